"""Operator 10: remove byte strings that an earlier document holds, with a run-length index.

WIDTH bytes that two documents share have the same least hash among their
24-byte grams.  That hash is the window's key.

1. Texts that are equal as a whole are one class; only its first document is
   searched, all later ones go as a whole.
2. Each task gathers the keys of its documents.  Keys that two documents of a
   task share are known at once; of every other key one row of bytes per task and
   bucket goes on, so a frequent key is sent once per task.  Buckets find the keys
   that several tasks have.
3. Documents learn which of their keys are shared, and send the bytes around
   each such key, a stretch of at most 74 bytes unless the text repeats itself;
   longer ones are cut into pieces that overlap by all but one byte of a window.
   Stretches are dealt by key and sorted; equal ones enter once, with their first
   document.  Per batch of keys a run-length index of the stretches is built (see
   rindex): matching statistics from its run heads tell which windows occur again,
   and each of those gets the least document that holds it.
4. Windows whose least document comes before their own are removed.

Hashes only choose what meets; the index compares bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytestools import U64, gram_hashes, ranges, slices, window_min
from quire.llm.common import cut, table
from quire.llm.rindex import MOST, RunIndex

WIDTH, GRAM = 50, 24
#: Bytes of text whose keys make up one bucket, about 300,000 keys.
BUCKET_BYTES = 4 << 20
#: Bytes of text whose keys are found at once, so that what is gathered on the way fits into a core's cache.
CACHED = 1 << 16
#: Keys that a task gathers before it sends them on.
FLUSH_KEYS = 1 << 20
#: Symbols of an index; the stretches of a key that have more are indexed in parts that pass on what is new,
#: and each part meets what earlier ones passed on and may hold a window of its own, by half as many symbols at once.
INDEX_SYMBOLS = MOST // 2
#: Bytes of a stretch, at most, and stretches of a part, copies included.
PIECE, PART = 4096, 100_000
LAST_ID = (1 << 63) - 1


def window_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each place's window, whether the window lies in one text, and the text that the place is in."""
    key = window_min(gram_hashes(data), WIDTH - GRAM + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(key)]
    return key, np.arange(len(key)) + WIDTH <= at[1:][text], text


def _gather(bits: int):
    """Keys of documents as rows (bucket, keys, places, ids), where a place points into ids.

    The first bits of a key are its bucket's number, and the 32 bits that follow
    are sent; what they wrongly take for shared, the index finds to be different.
    Negative buckets hold keys that are known to be shared, with their bucket's bits.
    """
    schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("places", pa.binary()), ("ids", pa.binary())])

    def flush(found: list[tuple[np.ndarray, np.ndarray]], number: int) -> pa.RecordBatch:
        key, doc = np.concatenate([k for k, _ in found]), np.concatenate([d for _, d in found])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(first)
        count = np.diff(np.append(starts, len(key)))
        rows = []
        several = np.repeat(count > 1, count)
        if several.any():
            rows.append((-1 - number % 64, key[several], doc[several]))
        # One document stands for a shared key; it is told once more if other tasks have the key too.
        key, doc = key[starts], doc[starts]
        bucket = (key >> U64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for b, k, d in zip(bucket[np.concatenate(([0], cuts))] if len(key) else [], np.split(key.astype(np.uint32), cuts), np.split(doc, cuts)):
            rows.append((int(b), k, d))
        blobs = []
        for _, k, d in rows:
            ids, place = np.unique(d, return_inverse=True)
            blobs.append((k.tobytes(), place.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32).tobytes(), ids.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([b[i] for b in blobs], pa.binary()) for i in range(3))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, number = [], 0, 0
        for rows, data, at in slices(batches, "bytes", CACHED):
            key, good, text = window_keys(data, at)
            turn = good.copy()
            turn[1:] &= (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            found.append((key[turn] >> U64(32 - bits), ids[text[turn]]))
            held += len(found[-1][0])
            if held >= FLUSH_KEYS:
                yield flush(found, number)
                found, held, number = [], 0, number + 1
        if held:
            yield flush(found, number)

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket, the keys that several rows hold, as a row of keys for each document."""
    bucket = int(pdf["bucket"].iloc[0])
    kind = np.dtype(np.uint32 if bucket >= 0 else U64)
    key = np.frombuffer(b"".join(pdf["keys"]), kind).astype(U64)
    doc = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(p, np.uint16 if len(p) * kind.itemsize == len(k) * 2 else np.uint32)] for k, p, i in zip(pdf["keys"], pdf["places"], pdf["ids"])])
    if bucket >= 0:
        key += U64(bucket << 32)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        key, doc = key[same], doc[same]
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    starts = np.flatnonzero(np.diff(doc, prepend=-LAST_ID))
    return pd.DataFrame({"doc_id": doc[starts], "keys": [k.tobytes() for k in np.split(key, starts[1:])] if len(doc) else []})


def _pieces(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges cut into pieces of PIECE bytes at most, such that each window is in just one."""
    step = PIECE - WIDTH + 1
    count = -(-(end - begin - WIDTH + 1) // step)
    start = np.repeat(begin, count) + step * ranges(np.zeros_like(begin), count)
    return start, np.minimum(start + PIECE, np.repeat(end, count))


def _window_hashes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all windows of the strings, and the string each is in."""
    lengths = np.array([len(s) for s in strings])
    g = gram_hashes(np.frombuffer(b"".join(strings), np.uint8))
    at = ranges(np.cumsum(lengths) - lengths, lengths - WIDTH + 1)
    h = (g[at] * U64(0x9E3779B97F4A7C15) + g[at + GRAM]) * U64(0xD6E8FEB86659FD93) + g[at + WIDTH - GRAM]
    string = np.repeat(np.arange(len(strings)), lengths - WIDTH + 1)
    order = np.argsort(h, kind="stable")
    return h[order], string[order]


class _Carried:
    """Strings with new windows of a key's earlier parts, and their documents."""

    def __init__(self):
        self.strings: list[tuple[bytes, int]] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, more: list[tuple[bytes, int]]) -> None:
        if more:
            h, string = _window_hashes([s for s, _ in more])
            self.parts.append((h, string + len(self.strings)))
            self.strings += more

    def meeting(self, strings: list[bytes]) -> list[list[tuple[bytes, int]]]:
        """Those that may share a window with one of the strings, in lists of bounded size; one list at least."""
        out, size = [[]], 0
        if self.parts:
            own = np.unique(_window_hashes(strings)[0])
            which = [string[own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h] for h, string in self.parts]
            for k in np.unique(np.concatenate(which)):
                more = len(self.strings[k][0]) + 1
                if out[-1] and size + more > INDEX_SYMBOLS // 2:
                    out.append([])
                    size = 0
                out[-1].append(self.strings[k])
                size += more
        return out


def _stretches(bits: int):
    """The bytes around each shared key of a document: (key, doc_id, text_key, start, bytes)."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches, "bytes", CACHED):
            key, good, text = window_keys(data, at)
            known = np.unique(np.frombuffer(b"".join(k for part in rows.column("keys").to_pylist() for k in part), U64))
            if not len(key) or not len(known):
                continue
            # Runs of places with one key; the keys of their first places are looked up.
            edge = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            begin, end = good.copy(), good.copy()
            begin[1:] &= edge | ~good[:-1]
            end[:-1] &= edge | ~good[1:]
            begin, end = np.flatnonzero(begin), np.flatnonzero(end)
            sent = key[begin] >> U64(32 - bits)
            wanted = known[np.minimum(np.searchsorted(known, sent), len(known) - 1)] == sent
            begin, end = _pieces(begin[wanted], end[wanted] + WIDTH)
            lengths = end - begin
            own = text[begin]
            for lo in range(0, len(begin), 20_000):
                part = slice(lo, lo + 20_000)
                offsets = np.concatenate(([0], np.cumsum(lengths[part]))).astype(np.int32)
                blob = data[ranges(begin[part], lengths[part])]
                values = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(blob.tobytes())])
                ids = [rows.column(c).to_numpy(zero_copy_only=False)[own[part]] for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([pa.array(key[begin[part]].view(np.int64)), *map(pa.array, ids), pa.array((begin[part] - at[own[part]]).astype(np.int32)), values], schema=schema)

    return run


def _search(strings: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the strings, the least owner of an equal window; and where each string's windows start."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    index = RunIndex(np.frombuffer(b"".join(strings), np.uint8), starts)
    least = index.least_owner(owner, WIDTH)
    return least[least >= 0], np.concatenate(([0], np.cumsum(np.diff(starts) - WIDTH + 1)))


def _marks(strings: list[bytes], which: np.ndarray, owner: np.ndarray, doc: np.ndarray, text_key: np.ndarray, start: np.ndarray):
    """Removed ranges of the occurrences (string which of document doc at start), and for each string where its first new window starts and its last ends (-1: none)."""
    least, first = _search(strings, owner)
    news = np.full((len(strings), 2), -1)
    whole = doc > owner[which]
    size = np.array([len(s) for s in strings])
    out = [(doc[whole], text_key[whole], start[whole], start[whole] + size[which[whole]])]
    windows = np.diff(first)
    gone = least < np.repeat(owner, windows)
    fresh = np.flatnonzero(~gone)
    if len(fresh):
        string = np.repeat(np.arange(len(strings)), windows)[fresh]
        ends = np.flatnonzero(np.diff(string, append=-1))
        begins = np.concatenate(([0], ends[:-1] + 1))
        news[string[begins], 0] = fresh[begins] - first[string[begins]]
        news[string[ends], 1] = fresh[ends] - first[string[ends]] + WIDTH
    # Of the first document, runs of windows that an earlier one holds in another string.
    partly = np.flatnonzero(~whole & (np.add.reduceat(np.append(gone, False), first[:-1])[which] > 0 if len(strings) else whole))
    for o in partly:
        flags = np.concatenate(([False], gone[first[which[o]] : first[which[o] + 1]], [False]))
        turns = np.flatnonzero(flags[1:] != flags[:-1])
        lo, hi = turns[::2], turns[1::2] - 1 + WIDTH
        out.append((np.full(len(lo), doc[o]), np.full(len(lo), text_key[o]), start[o] + lo, start[o] + hi))
    return [np.concatenate(x) for x in zip(*out)], news


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed ranges (doc_id, text_key, start, stop) from stretches that are sorted by key and document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    held: list = []  # of (key, doc, text_key, start, bytes)
    distinct: set[bytes] = set()  # of held
    carried = _Carried()

    def process(rows: list, more: list[tuple[bytes, int]]):
        """Removed ranges of the rows' stretches, and the range of each distinct one (with its first document) that has new windows."""
        number: dict[bytes, int] = {}
        owner: list[int] = []
        which = np.empty(len(rows), np.int64)
        for i, r in enumerate(rows):
            which[i] = k = number.setdefault(r[4], len(number))
            if k == len(owner):
                owner.append(r[1])
            elif r[1] < owner[k]:
                owner[k] = r[1]
        own = len(number)
        for s, d in more:
            k = number.setdefault(s, len(number))
            if k == len(owner):
                owner.append(d)
            elif d < owner[k]:
                owner[k] = d
        strings, owners = list(number), np.array(owner, np.int64)
        found, news = _marks(strings, which, owners, *(np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3)))
        return found, strings[:own], owners[:own], news[:own]

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.int32)), pa.array(found[3].astype(np.int32))], schema=schema)

    def finish(rows: list, pass_on: bool = False):
        """Rows against one another and all that is carried; if asked, what is new in them is carried from then on."""
        lo = hi = None
        for more in carried.meeting(list({x[4] for x in rows})):
            found, strings, owner, news = process(rows, more)
            yield emit(found)
            # A window that is new is so in every list's range.
            ends = np.where(news[:, 0] >= 0, news[:, 1], 0)
            lo, hi = (news[:, 0], ends) if lo is None else (np.maximum(lo, news[:, 0]), np.minimum(hi, ends))
        if pass_on:
            carried.add([(s[a:b], int(o)) for s, o, a, b in zip(strings, owner, lo, hi) if a >= 0 and b - a >= WIDTH])

    size = 0  # symbols of distinct
    for batch in batches:
        for r in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("key", "doc_id", "text_key", "start", "bytes"))):
            more = 0 if r[4] in distinct else len(r[4]) + 1
            if held and r[0] != held[-1][0] and (size >= INDEX_SYMBOLS // 2 or len(held) >= PART // 2 or carried.parts):
                yield from finish(held)
                held, distinct, size, carried, more = [], set(), 0, _Carried(), len(r[4]) + 1
            elif held and (size + more > INDEX_SYMBOLS or len(held) >= PART):
                # Keys before the last are whole; the last goes on, with what was new in it.
                last = held[-1][0]
                done = [x for x in held if x[0] != last]
                part = [x for x in held if x[0] == last]
                if done:
                    yield from finish(done)
                    held, distinct = part, {x[4] for x in part}
                    size = sum(map(len, distinct)) + len(distinct)
                if r[0] == last and (size > INDEX_SYMBOLS // 4 or len(held) >= PART // 4):
                    yield from finish(held, True)
                    held, distinct, size = [], set(), 0
                more = 0 if r[4] in distinct else len(r[4]) + 1
            held.append(r)
            distinct.add(r[4])
            size += more
    if held:
        yield from finish(held)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text; rows without ranges pass with the digest they have."""
    for batch in batches:
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, key, size, digest, copy, found in zip(*(batch.column(c).to_pylist() for c in ("bytes", "text_key", "n_bytes", "digest", "is_copy", "ranges"))):
            if copy:
                found = [{"text_key": key, "start": 0, "stop": size}]
                text = bytes(size) if text is None else text
            merged: list[list[int]] = []
            for lo, hi in sorted((r["start"], r["stop"]) for r in found or () if r["text_key"] == key):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            left = text
            if merged:
                left = b"".join(text[a:b] for a, b in zip([0, *(m[1] for m in merged)], [*(m[0] for m in merged), len(text)]))
                digest = hashlib.sha256(left).hexdigest()
            out["n_removed"].append(sum(hi - lo for lo, hi in merged))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(digest)
            out["kept"].append(left)
        types = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, types[k]) for k, v in out.items())], names=["doc_id", "n_bytes", *out])


def removed_ranges(texts: DataFrame, n_bytes: int) -> DataFrame:
    """Byte ranges (may overlap) of WIDTH or more that a text with a smaller doc_id holds too. texts: doc_id, text_key, bytes."""
    bits = min(32, max(0, math.ceil(math.log2(max(1, n_bytes) / BUCKET_BYTES))))
    keys = texts.select("doc_id", "bytes").mapInArrow(_gather(bits), "bucket long, keys binary, places binary, ids binary")
    shared = keys.groupBy("bucket").applyInPandas(_meet, "doc_id long, keys binary").groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    around = texts.join(shared, "doc_id").select("doc_id", "text_key", "bytes", "keys").mapInArrow(_stretches(bits), "key long, doc_id long, text_key long, start int, bytes binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = around.repartition(max(parts, math.ceil(n_bytes / (32 << 20))), "key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(_index, "doc_id long, text_key long, start int, stop int")


def deduplicate(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (the bytes left).

    Null texts are empty.  Texts of fewer than WIDTH bytes keep all.  A null
    doc_id counts as the largest.  Rows that share a doc_id remove nothing from
    each other, whether they repeat or differ; each gets a row.  Other columns
    are ignored.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), text.alias("bytes"))
    light = docs.select("doc_id", F.sha2("bytes", 256).alias("digest"), F.xxhash64("bytes").alias("text_key"), F.length("bytes").cast("long").alias("n_bytes")).distinct()
    light = cut(light)
    first = light.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("first_id"))
    light = cut(light.join(first, light["digest"] == first["_digest"]).drop("_digest").withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_text_key"))
    total = light.filter("_id = first_id").agg(F.sum("n_bytes")).first()[0] or 0
    # One frame for all uses, joined by doc_id alone, so that one exchange of the texts serves them all.
    docs = docs.withColumn("text_key", F.xxhash64("bytes"))
    every = docs.join(light, (docs["doc_id"] == light["_id"]) & (docs["text_key"].bitwiseXOR(light["_text_key"]) == 0))
    firsts = every.filter(f"_id = first_id and n_bytes >= {WIDTH}").select("doc_id", "text_key", "bytes")
    found = removed_ranges(firsts, total).groupBy(F.col("doc_id").alias("_of")).agg(F.collect_list(F.struct("text_key", "start", "stop")).alias("ranges"))
    every = every.join(found, every["doc_id"] == found["_of"], "left")
    is_copy = (F.col("_id") > F.col("first_id")) & (F.col("n_bytes") >= WIDTH)
    needed = F.col("bytes") if with_text else F.when(F.col("ranges").isNotNull() & ~is_copy, F.col("bytes"))
    out = every.select("doc_id", needed.alias("bytes"), "text_key", "n_bytes", "digest", is_copy.alias("is_copy"), "ranges")
    out = out.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))
    return out if with_text else out.drop("kept")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, each without the bytes that earlier ones hold."""
    return deduplicate(table(spark, sf_dir, "documents"), with_text=False)


SQL = r"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, doc_id, p, b[p + 1:p + 50] AS s FROM (SELECT r, doc_id, b, unnest(range(octet_length(b) - 49)) AS p FROM h WHERE octet_length(b) >= 50)),
bad AS (SELECT r, p FROM w JOIN (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s) USING (s) WHERE doc_id > first_id),
apart AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 50, true)::INT AS new FROM bad),
spans AS (SELECT r, min(p) AS lo, max(p) + 50 AS hi FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM apart) GROUP BY r, g),
ahead AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS after FROM spans),
found AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(hex(b[after + 1:lo]), '' ORDER BY lo) AS kept FROM ahead JOIN h USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1:]))) AS kept_sha256
FROM h LEFT JOIN found USING (r)
"""
