"""Operator 5: n-gram Jaccard join with a forest of MinHash tries.

A document is the set of its SHINGLE-word shingles.  Each tree of the forest has
a path of DEPTH minima under random hashes, and documents with a common path
prefix meet in it.  The prefix that must agree starts at the whole path and is
shortened until two documents at the threshold meet in some tree with at least
the target probability (4 of 8 at 0.8 and 0.999).  A document's neighbours aren't known before
they are verified, so the prefix is as long for all documents; shortening it by
what a document has met would favour trees that its neighbours aren't in.
Every meeting is verified by the exact sets, in the first tree in which the two
meet, so each pair is counted once.

Documents with the same shingles, each as often, are one class and enter once.
Large prefix groups are dealt into chunks, and each pair of chunks is a task of
its own, which returns counts and a spanning star, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytestools import U64, mixed, slices, word_hashes
from quire.llm.common import cut, table, whole_row
from quire.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.999
#: Members of a prefix group that are dealt into one chunk, on average.
CHUNK = 1000
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096
LAST_ID = (1 << 63) - 1

_RNG = np.random.Generator(np.random.PCG64(5))
_FACTORS = _RNG.integers(0, 1 << 63, (TREES, DEPTH), U64) * U64(2) + U64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, (TREES, DEPTH), U64)


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix by which pairs at the threshold meet in some tree with the wanted probability; at least 1."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts end to end, and the text each is in; fewer words than width are one shingle."""
    h, text = word_hashes(data, at)
    if not len(h):
        return h, text
    first = np.searchsorted(text, np.arange(len(at) - 1))
    count = np.diff(np.append(first, len(h)))
    out = h.copy()
    for k in range(1, width):
        # Words that the text no longer has count as nothing, which only short texts' one shingle meets.
        follows = np.zeros(len(h), U64)
        follows[:-k] = np.where(text[k:] == text[:-k], h[k:], U64(0)) if len(h) > k else follows[:-k]
        out = out * U64(0x9E3779B97F4A7C15) ^ (out >> U64(31))
        out += follows
    out = mixed(out)
    keep = np.arange(len(h)) < (first + np.maximum(count - width + 1, np.minimum(count, 1)))[text]
    return out[keep], text[keep]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: two sums over its shingles that name its class, how many it has, and its paths."""
    for rows, data, at in slices(batches, "bytes"):
        x, text = shingles(data, at)
        count = np.bincount(text, minlength=len(at) - 1)
        has = np.flatnonzero(count)
        start = np.searchsorted(text, has)
        one, two = np.zeros(len(count), U64), np.zeros(len(count), U64)
        paths = np.zeros((len(count), TREES, DEPTH), ">u2")
        if len(has):
            one[has] = np.add.reduceat(mixed(x + U64(0x2545F4914F6CDD1D)), start)
            two[has] = np.add.reduceat(mixed(x ^ U64(0x9FB21C651E98DF25)), start)
            for t in range(TREES):
                for d in range(DEPTH):
                    paths[has, t, d] = np.minimum.reduceat(x * _FACTORS[t, d] + _SHIFTS[t, d], start) >> U64(48)
        flat = np.ascontiguousarray(paths).tobytes()
        width = TREES * DEPTH * 2
        blobs = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(np.arange(0, len(flat) + 1, width, dtype=np.int32).tobytes()), pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(count.astype(np.int64)), blobs], names=["doc_id", "text_key", "class", "class2", "n", "paths"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's class and its distinct shingles."""
    for _, data, at in slices(batches, "bytes"):
        x, text = shingles(data, at)
        count = np.bincount(text, minlength=len(at) - 1)
        has = np.flatnonzero(count)
        start = np.searchsorted(text, has)
        one = np.add.reduceat(mixed(x + U64(0x2545F4914F6CDD1D)), start) if len(has) else np.empty(0, U64)
        yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array([np.unique(s).tobytes() for s in np.split(x, start[1:])] if len(has) else [], pa.binary())], names=["class", "shingles"])


def _first_meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of tasks (key, i, j) that lie together, the members that meet another one there for the first time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        # The last task may go on in the next batch.
        task = pdf[["key", "i", "j"]].to_numpy()
        other = np.flatnonzero((task != task[-1]).any(1))
        whole = int(other[-1]) + 1 if len(other) else 0
        if whole:
            yield _meeting(pd.concat([*held, pdf.iloc[:whole]]))
            held = []
        held.append(pdf.iloc[whole:])
    if held:
        yield _meeting(pd.concat(held))


def _meeting(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of whole tasks that meet another one there for the first time."""
    if not len(pdf):
        return pdf
    task = pdf[["key", "i", "j"]].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]).any(1))))
    size = np.diff(np.append(start, len(pdf)))
    keys = np.frombuffer(b"".join(pdf["keys"]), np.int64).reshape(len(pdf), TREES)
    tree, needed = pdf["tree"].to_numpy(), np.zeros(len(pdf), bool)
    # Most groups are pairs, and those are looked at all at once.
    two = start[(size == 2) & (task[start, 1] == task[start, 2])]
    apart = (keys[two] != keys[two + 1]) | (np.arange(TREES) >= tree[two, None])
    new = apart.all(1)
    needed[two[new]] = needed[two[new] + 1] = True
    for at, count in zip(start[(size > 2) | (task[start, 1] != task[start, 2])], size[(size > 2) | (task[start, 1] != task[start, 2])]):
        group, own = pdf.iloc[at : at + count], keys[at : at + count]
        for lo in range(0, count, 256):
            meets = _new_pairs(own, group, int(tree[at]), slice(lo, lo + 256))
            needed[at + lo : at + min(lo + 256, count)] |= meets.any(1)
            needed[at : at + count] |= meets.any(0)
    return pdf.loc[needed, ["tree", "key", "i", "j", "chunk", "class", "size", "keys"]]


def _new_pairs(keys: np.ndarray, pdf: pd.DataFrame, tree: int, rows: slice) -> np.ndarray:
    """Pairs of these rows with all: of the task's two chunks, in order, and not together in an earlier tree."""
    chunk, i, j = pdf["chunk"].to_numpy(), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    place = np.arange(len(keys))
    new = (chunk[rows, None] == i) & (chunk[None, :] == j)
    if i == j:
        new &= place[rows, None] < place[None, :]
    for t in range(tree):
        new &= keys[rows, t, None] != keys[None, :, t]
    return new


def _verify(threshold: float):
    """Exact similarity of a task's new pairs: for each member how many documents it is linked with here, and the least class it is connected to."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"class": np.empty(0, np.int64), "links": np.empty(0, np.int64), "least": np.empty(0, np.int64)})
        if len(pdf) < 2:
            return empty
        sets = [np.frombuffer(s, U64) for s in pdf["shingles"]]
        size = np.array([len(s) for s in sets])
        own = np.repeat(np.arange(len(sets)), size)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        # Shingles that the same members hold are one column with a weight; those of one member touch no pair.
        sign = mixed(np.arange(1, len(sets) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        held = np.zeros(column.max() + 1, U64)
        np.add.at(held, column, sign[own])
        times = np.bincount(column)
        pattern, first, weight = np.unique(held, return_index=True, return_counts=True)
        many = times[first] > 1
        number = np.full(len(held), -1)
        number[first[many]] = np.arange(many.sum())
        weight = weight[many].astype(np.float32)
        entry = number[column] >= 0
        row, col = own[entry], number[column[entry]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), np.float64)
        for lo in range(0, len(weight), COLUMNS):
            part = slice(*np.searchsorted(col, [lo, lo + COLUMNS]))
            wide = min(COLUMNS, len(weight) - lo)
            x = np.zeros((len(sets), wide), np.float32)
            x[row[part], col[part] - lo] = 1
            both += (x * weight[lo : lo + wide]) @ x.T
        union = size[:, None] + size[None, :] - both
        keys = np.array([np.frombuffer(p, np.int64) for p in pdf["keys"]])
        linked = _new_pairs(keys, pdf, int(pdf["tree"].iloc[0]), slice(0, len(pdf)))
        linked &= both >= threshold * union - 1e-6
        linked |= linked.T
        some = linked.any(1)
        if not some.any():
            return empty
        linked, classes, sizes = linked[some][:, some], pdf["class"].to_numpy()[some], pdf["size"].to_numpy()[some]
        least = classes.copy()
        while True:
            lower = np.minimum(least, np.where(linked, least[None, :], LAST_ID).min(1))
            if (lower == least).all():
                break
            least = lower
        return pd.DataFrame({"class": classes, "links": linked @ sizes, "least": least})

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, n_links, component_id, kept.

    class_id is the least doc_id with the same shingles, n_links the number of
    other documents of similarity threshold or more, component_id the least
    doc_id reachable by links, and kept marks that document.  Words are what
    stands between whitespace, with A-Z in lower case.  Texts of fewer than five
    words are one shingle of all their words; null texts and texts without words
    are linked with nothing.  Rows that repeat are documents linked with each
    other; rows that share a doc_id but not the text don't mix.  A null doc_id
    counts as the largest.  Other columns are ignored.
    """
    depth = prefix_depth(threshold, recall)
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), text.alias("bytes")).withColumn("text_key", F.xxhash64("bytes"))
    signed = cut(docs.mapInArrow(_signatures, "doc_id long, text_key long, class long, class2 long, n long, paths binary"))
    classes = signed.filter("n > 0").groupBy("class", "class2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"), F.first("paths").alias("paths"))
    prefixes = [F.xxhash64(F.lit(t), F.substring("paths", t * DEPTH * 2 + 1, depth * 2)) for t in range(TREES)]
    classes = cut(classes.withColumn("prefixes", F.array(*prefixes)).drop("paths"))
    placed = classes.select("class", F.posexplode("prefixes").alias("tree", "key"))
    groups = placed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = placed.join(groups, "key").join(classes.select("class", "size", "prefixes"), "class")
    pack = F.unhex(F.array_join(F.transform("prefixes", lambda p: F.lpad(F.hex(p), 16, "0")), ""))
    members = members.withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.hash("class"), "chunks"))
    # A member of chunk c is wanted by the tasks (i, j), i <= j, that have c in them.
    tasks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, "chunk").alias("i"), F.greatest(o, "chunk").alias("j")))
    members = members.select("tree", "key", "class", "size", "chunk", pack.alias("keys"), F.explode(tasks).alias("task")).select("*", "task.i", "task.j").drop("task")
    shape = "tree int, key long, i int, j int, chunk int, class long, size long, keys binary"
    together = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    needed = cut(together.mapInPandas(_first_meetings, shape))
    wanted = needed.select("class").distinct().join(classes, "class").select(F.col("class_id").alias("doc_id")).distinct()
    sets = docs.join(wanted, "doc_id").select("bytes").mapInArrow(_sets, "class long, shingles binary")
    sets = sets.groupBy("class").agg(F.first("shingles").alias("shingles"))
    found = needed.join(sets, "class").groupBy("key", "i", "j").applyInPandas(_verify(threshold), "class long, links long, least long")
    found = cut(found)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    whole = components(found.filter("class != least").select(F.col("class").alias("a"), F.col("least").alias("b")))
    joined = classes.select("class", "class_id", "size").join(links, "class", "left").join(whole.withColumnRenamed("node", "class"), "class", "left")
    joined = joined.withColumn("component", F.coalesce("component", "class"))
    least = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    joined = joined.join(least, "component").select(F.col("class").alias("_class"), "class_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    rows = signed.select("doc_id", "text_key", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    out = rows.join(joined, rows["class"] == joined["_class"], "left")
    back = lambda c: F.nullif(c, F.lit(LAST_ID))
    component = F.coalesce("component_id", "doc_id")
    return out.select(back(F.col("doc_id")).alias("doc_id"), "text_key", back(F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), back(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def remove_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each component, that with the least doc_id; of rows that repeat it, one. All columns stay.

    A null doc_id counts as the largest.  Null texts and texts without words are
    linked with nothing and all stay; an empty table stays empty.
    """
    found = join(docs.select("doc_id", "text"), threshold).filter("kept").groupBy("doc_id", "text_key").agg(F.max("n_links").alias("n_links"))
    key = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")))
    packed = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), key.alias("_key"))
    kept = packed.join(found, packed["_id"].eqNullSafe(found["doc_id"]) & (packed["_key"] == found["text_key"])).select("_row", "_id", "_key", "n_links")
    # Only linked documents can repeat; texts without words stay as they are.
    return kept.filter("n_links = 0").select("_row.*").unionByName(kept.filter("n_links > 0").dropDuplicates(["_id", "_key"]).select("_row.*"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id, n_links, component_id, kept."""
    return join(table(spark, sf_dir, "documents")).drop("text_key")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
every AS (SELECT r, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
s AS (SELECT DISTINCT r, g FROM every),
size AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r < b.r GROUP BY 1, 2),
pair AS (SELECT a, b FROM both_ JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a),
same AS (SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM every GROUP BY r),
class AS (SELECT r, min(doc_id) OVER (PARTITION BY k) AS class_id FROM same JOIN d USING (r)),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = doc_id AS kept
FROM d LEFT JOIN n ON n.a = d.r LEFT JOIN class USING (r) JOIN least ON least.a = d.r
"""
