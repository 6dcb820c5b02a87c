"""Operator 1: benchmark decontamination by winnowed word fingerprints.

Texts become words.  Every run of GRAM words is hashed, and of each run of
SPAN - GRAM + 1 consecutive hashes the least is kept, so any SPAN words that a
document shares with an item leave a common fingerprint in both.  Documents are
cut into overlapping blocks first: a window of SPAN words lies in the block it
starts in.  Fingerprints meet in a join, which carries the item's words around
the fingerprint; each meeting is then extended word by word to both sides and
counts if SPAN words agree.  Items shorter than SPAN words are one window and
are looked up by the hash of all their words, at every place of a document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, let, table

#: What stands between words, in lower-cased texts and in texts as they are.
GAP, RAW_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 5
#: Window starts in a block, and the bits that hold a place in it.
BLOCK, PLACE_BITS = 1024, 11
#: Fingerprints of the items up to which they are broadcast (about 0.3 kB each); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def _split(text: Column, gap: str) -> Column:
    # Splitting at gaps takes a small part of the time that Java's matcher needs to find words.
    return F.coalesce(F.array_remove(F.split(text, gap, -1), ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return _split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), GAP)


def word_count(text: Column) -> Column:
    """How many words a text has; lower-casing changes no word's bounds."""
    return F.size(_split(text, RAW_GAP))


def _blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per block: the first word's place and the block's words."""
    def cutting(w):
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(BLOCK)))
        return F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(w, s + 1, F.lit(BLOCK + SPAN - 1)).alias("words")))

    df = df.select(*keys, let(words(F.col("text")), cutting).alias("_cut"))
    return df.select(*keys, F.explode_outer("_cut").alias("_b")).filter("_b is not null").select(*keys, "_b.at", "_b.words")


def _grams(hashes: Column, length: int, last: Column) -> Column:
    """Hashes of all runs of so many words that start up to a place (from 1); the low bits are the place, so that minima know where they are."""
    high = F.lit(-1 << PLACE_BITS).cast("long")

    def gram(i):
        value = F.xxhash64(F.lit(length), *(F.get(hashes, i + j) for j in range(length)))
        return value.bitwiseAND(high).bitwiseOR(i.cast("long"))

    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), gram)).otherwise(F.array().cast("array<bigint>"))


def _window_min(values: Column, width: int) -> Column:
    """For each place, the least of the values from there on, width of them at most; in as many passes as width has bits."""
    def shifted(by):
        return lambda v: F.transform(v, lambda x, i: F.least(x, F.get(v, i + by)))

    def widened(v, step):
        if step == width:
            return v
        by = min(step, width - step)
        return let(shifted(by)(v), lambda w: widened(w, step + by))

    return widened(values, 1)


def _fingerprints(blocks: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds codes: winnowed hashes, and the hash at every place for each of the short items' lengths."""
    size = F.size("words")
    last = F.least(F.lit(BLOCK), size - (SPAN - 1))

    def coded(hashes):
        least = let(_grams(hashes, GRAM, size - (GRAM - 1)), lambda g: F.slice(_window_min(g, SPAN - GRAM + 1), F.lit(1), F.greatest(last, F.lit(1))))
        codes = [F.when(last >= 1, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))]
        return F.flatten(F.array(*codes, *(_grams(hashes, m, F.least(F.lit(BLOCK), size - (m - 1))) for m in lengths)))

    return blocks.withColumn("codes", let(_hashes(F.col("words")), coded))


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _run(pairs: list[tuple[Column, Column]]) -> Column:
    """How many of the first pairs are equal, up to the first that aren't."""
    equal = F.array(*(F.coalesce(a == b, F.lit(False)) for a, b in pairs))
    first = F.array_position(equal, False)
    return F.when(first == 0, len(pairs)).otherwise(first - 1).cast("int")


def item_fingerprints(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """Fingerprints of the items with the words around them, and the lengths of the short items."""
    items = items.select("item_id", "text")
    short = items.select(word_count(F.col("text")).alias("n")).filter(f"n > 0 and n < {SPAN}").distinct()
    lengths = sorted(r[0] for r in short.collect())  # SPAN - 1 values at most
    blocks = cut(_blocks(items, ["item_id"]))
    long = _fingerprints(blocks.filter(F.size("words") >= SPAN), []).select("item_id", "words", F.explode_outer("codes").alias("code"), F.lit(SPAN).alias("need"))
    found = long
    for m in lengths:
        own = blocks.filter((F.size("words") == m) & (F.col("at") == 0))
        found = found.unionByName(own.withColumn("code", let(_hashes(F.col("words")), lambda h: F.element_at(_grams(h, m, F.lit(1)), 1))).select("item_id", "words", "code", F.lit(m).alias("need")))
    place = F.col("code").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    back = SPAN - GRAM
    left = F.array(*(F.get("words", place - j) for j in range(1, back + 1)))
    right = F.array(*(F.get("words", place + j) for j in range(SPAN)))
    return found.select(F.shiftright("code", PLACE_BITS).alias("print"), "item_id", "need", left.alias("i_left"), right.alias("i_right")).distinct(), lengths


def hits(docs: DataFrame, items: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Shared spans: the keys, start and end (in words of the document) and item_id; spans may overlap."""
    prints, lengths = item_fingerprints(items)
    prints = cut(prints)
    blocks = _fingerprints(_blocks(docs, keys), lengths)
    place = F.col("code").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place")
    mark = F.shiftright("code", PLACE_BITS).alias("print")
    if prints.count() <= broadcast_rows:
        met = blocks.select(*keys, "at", "words", F.explode_outer("codes").alias("code")).select(*keys, "at", "words", place, mark).join(F.broadcast(prints), "print")
    else:
        met = blocks.select(*keys, "at", F.explode_outer("codes").alias("code")).select(*keys, "at", place, mark).join(prints, "print")
        same = [F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "at"]]
        on = same[0]
        for x in same[1:]:
            on = on & x
        met = met.alias("m").join(_blocks(docs, keys).alias("b"), on).select("m.*", "b.words")
    p = F.col("place")
    left = _run([(F.get("words", p - j), F.get("i_left", F.lit(j - 1))) for j in range(1, SPAN - GRAM + 1)])
    right = _run([(F.get("words", p + j), F.get("i_right", F.lit(j))) for j in range(SPAN)])
    met = met.select(*keys, "item_id", "need", (F.col("at") + p).alias("_p"), left.alias("_l"), right.alias("_r"))
    met = met.filter(F.col("_l") + F.col("_r") >= F.col("need"))
    return met.select(*keys, (F.col("_p") - F.col("_l")).alias("start"), (F.col("_p") + F.col("_r")).alias("end"), "item_id")


def contamination(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and _text_key.

    A word is hit if it lies in SPAN consecutive words that occur in an item, or
    in a whole item of fewer words.  Contaminated: at least one word in twenty is
    hit.  Null texts have no words; items without words match nothing.  Rows that
    repeat are documents of their own with equal results, and rows that share a
    doc_id but not the text don't mix.  Items that repeat count once; a null
    item_id marks words but isn't listed.  Other columns are ignored.
    """
    docs = docs.select("doc_id", "text").withColumn("_text_key", F.xxhash64("text"))
    keys = ["doc_id", "_text_key"]
    found = cut(hits(docs, items, keys, broadcast_rows).distinct())
    hit = found.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("w")).distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    listed = found.select(*keys, F.col("item_id").cast("string").alias("i")).distinct().groupBy(*keys).agg(F.count("i").alias("n_items"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("items"))
    out = docs.select(*keys, word_count(F.col("text")).cast("long").alias("n_words"))
    for name, part in (("h", hit), ("i", listed)):
        same = F.col("d.doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (F.col("d._text_key") == F.col(f"{name}._text_key"))
        out = out.alias("d").join(part.alias(name), same, "left").select("d.*", *(f"{name}.{c}" for c in part.columns if c not in keys))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "_text_key",
    )


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones; all columns stay, and rows that repeat stay as often as before.

    Null and empty texts have no words and stay; rows that share a doc_id are
    judged each by its own text.  Without items all stay.
    """
    bad = contamination(docs, items).filter("contaminated").select("doc_id", "_text_key").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("b._text_key"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_text_key")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT r, s, n, list_slice(w, s, s + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens)),
met AS (SELECT r, s, n, item_id FROM dw JOIN iw ON dw.win = iw.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM met) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
