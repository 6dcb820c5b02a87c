"""Operator 2: mix sources to target weights along a time-varying curriculum.

Each source has a rate over training time, a piecewise linear schedule that is
scaled so that its integral is the source's target.  A source's documents queue
up in a fixed pseudo-random order, once per epoch.  The words ahead of a copy,
divided by the target, are the share of the source's demand that training has
used up when it reaches the copy; inverting the integrated schedule at that
share gives the copy's training position between 0 and 1.  Copies whose share
is 1 or more are not taken.

Running sums over a source would put a hot source into one task.  So documents
are dealt into ranges of their order hash, the ranges' totals are summed up
first, and only then each range is summed inside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Knots (time, rate) of the default curricula, dealt to the sources in the order of the weights.
CURRICULA = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Columns of the result.
RESULT = ("doc_id", "source", "size", "source_size", "target", "taken", "position", "epochs")
#: Documents that a range of the order hash holds on average.
RANGE_ROWS = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """Target words of each source: budget times all words, by weight, none above most times its size.

    sizes has source and source_size.  The level is found in closed form: sources
    fill up in the order of their limit over their weight; the first one that the
    rest of the budget, shared by weight, doesn't fill gives the level of all
    later ones.  There is one row per source, so one task may order them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full_at", "rank")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    ranked = ranked.withColumn("full_at", F.col("limit") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level)
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)["level"])
    return found.withColumn("target", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit"))).select("source", "source_size", "rank", "target")


def _position(share: Column, rank: Column, curricula: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The time at which a source's demand reaches the share, by inverting its integrated schedule."""
    cases = None
    for k, knots in enumerate(curricula):
        area = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]))
        piece, done = None, 0.0
        for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
            a, slope = r0 / area, (r1 - r0) / (t1 - t0) / area
            d = share - F.lit(done) if done else share
            root = a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * d))
            at = F.lit(t0) + F.when(root > 0, 2 * d / root).otherwise(0.0)
            done += (t1 - t0) * (r0 + r1) / 2 / area
            piece = F.when(share < done, at) if piece is None else piece.when(share < done, at)
        piece = piece.otherwise(knots[-1][0])
        chosen = rank % len(curricula) == k
        cases = F.when(chosen, piece) if cases is None else cases.when(chosen, piece)
    return cases


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    most: float = 2.0,
    curricula: Sequence[Sequence[tuple[float, float]]] = CURRICULA,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document, in the order of training: how many words the mix takes and where.

    docs has doc_id, text and source; columns named in keep are carried along
    (but for those named like a result, which it replaces), others are ignored.  Returns doc_id, source, size,
    source_size, target, taken, position (time of the first copy) and epochs
    (copies taken, the last perhaps in part).  Sources rank by code point, null
    is a source of its own and comes last.  Null and empty texts have size 0 and
    are taken with 0 words.  Repeated rows are documents of their own.  Where
    two rows tie in doc_id, the smaller one queues first.  An empty table gives
    no rows.  The order hash depends on doc_id and text alone, so reruns agree,
    and rows that share a doc_id are dealt to different ranges.
    """
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    key = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
    extra = [c for c in keep if c not in RESULT]
    carried = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in extra))
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), carried.alias("_row")))
    totals = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")))
    rows = totals.agg(F.sum("_n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, rows) / RANGE_ROWS)))
    sized = sized.withColumn("_range", F.shiftright(F.col("_key"), 60 - bits) if bits else F.lit(0).cast("long"))
    targets = source_targets(totals.drop("_n"), weights, budget, most)
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).drop("_words")
    t = targets.alias("t")
    ranges = ranges.alias("r").join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "_range", "_before", "source_size", "rank", "target")
    joined = sized.alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d._range") == F.col("r._range")))
    joined = joined.select("d.*", "_before", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    wanted = F.round("target").cast("long")
    epochs = math.ceil(most)

    def part(epoch: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), wanted - F.col("_start") - epoch * F.col("source_size")))

    taken = part(0)
    for epoch in range(1, epochs):
        taken = taken + part(epoch)
    placed = joined.withColumn("_start", start).withColumn("taken", taken.cast("long"))
    share = F.col("_start") / F.col("target")
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, _position(share, F.col("rank"), curricula)))
    placed = placed.withColumn("epochs", F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "epochs", *(F.col(f"_row.`{c}`") for c in extra)).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed: doc_id, size, source_size, target, taken, position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, rank,
         coalesce(least(most, weight * (SELECT arg_min(level, (most / weight, rank)) FROM levels WHERE level <= most / weight)), most)::DOUBLE AS target
  FROM levels),
queued AS (
  SELECT doc_id, size, source_size, target, rank,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, (greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - start - source_size)))::BIGINT AS taken,
         start / target AS share FROM queued)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE rank % 3 WHEN 0 THEN 2 * share / (1.5::DOUBLE + sqrt(1.5::DOUBLE * 1.5 + 2 * -1.0::DOUBLE * share))
            WHEN 1 THEN 2 * share / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * share))
            ELSE 2 * share / (0.5::DOUBLE + sqrt(0.5::DOUBLE * 0.5 + 2 * 1.0::DOUBLE * share)) END END AS position
FROM taking
"""
