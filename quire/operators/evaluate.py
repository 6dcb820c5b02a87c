"""Accuracy, regressions, model selection and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text


def evaluate(pairs: DataFrame) -> DataFrame:
    """Per script the mean error rates of its pairs (reference, hypothesis); a missing hypothesis is empty."""
    hyp = F.coalesce("hypothesis", F.lit(""))
    rated = pairs.withColumn("_cer", text.character_error_rate(F.col("reference"), hyp)).withColumn("_wer", text.word_error_rate(F.col("reference"), hyp))
    return rated.groupBy("script").agg(F.avg("_cer").alias("cer"), F.avg("_wer").alias("wer"), F.count("*").alias("samples"))


def regressions(report: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """report with whether a script is worse than its baseline; scripts without one aren't."""
    b = baseline.select("script", F.col("cer").alias("base_cer"), F.col("wer").alias("base_wer"))
    worse = (F.col("cer") > F.col("base_cer") + tolerance) | (F.col("wer") > F.col("base_wer") + tolerance)
    return report.join(b, "script", "left").withColumn("regressed", F.coalesce(worse, F.lit(False)))


def improvement(parent: Column, candidate: Column) -> Column:
    return F.when(parent == 0, 0.0).otherwise((parent - candidate) / parent * 100)


def promotion(candidate: DataFrame, parent: DataFrame, evaluated_on: str = "test", least_samples: int = 10, least_improvement: float = 1.0) -> DataFrame:
    """One row: whether a candidate's report (script, cer, samples) beats its parent's, and the first reason that speaks against it."""
    p = parent.select("script", F.col("cer").alias("parent_cer"))
    both = candidate.join(p, "script", "left").withColumn("parent_or_0", F.coalesce("parent_cer", F.lit(0.0)))
    one = both.agg(F.avg("cer").alias("mean_cer"), F.sum("samples").alias("samples"), F.coalesce(F.bool_or(F.col("cer") > F.col("parent_or_0")), F.lit(False)).alias("worse"))
    one = one.crossJoin(parent.agg(F.coalesce(F.avg("cer"), F.lit(0.0)).alias("parent_mean")))  # one row each
    better = improvement(F.col("parent_mean"), F.col("mean_cer"))
    verdict = F.when(F.lit(evaluated_on != "test"), "not_held_out").when(F.col("samples") < least_samples, "too_few_samples").when(F.col("worse"), "script_regressed")
    verdict = verdict.when(F.col("parent_mean") == 0, "parent_is_perfect").when(better < least_improvement, "too_small").otherwise("promote")
    return one.select("mean_cer", "parent_mean", "samples", better.alias("improvement"), verdict.alias("verdict"))


def candidate_scores(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per model: half its confidence, 0.4 of its lexicon hits and a tenth for the lack of impossible diacritics.

    Confidences are on a scale of 100 if any of the model's exceeds 1.
    """
    key = text.monotonize(text.lexicon_key(F.col("token")))
    words = lines.select("model", F.explode(text.tokens(F.col("text"))).alias("token")).withColumn("key", key).filter("key != ''")
    forms = lexicon.select(text.monotonize(F.lower("form")).alias("key")).distinct().withColumn("known", F.lit(1))
    hits = words.join(forms, "key", "left").groupBy("model").agg((F.sum(F.coalesce("known", F.lit(0))) / F.count("*")).alias("hit"))
    scale = F.when(F.max("conf") > 1, 100.0).otherwise(1.0)
    flags = F.size(text.diacritic_violations(F.col("text")))
    sizes = lines.withColumn("_v", flags).withColumn("_n", F.length(F.regexp_replace(F.col("text"), r"\p{M}", "")))
    each = sizes.groupBy("model").agg((F.avg("conf") / scale).alias("confidence"), (F.sum("_v") / F.greatest(F.sum("_n"), F.lit(1))).alias("violations"))
    out = each.join(hits, "model", "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    return out.withColumn("score", 0.5 * F.col("confidence") + 0.4 * F.col("hit") + 0.1 * (1 - F.col("violations")))


def select_best(scores: DataFrame, default: str) -> DataFrame:
    """The best model; ties go to the default, then to the least name."""
    order = Window.orderBy(F.desc("score"), F.desc(F.col("model") == default), "model")  # a row per model
    return scores.withColumn("rank", F.row_number().over(order))
