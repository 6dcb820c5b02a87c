"""The review desk: suggestions on lines, overrides, corrections, search and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

PAGE = ["doc_id", "page_no"]


def final_text(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """lines with final_text: an accepted override, else an edited one, else the recognized text."""
    own = lambda s: overrides.filter(F.col("store") == s).select("line_id", F.col("text").alias(f"_{s}"))
    out = lines.join(own("accepted"), "line_id", "left").join(own("edited"), "line_id", "left")
    return out.withColumn("final_text", F.coalesce("_accepted", "_edited", "text")).withColumn("touched", F.col("_accepted").isNotNull() | F.col("_edited").isNotNull()).drop("_accepted", "_edited")


def with_suggestions(lines: DataFrame, suggestions: DataFrame) -> DataFrame:
    """lines with their suggestions in order, as an array."""
    s = suggestions.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_text", "suggestion_text", "reason", "reversible", "start", "end"))).alias("suggestions"))
    return lines.join(s, "line_id", "left").withColumn("n_suggestions", F.coalesce(F.size("suggestions"), F.lit(0)))


def by_reason(suggestions: DataFrame) -> DataFrame:
    """Suggestions by reason, with their share in whole per cent."""
    n = suggestions.groupBy("reason").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row per reason
    return n.withColumn("percent", F.floor(F.col("n") * 100 / total).cast("int"))


def search(lines: DataFrame, query: str, limit: int = 15, width: int = 60) -> DataFrame:
    """The first lines whose final_text holds the query, whatever the case, with a snippet."""
    snippet = F.when(F.length("final_text") > width, F.concat(F.substring("final_text", 1, width), F.lit("…"))).otherwise(F.col("final_text"))
    hit = lines.filter(F.contains(F.lower("final_text"), F.lit(query.lower())))
    return hit.orderBy("page_no", "line_idx").limit(limit).select("page_no", "line_idx", snippet.alias("snippet"))


def page_summary(lines: DataFrame, suggestions: DataFrame, low: float = 50.0) -> DataFrame:
    """Per page: lines, lines of low confidence, mean confidence and suggestions."""
    per = lines.groupBy(*PAGE).agg(F.count("*").alias("n_lines"), F.count_if(F.col("conf") < low).alias("low_lines"), F.avg("conf").alias("mean_conf"))
    s = suggestions.join(lines.select("line_id", *PAGE), "line_id").groupBy(*PAGE).agg(F.count("*").alias("n_suggestions"))
    return per.join(s, PAGE, "left").withColumn("n_suggestions", F.coalesce("n_suggestions", F.lit(0)))


def worst_pages(summary: DataFrame, limit: int = 10) -> DataFrame:
    return summary.orderBy("mean_conf", "page_no").limit(limit)


def latest_revision(corrections: DataFrame) -> DataFrame:
    over = Window.partitionBy("line_id").orderBy(F.desc("corrected_at"), F.desc("corrected_text"))
    return corrections.withColumn("_r", F.row_number().over(over)).filter("_r = 1").drop("_r")


def eligible_samples(corrections: DataFrame, least_height: int = 8, scripts: list[str] | None = None) -> DataFrame:
    """Accepted corrections with text, a box of some height and a wanted script; texts are stripped."""
    kept = corrections.filter(F.col("accepted") & (F.btrim("corrected_text") != "") & (F.col("h") >= least_height))
    if scripts:
        kept = kept.filter(F.col("script").isin(scripts))
    return kept.withColumn("text", F.btrim("corrected_text"))


def with_images(samples: DataFrame, images: DataFrame) -> DataFrame:
    """Samples with their page's image; a sample without one fails the job."""
    out = samples.join(images.select("page_no", "image"), "page_no", "left")
    return out.withColumn("image", F.coalesce("image", F.raise_error(F.concat(F.lit("no image for page "), "page_no")).cast("string"))).withColumn("name", F.concat(F.lit("line-"), "line_id", F.lit(".png")))


def job_outcome(pages: DataFrame) -> DataFrame:
    """Per document: pages, failures other than empty pages, empty pages, and whether the run is good."""
    empty = F.exists("failures", lambda f: f == "EmptyPage")
    real = F.size(F.filter("failures", lambda f: f != "EmptyPage"))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(real).alias("n_failures"), F.count_if(empty).alias("empty_pages"), F.bool_and(F.size("failures") > 0).alias("failed"))
    return out.withColumn("ok", (F.col("n_failures") == 0) & (F.col("empty_pages") < F.col("n_pages")))


def reader_accuracy(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Error rate of the recognized text against each accepted line; an unknown line was read as nothing."""
    accepted = overrides.filter("store = 'accepted'").select("line_id", F.col("text").alias("accepted"))
    both = accepted.join(lines.select("line_id", "text"), "line_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return both.select("line_id", text.character_error_rate(F.col("accepted"), F.col("text")).alias("cer"))


def job_state(raw: Column, states: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, state in states.items():
        out = F.when(raw == name, state).otherwise(out)
    return out


def undone(log: DataFrame, steps: int = 1) -> DataFrame:
    """What the stores hold (store, key, value) after the last writes of a log (session, seq, store, key, value) are taken back, per session.

    A null value removes a key; a write that changes nothing isn't one.
    """
    same = [F.col(c) for c in ("session", "store", "key")]
    before = F.lag("value").over(Window.partitionBy(*same).orderBy("seq"))
    real = log.withColumn("_before", before).filter(~F.col("value").eqNullSafe(F.col("_before")))
    # The last steps + 1 numbers of a session; the first of them is the last that stays.
    last = F.slice(F.reverse(F.array_sort(F.collect_list("seq"))), 1, steps + 1)
    kept = real.groupBy("session").agg(last.alias("_last")).select("session", F.get("_last", F.lit(steps)).alias("_stays"))
    rows = real.join(kept, "session").filter(F.col("seq") <= F.col("_stays"))
    return rows.groupBy(*same).agg(F.max_by("value", "seq").alias("value")).filter("value is not null")


def committed(lines: DataFrame, overrides: DataFrame, reviewer: str, at: str, tenant: str = "default") -> DataFrame:
    """One correction for each reviewed line: what was read, what it is now (accepted overrides before edited ones), its box as JSON, by whom and when."""
    done = final_text(lines, overrides).filter("touched")
    box = F.to_json(F.struct("x", "y", "w", "h"))
    return done.select(
        "line_id", *PAGE, "script", F.col("text").alias("original_text"), F.col("final_text").alias("corrected_text"), box.alias("bbox"), F.lit(1).alias("accepted"),
        F.lit(reviewer).alias("reviewer"), F.lit(at).alias("corrected_at"), F.lit(tenant).alias("tenant"),
    )


def training_records(samples: DataFrame) -> DataFrame:
    """What a trainer reads for each sample (name, text): the image's place, its side text, and the manifest's entry."""
    image = F.concat(F.lit("images/"), "name")
    side = F.regexp_replace(image, r"\.[^./]+$", ".gt.txt")
    return samples.select("name", image.alias("image"), side.alias("side"), F.concat("text", F.lit("\n")).alias("side_text"), F.to_json(F.struct(image.alias("image"), "text")).alias("entry"))


def training_outcome(scripts: DataFrame, samples: DataFrame, candidate: DataFrame, parent: DataFrame, least_samples: int = 10, least_improvement: float = 1.0) -> DataFrame:
    """What a training run comes to: nothing to learn from, refused with the policy's reason, or promoted. One row.

    candidate and parent are reports by script on held-out pages (script, cer,
    samples).  scripts lists those to train for; samples are the eligible ones.
    """
    from quire.operators.evaluate import promotion

    wanted = samples.join(scripts.select("script").distinct(), "script", "left_semi").agg(F.count("*").alias("n_samples"))
    verdict = promotion(candidate, parent, "test", least_samples, least_improvement)
    both = wanted.crossJoin(verdict)  # one row each
    return both.select("n_samples", F.when(F.col("n_samples") == 0, "nothing_to_learn_from").otherwise(F.col("verdict")).alias("outcome"))
