"""The page pipeline: readable pages to lines, suggestions and failures, over recorded layouts and engine output.

Engines and layout analysers don't run here; what they returned is a table, a
row for each block or segment, and a run table says which engine read which page
and variant, and with what error.  A plug-in is a function from DataFrame to
DataFrame with the same columns (see Ports), so a live engine behind
``mapInArrow`` can take a table's place.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import lines as line_ops
from quire.operators import reconcile, suggest

PAGE = ["doc_id", "page_no"]
SEGMENT = [*PAGE, "seg_idx"]
#: What a candidate tells the others of its segment.
READING = ["cand_ord", "model_name", "variant", "text"]
#: Candidates of one variant are numbered within so many engines.
MOST_ENGINES = 100

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Ports:
    """What can be plugged in; each takes and returns the table that it is named after."""

    #: Chooses a line for each segment, and none for no segment, among candidates (SEGMENT, cand_ord, model_name, variant, conf, text, agreement, readings).
    reconcile: Step = lambda candidates: reconcile.script_aware(candidates, SEGMENT)
    #: Readings by all candidates, is_chosen on one, to suggestions (SEGMENT, source_text, suggestion_text, reason, reversible); seg_id may be among them, else it is looked up.
    merge: Step | None = lambda candidates: reconcile.merge_suggestions(candidates, [*SEGMENT, "seg_id"])
    #: Paragraphs, roles and the like, from the document's lines.
    assemble: Step = lambda lines: lines
    #: Writes a table that is used several times and reads it back; left as it is, each use computes it again.
    keep: Step = lambda rows: rows


@dataclass(frozen=True)
class Outcome:
    """lines (PAGE, seg_idx, line_id, text, engine, model_name, conf, agreement, box), suggestions and failures (PAGE, error_type, message)."""

    lines: DataFrame
    find_suggestions: Callable[[], DataFrame]
    failures: DataFrame

    @functools.cached_property
    def suggestions(self) -> DataFrame:
        """Made when they are asked for, as the lexicon is read for them."""
        return self.find_suggestions()

    def clean_pages(self, pages: DataFrame) -> DataFrame:
        """Pages without a failure."""
        return pages.join(self.failures.select(*PAGE).distinct(), PAGE, "left_anti")


def routed(lines: DataFrame, routes: DataFrame, default: list[str]) -> DataFrame:
    """lines with a row for each engine of their script (script, engine_ord, engine), or of the default; routes has a row per script and engine."""
    table = routes.groupBy("script").agg(F.transform(F.array_sort(F.collect_list(F.struct("engine_ord", "engine"))), lambda r: r["engine"]).alias("_engines"))
    # A row per script.
    found = lines.join(F.broadcast(table), "script", "left")
    return found.select(*lines.columns, F.posexplode(F.coalesce("_engines", F.array(*map(F.lit, default)))).alias("engine_ord", "engine"))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: list[str] = PAGE) -> DataFrame:
    """Rows of primary, and those of fallback for keys that primary has none of."""
    return primary.unionByName(fallback.join(primary.select(*key).distinct(), key, "left_anti"))


def text_layer_lines(lines: DataFrame) -> DataFrame:
    """Lines of the embedded text, as they are: no layout, no routing, no vote."""
    return lines.select(
        *PAGE, F.col("line_idx").cast("long").alias("seg_idx"), "line_id", "script", "text", F.lit("pdf_text_layer").alias("engine"), F.lit("embedded").alias("model_name"), F.lit("").alias("model_hash"),
        F.lit(100.0).alias("conf"), F.lit("single").alias("agreement"), "x", "y", "w", "h",
    )


def whole_page(lines: DataFrame, page_no: int = 1) -> DataFrame:
    """Lines without pages as one page per document, for the default tenant."""
    return lines.withColumns({"page_no": F.lit(page_no).cast("long"), "organization_id": F.lit("default"), "user_id": F.lit("system"), "edition": F.lit("desktop")})


def page_failures(pages: DataFrame, lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Failures (PAGE, error_type, message): unreadable pages, pages without lines, and pages on which every engine failed.

    pages has error, null for a readable page.  Of lines only their pages count.
    runs has engine, run_ord and error.
    """
    unreadable = pages.filter("error is not null").select(*PAGE, F.lit("IngestError").alias("error_type"), F.col("error").alias("message"))
    readable = pages.filter("error is null").select(*PAGE)
    empty = readable.join(lines.select(*PAGE).distinct(), PAGE, "left_anti").select(*PAGE, F.lit("EmptyPage").alias("error_type"), F.lit("no text lines were produced for this page").alias("message"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ord", F.concat("engine", F.lit(": "), "error").alias("v")))), lambda r: r["v"]), "; ")
    dead = runs.groupBy(*PAGE).agg(F.bool_and(F.col("error").isNotNull()).alias("_all"), said.alias("_said")).filter("_all").join(readable, PAGE, "left_semi")
    dead = dead.select(*PAGE, F.lit("EngineError").alias("error_type"), F.concat(F.lit("every engine failed on this page: "), "_said").alias("message"))
    return unreadable.unionByName(empty).unionByName(dead)


def candidates_of(segments: DataFrame, blocks: DataFrame, runs: DataFrame, routes: DataFrame, default: list[str], adapter: line_ops.Adapter | None = None) -> DataFrame:
    """Each segment's candidate lines in order, variants before engines; a segment that nobody read is its own.

    Each knows its segment's agreement (see lines.agreement) and all readings.
    With an adapter, blocks are recorded pages (see lines.read_pages), and the
    texts of candidates are shuffled once, by segment.
    """
    box = ["x", "y", "w", "h"]
    composed = line_ops.compose_lines(line_ops.assign_blocks(segments, blocks)) if adapter is None else line_ops.read_pages(blocks, adapter)
    wanted = routed(composed.withColumnRenamed("engine", "_read_by"), routes, default).filter("_read_by = engine")
    read = wanted.select(*SEGMENT, F.struct("engine", "model_name", "variant", "conf", *box, "text", "engine_ord").alias("_r"))
    ran = runs.filter("error is null").groupBy(*PAGE).agg(F.collect_list(F.struct("engine", "variant", "variant_ord")).alias("ran"))
    layout = F.struct("seg_id", "script", "region_type", "reading_order", *box, "ran").alias("_s")
    both = segments.join(ran, PAGE, "left").select(*SEGMENT, layout, F.lit(None).cast(read.schema["_r"].dataType).alias("_r"))
    both = both.unionByName(read.withColumn("_s", F.lit(None).cast(both.schema["_s"].dataType)))
    # A row for each segment, gathered once however many columns and uses there are later on.
    each = both.groupBy(*SEGMENT).agg(F.first("_s", ignorenulls=True).alias("_s"), F.collect_list("_r").alias("_r")).filter("_s is not null")

    def line(r, order, name):
        own = [F.col(f"_s.{c}").alias(c) for c in ("seg_id", "script", "region_type", "reading_order")]
        return F.struct(*own, *(r[c].alias(c) for c in ("engine", "model_name", "variant", "conf", *box, "text")), name.alias("cand_id"), order.alias("cand_ord"))

    def named(r):
        return F.concat(F.col("_s.seg_id"), F.lit("-"), r["engine"], F.when(r["variant"] != "", F.concat(F.lit("-"), r["variant"])).otherwise(""))

    heard = lambda run: F.filter("_r", lambda r: (r["engine"] == run["engine"]) & (r["variant"] == run["variant"]))
    found = F.flatten(F.transform("_s.ran", lambda run: F.transform(heard(run), lambda r: line(r, run["variant_ord"] * MOST_ENGINES + r["engine_ord"], named(r)))))
    silent = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("engine", "model_name")), F.lit("").alias("variant"), F.lit(0.0).alias("conf"), *(F.col(f"_s.{c}").alias(c) for c in box), F.lit("").alias("text"))
    nobody = F.array(line(silent, F.lit(0), F.col("_s.seg_id")))
    all_of = each.select(*SEGMENT, F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(nobody).alias("_a"))
    readings = F.transform("_a", lambda c: F.struct(*(c[k].alias(k) for k in READING))).alias("readings")
    return all_of.select(*SEGMENT, line_ops.tier(F.transform("_a", lambda c: c["text"])).alias("agreement"), readings, F.explode("_a").alias("_c")).select(*SEGMENT, "_c.*", "agreement", "readings")


def process_pages(
    pages: DataFrame, embedded: DataFrame, segments: DataFrame, blocks: DataFrame, runs: DataFrame, routes: DataFrame, default: list[str], lexicon: DataFrame, ports: Ports = Ports(),
    adapter: line_ops.Adapter | None = None,
) -> Outcome:
    """The whole pipeline for any number of pages at once; nothing that happens on one page touches another.

    pages (PAGE, error), embedded (PAGE, line_idx, line_id, script, text, box) for
    pages whose own text is trusted, segments (SEGMENT, seg_id, script,
    region_type, reading_order, box), blocks (PAGE, engine, model_name, variant,
    block_idx, text, conf, box), runs (PAGE, engine, variant, variant_ord,
    run_ord, error), routes (script, engine_ord, engine).  Unreadable pages and
    pages with text of their own take no part in recognition.  With an adapter,
    blocks are recorded pages instead (see lines.read_pages).
    """
    # Inner joins with distinct pages: a semi join would sink below whatever takes a page's text apart, and shuffle that text.
    readable = pages.filter("error is null").select(*PAGE).distinct()
    own = text_layer_lines(embedded.join(readable, PAGE))
    scans = readable.join(own.select(*PAGE).distinct(), PAGE, "left_anti")
    seen = segments.join(scans, PAGE).withColumn("seg_id", F.concat(F.lit("p"), "page_no", F.lit("-"), "seg_id"))
    asked = runs.join(seen.select(*PAGE).distinct(), PAGE, "left_semi")
    candidates = ports.keep(candidates_of(seen, blocks, asked, routes, default, adapter))
    best = ports.keep(ports.reconcile(reconcile.primary_only(candidates, SEGMENT)))
    chosen = best.withColumn("model_hash", F.lit(""))
    shown = [*PAGE, "seg_idx", "line_id", "script", "text", "engine", "model_name", "model_hash", "conf", "agreement", "x", "y", "w", "h"]
    lines = ports.assemble(chosen.withColumnRenamed("seg_id", "line_id").select(shown).unionByName(own.select(shown)))

    def suggestions() -> DataFrame:
        flags = suggest.line_flags(lines, lexicon).select("line_id", "source_text", "suggestion_text", "reason", "reversible", "start", "end")
        if ports.merge is None:
            return flags
        read = best.select(*SEGMENT, "seg_id", F.col("cand_ord").alias("_best"), F.explode("readings").alias("_c"))
        merged = ports.merge(read.select(*SEGMENT, "seg_id", "_c.*", (F.col("_c.cand_ord") == F.col("_best")).alias("is_chosen")))
        merged = merged if "seg_id" in merged.columns else merged.join(seen.select(*SEGMENT, "seg_id"), SEGMENT)
        none = F.lit(None).cast("int")
        return flags.unionByName(merged.select(F.col("seg_id").alias("line_id"), "source_text", "suggestion_text", "reason", "reversible", none.alias("start"), none.alias("end")))

    # A segment always becomes a line, whatever is read there, and what assembling leaves out is no failure: the layout alone says which pages are empty.
    return Outcome(lines, suggestions, page_failures(pages, seen.select(*PAGE).unionByName(own.select(*PAGE)), asked))


def exit_code(problems: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row, a run's exit code: 3 if anything is missing to run at all, 1 if a job isn't good (see review.job_outcome), else 0."""
    missing = problems.agg((F.count("*") > 0).alias("missing"))
    bad = jobs.agg(F.coalesce(F.bool_or(~F.col("ok")), F.lit(False)).alias("bad"))
    return missing.crossJoin(bad).select(F.when(F.col("missing"), 3).when(F.col("bad"), 1).otherwise(0).alias("exit_code"))


#: Language packs that recognition needs, and what is said of each blocker.
NEEDED_PACKS = ("ell", "grc")


def environment_problems(reports: DataFrame) -> DataFrame:
    """Reports (host, tesseract, languages, kraken, models, torch, torch_coherent, pdf) with problems, the blockers in a fixed order."""
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, NEEDED_PACKS)), F.coalesce("languages", F.array().cast("array<string>"))))
    found = [
        F.when(~F.col("tesseract"), F.lit("tesseract is not installed")).when(F.size(missing) > 0, F.concat(F.lit("language packs missing: "), F.array_join(missing, ", "))),
        F.when(~F.col("kraken"), F.lit("kraken is not installed")).when(F.col("models") == 0, F.lit("no recognition model found")),
        F.when(F.col("torch") & ~F.coalesce("torch_coherent", F.lit(True)), F.lit("torch and torchvision don't fit together")),
        F.when(~F.col("pdf"), F.lit("PDF input is not available")),
    ]
    return reports.select("host", F.array_compact(F.array(*found)).alias("problems"))


def device(reports: DataFrame) -> DataFrame:
    """Reports (host, preferred, cuda, mps) with the device to use: the preferred one, an accelerator, or the CPU; a failed probe is null."""
    probed = F.when(F.coalesce("cuda", F.lit(False)), "cuda:0").when(F.coalesce("mps", F.lit(False)), "mps").otherwise("cpu")
    return reports.select("host", F.coalesce("preferred", probed).alias("device"))


def chosen_model(scripts: DataFrame, promotions: DataFrame, manifest: DataFrame, files: DataFrame, explicit: str | None = None) -> DataFrame:
    """scripts with a model each: the explicit one, the newest promoted one, the manifest's default if its file is there, else the first file.

    promotions (script, pos, engine, model), manifest (name, engine, is_default),
    files (name); the last two are the few models of a machine.  Without any file
    the model is null, which is an error for the caller.
    """
    newest = promotions.groupBy("script").agg(F.max(F.struct("pos", "engine", "model")).alias("_new")).select("script", F.when(F.col("_new.engine") == "kraken", F.col("_new.model")).alias("_promoted"))
    default = manifest.filter("is_default and engine = 'kraken'").select("name").distinct().join(files, "name", "left_semi").agg(F.min("name").alias("_default"))
    first = files.agg(F.min("name").alias("_first"))
    some = default.crossJoin(first)  # one row each
    out = scripts.join(newest, "script", "left").crossJoin(F.broadcast(some))
    return out.withColumn("model", F.coalesce(F.lit(explicit).cast("string"), "_promoted", "_default", "_first")).drop("_promoted", "_default", "_first")


def next_free(taken: DataFrame) -> DataFrame:
    """For each prefix of taken ids (prefix, n) the least number from 1 that isn't taken, as ``prefix-n``."""
    n = taken.filter("n >= 1").select("prefix", "n").distinct()
    # A number that is taken ends the gap-free start as long as it equals its rank; ranks are found by counting in ranges of numbers.
    width = 1024
    ranges = n.withColumn("_r", F.floor(F.col("n") / width)).groupBy("prefix", "_r").agg(F.count("*").alias("_c"), F.collect_set("n").alias("_n"))
    full = F.when(F.col("_r") == 0, width - 1).otherwise(width)
    at = F.row_number().over(Window.partitionBy("prefix").orderBy("_r")) - 1
    holes = ranges.withColumn("_at", at).filter((F.col("_at") != F.col("_r")) | (F.col("_c") < full))
    first = holes.groupBy("prefix").agg(F.min(F.struct("_at", "_r", "_n")).alias("_h"))
    low = F.greatest(F.lit(1).cast("long"), F.col("_h._at") * width)
    inside = F.array_min(F.array_except(F.sequence(low, (F.col("_h._at") + 1) * width - 1), F.when(F.col("_h._at") == F.col("_h._r"), F.col("_h._n")).otherwise(F.array().cast("array<bigint>"))))
    last = ranges.groupBy("prefix").agg(F.max("_r").alias("_last"))
    all_prefixes = taken.select("prefix").distinct().join(last, "prefix", "left").join(first.select("prefix", inside.alias("_free")), "prefix", "left")
    free = F.coalesce("_free", (F.col("_last") + 1) * width, F.lit(1))
    return all_prefixes.select("prefix", F.concat("prefix", F.lit("-"), free).alias("next_id"))


#: What an interface answers.
UNAUTHORIZED, BAD_REQUEST, NOT_FOUND, TOO_LARGE, UNAVAILABLE, ACCEPTED, FINE = 401, 400, 404, 413, 503, 202, 200


def response_status(requests: DataFrame, most_bytes: int) -> DataFrame:
    """The status of each request (route submit, status or result; tenant, valid_upload, n_bytes, queue_up, job_id, state, has_result).

    tenant is null for an unknown key.  Jobs are looked up by the tenant's own
    id, so a stranger's job isn't found.
    """
    submit = F.when(~F.col("valid_upload"), BAD_REQUEST).when(F.col("n_bytes") > most_bytes, TOO_LARGE).when(~F.col("queue_up"), UNAVAILABLE).otherwise(ACCEPTED)
    known = F.when(~F.col("job_id").rlike("^[0-9a-f]{32}$"), NOT_FOUND).when(~F.col("queue_up"), UNAVAILABLE).when(F.col("state") == "not_found", NOT_FOUND)
    result = F.coalesce(known, F.when(F.col("state") != "done", BAD_REQUEST).when(~F.col("has_result"), NOT_FOUND), F.lit(FINE))
    answer = F.when(F.col("tenant").isNull(), UNAUTHORIZED).when(F.col("route") == "submit", submit).when(F.col("route") == "status", F.coalesce(known, F.lit(FINE))).otherwise(result)
    return requests.withColumn("status", answer)
