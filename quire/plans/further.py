"""Queries of page scans, the page pipeline, image operators, file sinks, streams and runs, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import boxes, digests, images, results, text
from quire.operators import pages, resilience, review, suggest, training
from quire.plans import testbed as t
from quire.plans.reference import PAGE, query
from quire.sources import docx, parsers, pdf, png, scans, settings, sinks
from quire.streaming import events


def scratch(spark: SparkSession) -> str:
    """A new folder for what a query writes and reads back, in the session's shared folder; on one machine, where that may be unset, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp()).rstrip('/')}/query-{uuid.uuid4().hex}"


# Scans of files that are made from the documents' numbers


def _pixels(doc: int) -> np.ndarray:
    """A gray image, 16 wide and 1 to 7 high."""
    y, x = np.mgrid[0 : 1 + doc % 7, 0:16]
    return ((31 * doc + 7 * x + 13 * y * y) % 256).astype(np.uint8)


def _colours(doc: int) -> np.ndarray:
    base = _pixels(doc).astype(int)
    return np.stack([base, (base * 3 + doc) % 256, (base + 100) % 256], 2).astype(np.uint8)


#: The images' pixels as rows.
_PIXELS = "px AS (SELECT doc_id, x, y, (31 * doc_id + 7 * x + 13 * y * y) % 256 AS v FROM (SELECT doc_id, unnest(range(16)) AS x, y FROM (SELECT doc_id, unnest(range(1 + doc_id % 7)) AS y FROM documents)))"


def _tiff(frames: list[np.ndarray]) -> bytes:
    out, heads = bytearray(b"II*\0\0\0\0\0"), []
    for f in frames:
        at = len(out)
        out += f.tobytes()
        heads.append((len(out), [(256, f.shape[1]), (257, f.shape[0]), (258, 8), (259, 1), (262, 1), (273, at), (277, 1), (279, f.size)]))
        out += len(heads[-1][1]).to_bytes(2, "little") + b"".join(tag.to_bytes(2, "little") + b"\4\0\1\0\0\0" + value.to_bytes(4, "little") for tag, value in heads[-1][1]) + bytes(4)
    places = [h[0] for h in heads]
    out[4:8] = places[0].to_bytes(4, "little")
    for place, (_, tags), follows in zip(places, heads, [*places[1:], 0]):
        end = place + 2 + 12 * len(tags)
        out[end : end + 4] = follows.to_bytes(4, "little")
    return bytes(out)


def _file(doc: int) -> bytes:
    """By number: a PDF of an image page and one without, a PNG, a TIFF of three frames, and bytes that are none of them."""
    if doc % 4 == 0:
        return pdf.write([{"width": 16, "height": 1 + doc % 7, "image": png.encode(_pixels(doc))}, {"width": 9, "height": 9}])
    return [png.encode(_colours(doc)), _tiff([_pixels(doc + k) for k in range(3)]), b"no image"][doc % 4 - 1]


def _made(spark: SparkSession, d: str, make) -> DataFrame:
    """Documents (doc_id) with make(doc_id) as content."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "path": [f"{i}.bin" for i in b["doc_id"]], "content": [make(int(i)) for i in b["doc_id"]]})

    return t.documents(spark, d).select("doc_id").mapInPandas(run, "doc_id long, path string, content binary")


def _scanned(spark, d):
    found = scans.pages(_made(spark, d, _file))
    return found.withColumn("doc_id", F.split_part("path", F.lit("."), F.lit(1)).cast("long")).withColumn("failed", F.col("error").isNotNull())


_SCANNED = """sc AS (
  SELECT doc_id, unnest(range(1, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 2 THEN 4 ELSE 2 END)) AS page_no, CASE doc_id % 4 WHEN 0 THEN 'pdf' ELSE 'image' END AS kind FROM documents),
sp AS (SELECT *, (doc_id % 4 = 0 AND page_no = 2) OR doc_id % 4 = 3 AS failed, CASE WHEN doc_id % 4 = 2 THEN 1 + (doc_id + page_no - 1) % 7 ELSE 1 + doc_id % 7 END AS h FROM sc)"""
_SIZES = "CASE WHEN failed THEN 1 ELSE 16 END::BIGINT AS width, CASE WHEN failed THEN 1 ELSE h END::BIGINT AS height, failed"


@query("src_01_scan_pages", f"SELECT doc_id, page_no, kind, {_SIZES} FROM sp", _SCANNED)
def _(spark, d):
    return _scanned(spark, d).select("doc_id", "page_no", "kind", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "failed")


@query("src_02_pdf_pages", f"SELECT doc_id, page_no, {_SIZES} FROM sp WHERE kind = 'pdf'", _SCANNED)
def _(spark, d):
    return _scanned(spark, d).filter("kind = 'pdf'").select("doc_id", "page_no", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "failed")


@query("src_03_image_frames", "SELECT sp.doc_id, page_no, sum(v)::BIGINT AS total FROM sp JOIN (SELECT doc_id AS id, v FROM px) ON id = sp.doc_id + page_no - 1 WHERE sp.doc_id % 4 = 2 AND sp.doc_id + 2 <= (SELECT max(doc_id) FROM documents) GROUP BY ALL", _SCANNED, _PIXELS)
def _(spark, d):
    most = t.documents(spark, d).agg(F.max("doc_id").alias("most"))
    some = _scanned(spark, d).crossJoin(F.broadcast(most)).filter("doc_id % 4 = 2 and doc_id + 2 <= most")
    known = t.documents(spark, d).select(F.col("doc_id").alias("id"))
    return some.join(known, F.col("id") == F.col("doc_id") + F.col("page_no") - 1).select("doc_id", "page_no", _total(F.col("content")).alias("total"))


@query("src_05_memory_page", "SELECT doc_id, 1::BIGINT AS page_no, 1::BIGINT AS width, octet_length(encode(text)) AS n_bytes FROM documents")
def _(spark, d):
    payloads = t.documents(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return scans.one_page(payloads).select(F.col("path").cast("long").alias("doc_id"), "page_no", F.col("width").cast("long").alias("width"), F.octet_length("content").cast("long").alias("n_bytes"))


@query("src_06_count_pages", "SELECT doc_id, greatest(1, count(*)) AS pages FROM sc GROUP BY doc_id", _SCANNED)
def _(spark, d):
    return scans.count_pages(_scanned(spark, d), "doc_id")


@query("src_09_word_list", r"SELECT count(DISTINCT w) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM benchmark) WHERE w <> ''")
def _(spark, d):
    folder = scratch(spark)
    # Lines end as on another system, which the scan allows for.
    t.table(spark, d, "benchmark").select(F.explode(F.split("text", r"[ \n]+")).alias("w")).filter("w != ''").distinct().select(F.concat("w", F.lit("\r")).alias("value")).write.text(folder)
    return parsers.lexicon_file(spark, folder, "la", 0).agg(F.count("*").alias("n"))


@query("src_10_title_words", "SELECT word, count(*) AS n FROM (SELECT unnest(['Title', replace(source, ' ', '_'), lang || '_two']) AS word FROM documents) WHERE word <> 'Title' AND NOT contains(word, '_') GROUP BY word")
def _(spark, d):
    both = t.documents(spark, d).select(F.posexplode(F.array(F.lit("Title"), F.replace("source", F.lit(" "), F.lit("_")), F.concat("lang", F.lit("_two")))).alias("idx", "value"))
    return parsers.title_words(both).groupBy(F.col("form").alias("word")).agg(F.count("*").alias("n"))


@query("src_10_listed_words", "SELECT line_id, 'k' || line_idx AS form FROM ln", t.LINES)
def _(spark, d):
    rows = t.lines(spark, d).select("line_id", F.concat(F.lit("    'k"), "line_idx", F.lit("': u\"x\",")).alias("value"))
    return parsers.quoted_keys(rows).select("line_id", "form")


@query("src_13_fixture_tiers", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'scan' WHEN doc_id % 3 = 1 THEN 'synthetic' ELSE 'unknown' END AS tier, count(*) AS n, sum(length(nfc_normalize(text)))::BIGINT AS n_chars FROM documents GROUP BY 1")
def _(spark, d):
    docs = t.documents(spark, d)
    said = docs.select(F.col("doc_id").alias("fixture_id"), F.when(F.col("doc_id") % 3 == 0, "scan").when(F.col("doc_id") % 3 == 1, "synthetic").otherwise("other").alias("tier"))
    found = scans.fixture_tiers(docs.select(F.col("doc_id").alias("fixture_id"), "text"), said.filter("fixture_id % 6 != 5"))
    return found.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("src_14_page_images", "SELECT doc_id // 2 AS page_no, octet_length(encode(lang || min(doc_id)))  AS n_bytes FROM documents WHERE doc_id % 5 <> 0 GROUP BY doc_id // 2, lang QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY min(doc_id)) = 1")
def _(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, F.concat(F.lit("notes-"), i, F.lit(".txt"))).otherwise(F.concat(F.floor(i / 2), F.when(i % 2 == 0, ".JPG").otherwise(".png")))
    files = t.documents(spark, d).select(F.concat(F.lit("/pages/"), name).alias("path"), F.concat("lang", i).cast("binary").alias("content"))
    return scans.numbered_images(files).select("page_no", F.octet_length("content").cast("long").alias("n_bytes"))


# Images


@F.pandas_udf(T.LongType())
def _total(contents: pd.Series) -> pd.Series:
    """The sum of an image's gray pixels."""
    return contents.map(lambda c: None if c is None else int(images.read_gray(c).sum(dtype=np.int64)))


def _processed(spark, d, make, *names):
    done = _made(spark, d, make).select("doc_id", images.chain(*names)(F.col("content")).alias("r"))
    return done.select("doc_id", _total(F.col("r.content")).alias("total"), F.col("r.error").isNotNull().alias("failed"))


_LUMA = "(19595 * v + 38470 * ((v * 3 + doc_id) % 256) + 7471 * ((v + 100) % 256) + 32768) >> 16"


@query("img_01_grayscale", f"SELECT doc_id, sum({_LUMA})::BIGINT AS total, false AS failed FROM px GROUP BY doc_id", _PIXELS)
def _(spark, d):
    return _processed(spark, d, lambda i: png.encode(_colours(i)), "grayscale")


@query("img_02_adaptive")
def _(spark, d):
    return _processed(spark, d, lambda i: png.encode(_pixels(i)), "adaptive_gaussian")


@query("img_03_otsu")
def _(spark, d):
    return _processed(spark, d, lambda i: png.encode(_pixels(i)), "otsu")


@query("img_04_deskew")
def _(spark, d):
    return _processed(spark, d, lambda i: png.encode(_pixels(i)), "deskew")


@query("img_05_despeckle")
def _(spark, d):
    return _processed(spark, d, lambda i: png.encode(_pixels(i)), "despeckle")


@query("img_06_crop_pixels", "SELECT doc_id, sum(v)::BIGINT AS total FROM px WHERE x >= 2 AND x < 11 AND y < 3 GROUP BY doc_id", _PIXELS)
def _(spark, d):
    made = _made(spark, d, lambda i: png.encode(_pixels(i)))
    box = boxes.padded_crop(F.lit(4), F.lit(0), F.lit(5), F.lit(1), F.lit(16).cast("long"), (1 + F.col("doc_id") % 7).cast("long"))
    placed = made.select("doc_id", "content", *box)
    out = placed.select("doc_id", images.cropped(F.col("content"), F.col("left"), F.col("top"), F.col("right"), F.col("bottom")).alias("r"))
    return out.select("doc_id", _total(F.col("r.content")).alias("total"))


@query("img_07_shrink", "SELECT doc_id, sum(m)::BIGINT AS total FROM (SELECT doc_id, floor(avg(v) + 0.5) AS m FROM px WHERE doc_id % 7 IN (1, 3, 5) GROUP BY doc_id, x // 2, y // 2) GROUP BY doc_id", _PIXELS)
def _(spark, d):
    made = _made(spark, d, lambda i: png.encode(_pixels(i))).filter("doc_id % 7 in (1, 3, 5)")
    return made.select("doc_id", _total(images.downscaled(F.col("content"), 8)["content"]).alias("total"))


@query("img_08_bilevel", "SELECT doc_id, sum(CASE WHEN v > 128 THEN 255 ELSE 0 END)::BIGINT AS total, false AS failed FROM px GROUP BY doc_id", _PIXELS)
def _(spark, d):
    return _processed(spark, d, lambda i: png.encode(_pixels(i)), "bilevel")


@query("udf_03_chain", "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN count(*) * 255 - sum(CASE WHEN v > 128 THEN 0 ELSE 255 END) END::BIGINT AS total, doc_id % 4 = 3 AS failed FROM px GROUP BY doc_id", _PIXELS)
def _(spark, d):
    # The second processor leaves a bilevel image as it is; what is no image is an error that stops the chain.
    return _processed(spark, d, lambda i: b"no image" if i % 4 == 3 else png.encode(_pixels(i)), "bilevel", "grayscale", "bilevel")


# The page pipeline


def _recorded(spark, d):
    """Pages of all kinds by number: every 11th can't be read, every 7th has text of its own, every 13th no layout, and on every 17th all engines fail."""
    docs, segments = t.documents(spark, d), t.segments(spark, d)
    i = F.col("doc_id")
    found = docs.select("doc_id", i.alias("page_no"), F.when(i % 11 == 0, "broken").alias("error"))
    embedded = t.lines(spark, d).filter("doc_id % 7 = 0")
    layout = segments.filter("doc_id % 13 != 0").withColumn("seg_id", F.concat(F.lit("line-"), "seg_idx"))
    every = t.recorded_pages(spark, d).unionByName(t.recorded_pages(spark, d, "kraken", ("eio", "oei")))
    run = lambda engine, order, bad: docs.select("doc_id", i.alias("page_no"), F.lit(engine).alias("engine"), F.lit("").alias("variant"), F.lit(0).alias("variant_ord"), F.lit(order).alias("run_ord"), F.when(bad, f"{engine} is down").alias("error"))
    runs = run("tess", 0, i % 17 == 0).unionByName(run("kraken", 1, i % 17 == 0)).unionByName(run("idle", 2, F.lit(True)))
    routes = spark.createDataFrame([("en", 0, "kraken"), ("en", 1, "tess"), ("de", 0, "tess")], "script string, engine_ord int, engine string")
    return found, embedded, layout, every, runs, routes, ["tess", "idle"], t.lexicon(spark, d)


_RECORDED = """
pg AS (SELECT doc_id, doc_id % 11 = 0 AS broken, doc_id % 7 = 0 AND doc_id % 11 <> 0 AS own FROM documents),
eb AS (
  SELECT doc_id, block_idx, engine, text, conf, x, y, w, h FROM (SELECT * FROM bl UNION ALL SELECT * REPLACE ('kraken' AS engine, translate(text, 'eio', 'oei') AS text, (conf * 7 + doc_id) % 101 AS conf) FROM bl)
  WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0),
ea AS (
  SELECT b.*, s.seg_idx, s.script, (least(b.x + b.w, s.x + s.w) - greatest(b.x, s.x)) * (least(b.y + b.h, s.y + s.h) - greatest(b.y, s.y)) AS area
  FROM eb b JOIN sg s ON b.doc_id = s.doc_id AND b.x < s.x + s.w AND s.x < b.x + b.w AND b.y < s.y + s.h AND s.y < b.y + b.h
  QUALIFY row_number() OVER (PARTITION BY b.doc_id, engine, block_idx ORDER BY area DESC, seg_idx) = 1),
ec AS (
  SELECT doc_id, seg_idx, script, engine, coalesce(string_agg(text, ' ' ORDER BY block_idx) FILTER (WHERE text <> ''), '') AS text, avg(conf) AS conf FROM ea
  WHERE engine = 'tess' OR script = 'en' GROUP BY ALL),
eo AS (SELECT *, CASE WHEN engine = 'kraken' THEN 0 ELSE 1 END AS ord FROM ec),
ch AS (SELECT * FROM eo QUALIFY row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY conf DESC, ord) = 1),
tr AS (SELECT doc_id, seg_idx, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) = 1 THEN 'unanimous' ELSE 'split' END AS agreement FROM eo GROUP BY ALL),
pl AS (
  SELECT ch.doc_id, ch.seg_idx, 'p' || ch.doc_id || '-line-' || ch.seg_idx AS line_id, text, engine, agreement FROM ch JOIN tr USING (doc_id, seg_idx)
  UNION ALL SELECT s.doc_id, s.seg_idx, 'p' || s.doc_id || '-line-' || s.seg_idx, '', NULL, 'single' FROM sg s ANTI JOIN ch ON ch.doc_id = s.doc_id AND ch.seg_idx = s.seg_idx
  WHERE s.doc_id % 11 <> 0 AND s.doc_id % 7 <> 0 AND s.doc_id % 13 <> 0
  UNION ALL SELECT doc_id, line_idx, line_id, text, 'pdf_text_layer', 'single' FROM ln WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0)"""
_PIPE = (t.BLOCKS, t.SEGMENTS, _RECORDED)


def _outcome(spark, d, **ports):
    return pages.process_pages(*_recorded(spark, d), pages.Ports(**ports), t.in_parts)


@query("pipe_01_page_lines", "SELECT doc_id, seg_idx, line_id, text, engine, agreement FROM pl", *_PIPE)
def _(spark, d):
    return _outcome(spark, d).lines.select("doc_id", "seg_idx", "line_id", "text", "engine", "agreement")


@query(
    "pipe_01_page_failures",
    """SELECT doc_id, 'IngestError' AS error_type, 'broken' AS message FROM pg WHERE broken
    UNION ALL SELECT doc_id, 'EmptyPage', 'no text lines were produced for this page' FROM pg WHERE NOT broken AND NOT own AND doc_id % 13 = 0
    UNION ALL SELECT doc_id, 'EngineError', 'every engine failed on this page: tess: tess is down; kraken: kraken is down; idle: idle is down' FROM pg WHERE NOT broken AND NOT own AND doc_id % 13 <> 0 AND doc_id % 17 = 0""",
    *_PIPE,
)
def _(spark, d):
    return _outcome(spark, d).failures.select("doc_id", "error_type", "message")


@query("pipe_01_clean_pages", "SELECT count(*) AS n FROM pg WHERE NOT broken AND (own OR (doc_id % 13 <> 0 AND doc_id % 17 <> 0))", *_PIPE)
def _(spark, d):
    found = _recorded(spark, d)
    return pages.process_pages(*found, adapter=t.in_parts).clean_pages(found[0]).agg(F.count("*").alias("n"))


@query("pipe_01_suggestions")
def _(spark, d):
    return _outcome(spark, d).suggestions.select("line_id", "source_text", "suggestion_text", "reason", "start", "end")


@query("udf_01_recorded_blocks", "SELECT doc_id, engine, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM eo GROUP BY ALL", *_PIPE)
def _(spark, d):
    found, embedded, layout, blocks, runs, routes, default, _lexicon = _recorded(spark, d)
    seen = layout.filter("doc_id % 11 != 0 and doc_id % 7 != 0")
    c = pages.candidates_of(seen, blocks, runs, routes, default, t.in_parts).filter("engine is not null")
    return c.groupBy("doc_id", "engine").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("udf_02_layout", "SELECT doc_id, seg_idx, CASE WHEN doc_id % 4 = 0 THEN 'fallback' ELSE 'primary' END AS which FROM sg", t.LINES, t.SEGMENTS)
def _(spark, d):
    seg = t.segments(spark, d)
    named = lambda which: seg.withColumn("which", F.lit(which))
    return pages.with_fallback(named("primary").filter("doc_id % 4 != 0"), named("fallback")).select("doc_id", "seg_idx", "which")


@query("set_04_fallback_layout", "SELECT line_id, CASE WHEN doc_id % 4 = 0 THEN 'fallback' ELSE 'primary' END AS which FROM ln", t.LINES)
def _(spark, d):
    base = t.lines(spark, d)
    return pages.with_fallback(base.filter("doc_id % 4 != 0").withColumn("which", F.lit("primary")), base.withColumn("which", F.lit("fallback"))).select("line_id", "which")


@query("udf_04_plug_in_choice", "SELECT doc_id, seg_idx, engine FROM eo QUALIFY row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY length(text) DESC, ord) = 1", *_PIPE)
def _(spark, d):
    from quire.operators.reconcile import first_by

    longest = lambda c: first_by(c, pages.SEGMENT, [F.desc(F.length("text")), F.col("cand_ord")])
    return _outcome(spark, d, reconcile=longest, merge=None).lines.filter("engine is not null and engine != 'pdf_text_layer'").select("doc_id", "seg_idx", "engine")


@query("udf_05_assemble", "SELECT doc_id, count(*) AS n FROM pl WHERE text <> '' GROUP BY doc_id", *_PIPE)
def _(spark, d):
    return _outcome(spark, d, assemble=lambda lines: lines.filter("text != ''"), merge=None).lines.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("prj_04_text_layer_pages", "SELECT doc_id, line_id, text, 'pdf_text_layer' AS engine, 'embedded' AS model_name, '' AS model_hash FROM ln WHERE doc_id % 7 = 0", t.LINES)
def _(spark, d):
    return pages.text_layer_lines(t.lines(spark, d).filter("doc_id % 7 = 0")).select("doc_id", "line_id", "text", "engine", "model_name", "model_hash")


@query("prj_05_whole_page", "SELECT doc_id, 1::BIGINT AS page_no, 'default' AS organization_id, 'system' AS user_id, 'desktop' AS edition, count(*) AS n FROM ln GROUP BY doc_id", t.LINES)
def _(spark, d):
    return pages.whole_page(t.lines(spark, d).drop("page_no")).groupBy("doc_id", "page_no", "organization_id", "user_id", "edition").agg(F.count("*").alias("n"))


@query("join_04_route_scripts", "SELECT line_id, unnest(CASE script WHEN 'en' THEN ['kraken', 'tess'] WHEN 'de' THEN ['kraken'] ELSE ['tess'] END) AS engine, unnest(CASE script WHEN 'en' THEN [0, 1] ELSE [0] END)::BIGINT AS ord FROM ln", t.LINES)
def _(spark, d):
    routes = spark.createDataFrame([("en", 0, "kraken"), ("en", 1, "tess"), ("de", 0, "kraken")], "script string, engine_ord int, engine string")
    return pages.routed(t.lines(spark, d), routes, ["tess"]).select("line_id", "engine", F.col("engine_ord").cast("long").alias("ord"))


@query("agg_14_page_outcome", """SELECT doc_id, 'IngestError' AS error_type, 'torn' AS message FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, 'EmptyPage', 'no text lines were produced for this page' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'EngineError', 'every engine failed on this page: a: ' || source || '; b: ' || lang FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 4 = 0""")
def _(spark, d):
    docs, i = t.documents(spark, d).withColumn("page_no", F.col("doc_id")), F.col("doc_id")
    runs = docs.select(*PAGE, F.lit("a").alias("engine"), F.lit(0).alias("run_ord"), F.when(i % 4 == 0, F.col("source")).alias("error"))
    runs = runs.unionByName(docs.select(*PAGE, F.lit("b").alias("engine"), F.lit(1).alias("run_ord"), F.when(i % 2 == 0, F.col("lang")).alias("error")))
    out = pages.page_failures(docs.select(*PAGE, F.when(i % 5 == 0, "torn").alias("error")), docs.filter("doc_id % 3 != 0"), runs)
    return out.select("doc_id", "error_type", "message")


# Files of whole documents, stores and registries


@query("snk_05_searchable_pdf", "SELECT doc_id, 1 + (doc_id % 5 = 0)::BIGINT AS n_pages, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY line_idx)) AS digest FROM ln GROUP BY doc_id", t.LINES)
def _(spark, d):
    base = t.lines(spark, d)
    shown = _made(spark, d, lambda i: png.encode(_pixels(i))).select("doc_id", F.col("doc_id").alias("page_no"), F.lit(16).alias("width"), (1 + F.col("doc_id") % 7).cast("int").alias("height"), "content")
    failed = shown.filter("doc_id % 5 = 0").select("doc_id", (F.col("page_no") + 1).alias("page_no"), "width", "height", F.lit(None).cast("binary").alias("content"))
    out = sinks.searchable_pdf(shown.unionByName(failed), base, failed.select(*PAGE, F.lit("torn").alias("message")))

    @F.pandas_udf("n_pages long, n_lines long, digest string")
    def read(contents: pd.Series) -> pd.DataFrame:
        import hashlib

        files = [pdf.File(c) for c in contents]
        texts = [f.hidden_text(f.pages[0]) for f in files]
        return pd.DataFrame({"n_pages": [len(f.pages) for f in files], "n_lines": [len(x) for x in texts], "digest": [hashlib.sha256("\n".join(x).encode()).hexdigest() for x in texts]})

    return out.select("doc_id", read("content").alias("r")).select("doc_id", "r.*")


@query("snk_06_docx", "SELECT doc_id, (doc_id % 5 = 0)::BIGINT AS n_breaks, count(*) + (doc_id % 5 = 0)::BIGINT AS n_paragraphs, count(*) FILTER (WHERE line_idx = 0) AS n_headings, sum(length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')))::BIGINT + (doc_id % 5 = 0)::BIGINT * length('[Page ' || (doc_id + 1) || ' could not be read: torn]') AS n_chars FROM ln GROUP BY doc_id", t.LINES)
def _(spark, d):
    base = t.lines(spark, d).select(*PAGE, F.col("line_idx").alias("para_idx"), "text", F.when(F.col("line_idx") == 0, "heading").otherwise("paragraph").alias("role"))
    failed = t.documents(spark, d).filter("doc_id % 5 = 0").select("doc_id", (F.col("doc_id") + 1).alias("page_no"), F.lit("torn").alias("message"))

    @F.pandas_udf("n_breaks long, n_paragraphs long, n_headings long, n_chars long")
    def read(contents: pd.Series) -> pd.DataFrame:
        found = [docx.read(c) for c in contents]
        return pd.DataFrame({"n_breaks": [b for b, _ in found], "n_paragraphs": [len(p) for _, p in found], "n_headings": [sum(s == "Heading1" for _, s in p) for _, p in found], "n_chars": [sum(len(x) for x, _ in p) for _, p in found]})

    return sinks.docx(base, failed).select("doc_id", read("content").alias("r")).select("doc_id", "r.*")


_COMMITTED = "cm AS (SELECT line_id, text AS original_text, final_text AS corrected_text, '{\"x\":' || x || ',\"y\":' || y || ',\"w\":' || w || ',\"h\":' || h || '}' AS bbox, 1::BIGINT AS accepted, 'ann' AS reviewer FROM fi WHERE touched)"
_FINAL = "fi AS (SELECT ln.*, coalesce(a.text, e.text, ln.text) AS final_text, a.text IS NOT NULL OR e.text IS NOT NULL AS touched FROM ln LEFT JOIN (SELECT * FROM ov WHERE store = 'accepted') a USING (line_id) LEFT JOIN (SELECT * FROM ov WHERE store = 'edited') e USING (line_id))"


def _commit(spark, d):
    return review.committed(t.lines(spark, d), t.overrides(spark, d), "ann", "2026-01-01T00:00:00").withColumn("accepted", F.col("accepted").cast("long"))


@query("rev_04_commit", "SELECT * FROM cm", t.LINES, t.OVERRIDES, _FINAL, _COMMITTED)
def _(spark, d):
    return _commit(spark, d).select("line_id", "original_text", "corrected_text", "bbox", "accepted", "reviewer")


@query("snk_07_append_corrections", "SELECT line_id, corrected_text, bbox, accepted FROM cm UNION ALL SELECT line_id, corrected_text, bbox, accepted FROM cm", t.LINES, t.OVERRIDES, _FINAL, _COMMITTED)
def _(spark, d):
    folder, rows = scratch(spark), _commit(spark, d)
    sinks.append_corrections(rows, folder)
    sinks.append_corrections(rows, folder)
    return spark.read.parquet(folder).select("line_id", "corrected_text", "bbox", "accepted")


@query("snk_08_training_export", "SELECT 'images/line-' || line_id || '.png' AS image, 'images/line-' || line_id || '.gt.txt' AS side, trim(corrected_text) || chr(10) AS side_text FROM co WHERE accepted AND trim(corrected_text) <> '' AND h >= 8", t.LINES, t.CORRECTIONS)
def _(spark, d):
    samples = review.eligible_samples(t.corrections(spark, d)).withColumn("name", F.concat(F.lit("line-"), "line_id", F.lit(".png")))
    return review.training_records(samples).select("image", "side", "side_text")


_MODELS = "md AS (SELECT lang AS script, doc_id, sha256(text) AS model_hash, doc_id % 3 <> 0 AS fine FROM documents)"


@query("snk_09_register", "SELECT script, model_hash, substr(model_hash, 1, 16) || '.mlmodel' AS file, doc_id AS registered_at FROM md WHERE fine QUALIFY row_number() OVER (PARTITION BY script ORDER BY doc_id DESC) = 1", _MODELS)
def _(spark, d):
    folder, i = scratch(spark), F.col("doc_id")
    hash_ = F.when(i % 3 != 0, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("!")), 256))
    models = t.documents(spark, d).select(F.lit("kraken").alias("engine"), hash_.alias("model_hash"), F.col("text").cast("binary").alias("content"), F.col("lang").alias("script"), F.lit(1.0).alias("improvement_pct"), i.alias("registered_at"))
    sinks.register(models.filter("registered_at % 2 = 0"), folder)
    sinks.register(models.filter("registered_at % 2 = 1"), folder)
    return sinks.promoted(spark.read.parquet(folder).drop("content")).select("script", "model_hash", "file", "registered_at")


@query("snk_10_atomic_swap", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    folder, docs = scratch(spark), t.documents(spark, d)
    sinks.replace_folder(docs.select("lang").limit(1), folder)
    sinks.replace_folder(docs.groupBy("lang").agg(F.count("*").alias("n")), folder)
    return spark.read.parquet(folder)


@query("snk_14_sessions", "SELECT substr(sha256(text), 1, 16) AS key, max(CASE WHEN doc_id % 4 = 0 THEN lang || '!' ELSE lang END) AS state FROM documents GROUP BY 1")
def _(spark, d):
    folder = scratch(spark)
    one = t.documents(spark, d).select(digests.session_key(F.col("text")).alias("key"), F.col("lang").alias("state"), "doc_id")
    few = one.groupBy("key").agg(F.max(F.when(F.col("doc_id") % 4 == 0, F.concat("state", F.lit("!"))).otherwise(F.col("state"))).alias("state"), F.max((F.col("doc_id") % 4 == 0).cast("int")).alias("again"))
    few = few.withColumn("part", F.substring("key", 1, 1))
    whole = lambda rows: rows.groupBy("part").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "state"))))).alias("state")).withColumnRenamed("part", "key")
    sinks.save_sessions(whole(few.withColumn("state", F.lit("old"))), folder)
    sinks.save_sessions(whole(few), folder)
    found = sinks.load_sessions(spark, folder, "state string")
    return found.select(F.explode(F.from_json("state", "map<string,string>")).alias("key", "state"))


# Scalars


@query("fn_10_ligatures", "SELECT line_id, text AS source_text, replace(replace(text, 'th', 'þ'), 'ch', 'χ') AS suggestion_text FROM ln WHERE contains(text, 'th') OR contains(text, 'ch')", t.LINES)
def _(spark, d):
    return suggest.ligatures(t.lines(spark, d), {"th": "þ", "ch": "χ"}).select("line_id", "source_text", "suggestion_text")


@query("fn_29_verify_digest", "SELECT doc_id, doc_id % 2 = 0 OR doc_id % 3 = 0 AS verified, doc_id % 5 = 0 AS is_pointer FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    listed = F.when(i % 2 == 0, F.upper(F.sha2("text", 256))).when(i % 3 != 0, F.sha2(F.concat("text", F.lit("!")), 256))
    stub = F.when(i % 5 == 0, F.concat(F.lit("version https://git-lfs.github.com/spec/v1\n"), "text")).otherwise(F.col("text"))
    return t.documents(spark, d).select("doc_id", digests.verified(F.col("text"), listed).alias("verified"), digests.is_pointer(stub).alias("is_pointer"))


@query("fn_31_polytonic_keys", """SELECT l || a || b AS keys, nfc_normalize(g || CASE b WHEN '>' THEN chr(787) ELSE chr(788) END || CASE a WHEN '/' THEN chr(769) WHEN '=' THEN chr(768) WHEN '~' THEN chr(834) ELSE '' END) AS glyph
    FROM (VALUES ('a', 'α'), ('e', 'ε'), ('h', 'η'), ('i', 'ι'), ('o', 'ο'), ('u', 'υ'), ('w', 'ω'), ('r', 'ρ'), ('A', 'Α'), ('E', 'Ε'), ('H', 'Η'), ('I', 'Ι'), ('O', 'Ο'), ('U', 'Υ'), ('W', 'Ω'), ('R', 'Ρ')) x(l, g), (VALUES (''), ('/'), ('='), ('~')) y(a), (VALUES ('>'), ('<')) z(b)
    WHERE length(glyph) = 1 UNION ALL SELECT '''', chr(8125)""")
def _(spark, d):
    asked = spark.createDataFrame([(k,) for k in (*text.polytonic_keys(), "zz", "a")], "keys string")
    return asked.select("keys", text.polytonic(F.col("keys")).alias("glyph")).filter("glyph is not null")


@query("udf_07_results", "SELECT doc_id, coalesce(TRY_CAST(substr(source, 4) AS INT) * 2, -1)::BIGINT AS doubled, CASE WHEN TRY_CAST(substr(source, 4) AS INT) IS NULL THEN 'page: ' || source || ' has no number' WHEN TRY_CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'page: even' END AS error FROM documents")
def _(spark, d):
    n = results.checked(F.substring("source", 4, 9).try_cast("int"), F.concat("source", F.lit(" has no number")), "int")
    doubled = results.unwrap_or(results.mapped(n, lambda v: v * 2, "long"), F.lit(-1).cast("long"))
    odd = results.and_then(n, lambda v: F.when(v % 2 == 0, results.err(F.lit("even"), "int")).otherwise(results.ok(v)), "int")
    said = results.map_err(odd, lambda e: F.concat(F.lit("page: "), e), "int")
    return t.documents(spark, d).select("doc_id", doubled.alias("doubled"), said["error"].alias("error"))


@query("str_09_failures_as_data", "SELECT doc_id, TRY_CAST(substr(source, 4) AS INT)::BIGINT AS number, CASE WHEN TRY_CAST(substr(source, 4) AS INT) IS NULL THEN 'no number in ' || source END AS error FROM documents")
def _(spark, d):
    r = results.checked(F.substring("source", 4, 9).try_cast("int"), F.concat(F.lit("no number in "), "source"), "long")
    return t.documents(spark, d).select("doc_id", r["value"].alias("number"), r["error"].alias("error"))


# Runs, streams and resilience


def _each(spark, d, checkpoint_files: int):
    """All documents' line counts by a stream of files."""
    folder = scratch(spark)
    docs = t.documents(spark, d).select("doc_id", "text")
    docs.repartitionByRange(6, "doc_id").write.parquet(f"{folder}/in")
    stream = events.page_stream(spark, f"{folder}/in", "doc_id long, text string", max_files=checkpoint_files)
    return events.processed(stream, lambda b: b.select("doc_id", F.size(F.split("text", r"\n")).cast("long").alias("n_lines")), f"{folder}/out")


@query("str_01_page_stream", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents")
def _(spark, d):
    return _each(spark, d, 8).select("doc_id", "n_lines")


@query("str_02_bounded_window", "SELECT 3::BIGINT AS batches, count(*) AS n FROM documents")
def _(spark, d):
    return _each(spark, d, 2).agg(F.countDistinct("batch").alias("batches"), F.count("*").alias("n"))


@query("str_04_retries", "SELECT event_id // 3 AS call, bool_or(event_type <> 'error') AS ok, arg_min(CASE WHEN event_type <> 'error' THEN value END, event_id) FILTER (WHERE event_type <> 'error') AS value FROM events WHERE event_id % 3 < 2 GROUP BY 1")
def _(spark, d):
    e = t.table(spark, d, "events")
    calls = e.select(F.floor(F.col("event_id") / 3).alias("call"), (F.col("event_id") % 3).alias("attempt"), (F.col("event_type") != "error").alias("ok"), "value", F.when(F.col("event_type") == "error", "failed").alias("error"))
    return resilience.retried(calls, ["call"], 2).select("call", "ok", "value")


_CALLS = "SELECT (user_id % 5)::VARCHAR AS engine, event_id AS seq, epoch_us(ts)::DOUBLE / 1e6 AS t, CASE WHEN event_id % 4 < 3 THEN 'error' ELSE 'ok' END AS outcome FROM events"


def _calls(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return t.table(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("engine"), F.col("event_id").alias("seq"), at.alias("t"), F.when(F.col("event_id") % 4 < 3, "error").otherwise("ok").alias("outcome"), (F.col("user_id") % 40).cast("string").alias("key"))


@query(
    "str_05_circuit_breaker",
    f"""SELECT engine, seq, t, outcome, state, state <> 'open' AS allowed FROM (
    WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY seq) AS k FROM ({_CALLS})),
    r AS (
      SELECT engine, 0::BIGINT AS k, 0::BIGINT AS seq, 0.0::DOUBLE AS t, '' AS outcome, '' AS state, 'closed' AS after, 0 AS failures, 0.0::DOUBLE AS opened FROM (SELECT DISTINCT engine FROM c)
      UNION ALL
      SELECT engine, k, seq, t, outcome, state,
             CASE WHEN state = 'open' THEN 'open' WHEN outcome = 'ok' THEN 'closed' WHEN state = 'half_open' OR failures + 1 >= 3 THEN 'open' ELSE 'closed' END,
             CASE WHEN state = 'open' THEN failures WHEN outcome = 'ok' THEN 0 ELSE failures + 1 END,
             CASE WHEN state <> 'open' AND outcome <> 'ok' AND (state = 'half_open' OR failures + 1 >= 3) THEN t ELSE opened END
      FROM (SELECT c.engine, c.k, c.seq, c.t, c.outcome, CASE WHEN r.after = 'open' AND c.t - r.opened >= 300 THEN 'half_open' ELSE r.after END AS state, r.failures, r.opened FROM r JOIN c ON c.engine = r.engine AND c.k = r.k + 1))
    SELECT * FROM r WHERE k > 0)""",
)
def _(spark, d):
    return resilience.circuit_breaker(_calls(spark, d), 3, 300.0)


@query("str_06_cached_calls")
def _(spark, d):
    return resilience.cached(_calls(spark, d).withColumn("ok", F.col("outcome") == "ok"), 4, 3600.0)


@query("str_08_response_status", """SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 401
      WHEN event_type = 'click' THEN CASE WHEN event_id % 5 = 0 THEN 400 WHEN value > 40 THEN 413 WHEN event_id % 7 = 0 THEN 503 ELSE 202 END
      WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 7 = 0 THEN 503 WHEN event_id % 3 = 0 THEN 404
      WHEN event_type = 'view' THEN 200 WHEN event_id % 3 = 1 THEN 400 WHEN event_id % 2 = 0 THEN 404 ELSE 200 END::BIGINT AS status FROM events""")
def _(spark, d):
    i = F.col("event_id")
    requests = t.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "click", "submit").when(F.col("event_type") == "view", "status").otherwise("result").alias("route"), F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("tenant"),
        (i % 5 != 0).alias("valid_upload"), F.col("value").alias("n_bytes"), (i % 7 != 0).alias("queue_up"), F.when(i % 11 == 0, "nope").otherwise(F.md5(i.cast("string"))).alias("job_id"),
        F.when(i % 3 == 0, "not_found").when(i % 3 == 1, "running").otherwise("done").alias("state"), (i % 2 != 0).alias("has_result"),
    )
    return pages.response_status(requests, 40).select("event_id", F.col("status").cast("long").alias("status"))


@query("str_10_undo", "SELECT session, key, arg_max(value, seq) AS value FROM (SELECT *, count(*) OVER (PARTITION BY session) - row_number() OVER (PARTITION BY session ORDER BY seq) AS younger FROM (SELECT lang AS session, doc_id AS seq, source AS key, doc_id::VARCHAR AS value FROM documents)) WHERE younger >= 3 GROUP BY session, key")
def _(spark, d):
    log = t.documents(spark, d).select(F.col("lang").alias("session"), F.col("doc_id").alias("seq"), F.lit("edited").alias("store"), F.col("source").alias("key"), F.col("doc_id").cast("string").alias("value"))
    return review.undone(log, 3).select("session", "key", "value")


@query("flt_08_environment", """SELECT doc_id AS host, list_filter([CASE WHEN doc_id % 3 = 0 THEN 'tesseract is not installed' WHEN lang = 'en' THEN 'language packs missing: grc' WHEN lang = 'de' THEN 'language packs missing: ell, grc' END,
    CASE WHEN doc_id % 4 = 0 THEN 'kraken is not installed' WHEN doc_id % 5 = 0 THEN 'no recognition model found' END, CASE WHEN doc_id % 6 = 0 THEN 'torch and torchvision don''t fit together' END, CASE WHEN doc_id % 7 = 0 THEN 'PDF input is not available' END], lambda p: p IS NOT NULL) AS problems FROM documents""")
def _(spark, d):
    return pages.environment_problems(_reports(spark, d))


def _reports(spark, d):
    i = F.col("doc_id")
    packs = F.when(F.col("lang") == "en", F.array(F.lit("eng"), F.lit("ell"))).when(F.col("lang") == "de", F.array(F.lit("deu"))).otherwise(F.array(F.lit("grc"), F.lit("ell")))
    return t.documents(spark, d).select(
        i.alias("host"), (i % 3 != 0).alias("tesseract"), packs.alias("languages"), (i % 4 != 0).alias("kraken"), (i % 5).alias("models"), (i % 2 == 0).alias("torch"), F.when(i % 3 == 0, False).alias("torch_coherent"), (i % 7 != 0).alias("pdf"),
        F.when(i % 9 == 0, "cpu").alias("preferred"), F.when(i % 2 == 0, i % 4 == 0).alias("cuda"), (i % 3 == 0).alias("mps"),
    )


@query("trn_01_training_outcome", "SELECT count(*) AS n_samples, CASE WHEN count(*) = 0 THEN 'nothing_to_learn_from' ELSE 'promote' END AS outcome FROM co WHERE accepted AND trim(corrected_text) <> '' AND h >= 8 AND script IN ('en', 'de')", t.LINES, t.CORRECTIONS)
def _(spark, d):
    report = spark.createDataFrame([("en", 0.1, 20), ("de", 0.2, 20)], "script string, cer double, samples long")
    parent = report.withColumn("cer", F.col("cer") * 2)
    return review.training_outcome(report.select("script"), review.eligible_samples(t.corrections(spark, d)), report, parent)


@query("trn_04_device", "SELECT doc_id AS host, CASE WHEN doc_id % 9 = 0 THEN 'cpu' WHEN doc_id % 4 = 0 THEN 'cuda:0' WHEN doc_id % 3 = 0 THEN 'mps' ELSE 'cpu' END AS device FROM documents")
def _(spark, d):
    return pages.device(_reports(spark, d))


@query("trn_05_exit_code", "SELECT 3::BIGINT AS broken, 1::BIGINT AS failed, 0::BIGINT AS good")
def _(spark, d):
    reports = pages.environment_problems(_reports(spark, d))
    missing, none = reports.filter(F.size("problems") > 0), reports.filter("host < 0")
    jobs = t.documents(spark, d).select((F.col("doc_id") % 5 != 0).alias("ok"))
    code = lambda p, j, name: pages.exit_code(p, j).select(F.col("exit_code").cast("long").alias(name))
    return code(missing, jobs, "broken").crossJoin(code(none, jobs, "failed")).crossJoin(code(none, jobs.filter("ok"), "good"))  # one row each


@query("trn_06_next_free", "SELECT source AS prefix, source || '-' || (SELECT min(n) FROM range(1, (SELECT max(doc_id) + 3 FROM documents)) x(n) WHERE n NOT IN (SELECT doc_id // 3 FROM documents y WHERE y.source = z.source)) AS next_id FROM (SELECT DISTINCT source FROM documents) z")
def _(spark, d):
    return pages.next_free(t.documents(spark, d).select(F.col("source").alias("prefix"), F.floor(F.col("doc_id") / 3).alias("n")))


@query("top_06_model_choice", """SELECT script, coalesce(CASE WHEN n % 2 = 0 THEN 'm' || n END, 'b.mlmodel') AS model FROM (SELECT d.lang AS script, max(CASE WHEN doc_id % 3 = 0 THEN doc_id END) AS n FROM documents d GROUP BY d.lang)""")
def _(spark, d):
    i = F.col("doc_id")
    scripts = t.documents(spark, d).select(F.col("lang").alias("script")).distinct()
    promotions = t.documents(spark, d).filter("doc_id % 3 = 0").select(F.col("lang").alias("script"), i.alias("pos"), F.when(i % 2 == 0, "kraken").otherwise("calamari").alias("engine"), F.concat(F.lit("m"), i).alias("model"))
    manifest = spark.createDataFrame([("b.mlmodel", "kraken", True), ("a.mlmodel", "kraken", False)], "name string, engine string, is_default boolean")
    return pages.chosen_model(scripts, promotions, manifest, spark.createDataFrame([("a.mlmodel",), ("b.mlmodel",)], "name string")).select("script", "model")


@query("src_21_host_settings", """SELECT doc_id AS host, CASE doc_id % 4 WHEN 0 THEN 'app-' || lang ELSE 'quire' END AS app_name, CASE doc_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 300 END::BIGINT AS dpi,
    CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE false END AS strict, source AS tenant,
    list_filter([CASE WHEN doc_id % 3 = 2 THEN 'QUIRE_DPI' END, CASE WHEN doc_id % 5 = 2 THEN 'QUIRE_STRICT' END], lambda x: x IS NOT NULL) AS wrong FROM documents""")
def _(spark, d):
    i = F.col("doc_id")
    one = lambda name, value: F.struct(F.lit(f"QUIRE_{name}").alias("name"), value.alias("value"))
    four = F.array(
        one("APP_NAME", F.when(i % 4 == 0, F.concat(F.lit(" app-"), "lang")).otherwise(F.lit(" "))), one("DPI", F.when(i % 3 == 0, " 200 ").when(i % 3 == 2, "many")),
        one("STRICT", F.when(i % 5 == 0, "Yes").when(i % 5 == 1, "off").when(i % 5 == 2, "maybe").when(i % 5 == 3, "")), one("API_KEYS", F.concat(F.lit("k:"), "source", F.lit(", other:x"))),
    )
    rows = t.documents(spark, d).select(i.alias("host"), F.inline(four))
    out = settings.scan(rows)
    return out.select("host", "app_name", F.col("dpi").cast("long").alias("dpi"), "strict", F.col("api_keys")["k"].alias("tenant"), "wrong")


@query("str_03_streamed_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, CASE WHEN event_type = 'error' THEN 'page_failed' ELSE 'page_completed' END AS event_type, count(*) AS n, round(sum(value), 4) AS total_ms FROM events GROUP BY 1, 2")
def _(spark, d):
    folder = scratch(spark)
    rows = t.table(spark, d, "events")
    rows.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    stream = events.windowed(events.page_events(events.page_stream(spark, f"{folder}/in", schema, max_files=1)))
    writer = stream.writeStream.outputMode("complete").foreachBatch(lambda b, _n: b.write.mode("overwrite").parquet(f"{folder}/out"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("total_ms", F.round("total_ms", 4))


@query("top_07_candidate_caps", "SELECT DISTINCT text AS token, CASE WHEN length(text) BETWEEN 1 AND 64 THEN least(512, 60 * (length(text) - length(replace(text, 'e', '')))) ELSE 0 END AS n FROM ln", t.LINES)
def _(spark, d):
    # Sixty targets for each e: lines with many reach the cap, and long ones have none.
    pairs = [("e", chr(0x4E00 + k)) for k in range(60)]
    return t.lines(spark, d).select(F.col("text").alias("token")).distinct().select("token", F.size(suggest.confusion_candidates(F.col("token"), pairs)).cast("long").alias("n"))


@query("trn_03_training_command", "SELECT doc_id, '--device cpu train ' || CASE WHEN doc_id % 2 = 0 THEN '-i ' || source || ' ' ELSE '' END || '--epochs 10 --quit fixed --lrate 0.0001 ' || lang || '/images/*.png' AS arguments, 7200::BIGINT AS timeout_s FROM documents")
def _(spark, d):
    jobs = t.documents(spark, d).select("doc_id", F.col("lang").alias("folder"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("parent"), F.lit("cpu").alias("device"))
    return training.training_command(jobs).select("doc_id", F.array_join("arguments", " ").alias("arguments"), F.col("timeout_s").cast("long").alias("timeout_s"))


@query("snk_13_listed_models", "SELECT lang AS name, max(doc_id) AS pos, max(doc_id) % 2 = 0 AS fine FROM documents GROUP BY lang")
def _(spark, d):
    from quire.sources import replies

    docs = t.documents(spark, d).withColumn("name", F.col("lang"))
    entries = docs.select("name", F.col("doc_id").alias("pos"), F.lit("kraken").alias("engine"), F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2(F.lit("x"), 256)).alias("sha256"))
    listed = replies.latest_by_name(entries)
    there = docs.select("name", F.col("doc_id").alias("pos"), F.col("text").alias("content"))
    return listed.join(there, ["name", "pos"]).select("name", "pos", digests.verified(F.col("content"), F.col("sha256")).alias("fine"))
