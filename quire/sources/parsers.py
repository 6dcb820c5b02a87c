"""Engine output, lexicon files and uploads as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_LEVEL, WORD_LEVEL = 4, 5


def tesseract_rows(tsv: DataFrame, level: int) -> DataFrame:
    """Rows of one level of columnar output (arrays level, text, conf, left, top, width, height), with their index."""
    zipped = F.arrays_zip("level", "text", "conf", "left", "top", "width", "height")
    each = tsv.select("doc_id", "page_no", F.posexplode(zipped).alias("idx", "r")).select("doc_id", "page_no", "idx", "r.*")
    whole = [F.col(c).try_cast("int").alias(a) for c, a in (("left", "x"), ("top", "y"), ("width", "w"), ("height", "h"))]
    typed = each.select("doc_id", "page_no", "idx", F.col("level").try_cast("int").alias("level"), F.btrim(F.coalesce("text", F.lit(""))).alias("text"), F.col("conf").try_cast("double").alias("conf"), *whole)
    return typed.filter((F.col("level") == level) & (F.col("w") > 0) & (F.col("h") > 0))


def tesseract_words(tsv: DataFrame) -> DataFrame:
    """Words with text and a confidence from 0 to 100; rows that fail a cast are skipped."""
    words = tesseract_rows(tsv, WORD_LEVEL).filter((F.col("text") != "") & F.col("conf").between(0, 100) & (F.col("x") >= 0) & (F.col("y") >= 0))
    return words.withColumn("block_id", F.concat(F.lit("word-"), "idx"))


def tesseract_lines(tsv: DataFrame) -> DataFrame:
    """Empty lines in reading order, counted from 1 over the kept rows."""
    kept = tesseract_rows(tsv, LINE_LEVEL)
    order = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("idx"))
    return kept.withColumn("reading_order", order).withColumn("line_id", F.concat(F.lit("line-"), "reading_order")).drop("text", "conf")


def polygon_box(polygon: Column) -> Column:
    """x, y, w, h around an array of [x, y] points; null for none."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    left, top = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(polygon) > 0, F.struct(left.alias("x"), top.alias("y"), (F.array_max(xs) - left).alias("w"), (F.array_max(ys) - top).alias("h")))


def kraken_records(records: DataFrame) -> DataFrame:
    """Boxes from bbox (x0, y0, x1, y1), else around the polygon; confidence is the mean of the letters', on a scale of 100; category normalized."""
    given = F.when(F.size("bbox") == 4, F.struct(F.col("bbox")[0].alias("x"), F.col("bbox")[1].alias("y"), (F.col("bbox")[2] - F.col("bbox")[0]).alias("w"), (F.col("bbox")[3] - F.col("bbox")[1]).alias("h")))
    box = F.coalesce(given, polygon_box(F.col("polygon")))
    total = F.aggregate("char_conf", F.lit(0.0), lambda a, c: a + c)
    mean = F.when(F.size("char_conf") > 0, total / F.size("char_conf")).otherwise(0.0)
    kinds = ("main", "apparatus", "scholia", "running_head", "footnote", "margin")
    named = F.replace(F.lower(F.coalesce("category", F.lit(""))), F.lit("-"), F.lit("_"))
    out = records.withColumn("_box", box).withColumn("conf", F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean * 100)))
    return out.withColumn("region_type", F.when(named.isin(*kinds), named).otherwise("unknown")).select("*", "_box.*").drop("_box")


def vlm_reply(replies: DataFrame) -> DataFrame:
    """Lines ``x1,y1,x2,y2|text`` of a reply; coordinates are divided by its scale and rounded to even."""
    each = replies.select("doc_id", "page_no", "scale", F.posexplode(F.split("payload", "\n")).alias("idx", "row"))
    pattern = r"^\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\|(.*)$"
    number = lambda k: F.bround(F.regexp_extract("row", pattern, k).try_cast("int") / F.col("scale")).cast("int")
    kept = each.filter(F.col("row").rlike(pattern))
    x1, y1, x2, y2 = (number(k) for k in (1, 2, 3, 4))
    size = lambda a, b: F.greatest(F.lit(1), b - a)
    return kept.select("doc_id", "page_no", "idx", x1.alias("x"), y1.alias("y"), size(x1, x2).alias("w"), size(y1, y2).alias("h"), F.btrim(F.regexp_extract("row", pattern, 5)).alias("text"), F.lit(0.0).alias("conf"))


CALAMARI = "predictions array<struct<id:string, sentence:string, avg_char_probability:double>>"


def calamari_predictions(replies: DataFrame) -> DataFrame:
    """The voted prediction of a reply, else its first; empty ones are skipped."""
    p = F.from_json("payload", F.lit(CALAMARI))["predictions"]
    best = F.coalesce(F.get(F.filter(p, lambda x: x["id"] == "voted"), F.lit(0)), F.get(p, F.lit(0)))
    text, conf = F.btrim(best["sentence"]), F.greatest(F.lit(0.0), F.least(F.lit(100.0), best["avg_char_probability"] * 100))
    return replies.select("doc_id", "page_no", text.alias("text"), conf.alias("conf")).filter("text is not null and text != ''")


def hunspell_words(rows: DataFrame) -> DataFrame:
    """Words of a dictionary's rows (value, idx): after the count in the first, up to the flags."""
    return rows.filter("idx > 0").select(F.btrim(F.split_part("value", F.lit("/"), F.lit(1))).alias("form")).filter("form != ''")


def quoted_keys(rows: DataFrame) -> DataFrame:
    """Forms of a table that is written as a program's mapping: what stands quoted before a colon. The file is never run."""
    return rows.withColumn("form", F.explode(F.regexp_extract_all("value", F.lit(r"'([^']+)':"), F.lit(1)))).drop("value")


def title_words(rows: DataFrame) -> DataFrame:
    """Single words among page titles (value, idx), after a header row."""
    return rows.filter("idx > 0").select(F.replace("value", F.lit("_"), F.lit(" ")).alias("form")).filter(~F.contains(F.col("form"), F.lit(" ")) & (F.col("form") != ""))


#: Suffixes that may be uploaded, and how their files begin.
MAGIC = {"pdf": "25504446", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF", "tif": "49492A00", "tiff": "49492A00"}


def upload_verdict(name: Column, content: Column, most: int) -> Column:
    """The first rule that an upload breaks, or ok."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    magic = F.lit(None).cast("string")
    for kind, start in MAGIC.items():
        magic = F.when(suffix == kind, F.lit(start)).otherwise(magic)
    other = F.when(suffix.isin("tif", "tiff") & F.startswith(F.hex(content), F.lit("4D4D002A")), True).otherwise(False)
    fits = F.startswith(F.hex(content), magic) | other
    return (
        F.when(F.length(content) == 0, "empty").when(F.length(content) > most, "too_large").when(name.rlike(r"[/\\]") | name.isin("", ".", ".."), "bad_name")
        .when(magic.isNull(), "unknown_suffix").when(~fits, "wrong_content").otherwise("ok")
    )


def lexicon_file(spark: SparkSession, path: str, lexicon: str, layer: int) -> DataFrame:
    """A word list, one form a row, with or without carriage returns."""
    rows = spark.read.text(path).select(F.rtrim("value").alias("form")).filter("form != ''")
    return rows.withColumn("lexicon", F.lit(lexicon)).withColumn("layer", F.lit(layer))


def corpus_pages(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Corpus pages (split, page_id) whose image has a transcription of the same stem; the script is the id's start."""
    kept = images.filter(F.lower(F.col("suffix")).isin("png", "jpg", "jpeg", "tiff", "tif"))
    script = F.regexp_extract("page_id", r"^([a-z]+)", 1)
    return kept.join(texts.select("split", "page_id", "text"), ["split", "page_id"]).withColumn("script", script).withColumn("provenance", F.concat(F.lit("corpus:"), "split", F.lit("/"), "page_id"))


def corrections_for(corrections: DataFrame, prefix: str) -> DataFrame:
    """Corrections whose line_id is LIKE prefix%, in order; _ and % in the prefix are wild."""
    return corrections.filter(F.col("line_id").like(prefix + "%")).orderBy("corrected_at", "line_id")


def promoted_model(promotions: DataFrame, script: str) -> DataFrame:
    """The newest promotion that was measured on the script and whose weights still have their digest."""
    fine = promotions.filter(F.map_contains_key("per_script_cer", F.lit(script)) & (F.lower("sha256") == F.sha2("content", 256)))
    return fine.orderBy(F.desc("pos")).limit(1)
