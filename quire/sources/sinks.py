"""Documents as text, Markdown and archival XML, and the lexicon's word list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as fn

PAGE = ["doc_id", "page_no"]


def _joined(rows: DataFrame, key: list[str], order: str, value: Column, glue: str, name: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(items, lambda s: s["v"]), glue).alias(name))


def plain_text(lines: DataFrame, failures: DataFrame) -> DataFrame:
    """Per document its pages' lines; pages that could not be read are noted first."""
    note = F.concat(F.lit("[Page "), "page_no", F.lit(" could not be read: "), "message", F.lit("]"))
    rows = failures.select(*PAGE, F.lit(-1).cast("long").alias("line_idx"), note.alias("v")).unionByName(lines.select(*PAGE, "line_idx", F.col("text").alias("v")))
    rows = rows.withColumn("o", F.struct("page_no", "line_idx"))
    return _joined(rows, ["doc_id"], "o", F.col("v"), "\n", "body")


def markdown(paragraphs: DataFrame) -> DataFrame:
    """Per document its pages as sections of paragraphs (para_idx, text, role)."""
    role, body = F.col("role"), F.col("text")
    mark = F.when(role == "heading", F.concat(F.lit("# "), body)).when(role == "subheading", F.concat(F.lit("## "), body))
    mark = mark.when(role == "page_number", F.concat(F.lit("<!-- page: "), body, F.lit(" -->"))).when(role == "running_head", F.concat(F.lit("<!-- head: "), body, F.lit(" -->")))
    mark = mark.when(role == "footnote", F.concat(F.lit("*[Footnote]* "), body)).otherwise(body)
    pages = _joined(paragraphs, PAGE, "para_idx", mark, "\n\n", "v").withColumn("v", F.concat(F.lit("## Page "), "page_no", F.lit("\n\n"), "v"))
    return _joined(pages, ["doc_id"], "page_no", F.col("v"), "\n\n", "body").withColumn("body", F.concat("body", F.lit("\n")))


def alto_lines(lines: DataFrame) -> DataFrame:
    """Each line as ALTO's TextLine, verbatim."""
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), fn.escape_html(value.cast("string")), F.lit('"'))
    place = [attribute(n, F.col(c)) for n, c in (("HPOS", "x"), ("VPOS", "y"), ("WIDTH", "w"), ("HEIGHT", "h"))]
    content = F.concat(F.lit("<String"), attribute("CONTENT", F.col("text")), attribute("WC", F.format_number(F.col("conf") / 100, 6)), *place, F.lit("/>"))
    line = F.concat(F.lit("<TextLine"), attribute("ID", F.col("line_id")), *place, F.lit(">"), content, F.lit("</TextLine>"))
    return lines.select(*PAGE, "line_idx", line.alias("xml"))


def alto(lines: DataFrame) -> DataFrame:
    """Each document as one ALTO file."""
    pages = _joined(alto_lines(lines), PAGE, "line_idx", F.col("xml"), "", "v")
    pages = pages.withColumn("v", F.concat(F.lit('<Page PHYSICAL_IMG_NR="'), "page_no", F.lit('"><PrintSpace><TextBlock>'), "v", F.lit("</TextBlock></PrintSpace></Page>")))
    out = _joined(pages, ["doc_id"], "page_no", F.col("v"), "", "body")
    return out.withColumn("body", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout>'), "body", F.lit("</Layout></alto>")))


def polygon(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box's corners clockwise from the top left."""
    at = lambda a, b: F.concat(a.cast("string"), F.lit(","), b.cast("string"))
    return F.concat_ws(" ", at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))


def page_xml(lines: DataFrame) -> DataFrame:
    """Each page as one PAGE file, a region with its lines."""
    box = [F.col(c) for c in "xywh"]
    line = F.concat(F.lit('<TextLine id="'), "line_id", F.lit('"><Coords points="'), polygon(*box), F.lit('"/><TextEquiv conf="'), F.format_number(F.col("conf") / 100, 6), F.lit('"><Unicode>'), fn.escape_html(F.col("text")), F.lit("</Unicode></TextEquiv></TextLine>"))
    out = _joined(lines, PAGE, "line_idx", line, "", "body")
    head = '<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion>'
    return out.withColumn("body", F.concat(F.lit(head), "body", F.lit("</TextRegion></Page></PcGts>")))


def word_list(forms: DataFrame) -> DataFrame:
    """The distinct monotonized forms of more than one letter, in code-point order."""
    return forms.select(fn.monotonize(F.lower("form")).alias("form")).filter(F.length("form") > 1).distinct().orderBy("form")


def envelope(rows: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


# Files of a whole document


def _by_document(rows: DataFrame, write) -> DataFrame:
    """write(pages) -> bytes for each document; a document's rows, one per page, are gathered by the task that writes its file."""
    def run(key, pdf):
        import pandas as pd

        return pd.DataFrame({"doc_id": [key[0]], "content": [write(pdf.sort_values("page_no").to_dict("records"))]})

    return rows.groupBy("doc_id").applyInPandas(run, "doc_id long, content binary")


def failure_note(page_no: Column, message: Column) -> Column:
    return F.concat(F.lit("[Page "), page_no, F.lit(" could not be read: "), message, F.lit("]"))


def _noted(pages: DataFrame, failures: DataFrame) -> DataFrame:
    """pages with note, the failures of each, or null."""
    notes = F.array_join(F.array_sort(F.collect_list(failure_note(F.col("page_no"), F.col("message")))), "\n")
    return pages.join(failures.groupBy(*PAGE).agg(notes.alias("note")), PAGE, "left")


def docx(paragraphs: DataFrame, failures: DataFrame) -> DataFrame:
    """Each document (doc_id, content) as a Word file: pages broken apart, a style for each role, notes of failed pages in italics."""
    from quire.sources import docx as files

    both = paragraphs.select(*PAGE).union(failures.select(*PAGE)).distinct()
    own = paragraphs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("para_idx", "text", "role"))).alias("paragraphs"))
    rows = _noted(both.join(own, PAGE, "left"), failures)

    def write(pages):
        none = lambda v: v is None or not hasattr(v, "__len__")
        return files.write([([] if none(p["paragraphs"]) else [(r["text"], r["role"]) for r in p["paragraphs"]], None if none(p["note"]) else p["note"]) for p in pages])

    return _by_document(rows, write)


def searchable_pdf(pages: DataFrame, lines: DataFrame, failures: DataFrame) -> DataFrame:
    """Each document (doc_id, content) as a PDF file: the page images (PAGE, width, height, content) with the lines' text laid over them invisibly.

    A page without an image is blank; a failed page shows its note.
    """
    from quire.sources import pdf as files

    item = F.struct("line_idx", "x", "y", "w", "h", "text")
    own = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("lines"))
    rows = _noted(pages.select(*PAGE, "width", "height", "content").join(own, PAGE, "left"), failures)

    def write(found):
        none = lambda v: v is None or not hasattr(v, "__len__")
        return files.write([
            {"width": p["width"], "height": p["height"], "image": None if none(p["content"]) else bytes(p["content"]), "note": None if none(p["note"]) else p["note"],
             "lines": [] if none(p["lines"]) else [(r["x"], r["y"], r["w"], r["h"], r["text"]) for r in p["lines"]]}
            for p in found
        ])

    return _by_document(rows, write)


# Tables and folders that grow or are replaced


def _place(spark, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def replace_folder(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Writes df beside the folder and then swaps it in; if writing fails, the old folder stays and nothing is left behind."""
    spark, part, old = df.sparkSession, path.rstrip("/") + ".part", path.rstrip("/") + ".old"
    system, place = _place(spark, path)
    _, beside = _place(spark, part)
    _, before = _place(spark, old)
    try:
        df.write.format(format).mode("overwrite").save(part)
    except Exception:
        system.delete(beside, True)
        raise
    system.delete(before, True)
    if system.exists(place) and not system.rename(place, before):
        raise OSError(f"could not move {path}")
    if not system.rename(beside, place):
        system.rename(before, place)
        raise OSError(f"could not write {path}")
    system.delete(before, True)


def append_corrections(corrections: DataFrame, path: str) -> None:
    """Adds rows to the store, all or none; rows are never changed or removed."""
    corrections.write.mode("append").parquet(path)


def save_sessions(sessions: DataFrame, path: str) -> None:
    """Review sessions (key, state) as JSON, one folder per key; a session replaces its former state alone."""
    spark = sessions.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        sessions.write.mode("overwrite").partitionBy("key").json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def load_sessions(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, key string").json(path)


def registered(models: DataFrame) -> DataFrame:
    """Models (engine, model_hash, content, script, improvement_pct, registered_at) that have the digest they are registered under, with the file that keeps them."""
    from quire.functions.digests import is_digest, verified

    fine = models.filter(is_digest(F.col("model_hash"))).filter(verified(F.col("content"), F.col("model_hash")))
    return fine.withColumn("file", F.concat(F.substring(F.lower("model_hash"), 1, 16), F.lit(".mlmodel")))


def register(models: DataFrame, path: str) -> None:
    """Adds the models that are what they say to the registry, a table of promotions and their weights."""
    registered(models).write.mode("append").parquet(path)


def promoted(registry: DataFrame) -> DataFrame:
    """The newest model of each script; weights aren't read."""
    last = F.max(F.struct("registered_at", "model_hash", "engine", "file", "improvement_pct")).alias("m")
    return registry.groupBy("script").agg(last).select("script", "m.engine", "m.model_hash", "m.file", "m.improvement_pct", "m.registered_at")


def export_training(samples: DataFrame, folder: str) -> None:
    """Writes each sample (name, text, image) as an image and a side text by the tasks that hold them, and the list of all as train.json.

    The folder may be in any file system that pyarrow knows.  A task that runs
    again writes the same files.
    """
    from quire.operators.review import training_records

    records = training_records(samples).join(samples.select("name", "image").withColumnRenamed("image", "content"), "name")

    def write(rows):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(f"{base}/images", recursive=True)
        for r in rows:
            for name, data in ((r["image"], bytes(r["content"])), (r["side"], r["side_text"].encode())):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(data)

    records.select("image", "side", "side_text", "content").foreachPartition(write)
    records.orderBy("name").select("entry").write.mode("overwrite").text(f"{folder}/train.json")
