"""Scans: files of pages to a row per page, and folders of page images."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import pdf, png

PAGE = pa.schema([("path", pa.string()), ("page_no", pa.int64()), ("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
PAGE_DDL = "path string, page_no long, kind string, width int, height int, content binary, error string"
#: Suffixes of page images.
SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder (path, content), from any file system that Spark reads."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _pages(content: bytes) -> Iterator[tuple]:
    """(page_no, kind, width, height, content, error) of each page of a file; page 0 stands for a file that can't be opened."""
    if content[:4] == pdf.MAGIC:
        try:
            file = pdf.File(content)
        except Exception as error:  # the file is lost, the others go on
            yield 0, "pdf", 1, 1, None, f"{type(error).__name__}: {error}"
            return
        for number, page in enumerate(file.pages, 1):
            try:
                data, w, h = file.image(page)
                yield number, "pdf", w, h, data, None
            except Exception as error:  # the page is lost, the others go on
                yield number, "pdf", 1, 1, None, f"{type(error).__name__}: {error}"
    elif content.startswith(png.TIFF):
        frames = list(png.tiff_frames(content))
        for number, (pixels, error) in enumerate(frames, 1):
            if error:
                yield number, "image", 1, 1, None, error
            else:
                # A single frame's bytes pass untouched.
                yield number, "image", pixels.shape[1], pixels.shape[0], content if len(frames) == 1 else png.encode(pixels), None
    else:
        try:
            w, h = png.size(content)
            yield 1, "image", w, h, content, None
        except Exception as error:
            yield 1, "image", 1, 1, None, f"{type(error).__name__}: {error}"


def pages(files: DataFrame) -> DataFrame:
    """A row per page of files (path, content): path, page_no (from 1), kind, width, height, content, error.

    PDF files are told by their first four bytes, all others are images.  A page
    that can't be read is a row with an error, and the scan goes on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for page in _pages(content or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, *page), PAGE)], schema=PAGE)

    return files.select("path", "content").mapInArrow(run, PAGE_DDL)


def one_page(payloads: DataFrame) -> DataFrame:
    """Payloads (path, content) as a page each, taken as they are."""
    return payloads.select("path", F.lit(1).cast("long").alias("page_no"), F.lit("memory").alias("kind"), F.lit(1).alias("width"), F.lit(1).alias("height"), "content", F.lit(None).cast("string").alias("error"))


def count_pages(pages: DataFrame, key: str) -> DataFrame:
    """How many pages each file has; a file that can't be opened counts as one."""
    return pages.groupBy(key).agg(F.greatest(F.lit(1), F.count_if(F.col("page_no") > 0)).cast("long").alias("pages"))


def numbered_images(files: DataFrame) -> DataFrame:
    """Files named by a number and an image's suffix: page_no and content; of several files of a number the first name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    number = F.regexp_extract(name, rf"(?i)^([0-9]+)\.(?:{'|'.join(SUFFIXES)})$", 1)
    found = files.select(number.alias("_n"), name.alias("_name"), "content").filter("_n != ''")
    return found.groupBy(F.col("_n").cast("long").alias("page_no")).agg(F.min_by("content", "_name").alias("content"))


def fixture_tiers(fixtures: DataFrame, provenance: DataFrame) -> DataFrame:
    """Fixtures (fixture_id, text) with composed text and the tier that provenance (fixture_id, tier) gives, else unknown."""
    from quire.functions.text import nfc

    # A row per fixture, of which there are few.
    known = provenance.select("fixture_id", F.when(F.col("tier").isin("synthetic", "scan"), F.col("tier")).alias("tier"))
    return fixtures.join(known, "fixture_id", "left").withColumns({"text": nfc(F.col("text")), "tier": F.coalesce("tier", F.lit("unknown"))})
