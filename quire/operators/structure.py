"""From lines to paragraphs: page geometry, breaks, hyphenation, roles and running heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

PAGE = ["doc_id", "page_no"]
BUCKET = 5
#: Characters that may end a broken line.
HYPHENS = "-‐¬­"


def column_edge(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Per page the median (truncated) of the most frequent 5-pixel bucket of a value; ties go to the bucket seen first."""
    b = lines.select(*PAGE, "line_idx", value.cast("int").alias("v")).withColumn("bucket", F.floor(F.col("v") / BUCKET))
    each = b.groupBy(*PAGE, "bucket").agg(F.count("*").alias("n"), F.min("line_idx").alias("first"), F.percentile("v", 0.5).alias("mid"))
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "first"))
    return each.withColumn("r", rank).filter("r = 1").select(*PAGE, F.col("mid").cast("int").alias(name))


def page_geometry(lines: DataFrame) -> DataFrame:
    """Per page: left and right edge, median leading and median line height."""
    order = Window.partitionBy(*PAGE).orderBy("line_idx")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(order)
    medians = lines.withColumn("_gap", gap).groupBy(*PAGE).agg(F.coalesce(F.percentile("_gap", 0.5), F.lit(0.0)).alias("median_leading"), F.percentile("h", 0.5).alias("median_line_height"))
    return medians.join(column_edge(lines, F.col("x"), "left_edge"), PAGE).join(column_edge(lines, F.col("x") + F.col("w"), "right_edge"), PAGE)


def multi_column(lines: DataFrame, widths: DataFrame) -> DataFrame:
    """Per page whether the two most frequent left buckets hold a fifth of the lines each and lie a quarter page apart."""
    b = lines.withColumn("bucket", F.floor(F.col("x") / BUCKET)).groupBy(*PAGE, "bucket").agg(F.count("*").alias("n"), F.min("line_idx").alias("first"))
    over = Window.partitionBy(*PAGE)
    b = b.withColumn("r", F.row_number().over(over.orderBy(F.desc("n"), "first"))).withColumn("total", F.sum("n").over(over))
    two = b.filter("r <= 2").groupBy(*PAGE).agg(F.count("*").alias("k"), F.min("n").alias("least"), (F.max("bucket") - F.min("bucket")).alias("apart"), F.first("total").alias("total"))
    two = two.join(widths, PAGE)
    yes = (F.col("total") >= 4) & (F.col("width") > 0) & (F.col("k") == 2) & (F.col("least") >= 0.2 * F.col("total")) & (F.col("apart") * BUCKET > 0.25 * F.col("width"))
    return two.select(*PAGE, yes.alias("multi_column"))


def with_breaks(lines: DataFrame, geometry: DataFrame) -> DataFrame:
    """Lines with the three break rules against the line before: indent, short line and gap."""
    order = Window.partitionBy(*PAGE).orderBy("line_idx")
    at = lines.join(geometry, PAGE)
    before = lambda c: F.lag(c).over(order)
    at = at.withColumn("_x", before("x")).withColumn("_right", before(F.col("x") + F.col("w"))).withColumn("_bottom", before(F.col("y") + F.col("h")))
    wide = F.col("right_edge") - F.col("left_edge")
    some = F.col("_x").isNotNull() & (wide > 0)
    indent = some & (F.col("x") > F.col("left_edge") + 0.02 * wide) & (F.col("x") > F.col("_x") + 0.01 * wide)
    short = some & (F.col("_right") < F.col("right_edge") - 0.15 * wide)
    gap = F.col("_x").isNotNull() & (F.col("median_leading") > 0) & (F.col("y") - F.col("_bottom") > 1.5 * F.col("median_leading"))
    return at.withColumn("indent_break", indent).withColumn("short_break", short).withColumn("gap_break", gap).drop("_x", "_right", "_bottom")


def paragraphs(broken: DataFrame) -> DataFrame:
    """Lines with their paragraph's number on the page; a running head is a paragraph of its own."""
    order = Window.partitionBy(*PAGE).orderBy("line_idx")
    head = F.col("region_type") == "running_head"
    after_head = F.coalesce(F.lag("region_type").over(order) == "running_head", F.lit(False))
    new = F.lag("line_idx").over(order).isNull() | head | after_head | F.col("indent_break") | F.col("short_break") | F.col("gap_break")
    number = F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return broken.withColumn("_new", new).withColumn("para_idx", number).withColumn("para_id", F.concat(F.lit("page-"), "page_no", F.lit("-para-"), "para_idx")).drop("_new")


def is_centred(x: Column, w: Column, left: Column, right: Column, tolerance: int = 15) -> Column:
    wide = right - left
    return (wide > 0) & (w <= 0.85 * wide) & (F.abs((x - left) - (right - (x + w))) <= tolerance)


def role(first_text: Column, is_head: Column, height: Column, x: Column, w: Column, left: Column, right: Column, median_height: Column) -> Column:
    """page_number or running_head for a head line, heading for a large narrow centred one, else body."""
    number = F.btrim(first_text).rlike(r"^(\d+|(?i)[ivxlcdm]+)$")
    heading = (height >= 1.3 * median_height) & (w < 0.7 * (right - left)) & is_centred(x, w, left, right)
    return F.when(is_head, F.when(number, "page_number").otherwise("running_head")).when(heading, "heading").otherwise("body")


def edge_slots(lines: DataFrame, top_k: int = 2, bottom_k: int = 2) -> DataFrame:
    """The first and last lines of each page by y, without blank and upright ones; a short page's line may be both."""
    kept = lines.filter((F.btrim("text") != "") & (F.col("h") <= 2 * F.col("w")))
    over = Window.partitionBy(*PAGE)
    top = F.row_number().over(over.orderBy("y", "line_idx")) - 1
    bottom = F.row_number().over(over.orderBy(F.desc("y"), F.desc("line_idx"))) - 1
    ranked = kept.withColumn("_top", top).withColumn("_bottom", bottom)
    both = ranked.filter(F.col("_top") < top_k).withColumn("side", F.lit("top")).withColumn("slot", F.col("_top"))
    return both.unionByName(ranked.filter(F.col("_bottom") < bottom_k).withColumn("side", F.lit("bottom")).withColumn("slot", F.col("_bottom"))).drop("_top", "_bottom")


def running_heads(lines: DataFrame, pages: DataFrame, book: str = "doc_id", window: int = 2, threshold: float = 0.9) -> DataFrame:
    """Lines that are running heads or folios: doc_id, page_no, line_idx and the best similarity with a neighbour page's slot.

    pages gives each page's position (page_idx) in its book.  Neighbours meet in an
    equi-join on the position, exploded to both sides, not in a range join.
    """
    slots = edge_slots(lines).join(pages.select(*PAGE, "page_idx", F.col(book).alias("_book")), PAGE)
    slots = slots.withColumn("_shape", text.normalize_candidate(F.col("text")))
    count = pages.groupBy(F.col(book).alias("_book")).agg(F.count("*").alias("_pages")).filter("_pages >= 2")
    slots = slots.join(count, "_book", "left_semi")
    folio = text.is_folio(F.col("text"))
    footnote = text.is_footnote(F.col("text"))
    offsets = F.array(*(F.lit(d) for k in range(1, window + 1) for d in (-k, k)))
    mine = slots.filter(~folio & ~footnote).withColumn("_near", F.explode(F.transform(offsets, lambda d: F.col("page_idx") + d)))
    other = slots.select(F.col("_book").alias("b"), F.col("side").alias("s"), F.col("page_idx").alias("p"), F.col("_shape").alias("other"), F.col("h").alias("oh"))
    pair = mine.join(other, (F.col("_book") == F.col("b")) & (F.col("side") == F.col("s")) & (F.col("_near") == F.col("p")))
    same_size = F.greatest("h", "oh") <= 1.5 * F.greatest(F.least("h", "oh"), F.lit(1))
    pair = pair.filter(same_size & (F.abs(F.length("_shape") - F.length("other")) <= 4))
    scored = _scored(pair)
    heads = scored.filter(F.col("similarity") >= threshold)
    return heads.unionByName(slots.filter(folio).select(*PAGE, "line_idx", F.lit(1.0).alias("similarity"))).groupBy(*PAGE, "line_idx").agg(F.max("similarity").alias("similarity"))


def _scored(pair: DataFrame) -> DataFrame:
    # Equal shapes need no matcher; the others' distinct pairs go through it once.
    rest = pair.filter("_shape != other")
    distinct = rest.select("_shape", "other").distinct().withColumn("similarity", text.similarity(F.col("_shape"), F.col("other")))
    both = rest.join(distinct, ["_shape", "other"]).select(*PAGE, "line_idx", "similarity").unionByName(pair.filter("_shape = other").select(*PAGE, "line_idx", F.lit(1.0).alias("similarity")))
    return both.groupBy(*PAGE, "line_idx").agg(F.max("similarity").alias("similarity"))


def without_running_heads(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("region_type") != "running_head")


def join_candidates(lines: DataFrame, key: list[str]) -> DataFrame:
    """Neighbour lines whose first ends in a hyphen: its last word without it (a), the next line's first word (b), and the hyphen."""
    order = Window.partitionBy(*key).orderBy("line_idx")
    at = lines.withColumn("next_id", F.lead("line_id").over(order)).withColumn("next_text", F.lead("text").over(order))
    bare = F.rtrim(F.col("text"))
    last = F.regexp_extract(bare, rf"(\S+)[{HYPHENS}]$", 1)
    first = F.regexp_replace(F.regexp_extract(F.col("next_text"), r"^\s*(\S+)", 1), r"(?U)\W+$", "")
    at = at.withColumn("a", last).withColumn("b", first).withColumn("hyphen", F.right(bare, F.lit(1)))
    return at.filter(F.col("next_text").isNotNull() & bare.rlike(rf"\S[{HYPHENS}]$") & (F.length("a") >= 1) & (F.col("b") != ""))


def dehyphenate(candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Verdict for each candidate: the hyphen goes unless only the hyphenated word is in the lexicon (forms, a column form)."""
    forms = lexicon.select(text.monotonize(F.lower("form")).alias("f")).distinct()
    key = lambda c: text.monotonize(text.lexicon_key(c))
    c = candidates.withColumn("_ab", key(F.concat("a", "b"))).withColumn("_a_b", key(F.concat("a", F.lit("-"), "b")))
    c = c.join(forms.select(F.col("f").alias("_f1")), F.col("_ab") == F.col("_f1"), "left").join(forms.select(F.col("f").alias("_f2")), F.col("_a_b") == F.col("_f2"), "left")
    joined, hyphenated = F.col("_f1").isNotNull(), F.col("_f2").isNotNull()
    verdict = F.when(joined & ~hyphenated, "joined_in_lexicon").when(hyphenated, "hyphen_in_lexicon").otherwise("unverified")
    keep = hyphenated
    return c.withColumn("verdict", verdict).withColumn("separator", F.when(keep, "-").otherwise("")).withColumn("removed", F.when(keep, "").otherwise(F.col("hyphen"))).drop("_ab", "_a_b", "_f1", "_f2")


def fold_paragraph(lines: Column) -> Column:
    """Text of a paragraph from its ordered lines (text, joined: null, "drop" or "keep", how it joins the next line)."""
    start = F.struct(F.lit("").alias("t"), F.lit("first").alias("how"))

    def step(a, x):
        glued = F.when(a["how"] == "first", x["text"]).when(a["how"] == "drop", F.concat(F.substring(F.rtrim(a["t"]), F.lit(1), F.length(F.rtrim(a["t"])) - 1), F.ltrim(x["text"])))
        glued = glued.when(a["how"] == "keep", F.concat(F.rtrim(a["t"]), F.ltrim(x["text"]))).otherwise(F.concat(F.rtrim(a["t"]), F.lit(" "), F.ltrim(x["text"])))
        return F.struct(glued.alias("t"), F.coalesce(x["joined"], F.lit("wrap")).alias("how"))

    return F.aggregate(lines, start, step, lambda a: a["t"])


def unfold_paragraph(whole: Column, lines: Column) -> Column:
    """The line texts again, from the paragraph's text and each line's length, joined and removed hyphen; outer blanks are lost."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        own = F.when(x["joined"] == "drop", x["size"] - 1).otherwise(x["size"])
        piece = F.concat(F.substring(whole, a["at"], own), F.when(x["joined"] == "drop", x["removed"]).otherwise(""))
        return F.struct((a["at"] + own + F.when(x["joined"].isNull(), 1).otherwise(0)).alias("at"), F.array_append(a["out"], piece).alias("out"))

    return F.aggregate(lines, start, step, lambda a: a["out"])
