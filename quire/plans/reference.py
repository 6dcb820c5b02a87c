"""Queries of the operators over the derived tables, with their SQL. Names start with the operator's number in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import boxes, text
from quire.operators import evaluate, lines, order, reconcile, review, structure, suggest
from quire.plans import testbed as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PAGE = ["doc_id", "page_no"]
LINE = [*PAGE, "line_idx"]


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query, and its SQL over the given views."""
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = ("WITH " + ",\n".join(views) + "\n" if views else "") + sql
        return run

    return add


#: Letters beyond ASCII in the tables; DuckDB's edit distance counts bytes, so its SQL maps each to one byte.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_NARROW = "(" + " || ".join(f"chr({1 + k + (k >= 8) * 6})" for k in range(len(_WIDE))) + ")"


def _one(x: str) -> str:
    return f"translate({x}, '{_WIDE}', {_NARROW})"


def _sql_cer(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 THEN CASE WHEN length({b}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE levenshtein({_one(a)}, {_one(b)})::DOUBLE / length({a}) END"


# Projections and filters


@query("prj_01_page_scoped_id", "SELECT line_id, 'p' || page_no || '-' || line_idx AS scoped_id FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", F.concat(F.lit("p"), "page_no", F.lit("-"), "line_idx").alias("scoped_id"))


@query("prj_02_box_edges", "SELECT line_id, x + w AS box_right, y + h AS box_bottom, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AS valid FROM ln", t.LINES)
def _(spark, d):
    b = [F.col(c) for c in "xywh"]
    return t.lines(spark, d).select("line_id", (b[0] + b[2]).alias("box_right"), (b[1] + b[3]).alias("box_bottom"), boxes.is_valid(*b).alias("valid"))


@query("prj_03_confidence_domain", "SELECT line_id, conf - 1 BETWEEN 0 AND 100 AS valid FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", (F.col("conf") - 1).between(0, 100).alias("valid"))


@query("flt_01_primary_variants", "SELECT doc_id, line_idx, cand_ord FROM cd WHERE variant = ''", t.CANDIDATES)
def _(spark, d):
    return reconcile.primary_only(t.candidates(spark, d), LINE).select("doc_id", "line_idx", "cand_ord")


@query("flt_02_low_confidence", "SELECT line_id, conf FROM ln WHERE conf < 50", t.LINES)
def _(spark, d):
    return t.lines(spark, d).filter("conf < 50").select("line_id", "conf")


@query("flt_03_eligible_samples", "SELECT line_id, corrected_at, trim(corrected_text) AS text FROM co WHERE accepted AND trim(corrected_text) <> '' AND h >= 8 AND script IN ('en', 'de')", t.LINES, t.CORRECTIONS)
def _(spark, d):
    return review.eligible_samples(t.corrections(spark, d), 8, ["en", "de"]).select("line_id", "corrected_at", "text")


@query("flt_04_edge_candidates", "SELECT line_id, row_number() OVER (PARTITION BY doc_id ORDER BY y, line_idx) AS place FROM ln WHERE trim(text) <> '' AND h <= 2 * w", t.LINES)
def _(spark, d):
    kept = t.lines(spark, d).filter((F.btrim("text") != "") & (F.col("h") <= 2 * F.col("w")))
    return kept.select("line_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "line_idx")).cast("long").alias("place"))


_HEADED = "hd AS (SELECT * REPLACE (CASE WHEN line_idx = 0 AND doc_id % 3 = 0 THEN 'running_head' ELSE region_type END AS region_type) FROM ln)"


def _headed(spark, d):
    return t.lines(spark, d).withColumn("region_type", F.when((F.col("line_idx") == 0) & (F.col("doc_id") % 3 == 0), "running_head").otherwise(F.col("region_type")))


@query("flt_05_without_running_heads", "SELECT line_id, text FROM hd WHERE region_type <> 'running_head'", t.LINES, _HEADED)
def _(spark, d):
    return structure.without_running_heads(_headed(spark, d)).select("line_id", "text")


_FINAL = "fi AS (SELECT ln.*, coalesce(a.text, e.text, ln.text) AS final_text, a.text IS NOT NULL OR e.text IS NOT NULL AS touched FROM ln LEFT JOIN (FROM ov WHERE store = 'accepted') a USING (line_id) LEFT JOIN (FROM ov WHERE store = 'edited') e USING (line_id))"


@query("flt_06_search", "SELECT page_no, line_idx, CASE WHEN length(final_text) > 60 THEN substr(final_text, 1, 60) || '…' ELSE final_text END AS snippet FROM fi WHERE contains(lower(final_text), 'th') ORDER BY page_no, line_idx LIMIT 15", t.LINES, t.OVERRIDES, _FINAL)
def _(spark, d):
    return review.search(review.final_text(t.lines(spark, d), t.overrides(spark, d)), "TH")


_GREEK = ("abgdezhqiklmnxoprstufcyw", "αβγδεζηθικλμνξοπρστυφχψω")


@query("flt_07_greek_forms", f"SELECT line_idx, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(translate(token, '{_GREEK[0]}', '{_GREEK[1]}'), '[Ͱ-Ͽἀ-῿ͅ]+')) AS greek FROM (SELECT line_idx, unnest(regexp_extract_all(text, '\\S+')) AS token FROM ln) GROUP BY line_idx", t.LINES)
def _(spark, d):
    words = t.lines(spark, d).select("line_idx", F.explode(text.tokens(F.col("text"))).alias("token"))
    return words.groupBy("line_idx").agg(F.count("*").alias("n"), F.count_if(text.is_greek_form(F.translate("token", *_GREEK))).alias("greek"))


# Joins


_ASSIGNED = """
pr AS (
  SELECT b.*, s.seg_idx, s.seg_id, s.script, s.region_type, s.reading_order,
         (least(b.x + b.w, s.x + s.w) - greatest(b.x, s.x)) * (least(b.y + b.h, s.y + s.h) - greatest(b.y, s.y)) AS area
  FROM bl b JOIN sg s ON b.doc_id = s.doc_id AND b.x < s.x + s.w AND s.x < b.x + b.w AND b.y < s.y + s.h AND s.y < b.y + b.h),
asg AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY area DESC, seg_idx) = 1)"""


def _assigned(spark, d):
    return lines.assign_blocks(t.segments(spark, d), t.blocks(spark, d))


@query("join_01_assign_blocks", "SELECT doc_id, block_idx, seg_idx, area FROM asg", t.BLOCKS, t.SEGMENTS, _ASSIGNED)
def _(spark, d):
    return _assigned(spark, d).select("doc_id", "block_idx", "seg_idx", "area")


@query("join_02_boxes_overlap", "SELECT a.line_id, b.line_idx AS other, a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h AS overlap FROM ln a JOIN ln b ON a.doc_id = b.doc_id AND b.line_idx = a.line_idx + 1", t.LINES)
def _(spark, d):
    a = t.lines(spark, d)
    pair = a.alias("a").join(a.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.line_idx") == F.col("a.line_idx") + 1))
    return pair.select("a.line_id", F.col("b.line_idx").alias("other"), boxes.overlaps("a", "b").alias("overlap"))


_MODEL = "mb AS (SELECT doc_id, page_no, line_idx AS block_idx, x, y + CASE WHEN line_idx % 4 = 0 THEN 5000 ELSE 4 END AS y, w, h FROM ln)"


@query(
    "join_03_grounding",
    """SELECT m.doc_id, m.block_idx, coalesce(max(i.iou), 0.0) AS iou, coalesce(max(i.iou), 0.0) > 0.5 AS grounded FROM mb m LEFT JOIN (
    SELECT doc_id, block_idx, common::DOUBLE / (area + other - common) AS iou FROM (
      SELECT m.doc_id, m.block_idx, (least(m.x + m.w, r.x + r.w) - greatest(m.x, r.x)) * (least(m.y + m.h, r.y + r.h) - greatest(m.y, r.y)) AS common, m.w * m.h AS area, r.w * r.h AS other
      FROM mb m JOIN ln r ON m.doc_id = r.doc_id AND m.x < r.x + r.w AND r.x < m.x + m.w AND m.y < r.y + r.h AND r.y < m.y + m.h)) i ON m.doc_id = i.doc_id AND m.block_idx = i.block_idx
    GROUP BY m.doc_id, m.block_idx""",
    t.LINES, _MODEL,
)
def _(spark, d):
    base = t.lines(spark, d)
    model = base.select(*PAGE, F.col("line_idx").alias("block_idx"), "x", (F.col("y") + F.when(F.col("line_idx") % 4 == 0, 5000).otherwise(4)).alias("y"), "w", "h")
    return lines.grounded(model, base.select(*PAGE, "x", "y", "w", "h"), 0.5).select("doc_id", "block_idx", "iou", "grounded")


#: Both sides drop the same marks from the tables' letters; ê, ç and ñ keep theirs, as only six marks go.
_KEY = "translate(lower(trim({}, '.,;:!?()[]{{}}-\"''·«»‘’“”–—…')), 'éèáíóú', 'eeaiou')"
_TOKENS = r"tk AS (SELECT line_id, script, pos, token FROM (SELECT line_id, script, unnest(regexp_extract_all(text, '\S+')) AS token, unnest(range(len(regexp_extract_all(text, '\S+')))) AS pos FROM ln) WHERE script IN ('en', 'de'))"
_KNOWN = f"lk AS (SELECT lexicon, {_KEY.format('form')} AS key, min(layer) AS layer FROM lx GROUP BY ALL)"


def _words(spark, d):
    return suggest.token_spans(t.lines(spark, d).filter("script in ('en', 'de')")).withColumn("lexicon", F.col("script"))


@query("join_05_lexicon_members", f"SELECT tk.line_id, tk.pos::BIGINT AS pos FROM tk SEMI JOIN lk ON lk.key = {_KEY.format('tk.token')} AND lk.lexicon = tk.script", t.LINES, _TOKENS, t.LEXICON, _KNOWN)
def _(spark, d):
    return suggest.known_tokens(_words(spark, d), t.lexicon(spark, d)).filter("layer is not null").select("line_id", F.col("pos").cast("long").alias("pos"))


@query("join_06_lexicon_layers", f"SELECT tk.script, lk.layer::BIGINT AS layer, count(*) AS n FROM tk LEFT JOIN lk ON lk.key = {_KEY.format('tk.token')} AND lk.lexicon = tk.script GROUP BY ALL", t.LINES, _TOKENS, t.LEXICON, _KNOWN)
def _(spark, d):
    return suggest.known_tokens(_words(spark, d), t.lexicon(spark, d)).groupBy("script", F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("n"))


@query("join_07_suggestions_on_lines", "SELECT ln.line_id, count(su.ord) AS n_suggestions, string_agg(reason, ',' ORDER BY ord) AS reasons FROM ln LEFT JOIN su USING (line_id) GROUP BY ln.line_id", t.LINES, t.SUGGESTIONS)
def _(spark, d):
    out = review.with_suggestions(t.lines(spark, d), t.suggestions(spark, d))
    return out.select("line_id", F.col("n_suggestions").cast("long").alias("n_suggestions"), F.array_join(F.transform("suggestions", lambda s: s["reason"]), ",").alias("reasons"))


@query("join_08_running_heads")
def _(spark, d):
    base = t.lines(spark, d)
    head = base.filter("line_idx = 0").withColumn("text", F.concat("source", F.lit(" "), "doc_id")).withColumn("line_idx", F.lit(-2).cast("long"))
    folio = base.filter("line_idx = 0").withColumn("text", F.concat(F.lit("— "), F.col("doc_id") % 1000, F.lit(" —"))).withColumn("line_idx", F.lit(-1).cast("long"))
    whole = base.unionByName(head.withColumn("y", F.col("y") - 60)).unionByName(folio.withColumn("y", F.col("y") - 30))
    pages = order.numbered(base.select("doc_id", "page_no", "source").distinct(), F.col("source"), "doc_id", "page_idx")
    return structure.running_heads(whole.drop("source"), pages, "source").select("doc_id", "line_idx", "similarity")


@query("join_09_training_samples", "SELECT line_id, corrected_at, 'line-' || line_id || '.png' AS name, 'image ' || page_no AS image FROM co WHERE accepted AND trim(corrected_text) <> '' AND h >= 8", t.LINES, t.CORRECTIONS)
def _(spark, d):
    images = t.documents(spark, d).select(F.col("doc_id").alias("page_no"), F.concat(F.lit("image "), "doc_id").alias("image"))
    return review.with_images(review.eligible_samples(t.corrections(spark, d)), images).select("line_id", "corrected_at", "name", "image")


_PAIRS = "pa AS (SELECT script, text AS reference, translate(text, 'eio', 'oei') AS hypothesis, doc_id, line_idx FROM ln)"


def _pairs(spark, d):
    # Comparing is what takes the time, and it goes by the square of a line, so documents are dealt out first.
    return t.lines(spark, d).repartition("doc_id").select("script", F.col("text").alias("reference"), F.translate("text", "eio", "oei").alias("hypothesis"), "doc_id", "line_idx")


@query(
    "join_10_regressions",
    f"""SELECT r.script, n, b.base, coalesce(cer > b.base, false) AS regressed FROM (SELECT script, count(*) AS n, avg({_sql_cer('reference', 'hypothesis')}) AS cer FROM pa GROUP BY script) r
    LEFT JOIN (VALUES ('en', 0.05::DOUBLE), ('de', 0.9::DOUBLE)) b(script, base) ON r.script = b.script""",
    t.LINES, _PAIRS,
)
def _(spark, d):
    base = spark.createDataFrame([("en", 0.05, 9.0), ("de", 0.9, 9.0)], "script string, cer double, wer double")
    return evaluate.regressions(evaluate.evaluate(_pairs(spark, d)), base).select("script", F.col("samples").alias("n"), F.col("base_cer").alias("base"), "regressed")


def _chosen(spark, d):
    c = t.candidates(spark, d)
    return c.withColumn("is_chosen", F.col("cand_ord") == 1)


@query("join_11_align_readings")
def _(spark, d):
    return reconcile.align(_chosen(spark, d), LINE)


@query("join_12_final_text", "SELECT line_id, final_text, touched FROM fi", t.LINES, t.OVERRIDES, _FINAL)
def _(spark, d):
    return review.final_text(t.lines(spark, d), t.overrides(spark, d)).select("line_id", "final_text", "touched")


@query("join_13_reviewed_lines", "SELECT line_id, text AS original_text, final_text AS corrected_text FROM fi WHERE touched", t.LINES, t.OVERRIDES, _FINAL)
def _(spark, d):
    out = review.final_text(t.lines(spark, d), t.overrides(spark, d)).filter("touched")
    return out.select("line_id", F.col("text").alias("original_text"), F.col("final_text").alias("corrected_text"))


@query("join_14_against_parent", "SELECT c.script, c.n, coalesce(p.n, 0) AS parent, c.n > coalesce(p.n, 0) AS worse FROM (SELECT script, count(*) AS n FROM ln GROUP BY script) c LEFT JOIN (SELECT script, count(*) AS n FROM ln WHERE script <> 'fr' GROUP BY script) p USING (script)", t.LINES)
def _(spark, d):
    own = t.lines(spark, d).groupBy("script").agg(F.count("*").alias("n"))
    parent = own.filter("script <> 'fr'").select("script", F.col("n").alias("p"))
    both = own.join(parent, "script", "left").withColumn("parent", F.coalesce("p", F.lit(0)))
    return both.select("script", "n", "parent", (F.col("n") > F.col("parent")).alias("worse"))


def _hyphenated(spark, d):
    """Lines of which every fourth that has more than 20 letters is broken: its end goes to the next line."""
    base = t.lines(spark, d)
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    cut_ = (F.col("doc_id") + F.col("line_idx")) % 4 == 0
    split_at = F.col("text").rlike(r"[a-z]{4}$") & cut_ & F.lead("line_idx").over(order).isNotNull()
    base = base.withColumn("_cut", split_at).withColumn("_tail", F.when(F.col("_cut"), F.right("text", F.lit(2))).otherwise(""))
    head = F.when(F.col("_cut"), F.concat(F.substring("text", F.lit(1), F.length("text") - 2), F.lit("-"))).otherwise(F.col("text"))
    return base.select(*[c for c in base.columns if c not in ("text", "_cut", "_tail")], F.concat(F.coalesce(F.lag("_tail").over(order), F.lit("")), head).alias("text"))


_HYPHEN = r"""
c0 AS (SELECT *, regexp_matches(text, '[a-z]{4}$') AND (doc_id + line_idx) % 4 = 0 AND lead(line_idx) OVER (PARTITION BY doc_id ORDER BY line_idx) IS NOT NULL AS c FROM ln),
hy AS (SELECT * REPLACE (coalesce(lag(CASE WHEN c THEN right(text, 2) ELSE '' END) OVER (PARTITION BY doc_id ORDER BY line_idx), '') || CASE WHEN c THEN substr(text, 1, length(text) - 2) || '-' ELSE text END AS text) FROM c0)"""
_FOLD = r"""
hj AS (SELECT *, CASE WHEN regexp_matches(rtrim(text), '\S-$') AND next_text IS NOT NULL AND trim(next_text) <> '' THEN 'drop' END AS joined
       FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_idx) AS next_text FROM hy)),
gp AS (SELECT doc_id, line_idx, sum(CASE WHEN line_idx % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS para, rtrim(ltrim(text)) AS text, joined FROM hj),
ge AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para ORDER BY line_idx DESC) = 1 AS last FROM gp)"""


def _folded(spark, d):
    h = _hyphenated(spark, d)
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    nxt = F.lead("text").over(order)
    joined = F.when(F.rtrim(F.col("text")).rlike(r"\S-$") & nxt.isNotNull() & (F.trim(nxt) != ""), "drop")
    h = h.withColumn("joined", joined).withColumn("para", F.sum(F.when(F.col("line_idx") % 5 == 0, 1).otherwise(0)).over(order))
    item = F.struct("line_idx", F.trim("text").alias("text"), "joined", F.length(F.trim("text")).alias("size"), F.lit("-").alias("removed"))
    return h.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(item)).alias("lines"))


@query("join_15_unjoin", "SELECT doc_id, para::BIGINT AS para, string_agg(text, '|' ORDER BY line_idx) AS lines FROM ge GROUP BY doc_id, para", t.LINES, _HYPHEN, _FOLD)
def _(spark, d):
    p = _folded(spark, d)
    # A join across the paragraph's end isn't one of the paragraph's.
    inner = F.transform("lines", lambda x, i: F.struct(x["text"].alias("text"), F.when(i < F.size("lines") - 1, x["joined"]).alias("joined"), x["size"].alias("size"), x["removed"].alias("removed")))
    p = p.withColumn("lines", inner).withColumn("whole", structure.fold_paragraph(F.col("lines")))
    return p.select("doc_id", F.col("para").cast("long").alias("para"), F.array_join(structure.unfold_paragraph(F.col("whole"), F.col("lines")), "|").alias("lines"))


@query(
    "win_06_paragraph_text",
    "SELECT doc_id, para::BIGINT AS para, string_agg(CASE WHEN joined = 'drop' AND NOT last THEN left(text, length(text) - 1) WHEN last THEN text ELSE text || ' ' END, '' ORDER BY line_idx) AS whole FROM ge GROUP BY doc_id, para",
    t.LINES, _HYPHEN, _FOLD,
)
def _(spark, d):
    return _folded(spark, d).select("doc_id", F.col("para").cast("long").alias("para"), structure.fold_paragraph(F.col("lines")).alias("whole"))


# Aggregations


@query(
    "agg_01_compose_lines",
    """SELECT doc_id, seg_id || '-' || engine AS cand_id, coalesce(string_agg(text, ' ' ORDER BY block_idx) FILTER (WHERE text <> ''), '') AS text, avg(conf) AS conf,
    min(x) AS x, min(y) AS y, greatest(1, max(x + w) - min(x)) AS w, greatest(1, max(y + h) - min(y)) AS h FROM asg GROUP BY doc_id, seg_id, engine""",
    t.BLOCKS, t.SEGMENTS, _ASSIGNED,
)
def _(spark, d):
    return lines.read_pages(t.recorded_pages(spark, d), t.in_parts).select("doc_id", "cand_id", "text", "conf", "x", "y", "w", "h")


@query("agg_02_union_box", "SELECT doc_id, min(x) AS x, min(y) AS y, greatest(1, max(x + w) - min(x)) AS w, greatest(1, max(y + h) - min(y)) AS h FROM ln GROUP BY doc_id", t.LINES)
def _(spark, d):
    return t.lines(spark, d).groupBy("doc_id").agg(*boxes.union_of())


@query(
    "agg_03_agreement",
    r"""SELECT doc_id, line_idx, CASE WHEN sum(n) = 1 THEN 'single' WHEN count(*) = 1 THEN 'unanimous' WHEN max(n) >= 2 THEN 'majority' ELSE 'split' END AS agreement FROM (
    SELECT doc_id, line_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, count(*) AS n FROM cd GROUP BY ALL) GROUP BY doc_id, line_idx""",
    t.CANDIDATES,
)
def _(spark, d):
    return lines.agreement(t.candidates(spark, d), LINE).select("doc_id", "line_idx", "agreement")


_READINGS = r"rd AS (SELECT doc_id, line_idx, cand_ord, model_name || variant AS voter, unnest(regexp_extract_all(text, '\S+')) AS text, unnest(range(len(regexp_extract_all(text, '\S+')))) AS pos FROM cd)"


@query(
    "agg_04_weighted_vote",
    """SELECT doc_id, line_idx, pos::BIGINT AS pos, text, score FROM (SELECT doc_id, line_idx, pos, text, sum(CASE WHEN cand_ord = 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS score, max((cand_ord = 0)::INT) AS piv FROM rd GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY doc_id, line_idx, pos ORDER BY score DESC, piv DESC, text) = 1""",
    t.CANDIDATES, _READINGS,
)
def _(spark, d):
    c = t.candidates(spark, d).select("doc_id", "line_idx", "cand_ord", F.concat("model_name", "variant").alias("voter"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("pos", "text"))
    c = c.withColumn("ord", F.col("cand_ord")).withColumn("weight", F.when(F.col("cand_ord") == 1, 1.5).otherwise(1.0)).withColumn("is_pivot", F.col("cand_ord") == 0)
    return reconcile.vote(c, ["doc_id", "line_idx"]).select("doc_id", "line_idx", F.col("pos").cast("long").alias("pos"), "text", "score")


@query("agg_05_evaluate", f"SELECT script, count(*) AS samples, round(avg({_sql_cer('reference', 'hypothesis')}), 9) AS cer FROM pa GROUP BY script", t.LINES, _PAIRS)
def _(spark, d):
    return evaluate.evaluate(_pairs(spark, d)).select("script", "samples", F.round("cer", 9).alias("cer"))


@query("agg_06_by_reason", "SELECT reason, count(*) AS n, (count(*) * 100 // sum(count(*)) OVER ())::BIGINT AS percent FROM su GROUP BY reason", t.LINES, t.SUGGESTIONS)
def _(spark, d):
    return review.by_reason(t.suggestions(spark, d)).select("reason", "n", F.col("percent").cast("long").alias("percent"))


def _sql_edge(value: str, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, trunc(mid)::BIGINT AS edge FROM (SELECT doc_id, v // 5 AS b, count(*) AS n, min(line_idx) AS f, quantile_cont(v, 0.5) AS mid FROM (SELECT doc_id, line_idx, {value} AS v FROM ln) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)"""


_GEOMETRY = (
    _sql_edge("x", "le")
    + ",\n"
    + _sql_edge("x + w", "re")
    + """,
gm AS (SELECT doc_id, le.edge AS left_edge, re.edge AS right_edge, median_leading, median_line_height FROM (
  SELECT doc_id, coalesce(quantile_cont(gap, 0.5), 0.0)::DOUBLE AS median_leading, quantile_cont(h, 0.5)::DOUBLE AS median_line_height
  FROM (SELECT *, y - lag(y + h) OVER (PARTITION BY doc_id ORDER BY line_idx) AS gap FROM ln) GROUP BY doc_id) JOIN le USING (doc_id) JOIN re USING (doc_id))"""
)


@query("agg_07_column_edges", "SELECT doc_id, left_edge, right_edge FROM gm", t.LINES, _GEOMETRY)
def _(spark, d):
    return structure.page_geometry(t.lines(spark, d)).select("doc_id", F.col("left_edge").cast("long").alias("left_edge"), F.col("right_edge").cast("long").alias("right_edge"))


@query("agg_08_medians", "SELECT doc_id, median_leading, median_line_height FROM gm", t.LINES, _GEOMETRY)
def _(spark, d):
    return structure.page_geometry(t.lines(spark, d)).select("doc_id", "median_leading", "median_line_height")


@query(
    "agg_09_multi_column",
    """SELECT doc_id, any_value(total) >= 4 AND count(*) = 2 AND min(n) >= 0.2::DOUBLE * any_value(total) AND (max(b) - min(b)) * 5 > 0.25::DOUBLE * 60 AS multi_column FROM (
    SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM (SELECT doc_id, x // 5 AS b, count(*) AS n, min(line_idx) AS f FROM ln GROUP BY ALL)) WHERE r <= 2 GROUP BY doc_id""",
    t.LINES,
)
def _(spark, d):
    base = t.lines(spark, d)
    return structure.multi_column(base, base.select(*PAGE).distinct().withColumn("width", F.lit(60))).select("doc_id", "multi_column")


@query("agg_10_coverage", "SELECT doc_id, sum(w * h)::DOUBLE / (2000 * 3000) AS coverage FROM ln GROUP BY doc_id", t.LINES)
def _(spark, d):
    return t.lines(spark, d).groupBy("doc_id").agg((F.sum(F.col("w") * F.col("h")).cast("double") / (2000 * 3000)).alias("coverage"))


_MODELS = "md AS (SELECT CASE cand_ord WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model, text, conf FROM cd WHERE cand_ord < 3 AND script IN ('en', 'de'))"
_SCORES = rf"""
mt AS (SELECT model, {_KEY.format("token")} AS key FROM (SELECT model, unnest(regexp_extract_all(text, '\S+')) AS token FROM md)),
sc AS (SELECT m.model, round(0.5 * m.c / 100 + 0.4 * h.hit + 0.1, 6) AS score FROM (SELECT model, avg(conf) AS c FROM md GROUP BY model) m
  JOIN (SELECT model, avg((lk.key IS NOT NULL)::INT)::DOUBLE AS hit FROM mt LEFT JOIN (SELECT DISTINCT key FROM lk) lk ON mt.key = lk.key WHERE mt.key <> '' GROUP BY model) h USING (model))"""


def _scores(spark, d):
    model = F.when(F.col("cand_ord") == 0, "a").when(F.col("cand_ord") == 1, "b").otherwise("c")
    c = t.candidates(spark, d).filter("cand_ord < 3 and script in ('en', 'de')").withColumn("model", model)
    return evaluate.candidate_scores(c, t.lexicon(spark, d)).select("model", F.round("score", 6).alias("score"))


@query("agg_11_candidate_scores", "SELECT model, score FROM sc", t.CANDIDATES, _MODELS, t.LEXICON, _KNOWN, _SCORES)
def _(spark, d):
    return _scores(spark, d)


@query("top_02_select_best", "SELECT model, row_number() OVER (ORDER BY score DESC, model = 'b' DESC, model) AS rank FROM sc", t.CANDIDATES, _MODELS, t.LEXICON, _KNOWN, _SCORES)
def _(spark, d):
    return evaluate.select_best(_scores(spark, d), "b").select("model", F.col("rank").cast("long").alias("rank"))


@query("agg_12_mean_error", f"SELECT round(coalesce(avg(cer), 0), 9) AS mean_cer FROM (SELECT script, avg({_sql_cer('reference', 'hypothesis')}) AS cer FROM pa GROUP BY script)", t.LINES, _PAIRS)
def _(spark, d):
    return evaluate.evaluate(_pairs(spark, d)).agg(F.round(F.coalesce(F.avg("cer"), F.lit(0.0)), 9).alias("mean_cer"))


_FAILED = "fp AS (SELECT doc_id % 50 AS doc_id, CASE WHEN doc_id % 9 = 0 THEN ['EmptyPage'] WHEN doc_id % 13 = 0 OR doc_id % 50 = 7 THEN ['EngineError', 'Timeout'] ELSE [] END AS failures FROM documents)"


def _failed(spark, d):
    i = F.col("doc_id")
    failures = F.when(i % 9 == 0, F.array(F.lit("EmptyPage"))).when((i % 13 == 0) | (i % 50 == 7), F.array(F.lit("EngineError"), F.lit("Timeout"))).otherwise(F.array().cast("array<string>"))
    return t.documents(spark, d).select((i % 50).alias("doc_id"), failures.alias("failures"))


@query(
    "agg_13_run_summary",
    """SELECT doc_id, n_pages, n_failures, empty_pages, n_failures = 0 AND empty_pages < n_pages AS ok FROM (SELECT doc_id, count(*) AS n_pages, sum(len(list_filter(failures, lambda f: f <> 'EmptyPage')))::BIGINT AS n_failures,
    count(*) FILTER (WHERE list_contains(failures, 'EmptyPage')) AS empty_pages FROM fp GROUP BY doc_id)""",
    _FAILED,
)
def _(spark, d):
    return review.job_outcome(_failed(spark, d)).drop("failed")


@query("agg_15_job_outcome", "SELECT doc_id, bool_and(len(failures) > 0) AS failed FROM fp GROUP BY doc_id", _FAILED)
def _(spark, d):
    return review.job_outcome(_failed(spark, d)).select("doc_id", "failed")


_SUMMARY = "sm AS (SELECT doc_id, page_no, count(*) AS n_lines, count(*) FILTER (WHERE conf < 50) AS low_lines, avg(conf) AS mean_conf, coalesce(any_value(n), 0) AS n_suggestions FROM ln LEFT JOIN (SELECT doc_id, count(*) AS n FROM su JOIN ln USING (line_id) GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, page_no)"


@query("agg_16_dashboard", "SELECT doc_id, n_lines, low_lines, mean_conf, n_suggestions FROM sm", t.LINES, t.SUGGESTIONS, _SUMMARY)
def _(spark, d):
    return review.page_summary(t.lines(spark, d), t.suggestions(spark, d)).drop("page_no")


@query("top_03_worst_pages", "SELECT doc_id, mean_conf FROM sm ORDER BY mean_conf, page_no LIMIT 10", t.LINES, t.SUGGESTIONS, _SUMMARY)
def _(spark, d):
    return review.worst_pages(review.page_summary(t.lines(spark, d), t.suggestions(spark, d))).select("doc_id", "mean_conf")


@query("agg_17_distinct_forms", "SELECT lexicon, count(DISTINCT form) AS n FROM lx GROUP BY lexicon", t.LEXICON)
def _(spark, d):
    return t.lexicon(spark, d).groupBy("lexicon").agg(F.countDistinct("form").alias("n"))


_SPLIT = "sp AS (SELECT doc_id, CASE WHEN v < 0.1::DOUBLE * 4294967296 THEN 'dev' WHEN v < 0.2::DOUBLE * 4294967296 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256('page-' || doc_id), 1, 8))::BIGINT AS v FROM documents))"


def _split(spark, d):
    return t.documents(spark, d).select("doc_id", text.assign_split(F.concat(F.lit("page-"), "doc_id")).alias("split"))


@query("agg_18_split_pages", "SELECT s.split, count(doc_id) AS n, min(doc_id) AS least FROM (VALUES ('train'), ('dev'), ('test')) s(split) LEFT JOIN sp USING (split) GROUP BY s.split", _SPLIT)
def _(spark, d):
    names = spark.createDataFrame([("train",), ("dev",), ("test",)], "split string")
    return names.join(_split(spark, d), "split", "left").groupBy("split").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least"))


@query("fn_24_assign_split", "SELECT doc_id, split FROM sp", _SPLIT)
def _(spark, d):
    return _split(spark, d)


# Windows


_BROKEN = """
bk AS (SELECT *, px IS NOT NULL AND wide > 0 AND x > left_edge + 0.02::DOUBLE * wide AND x > px + 0.01::DOUBLE * wide AS indent_break, px IS NOT NULL AND wide > 0 AND pr < right_edge - 0.15::DOUBLE * wide AS short_break,
  px IS NOT NULL AND median_leading > 0 AND y - pb > 1.5::DOUBLE * median_leading AS gap_break FROM (
  SELECT hd.*, gm.left_edge, gm.right_edge, median_leading, median_line_height, right_edge - left_edge AS wide, lag(x) OVER o AS px, lag(x + w) OVER o AS pr, lag(y + h) OVER o AS pb FROM hd JOIN gm USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY line_idx))),
pg AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS para_idx FROM (SELECT *, lag(line_idx) OVER o IS NULL OR region_type = 'running_head' OR coalesce(lag(region_type) OVER o = 'running_head', false) OR indent_break OR short_break OR gap_break AS brk FROM bk WINDOW o AS (PARTITION BY doc_id ORDER BY line_idx)))"""
_STRUCTURE = (t.LINES, _HEADED, _GEOMETRY, _BROKEN)


def _broken(spark, d):
    base = _headed(spark, d)
    return structure.with_breaks(base, structure.page_geometry(base))


@query("win_01_paragraphs", "SELECT line_id, 'page-' || page_no || '-para-' || para_idx AS para_id FROM pg", *_STRUCTURE)
def _(spark, d):
    return structure.paragraphs(_broken(spark, d)).select("line_id", "para_id")


for _number, _rule in (("02", "indent"), ("03", "short"), ("04", "gap")):

    def _break(spark, d, rule=_rule):
        return _broken(spark, d).select("line_id", f"{rule}_break")

    query(f"win_{_number}_{_rule}_break", f"SELECT line_id, {_rule}_break FROM bk", *_STRUCTURE)(_break)


@query(
    "fn_19_roles",
    """SELECT doc_id, para_idx::BIGINT AS para_idx, CASE WHEN region_type = 'running_head' THEN CASE WHEN regexp_full_match(trim(text), '[0-9]+|[ivxlcdmIVXLCDM]+') THEN 'page_number' ELSE 'running_head' END
    WHEN h >= 1.3::DOUBLE * median_line_height AND w < 0.7::DOUBLE * wide AND wide > 0 AND w <= 0.85::DOUBLE * wide AND abs((x - left_edge) - (right_edge - (x + w))) <= 15 THEN 'heading' ELSE 'body' END AS role
    FROM pg QUALIFY row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY line_idx) = 1""",
    *_STRUCTURE,
)
def _(spark, d):
    p = structure.paragraphs(_broken(spark, d))
    first = reconcile.first_by(p, ["doc_id", "para_idx"], [F.col("line_idx")])
    c = {k: F.col(k) for k in ("text", "h", "x", "w", "left_edge", "right_edge", "median_line_height")}
    kind = structure.role(c["text"], F.col("region_type") == "running_head", c["h"], c["x"], c["w"], c["left_edge"], c["right_edge"], c["median_line_height"])
    return first.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), kind.alias("role"))


@query("fn_18_centred", "SELECT line_id, right_edge > left_edge AND w <= 0.85::DOUBLE * (right_edge - left_edge) AND abs((x - left_edge) - (right_edge - (x + w))) <= 15 AS centred FROM ln JOIN gm USING (doc_id)", t.LINES, _GEOMETRY)
def _(spark, d):
    base = t.lines(spark, d)
    at = base.join(structure.page_geometry(base), PAGE)
    return at.select("line_id", structure.is_centred(F.col("x"), F.col("w"), F.col("left_edge"), F.col("right_edge")).alias("centred"))


@query(
    "win_05_dehyphenate",
    rf"""SELECT line_id, CASE WHEN j AND NOT k THEN 'joined_in_lexicon' WHEN k THEN 'hyphen_in_lexicon' ELSE 'unverified' END AS verdict FROM (
    SELECT line_id, {_KEY.format("a || b")} IN (SELECT key FROM lk) AS j, {_KEY.format("a || '-' || b")} IN (SELECT key FROM lk) AS k FROM (
      SELECT line_id, regexp_extract(rtrim(text), '(\S+)-$', 1) AS a, regexp_replace(regexp_extract(nt, '^\s*(\S+)', 1), '[^\pL\pN_]+$', '') AS b
      FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_idx) AS nt FROM hy) WHERE nt IS NOT NULL AND regexp_matches(rtrim(text), '\S-$')) WHERE a <> '' AND b <> '')""",
    t.LINES, _HYPHEN, t.LEXICON, _KNOWN,
)
def _(spark, d):
    return structure.dehyphenate(structure.join_candidates(_hyphenated(spark, d), ["doc_id"]), t.lexicon(spark, d)).select("line_id", "verdict")


@query("fn_17_join_candidates", r"SELECT * FROM (SELECT line_id, regexp_extract(rtrim(text), '(\S+)-$', 1) AS a, regexp_replace(regexp_extract(nt, '^\s*(\S+)', 1), '[^\pL\pN_]+$', '') AS b, '-' AS hyphen FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_idx) AS nt FROM hy) WHERE nt IS NOT NULL AND regexp_matches(rtrim(text), '\S-$')) WHERE a <> '' AND b <> ''", t.LINES, _HYPHEN)
def _(spark, d):
    return structure.join_candidates(_hyphenated(spark, d), ["doc_id"]).select("line_id", "a", "b", "hyphen")


@query(
    "win_07_edge_slots",
    """SELECT line_id, side, slot FROM (SELECT line_id, 'top' AS side, row_number() OVER (PARTITION BY doc_id ORDER BY y, line_idx) - 1 AS slot FROM ln WHERE trim(text) <> '' AND h <= 2 * w
    UNION ALL SELECT line_id, 'bottom', row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, line_idx DESC) - 1 FROM ln WHERE trim(text) <> '' AND h <= 2 * w) WHERE slot < 2""",
    t.LINES,
)
def _(spark, d):
    return structure.edge_slots(t.lines(spark, d)).select("line_id", "side", F.col("slot").cast("long").alias("slot"))


@query("win_08_best_by_confidence", "SELECT doc_id, line_idx, cand_ord::BIGINT AS cand_ord, conf FROM cd QUALIFY row_number() OVER (PARTITION BY doc_id, line_idx ORDER BY conf DESC, cand_ord) = 1", t.CANDIDATES)
def _(spark, d):
    return reconcile.best_by_confidence(t.candidates(spark, d), LINE).select("doc_id", "line_idx", F.col("cand_ord").cast("long").alias("cand_ord"), "conf")


@query(
    "win_09_script_aware",
    r"""SELECT doc_id, line_idx, cand_ord::BIGINT AS cand_ord FROM (
      SELECT *, sum(eq::INT) OVER g AS k, count(*) OVER g AS n, max(lat::INT) OVER g AS any_lat, min(asc_) OVER g AS lo, max(asc_) OVER g AS hi FROM (
        SELECT *, lat AND cand_ord IN (0, 2, 3) AS eq FROM (SELECT *, length(regexp_replace(text, '[^CDFGJLQRSUVWbcdefghjlmqrswz]', '', 'g')) >= 3 AS lat, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS asc_ FROM cd))
      WINDOW g AS (PARTITION BY doc_id, line_idx))
    WHERE CASE WHEN k > 0 AND k < n THEN eq WHEN any_lat = 0 AND lo < 3 AND hi > lo THEN asc_ = lo ELSE true END
    QUALIFY row_number() OVER (PARTITION BY doc_id, line_idx ORDER BY conf DESC, cand_ord) = 1""",
    t.CANDIDATES,
)
def _(spark, d):
    return reconcile.script_aware(t.candidates(spark, d), LINE).select("doc_id", "line_idx", F.col("cand_ord").cast("long").alias("cand_ord"))


@query("win_10_first_candidate", "SELECT doc_id, line_idx, text FROM cd WHERE cand_ord = 0", t.CANDIDATES)
def _(spark, d):
    return reconcile.first_candidate(t.candidates(spark, d), LINE).select("doc_id", "line_idx", "text")


@query("win_11_merge_suggestions")
def _(spark, d):
    return reconcile.merge_suggestions(_chosen(spark, d), LINE)


@query("win_12_latest_revision", "SELECT line_id, corrected_text, corrected_at FROM co QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY corrected_at DESC) = 1", t.LINES, t.CORRECTIONS)
def _(spark, d):
    return review.latest_revision(t.corrections(spark, d)).select("line_id", "corrected_text", "corrected_at")


# Order and limits


@query("top_01_ranked_candidates", f"""SELECT token, candidate, rank FROM (SELECT token, candidate, row_number() OVER (PARTITION BY token ORDER BY layer, candidate) AS rank FROM (
    SELECT DISTINCT token, candidate FROM (SELECT token, substr(token, 1, p - 1) || 'a' || substr(token, p + 1) AS candidate FROM (SELECT token, unnest(range(1, length(token) + 1)) AS p FROM (SELECT DISTINCT token FROM tk WHERE script = 'en' AND length(token) <= 64)) WHERE substr(token, p, 1) = 'e')) c
    JOIN lk ON lk.lexicon = 'en' AND lk.key = {_KEY.format('c.candidate')}) WHERE rank <= 3""", t.LINES, _TOKENS, t.LEXICON, _KNOWN)
def _(spark, d):
    words = _words(spark, d).filter("script = 'en'").select("token").distinct()
    made = words.select("token", F.explode(suggest.confusion_candidates(F.col("token"), [("e", "a")])).alias("candidate"), F.lit("en").alias("lexicon"))
    return suggest.ranked(made, t.lexicon(spark, d)).select("token", "candidate", F.col("rank").cast("long").alias("rank"))


@query("top_04_first_pages", "SELECT doc_id, line_id FROM ln WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20)", t.LINES)
def _(spark, d):
    few = t.documents(spark, d).select("doc_id").orderBy("doc_id").limit(20)
    return t.lines(spark, d).join(few, "doc_id", "left_semi").select("doc_id", "line_id")


@query("top_05_page_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents")
def _(spark, d):
    return order.numbered(t.documents(spark, d).select("doc_id", "source"), F.col("source"), "doc_id", "place").select("doc_id", "place")


# Sets


@query("set_01_variant_union", "SELECT doc_id, line_idx, count(*) AS n FROM cd WHERE NOT (variant = 'otsu' AND doc_id % 5 = 0) GROUP BY doc_id, line_idx", t.CANDIDATES)
def _(spark, d):
    c = t.candidates(spark, d)
    fine = c.filter("variant = ''").unionByName(c.filter("variant != '' and doc_id % 5 != 0"))
    return fine.groupBy("doc_id", "line_idx").agg(F.count("*").alias("n"))


_SUBSTITUTED = "sb AS (SELECT DISTINCT token, substr(token, 1, p - 1) || b || substr(token, p + 1) AS candidate FROM (SELECT DISTINCT token, unnest(range(1, length(token) + 1)) AS p FROM tk WHERE length(token) <= 64), (VALUES ('o', 'v'), ('e', 'i')) s(a, b) WHERE substr(token, p, 1) = a)"


@query("set_02_substitutions", "SELECT token, string_agg(candidate, ' ' ORDER BY candidate) AS candidates FROM sb GROUP BY token", t.LINES, _TOKENS, _SUBSTITUTED)
def _(spark, d):
    words = _words(spark, d).select("token").distinct()
    made = words.select("token", suggest.confusion_candidates(F.col("token"), [("o", "v"), ("e", "i")]).alias("c"))
    return made.filter(F.size("c") > 0).select("token", F.array_join("c", " ").alias("candidates"))


@query("fn_13_confusion_candidates", "SELECT token, candidate FROM sb", t.LINES, _TOKENS, _SUBSTITUTED)
def _(spark, d):
    words = _words(spark, d).select("token").distinct()
    return words.select("token", F.explode(suggest.confusion_candidates(F.col("token"), [("o", "v"), ("e", "i")])).alias("candidate"))


@query("set_03_first_layer", "SELECT lexicon, form, min(layer)::BIGINT AS layer FROM lx GROUP BY lexicon, form", t.LEXICON)
def _(spark, d):
    return t.lexicon(spark, d).groupBy("lexicon", "form").agg(F.min("layer").cast("long").alias("layer"))


@query("set_05_missing_baselines", "SELECT lang FROM documents EXCEPT SELECT unnest(['en', 'de'])")
def _(spark, d):
    return t.documents(spark, d).select("lang").distinct().join(spark.createDataFrame([("en",), ("de",)], "lang string"), "lang", "left_anti")
