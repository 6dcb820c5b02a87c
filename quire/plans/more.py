"""Queries of the remaining operators: sources, sinks, scalar functions, review, promotion and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import boxes, text
from quire.operators import evaluate, lines, review, structure, suggest
from quire.plans import testbed as t
from quire.plans.reference import _FINAL, _KEY, _KNOWN, _PAIRS, _TOKENS, _one, _pairs, _sql_cer, _words, query
from quire.sources import parsers, replies, sinks
from quire.streaming import events

PAGE = ["doc_id", "page_no"]


# Sources


def _text_words(spark, d):
    b = t.blocks(spark, d)
    pt = lambda c, k: (c * k).cast("double") / 10
    return b.select(*PAGE, F.col("block_idx").alias("word_idx"), pt(F.col("x"), 1).alias("x0"), pt(F.col("y"), 1).alias("y0"), pt(F.col("x") + F.col("w"), 1).alias("x1"), pt(F.col("y") + F.col("h"), 1).alias("y1"), "text", F.lit(0).alias("block_no"), F.floor(F.col("block_idx") / 100000).alias("line_no"))


_TEXT_LAYER = """
tw AS (SELECT doc_id, page_no, block_idx AS word_idx, x::DOUBLE / 10 AS x0, y::DOUBLE / 10 AS y0, (x + w)::DOUBLE / 10 AS x1, (y + h)::DOUBLE / 10 AS y1, text, block_idx // 100000 AS line_no FROM bl WHERE trim(text) <> ''),
tl AS (SELECT doc_id, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(word_idx) AS f, string_agg(text, ' ' ORDER BY word_idx) AS text FROM tw GROUP BY doc_id, line_no),
tg AS (SELECT doc_id FROM (SELECT doc_id, sum((x1 - x0) * (y1 - y0)) AS a FROM tl GROUP BY doc_id) WHERE doc_id % 3 <> 0 AND a / (100.0::DOUBLE * 100.0) >= 0.10::DOUBLE)"""


@query(
    "src_04_text_layer",
    """SELECT doc_id, 'p' || doc_id || '-tl-l' || (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1) AS line_id, text, greatest(0, trunc(x0 * 300 / 72))::BIGINT AS x, greatest(0, trunc(y0 * 300 / 72))::BIGINT AS y,
    greatest(1, trunc(x1 * 300 / 72)::BIGINT - trunc(x0 * 300 / 72)::BIGINT) AS w FROM tl SEMI JOIN tg USING (doc_id)""",
    t.BLOCKS, _TEXT_LAYER,
)
def _(spark, d):
    pages = t.documents(spark, d).select("doc_id", F.col("doc_id").alias("page_no"), F.lit(100.0).alias("width_pt"), F.lit(100.0).alias("height_pt"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("n_images"))
    out = lines.text_layer(_text_words(spark, d), pages)
    return out.select("doc_id", "line_id", "text", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("w").cast("long").alias("w"))


@query("src_07_corpus_pages", "SELECT lang || '-' || doc_id AS page_id, lang AS script, 'corpus:' || CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END || '/' || lang || '-' || doc_id AS provenance FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0")
def _(spark, d):
    base = t.documents(spark, d).select(F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"), F.concat("lang", F.lit("-"), "doc_id").alias("page_id"), F.when(F.col("doc_id") % 4 == 0, "gif").otherwise("PNG").alias("suffix"), "text", "doc_id")
    return parsers.corpus_pages(base.select("split", "page_id", "suffix"), base.filter("doc_id % 5 != 0").select("split", "page_id", "text")).select("page_id", "script", "provenance")


@query("src_08_corrections_for", "SELECT line_id, corrected_at, accepted FROM co WHERE line_id LIKE 'p1_-l%'", t.LINES, t.CORRECTIONS)
def _(spark, d):
    return parsers.corrections_for(t.corrections(spark, d), "p1_-l").select("line_id", "corrected_at", "accepted")


_DICTIONARY = "di AS (SELECT line_idx AS idx, text || '/AB' AS value FROM ln)"


@query("src_10_dictionary_words", "SELECT trim(split_part(value, '/', 1)) AS form, count(*) AS n FROM di WHERE idx > 0 AND trim(split_part(value, '/', 1)) <> '' GROUP BY 1", t.LINES, _DICTIONARY)
def _(spark, d):
    rows = t.lines(spark, d).select(F.col("line_idx").alias("idx"), F.concat("text", F.lit("/AB")).alias("value"))
    return parsers.hunspell_words(rows).groupBy("form").agg(F.count("*").alias("n"))


@query("src_12_promoted_model", "SELECT max(doc_id) AS pos FROM documents WHERE lang = 'de' AND doc_id % 6 <> 0")
def _(spark, d):
    p = t.documents(spark, d).select(F.col("doc_id").alias("pos"), F.create_map("lang", F.lit(0.1)).alias("per_script_cer"), F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 6 == 0, "0").otherwise(F.upper(F.sha2("text", 256))).alias("sha256"))
    return parsers.promoted_model(p, "de").select("pos")


_TSV = "tv AS (SELECT doc_id, line_idx, k, CASE WHEN k % 4 = 3 THEN 4 ELSE 5 END AS level, text, CASE WHEN k % 7 = 6 THEN 'x' ELSE ((doc_id + k) % 120 - 10)::VARCHAR END AS conf, x, y, CASE WHEN k % 5 = 4 THEN 0 ELSE w END AS w FROM (SELECT *, block_idx // 100000 AS line_idx, block_idx % 100000 AS k FROM bl))"


def _tsv(spark, d):
    b = t.blocks(spark, d).withColumn("line_idx", F.floor(F.col("block_idx") / 100000)).withColumn("k", F.col("block_idx") % 100000)
    k = F.col("k")
    row = F.struct("k", F.when(k % 4 == 3, "4").otherwise("5").alias("level"), "text", F.when(k % 7 == 6, "x").otherwise(((F.col("doc_id") + k) % 120 - 10).cast("string")).alias("conf"), F.col("x").cast("string").alias("left"), F.col("y").cast("string").alias("top"), F.when(k % 5 == 4, "0").otherwise(F.col("w").cast("string")).alias("width"), F.lit("20").alias("height"))
    g = b.groupBy("doc_id", F.col("line_idx").alias("page_no")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return g.select("doc_id", "page_no", *(F.col("r")[c].alias(c) for c in ("level", "text", "conf", "left", "top", "width", "height")))


@query("src_15_tesseract_words", "SELECT doc_id, line_idx AS page_no, 'word-' || k AS block_id, trim(text) AS text, conf::DOUBLE AS conf FROM tv WHERE level = 5 AND w > 0 AND trim(text) <> '' AND TRY_CAST(conf AS DOUBLE) BETWEEN 0 AND 100", t.BLOCKS, _TSV)
def _(spark, d):
    return parsers.tesseract_words(_tsv(spark, d)).select("doc_id", "page_no", "block_id", "text", "conf")


@query("src_16_tesseract_lines", "SELECT doc_id, line_idx AS page_no, row_number() OVER (PARTITION BY doc_id, line_idx ORDER BY k) AS reading_order, x FROM tv WHERE level = 4 AND w > 0", t.BLOCKS, _TSV)
def _(spark, d):
    return parsers.tesseract_lines(_tsv(spark, d)).select("doc_id", "page_no", F.col("reading_order").cast("long").alias("reading_order"), F.col("x").cast("long").alias("x"))


@query("src_17_kraken_records", "SELECT line_id, CASE WHEN line_idx % 2 = 0 THEN x ELSE x - 5 END AS x, CASE WHEN line_idx % 2 = 0 THEN w ELSE w + 5 END AS w, CASE WHEN line_idx % 3 = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, (conf + 0.5::DOUBLE) / 2 * 100) END AS conf, CASE WHEN line_idx = 0 THEN 'running_head' ELSE 'unknown' END AS region_type FROM ln", t.LINES)
def _(spark, d):
    b = t.lines(spark, d)
    x, y, w, h = (F.col(c) for c in "xywh")
    bbox = F.when(F.col("line_idx") % 2 == 0, F.array(x, y, x + w, y + h)).otherwise(F.array().cast("array<bigint>"))
    points = F.array(F.array(x, y), F.array(x + w, y), F.array(x - 5, y + h))
    chars = F.when(F.col("line_idx") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("conf"), F.lit(0.5)))
    r = b.select("line_id", bbox.alias("bbox"), points.alias("polygon"), chars.alias("char_conf"), F.when(F.col("line_idx") == 0, "Running-Head").otherwise("other").alias("category"))
    return parsers.kraken_records(r).select("line_id", "x", "w", "conf", "region_type")


@query("src_18_vlm_reply", "SELECT doc_id, line_idx AS idx, round_even(x / 4.0::DOUBLE, 0)::BIGINT AS x, greatest(1, round_even((x + w) / 4.0::DOUBLE, 0)::BIGINT - round_even(x / 4.0::DOUBLE, 0)::BIGINT) AS w, trim(text) AS text FROM ln WHERE line_idx % 6 <> 5", t.LINES)
def _(spark, d):
    b = t.lines(spark, d)
    row = F.concat_ws(",", "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    row = F.when(F.col("line_idx") % 6 == 5, F.concat(F.lit("no box "), "text")).otherwise(F.concat(row, F.lit("|"), "text"))
    g = b.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", row.alias("r")))), lambda s: s["r"]), "\n").alias("payload")).withColumn("scale", F.lit(4.0))
    out = parsers.vlm_reply(g)
    return out.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("x").cast("long").alias("x"), F.col("w").cast("long").alias("w"), "text")


@query("src_20_calamari", "SELECT doc_id, line_idx AS page_no, trim(text) AS text, CASE WHEN line_idx % 2 = 0 THEN 100.0::DOUBLE ELSE 25.0::DOUBLE END AS conf FROM ln WHERE trim(text) <> ''", t.LINES)
def _(spark, d):
    b = t.lines(spark, d)
    voted = F.struct(F.lit("voted").alias("id"), F.col("text").alias("sentence"), F.when(F.col("line_idx") % 2 == 0, 1.5).otherwise(0.25).alias("avg_char_probability"))
    other = F.struct(F.lit("fold_0").alias("id"), F.lit("other").alias("sentence"), F.lit(0.9).alias("avg_char_probability"))
    payload = F.to_json(F.struct(F.array(other, voted).alias("predictions")))
    return parsers.calamari_predictions(b.select("doc_id", F.col("line_idx").alias("page_no"), payload.alias("payload")))


@query("src_22_upload_rules", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'empty' WHEN doc_id % 5 = 0 THEN 'bad_name' WHEN doc_id % 3 = 0 THEN 'unknown_suffix' WHEN doc_id % 2 = 0 THEN 'wrong_content' ELSE 'ok' END AS verdict FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, "a/b.pdf").when(i % 3 == 0, "a.exe").otherwise("A.PDF")
    content = F.when(i % 7 == 0, "").when(i % 2 == 0, "plain").otherwise("%PDF-1.7").cast("binary")
    return t.documents(spark, d).select("doc_id", parsers.upload_verdict(name, content, 10**6).alias("verdict"))


# Sinks


@query("snk_01_plain_text", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '[Page ' || doc_id || ' could not be read: broken]' || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY line_idx) AS body FROM ln GROUP BY doc_id", t.LINES)
def _(spark, d):
    bad = t.documents(spark, d).filter("doc_id % 10 = 0").select("doc_id", F.col("doc_id").alias("page_no"), F.lit("broken").alias("message"))
    return sinks.plain_text(t.lines(spark, d), bad)


@query("snk_02_markdown", "SELECT doc_id, '## Page ' || doc_id || chr(10) || chr(10) || string_agg(CASE line_idx % 4 WHEN 0 THEN '# ' || text WHEN 1 THEN '<!-- head: ' || text || ' -->' WHEN 2 THEN '*[Footnote]* ' || text ELSE text END, chr(10) || chr(10) ORDER BY line_idx) || chr(10) AS body FROM ln GROUP BY doc_id", t.LINES)
def _(spark, d):
    k = F.col("line_idx") % 4
    role = F.when(k == 0, "heading").when(k == 1, "running_head").when(k == 2, "footnote").otherwise("body")
    return sinks.markdown(t.lines(spark, d).select(*PAGE, F.col("line_idx").alias("para_idx"), "text", role.alias("role")))


def _sql_escaped(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{char}', '{entity}')"
    return x


_PLACE = """' HPOS="' || x || '" VPOS="' || y || '" WIDTH="' || w || '" HEIGHT="' || h || '"'"""


@query(
    "snk_03_alto",
    f"""SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page PHYSICAL_IMG_NR="' || page_no || '"><PrintSpace><TextBlock>' || string_agg(
      '<TextLine ID="' || line_id || '"' || {_PLACE} || '><String CONTENT="' || {_sql_escaped('text')} || '" WC="' || format('{{:.6f}}', conf / 100) || '"' || {_PLACE} || '/></TextLine>', '' ORDER BY line_idx)
      || '</TextBlock></PrintSpace></Page></Layout></alto>' AS body FROM ln GROUP BY doc_id, page_no""",
    t.LINES,
)
def _(spark, d):
    return sinks.alto(t.lines(spark, d))


@query(
    "snk_04_page_xml",
    f"""SELECT doc_id, page_no, '<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion>' || string_agg(
      '<TextLine id="' || line_id || '"><Coords points="' || x || ',' || y || ' ' || (x + w) || ',' || y || ' ' || (x + w) || ',' || (y + h) || ' ' || x || ',' || (y + h) || '"/><TextEquiv conf="'
      || format('{{:.6f}}', conf / 100) || '"><Unicode>' || {_sql_escaped('text')} || '</Unicode></TextEquiv></TextLine>', '' ORDER BY line_idx) || '</TextRegion></Page></PcGts>' AS body FROM ln GROUP BY doc_id, page_no""",
    t.LINES,
)
def _(spark, d):
    return sinks.page_xml(t.lines(spark, d))


@query("snk_11_json", "SELECT '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' AS json FROM documents")
def _(spark, d):
    return sinks.envelope(t.documents(spark, d).select("doc_id", "lang"))


@query("snk_12_word_list", "SELECT DISTINCT translate(lower(form), 'éèáíóú', 'eeaiou') AS form FROM lx WHERE length(form) > 1", t.LEXICON)
def _(spark, d):
    return sinks.word_list(t.lexicon(spark, d))


@query("snk_14_session_key", "SELECT doc_id, substr(sha256(text), 1, 16) AS key FROM documents")
def _(spark, d):
    return t.documents(spark, d).select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("key"))


# Scalar functions


@query("fn_01_nfc", "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def _(spark, d):
    return t.documents(spark, d).select("doc_id", F.sha2(text.nfc(F.col("text")), 256).alias("digest"))


@query("fn_02_monotonize", "SELECT line_id, translate(lower(text), 'éèáíóú', 'eeaiou') AS key FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", text.monotonize(F.lower("text")).alias("key"))


@query("fn_03_lexicon_form", "SELECT DISTINCT token, trim(token, '.,;:!?()[]{}-\"''·«»‘’“”–—…') AS form FROM tk", t.LINES, _TOKENS)
def _(spark, d):
    return _words(spark, d).select("token", text.lexicon_form(F.col("token")).alias("form")).distinct()


@query("fn_04_latin_evidence", "SELECT line_id, length(regexp_replace(text, '[^CDFGJLQRSUVWbcdefghjlmqrswz]', '', 'g')) AS n FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", text.latin_evidence(F.col("text")).cast("long").alias("n"))


@query("fn_05_greek_letters", "SELECT line_id, length(regexp_replace(translate(text, 'aeo', 'αεο'), '[^Ͱ-Ͽἀ-῿]', '', 'g')) AS n FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", text.greek_letters(F.translate("text", "aeo", "αεο")).cast("long").alias("n"))


@query("fn_06_ascii_letters", "SELECT line_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", text.ascii_letters(F.col("text")).cast("long").alias("n"))


@query("fn_07_latin_dominant", "SELECT line_id, l >= 3 AND l >= g AS latin FROM (SELECT line_id, length(regexp_replace(u, '[^CDFGJLQRSUVWbcdefghjlmqrswz]', '', 'g')) AS l, length(regexp_replace(u, '[^Ͱ-Ͽἀ-῿]', '', 'g')) AS g FROM (SELECT line_id, translate(text, 'aeotn', 'αεοτν') AS u FROM ln))", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", text.is_latin_dominant(F.translate("text", "aeotn", "αεοτν")).alias("latin"))


@query(
    "fn_08_diacritics",
    "SELECT line_id, CASE line_idx % 4 WHEN 0 THEN [] WHEN 1 THEN ['multiple_breathing_marks'] WHEN 2 THEN ['multiple_accent_marks'] ELSE ['multiple_breathing_marks', 'multiple_accent_marks', 'multiple_accent_marks'] END AS flags FROM ln",
    t.LINES,
)
def _(spark, d):
    # One breathing and one accent on each alpha, and then letters with more of one, of the other, or of both.
    rest = [F.lit(x) for x in ("\u1f04", "\u1f04\u0314", "\u1f04\u0300", "\u1f04\u0313\u0301\u03b7\u0342\u0301")]
    odd = F.concat(F.translate("text", "a", "\u1f04"), F.element_at(F.array(*rest), (F.col("line_idx") % 4 + 1).cast("int")))
    return t.lines(spark, d).select("line_id", text.diacritic_violations(odd).alias("flags"))


@query("fn_09_dangling_marks", r"SELECT line_id, len(regexp_extract_all(translate(text, 'x ', chr(769) || chr(769)), '(?:^|[^\pL\pM])\pM')) AS n FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", text.dangling_marks(F.translate("text", "x ", "\u0301\u0301")).cast("long").alias("n"))


_SHORT = {"th.": "the", "nd.": "and"}


_SHORTENED = "replace(text, ' the ', ' th. ')"


def _sql_expanded(line: str, short: str, long: str) -> str:
    """Twice, as a match takes the signs around it along."""
    for _ in range(2):
        line = rf"regexp_replace({line}, '(^|[^\pL\pN\pM_]){short}[.]($|[^\pL\pN\pM_])', '\1{long}\2', 'g')"
    return line


@query("fn_11_abbreviations", f"SELECT line_id, {_sql_expanded(_sql_expanded(_SHORTENED, 'th', 'the'), 'nd', 'and')} AS expanded FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", suggest.expand(F.replace("text", F.lit(" the "), F.lit(" th. ")), _SHORT).alias("expanded"))


@query(
    "fn_12_lexicon_flags",
    rf"""SELECT line_id, pos::BIGINT AS pos, token AS source_text, 'not_in_' || script || '_lexicon' AS reason, st::BIGINT AS "start" FROM (
    SELECT *, coalesce(sum(length(token)) OVER o, 0) + sum(length(gap)) OVER p AS st FROM (
      SELECT line_id, script, unnest(found) AS token, unnest(list_slice(gaps, 1, len(found))) AS gap, unnest(range(len(found))) AS pos
      FROM (SELECT line_id, script, regexp_extract_all(text, '\S+') AS found, regexp_split_to_array(text, '\S+') AS gaps FROM ln WHERE script IN ('en', 'de')))
    WINDOW o AS (PARTITION BY line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY line_id ORDER BY pos)) f
    ANTI JOIN lk ON lk.lexicon = f.script AND lk.key = {_KEY.format("f.token")} WHERE {_KEY.format("f.token")} <> ''""",
    t.LINES, t.LEXICON, _KNOWN,
)
def _(spark, d):
    spans = _words(spark, d).drop("lexicon")
    return suggest.lexicon_flags(spans, t.lexicon(spark, d)).select("line_id", F.col("pos").cast("long").alias("pos"), "source_text", "reason", F.col("start").cast("long").alias("start"))


_SHAPED = "regexp_replace(translate(lower(trim(text)), 'äçèéêíñóöü', 'aceeeinoou'), '[0-9]+', '@', 'g')"
_NUMERAL = r"'(^|[^\pL\pN\pM_])[ivxlcdm]+($|[^\pL\pN\pM_])', '\1@\2', 'g'"


@query("fn_14_candidate_shape", f"SELECT line_id, regexp_replace(regexp_replace({_SHAPED}, {_NUMERAL}), {_NUMERAL}) AS shape FROM ln WHERE script = 'en'", t.LINES)
def _(spark, d):
    return t.lines(spark, d).filter("script = 'en'").select("line_id", text.normalize_candidate(F.col("text")).alias("shape"))


@query("fn_15_similarity")
def _(spark, d):
    return t.lines(spark, d).select("line_id", text.similarity(F.col("text"), F.translate("text", "eio", "oei")).alias("ratio"))


@query("fn_16_folio_shapes", r"SELECT line_id, doc_id % 5 <> 0 AND regexp_matches(f, '^[-‐–—－]\s*\S{1,4}\s*[-‐–—－]$') AS folio, regexp_matches(n, '^\s*\d{1,3}\s+\S') AND regexp_matches(n, '\p{Ll}') AS footnote FROM (SELECT line_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE '— ' || doc_id || ' —' END AS f, (line_idx || ' ' || text) AS n FROM ln)", t.LINES)
def _(spark, d):
    f = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("— "), "doc_id", F.lit(" —")))
    return t.lines(spark, d).select("line_id", ((F.col("doc_id") % 5 != 0) & text.is_folio(f)).alias("folio"), text.is_footnote(F.concat("line_idx", F.lit(" "), "text")).alias("footnote"))


@query("fn_20_edit_distance", f"SELECT doc_id, line_idx, levenshtein({_one('reference')}, {_one('hypothesis')}) AS distance FROM pa", t.LINES, _PAIRS)
def _(spark, d):
    return _pairs(spark, d).select("doc_id", "line_idx", text.distance(F.col("reference"), F.col("hypothesis")).cast("long").alias("distance"))


@query("fn_21_character_error", f"SELECT doc_id, line_idx, {_sql_cer('reference', 'hypothesis')} AS cer FROM pa", t.LINES, _PAIRS)
def _(spark, d):
    return _pairs(spark, d).select("doc_id", "line_idx", text.character_error_rate(F.col("reference"), F.col("hypothesis")).alias("cer"))


@query("fn_22_word_error")
def _(spark, d):
    return _pairs(spark, d).select("doc_id", "line_idx", text.word_error_rate(F.col("reference"), F.col("hypothesis")).alias("wer"))


@query("fn_23_regression_exceeded", f"SELECT doc_id, line_idx, {_sql_cer('reference', 'hypothesis')} > 0.1::DOUBLE + 0.05::DOUBLE AS exceeded FROM pa", t.LINES, _PAIRS)
def _(spark, d):
    p = _pairs(spark, d)
    return p.select("doc_id", "line_idx", (text.character_error_rate(F.col("reference"), F.col("hypothesis")) > F.lit(0.1) + 0.05).alias("exceeded"))


_APPLIED = """CASE WHEN line_idx % 3 = 0 THEN translate(text, 'e', 'o') WHEN substr(translate(text, 'e', 'o'), 1, 2) = substr(text, 1, 2) THEN upper(substr(translate(text, 'äöüßéèêçñáíóú', 'aouseeecnaiou'), 1, 2)) || substr(translate(text, 'e', 'o'), 3)
    WHEN (length(translate(text, 'e', 'o')) - length(replace(translate(text, 'e', 'o'), substr(text, 1, 2), ''))) // 2 = 1 THEN replace(translate(text, 'e', 'o'), substr(text, 1, 2), upper(substr(translate(text, 'äöüßéèêçñáíóú', 'aouseeecnaiou'), 1, 2))) ELSE translate(text, 'e', 'o') END"""


@query("fn_25_apply_suggestions", f"""SELECT line_id, {_APPLIED} AS applied
    FROM ln WHERE (doc_id + line_idx) % 3 = 0 AND length(text) > 3""", t.LINES)
def _(spark, d):
    out = review.with_suggestions(t.lines(spark, d), t.suggestions(spark, d)).filter("n_suggestions > 0")
    return out.select("line_id", suggest.apply_all(F.col("text"), F.col("suggestions")).alias("applied"))


@query("fn_26_scaled_box", "SELECT line_id, greatest(0, trunc(x / 7.0::DOUBLE * 300 / 72))::BIGINT AS x, greatest(1, trunc((x + w) / 7.0::DOUBLE * 300 / 72)::BIGINT - trunc(x / 7.0::DOUBLE * 300 / 72)::BIGINT) AS w FROM ln", t.LINES)
def _(spark, d):
    b = [F.col(c) / 7.0 for c in ("x", "y")] + [(F.col("x") + F.col("w")) / 7.0, (F.col("y") + F.col("h")) / 7.0]
    return t.lines(spark, d).select("line_id", *boxes.scaled(*b, 300)).select("line_id", F.col("x").cast("long").alias("x"), F.col("w").cast("long").alias("w"))


@query("fn_27_confidence_bands", "SELECT CASE WHEN conf < 40 THEN 'very_low' WHEN conf < 60 THEN 'low' WHEN conf < 80 THEN 'medium' ELSE 'high' END AS band, count(*) AS n FROM ln GROUP BY 1", t.LINES)
def _(spark, d):
    return t.lines(spark, d).groupBy(text.confidence_band(F.col("conf")).alias("band")).agg(F.count("*").alias("n"))


@query("fn_28_queue_id", "SELECT doc_id, substr(sha256(source), 1, 16) || '-' || doc_id AS queue_id FROM documents")
def _(spark, d):
    return t.documents(spark, d).select("doc_id", text.queue_id(F.col("source"), F.col("doc_id").cast("string")).alias("queue_id"))


@query("fn_30_improvement", "SELECT lang, CASE WHEN avg(n_chars) = 0 THEN 0.0 ELSE (avg(n_chars) - min(n_chars)) / avg(n_chars) * 100 END AS improvement FROM documents GROUP BY lang")
def _(spark, d):
    g = t.documents(spark, d).groupBy("lang").agg(F.avg("n_chars").alias("p"), F.min("n_chars").alias("c"))
    return g.select("lang", evaluate.improvement(F.col("p"), F.col("c")).alias("improvement"))


@query("fn_33_collapsed", r"SELECT line_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM ln", t.LINES)
def _(spark, d):
    return t.lines(spark, d).select("line_id", text.collapsed(F.col("text")).alias("text"))


@query("img_06_crop_box", "SELECT line_id, greatest(0, x - 2) AS \"left\", least(1000, x + w + 2) AS \"right\", greatest(0, y - 2) AS top, least(500, y + h + 2) AS bottom FROM ln", t.LINES)
def _(spark, d):
    b = [F.col(c) for c in "xywh"]
    return t.lines(spark, d).select("line_id", *boxes.padded_crop(*b, F.lit(1000).cast("long"), F.lit(500).cast("long")))


@query("img_07_downscale", "SELECT line_id, CASE WHEN greatest(w, h) > 1400 THEN 1400.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS scale FROM ln", t.LINES)
def _(spark, d):
    edge = F.greatest("w", "h")
    return t.lines(spark, d).select("line_id", F.when(edge > 1400, F.lit(1400.0) / edge).otherwise(F.lit(1.0)).alias("scale"))


# Review, promotion, streams


@query("rev_01_accept_reversible", f"SELECT * FROM (SELECT line_id, text, {_APPLIED} AS accepted FROM ln WHERE (doc_id + line_idx) % 3 = 0 AND length(text) > 3) WHERE accepted <> text", t.LINES)
def _(spark, d):
    out = review.with_suggestions(t.lines(spark, d), t.suggestions(spark, d)).filter("n_suggestions > 0")
    return out.select("line_id", "text", suggest.apply_all(F.col("text"), F.col("suggestions")).alias("accepted")).filter("accepted != text")


@query("rev_02_reviewed_export", "SELECT doc_id, string_agg(final_text, chr(10) ORDER BY line_idx) AS body FROM fi GROUP BY doc_id", t.LINES, t.OVERRIDES, _FINAL)
def _(spark, d):
    out = review.final_text(t.lines(spark, d), t.overrides(spark, d)).withColumn("text", F.col("final_text"))
    none = spark.createDataFrame([], "doc_id long, page_no long, message string")
    return sinks.plain_text(out, none)


@query("rev_03_reader_accuracy", "SELECT ln.line_id, CASE WHEN length(ov.text) = 0 THEN CASE WHEN length(ln.text) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE (length(ln.text) - length(replace(ln.text, 'a', '')))::DOUBLE / length(ov.text) END AS cer FROM ov JOIN ln USING (line_id) WHERE store = 'accepted'", t.LINES, t.OVERRIDES)
def _(spark, d):
    return review.reader_accuracy(t.lines(spark, d), t.overrides(spark, d))


@query("trn_02_promotion", "SELECT round(avg(c), 9) AS mean_cer, round(avg(p), 9) AS parent_mean, sum(n)::BIGINT AS samples, CASE WHEN sum(n) < 10 THEN 'too_few_samples' WHEN bool_or(c > p) THEN 'script_regressed' WHEN avg(p) = 0 THEN 'parent_is_perfect' WHEN (avg(p) - avg(c)) / avg(p) * 100 < 1 THEN 'too_small' ELSE 'promote' END AS verdict FROM (SELECT lang, avg(n_chars) / 100000.0::DOUBLE AS p, avg(n_chars) / 200000.0::DOUBLE AS c, count(*) AS n FROM documents GROUP BY lang)")
def _(spark, d):
    g = t.documents(spark, d).groupBy(F.col("lang").alias("script")).agg(F.avg("n_chars").alias("a"), F.count("*").alias("samples"))
    c, p = g.select("script", (F.col("a") / 200000).alias("cer"), "samples"), g.select("script", (F.col("a") / 100000).alias("cer"))
    return evaluate.promotion(c, p).select(F.round("mean_cer", 9).alias("mean_cer"), F.round("parent_mean", 9).alias("parent_mean"), "samples", "verdict")


@query("str_03_page_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, CASE WHEN event_type = 'error' THEN 'page_failed' ELSE 'page_completed' END AS event_type, count(*) AS n, round(sum(value), 4) AS total_ms FROM events GROUP BY 1, 2")
def _(spark, d):
    return events.windowed(events.page_events(t.table(spark, d, "events"))).withColumn("total_ms", F.round("total_ms", 4))


@query("str_06_cache_keys", "SELECT count(DISTINCT sha256(text) || source) AS computed, count(*) AS asked FROM documents")
def _(spark, d):
    keys = t.documents(spark, d).select(F.concat(F.sha2("text", 256), "source").alias("k"))
    return keys.agg(F.countDistinct("k").alias("computed"), F.count("*").alias("asked"))


@query("str_07_job_states", "SELECT event_type, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'failed' END AS state, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    state = review.job_state(F.col("event_type"), {"click": "running", "view": "queued"}, "failed")
    return t.table(spark, d, "events").groupBy("event_type", state.alias("state")).agg(F.count("*").alias("n"))


# Replies, lists and settings


@query(
    "src_19_block_reply",
    r"""SELECT doc_id, line_idx AS block, line, text, x // 10 * 700 // 1000 AS x FROM (SELECT doc_id, line_idx, least(x, 1000) * 10 AS x, unnest(f) AS text, unnest(range(len(f))) AS line FROM (
    SELECT doc_id, line_idx, x, list_filter(list_transform(string_split(text, '. '), lambda p: trim(p)), lambda p: p <> '') AS f FROM ln WHERE line_idx % 3 <> 2))""",
    t.LINES,
)
def _(spark, d):
    b = t.lines(spark, d)
    label = F.when(F.col("line_idx") % 3 == 2, "image").otherwise("text")
    one = F.concat(F.lit("<BLOCK>"), label, F.lit("["), F.col("x"), F.lit(","), F.lit(0), F.lit(","), F.lit(900), F.lit(","), F.lit(500), F.lit("]<FORK>"), F.replace(F.col("text"), F.lit(". "), F.lit("\n")))
    g = b.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", one.alias("v")))), lambda s: s["v"]), "").alias("payload"))
    out = replies.block_reply(g.select("*", F.lit(700).alias("page_w"), F.lit(900).alias("page_h"), F.lit("stop").alias("finish_reason")))
    return out.select("doc_id", F.col("block").cast("long").alias("block"), F.col("line").cast("long").alias("line"), "text", F.col("x").cast("long").alias("x"))


@query("src_11_model_list", "SELECT source AS name, max(doc_id) AS pos FROM documents WHERE doc_id % 7 <> 0 GROUP BY source")
def _(spark, d):
    e = t.documents(spark, d).select(F.col("source").alias("name"), F.col("doc_id").alias("pos"), F.lit("kraken").alias("engine"), F.when(F.col("doc_id") % 7 != 0, F.sha2("text", 256)).alias("sha256"))
    return replies.latest_by_name(e).select("name", "pos")


@query("snk_13_upsert_models", "SELECT source AS name, max(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS pos FROM documents GROUP BY source HAVING max(CASE WHEN doc_id % 2 = 0 THEN doc_id END) IS NOT NULL UNION ALL SELECT source, max(doc_id) FROM documents GROUP BY source HAVING max(CASE WHEN doc_id % 2 = 0 THEN doc_id END) IS NULL")
def _(spark, d):
    each = t.documents(spark, d).select(F.col("source").alias("name"), F.col("doc_id").alias("pos"))
    last = lambda df: df.groupBy("name").agg(F.max("pos").alias("pos"))
    return replies.upsert(last(each), last(each.filter("pos % 2 = 0")))


@query("src_21_settings", "SELECT doc_id, source AS tenant, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS flag FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    keys = replies.api_keys(F.concat(F.lit("k:other, key"), i, F.lit(": "), F.col("source"), F.lit(" ,")))
    raw = F.when(i % 4 == 0, "Yes").when(i % 4 == 1, " off ").when(i % 4 == 2, "maybe")
    return t.documents(spark, d).select("doc_id", F.element_at(keys, F.concat(F.lit("key"), i)).alias("tenant"), replies.boolean_setting(raw, True).alias("flag"))


@query("fn_32_output_format", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN NULL ELSE 'alto' END AS format FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    path = F.when(i % 4 == 0, "a.TXT").when(i % 4 == 1, "b.md").when(i % 4 == 2, "c.exe").otherwise("d.exe")
    return t.documents(spark, d).select("doc_id", replies.output_format(path, F.when(i % 4 == 3, "alto")).alias("format"))
