"""Operators on the survey's small fixtures."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate, lines, reconcile, resilience, review, structure, suggest
from quire.plans import registry
from quire.sources import parsers, sinks
from quire.streaming import events

KEY = ["doc_id", "page_no", "line_idx"]
LINES = "doc_id string, page_no int, line_idx int, line_id string, text string, conf double, x int, y int, w int, h int, script string, region_type string"


def page(spark, rows):
    return spark.createDataFrame([("d", 1, k, f"l{k}", t, 90.0, x, y, w, h, "polytonic", "main") for k, (t, x, y, w, h) in enumerate(rows)], LINES)


def test_geometry_and_breaks(spark):
    df = page(spark, [("a", 10, 20, 100, 15), ("b", 10, 45, 105, 15), ("c", 12, 70, 98, 15)])
    g = structure.page_geometry(df).first()
    assert (g.left_edge, g.right_edge, g.median_leading, g.median_line_height) == (10, 110, 10.0, 15.0)
    broken = page(spark, [("a", 10, 0, 100, 15), ("b", 15, 25, 95, 15), ("c", 10, 50, 70, 15), ("d", 10, 75, 100, 15), ("e", 10, 130, 100, 15), ("f", 10, 155, 100, 15)])
    out = structure.paragraphs(structure.with_breaks(broken, structure.page_geometry(broken))).orderBy("line_idx").collect()
    assert [r.para_idx for r in out] == [0, 1, 1, 2, 3, 3]


def test_running_heads(spark):
    rows = []
    for p in range(1, 6):
        head = "ΤΟΥ ΑΓΙΟΥ ΙΩΑΝΝΟΥ" if p != 3 else "TΟY ΑΓIΟΥ ΙΩΑΝΝOΥ"
        for k, (t, y) in enumerate([(head, 0), (f"- {p + 40} -", 30), (f"body {'xyz' * p} alone", 60), (f"other text {p * 'qwerty'}", 90), (("foxes", "houndly", "lion mane", "tapirus x", "kea")[p - 1], 120)]):
            rows.append(("b", p, k, f"p{p}-{k}", t, 90.0, 0, y, 200, 15, "polytonic", "main"))
    df = spark.createDataFrame(rows, LINES)
    pages = df.select("doc_id", "page_no", F.col("page_no").alias("page_idx")).distinct()
    got = {(r.page_no, r.line_idx) for r in structure.running_heads(df, pages).collect()}
    assert got == {(p, k) for p in range(1, 6) for k in (0, 1)}
    assert structure.running_heads(df.filter("page_no = 1"), pages.filter("page_no = 1")).filter("line_idx = 0").count() == 0


def test_hyphens(spark):
    df = page(spark, [("λόγος εὐ-", 0, 0, 9, 9), ("χή, και", 0, 20, 9, 9), ("ἀντι-", 0, 40, 9, 9), ("εὐχή", 0, 60, 9, 9), ("unverified-", 0, 80, 9, 9), ("word", 0, 100, 9, 9), ("end-", 0, 120, 9, 9), ("", 0, 140, 9, 9)])
    lexicon = spark.createDataFrame([("x", 0, "εὐχή"), ("x", 0, "ἀντι-εὐχή")], "lexicon string, layer int, form string")
    got = {r.line_id: (r.verdict, r.separator) for r in structure.dehyphenate(structure.join_candidates(df, ["doc_id"]), lexicon).collect()}
    assert got == {"l0": ("joined_in_lexicon", ""), "l2": ("hyphen_in_lexicon", "-"), "l4": ("unverified", "")}


def test_unfold_is_the_inverse_of_fold(spark):
    rows = [("ab-", "drop"), ("cd ef", None), ("gh-", "keep"), ("ij", None)]
    items = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(j).cast("string").alias("joined"), F.lit(len(t)).alias("size"), F.lit("-").alias("removed")) for t, j in rows))
    r = spark.range(1).select(items.alias("i")).select("i", structure.fold_paragraph(F.col("i")).alias("whole")).select("whole", structure.unfold_paragraph(F.col("whole"), F.col("i")).alias("back")).first()
    assert r.whole == "abcd ef gh-ij" and r.back == [t for t, _ in rows]


def test_blocks_to_lines(spark):
    seg = spark.createDataFrame([("d", 1, k, f"s{k}", 0, 20 * k, 100, 20, "polytonic", "main", k) for k in range(3)], "doc_id string, page_no int, seg_idx int, seg_id string, x int, y int, w int, h int, script string, region_type string, reading_order int")
    words = [("b", 60, 0, 10, 20, 80.0), ("a", 0, 2, 20, 20, 60.0), ("graze", 0, 19, 20, 10, 50.0), ("tie", 40, 30, 10, 20, 40.0), ("out", 500, 500, 10, 10, 10.0), ("", 70, 0, 5, 20, 100.0)]
    blk = spark.createDataFrame([("d", 1, "t", "grc", "", k, *w) for k, w in enumerate(words)], "doc_id string, page_no int, engine string, model_name string, variant string, block_idx int, text string, x int, y int, w int, h int, conf double")
    got = {r.block_idx: r.seg_idx for r in lines.assign_blocks(seg, blk).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 5: 0}
    first = lines.compose_lines(lines.assign_blocks(seg, blk)).filter("seg_idx = 0").first()
    assert (first.text, first.conf, first.x, first.y, first.w, first.h, first.cand_id) == ("b a", 80.0, 0, 0, 75, 22, "s0-t")


def test_pages_are_read_as_blocks_are(spark):
    """Pages in parts give the lines that assigning and composing rows gives, whatever overlaps, ties or is empty."""
    rng = random.Random(3)
    segs, blks, parts = [], [], []
    for page in range(30):
        box = lambda tall: (rng.randint(0, 60), rng.randint(-20, 200), rng.randint(1, 60), rng.choice(tall))
        s = [(k, f"s{k}", "grc", "main", k, *box((1, 8, 9, 150))) for k in range(rng.randint(0, 9))]
        segs += [(page, 1, *x) for x in s]
        for engine in "ab":
            b = [(rng.randint(0, 30), rng.choice(("", "x", "yy", None)), rng.choice((None, 1.0, 50.0)), *box((1, 8, 20))) for _ in range(rng.randint(0, 40))]
            b = list({x[0]: x for x in b}.values())
            blks += [(page, 1, engine, "m", "v" if engine == "b" else "", *x) for x in b]
            parts += [(page, 1, engine, "m", "v" if engine == "b" else "", n, 3, s[n::3], b[n::3]) for n in range(3)]
    page, box = "doc_id long, page_no long, ", "x long, y long, w long, h long"
    seg = spark.createDataFrame(segs, page + "seg_idx long, seg_id string, script string, region_type string, reading_order long, " + box)
    blk = spark.createDataFrame(blks, page + "engine string, model_name string, variant string, block_idx long, text string, conf double, " + box)
    whole = spark.createDataFrame(parts, lines.PARTS.format(page=page.rstrip(", "))).coalesce(1)
    want = lines.compose_lines(lines.assign_blocks(seg, blk))
    got = lines.read_pages(whole).select(want.columns).collect()
    assert len(got) > 50 and sorted(map(str, got)) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted(map(str, lines.read_pages(whole).select(want.columns).collect())) == sorted(map(str, got))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for torn in ("part != 1", "doc_id != 29 or engine != 'b' or part != 2"):
        with pytest.raises(Exception, match="a page"):
            lines.read_pages(whole.filter(torn)).collect()


def test_readings(spark):
    rows = [(0, "grc", "", "alpha beta gamma", 50.0), (1, "ell", "", "alpha bets gamma", 90.0), (2, "eng", "", "alpha bets  gamma", 10.0), (3, "grc", "otsu", "x", 99.0)]
    df = spark.createDataFrame([("d", 1, 0, *r) for r in rows], "doc_id string, page_no int, line_idx int, cand_ord int, model_name string, variant string, text string, conf double")
    assert reconcile.best_by_confidence(reconcile.primary_only(df, KEY), KEY).first().cand_ord == 1
    assert lines.agreement(df, KEY).first().agreement == "majority"
    merged = reconcile.merge_suggestions(df.withColumn("is_chosen", F.col("cand_ord") == 0), KEY).first()
    assert (merged.source_text, merged.suggestion_text) == ("alpha beta gamma", "alpha bets gamma")
    latin = spark.createDataFrame([("d", 1, 0, 0, "grc", "", "qυιδ διcις", 90.0), ("d", 1, 0, 1, "lat+grc", "", "quid dicis", 40.0)], df.schema)
    assert reconcile.script_aware(latin, KEY).first().cand_ord == 1
    greek = spark.createDataFrame([("d", 1, 0, 0, "grc", "", "λoγoς", 90.0), ("d", 1, 0, 1, "ell", "", "λόγος", 40.0)], df.schema)
    assert reconcile.script_aware(greek, KEY).first().cand_ord == 1


def test_long_lines_are_merged_whole(spark):
    """Lines of any length, and candidates longer than their line, vote on all words as difflib aligns them."""
    rng = random.Random(3)
    rows, want, read = [], {}, {}
    for k, (n, kinds) in enumerate([(513, 40), (600, 9), (1500, 300), (520, 1), (400, 50), (900, 900)]):
        own = [f"w{rng.randrange(kinds)}" for _ in range(n)]
        other = [w for w in ("x" if rng.random() < 0.1 else w for w in own) if rng.random() > 0.02]
        other[20:20] = ["y"] * 600 if k == 4 else []
        at = [{"a": (0, w, True)} for w in own]
        for what, i, j, c, d in difflib.SequenceMatcher(None, own, other, autojunk=False).get_opcodes():
            if what == "equal" or (what == "replace" and j - i == d - c):
                for p in range(j - i):
                    at[i + p] |= {v: (number, other[c + p], False) for number, v in enumerate("bc", 1)}
        rows += [(k, number, v, "", " ".join(own if v == "a" else other), v == "a") for number, v in enumerate("abc")]
        read |= {(k, p, v): x for p, r in enumerate(at) for v, x in r.items()}
        voted = " ".join(r["b"][1] if "b" in r else w for w, r in zip(own, at))
        want |= {k: voted} if voted != " ".join(own) else {}
    df = spark.createDataFrame(rows, "k long, cand_ord int, model_name string, variant string, text string, is_chosen boolean")
    assert {r.k: r.suggestion_text for r in reconcile.merge_suggestions(df, ["k"]).collect()} == want and len(want) > 4
    assert {(r.k, r.pos, r.voter): (r.ord, r.text, r.is_pivot) for r in reconcile.align(df, ["k"]).collect()} == read


def test_blocks_of_long_lines():
    """They are difflib's, whatever repeats; gaps that hold nothing but repeated or rare words take no more than linear room."""
    rng = random.Random(8)
    for kinds in (1, 2, 3, 20, 200) * 30:
        a = rng.choices(range(kinds), k=rng.choice((0, 1, 9, 60)))
        b = [w for w in (rng.randrange(kinds) if rng.random() < 0.2 else w for w in a) if rng.random() > 0.1]
        a, b = ([str(w) for w in x] for x in (a, b[len(b) // 2 :] + b[: len(b) // 2] if rng.random() < 0.3 else b))
        cut = [(i + p, j + p) for i, j, k in reconcile.long_blocks(a, b) for p in range(k)]
        assert cut == [(i + p, j + p) for i, j, k in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for p in range(k)]
    n = 20000
    assert reconcile.long_blocks(["x"] * n, ["x"] * (n + 5)) == [(0, 0, n), (n, n + 5, 0)]
    odd = [[f"{side}{k}" if k % 2 else "x" for k in range(n)] for side in "ab"]
    assert reconcile.long_blocks(*odd) == [*((k, k, 1) for k in range(0, n, 2)), (n, n, 0)]


def test_flags_of_lines(spark, monkeypatch):
    """Line by line, in tasks that forget, and by a join of tokens, flags are the same; the first shuffles no lines."""
    words = ["alpha", "Alpha,", "ἀρχῇ", "\u03b1\u0313ρχη", "ΛΟΓΟΣ", "λόγος.", "...", "«x»", "é", "e\u0301", "İ", "straße", "zz\x1cq", "n\xa0m", "\u2003", "😀b", ""]
    rng = random.Random(4)
    rows = [(f"l{k}", rng.choice(("grc", "en", "xx", None)), None if k % 41 == 0 else rng.choice((" ", "\t ", "\u3000")).join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(300)]
    lines_ = spark.createDataFrame(rows, "line_id string, script string, text string")
    lexicon = spark.createDataFrame([("grc", 0, "αρχη"), ("grc", 1, "αρχη"), ("grc", 0, "λόγος"), ("en", 0, "Alpha"), ("en", 0, "é"), ("en", 2, "q"), ("en", 0, None)], "lexicon string, layer int, form string")
    want = sorted(map(str, suggest.lexicon_flags(suggest.token_spans(lines_), lexicon).collect()))
    assert len(want) > 100
    assert sorted(map(str, suggest.line_flags(lines_, lexicon, 0).collect())) == want
    found = suggest.line_flags(lines_, lexicon)
    assert sorted(map(str, found.collect())) == want and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(suggest, "MOST_KNOWN", 2)
    assert sorted(map(str, suggest.line_flags(lines_, lexicon).collect())) == want
    assert suggest.line_flags(lines_, lexicon.limit(0)).count() == 0


def test_suggestions_never_change_what_was_read(spark):
    cases = [
        ("abc def", "def", "xyz", True, 4, 7, "abc xyz"), ("abc def", "def", "xyz", False, 4, 7, "abc def"), ("zz abc", "abc", "x", True, 0, 3, "zz x"),
        ("abc abc", "abc", "x", True, 1, 4, "abc abc"), ("abc", "abc", "whole", True, None, None, "whole"),
    ]
    df = spark.createDataFrame([c[:6] for c in cases], "line string, source string, to string, rev boolean, s int, e int")
    got = df.select(suggest.apply_suggestion(*(F.col(c) for c in ("line", "source", "to", "rev", "s", "e"))).alias("v")).collect()
    assert [r.v for r in got] == [c[6] for c in cases]
    spans = suggest.token_spans(spark.createDataFrame([("l", "  ab ç\td ")], "line_id string, text string")).collect()
    assert [(r.token, r.start, r.end) for r in spans] == [("ab", 2, 4), ("ç", 5, 6), ("d", 7, 8)]


def test_confusion(spark):
    df = spark.createDataFrame([("Aογος",), ("",), ("ο" * 65,)], "token string")
    got = [r.c for r in df.select(suggest.confusion_candidates(F.col("token")).alias("c")).collect()]
    assert "Αογος" in got[0] and got[0] == sorted(got[0]) and "Aογος" not in got[0] and got[1] == [] and got[2] == []
    pairs = set(suggest.substitutions())
    assert all((b, a) in pairs for a, b in pairs)


def test_promotion(spark):
    make = lambda rows: spark.createDataFrame(rows, "script string, cer double, samples int")
    parent = make([("a", 0.2, 9), ("b", 0.1, 9)])
    verdict = lambda rows, p=parent, **k: evaluate.promotion(make(rows), p, **k).first().verdict
    assert verdict([("a", 0.1, 9), ("b", 0.1, 9)]) == "promote"
    assert verdict([("a", 0.1, 9), ("b", 0.1, 9)], evaluated_on="dev") == "not_held_out"
    assert verdict([("a", 0.1, 3)]) == "too_few_samples"
    assert verdict([("a", 0.1, 9), ("c", 0.01, 9)]) == "script_regressed"
    assert verdict([("a", 0.0, 99)], make([("a", 0.0, 9)])) == "parent_is_perfect"
    assert verdict([("a", 0.1999, 99), ("b", 0.1, 9)]) == "too_small"


def test_sources(spark):
    tsv = spark.createDataFrame([("d", 1, ["5", "5", "4", "5"], ["α", " ", "", "x"], ["90", "80", "-1", "nan?"], ["1"] * 4, ["2"] * 4, ["3", "3", "30", "3"], ["4"] * 4)], "doc_id string, page_no int, level array<string>, text array<string>, conf array<string>, left array<string>, top array<string>, width array<string>, height array<string>")
    assert [(r.block_id, r.text, r.w) for r in parsers.tesseract_words(tsv).collect()] == [("word-0", "α", 3)]
    assert [(r.line_id, r.w) for r in parsers.tesseract_lines(tsv).collect()] == [("line-1", 30)]
    reply = spark.createDataFrame([("d", 1, "5,10,15,20|λόγος\nno\n1,2|x\n7,7,7,7|b", 2.0)], "doc_id string, page_no int, payload string, scale double")
    assert [(r.x, r.w, r.text) for r in parsers.vlm_reply(reply).orderBy("idx").collect()] == [(2, 6, "λόγος"), (4, 1, "b")]


def test_sinks_are_verbatim(spark):
    df = page(spark, [("a <b> & \"c\"", 1, 2, 3, 4), ("δ", 5, 6, 7, 8)])
    body = sinks.alto(df).first().body
    import xml.etree.ElementTree as ET

    found = [s.attrib["CONTENT"] for s in ET.fromstring(body.split("?>", 1)[1]).iter() if s.tag.endswith("String")]
    assert found == ['a <b> & "c"', "δ"]
    assert [u.text for u in ET.fromstring(sinks.page_xml(df).first().body.split("?>", 1)[1]).iter() if u.tag.endswith("Unicode")] == found


def test_circuit_breaker(spark):
    calls = [(0, 0.0, "error"), (1, 1.0, "error"), (2, 2.0, "error"), (3, 3.0, "ok"), (4, 33.0, "error"), (5, 40.0, "ok"), (6, 64.0, "ok"), (7, 65.0, "ok")]
    df = spark.createDataFrame([("e", *c) for c in calls], "engine string, seq long, t double, outcome string")
    got = [(r.state, r.allowed) for r in resilience.circuit_breaker(df).orderBy("seq").collect()]
    assert got == [("closed", True)] * 3 + [("open", False), ("half_open", True), ("open", False), ("half_open", True), ("closed", True)]


def test_stream_of_pages(spark, tmp_path):
    spark.range(10).withColumn("text", F.lit("x")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.run_pages(stream, lambda b: b.filter("id % 2 = 0"), lambda b, n: seen.extend(r.id for r in b.collect())).awaitTermination()
    assert sorted(seen) == [0, 2, 4, 6, 8]


def test_review(spark):
    df = page(spark, [("a", 0, 0, 1, 9), ("b", 0, 9, 1, 9), ("c", 0, 18, 1, 9)])
    over = spark.createDataFrame([("l0", "edited", "E"), ("l0", "accepted", "A"), ("l1", "edited", "B"), ("zz", "accepted", "q")], "line_id string, store string, text string")
    got = {r.line_id: (r.final_text, r.touched, r.text) for r in review.final_text(df, over).collect()}
    assert got == {"l0": ("A", True, "a"), "l1": ("B", True, "b"), "l2": ("c", False, "c")}
    assert {r.line_id: r.cer for r in review.reader_accuracy(df, over).collect()} == {"l0": 1.0, "zz": 1.0}


def test_every_query_has_a_stable_name():
    assert all(n.split("_")[1][:2].isdigit() for n in registry.QUERIES)
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
