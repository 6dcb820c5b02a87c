"""Text functions against plain Python, Greek included."""

import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.plans import registry, testbed

GREEK = [chr(c) for c in (*range(0x370, 0x400), *range(0x1F00, 0x2000)) if unicodedata.category(chr(c))[0] == "L" and unicodedata.normalize("NFC", chr(c)) == chr(c)]


def run(spark, column, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, t string")
    return [r.v for r in df.select("k", column(F.col("t")).alias("v")).orderBy("k").collect()]


def monotonized(t):
    parts = "".join(c for c in unicodedata.normalize("NFD", t) if c not in text.REMOVED_MARKS)
    return unicodedata.normalize("NFC", parts)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_monotonize_all_greek_and_latin(spark):
    letters = GREEK + [chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFC", chr(c)) == chr(c)]
    rng = random.Random(1)
    values = letters + ["".join(rng.choice(letters) for _ in range(8)) for _ in range(300)]
    assert run(spark, text.monotonize, values) == [monotonized(v) for v in values]


def test_normal_forms(spark):
    values = ["abc", "é", "ἄ", None, ""]
    assert run(spark, text.nfc, values) == ["abc", "é", "ἄ", None, ""]
    assert run(spark, text.nfd, values) == ["abc", "é", unicodedata.normalize("NFD", "ἄ"), None, ""]


def test_candidate_shapes(spark):
    values = ["12", "xiv", "page 45", "book iii", "normal text", "ΛΟΓΟΣ 12", "Éa"]
    assert run(spark, text.normalize_candidate, values) == ["@", "@", "page @", "book @", "normal text", "λογος @", "ea"]


def test_folios_and_footnotes(spark):
    assert run(spark, text.is_folio, ["- 40 -", "— ΛΦ —", "－1－", "- 12345 -", "40"]) == [True, True, True, False, False]
    assert run(spark, text.is_footnote, ["1 see above", "12 ABC", "see 1", "1234 abc"]) == [True, False, False, False]


def test_diacritics(spark):
    assert run(spark, text.diacritic_violations, ["ἄ", "ἀ̔", "ά̀", "abc", ""]) == [[], ["multiple_breathing_marks"], ["multiple_accent_marks"], [], []]
    assert run(spark, text.dangling_marks, ["́a", "á", "a ́"]) == [1, 0, 1]


def test_letters(spark):
    assert run(spark, text.latin_evidence, ["Quod", "ΑΒΓ", "AB"]) == [2, 0, 0]
    assert run(spark, text.greek_letters, ["ἀβγ", "abc"]) == [3, 0]
    assert run(spark, text.is_latin_dominant, ["quid dicis", "λόγος", "ab"]) == [True, False, False]
    assert run(spark, text.is_greek_form, ["λόγος", "λόγος1", ""]) == [True, False, False]


def test_error_rates(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("αβγ abc") for _ in range(rng.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(200)] + [("", ""), ("", "x"), ("x", "")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string")
    got = df.select("k", text.character_error_rate(F.col("a"), F.col("b")).alias("c"), text.word_error_rate(F.col("a"), F.col("b")).alias("w"), text.similarity(F.col("a"), F.col("b")).alias("s")).orderBy("k").collect()
    for (a, b), r in zip(pairs, got):
        rate = lambda x, y: (0.0 if not y else 1.0) if not x else edits(x, y) / len(x)
        assert r.c == pytest.approx(rate(a, b)) and r.w == pytest.approx(rate(a.split(), b.split()))
        assert r.s == pytest.approx(0.0 if abs(len(a) - len(b)) > 4 else difflib.SequenceMatcher(None, a, b).ratio())


def test_splits_are_stable_and_near_their_shares(spark):
    ids = [f"page-{k}" for k in range(3000)]
    got = run(spark, text.assign_split, ids)
    assert got == run(spark, text.assign_split, ids)
    assert abs(got.count("train") / 3000 - 0.8) < 0.03 and abs(got.count("dev") / 3000 - 0.1) < 0.02


def test_similarity_query_compares_whole_lines(spark):
    lines = {r.line_id: r.text for r in testbed.lines(spark, "/root/testdata/sf0.001").collect()}
    got = {r.line_id: r.ratio for r in registry.QUERIES["fn_15_similarity"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(lines) and max(map(len, lines.values())) > 40
    swap = str.maketrans("eio", "oei")
    assert all(got[k] == pytest.approx(difflib.SequenceMatcher(None, x, x.translate(swap)).ratio()) for k, x in lines.items())


def table_edits(a, b):
    """Edit distance by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_as_bits(spark):
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(n))
    pairs = [(some(rng.randint(0, 90)), some(rng.randint(0, 90))) for _ in range(300)]
    pairs += [(p, p[: rng.randint(0, 90)] + "x" + p[rng.randint(0, 90) :]) for p, _ in pairs] + [("", ""), ("a", ""), ("", "ab")]
    assert all(text.edits(a, b) == table_edits(a, b) for a, b in pairs)
    long = some(900)
    rows = [*pairs[:40], (long, long[:300] + long[350:] + "zz"), (None, "a"), (long, None)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.distance(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == (None if r.a is None or r.b is None else table_edits(r.a, r.b)) for r in df.collect())


def test_word_error_rate(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(7000)]
    many = rng.sample(words, 7000)
    rows = [("a b c", "a x c"), ("", ""), ("", "a"), ("a b", "a b"), (" ".join(many), " ".join(many[:3000] + ["new"] + many[3001:])), (" ".join(many[:200]), " ".join(reversed(many[:200])))]
    got = [r.e for r in spark.createDataFrame(rows, "a string, b string").select(text.word_error_rate(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got[:4] == [1 / 3, 0.0, 1.0, 0.0] and got[4] == 1 / 7000
    assert got[5] == table_edits(many[:200], many[:200][::-1]) / 200
