"""Whole queries without SQL against plain Python, over a small folder of tables."""

import difflib
import random

import pytest

from quire.functions import images, text
from quire.operators import reconcile
from quire.plans import further, registry, testbed
from tests.test_text import table_edits


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioxtn,") for _ in range(rng.randint(1, 7)))
    docs = [(i, "\n".join(" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))), ("en", "de", "fr")[i % 3], ("aa", "bb")[i % 2], 0) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, "ax ten")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    events = [(i, i % 7, "error" if i % 3 else "view", float(i)) for i in range(300)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_seconds(event_id * 7) as ts").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def rows(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).collect()


def all_lines(spark, sf_dir):
    return testbed.lines(spark, sf_dir).collect()


def test_word_error(spark, sf_dir):
    swap = str.maketrans("eio", "oei")
    want = {}
    for r in all_lines(spark, sf_dir):
        a, b = r.text.split(), r.text.translate(swap).split()
        want[r.doc_id, r.line_idx] = table_edits(a, b) / len(a) if a else float(bool(b))
    got = {(r.doc_id, r.line_idx): r.wer for r in rows(spark, sf_dir, "fn_22_word_error")}
    assert got == pytest.approx(want) and len(set(want.values())) > 5


def test_similarity(spark, sf_dir):
    swap = str.maketrans("eio", "oei")
    want = {r.line_id: difflib.SequenceMatcher(None, r.text, r.text.translate(swap)).ratio() for r in all_lines(spark, sf_dir)}
    assert {r.line_id: r.ratio for r in rows(spark, sf_dir, "fn_15_similarity")} == pytest.approx(want)


def readings(spark, sf_dir):
    """For each line what each voter reads at each word of the chosen candidate, and the candidates' texts."""
    lines = {}
    for r in testbed.candidates(spark, sf_dir).collect():
        lines.setdefault((r.doc_id, r.page_no, r.line_idx), {})[r.cand_ord] = (r.model_name + ("@" + r.variant if r.variant else ""), r.text)
    out = {}
    for key, found in lines.items():
        name, chosen = found[1]
        pivot, at = chosen.split(), {}
        for p, w in enumerate(pivot):
            at[p, name] = (0, w, True)
        for number, k in enumerate((k for k in sorted(found) if k != 1), 1):
            voter, line = found[k]
            for what, a, b, c, d in difflib.SequenceMatcher(None, pivot, line.split(), autojunk=False).get_opcodes():
                if what == "equal" or (what == "replace" and b - a == d - c):
                    for i in range(b - a):
                        at[a + i, voter] = (number, line.split()[c + i], False)
        out[key] = (chosen, at)
    return out


def test_aligned_readings(spark, sf_dir):
    want = {(*key, p, v, *x) for key, (_, at) in readings(spark, sf_dir).items() for (p, v), x in at.items()}
    got = [(r.doc_id, r.page_no, r.line_idx, r.pos, r.voter, r.ord, r.text, r.is_pivot) for r in rows(spark, sf_dir, "join_11_align_readings")]
    assert len(got) == len(set(got)) and set(got) == want


def test_merged_suggestions(spark, sf_dir):
    want = {}
    for key, (chosen, at) in readings(spark, sf_dir).items():
        words = []
        for p in sorted({p for p, _ in at}):
            votes, own = {}, None
            for (q, _), (_, w, pivot) in at.items():
                if q == p:
                    votes[w] = votes.get(w, 0) + 1
                    own = w if pivot else own
            words.append(min(votes, key=lambda w: (-votes[w], w != own, w)))
        if words and " ".join(words) != " ".join(chosen.split()):
            want[key] = " ".join(words)
    got = {(r.doc_id, r.page_no, r.line_idx): r.suggestion_text for r in rows(spark, sf_dir, "win_11_merge_suggestions")}
    assert want and got == want


def test_running_heads(spark, sf_dir):
    books = {}
    for r in all_lines(spark, sf_dir):
        books.setdefault(r.source, {}).setdefault(r.doc_id, []).append((r.y, r.line_idx, r.text, r.w, r.h))
    shape = {}
    want = {}
    for source, book in books.items():
        slots = {}
        for doc, own in book.items():
            first = next(x for x in own if x[1] == 0)
            own = own + [(first[0] - 60, -2, f"{source} {doc}", first[3], first[4]), (first[0] - 30, -1, f"— {doc % 1000} —", first[3], first[4])]
            kept = sorted(x for x in own if x[2].strip(" ") and x[4] <= 2 * x[3])
            slots[doc] = [("top", x) for x in kept[:2]] + [("bottom", x) for x in kept[::-1][:2]]
        order = sorted(book)
        shaped = sorted({x[2] for s in slots.values() for _, x in s})
        df = spark.createDataFrame([(k, x) for k, x in enumerate(shaped)], "k long, t string")
        shape |= {shaped[r.k]: (r.s, r.folio, r.note) for r in df.select("k", text.normalize_candidate(df.t).alias("s"), text.is_folio(df.t).alias("folio"), text.is_footnote(df.t).alias("note")).collect()}
        for i, doc in enumerate(order):
            for side, (_, idx, line, _, h) in slots[doc]:
                mine, folio, note = shape[line]
                best = 1.0 if folio else 0.0
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(order) and not folio and not note:
                        for other_side, (_, _, other, _, oh) in slots[order[j]]:
                            theirs = shape[other][0]
                            if other_side == side and max(h, oh) <= 1.5 * max(min(h, oh), 1) and abs(len(mine) - len(theirs)) <= 4:
                                best = max(best, difflib.SequenceMatcher(None, mine, theirs).ratio())
                if best >= 0.9:
                    want[doc, idx] = max(best, want.get((doc, idx), 0))
    got = {(r.doc_id, r.line_idx): r.similarity for r in rows(spark, sf_dir, "join_08_running_heads")}
    assert got == pytest.approx(want) and {i for _, i in want} >= {-2, -1}


@pytest.mark.parametrize("name, work", [("img_02_adaptive", images.adaptive_gaussian), ("img_03_otsu", images.otsu), ("img_04_deskew", images.deskew), ("img_05_despeckle", images.despeckle)])
def test_images(spark, sf_dir, name, work):
    got = {r.doc_id: (r.total, r.failed) for r in rows(spark, sf_dir, name)}
    assert got == {i: (int(work(further._pixels(i)).sum(dtype=int)), False) for i in range(40)}


def test_cached_calls(spark, sf_dir):
    got = rows(spark, sf_dir, "str_06_cached_calls")
    assert len(got) == 300 and 0 < sum(r.hit for r in got) < 300


def test_pipeline_suggestions(spark, sf_dir):
    """Each is a token of its line that the lexicon doesn't know, or a merged line that differs from it."""
    lines = {r.line_id: r.text for r in rows(spark, sf_dir, "pipe_01_page_lines")}
    known = {r.form.strip(text.EDGE).lower() for r in testbed.lexicon(spark, sf_dir).collect()}
    got = rows(spark, sf_dir, "pipe_01_suggestions")
    for r in got:
        if r.reason == "alignment_merge":
            assert r.source_text == lines[r.line_id] and r.suggestion_text != " ".join(r.source_text.split())
        else:
            assert lines[r.line_id][r.start : r.end] == r.source_text and r.source_text.strip(text.EDGE).lower() not in known
    flagged = {(r.line_id, r.start) for r in got if r.start is not None}
    scripts = {f"p{r.doc_id}-line-{r.line_idx}": r.script for r in all_lines(spark, sf_dir)} | {r.line_id: r.script for r in all_lines(spark, sf_dir)}
    for line, whole in lines.items():
        at = 0
        for token in whole.split():
            at = whole.index(token, at)
            bare = token.strip(text.EDGE).lower()
            assert ((line, at) in flagged) == (scripts[line] in ("en", "de") and bare != "" and bare not in known)
            at += len(token)


@pytest.mark.parametrize("name", ["agg_01_compose_lines", "pipe_01_page_lines", "udf_01_recorded_blocks"])
def test_words_of_pages_are_not_shuffled(spark, sf_dir, name):
    """Rows of single words are several times the size of their texts."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "block_idx" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "Window" in x)


@pytest.mark.parametrize("name, reads", [("pipe_01_page_failures", 0), ("pipe_01_clean_pages", 0), ("pipe_01_page_lines", 1), ("udf_04_plug_in_choice", 1), ("udf_05_assemble", 1)])
def test_candidates_are_made_once(spark, sf_dir, name, reads):
    """Failures come from the layout and the engines' runs; lines and their agreement from one reading of the pages."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == reads


@pytest.mark.parametrize("name", ["pipe_01_page_failures", "pipe_01_clean_pages", "udf_04_plug_in_choice", "udf_05_assemble", "pipe_01_suggestions"])
def test_pages_are_joined_after_texts_are_split(spark, sf_dir, name):
    """No join of pages lies below what splits a text, so that whole texts aren't shuffled by page."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    for k, line in enumerate(plan):
        if "Generate posexplode(split(" in line:
            below = next((j for j in range(k + 1, len(plan)) if depth[j] <= depth[k]), len(plan))
            assert not any("Join" in x for x in plan[k:below])


def test_merging_gathers_candidates_once(spark, sf_dir):
    """Readings of single words take part in no exchange, and the vote inside a line is that of the rows."""
    plan = registry.QUERIES["win_11_merge_suggestions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") <= 2 and "pos#" not in plan
    rng = random.Random(9)
    line = lambda: " ".join("x" if rng.random() < 0.4 else w for w in "abcdef"[: rng.randint(4, 6)])
    rows = [(k, c, rng.choice(("m", "n", "o", None)), rng.choice(("", "v")), line(), c == k % 3) for k in range(300) for c in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "k long, cand_ord int, model_name string, variant string, text string, is_chosen boolean")
    won = {}
    for r in reconcile.vote(reconcile.align(df, ["k"]), ["k"]).orderBy("k", "pos").collect():
        won.setdefault(r.k, []).append(r.text)
    chosen = {r[0]: r[4] for r in rows if r[5]}
    want = {k: " ".join(w) for k, w in won.items() if " ".join(w) != chosen[k]}
    got = {r.k: (r.source_text, r.suggestion_text) for r in reconcile.merge_suggestions(df, ["k"]).collect()}
    assert len(want) > 10 and got == {k: (chosen[k], w) for k, w in want.items()}
