"""Each corpus operator on hand-made rows: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, embeddings, licences, lmscore, mixing, neardup, pii, rindex, suffixdedup, toxicity
from quire.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, _key string"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long, shared = words(1, 6000), words(2, 30)
    texts = [
        (1, "See " + shared + " end"), (2, shared), (2, shared), (3, None), (4, ""), (5, "   \n\t"), (6, "one two"), (6, "other text"),
        (None, shared + " tail words"), (7, long), (8, long + " more"), (9, "a\x00b é 😀 " + shared.upper()), (10, "aaaa " * 200),
    ]
    return spark.createDataFrame([(i, t, "en", None if i == 7 else "s", None, 5, 0.5, "k") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def as_bytes(t):
    return (t or "").encode()


def brute_removed(rows):
    """Operator 10 by a dictionary of all windows."""
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        b = as_bytes(t)
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, math.inf), key(i))
    out = []
    for i, t in rows:
        b = as_bytes(t)
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffixdedup.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_removed(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got if r.n_removed < r.n_bytes or not r.n_bytes)
    assert suffixdedup.deduplicate(none).count() == 0


def test_suffix_dedup_random_and_parts(spark, monkeypatch):
    """Many stretches of one key, split over several small indexes."""
    monkeypatch.setattr(suffixdedup, "INDEX_SYMBOLS", 4000)
    rng = random.Random(3)
    base = [words(k, 40) for k in range(4)]
    rows = []
    for i in range(60):
        b = rng.choice(base)
        lo, hi = sorted(rng.sample(range(len(b)), 2))
        rows.append((i, words(100 + i, rng.randint(0, 6)) + b[lo:hi] + rng.choice(base)[lo:hi]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffixdedup.deduplicate(df, with_text=False).collect()), key=str)
    assert got == brute_removed(rows)


def test_suffix_dedup_of_texts_that_repeat_themselves(spark):
    """Stretches longer than an index, of periods that do and don't divide their pieces."""
    rows = [(1, "a" * 1_100_000), (2, "x" + "a" * 60 + "y"), (3, "abcdefg" * 160_000), (4, "zz" + "efgabcd" * 900 + "a" * 49), (5, "a" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffixdedup.deduplicate(df, with_text=False).collect()), key=str)
    assert got == brute_removed(rows)


def test_suffix_dedup_of_a_passage_in_many_contexts(monkeypatch):
    """What the parts of a key pass on is more than an index holds."""
    monkeypatch.setattr(rindex, "MOST", 1 << 13)
    monkeypatch.setattr(suffixdedup, "INDEX_SYMBOLS", 1 << 12)
    rng = random.Random(8)
    context = lambda: bytes(rng.choice(b"abcdefghij") for _ in range(25))
    pool = [context() + b"one passage of 24 bytes." + context() for _ in range(700)]
    # Rows repeat, share some of their windows, or are alone.
    texts = [rng.choice([rng.choice(pool), context()[:12] + rng.choice(pool)[12:], rng.choice(pool)[:60] + context()[:14]]) for _ in range(1500)]
    columns = [[1] * 1500, list(range(1500)), list(range(1500)), [0] * 1500]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(texts, pa.binary())], names=["key", "doc_id", "text_key", "start", "bytes"])
    gone = {i: bytearray(len(t)) for i, t in enumerate(texts)}
    for found in suffixdedup._index(iter([batch])):
        for r in found.to_pylist():
            gone[r["doc_id"]][r["start"] : r["stop"]] = b"\1" * (r["stop"] - r["start"])
    want = brute_removed([(i, t.decode()) for i, t in enumerate(texts)])
    assert sorted(((i, sum(g)) for i, g in gone.items()), key=str) == sorted(((w[0], w[2]) for w in want), key=str)
    assert sum(w[2] < w[1] for w in want) > 300


def brute_contamination(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    import re

    split = lambda t: re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for i, t in rows:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])] - {None}
        listed = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), listed, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [0, 10**6])
def test_decontamination(spark, docs, none, most):
    shared = words(2, 30).split()
    items = [(1, " ".join(shared[3:20])), (2, " ".join(shared[10:23]) + " x"), (2, " ".join(shared[10:23])), (3, "One, TWO!"), (4, None), (5, "..."), (6, "é"), (7, words(1, 6000)[-200:]), (None, "other"), (8, "aaaa " * 20)]
    items_df = spark.createDataFrame([(*x, "doc") for x in items], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(docs, items_df, most).drop("_text_key").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_contamination(rows, items)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert decontaminate.contamination(none, items_df).count() == 0
    assert decontaminate.contamination(docs, items_df.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.remove_contaminated(docs, items_df)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not w[-1] for w in want)


def test_mixing(docs, none):
    got = mixing.mix(docs, keep=docs.columns)
    rows = got.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(got.columns)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    for source in ("s", None):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].target <= 2 * own[0].source_size
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p < 1 for p in placed)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, keep=docs.columns).collect()))
    assert mixing.mix(none).count() == 0


def test_source_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 0), ("d", 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    left, open_ = 1.5 * 1210, {"a": 5.0, "b": 2.0, "c": 1.0, "d": 5.0, None: 2.0}
    limit = {"a": 20.0, "b": 200.0, "c": 200.0, "d": 2000.0, None: 0.0}
    want = {}
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > limit[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = limit[s]
            left -= limit[s]
            del open_[s]
    assert got == pytest.approx(want)


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a <b> # \\ </turn>\n### user: "), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 0, "user", "hi"), (3, 1, "assistant", "other"),
        (4, 1, "assistant", None), (4, None, None, "x"), (5, 0, "a:b\n", ""), (5, 0, "a:b\n", ""), (None, 0, "user", "é😀"), (6, 0, "user", "long " * 30000), (6, 1, "assistant", "z"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = [(a, b) for _, _, a, b in turns]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.format_turn(a, b)[0]) for a, b in turns)
    packs = chat.pack(chat.conversations_of(df)).collect()
    # Shared turns are there once, and positions go on from the ancestors.
    text = "".join(p.text for p in packs)
    assert text.count("### user: hi<") == 1 and text.count("other") == 1
    for p in packs:
        for node in p.nodes:
            assert node.position == sum(a.stop - a.start for a in node.ancestors)
    assert chat.digests(df.limit(0)).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(300):
        body = [words(1000 + i * 7 + k, rng.randint(3, 9)) for k in range(rng.randint(1, 8))]
        bad = i % 3 == 0
        if bad:
            body[rng.randrange(len(body))] += " you " + rng.choice(["dolt", "oafish", "cretinous"])
        texts.append((i, ". ".join(body) + "."))
        labels.append((i, int(bad)))
    texts += [(1000, None), (1001, ""), (1001, ""), (None, "what a dolt"), (1002, words(5, 20000))]
    df = spark.createDataFrame([(*t, 0.1) for t in texts], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (5, None), (6, 7)], "doc_id long, toxic int")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    model = toxicity.train(toxicity._learned_from(df), lab)
    got = {(r.doc_id, k): r for k, r in enumerate(toxicity.score(df, model, ["doc_id"]).collect())}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    right = sum((r.score >= 0.5) == (i % 3 == 0) for (i, _), r in got.items() if i in held)
    assert right >= 0.9 * len(held)
    for (i, _), r in got.items():
        for s in r.offending:
            if i in held and i % 3 == 0:
                assert any(w in dict(texts)[i].encode()[s.start : s.stop].decode() for w in ("dolt", "oaf", "cretin"))
    kept = toxicity.remove_toxic(df, lab)
    assert kept.columns == df.columns and kept.filter("doc_id in (1000, 1001, 1002)").count() == 4
    assert toxicity.remove_toxic(none, lab).count() == 0
    assert toxicity.remove_toxic(df, lab.limit(0)).count() == len(texts)


def test_toxicity_of_long_texts(spark):
    """Calm sentences add nothing up, however many there are, and one toxic sentence among them is found."""
    rng = random.Random(6)
    pool = words(7, 400).split()
    calm = lambda n: ". ".join(" ".join(rng.choice(pool) for _ in range(5)) for _ in range(n)) + "."
    texts, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        texts.append((i, calm(rng.randint(1, 8)) + " you " + rng.choice(["dolt", "cretin"]) + "." if bad else calm(rng.randint(2, 12))))
        labels.append((i, int(bad)))
    long = {1000: calm(200_000 // 31), 1001: calm(1_000_000 // 31)}
    long |= {k + 10: t[: len(t) // 2 + 1] + " you dolt. " + t[len(t) // 2 + 1 :] for k, t in long.items()}
    df = spark.createDataFrame(texts + sorted(long.items()), "doc_id long, text string")
    kept = toxicity.remove_toxic(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(r.doc_id for r in kept.filter("doc_id >= 1000").select("doc_id").collect()) == [1000, 1001]


def test_lm_is_a_distribution_and_base_is_exact(spark, docs, none):
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    got = lmscore.score(docs, training).collect()
    rows = [(r.doc_id, as_bytes(r.text).lower().split() + [b"\0"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = {}
    for i, w in rows:
        for x in w if not held(i) else ():
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for i, w in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert lmscore.score(none, training).count() == 0
    assert lmscore.score(docs, F.lit(False)).filter("n_known = 0").count() == len(rows)


def test_lm_sums_to_one(spark):
    """After each context, the probabilities of all words, the end and the unknown add up to one."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").select(F.col("text").cast("binary").alias("bytes"))
    model, _, _ = lmscore.train(df, 0, 3, 1e-5, 4e-6, 0.5)
    assert len(model.keys) == 3 and len(model.keys[2]) > 20
    arcs, weight, following, back, fail = model.tables()

    def log_p(state, w):
        total = 0.0
        while (state * model.width + w) not in arcs:
            total += back[state]
            state = fail[state]
        return total + weight[arcs[state * model.width + w]]

    for state in range(len(back)):
        lost, s = 0.0, state
        while s:
            lost += back[s]
            s = fail[s]
        unknown = 10 ** (lost - model.total)
        assert sum(10 ** log_p(state, w) for w in range(model.width)) + unknown == pytest.approx(1.0)


def test_near_duplicates(spark, docs, none, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 5)
    base = words(9, 120).split()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(40):
        w = list(base)
        w[3 * k % 120] = f"x{k}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_links int, class_id string")
    got = neardup.join(df).collect()
    sets = []
    for _, t in rows:
        w = as_bytes(t).lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    key = [neardup.LAST_ID if i is None else i for i, _ in rows]
    link = [[j for j, b in enumerate(sets) if j != k and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9] for k, a in enumerate(sets)]
    least = list(key)
    for _ in rows:
        for k in range(len(rows)):
            least[k] = min([least[k], *(least[j] for j in link[k])])
    want = sorted((key[k], len(link[k]), least[k]) for k in range(len(rows)))
    back = lambda i: neardup.LAST_ID if i is None else i
    assert sorted((back(r.doc_id), r.n_links, back(r.component_id)) for r in got) == want
    kept = neardup.remove_near_duplicates(df)
    assert kept.columns == df.columns
    # One for each group, and all texts without words.
    # Two texts are numbered 6 and aren't linked.
    assert kept.count() == len({c for c, s in zip(least, sets) if s}) + sum(not s for s in sets) + 1
    assert neardup.join(none).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 40)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 600)] + 0.12 * rng.normal(size=(600, 16))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(608, [0.6, 0.8]), (609, [0.6, 0.8]), (610, [0.8, -0.6])]
    rows += [(600, rows[0][1]), (600, rows[0][1]), (601, None), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] * 16), (605, [1.0, 2.0]), (606, []), (607, [float("inf")] * 16), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, class string")
    got = embeddings.join(df).collect()
    good = [k for k, (_, v) in enumerate(rows) if v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    u = np.array([rows[k][1] for k in good], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    key = np.array([embeddings.LAST_ID if rows[k][0] is None else rows[k][0] for k in good])
    least = key.copy()
    for _ in range(50):
        least = np.minimum(least, np.where(linked, least[None, :], embeddings.LAST_ID).min(1))
    back = lambda i: embeddings.LAST_ID if i is None else i
    # Vectors of two components: 605, 608 and 609 are near one another.
    want = {k: (0, k) for k in (601, 602, 603, 604, 606, 607, 610)}
    assert np.dot([1, 2], [0.6, 0.8]) / math.sqrt(5) >= 0.95
    want |= {k: (2, 605) for k in (605, 608, 609)}
    found = sorted((back(r.vec_id), r.n_links, back(r.component_id)) for r in got)
    exact = sorted([(int(k), int(n), int(c)) for k, n, c in zip(key, linked.sum(1), least)] + [(k, *v) for k, v in want.items()])
    assert sum(f[1] for f in found) >= 0.9 * sum(e[1] for e in exact) and all(f[1] <= e[1] for f, e in zip(found, exact))
    assert found == exact
    assert embeddings.join(df.limit(0)).count() == 0
    assert embeddings.join(df.filter("vec_id = 601")).collect()[0].n_links == 0


def test_embeddings_of_one_group_in_many_lists(spark, monkeypatch):
    """A third of the vectors are near copies of one, spread over more lists than any fixed number of probes."""
    monkeypatch.setattr(embeddings, "LIST_SIZE", 10)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    x = rng.normal(size=(1500, 24))
    x[:500] = centre + 0.25 * rng.normal(size=(500, 24))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.join(df).collect()}
    assert want.sum() > 10_000
    assert [got[k] for k in range(len(x))] == want.tolist()


def test_pii(spark, docs, none):
    texts = [
        "mail a.b@c-d.example.org, x@y.z1_q@w.v or @no", "ip 1.22.333.4 and 10.0.0.255.7", "card 4111 1111 1111 1111 or 4111 1111 1111 1112", "call +1 (743) 555-3824 now", "IBAN DE89 3704 0044 0532 0130 00",
        "ssn 123-45-6789", "123-45-6789 alone", "é😀 a@b.c", "1" * 30000, "a" * 30000 + "@b.cc", "+1 " + "2-" * 9000, None, "",
    ]
    df = spark.createDataFrame([(k, t, "p") for k, t in enumerate(texts)], "doc_id long, text string, pii string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.pii] for r in pii.detect(df).collect()}
    assert found[0] == [("email", "a.b@c-d.example.org"), ("email", "x@y.z1"), ("email", "_q@w.v")]
    assert found[1] == [("ip", "10.0.0.255")]
    assert found[2] == [("card", "4111 1111 1111 1111")] or ("card", "4111 1111 1111 1111") in found[2]
    assert found[3] == [("phone", "+1 (743) 555-3824")]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found[4]
    assert found[5] == [("ssn", "123-45-6789")] and found[6] == []
    assert found[7] == [("email", "a@b.c")]
    assert found[8] == [] and found[9] == [("email", texts[9])] and found[11] == [] and found[12] == []
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[7] == "é😀 [EMAIL]" and clean[3] == "call [PHONE] now" and clean[11] is None
    assert pii.redact(docs).columns == docs.columns and pii.redact(none).count() == 0


def test_licences(spark, docs, none):
    lines = [words(50 + k, 12) for k in range(200)]
    model = licences.train(lines)
    texts = [
        (1, "intro\nReleased under the MIT License.\nend"), (2, "This work is licensed under the GNU General Public License, version 3."), (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, None), (4, ""), (5, "She has held a driving license for years."), (6, words(1, 5000)), (7, "redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ]
    df = spark.createDataFrame([(*t, "f") for t in texts], "doc_id long, text string, family string")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.scan(df, model).collect())
    assert got == [(1, 1, "mit"), (2, 0, "gpl"), (7, 0, "bsd")]
    assert licences.scan(none, model).count() == 0 and licences.scan(docs, model).count() == 0
    # Templates' own sentences, each left as it is, are found.
    every = [(k, t, f) for k, (t, f) in enumerate((t, f) for f, ts in licences.TEMPLATES.items() for t in ts)]
    frame = spark.createDataFrame(every, "doc_id long, text string, want string")
    hits = {r.doc_id: r.family for r in licences.scan(frame, model).collect()}
    assert sum(hits.get(k) == f for k, _, f in every) >= 0.9 * len(every)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
