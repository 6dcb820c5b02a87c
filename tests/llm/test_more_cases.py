"""Scores against a plain backoff model, several buckets, redaction, licences and the pipeline on odd tables."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chat, licences, lmscore, pii, queries, rindex, suffixdedup
from tests.llm.test_small_cases import brute_removed, words


class Backoff:
    """Absolute discounting over all n-grams that are there twice, by recursion."""

    def __init__(self, texts, order=3, discount=0.5):
        self.order, self.discount = order, discount
        # Every text follows an end.
        lines = [["</s>", *t.split(), "</s>"] for t in texts]
        self.words = {}
        for line in lines:
            for w in line[1:]:
                self.words[w] = self.words.get(w, 0) + 1
        self.n, self.v = sum(self.words.values()), len(self.words)
        frequent = {w for w, c in self.words.items() if c >= 2} | {"</s>"}
        self.grams = {(w,): self.words.get(w, 0) for w in frequent}
        for n in range(2, order + 1):
            found = {}
            for line in lines:
                for k in range(len(line) - n + 1):
                    g = tuple(line[k : k + n])
                    if all(w in frequent for w in g):
                        found[g] = found.get(g, 0) + 1
            self.grams |= {g: c for g, c in found.items() if c >= 2 and g[:-1] in self.grams and g[1:] in self.grams}
        self.left = {}
        for g, c in self.grams.items():
            if len(g) > 1:
                self.left[g[:-1]] = self.left.get(g[:-1], 1.0) - (c - discount) / self.grams[g[:-1]]

    def p(self, context, w):
        if not context:
            return (self.words.get(w, 0) + 1) / (self.n + self.v + 1)
        lower = self.p(context[1:], w)
        left = self.left.get(context, 1.0)
        g = (*context, w)
        return (self.grams[g] - self.discount) / self.grams[context] + left * lower if g in self.grams else left * lower

    def score(self, text):
        total, history = 0.0, ["</s>"]
        for w in [*text.split(), "</s>"]:
            context = tuple(history[-(self.order - 1) :])
            while context and context not in self.grams:
                context = context[1:]
            total += math.log10(self.p(context, w))
            history.append(w)
        return total


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(12)
    usual = "a b c d e f g h".split()
    texts = [" ".join(rng.choice(usual) if rng.random() < 0.85 else f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 14))) for _ in range(240)]
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket, flush", [(16 << 20, 1 << 21), (300, 64)])
def test_lm_score_by_recursion(spark, speech, monkeypatch, bucket, flush):
    """The same in one bucket and in many, and with words sent on early."""
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(lmscore, "FLUSH", flush)
    df = spark.createDataFrame(speech, "doc_id long, text string").repartition(3)
    training = F.col("doc_id") % 7 != 2
    model = Backoff([t for i, t in speech if i % 7 != 2])
    assert sum(len(g) == 3 for g in model.grams) > 50
    got = {r.doc_id: r for r in lmscore.score(df, training).collect()}
    assert len(got) == len(speech)
    for i, t in speech:
        assert got[i].score == pytest.approx(model.score(t)), t
        base = sum(math.log10((model.words.get(w, 0) + 1) / (model.n + model.v + 1)) for w in [*t.split(), "</s>"])
        assert got[i].base_score == pytest.approx(base)


@pytest.mark.parametrize("word_share, ngram_share", [(0.02, 0.02), (0.5, 0.5)])
def test_lm_score_keeps_n_grams_below_the_shares(spark, speech, monkeypatch, word_share, ngram_share):
    """Shares say which contexts are broadcast; n-grams that occur twice count all the same."""
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 600)
    monkeypatch.setattr(lmscore, "FLUSH", 128)
    monkeypatch.setattr(lmscore, "WORD_SHARE", word_share)
    monkeypatch.setattr(lmscore, "NGRAM_SHARE", ngram_share)
    df = spark.createDataFrame(speech, "doc_id long, text string").repartition(3)
    model = Backoff([t for i, t in speech if i % 7 != 2])
    got = {r.doc_id: r.score for r in lmscore.score(df, F.col("doc_id") % 7 != 2).collect()}
    assert got == {i: pytest.approx(model.score(t)) for i, t in speech}


def test_lm_score_of_rare_words_in_many_tokens(spark):
    """Three occurrences count among 600,000 tokens as they do among ten."""
    rows = [(k, "a " * 200_000) for k in range(3)] + [(k, "x y z") for k in range(3, 6)]
    model = Backoff([t for _, t in rows])
    got = lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).filter("doc_id > 2").collect()
    assert [r.score for r in got] == [pytest.approx(model.score("x y z"))] * 3


def test_suffix_dedup_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 512)
    monkeypatch.setattr(suffixdedup, "FLUSH_KEYS", 200)
    rng = random.Random(21)
    base = [words(k, 60) for k in range(5)]
    rows = []
    for i in range(80):
        b = rng.choice(base)
        lo, hi = sorted(rng.sample(range(len(b)), 2))
        rows.append((i, words(500 + i, rng.randint(0, 9)) + b[lo:hi] + rng.choice(base)[lo:hi]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in suffixdedup.deduplicate(df, with_text=False).collect()), key=str) == brute_removed(rows)


def test_run_index_statistics():
    """Each place's neighbour shares what is streamed for it, no place shares more with any other, and repetitive texts have few runs."""
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(120))
    strings = [base[a : a + rng.randint(1, 60)] for a in (rng.randrange(60) for _ in range(40))] + [b"", b"a" * 70]
    strings = list(dict.fromkeys(strings))
    starts = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    index = rindex.RunIndex(np.frombuffer(b"".join(strings), np.uint8), starts)
    assert not hasattr(index, "order") and len(index.places) < index.n
    shared, above = index.statistics()
    suffixes = [s[k:] for s in strings for k in range(len(s) + 1)]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for place, (n, other) in enumerate(zip(shared, above)):
        if n > 0:
            assert common(suffixes[place], suffixes[other]) == n
    owner = np.array([rng.randrange(100) for _ in strings])
    least = index.least_owner(owner, 7)
    held = [o for s, o in zip(strings, owner) for _ in range(len(s) + 1)]
    for place, s in enumerate(suffixes):
        want = min(o for t, o in zip(suffixes, held) if t[:7] == s[:7]) if len(s) >= 7 else -1
        assert least[place] == want


def test_redaction_of_overlapping_spans(spark):
    """Spans of several kinds, over block borders, against replacing what find() returns one by one."""
    rng = random.Random(9)
    parts = ["a.b@c-d.example.org", "1.22.33.4", "+1 743 555 3824", "4111 1111 1111 1111", "IBAN DE89 3704 0044 0532 0130 00", "token 9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "+49 4111-1111-1111-1111", "é😀", "ssn 123-45-6789"]
    texts = [" ".join(rng.choice([*parts, words(k * 50 + j, rng.randint(1, 8))]) for j in range(rng.randint(1, 120))) for k in range(60)] + ["x" * 1024 + parts[0], "", parts[0], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    kinds = set()
    for r in pii.detect(df).collect():
        t, out, at = texts[r.doc_id], [], 0
        for s in r.pii:
            kinds.add((s.kind, s.score))
            if s.start >= at:
                out += [t[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        assert clean[r.doc_id] == (None if t is None else "".join(out) + t[at:])
    # Words nearby raise scores, and decide on what no checksum confirms.
    assert {("iban", 90), ("ssn", 60), ("secret", 60), ("email", 90)} <= kinds


def test_context_decides_on_secrets(spark):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    texts = [f'token = "{key}"', f"TOKEN = {key.upper()}", f"commit {key}", f"order serial token {key}", "secret " + "a" * 40]
    got = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.pii] for r in got] == [["secret"], ["secret"], [], [], []]


def test_redaction_takes_linear_time(spark):
    took = []
    for n in (2_000, 100_000):
        text = " ".join(f"user{i}@mail.ex" for i in range(n))
        began = time.time()
        assert pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == " ".join(["[EMAIL]"] * n)
        took.append(time.time() - began)
    assert took[1] < 40 * max(took[0], 0.5)


def scanned_by_hand(rows, model):
    """Licence paragraphs, pair by pair."""
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    split = lambda t: ["^", *re.findall(licences.WORD, t.lower()), "$"]
    out = set()
    for i, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            w = split(line)
            pairs = [p for p in zip(w, w[1:]) if p in model.weights]
            if not pairs:
                continue
            z = np.array(model.bias) + sum(np.array(model.weights[p]) for p in pairs)
            k, p = int(np.argmax(z)), np.exp(z - z.max())
            if k == len(model.families) or 1 / p.sum() < licences.LEAST_PROBABILITY:
                continue
            mine = grams(w, 3)
            near = max(len(mine & grams(split(t), 3)) / max(1, min(len(mine), len(grams(split(t), 3)))) for t in licences.TEMPLATES[model.families[k]])
            if near >= licences.LEAST_SIMILARITY:
                out.add((i, number, model.families[k], round(float(1 / p.sum()), 9), round(near, 9)))
    return out


@pytest.fixture(scope="module")
def licensed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("licensed")
    rng = random.Random(3)
    every = [t for ts in licences.TEMPLATES.values() for t in ts]
    rows = []
    for i in range(120):
        lines = [words(7000 + 9 * i + k, rng.randint(2, 14)) for k in range(rng.randint(1, 6))]
        if i % 3 == 0:
            t = rng.choice(every)
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([t, "Note: " + t, t.upper(), " ".join(t.split()[: len(t.split()) // 2 + 1]), t + " See the file."]))
        if i % 5 == 1:
            lines.append(rng.choice(licences.OTHERS))
        rows.append((i, "\n".join(lines) if i != 7 else None))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_licence_query_by_hand(spark, licensed):
    folder, rows = licensed
    model = licences.train(licences.sample_lines(spark.read.parquet(f"{folder}/documents.parquet")))
    want = scanned_by_hand(rows, model)
    got = queries.QUERIES["op9_licences"](spark, folder).collect()
    assert {(r.doc_id, r.paragraph, r.family, round(r.probability, 9), round(r.similarity, 9)) for r in got} == want and len(got) == len(want) > 20
    planted = {i for i in range(0, 120, 3)}
    assert len({r[0] for r in want} & planted) >= 0.8 * len(planted) and len({r[0] for r in want} - planted) <= 2


def test_sample_lines_are_bounded_and_stable(spark, licensed, monkeypatch):
    monkeypatch.setattr(licences, "SAMPLE_LINES", 20)
    df = spark.createDataFrame([(i, f"line {i % 40}\n" + "long " * 600 + "\nunder the MIT license\n") for i in range(100)], "doc_id long, text string")
    got = licences.sample_lines(df)
    assert len(got) == len(set(got)) == 20 and all(re.fullmatch(r"line \d+", x) for x in got)
    assert got == licences.sample_lines(df.repartition(5)) and licences.sample_lines(df.limit(0)) == []


def test_pack_size_does_not_change_what_is_read_back(spark):
    rows = [(c, t, r, words(c // 4 * 10 + t, 6)) for c in range(60) for t, r in enumerate(("user", "assistant", "user", "assistant")[: 2 + c % 3])]
    whole = chat.conversations_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = lambda size: sorted(tuple(r) for r in chat.read_back(chat.pack(whole, pack_chars=size)).collect())
    assert read(1) == read(500) == read(1 << 20)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, taken long"


def tables(spark, folder, docs, items=((1, "one two three"),), labels=((1, 1, 0),)):
    spark.createDataFrame(list(docs), COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], []))
    assert out.count() == 0 and "taken" in out.columns


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, a shared doc_id, columns named like the operators' own."""
    long = words(1, 30000)
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (1, "something else under the same number here"), (2, None), (3, ""), (None, "a text without any number of its own"), (4, long), (5, "mail a@b.example.org or call +1 743 555 3824 today"), (6, "one two three")]
    docs = [(i, t, "en", None if i == 4 else "s", len(t or ""), 0.5, "r", 9) for i, t in texts]
    folder = tables(spark, tmp_path, docs, labels=[])
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
    kept = sorted((r.doc_id or 0, r.text or "") for r in frame.collect())
    # The repeated row stays once, the contaminated one goes, personal data is hidden.
    want = [(0, texts[5][1]), (1, texts[0][1]), (1, texts[2][1]), (2, ""), (3, ""), (4, long), (5, "mail [EMAIL] or call [PHONE] today")]
    assert kept == sorted(want)
    assert all(r.n_chars == len(r.text or "") for r in frame.collect())
    out = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.text) for r in out} <= {(i or None, t) for i, t in want} and all(0 < r.taken <= 2 * r.size for r in out)

@pytest.mark.parametrize("symbols", [1, 2, 5, 90, 256])
def test_index_sorts_only_ties_again(monkeypatch, symbols):
    rng, sorted_ = np.random.default_rng(symbols), []
    strings = [rng.integers(0, symbols, rng.integers(50, 75), np.uint8).tobytes() for _ in range(400)]
    strings += [strings[k] + strings[k + 1] for k in range(20)]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    sort = np.sort
    monkeypatch.setattr(rindex.np, "sort", lambda x, *a, **b: sorted_.append(len(x)) or sort(x, *a, **b))
    index = rindex.RunIndex(np.frombuffer(b"".join(strings), np.uint8), starts)
    monkeypatch.undo()
    least, at = index.least_owner(np.arange(len(strings))[::-1].copy(), 50), 0
    owners: dict[bytes, int] = {}
    for k, s in enumerate(strings):
        for p in range(len(s) - 49):
            owners[s[p : p + 50]] = len(strings) - 1 - k
    for s in strings:
        assert least[at : at + len(s) + 1].tolist() == [owners[s[p : p + 50]] if p + 50 <= len(s) else -1 for p in range(len(s) + 1)]
        at += len(s) + 1
    # All were sorted six times and more before.
    assert symbols < 5 or sum(sorted_) < 3 * index.n


def test_lm_requests_are_steps_that_come_back():
    """Rows of codes come back from steps and take less than 8 bytes each, rare words included; each start begins anew."""
    rng, mark = np.random.default_rng(3), 1000
    hashes = lmscore.RARE | rng.integers(0, 1 << 48, 300).astype(np.uint64)
    word = lambda n: np.where(rng.random(n) < 0.2, rng.choice(hashes, n), rng.zipf(1.3, n).astype(np.uint64) % np.uint64(mark))
    for n in (0, 1, 5000):
        rows = np.unique(np.stack([word(n), word(n), word(n)]), axis=1)
        columns = list(np.concatenate([rows, rows], axis=1))
        starts = np.array([0, rows.shape[1]]) if n else np.empty(0, np.int64)
        shrunk = lmscore._shrunk(columns, starts, mark)
        *grown, opens = lmscore._grown([(step, rare) for step, rare, _ in shrunk], starts, mark)
        assert all((a == b).all() for a, b in zip(grown, columns, strict=True))
        assert opens.sum() == 2 * len(np.unique(rows[:2], axis=1).T)
        assert n < 5000 or sum(len(lmscore._packed(x)) for part in shrunk for x in part[:2]) < 8 * len(columns[0])
