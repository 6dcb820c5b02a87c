"""The registered queries and the pipeline over a small folder of tables, against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quire.llm import queries
from tests.llm.test_small_cases import as_bytes, brute_contamination, brute_removed, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    items = [(k, words(900 + k, 25)) for k in range(6)]
    docs, labels = [], []
    for i in range(160):
        body = words(3000 + i, rng.randint(5, 120)).split()
        bad = i % 4 == 1
        for _ in range(3 * bad):
            body.insert(rng.randrange(len(body)), rng.choice(["dolt", "oaf", "cretin"]))
        if i % 13 == 0:
            body[2:2] = items[i % 6][1].split()[3:20]
        if i % 10 == 3:
            body += [f"user{i}@mail.example.org", "call", "+1 (743) 555-3824", "or", "4111 1111 1111 1111"]
        if i % 9 == 8:
            body = docs[i - 4][1].split()[:-1] + ["changed"]
        text = None if i == 50 else "" if i == 51 else docs[i - 7][1] if i % 17 == 16 else " ".join(body)
        docs.append((i, text, "en", [None, "a", "b", "c", "b"][i % 5], len(text or "")))
        labels.append((i, 1, int(bad)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    turns = [(c, t, r, words(c // 3 * 10 + t, 6)) for c in range(30) for t, r in enumerate(("user", "assistant", "user", "assistant")[: 2 + c % 3])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    x = np.random.default_rng(1).normal(size=(20, 8))
    vectors = [(k, (x[k % 20] + 0.15 * np.random.default_rng(k).normal(size=8)).tolist(), 0) for k in range(200)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def rows_of(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    want = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got.fetchall()), key=str)
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()), key=str) == want


def test_lm_score(spark, sf_dir):
    rows = [(i, as_bytes(t).lower().split() + [b"\0"]) for i, t in documents(spark, sf_dir)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = {}
    for i, w in rows:
        for x in w if not held(i) else ():
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in rows_of(spark, sf_dir, "op4_lm_score")}
    for i, w in rows:
        base = sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held(i), len(w), sum(x in counts for x in w), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = as_bytes(t).lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    link = [[j for j, b in enumerate(sets) if j != k and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9] for k, a in enumerate(sets)]
    least = [i for i, _ in rows]
    for _ in rows:
        for k in range(len(rows)):
            least[k] = min([least[k], *(least[j] for j in link[k])])
    return link, least


def test_near_duplicates(spark, sf_dir):
    rows = documents(spark, sf_dir)
    link, least = brute_groups(rows)
    assert sum(map(len, link)) > 20
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in rows_of(spark, sf_dir, "op5_near_duplicates")}
    assert got == {i: (len(link[k]), least[k], least[k] == i) for k, (i, _) in enumerate(rows)}


def test_toxicity(spark, sf_dir):
    got = {r.doc_id: r for r in rows_of(spark, sf_dir, "op6_toxicity")}
    assert set(got) == set(range(160))
    held = [i for i, r in got.items() if r.held_out and i not in (50, 51)]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    texts = dict(documents(spark, sf_dir))
    right = sum(got[i].predicted == int(bool(re.search("dolt|oaf|cretin", texts[i] or ""))) for i in held)
    assert right >= 0.9 * len(held)


def test_embeddings(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    u = np.array([r.embedding for r in v], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    least = np.arange(len(v))
    for _ in v:
        least = np.minimum(least, np.where(linked, least[None, :], 10**9).min(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in rows_of(spark, sf_dir, "op7_embedding_dedup")}
    assert linked.sum() > 100 and got == {k: (int(linked[k].sum()), int(least[k])) for k in range(len(v))}


def test_suffix_dedup(spark, sf_dir):
    assert sorted((tuple(r) for r in rows_of(spark, sf_dir, "op10_suffix_dedup")), key=str) == brute_removed(documents(spark, sf_dir))


def test_licences_runs_on_all(spark, sf_dir):
    assert rows_of(spark, sf_dir, "op9_licences") == []


def test_pipeline(spark, sf_dir):
    """Each stage on what the one before kept, by brute force but for the classifier's scores."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([tuple(r) for r in stage(spark, docs, sf_dir).collect()], stage(spark, docs, sf_dir).schema)
        stages.append(docs)
    assert all(s.columns == columns for s in stages[:-1])
    texts = dict(documents(spark, sf_dir))
    calm = {r.doc_id: r.text for r in stages[0].collect()}
    clean = {i for i, t in texts.items() if not re.search("dolt|oaf|cretin", t or "")}
    assert len(clean - set(calm)) <= 0.02 * len(clean) and len(set(calm) - clean) <= 0.1 * len(calm)
    rows = sorted(calm.items())
    _, least = brute_groups(rows)
    kept = {i: t for (i, t), c in zip(rows, least) if c == i}
    assert {r.doc_id: r.text for r in stages[1].collect()} == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(list(kept.items()), items) if r[-1]}
    assert bad and {r.doc_id for r in stages[2].collect()} == set(kept) - bad
    hidden = {r.doc_id: r.text for r in stages[3].collect()}
    for i in set(kept) - bad:
        t = kept[i]
        for pattern, name in ((r"user\d+@mail\.example\.org", "[EMAIL]"), (r"\+1 \(743\) 555-3824", "[PHONE]"), (r"4111 1111 1111 1111", "[CARD]")):
            t = t and re.sub(pattern, name, t)
        assert hidden[i] == t
    sizes = {}
    for r in stages[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for source, size in sizes.items():
        own = [r for r in stages[4].collect() if r.source == source]
        assert sum(r.taken for r in own) <= 2 * size and all(0 < r.taken <= 2 * r.size for r in own)
        assert not own or abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert hashlib.sha256(str(sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))).encode()).digest() == hashlib.sha256(str(sorted(map(str, stages[4].collect()))).encode()).digest()
