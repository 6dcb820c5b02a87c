"""Operator 6: toxicity by multiple-instance learning.

Only documents are labelled, but sentences offend.  A sentence has a logistic
score over its words and word beginnings; a document's probability is the
noisy-or of its sentences', one minus the product of their complements.  The
gradient of the documents' likelihood trains the sentence scores, which then
tell where a document offends.  A score combines the suspect sentences only, so
it doesn't grow with the number of calm ones in a long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytestools import U64, prefix_hashes, slices
from quire.llm.common import table, whole_row

#: The labelled sample: so many documents of each label at most, of so many bytes at most; all are bounds on the driver's memory.
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_BYTES = 2000, 4000, 50_000
#: Features must be in so many sampled documents, depend on the label (the G statistic), and keep so large a weight.
LEAST_DOCS, LEAST_G, LEAST_WEIGHT = 4, 11.0, 0.02
PREFIXES = (4, 5, 6, 7, 8)
STEPS, RATE, L2, START, BALANCE = 400, 0.3, 1e-3, -4.0, 0.0
#: Log-odds from which a sentence is suspect (a probability of 0.05); calmer ones add nothing to others.
SUSPECT = -2.9444

#: Bytes between words, and bytes that end a sentence.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
STOP = np.zeros(256, bool)
STOP[list(b".!?\n")] = True


def sentences(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where sentences begin in texts end to end, every text with one at least; the last entry is the end."""
    begin = np.zeros(len(data) + 1, bool)
    begin[1:] = STOP[data]
    # A stop's successor is no beginning of its own if it is a stop too.
    begin[:-1] &= ~STOP[data]
    begin[at] = True
    return np.flatnonzero(begin)


class Model:
    """Sorted feature hashes with their weights, and the score of a sentence without any."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def sentence_scores(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of each sentence, where each begins, and the first sentence of each text that isn't empty."""
        begin = sentences(data, at)
        z = np.full(len(begin) - 1, self.bias)
        h, where = prefix_hashes(data, at, GAP, PREFIXES)
        if len(self.features) and len(h):
            spot = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = self.features[spot] == h
            z += np.bincount(np.searchsorted(begin, where[hit], "right") - 1, self.weights[spot[hit]], len(z))
        return z, begin, np.searchsorted(begin, at)


def _noisy_or(z: np.ndarray, first: np.ndarray, bias: float) -> np.ndarray:
    """Documents' probabilities from their suspect sentences' log-odds, or else the likeliest sentence's; one without a sentence has the bias alone."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(z >= SUSPECT, -np.logaddexp(0.0, z), 0.0))))
    some = np.diff(first) > 0
    top = np.full(len(some), bias)
    if some.any():
        top[some] = np.maximum.reduceat(z[: first[-1]], first[:-1][some])
    log_none = np.where(top >= SUSPECT, sums[first[1:]] - sums[first[:-1]], -np.logaddexp(0.0, top))
    return -np.expm1(np.minimum(log_none, -np.logaddexp(0.0, top)))


def _g_statistic(toxic_with: np.ndarray, docs_with: np.ndarray, toxic: int, docs: int) -> np.ndarray:
    """How far the documents with a feature are from having labels like all (the log-likelihood ratio)."""
    out = np.zeros(len(docs_with))
    for seen, row, column in (
        (toxic_with, docs_with, toxic),
        (docs_with - toxic_with, docs_with, docs - toxic),
        (toxic - toxic_with, docs - docs_with, toxic),
        (docs - docs_with - toxic + toxic_with, docs - docs_with, docs - toxic),
    ):
        out += 2 * seen * np.log(np.maximum(seen, 1e-9) * docs / np.maximum(row * column, 1e-9))
    return out


def _choose(texts: list[bytes], labels: np.ndarray, at_once: int = 200) -> np.ndarray:
    """Sorted hashes of the features that depend on the label; counts are merged run by run, so memory follows the distinct features."""
    known, docs_with, toxic_with = np.empty(0, U64), np.empty(0, np.int32), np.empty(0, np.int32)
    for lo in range(0, len(texts), at_once):
        own, toxic = [known], [toxic_with]
        count = [docs_with]
        for text, label in zip(texts[lo : lo + at_once], labels[lo : lo + at_once]):
            h = np.unique(prefix_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), GAP, PREFIXES)[0])
            own.append(h)
            count.append(np.ones(len(h), np.int32))
            toxic.append(np.full(len(h), label, np.int32))
        h, count, toxic = (np.concatenate(x) for x in (own, count, toxic))
        order = np.argsort(h)
        h, count, toxic = h[order], count[order], toxic[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        known, docs_with, toxic_with = (h[first], np.add.reduceat(count, first), np.add.reduceat(toxic, first)) if len(first) else (known, docs_with, toxic_with)
    kept = docs_with >= LEAST_DOCS
    known, docs_with, toxic_with = known[kept], docs_with[kept].astype(np.int64), toxic_with[kept].astype(np.int64)
    return known[_g_statistic(toxic_with, docs_with, int(labels.sum()), len(labels)) >= LEAST_G]


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Trains on labelled texts by full-batch Adagrad."""
    if not texts or labels.min() == labels.max():
        rate = min(max(float(labels.mean()) if len(texts) else 0.0, 1e-3), 1 - 1e-3)
        return Model(np.empty(0, U64), np.empty(0), float(np.log(rate / (1 - rate))))
    features = _choose(texts, labels)
    feature, sentence, owner, total = [], [], [], 0
    for i, text in enumerate(texts):
        data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        begin = sentences(data, at)
        h, where = prefix_hashes(data, at, GAP, PREFIXES)
        spot = np.minimum(np.searchsorted(features, h), max(len(features) - 1, 0))
        hit = features[spot] == h if len(features) else np.zeros(len(h), bool)
        feature.append(spot[hit].astype(np.int32))
        sentence.append((np.searchsorted(begin, where[hit], "right") - 1 + total).astype(np.int32))
        owner.append(np.full(max(len(begin) - 1, 1), i))
        total += len(owner[-1])
    feature, sentence, owner = (np.concatenate(x) for x in (feature, sentence, owner))
    weights, bias = np.zeros(len(features)), START
    square, bias_square = np.full(len(features), 1e-6), 1e-6
    y = labels.astype(float)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** BALANCE
    for _ in range(STEPS):
        z = bias + np.bincount(sentence, weights[feature], total)
        p = np.exp(-np.logaddexp(0.0, -z))
        none = np.bincount(owner, -np.logaddexp(0.0, z), len(y))
        some = np.maximum(-np.expm1(none), 1e-12)
        factor = np.where(y > 0, -np.exp(none) / some, 1.0) * balance
        by_sentence = factor[owner] * p / len(y)
        grad = np.bincount(feature, by_sentence[sentence], len(features)) + L2 * weights / len(y)
        bias_grad = by_sentence.sum()
        square += grad**2
        bias_square += bias_grad**2
        weights -= RATE * grad / np.sqrt(square)
        bias -= RATE * bias_grad / np.sqrt(bias_square)
    keep = np.abs(weights) >= LEAST_WEIGHT
    return Model(features[keep], weights[keep], float(bias))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of the labelled documents, the first by the digest of doc_id.

    docs has doc_id and text, labels doc_id and toxic.  Labels other than 0 and 1
    are left out; of several for one document the largest holds, and of several
    texts of one doc_id the least.  Null texts aren't learned from.  Without labels of
    both kinds the model has no features and scores all texts alike.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).filter(F.length("bytes") <= SAMPLE_BYTES)
    there = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    sample = there.filter("toxic = 1").orderBy(order).limit(SAMPLE_TOXIC).unionByName(there.filter("toxic = 0").orderBy(order).limit(SAMPLE_OTHER))
    # At most SAMPLE_TOXIC + SAMPLE_OTHER rows of two numbers.
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("bytes").alias("bytes"), F.first("toxic").alias("toxic")).toArrow().sort_by("doc_id")
    return fit([bytes(b) for b in rows.column("bytes").to_pylist()], rows.column("toxic").to_numpy().astype(np.int64))


def _scoring(sent, located: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for rows, data, at in slices(batches, "bytes"):
            z, begin, first = model.sentence_scores(data, at)
            score = _noisy_or(z, first, model.bias)
            bad = np.concatenate(([0], np.cumsum(z >= 0)))
            columns = [rows.column(c) for c in rows.schema.names if c != "bytes"]
            names = [c for c in rows.schema.names if c != "bytes"]
            columns += [pa.array(score), pa.array(np.diff(first).astype(np.int32)), pa.array((bad[first[1:]] - bad[first[:-1]]).astype(np.int32))]
            if located:
                found = []
                for i in range(len(at) - 1):
                    own = np.arange(first[i], first[i + 1])[z[first[i] : first[i + 1]] >= 0]
                    found.append([{"start": int(begin[k] - at[i]), "stop": int(begin[k + 1] - at[i]), "score": float(1 / (1 + np.exp(-z[k])))} for k in own])
                columns.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "n_sentences", "n_offending", *["offending"] * located])

    return run


def score(docs: DataFrame, model: Model, keys: list[str], located: bool = True) -> DataFrame:
    """One row per document: keys, score (0 to 1), n_sentences, n_offending and, if located, offending.

    offending lists the sentences that alone are likelier toxic than not: start
    and stop in UTF-8 bytes, and score.  Null texts are empty; an empty text has
    no sentence and the score of a sentence without a known word.  Each row
    stands for itself, so repeated rows and ties get equal scores; columns other
    than text and keys are ignored.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(*keys, text.alias("bytes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "bytes")
    schema += ", score double, n_sentences int, n_offending int" + ", offending array<struct<start:int,stop:int,score:double>>" * located
    return rows.mapInArrow(_scoring(docs.sparkSession.sparkContext.broadcast(model), located), schema)


def _learned_from(df: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 5 isn't 0."""
    return df.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; the model learns from labelled docs. All columns stay.

    Null and empty texts score as calm ones do.  Each row is judged by its own
    text, so repeated rows stay or go together; an empty table stays empty.
    """
    model = train(_learned_from(docs.select("doc_id", "text")), labels.select("doc_id", "toxic"))
    scored = score(docs.select(whole_row(docs).alias("row"), "text"), model, ["row"], located=False)
    return scored.filter("score < 0.5").select("row.*")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted, n_sentences, n_offending."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(_learned_from(docs), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model, ["doc_id"], located=False).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending")
