"""Operator 4: score texts with an n-gram model as a weighted backoff automaton.

The model knows every word of the training texts: a word's probability is its
count plus one over all counts plus one for each word and one for the unknown.
On top of that, all n-grams that occur twice in training, however large it is,
are smoothed by absolute discounting.  What occurs once leaves its mass to the
lower orders.

Contexts are states.  A state's arcs are its n-grams; its failure arc leads to
the context without its first word, at the cost of the mass that is left.  The
automaton isn't held anywhere as a whole.  States of words with a share of at
least WORD_SHARE of the training tokens and of pairs of them with a share of at
least NGRAM_SHARE are broadcast, which are 1 / WORD_SHARE words and
1 / NGRAM_SHARE pairs at most; their arcs are dealt by n-gram and their failure
weights added up over all buckets, so that no task holds all that follows a
frequent word.  Other states lie in one bucket with their arcs.  A part of the
texts asks the buckets for the counts of its own n-grams, which at the same time
are what it adds to them, and follows its texts with the arcs and failure
weights that it gets back.

Words are told apart by 64-bit hashes; inside n-grams, frequent words by their
ranks and others by 48 bits of their hashes.  A part sends its n-grams sorted, as
steps from one to the next, in rounds by the contexts' last words.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytestools import U64, mixed, slices, word_hashes
from quire.llm.common import cut, table

#: Least shares of the training tokens of states that are broadcast; their inverses bound the words and the n-grams of an order. The others are looked up.
WORD_SHARE, NGRAM_SHARE, ORDER, DISCOUNT = 1e-5, 4e-6, 3, 0.5
#: Text bytes to a bucket of word or n-gram counts, and values that a task gathers before it sends them.
BUCKET_BYTES, FLUSH = 16 << 20, 1 << 21
#: N-grams are asked for in so many rounds, each with what follows a share of the words, so that the requests of one are on disk at a time.
ROUNDS = 4
#: An n-gram counts from so many occurrences in training on, whatever the input; and frequent contexts whose sums are added up in one group.
LEAST, STATES = 2, 1 << 13
BLOBS = "bucket long, keys binary, counts binary"


def _blobs(keys: np.ndarray, counts: np.ndarray, bits: int, spread: bool = False) -> pa.RecordBatch:
    """Sorted keys with counts as a row per bucket."""
    high = keys * U64(0x9E3779B97F4A7C15) if spread else keys
    bucket = (high >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    heads = bucket[np.concatenate(([0], cuts))] if len(keys) else bucket
    split = lambda x, f: pa.array([_packed(f(p)) for p in np.split(x, cuts)] if len(keys) else [], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), split(keys, _steps), split(counts, np.asarray)], names=["bucket", "keys", "counts"])


def _counting(bits: int, keys_of, spread: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data, at in slices(batches, "bytes"):
            held.append(keys_of(data, at))
            size += len(held[-1])
            if size >= FLUSH:
                yield _blobs(*np.unique(np.concatenate(held), return_counts=True), bits, spread)
                held, size = [], 0
        if size:
            yield _blobs(*np.unique(np.concatenate(held), return_counts=True), bits, spread)

    return run


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(_unpacked(x), dtype=U64) for x in pdf["keys"]])
    counts = np.concatenate([_unpacked(x) for x in pdf["counts"]]).astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + U64(1)) != 0)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, counts = _merged(pdf)
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "keys": [_packed(_steps(keys))], "counts": [_packed(counts)], "types": [len(keys)], "tokens": [int(counts.sum())]})


def _frequent(least: float):
    """Keys with at least so large a count."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(pdf)
        kept = counts >= least
        return pd.DataFrame({"key": keys[kept].view(np.int64), "count": counts[kept]})

    return run


class Automaton:
    """States 0 (root), 1 + w after word w, then those after longer n-grams; word 0 is the end (and start) of a text."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, types: int):
        """words: sorted hashes of the frequent words; counts: the end's count, then theirs."""
        self.words, self.width = words, len(words) + 1
        #: By word, its place among all words if the end comes first, then the most frequent one.
        self.rank = np.empty(self.width, np.int64)
        self.rank[np.concatenate(([0], 1 + np.argsort(-counts[1:], kind="stable")))] = np.arange(self.width)
        self.total = math.log10(tokens + types + 1)
        self.log_counts = np.log10(counts + 1)
        #: By order, the sorted keys of its n-grams: state of all but the last word * width + last word.
        self.keys = [np.arange(self.width)]
        self.grams = [counts.astype(np.float64)]
        self.probs = [np.power(10.0, self.log_counts - self.total)]
        self.first_state = [1]
        self.back = [np.zeros(1 + self.width)]
        self.fail = [np.zeros(1 + self.width, np.int64)]

    def ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word and end of each text its number or -1, the text it is in, and all words' hashes (0 for ends)."""
        h, text = word_hashes(data, at)
        spot = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        found = np.where(self.words[spot] == h, spot + 1, -1) if len(self.words) else np.full(len(h), -1)
        ends = np.searchsorted(text, np.arange(len(at) - 1), "right")
        return np.insert(found, ends, 0), np.insert(text, ends, np.arange(len(at) - 1)), np.insert(h, ends, 0)

    def states(self, ids: np.ndarray, order: int) -> np.ndarray:
        """After each word, the state of its last n-gram of that order, or -1; a text starts after an end."""
        before = np.concatenate(([0], ids[:-1]))
        state = np.where(ids >= 0, ids + 1, -1)
        for n in range(2, order + 1):
            # The context is the state of order n - 1 one word earlier; after an end only that end counts.
            context = np.concatenate(([1 if n == 2 else -1], state[:-1]))
            if n > 2:
                context[before == 0] = -1
            key = np.where((context >= 0) & (ids >= 0), context * self.width + ids, -1)
            spot = np.minimum(np.searchsorted(self.keys[n - 1], key), max(len(self.keys[n - 1]) - 1, 0))
            state = np.where((key >= 0) & (self.keys[n - 1][spot] == key), spot + self.first_state[n - 1], -1) if len(self.keys[n - 1]) else np.full(len(ids), -1)
        return state

    def candidates(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of the next order's n-grams in the texts: those whose first and last n - 1 words the automaton has."""
        n = len(self.keys) + 1
        ids, _, _ = self.ids(data, at)
        before = np.concatenate(([0], ids[:-1]))
        state = self.states(ids, n - 1)
        context = np.concatenate(([1 if n == 2 else -1], state[:-1]))
        if n > 2:
            context[before == 0] = -1
        good = (context >= 0) & (state >= 0)
        return (context[good] * self.width + ids[good]).astype(U64)

    def add(self, keys: np.ndarray, counts: np.ndarray, discount: float) -> None:
        """Adds the n-grams of the next order, sorted by key."""
        n = len(self.keys) + 1
        context, word = keys // self.width, keys % self.width
        first = self.first_state[-1]
        of_context = self.grams[-1][context - first]
        size = len(self.grams[-1])
        share = (counts - discount) / of_context
        left = 1 - np.bincount(context - first, share, size)
        self.back[-1][-size:] = np.log10(np.maximum(left, 1e-9))
        # The lower order's probability: its n-gram without the first word is there as often at least.
        if n == 2:
            lower = self.probs[0][word]
            shorter = word + 1
        else:
            shorter_context = self.fail[-1][context - first]
            spot = np.searchsorted(self.keys[-1], shorter_context * self.width + word)
            lower = self.probs[-1][spot]
            shorter = spot + self.first_state[-1]
        self.keys.append(keys)
        self.grams.append(counts.astype(np.float64))
        self.probs.append(share + left[context - first] * lower)
        self.first_state.append(first + size)
        self.back.append(np.zeros(len(keys)))
        self.fail.append(shorter)

    def tables(self):
        """Arcs by state * width + word, each arc's log probability and next state, and states' failure weights and arcs."""
        arcs = dict(zip(np.concatenate(self.keys).tolist(), range(sum(map(len, self.keys)))))
        weight = np.concatenate([np.log10(p) for p in self.probs]).tolist()
        following = np.concatenate([np.arange(len(k)) + s for k, s in zip(self.keys, self.first_state)])
        # No context longer than the model's: the last order's arcs lead to their suffix.
        if len(self.keys) > 1 and len(self.keys[-1]):
            following[-len(self.keys[-1]) :] = self.fail[-1]
        back, fail = np.concatenate(self.back), np.concatenate(self.fail)
        return arcs, weight, following.tolist(), back.tolist(), fail.tolist()


def _packed(x: np.ndarray) -> bytes:
    """Numbers as bytes, compressed byte by byte of all, so that leading zeros take no room."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.astype(U64).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, U64)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(U64).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences; np.cumsum brings them back."""
    return np.diff(x, prepend=U64(0))


#: Codes of words: the rank of a frequent one; of others 48 bits of the hash, with the highest bit set.
RARE = U64(1 << 63)


def _distinct(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of numbers below base, sorted by the columns in turn, and each given row's place among them."""
    if base ** len(columns) < 1 << 63:
        key = columns[0]
        for c in columns[1:]:
            key = key * base + c
        own, place = np.unique(key, return_inverse=True)
        out = []
        for _ in columns:
            own, last = np.divmod(own, base)
            out.append(last)
        return out[::-1], place
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return [c[order[new]] for c in columns], place


def _hashed(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of codes."""
    h = np.zeros(len(columns[0]), U64)
    for c in columns:
        h = mixed(h * U64(0x9E3779B97F4A7C15) + c.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x632BE59BD9B4E019))
    return h


def _shrunk(columns: list[np.ndarray], starts: np.ndarray, mark: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of codes, sorted from each start on, as steps: by column the steps, the hashes of its rare words, and their rows.

    A step is 0 where a row repeats the code before it.  Rare words that follow
    the same codes are numbered from mark on, which is above all ranks.
    """
    head = np.zeros(len(columns[0]), bool)
    head[starts] = True
    out = []
    for c in columns:
        change = head.copy()
        change[1:] |= c[1:] != c[:-1]
        fresh = (c >= RARE) & change
        nth, heads = np.cumsum(fresh), np.flatnonzero(head)
        nth -= np.repeat(nth[heads] - fresh[heads], np.diff(np.append(heads, len(c))))
        value = np.where(c >= RARE, mark - 1 + nth, (c & ~RARE).astype(np.int64))
        step = np.diff(value, prepend=0)
        step[heads] = value[heads] + 1
        where = np.flatnonzero(fresh)
        out.append((step, c[where] & ~RARE, where))
        head = change
    return out


def _grown(columns: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, mark: int) -> list[np.ndarray]:
    """The rows of codes, from each column's steps and hashes; and which rows' codes without the last column are new."""
    head = np.zeros(len(columns[0][0]), bool)
    head[starts] = True
    out = []
    for step, hashes in columns:
        value, heads = np.cumsum(step), np.flatnonzero(head)
        value -= np.repeat(value[heads] - step[heads], np.diff(np.append(heads, len(step)))) + 1
        last, head = head, step > 0
        code = value.astype(U64)
        if len(hashes):  # states, which may be above mark, have none
            rare = value >= mark
            code[rare] = RARE | hashes[(np.cumsum(rare & head) - 1)[rare]]
        out.append(code)
    return [*out, last]


class Tokens:
    """A part's texts as numbers: their words' ranks, then one number for none, then those of the part's rare words."""

    def __init__(self, m: Automaton, batches: list[pa.RecordBatch]):
        found, docs = [], 0
        for _, data, at in slices(iter(batches), "bytes"):
            ids, text, h = m.ids(data, at)
            found.append((ids, text + docs, h))
            docs += len(at) - 1
        self.docs = docs
        self.ids, self.text, h = (np.concatenate([f[k] for f in found]) for k in range(3))
        del found
        ids = self.ids
        before = lambda x, start: np.concatenate(([start], x[:-1])).astype(x.dtype)
        self.words, self.word_of = np.unique(h[ids < 0], return_inverse=True)
        self.mark = m.width + 1
        #: By number, the code that is the same in all parts.
        self.codes = np.concatenate((np.arange(self.mark).astype(U64), RARE | self.words >> U64(16)))
        word = m.rank[ids]
        word[ids < 0] = self.mark + self.word_of
        # Every text follows an end, whose number is 0.
        last = before(word, 0)
        pair = m.states(ids, 2)
        self.later = np.flatnonzero(before(ids, 0) != 0)
        self.at = np.concatenate((np.arange(len(ids)), self.later))
        # States number contexts from 1 on: words, then pairs.
        self.state = np.concatenate((before(ids, 0), before(pair, -1)[self.later] - 1))
        self.states = max(len(self.codes), sum(map(len, m.keys)))
        self.first, self.word, self.last = np.concatenate((np.full(len(ids), m.width), before(last, 0)[self.later])), word[self.at], last[self.at]
        self.known = np.flatnonzero(pair >= 0)
        self.known_count = m.grams[1][pair[self.known] - m.first_state[1]]
        self.asked = np.ones(len(self.at), bool)
        self.asked[self.known] = False
        #: By number, the round in which what follows the word is asked for.
        self.round = (_hashed(self.codes) % U64(ROUNDS)).astype(np.uint8)


class Grams:
    """What a part asks of the counts in a round: the bigrams and trigrams of some contexts, as contexts with the words that follow, and once its rare words.

    Bigrams that the automaton has are not asked for.  Another context in the
    automaton is frequent, so its n-grams (usual) are dealt by themselves, as its
    state with the word that follows.  All that follows any other context is in
    one bucket, as the context's last word, the one before (or that there is
    none) and the word that follows.
    """

    def __init__(self, t: Tokens, turn: int, bits: int):
        self.tokens, self.turn = t, turn
        asked, usual = t.asked & (t.round[t.last] == turn), t.state >= 0
        self.usual, self.other = np.flatnonzero(asked & usual), np.flatnonzero(asked & ~usual)
        keys, self.key_of = _distinct([t.state[self.usual], t.word[self.usual]], t.states)
        self.keys = [keys[0].astype(U64), t.codes[keys[1]]]
        self.key_bucket, self.key_of = self._dealt(self.keys, self.keys, self.key_of, bits)
        grams, self.gram_of = _distinct([x[self.other] for x in (t.last, t.first, t.word)], len(t.codes))
        self.grams = [t.codes[g] for g in grams]
        self.gram_bucket, self.gram_of = self._dealt(self.grams, self.grams[:2], self.gram_of, bits)
        v, u, _ = self.grams
        opens = np.zeros(len(v), bool)
        opens[:1] = True
        opens[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (self.gram_bucket[1:] != self.gram_bucket[:-1])
        self.context = np.cumsum(opens) - 1

    @staticmethod
    def _dealt(columns: list[np.ndarray], by: list[np.ndarray], place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorts the columns by the bucket of by: the buckets, and the places that were given."""
        bucket = (_hashed(*by) >> U64(64 - bits)).astype(np.uint32 if bits > 16 else np.uint16) if bits else np.zeros(len(by[0]), np.uint16)
        order = np.argsort(bucket, kind="stable")
        columns[:] = [c[order] for c in columns]
        spot = np.empty(len(order), np.int64)
        spot[order] = np.arange(len(order))
        return bucket[order], spot[place]

    def requests(self, part: int, learned: np.ndarray, bits: int) -> pa.RecordBatch:
        """A row for each bucket; learned says which texts are counted."""
        t = self.tokens
        words, word_of = (t.words, t.word_of) if self.turn == 0 else (t.words[:0], t.word_of[:0])
        of = lambda which: learned[t.text[which]]
        count = lambda place, which, n: np.bincount(place, of(which), n).astype(np.int64)
        buckets, columns = np.arange(1 << bits), {}
        for name, table_, at, counts in (("key", self.keys, self.key_bucket, count(self.key_of, t.at[self.usual], len(self.keys[0]))), ("gram", self.grams, self.gram_bucket, count(self.gram_of, t.at[self.other], len(self.grams[0])))):
            edges = np.searchsorted(at, np.arange((1 << bits) + 1))
            columns[f"{name}_counts"] = np.split(counts, edges[1:-1])
            starts = edges[:-1][np.diff(edges) > 0]
            for k, (step, hashes, where) in enumerate(_shrunk(table_, starts, t.mark)):
                columns[f"{name}{k}"] = np.split(step, edges[1:-1])
                columns[f"{name}{k}_rare"] = np.split(hashes, np.searchsorted(where, edges[1:-1]))
        cuts = np.searchsorted(words, buckets[1:].astype(U64) << U64(64 - bits)) if bits else []
        columns["words"] = [_steps(x) for x in np.split(words, cuts)]
        rare = np.flatnonzero(t.ids < 0)[: len(word_of)]
        columns["word_counts"] = np.split(count(word_of, rare, len(words)), cuts)
        rows = [b for b in buckets.tolist() if len(columns["key0"][b]) or len(columns["gram0"][b]) or len(columns["words"][b])]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([part] * len(rows), pa.int64()), *(pa.array([_packed(columns[c][b]) for b in rows], pa.binary()) for c in ASKED)], names=["bucket", "part", *ASKED])


#: A part's n-grams and rare words in a bucket with their counts, and the answers: counts of all parts, and of each context all, those of n-grams that count, and how many these are.
ASKED = [f"{c}{more}" for c in ("key0", "key1", "gram0", "gram1", "gram2") for more in ("", "_rare")] + ["key_counts", "gram_counts", "words", "word_counts"]
ANSWERED = ["key_counts", "counts", "totals", "kept", "kinds", "word_counts"]


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows sorted by part, part by part."""
    held, last = [], None
    for batch in batches:
        part = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and part[a] != last:
                yield last, held
                held = []
            held.append(batch.slice(a, b - a))
            last = int(part[a])
    if held:
        yield last, held


def _asking(model, bits: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _whole_parts(batches):
            learned = ~np.concatenate([r.column("held_out").to_numpy(zero_copy_only=False) for r in rows])
            yield Grams(Tokens(model.value, rows), turn, bits).requests(part, learned, bits)

    return run


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct key is, the sum of its counts, and each given key's place among them."""
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], np.bincount(place, counts, int(new.sum())).astype(np.int64), place


def _answering(mark: int):
    """The answers to a bucket's parts; and by ranges of states, as parts below 0, what the bucket has of frequent contexts.

    What doesn't count is answered by 0, and so is the total of a context whose
    n-grams don't count, for its failure weight is 1 then.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])

        def rows(names: list[str]):
            columns = [([_unpacked(x).astype(np.int64) for x in pdf[c]], np.concatenate([_unpacked(x) for x in pdf[f"{c}_rare"]])) for c in names]
            sizes = np.array([len(x) for x in columns[0][0]])
            ends = np.cumsum(sizes)
            return _grown([(np.concatenate(steps), hashes) for steps, hashes in columns], (ends - sizes)[sizes > 0], mark), ends

        whole = lambda c: np.concatenate([_unpacked(x) for x in pdf[c]]).astype(np.int64)
        parts = lambda x, ends: [_packed(p) for p in np.split(x, ends[:-1])]
        out = {"part": pdf["part"].to_numpy(), "bucket": bucket}
        (state, word, _), ends = rows(["key0", "key1"])
        first, counts, of = _added(_hashed(state, word), whole("key_counts"))
        good = counts >= LEAST
        out["key_counts"] = parts((counts * good)[of], ends)
        state, place = np.unique(state[first[good]].astype(np.int64), return_inverse=True)
        kept, kinds = np.bincount(place, counts[good], len(state)).astype(np.int64), np.bincount(place, minlength=len(state))
        cuts = np.flatnonzero(np.diff(state // STATES)) + 1
        more = [(-1 - int(s[0]) // STATES, bucket, _packed(s), _packed(k), _packed(n), b"", b"", b"") for s, k, n in zip(*(np.split(x, cuts) for x in (state, kept, kinds))) if len(s)]
        del word, of
        (last, first, word, opens), ends = rows(["gram0", "gram1", "gram2"])
        hashed = _hashed(last, first)
        del last, first
        heads = np.flatnonzero(opens)
        own, context = np.unique(hashed[heads], return_inverse=True)
        first, counts, of = _added(_hashed(hashed, word), whole("gram_counts"))
        del hashed, word
        context_of = context[(np.cumsum(opens) - 1)[first]]
        good = counts >= LEAST
        out["counts"] = parts((counts * good)[of], ends)
        total, kept, kinds = (np.bincount(context_of, x, len(own)).astype(np.int64) for x in (counts, counts * good, good))
        of_contexts = np.searchsorted(heads, ends)
        out |= {name: parts(x[context], of_contexts) for name, x in (("totals", total * (kinds > 0)), ("kept", kept), ("kinds", kinds))}
        words = [np.cumsum(_unpacked(x), dtype=U64) for x in pdf["words"]]
        _, counts, of = _added(np.concatenate(words), whole("word_counts"))
        out["word_counts"] = parts(counts[of], np.cumsum([len(x) for x in words]))
        return pd.concat([pd.DataFrame(out), pd.DataFrame(more, columns=["part", "bucket", *ANSWERED])])

    return run


def _of_states(pdf: pd.DataFrame) -> pd.DataFrame:
    """All buckets' sums of frequent contexts."""
    state, kept, kinds = (np.concatenate([_unpacked(x) for x in pdf[c]]).astype(np.int64) for c in ANSWERED[:3])
    own, place = np.unique(state, return_inverse=True)
    return pd.DataFrame({"state": own, "kept": np.bincount(place, kept).astype(np.int64), "kinds": np.bincount(place, kinds).astype(np.int64)})


def _left(total: np.ndarray, kept: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A context's failure weight: the mass that its arcs leave."""
    return 1 - np.where(total > 0, (kept - DISCOUNT * kinds) / np.maximum(total, 1), 0.0)


def _scoring(model, bits: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        m, kept, kinds = model.value
        t = Tokens(m, rows.to_batches())
        # Arcs and failure weights of the contexts of each token; no arc where an n-gram doesn't count.
        of_states = np.concatenate(m.grams)
        count, total, word_counts = np.empty(len(t.at)), of_states[np.maximum(t.state, 0)], None
        left = _left(of_states, kept, kinds)[np.maximum(t.state, 0)]
        count[t.known] = t.known_count
        for turn in range(ROUNDS):
            g = Grams(t, turn, bits)
            mine = answers.filter(pc.equal(answers["turn"], turn)).sort_by("bucket")
            # A part that knows all it needs has asked for nothing.
            got = {c: np.concatenate([np.empty(0, U64), *map(_unpacked, mine.column(c).to_pylist())]).astype(np.int64) for c in ANSWERED}
            word_counts = got["word_counts"] if turn == 0 else word_counts
            if any(len(x) != n for x, n in ((got["key_counts"], len(g.keys[0])), (got["counts"], len(g.context)), (got["totals"], g.context[-1] + 1 if len(g.context) else 0), (word_counts, len(t.words)))):
                raise ValueError("the documents' partitions changed between two reads")
            count[g.usual] = got["key_counts"][g.key_of]
            context = g.context[g.gram_of]
            count[g.other], total[g.other] = got["counts"][g.gram_of], got["totals"][context]
            left[g.other] = _left(got["totals"], got["kept"], got["kinds"])[context]
        arc = np.where(count >= LEAST, (count - DISCOUNT) / np.maximum(total, 1), 0.0)
        rare, n = t.ids < 0, len(t.ids)
        logs = np.where(rare, 0.0, m.log_counts[np.maximum(t.ids, 0)])
        logs[rare] = np.log10(word_counts[t.word_of] + 1)
        p = arc[:n] + left[:n] * np.power(10.0, logs - m.total)
        p[t.later] = arc[n:] + left[n:] * p[t.later]
        known = ~rare if m.log_counts[0] > 0 else t.ids > 0  # without training, not even the end is known
        known[rare] = word_counts[t.word_of] > 0
        sums = lambda x: pa.array(np.bincount(t.text, x, t.docs))
        whole = lambda x: pa.array(np.bincount(t.text, x, t.docs).astype(np.int64))
        columns = [rows.column("doc_id"), rows.column("held_out"), whole(None), whole(known), sums(logs - m.total), sums(np.log10(p))]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def train(texts: DataFrame, bits: int, order: int = ORDER, word_share: float = WORD_SHARE, ngram_share: float = NGRAM_SHARE, discount: float = DISCOUNT) -> tuple[Automaton, DataFrame, int]:
    """The automaton of the frequent words and n-grams, all words' counts by bucket, and how many tokens texts (bytes) have."""
    counts = texts.mapInArrow(_counting(bits, lambda data, at: word_hashes(data, at)[0], False), BLOBS)
    counts = cut(counts.groupBy("bucket").applyInPandas(_merge, BLOBS + ", types long, tokens long"))
    types, words_in = counts.agg(F.sum("types"), F.sum("tokens")).first()
    ends = texts.count()
    tokens, types = (words_in or 0) + ends, (types or 0) + (ends > 0)
    frequent = counts.groupBy("bucket").applyInPandas(_frequent(max(LEAST, word_share * tokens)), "key long, count long").toPandas()
    words = frequent["key"].to_numpy().view(np.int64).astype(np.int64).view(U64)
    by_hash = np.argsort(words)
    model = Automaton(words[by_hash], np.concatenate(([ends], frequent["count"].to_numpy()[by_hash])).astype(np.int64), tokens, types)
    for _ in range(2, order + 1):
        sent = texts.sparkSession.sparkContext.broadcast(model)
        keys = texts.mapInArrow(_counting(bits, lambda data, at, sent=sent: sent.value.candidates(data, at), True), BLOBS)
        kept = keys.groupBy("bucket").applyInPandas(_frequent(max(LEAST, ngram_share * tokens)), "key long, count long").toPandas().sort_values("key")
        model.add(kept["key"].to_numpy().astype(np.int64), kept["count"].to_numpy().astype(np.int64), discount)
    return model, counts.select("bucket", "keys", "counts"), tokens


def score(docs: DataFrame, training) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training is a condition on docs: the rows to learn from; the others are held
    out.  Null texts are empty, and an empty text is one token, its end.  Rows
    that repeat are learned from and scored each; rows that share a doc_id don't
    mix.  Other columns are ignored.  Without training texts all words are
    unknown; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    docs = docs.select("doc_id", text.alias("bytes"), (~training).alias("held_out"))
    # A part is what a task asks for at once: rows of one partition, chosen by hash, so that their order doesn't matter.
    sizes = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("bytes").cast("long")).alias("n")).agg(F.sum("n"), F.max("n")).first()
    bits = max(0, math.ceil(math.log2(max(1, sizes[0] or 0) / BUCKET_BYTES)))
    split = max(1, math.ceil((sizes[1] or 0) / (4 * FLUSH)))
    texts = docs.withColumn("part", F.spark_partition_id().cast("long") * split + F.pmod(F.xxhash64("doc_id", "bytes"), F.lit(split)))
    model, tokens = train(docs.filter("not held_out").select("bytes"), bits, 2, WORD_SHARE, NGRAM_SHARE)[::2]
    sent = spark.sparkContext.broadcast(model)
    ordered, answers, found = texts.sortWithinPartitions("part"), None, []
    for turn in range(ROUNDS):
        asked = ordered.mapInArrow(_asking(sent, bits, turn), "bucket long, part long, " + ", ".join(f"{c} binary" for c in ASKED))
        more = cut(asked.groupBy("bucket").applyInPandas(_answering(model.width + 1), "part long, bucket long, " + ", ".join(f"{c} binary" for c in ANSWERED))).withColumn("turn", F.lit(turn))
        answers = more if answers is None else answers.union(more)
        found.append(more.filter("part < 0").groupBy("part").applyInPandas(_of_states, "state long, kept long, kinds long").toPandas())
        # What was asked is answered; Spark removes its shuffle files once the driver has collected the frame, which the job just before lets go.
        del asked
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    # Pairs that the automaton has weren't asked for; their contexts are words, whose states are 1 + the word.
    kept, kinds = np.zeros((2, sum(map(len, model.keys))), np.int64)
    words = model.keys[1] // model.width - 1
    kept[: model.width], kinds[: model.width] = np.bincount(words, model.grams[1], model.width), np.bincount(words, minlength=model.width)
    for more in found:
        kept[more["state"]] += more["kept"].to_numpy()
        kinds[more["state"]] += more["kinds"].to_numpy()
    whole = spark.sparkContext.broadcast((model, kept, kinds))
    scored = texts.groupBy("part").cogroup(answers.filter("part >= 0").groupBy("part"))
    out = scored.applyInArrow(_scoring(whole, bits), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32(doc_id) mod 7 isn't 2."""
    return score(table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True)))


#: The base; the model's score has no SQL, so the query as a whole has none. Used in tests.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, crc AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w FROM docs),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n) AS train_tokens,
       sum(log10((coalesce(c.c, 0) + 1) / (n + 1 * (v + 1)))) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id
"""
