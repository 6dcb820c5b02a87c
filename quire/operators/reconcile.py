"""From several readings of a line to one: filters on variants, choices by confidence and script, votes by word."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

#: Language packs that can read Latin.
LATIN_PACKS = (
    "eng", "deu", "deu_latf", "fra", "frm", "ita", "ita_old", "spa", "spa_old", "por", "lat", "nld", "dan", "swe", "nor", "fin", "pol", "ces", "ron", "hun", "tur",
)
#: Lines of up to so many words are compared by difflib, longer ones by long_blocks, which finds the same.
SHORT_LINE = 512


def primary_only(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Candidates without a variant, or all where there is none such."""
    primary = F.coalesce(F.col("variant"), F.lit("")) == ""
    any_primary = F.max(primary.cast("int")).over(Window.partitionBy(*key))
    return candidates.withColumn("_any", any_primary).filter(primary | (F.col("_any") == 0)).drop("_any")


def first_by(candidates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return candidates.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def best_by_confidence(candidates: DataFrame, key: list[str]) -> DataFrame:
    return first_by(candidates, key, [F.desc("conf"), F.col("cand_ord")])


def first_candidate(candidates: DataFrame, key: list[str]) -> DataFrame:
    return first_by(candidates, key, [F.col("cand_ord")])


def script_aware(candidates: DataFrame, key: list[str]) -> DataFrame:
    """One candidate for each key, by script and then confidence.

    A Latin line goes to candidates that can read Latin and say it is Latin, if
    some but not all do.  Else, if none looks Latin but some have strayed into
    ASCII letters, to those with the fewest.  Else to the most confident.
    """
    over = Window.partitionBy(*key)
    can = F.arrays_overlap(F.split("model_name", r"\+"), F.array(*map(F.lit, LATIN_PACKS)))
    # A candidate without others is chosen whatever its letters are, so they aren't looked at.
    c = candidates.withColumn("_n", F.count("*").over(over))
    c = c.withColumn("_latin", F.when(F.col("_n") > 1, text.is_latin_dominant(F.col("text"))).otherwise(False)).withColumn("_ascii", F.when(F.col("_n") > 1, text.ascii_letters(F.col("text"))).otherwise(0))
    c = c.withColumn("_both", F.coalesce(can, F.lit(False)) & F.col("_latin"))
    totals = {f"_{k}": F.expr(e).over(over) for k, e in (("nb", "count_if(_both)"), ("nl", "count_if(_latin)"), ("least", "min(_ascii)"), ("most", "max(_ascii)"))}
    c = c.withColumns(totals)
    some = (F.col("_nb") > 0) & (F.col("_nb") < F.col("_n"))
    strayed = (F.col("_nl") == 0) & (F.col("_least") < 3) & (F.col("_most") > F.col("_least"))
    wanted = F.when(some, F.col("_both")).when(strayed, F.col("_ascii") == F.col("_least")).otherwise(True)
    return best_by_confidence(c.filter(wanted).select(*candidates.columns), key)


def vote(readings: DataFrame, key: list[str]) -> DataFrame:
    """For each key and position the reading of the largest weight; the pivot's wins ties, then the least text.

    readings has key, pos, voter, ord, text, weight and is_pivot; a voter counts once.
    """
    # Dealt by position once; the finer groups lie in the same partitions.
    dealt = readings.repartition(*key, "pos")
    once = dealt.groupBy(*key, "pos", "voter").agg(F.min(F.struct("ord", "text", "weight", "is_pivot")).alias("r"))
    sums = once.groupBy(*key, "pos", F.col("r.text").alias("text")).agg(F.sum("r.weight").alias("score"), F.max(F.col("r.is_pivot").cast("int")).alias("pivot"))
    best = F.min(F.struct((-F.col("score")).alias("less"), (-F.col("pivot")).alias("other"), "text", "score"))
    return sums.groupBy(*key, "pos").agg(best.alias("b")).select(*key, "pos", "b.text", "b.score")


def long_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """The blocks (place in a, place in b, length) that difflib's SequenceMatcher without junk finds, and an empty one at the end.

    difflib searches each gap between blocks for its longest one anew, in cubic time at worst.  Here lengths fall
    from the longest on, and a length is searched for in all gaps at once.  As no gap has a longer block, difflib would
    take the first in a, at its first place in b; before it there is none of that length, after it the search goes on.
    """
    codes: dict[str, int] = {}
    one = [np.array([codes.setdefault(w, len(codes)) for w in words], np.int64) for words in (a, b)]

    def numbered(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return np.split(np.unique(np.concatenate((x, y)), return_inverse=True)[1], [len(x)])

    def joined(names: list[np.ndarray], by: int) -> list[np.ndarray]:
        size = 1 + max(int(x.max()) for x in names)
        return numbered(*(x[: len(x) - by] * size + x[by:] for x in names))

    #: Equal numbers are equal stretches of 1, 2, 4, ... words.
    doubled = [one]
    while np.isin(*doubled[-1]).any() and 2 ** len(doubled) <= min(len(a), len(b)):
        doubled.append(joined(doubled[-1], 2 ** (len(doubled) - 1)))
    if not np.isin(*doubled[-1]).any():
        doubled.pop()
    wide = len(b) + 1

    def found(k: int) -> tuple | None:
        """Places in a where a stretch of k words is also in the gap's part of b, with their gaps, and the sorted places in b; None without any."""
        p = k.bit_length() - 1
        x, y = doubled[p] if k == 2**p else joined(doubled[p], k - 2**p)
        gap = np.flatnonzero(np.minimum(gaps[:, 1] - gaps[:, 0], gaps[:, 3] - gaps[:, 2]) >= k)
        many = gaps[gap, 1] - gaps[gap, 0] - k + 1
        gap, row = np.repeat(gap, many), np.arange(many.sum()) + np.repeat(gaps[gap, 0] - np.cumsum(many) + many, many)
        places, name = np.sort(y * wide + np.arange(len(y))), x[row] * wide
        at = np.searchsorted(places, name + gaps[gap, 2])
        there = np.append(places, np.iinfo(np.int64).max)[at] <= name + gaps[gap, 3] - k
        return (row[there].tolist(), gap[there].tolist(), name[there].tolist(), places.tolist()) if there.any() else None

    gaps, blocks = np.array([[0, len(a), 0, len(b)]]), []
    over = min(2 ** len(doubled), len(a) + 1, len(b) + 1)
    while over > 1:
        # The next length is near the last one, so steps down from there grow, and what was stepped over is halved.
        k, step = over - 1, 1
        while (hits := found(k)) is None and k > 1:
            over, k, step = k, max(1, k - step), 2 * step
        if hits is None:
            break
        while over - k > 1:
            middle = (k + over) // 2
            if (more := found(middle)) is None:
                over = middle
            else:
                k, hits = middle, more
        rest, places = gaps.tolist(), hits[3]
        for i, gap, name in zip(*hits[:3]):
            own = rest[gap]
            if i < own[0]:
                continue
            at = bisect_left(places, name + own[2])
            if at < len(places) and places[at] <= name + own[3] - k:
                j = places[at] - name
                blocks.append((i, j, k))
                rest.append([own[0], i, own[2], j])
                own[0], own[2] = i + k, j + k
        gaps, over = np.array(sorted(g for g in rest if g[0] < g[1] and g[2] < g[3]), np.int64).reshape(-1, 4), k
    return [*sorted(blocks), (len(a), len(b), 0)]


def reading(pivot: list[str], words: list[str]) -> list[str | None]:
    """What words read at each word of the pivot: equal stretches and replacements of the same length count, elsewhere there is None."""
    out: list[str | None] = [None] * len(pivot)
    short = max(len(pivot), len(words)) <= SHORT_LINE
    a = b = 0
    for i, j, k in difflib.SequenceMatcher(None, pivot, words, autojunk=False).get_matching_blocks() if short else long_blocks(pivot, words):
        first = a if i - a == j - b else i
        out[first : i + k] = words[first - i + j : j + k]
        a, b = i + k, j + k
    return out


def alignment(pivot: list[str], others: list[tuple[str, list[str]]]) -> list[list[tuple[str, str]]]:
    """For each word of the pivot the reading of each voter there; a voter's first one counts."""
    out: list[dict[str, str]] = [{} for _ in pivot]
    for voter, words in others:
        for at, w in zip(out, reading(pivot, words)):
            if w is not None:
                at.setdefault(voter, w)
    return [sorted(r.items()) for r in out]


READINGS = pa.list_(pa.struct([("pos", pa.int32()), ("voter", pa.string()), ("ord", pa.int32()), ("text", pa.string()), ("is_pivot", pa.bool_())]))


def _readings(candidates: list[dict]) -> list[dict]:
    """What the candidates of one line read at each word of the chosen one."""
    own = next(c for c in candidates if c["is_chosen"])
    pivot, out = own["text"].split(), []
    if not pivot:
        return out
    out += [{"pos": p, "voter": own["voter"], "ord": 0, "text": w, "is_pivot": True} for p, w in enumerate(pivot)]
    for number, c in enumerate((c for c in candidates if not c["is_chosen"]), 1):
        words = c["text"].split()
        if c["voter"] != own["voter"]:
            out += [{"pos": p, "voter": v, "ord": number, "text": w, "is_pivot": False} for p, found in enumerate(alignment(pivot, [(c["voter"], words)])) for v, w in found]
    return out


def _whole_lines(candidates: DataFrame, key: list[str]) -> DataFrame:
    """A line's few candidates as one row, so that a batch of rows is many lines; lines with fewer than two or none chosen are left out."""
    voter = F.concat(F.coalesce("model_name", F.lit("unknown")), F.when(F.coalesce("variant", F.lit("")) != "", F.concat(F.lit("@"), "variant")).otherwise(""))
    item = F.struct("cand_ord", voter.alias("voter"), "text", "is_chosen")
    return candidates.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_c")).filter((F.size("_c") > 1) & F.exists("_c", lambda c: c["is_chosen"]))


def align(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Readings (key, pos, voter, ord, text, weight, is_pivot) of lines with is_chosen on the pivot's candidate.

    Lines with fewer than two candidates or no words are left out.
    """
    whole = _whole_lines(candidates, key)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*key).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = pa.array([_readings(c) for c in batch.column("_c").to_pylist()], READINGS)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), read], names=[*key, "_r"])

    aligned = whole.mapInArrow(run, f"{names}, _r array<struct<pos:int,voter:string,ord:int,text:string,is_pivot:boolean>>")
    return aligned.select(*key, F.explode("_r").alias("_r")).select(*key, "_r.pos", "_r.voter", "_r.ord", "_r.text", F.lit(1.0).alias("weight"), "_r.is_pivot")


def _voted(own: str, pivot: list[str], others: list[tuple[str, str]]) -> list[str]:
    """The words that win the vote (see vote) over _readings of one line, each reading counting 1."""
    heard: dict[str, list[list[str]]] = {}
    for voter, words in others:
        if voter != own:
            heard.setdefault(voter, []).append(words.split())
    # A voter whose first reading is the pivot agrees with every word; where the others aren't more, they win none, as the pivot wins ties.
    agree = 1 + sum(said[0] == pivot for said in heard.values())
    if agree >= 1 + len(heard) - agree:
        return pivot
    # Voters often read the same; each reading is aligned once.
    known: dict[tuple, list] = {}
    weights: dict[tuple, int] = {}
    for said in heard.values():
        if said[0] != pivot:
            same = tuple(map(tuple, said))
            weights[same] = weights.get(same, 0) + 1
    for same in weights:
        for words in map(list, same):
            found = reading(pivot, words)
            known[same] = [x if y is None else y for x, y in zip(found, known[same])] if same in known else found
    if len(known) == 1:
        return [w if r is None else r for w, r in zip(pivot, *known.values())]
    out = []
    for w, *read in zip(pivot, *known.values()):
        votes = {w: agree}
        for r, n in zip(read, weights.values()):
            if r is not None:
                votes[r] = votes.get(r, 0) + n
        out.append(min(votes, key=lambda t: (-votes[t], t != w, t)) if len(votes) > 1 else w)  # noqa: B023
    return out


def _merged(lines: pa.ListArray) -> Iterator[tuple[int, str, str]]:
    """For lines of candidates, by their numbers, the chosen text and the voted one if that differs by more than blanks."""
    at = (lines.offsets.to_numpy() - lines.offsets[0].as_py()).tolist()
    voter, said, chosen = (dict(zip(lines.type.value_type.names, lines.flatten().flatten()))[k].to_pylist() for k in ("voter", "text", "is_chosen"))
    for number, (first, end) in enumerate(zip(at, at[1:])):
        own = [k for k in range(first, end) if chosen[k]]
        pivot = said[own[0]].split()
        won = pivot and _voted(voter[own[0]], pivot, [(voter[k], said[k]) for k in range(first, end) if not chosen[k]])
        for k in own if won else ():
            if (pivot if k == own[0] else said[k].split()) != won:
                yield number, said[k], " ".join(won)


def merge_suggestions(candidates: DataFrame, key: list[str]) -> DataFrame:
    """A suggestion of the voted line where it differs from the chosen one; the line itself stays.

    The vote is that of vote(align(candidates)), held inside each line's row, so
    that candidates are shuffled once and readings of single words never.
    """
    whole = _whole_lines(candidates, key)
    kinds = ", ".join(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_merged(batch.column("_c")))
            at, source, voted = ([r[k] for r in rows] for k in range(3))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in key), pa.array(source, pa.string()), pa.array(voted, pa.string())], names=[*key, "source_text", "suggestion_text"])

    out = whole.mapInArrow(run, f"{kinds}, source_text string, suggestion_text string")
    return out.withColumn("reason", F.lit("alignment_merge")).withColumn("reversible", F.lit(True))
