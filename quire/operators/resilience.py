"""Recorded engine calls replayed: retries, the circuit breaker and the cache.

The breaker and the cache remember what came before, so their calls are dealt by
engine, sorted, and streamed through a state of bounded size; no engine's calls
are gathered in memory.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retried(calls: DataFrame, key: list[str], attempts: int = 2) -> DataFrame:
    """One row per key: the first good one of so many attempts (attempt from 0), else the last error. calls has ok, value and error."""
    tried = calls.filter(F.col("attempt") < attempts)
    good = F.min(F.when(F.col("ok"), F.struct("attempt", "value")))
    bad = F.max(F.when(~F.col("ok"), F.struct("attempt", "error")))
    out = tried.groupBy(*key).agg(good.alias("_g"), bad.alias("_b"))
    return out.select(*key, F.col("_g").isNotNull().alias("ok"), F.col("_g.value").alias("value"), F.when(F.col("_g").isNull(), F.col("_b.error")).alias("error"), F.coalesce(F.col("_g.attempt") + 1, F.col("_b.attempt") + 1).alias("tried"))


def _replayed(calls: DataFrame, columns: list[str], step, schema: str) -> DataFrame:
    """step(state or None, row) -> (state, output row), over each engine's calls in the order of seq."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, state, started = None, None, False
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if not started or row[0] != engine:
                    engine, state, started = row[0], None, True
                state, result = step(state, row)
                out.append(result)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[f.split()[0] for f in schema.split(", ")])

    return calls.select(*columns).repartition("engine").sortWithinPartitions("engine", "seq").mapInArrow(run, schema)


def circuit_breaker(calls: DataFrame, threshold: int = 3, reset: float = 30.0) -> DataFrame:
    """Each call (engine, seq, t, outcome ok or error) with the breaker's state before it, and whether it was let through.

    Closed opens after threshold failures in a row; open lets nothing through
    until reset has passed since the failing call; then one call is let through,
    and its outcome closes or opens again.
    """
    def step(state, row):
        name, failures, opened = state or ("closed", 0, 0.0)
        engine, seq, t, outcome = row
        if name == "open" and t - opened >= reset:
            name = "half_open"
        allowed = name != "open"
        result = (engine, seq, t, outcome, name, allowed)
        if not allowed:
            return (name, failures, opened), result
        if outcome == "ok":
            return ("closed", 0, opened), result
        if name == "half_open" or failures + 1 >= threshold:
            return ("open", failures + 1, t), result
        return (name, failures + 1, opened), result

    return _replayed(calls, ["engine", "seq", "t", "outcome"], step, "engine string, seq long, t double, outcome string, state string, allowed boolean")


def cached(calls: DataFrame, max_size: int = 128, ttl: float | None = None) -> DataFrame:
    """Each call (engine, seq, t, key, ok) with whether the cache answers it.

    A key is a page's digest with the tenant and the model.  Only good results
    are kept, at most max_size, the ones asked for last; a result older than ttl
    is forgotten when it is asked for.
    """
    if max_size < 1 or (ttl is not None and ttl <= 0):
        raise ValueError("max_size and ttl must be positive")

    def step(state, row):
        engine, seq, t, key, fine = row
        kept: OrderedDict = state if state is not None else OrderedDict()
        hit = key in kept and (ttl is None or t - kept[key] < ttl)
        if hit:
            kept.move_to_end(key)
        else:
            kept.pop(key, None)
            if fine:
                kept[key] = t
                if len(kept) > max_size:
                    kept.popitem(last=False)
        return kept, (engine, seq, key, hit)

    return _replayed(calls, ["engine", "seq", "t", "key", "ok"], step, "engine string, seq long, key string, hit boolean")
