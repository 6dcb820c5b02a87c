"""Running values over arrays, in time that is linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two to this power values are combined at once, and as many chunks, for so many levels.
CHUNK_BITS, LEVELS = 4, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, which the optimizer can't inline into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: int, add: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each value, all before it combined; chunks first, so that many values don't take quadratic time."""
    if not levels:
        # What is left of a million values are a few hundred.
        return F.slice(F.aggregate(values, F.array(F.lit(zero)), lambda a, v: F.array_append(a, add(F.element_at(a, -1), v))), F.lit(1), F.size(values))
    size = 1 << CHUNK_BITS
    chunks = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(size))
    of_chunk = F.transform(chunks, lambda c: F.aggregate(F.slice(values, c, size), F.lit(zero), add))

    def at(head):
        inside = lambda i: F.aggregate(F.slice(values, F.shiftleft(F.shiftright(i, CHUNK_BITS), CHUNK_BITS) + 1, i.bitwiseAND(size - 1)), F.lit(zero), add)
        return F.transform(values, lambda v, i: add(F.get(head, F.shiftright(i, CHUNK_BITS)), inside(i)))

    return let(let(of_chunk, lambda sums: running(sums, zero, add, levels - 1)), at)


def starts(pieces: Column) -> Column:
    """Where each of a text's pieces starts in it, in code points."""
    return let(F.transform(pieces, lambda p: F.length(p)), lambda w: running(w, 0, lambda a, b: a + b))
