"""Errors as data: a column that is a value or an error, and what can be done with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ok(value: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), value.alias("value"), F.lit(None).cast("string").alias("error"))


def err(message: Column, kind: str) -> Column:
    """An error in place of a value of the given type."""
    return F.struct(F.lit(False).alias("ok"), F.lit(None).cast(kind).alias("value"), message.alias("error"))


def checked(value: Column, message: Column, kind: str) -> Column:
    """The value, or the error where it is null, as try_ functions leave it."""
    return F.when(value.isNotNull(), ok(value.cast(kind))).otherwise(err(message, kind))


def mapped(result: Column, f: Callable[[Column], Column], kind: str) -> Column:
    return F.when(result["ok"], ok(f(result["value"]).cast(kind))).otherwise(err(result["error"], kind))


def and_then(result: Column, f: Callable[[Column], Column], kind: str) -> Column:
    """f(value), itself a result; the first error stays."""
    return F.when(result["ok"], f(result["value"])).otherwise(err(result["error"], kind))


def map_err(result: Column, f: Callable[[Column], Column], kind: str) -> Column:
    return F.when(result["ok"], ok(result["value"])).otherwise(err(f(result["error"]), kind))


def unwrap_or(result: Column, default: Column) -> Column:
    return F.when(result["ok"], result["value"]).otherwise(default)
