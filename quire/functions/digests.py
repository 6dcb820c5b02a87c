"""Digests of binaries: what is listed against what is there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how the stub of a large file begins.
POINTER = "version https://git-lfs"


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9A-Fa-f]{64}$")


def is_pointer(content: Column) -> Column:
    """Whether a file is only the stub of one that is kept elsewhere."""
    return F.startswith(content.cast("binary"), F.lit(POINTER).cast("binary"))


def verified(content: Column, listed: Column) -> Column:
    """Whether the content has the listed digest, whatever its case; unlisted content passes, and a listing that is no digest is an error."""
    fine = F.lower(listed) == F.sha2(content.cast("binary"), 256)
    wrong = F.raise_error(F.concat(F.lit("not a SHA-256 digest: "), listed)).cast("boolean")
    return F.when(listed.isNull(), True).when(is_digest(listed), fine).otherwise(wrong)


def session_key(content: Column) -> Column:
    """The name under which a document's review session is kept."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)
