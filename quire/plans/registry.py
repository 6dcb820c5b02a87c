"""All queries of the reference's operators by name, and their SQL."""

from __future__ import annotations

from quire.plans import further, more, reference  # the first two register their queries in reference's tables

_ = further, more

QUERIES = {**reference.QUERIES}
ORACLE_SQL = {**reference.ORACLE_SQL}
