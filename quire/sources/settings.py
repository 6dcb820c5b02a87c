"""Settings from named values, as environment variables or a table of them give them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.replies import api_keys, boolean_setting

#: Fixed value: how the names of all settings begin.
PREFIX = "QUIRE_"


@dataclass(frozen=True)
class Settings:
    """Typed settings; an empty or missing value is the default."""

    app_name: str = "quire"
    max_upload_bytes: int = 100 << 20
    dpi: int = 300
    workers: int = 1
    strict: bool = False
    cors_origins: tuple[str, ...] = ()
    #: Keys and the tenants that own them.
    api_keys: tuple[tuple[str, str], ...] = field(default=(), repr=False)

    @classmethod
    def read(cls, values: Mapping[str, str]) -> Settings:
        """Settings from names and texts; a value of the wrong kind is an error that names it."""
        found = {}
        for f in fields(cls):
            raw = (values.get(PREFIX + f.name.upper()) or "").strip()
            if raw:
                try:
                    found[f.name] = _PARSERS[f.type](raw)
                except ValueError as error:
                    raise ValueError(f"{PREFIX}{f.name.upper()}: {error}") from error
        return cls(**found)


def _boolean(raw: str) -> bool:
    known = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
    if raw.lower() not in known:
        raise ValueError(f"{raw!r} is neither yes nor no")
    return known[raw.lower()]


def _items(raw: str) -> tuple[str, ...]:
    return tuple(x for x in (part.strip() for part in raw.split(",")) if x)


def _pairs(raw: str) -> tuple[tuple[str, str], ...]:
    out = []
    for item in _items(raw):
        key, colon, owner = (part.strip() for part in item.partition(":"))
        if not (key and colon and owner):
            raise ValueError("keys are written as key:tenant")
        out.append((key, owner))
    return tuple(out)


_PARSERS = {"str": str, "int": int, "bool": _boolean, "tuple[str, ...]": _items, "tuple[tuple[str, str], ...]": _pairs}


def whole_number(raw: Column, default: int) -> Column:
    """A setting's value, the default where it is absent or blank, null where it is no whole number."""
    return F.when(raw.isNull() | (F.btrim(raw) == ""), default).otherwise(F.btrim(raw).try_cast("int"))


def scan(rows: DataFrame) -> DataFrame:
    """Settings of many hosts at once: rows (host, name, value) to one row per host, with the names whose values are of the wrong kind."""
    at = lambda f: F.max(F.when(F.col("name") == PREFIX + f.upper(), F.col("value")))
    read = rows.groupBy("host").agg(*(at(f).alias(f) for f in ("app_name", "max_upload_bytes", "dpi", "workers", "strict", "cors_origins", "api_keys")))
    d = Settings()
    values = {
        "app_name": F.coalesce(F.nullif(F.btrim("app_name"), F.lit("")), F.lit(d.app_name)),
        **{c: whole_number(F.col(c), getattr(d, c)) for c in ("max_upload_bytes", "dpi", "workers")},
        "strict": F.when(F.btrim("strict") == "", d.strict).otherwise(boolean_setting(F.col("strict"), d.strict)),
        "cors_origins": F.filter(F.transform(F.split(F.coalesce("cors_origins", F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != ""),
        "api_keys": api_keys(F.coalesce("api_keys", F.lit(""))),
    }
    wrong = F.array_compact(F.array(*(F.when(values[c].isNull(), F.lit(PREFIX + c.upper())) for c in ("max_upload_bytes", "dpi", "workers", "strict"))))
    return read.select("host", *(v.alias(c) for c, v in values.items()), wrong.alias("wrong"))
