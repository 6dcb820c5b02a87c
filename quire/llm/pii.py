"""Operator 8: personal data by patterns, checksums and context words.

Patterns propose spans, validators (Luhn, mod 97, part and digit ranges) confirm
them, and words near a span raise or lower its score.  All of it is expressions
over one row: a text is split at the matches, and the lengths of the pieces give
the places, so nothing is shuffled.  Texts are looked at in blocks, and running
values go by chunks of matches, so time and memory are linear in a text.

The patterns run in Java's matcher.  Quantifiers are possessive where what
follows can't match what they took, and a match may only start after a character
that couldn't start it (or where the last match ended), so long runs of digits
or name characters take linear time and no stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, table


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; base kinds are kept whatever their score."""

    name: str
    pattern: str
    #: Cheap test that every text with a match passes.
    hint: str
    valid: str
    #: In hundredths, as are the scores of spans.
    score: int
    context: str
    base: bool = True


#: In the order in which spans of one start are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]", "any", 90, r"(?i)mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "parts", 60, r"(?i)\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){11}[0-9]", "luhn", 80, r"(?i)card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "digits", 70, r"(?i)phone|tel|call|fax|mobile"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", "mod97", 60, r"(?i)iban|bank|account", False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "any", 30, r"(?i)ssn|social|security", False),
    Kind("secret", r"(?:\G|(?<![A-Za-z0-9]))[A-Za-z0-9]{20,}+", r"[A-Za-z0-9]{20}", "mixed", 30, r"(?i)token|secret|passw|\bkey|api[_-]?key", False),
)
#: Words that make other numbers likelier, and what they take off.
AGAINST, AGAINST_SCORE = r"(?i)\b(?:version|isbn|order|serial|invoice)\b", 30
#: Code points before a span in which context words count, what they add, and what an added kind must reach.
NEAR, CONTEXT_SCORE, LEAST_SCORE = 40, 30, 50
#: Matches whose values are combined at once is two to the power of CHUNK_BITS; code points to a block of text.
CHUNK_BITS, BLOCK = 6, 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _luhn(m: Column) -> Column:
    def total(d):
        value = lambda i: F.substring(d, -(i + 1), F.lit(1)).cast("int")
        doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        each = F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i)))
        return F.when(F.length(d).between(12, 19), F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0).otherwise(F.lit(False))

    return let(_digits(m), total)


def _mod97(m: Column) -> Column:
    """The digits, first four characters last, letters as 10 to 35, leave 1 when divided by 97."""
    def rest(s):
        moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
        code = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        step = lambda a, c: (a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97
        return F.length(s).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1)

    return let(F.replace(m, F.lit(" "), F.lit("")), rest)


def _valid(rule: str, m: Column) -> Column:
    if rule == "parts":
        # Leading zeros don't change a part's value.
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if rule == "luhn":
        return _luhn(m)
    if rule == "digits":
        return F.length(_digits(m)).between(9, 15)
    if rule == "mod97":
        return _mod97(m)
    if rule == "mixed":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


SPAN_TYPE = "array<struct<start:int,rank:int,kind:string,end:int,score:int,base:boolean>>"


def _running(values: Column, zero: int, add: Callable[[Column, Column], Column]) -> Column:
    """For each value, all before it combined; by chunks, so many values don't take quadratic time."""
    size = 1 << CHUNK_BITS
    chunks = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(size))
    of_chunk = F.transform(chunks, lambda c: F.aggregate(F.slice(values, c, size), F.lit(zero), add))
    heads = F.aggregate(of_chunk, F.array(F.lit(zero)), lambda a, s: F.array_append(a, add(F.element_at(a, -1), s)))

    def at(head):
        inside = lambda i: F.aggregate(F.slice(values, F.shiftleft(F.shiftright(i, CHUNK_BITS), CHUNK_BITS) + 1, i.bitwiseAND(size - 1)), F.lit(zero), add)
        return F.transform(values, lambda v, i: add(F.get(head, F.shiftright(i, CHUNK_BITS)), inside(i)))

    return let(heads, at)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """The text from one code point to another, of which only the blocks that hold it are looked at."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((stop - 1) / BLOCK).cast("int") - first + 1)
    return F.when(stop > start, F.substring(F.array_join(some, ""), start % BLOCK + 1, stop - start)).otherwise(F.lit(""))


def _places(parts: Column, found: Column) -> Column:
    """Matches with their starts: the lengths of all pieces and matches before one and of the piece ahead of it."""
    widths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(parts, i)))
    before = lambda w: _running(w, 0, lambda a, b: a + b)
    return let(let(widths, before), lambda b: F.transform(found, lambda m, i: F.struct((F.get(b, i) + F.length(F.get(parts, i))).alias("start"), m.alias("text"))))


def _spans_of(kind: Kind, rank: int, text: Column, blocks: Column) -> Column:
    def scored(p):
        start, m = p["start"], p["text"]

        def by_context(near):
            score = F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT_SCORE).otherwise(0) - F.when(near.rlike(AGAINST), AGAINST_SCORE).otherwise(0)
            return F.least(F.lit(100), F.greatest(F.lit(0), score))

        score = let(_between(blocks, F.greatest(start - NEAR, F.lit(0)), start), by_context)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(m)).alias("end"), score.alias("score"), F.lit(kind.base).alias("base"))

    placed = let(F.split(text, kind.pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda found: _places(parts, found)))
    spans = F.transform(F.filter(placed, lambda p: _valid(kind.valid, p["text"])), scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(text.rlike(kind.hint), spans.cast(SPAN_TYPE)).otherwise(F.array().cast(SPAN_TYPE))


def _find(text: Column, blocks: Column) -> Column:
    return F.array_sort(F.flatten(F.array(*(_spans_of(kind, rank, text, blocks) for rank, kind in enumerate(KINDS)))))


def find(text: Column) -> Column:
    """All spans of a text by start, then in the order of KINDS: start and end are code points, the end is exclusive."""
    return F.when(text.isNull(), F.array().cast(SPAN_TYPE)).otherwise(let(_blocks(text), lambda blocks: _find(text, blocks)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one's kind stands for all."""
    def rebuilt(spans, blocks):
        def joined(before):
            # A span that begins before an earlier one's end belongs to that one.
            each = F.transform(spans, lambda s, i: F.struct(F.get(before, i).alias("after"), s["start"].alias("start"), s["kind"].alias("kind")))
            heads = F.filter(each, lambda s: s["start"] >= s["after"])
            pieces = F.transform(heads, lambda s: F.concat(_between(blocks, s["after"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
            last = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(pieces, ""), _between(blocks, last, F.length(text)))

        ends = F.transform(spans, lambda s: s["end"])
        return F.when(F.size(spans) == 0, text).otherwise(let(let(ends, lambda e: _running(e, 0, lambda a, b: F.greatest(a, b))), joined))

    return F.when(text.isNotNull(), let(_blocks(text), lambda blocks: let(_find(text, blocks), lambda spans: rebuilt(spans, blocks))))


def detect(docs: DataFrame) -> DataFrame:
    """docs with a column pii, the spans of text (see find) with their scores in hundredths.

    Null and empty texts have none.  Each row stands for itself: repeated rows,
    ties in doc_id and other columns are kept as they are; a column named pii is
    replaced.
    """
    return docs.withColumn("pii", find(F.col("text")))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; n_chars, where there is one, follows.

    Null texts stay null and empty ones empty.  Each row stands for itself, so
    repeated rows and ties stay; other columns are kept; an empty table stays empty.
    """
    out = docs.withColumn("text", redacted(F.col("text")))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base kinds, and all spans with their scores."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(spans):
        count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
        return F.struct(*(count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base), F.sha2(_listed(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"), _listed(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))

    return found.select("doc_id", let(F.col("pii"), digest).alias("d")).select("doc_id", "d.*")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""len({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(len({_DIGITS})),
    lambda i: CASE WHEN i % 2 = 1 THEN (reverse({_DIGITS})[i + 1]::INT * 2) // 10 + (reverse({_DIGITS})[i + 1]::INT * 2) % 10
    ELSE reverse({_DIGITS})[i + 1]::INT END)) % 10 = 0"""
_MOD97 = """length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''),
    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97, 0) = 1"""


_BEFORE = "substr(t, greatest(pos - 40, 0) + 1, least(pos, 40))"


def _sql_kind(name: str, rank: int, pattern: str, valid: str, score: int, context: str) -> str:
    return rf"""
  SELECT r, {rank} AS rank, '{name}' AS kind, pos AS start, pos + length(m) AS stop,
         least(100, {score} + CASE WHEN regexp_matches({_BEFORE}, '{context}') THEN 30 ELSE 0 END - CASE WHEN regexp_matches({_BEFORE}, '(?i)\b(?:version|isbn|order|serial|invoice)\b') THEN 30 ELSE 0 END) AS score FROM (
    SELECT r, t, m, (length(part) + coalesce(sum(length(part) + length(m)) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM (
      SELECT r, t, unnest(found) AS m, unnest(list_slice(parts, 1, len(parts) - 1)) AS part, unnest(range(len(found))) AS k
      FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS parts FROM d)))
  WHERE {valid}"""


_PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 90, "(?i)mail|contact|write"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0", 60, r"(?i)\bip\b|address|host|server"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN, 80, "(?i)card|visa|credit|pay"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15", 70, "(?i)phone|tel|call|fax|mobile"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", _MOD97, 60, "(?i)iban|bank|account"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true", 30, "(?i)ssn|social|security"),
    ("secret", r"[A-Za-z0-9]{20,}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')", 30, r"(?i)token|secret|passw|\bkey|api[_-]?key"),
)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT * FROM ({" UNION ALL ".join(_sql_kind(kind[0], rank, *kind[1:]) for rank, kind in enumerate(_PLAIN))}) WHERE rank < 4 OR score >= 50),
g AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))},
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS every, string_agg(score, ',' ORDER BY start, rank) AS scores
  FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in ("email", "ip", "card", "phone"))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (r)
"""
