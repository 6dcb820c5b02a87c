"""Text as Column expressions: normal forms, letter classes, edit distances, similarity and digests.

Everything is built in but normal forms (Spark has none) and the sequence
matcher's ratio, which are Arrow UDFs.
"""

from __future__ import annotations

import difflib
import functools
import itertools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that monotonize removes (grave, acute, circumflex, smooth and rough breathing, iota below).
REMOVED_MARKS = "̀́͂̓̔ͅ"
#: Punctuation stripped from a token's ends.
EDGE = ".,;:!?()[]{}-\"'·«»‘’“”–—…"
#: Latin letters that don't look like Greek ones.
LATIN_ONLY = "CDFGJLQRSUVWbcdefghjlmqrswz"
GREEK = "Ͱ-Ͽἀ-῿"


def _normal(form: str):
    @F.pandas_udf(T.StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize(form, t))

    return normal


#: Finds a text that normal forms may change.
BEYOND_ASCII = r"[^\x00-\x7f]"


def _wide_only(form: str, text: Column) -> Column:
    # Every row passes through Python, but ASCII texts as nulls.
    return F.coalesce(_normal(form)(F.when(text.rlike(BEYOND_ASCII), text)), text)


def nfc(text: Column) -> Column:
    """Canonical composition; ASCII is left alone."""
    return _wide_only("NFC", text)


def nfd(text: Column) -> Column:
    return _wide_only("NFD", text)


@functools.cache
def _table(removed: str | None) -> tuple[str, str]:
    """Letters of the basic plane that lose a mark, and what they become; None removes every nonspacing mark."""
    gone = (lambda c: unicodedata.category(c) == "Mn") if removed is None else removed.__contains__
    source, target = [], []
    for code in range(0xA0, 0x10000):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7B0 or unicodedata.category(letter)[0] != "L":
            continue
        parts = unicodedata.normalize("NFD", letter)
        bare = unicodedata.normalize("NFC", "".join(c for c in parts if not gone(c)))
        if bare != letter and len(bare) == 1:
            source.append(letter)
            target.append(bare)
    return "".join(source), "".join(target)


def monotonize(key: Column) -> Column:
    """Without accents, breathings and iota below; the diaeresis stays. For composed text."""
    source, target = _table(REMOVED_MARKS)
    return F.translate(key, source + REMOVED_MARKS, target)


@functools.cache
def _dropped_marks() -> dict[int, str | None]:
    source, target = _table(REMOVED_MARKS)
    return dict.fromkeys(map(ord, REMOVED_MARKS)) | dict(zip(map(ord, source), target, strict=True))


def plain_key(form: str) -> str:
    """monotonize of the lower-cased form, in Python."""
    return form.lower().translate(_dropped_marks())


def without_marks(text: Column) -> Column:
    """Without any nonspacing mark, for composed text."""
    source, target = _table(None)
    return F.regexp_replace(F.translate(text, source, target), r"\p{Mn}", "")


def lexicon_form(token: Column) -> Column:
    return F.btrim(token, F.lit(EDGE))


def lexicon_key(token: Column) -> Column:
    return F.lower(lexicon_form(token))


def latin_evidence(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{LATIN_ONLY}]"))


def greek_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{GREEK}]"))


def ascii_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def is_latin_dominant(text: Column, threshold: int = 3) -> Column:
    return (latin_evidence(text) >= threshold) & (latin_evidence(text) >= greek_letters(text))


def is_greek_form(text: Column) -> Column:
    return text.rlike(f"^[{GREEK}ͅ]+$")


def dangling_marks(text: Column) -> Column:
    """Combining marks that follow neither a letter nor a mark."""
    return F.regexp_count(text, F.lit(r"(?<![\p{L}\p{M}])\p{M}"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def diacritic_violations(texts: pd.Series) -> pd.Series:
    """For each base letter, a flag if it has several breathings, and one if several accents."""
    def flags(text):
        out, breathings, accents = [], 0, 0

        def close():
            if breathings > 1:
                out.append("multiple_breathing_marks")
            if accents > 1:
                out.append("multiple_accent_marks")

        for c in unicodedata.normalize("NFD", text or ""):
            if unicodedata.category(c)[0] != "M":
                close()
                breathings = accents = 0
            else:
                breathings += c in "̓̔"
                accents += c in "̀́͂"
        close()
        return out

    return texts.map(flags)


def normalize_candidate(text: Column) -> Column:
    """A running head's shape: lower case without marks, Latin look-alikes as Greek on Greek lines, numbers as @."""
    bare = F.btrim(without_marks(F.lower(text)), F.lit(" \t\n\r\f\x0b"))
    greek = F.translate(bare, "abehikmnoptxyz", "αβεηικμνορτχυζ")
    mapped = F.when(greek_letters(bare) > 0, greek).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(mapped, r"(?U)\d+", "@"), r"(?U)\b[ivxlcdm]+\b", "@")


def is_folio(text: Column) -> Column:
    dash = "[-‐–—－]"
    return F.btrim(text).rlike(rf"^{dash}\s*\S{{1,4}}\s*{dash}$")


def is_footnote(text: Column) -> Column:
    return text.rlike(r"^\s*\d{1,3}\s+\S") & text.rlike(r"\p{Ll}")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 where lengths differ by more than 4, else the sequence matcher's ratio."""
    return pd.Series([0.0 if abs(len(x) - len(y)) > 4 else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def tokens(text: Column) -> Column:
    """Words between Unicode whitespace."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def collapsed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def error_rate(distance: Column, size: Column, other: Column) -> Column:
    """Edits over the reference's length; an empty reference counts 0 or 1."""
    return F.when(size == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(distance / size)


def edits(a: str, b: str) -> int:
    """Edit distance with a column of the table as the bits of one number, so that a long text's column takes few steps."""
    start = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    if not a or not b:
        return len(a) + len(b)
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    full, top = (1 << len(a)) - 1, len(a) - 1
    # Bits of rows that are one more, and one less, than the row before them.
    more, less, distance = full, 0, len(a)
    for sign in b:
        same = places.get(sign, 0)
        free = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(free | more)), more & free
        distance += (up >> top) - (down >> top & 1)
        up, below = (up << 1 | 1) & full, same | less
        more, less = (down << 1 & full) | (full & ~(below | up)), up & below
    return distance


#: Signs of a text up to which Spark's own edit distance is used, which looks at each pair of signs.
SHORT = 400


@F.pandas_udf(T.IntegerType())
def _long_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b)], dtype="Int32")


def distance(a: Column, b: Column) -> Column:
    """Edit distance; long texts go through Python, where it takes a small part of the time."""
    short = F.greatest(F.length(a), F.length(b)) <= SHORT
    return F.coalesce(F.when(short, F.levenshtein(a, b)), _long_edits(F.when(~short, a), F.when(~short, b)))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """For composed text."""
    return error_rate(distance(reference, hypothesis), F.length(reference), F.length(hypothesis))


#: Code points from here on, past all that Unicode calls special in lower planes, stand for words.
FIRST_CODE, LAST_CODE = 0x10000, 0x10FFFF


@F.pandas_udf(T.StructType([T.StructField(c, k) for c, k in (("a", T.StringType()), ("b", T.StringType()), ("n_a", T.IntegerType()), ("n_b", T.IntegerType()))]))
def word_codes(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
    """Each pair's words as one character per distinct word, so that edits of characters are edits of words; and how many words each has."""
    out = []
    for pair in zip(references, hypotheses):
        known: dict[str, str] = {}
        coded = []
        for line in pair:
            words = (line or "").split()
            for w in words:
                if w not in known:
                    if len(known) > LAST_CODE - FIRST_CODE:
                        raise ValueError("more different words than code points")
                    known[w] = chr(FIRST_CODE + len(known))
            coded.append("".join(map(known.__getitem__, words)))
        out.append((*coded, len(coded[0]), len(coded[1])))
    return pd.DataFrame(out, columns=["a", "b", "n_a", "n_b"])


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits of words over the reference's words; a million different words to a pair at most, beyond is an error."""
    codes = word_codes(reference, hypothesis)
    return error_rate(distance(codes["a"], codes["b"]), codes["n_a"], codes["n_b"])


def assign_split(page_id: Column, dev: float = 0.1, test: float = 0.1) -> Column:
    """A stable part of the corpus from the first 32 bits of the id's digest."""
    value = F.conv(F.substring(F.sha2(page_id, 256), 1, 8), 16, 10).cast("long")
    return F.when(value < dev * 2**32, "dev").when(value < (dev + test) * 2**32, "test").otherwise("train")


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


#: The letters of the keys, and the marks of the signs, in the order in which they are typed.
KEY_LETTERS = {"a": "α", "e": "ε", "h": "η", "i": "ι", "o": "ο", "u": "υ", "w": "ω", "r": "ρ"}
KEY_ACCENTS = {"": "", "/": "\u0301", "=": "\u0300", "~": "\u0342"}
KEY_BREATHINGS = {">": "\u0313", "<": "\u0314"}


@functools.cache
def polytonic_keys() -> dict[str, str]:
    """Keys to glyphs: a letter, an accent and a breathing that compose to one character; and the apostrophe."""
    letters = KEY_LETTERS | {k.upper(): v.upper() for k, v in KEY_LETTERS.items()}
    out = {"'": "\u1fbd"}
    for (key, letter), (accent, high), (sign, breath) in itertools.product(letters.items(), KEY_ACCENTS.items(), KEY_BREATHINGS.items()):
        glyph = unicodedata.normalize("NFC", letter + breath + high)
        if len(glyph) == 1:
            out[key + accent + sign] = glyph
    return out


def polytonic(keys: Column) -> Column:
    """The glyph of a sequence of keys, or null."""
    pairs = itertools.chain.from_iterable(sorted(polytonic_keys().items()))
    return F.try_element_at(F.create_map(*map(F.lit, pairs)), keys)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence < 40, "very_low").when(confidence < 60, "low").when(confidence < 80, "medium").otherwise("high")


def queue_id(tenant: Column, job: Column) -> Column:
    return F.concat(F.substring(F.sha2(tenant, 256), 1, 16), F.lit("-"), job)
