"""Unicode and edit-distance functions that Spark lacks, as Arrow-batched UDFs. Apply them to distinct values where a column repeats."""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ECMAScript calls white space and line ends (fixed values).
JS_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_TONES = {"\u0300", "\u0301", "\u0309", "\u0303", "\u0323"}


def strip_accents(s: str) -> str:
    """NFD without marks, and d for the letter with a stroke."""
    out = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M"))
    return out.replace("đ", "d").replace("Đ", "D")


@functools.lru_cache(1 << 16)
def lookup_key(s: str) -> str:
    return unicodedata.normalize("NFC", s).lower()


@functools.lru_cache(1 << 16)
def accent_key_of(s: str) -> str:
    return strip_accents(lookup_key(s))


def accented_char(ch: str) -> bool:
    """A letter with an ASCII base and at least one mark, or the letter with a stroke."""
    if ch in "đĐ":
        return True
    d = unicodedata.normalize("NFD", ch)
    return len(d) > 1 and ch.isalpha() and d[0].isascii() and d[0].isalpha() and any(unicodedata.category(c).startswith("M") for c in d[1:])


def osa(a: str, b: str, swap: float = 0.8) -> float:
    """Optimal string alignment distance; an exchange of neighbours costs `swap`."""
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [float(i)]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                v = min(v, before[j - 2] + swap)
            now.append(v)
        before, row = row, now
    return row[-1]


def tone_flip(a: str, b: str) -> bool:
    """Do the words differ by tone marks alone?"""
    def bare(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", s) if c not in _TONES)

    return a != b and bare(a) == bare(b)


def fnv1a(s: str) -> int:
    h = 0x811C9DC5
    for byte in s.encode():
        h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
    return h


def _each(f, kind: T.DataType):
    """A scalar UDF of one or two string columns that maps null to null."""

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return a.map(f, na_action="ignore")

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)])

    return one, two


_ISSPACE = re.compile(r"\s+")
nfc = _each(lambda s: unicodedata.normalize("NFC", s), T.StringType())[0]
accent_key = _each(accent_key_of, T.StringType())[0]
#: accent_key of n-grams, by their words, which repeat.
gram_key = _each(lambda s: " ".join(map(accent_key_of, s.split(" "))), T.StringType())[0]
without_accents = _each(strip_accents, T.StringType())[0]
has_accent = _each(lambda s: any(map(accented_char, unicodedata.normalize("NFC", s))), T.BooleanType())[0]
html_unescape = _each(html.unescape, T.StringType())[0]
fold_key = _each(lambda s: _ISSPACE.sub(" ", unicodedata.normalize("NFC", s).casefold()).strip(), T.StringType())[0]
fnv1a32 = _each(fnv1a, T.LongType())[0]
osa_distance = _each(osa, T.DoubleType())[1]
tone_only_flip = _each(tone_flip, T.BooleanType())[1]

#: Keyboard digraphs and the letters they stand for, applied in this order (fixed values).
TELEX = [("dd", "đ"), ("aw", "ă"), ("aa", "â"), ("ee", "ê"), ("oo", "ô"), ("ow", "ơ"), ("uw", "ư"), ("w", "ư")]


def telex_decode(c: Column) -> Column:
    """Digraphs become their letters."""
    for a, b in TELEX:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def telex_lookup(c: Column) -> Column:
    """Digraphs become their letters, a lone w stays, and tone letters after a vowel at the end vanish."""
    for a, b in TELEX[:-1]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "(?<=[aăâeêioôơuưy][a-zđăâêôơư]{0,3})[sfrxj]$", "")


def words(c: Column) -> Column:
    """Lower-case words (letters and marks) of a column in NFC."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
