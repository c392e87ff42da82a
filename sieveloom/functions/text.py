"""Unicode text kernels in Python, for whole Arrow batches: folding, words, canonical forms and hashes.

Spark has no Unicode normalisation, so whatever must treat composed and decomposed letters alike starts here; joins, groupings and filters stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
MARKS = "\u0300-\u036f"
WORD = re.compile(rf"(?:[^\W_]|[{MARKS}])+")
#: Words, and marks that stand between two digits ("10:32", "1.000").
CONTENT = re.compile(rf"(?:[^\W_]|[{MARKS}])+|(?<=\d)(?:[^\w\s{ZERO_WIDTH}{MARKS}]|_)+(?=\d)")
_LINE = "\n\r\x0b\x0c\x85\u2028\u2029"


class FoldTable(dict):
    """For str.translate: letters and digits become lower case without diacritics, marks vanish, everything else is a blank."""

    def __missing__(self, cp: int) -> str:
        out = []
        for ch in unicodedata.normalize("NFD", chr(cp).lower()):
            if unicodedata.combining(ch):
                continue
            out.append("d" if ch == "đ" else ch if ch.isalnum() else " ")
        got = self[cp] = "".join(out)
        return got


class CaseTable(dict):
    """For str.translate after NFC: lower case, diacritics kept, everything that is no letter, digit or mark is a blank."""

    def __missing__(self, cp: int) -> str:
        low = chr(cp).lower()
        got = self[cp] = "".join(c if c.isalnum() or unicodedata.combining(c) else " " for c in low)
        return got


FOLD, CASE = FoldTable(), CaseTable()


def folded_words(text: str) -> list[str]:
    """Words without regard to case, diacritics, blanks and punctuation."""
    return text.translate(FOLD).split()


def cased_words(text: str) -> list[str]:
    """Words without regard to case, blanks and punctuation; diacritics count, composed and decomposed letters are equal."""
    return unicodedata.normalize("NFC", text).translate(CASE).split()


def canonical(text: str) -> str:
    """The text without case, blanks and punctuation; diacritics and marks between two digits stay."""
    return "".join(CONTENT.findall(unicodedata.normalize("NFC", text))).lower()


class WordHashes(dict):
    """Word -> 64-bit hash, kept while below a fixed number of words."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Odd multiplier of the rolling hash over words.
_STEP = 0x9E3779B97F4A7C15


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (the last k - 1 positions are left out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(_STEP) + words[j : j + n]
    return mix(acc)


def digest128(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text)


def map_batches(df: DataFrame, columns: list[str], kernel: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """Runs kernel(*columns as pyarrow arrays) on each Arrow batch of the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = kernel(*b.columns)
            if got is not None and got.num_rows:
                yield got

    return df.select(*columns).mapInArrow(run, schema)
