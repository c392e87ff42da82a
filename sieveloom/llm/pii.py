"""Personal information in free text (problem 1): spans from the character tagger of pii_model, and typed placeholders.

Every value comes from the network's decoded spans. What comes after it moves a span's ends only (a phone starts at its plus, an address at its number, no mark at an end). A caller may ask for values of
certain forms only (`forms`, off by default), such as a country's subscriber numbers.

Defined results: null texts have no values and stay null; empty texts have none; repeated rows give the same values once; a text of any length is decoded whole; other columns
are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from sieveloom.functions.text import map_batches
from sieveloom.llm.pii_model import Tagger
from sieveloom.llm.repetition import groups

PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "address": "<ADDRESS>", "person_name": "<PERSON_NAME>"}
_EDGE = re.compile(r"[\s.,;:!?(){}\[\]\"'“”*…\-]*")


@functools.lru_cache(maxsize=2)
def tagger(path: str | None = None) -> Tagger:
    return Tagger.load(path)


def trimmed(text: str, kind: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The span with its ends put right, or None if nothing is left."""
    while end > start and (text[end - 1].isspace() or text[end - 1] in ".,;:!?*-"):
        end -= 1
    if kind == "phone" and start and text[start - 1] == "+":
        start -= 1
    first = next((k for k in range(start, end) if text[k].isdigit()), start) if kind == "address" else start
    start = first
    if kind != "phone" or text[start] not in "(+":
        start += _EDGE.match(text[start:end]).end()
    while start < end and unicodedata.combining(text[start]):
        start += 1
    return (kind, start, end) if start < end else None


def national(kind: str, value: str) -> bool:
    """Is a value of the form that is asked for in these tables? A ten-digit subscriber number or its +84 form, an identity number of 9 or 12 digits or of a letter and 7, an address with a number, a name of letters."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "phone":
        return len(digits) == 10 and digits[0] == "0" or len(digits) == 11 and digits[:2] == "84"
    if kind == "id_number":
        return len(digits) in (9, 12) or len(digits) == 7 and value[:1].isalpha()
    if kind == "email":
        return "@" in value or "at" in value.lower()
    return bool(digits) if kind == "address" else not digits


def values(texts: list[str | None], weights: str | None = None, forms: Callable[[str, str], bool] | None = None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text in order. Equal texts are decoded once."""
    distinct = list(dict.fromkeys(t for t in texts if t))
    got: dict[str, list[tuple[str, int, int]]] = {}
    for a, b in groups(distinct):
        for t, spans in zip(distinct[a:b], tagger(weights).tag(distinct[a:b])):
            got[t] = [x for s in spans if (x := trimmed(t, *s)) and (forms is None or forms(x[0], t[x[1] : x[2]]))]
    return [got[t] if t else [] for t in texts]


def find(records: DataFrame, weights: str | None = None, forms: Callable[[str, str], bool] | None = None) -> DataFrame:
    """(record_table, record_key, pii_kind, char_start, char_end) of each value. records: (record_table, record_key, text)."""

    def kernel(tables: pa.Array, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        rows = [(k, *x) for k, spans in enumerate(values(texts.to_pylist(), weights, forms)) for x in spans]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.record_batch([tables.take(at), keys.take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=["record_table", "record_key", "pii_kind", "char_start", "char_end"])

    src = records.filter("record_key is not null and text is not null")
    return map_batches(src, ["record_table", "record_key", "text"], kernel, "record_table string, record_key string, pii_kind string, char_start int, char_end int")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], PLACEHOLDERS[kind]]
            at = e
    return "".join(out) + text[at:]


def redact(records: DataFrame, weights: str | None = None, forms: Callable[[str, str], bool] | None = None) -> DataFrame:
    """(record_table, record_key, text, n_values): the text with typed placeholders."""

    def kernel(tables: pa.Array, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ts = texts.to_pylist()
        spans = values(ts, weights, forms)
        return pa.record_batch([tables, keys, pa.array([None if t is None else redact_text(t, s) for t, s in zip(ts, spans)], pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=["record_table", "record_key", "text", "n_values"])

    return map_batches(records, ["record_table", "record_key", "text"], kernel, "record_table string, record_key string, text string, n_values int")
