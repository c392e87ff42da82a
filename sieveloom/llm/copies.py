"""Copies that differ in formatting only (problem 3), by Merkle-style bottom-up hashing of nested records.

Leaves are normalised and hashed; a node's digest (128 bits) is that of its kind and its children's digests, which are sorted first at unordered nodes; the root is the record's: its table, its
text (as plain text, and again as an unordered list of fields where it is one) and its slots. One pass writes each record's digests and its canonical structure. Grouping, and all that is shuffled of
most records, are the digests alone; the structures of those that share a root are then compared in full, and should two structures ever share a digest, the records are grouped by the structures instead.

Defined results: a null text never is a copy of anything; an empty text, or one of blanks and punctuation only, has the empty canonical form and equals others
of that form; equal ids are one record; other columns are ignored. For templates, null slots equal null slots only, and slots that are no valid JSON compare by
canonical text. A text that isn't a field list but equals one as plain text belongs to that list's class. Texts of any length are taken whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.text import _LINE, WORD, canonical, digest128, map_batches
from sieveloom.operators.common import lookup_join, materialize

_STRONG, _LINES = re.compile(r"[;|]"), re.compile(f"[{_LINE}]")
#: A colon that separates a label: not between two digits, and not that of a web address.
_COLON = re.compile(r"(?<!\d):(?!//)|:(?!\d|//)")
#: Groups of digests by which the records to compare in full are told apart from single ones: a bound on what is broadcast.
MARKS = 1 << 20

#: A node of the canonical structure: its digest and its serialised form.
Node = tuple[bytes, str]


def _field(part: str) -> tuple[str, str] | None:
    m = _COLON.search(part)
    if not m or not 1 <= len(WORD.findall(part[: m.start()])) <= 2:
        return None
    label, value = canonical(part[: m.start()]), canonical(part[m.end() :])
    return (label, value) if label and value else None


def parse_fields(text: str) -> list[tuple[str, str]] | None:
    """The (label, value) leaves of a text that is wholly a field list of two or more fields, else None. A line break is a separator only where every line
    between the stronger separators is a field; otherwise it is a blank within a value."""
    fields: list[tuple[str, str]] = []
    for part in _STRONG.split(unicodedata.normalize("NFC", text)):
        lines = [x for x in _LINES.split(part) if WORD.search(x)]
        if not lines:
            continue
        merged: list[str] = []
        for line in lines:
            if merged and _field(line) is None:
                merged[-1] += " " + line
            else:
                merged.append(line)
        got = [_field(x) for x in merged]
        if None in got:
            return None
        fields += got
    return fields if len(fields) > 1 else None


def leaf(kind: str, value: str) -> Node:
    body = kind + value
    return digest128(body), body


def node(kind: str, children: list[Node], ordered: bool = True) -> Node:
    """A node over its children's digests; the children of an unordered node come in the order of their digests."""
    if not ordered:
        children = sorted(children)
    return digest128(kind.encode() + b"".join(d for d, _ in children)), kind + "".join(f"{len(b)}:{b}" for _, b in children)


def _json_node(x: object) -> Node:
    if isinstance(x, dict):
        return node("o", [node("p", [leaf("k", k), _json_node(v)]) for k, v in x.items()], ordered=False)
    if isinstance(x, list):
        return node("l", [_json_node(v) for v in x])
    if isinstance(x, str):
        x = unicodedata.normalize("NFC", x)
    return leaf("v", json.dumps(x, ensure_ascii=False, sort_keys=True))


def slots_node(slots: str | None) -> Node:
    if slots is None:
        return leaf("n", "")
    try:
        return _json_node(json.loads(slots))
    except ValueError:
        return leaf("x", canonical(slots))


def record_nodes(table: str, text: str, slots: Node | None) -> tuple[Node, Node | None]:
    """Roots of a record: with its text as plain text and, if it is a field list, as an unordered list of fields."""
    fields = parse_fields(text)
    head, tail = leaf("d", table), [slots] if slots else []
    plain = node("r", [head, leaf("t", canonical(text)), *tail])
    if fields is None:
        return plain, None
    return plain, node("r", [head, node("f", [node("p", [leaf("a", a), leaf("b", b)]) for a, b in fields], ordered=False), *tail])


def structures(df: DataFrame, table: str, id_col: str, text_col: str, slots_col: str | None = None) -> DataFrame:
    """(record_table, record_id, plain, listed, plain_body, listed_body): root digests and canonical structures of each record with a text."""

    def kernel(ids: pa.Array, texts: pa.Array, slots: pa.Array | None = None) -> pa.RecordBatch:
        tails = [slots_node(s) for s in slots.to_pylist()] if slots is not None else [None] * len(texts)
        both = [record_nodes(table, t, s) for t, s in zip(texts.to_pylist(), tails)]
        part = lambda i, kind: pa.array([None if b[i // 2] is None else b[i // 2][i % 2] for b in both], kind)
        return pa.record_batch([pa.array([table] * len(both), pa.string()), ids.cast(pa.string()), part(0, pa.binary()), part(2, pa.binary()), part(1, pa.string()), part(3, pa.string())], names=["record_table", "record_id", "plain", "listed", "plain_body", "listed_body"])

    src = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), *([F.col(slots_col).alias("s")] if slots_col else [])).filter("i is not null and t is not null")
    return map_batches(src, src.columns, kernel, "record_table string, record_id string, plain binary, listed binary, plain_body string, listed_body string")


def _classes(rows: DataFrame) -> DataFrame:
    """(plain, first_id, n, root): for each plain digest of a class of two or more records its first id, rows and root. Only digests and ids are shuffled, after map-side combining."""
    own = materialize(rows.groupBy("plain").agg(F.min("listed").alias("via"), F.min("record_id").alias("least"), F.max("record_id").alias("most"), F.count(F.lit(1)).alias("n")).withColumn("root", F.coalesce("via", "plain")), "plain")
    roots = own.groupBy("root").agg(F.min("least").alias("first_id"), F.max("most").alias("last_id"), F.count(F.lit(1)).alias("plains")).filter("first_id <> last_id")
    return own.join(roots, "root").select("plain", "first_id", "n", "root")


def _clash(rows: DataFrame, classes: DataFrame) -> bool:
    """Do two records of a class that share a digest differ in structure? Compares the structures of all records whose digest falls on a mark of a class (at most MARKS of them are broadcast)."""
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).cast("int")
    marks = classes.select(mark("plain").alias("mark")).distinct()
    some = rows.withColumn("mark", mark("plain")).join(F.broadcast(marks), "mark", "left_semi")
    each = some.select("plain", "plain_body").groupBy("plain").agg(F.min("plain_body").alias("a"), F.max("plain_body").alias("b"))
    lists = some.filter("listed is not null").groupBy("listed").agg(F.min("listed_body").alias("a"), F.max("listed_body").alias("b"))
    return not each.select("a", "b").union(lists.select("a", "b")).filter("a <> b").isEmpty()


def collapse(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, members): all rows (record_table, record_id) of structures(), and those in classes of two or more as (record_table, record_id, first_id)."""
    rows = materialize(records, "records")
    classes = materialize(_classes(rows), "classes")
    keyed = rows.select("record_table", "record_id", "plain", "listed")
    if _clash(rows, classes):  # digests can not tell these records apart: the structures themselves are the keys
        keyed = rows.select("record_table", "record_id", F.col("plain_body").cast("binary").alias("plain"), F.col("listed_body").cast("binary").alias("listed"))
        classes = materialize(_classes(keyed), "classes")
    members = lookup_join(keyed.select("record_table", "record_id", "plain"), classes.select("plain", "first_id", "n"), "plain", "n", "inner")
    return keyed.select("record_table", "record_id"), members.select("record_table", "record_id", "first_id")


def copies_found(records: DataFrame) -> DataFrame:
    """One row for each record that isn't the first of its class."""
    return collapse(records)[1].filter("record_id <> first_id").select("record_table", "first_id", F.col("record_id").alias("copy_id")).distinct()


def copies_counted(records: DataFrame) -> DataFrame:
    """One row for each class: its first id and the number of records."""
    rows, members = collapse(records)
    others = materialize(members.filter("record_id <> first_id").distinct(), "others")
    more = others.groupBy("record_table", F.col("first_id").alias("record_id")).agg((F.count(F.lit(1)) + 1).alias("copies"))
    firsts = rows.distinct().join(others.select("record_table", "record_id"), ["record_table", "record_id"], "left_anti")
    return firsts.join(more, ["record_table", "record_id"], "left").select("record_table", "record_id", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
