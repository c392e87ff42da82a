"""Filling containers of fixed capacity (problem 6): bounded-space online packing.

Each partition keeps at most OPEN open windows a capacity. An item goes to the window it fits best; when none fits and all are open, the fullest is emitted. What is open
when a partition ends (a bounded number of items) is merged: the leftovers of FAN partitions are packed again, and so on until one group is left, so the last task is
bounded as well, however many partitions there are.

A text larger than a container is split into full containers and a rest; no other is split. Defined results: null and empty texts (no tokens) get no container; rows with
equal ids are packed as separate items; without rows or capacities nothing comes out; capacities that are null or under 1 are ignored; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.tokens import TOKENIZER, count_tokens
from sieveloom.operators.common import materialize

OPEN, FAN = 64, 16
_FIELDS = ("spec_id", "container_id", "doc_id", "piece", "token_start", "tokens")


class Packer:
    """Open windows of one capacity. emit(items) is called with the items of each window that is closed."""

    def __init__(self, capacity: int, emit, most: int = OPEN):
        self.capacity, self.emit, self.most = capacity, emit, most
        self.free: list[tuple[int, int]] = []  # (room left, window), sorted
        self.items: dict[int, list[tuple]] = {}
        self.made = 0

    def add(self, size: int, item: tuple) -> None:
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                self.close(0)
            room, window = self.capacity, self.made
            self.made += 1
            self.items[window] = []
        self.items[window].append(item)
        if room == size:
            self.emit(self.items.pop(window))
        else:
            bisect.insort(self.free, (room - size, window))

    def close(self, at: int) -> None:
        self.emit(self.items.pop(self.free.pop(at)[1]))


def pieces(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, first token, tokens) of a text of n tokens."""
    for k, start in enumerate(range(0, n, capacity)):
        yield k, start, min(capacity, n - start)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int32(), pa.int64(), kind, pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=[*_FIELDS, "open", "part"])


def pack(docs: DataFrame, capacities: dict[int, int], id_col: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, token_start, tokens). docs: (id, text)."""
    specs = {k: v for k, v in capacities.items() if k is not None and v and v > 0}
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"spec_id int, container_id long, doc_id {kind}, piece int, token_start long, tokens int, open boolean, part long"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, made = TaskContext.get().partitionId(), [], [0]

        def closed(items: list[tuple]) -> None:
            number = (part << 32) | made[0]
            made[0] += 1
            done.extend((s, number, *rest, False, part) for s, *rest in items)

        packers = {s: Packer(c, closed) for s, c in specs.items()}
        id_type = pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for doc, n in zip(b.column(0).to_pylist(), count_tokens(b.column(1).to_pylist(), tokenizer)):
                for s, p in packers.items():
                    for k, start, size in pieces(n, p.capacity):
                        p.add(size, (s, doc, k, start, size))
            if done:
                yield _batch(done, id_type)
                done.clear()
        for s, p in packers.items():
            for items in p.items.values():
                done.extend((s, None, *rest, True, part) for _, *rest in items)
        if done:
            yield _batch(done, id_type)

    now = materialize(docs.select(id_col, "text").filter("text is not null and text <> ''").mapInArrow(first, schema), "packed")
    out = [now.filter("not open")]
    left, level = now.filter("open"), 1
    groups = (left.agg(F.max("part")).first()[0] or 0) // FAN + 1
    while True:
        merged = left.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("spec_id", "part").applyInArrow(_merger(specs, level, groups == 1), schema)
        if groups == 1:
            out.append(merged)
            break
        now = materialize(merged, "packed")
        out.append(now.filter("not open"))
        left, level, groups = now.filter("open"), level + 1, (groups - 1) // FAN + 1
    result = out[0]
    for x in out[1:]:
        result = result.union(x)
    return result.select("spec_id", "container_id", F.col("doc_id").alias(id_col), "piece", "token_start", "tokens")


def _merger(specs: dict[int, int], level: int, last: bool):
    def again(key: tuple, t: pa.Table) -> pa.Table:
        spec, group = key[0].as_py(), key[1].as_py()
        done: list[tuple] = []
        made = [0]

        def closed(items: list[tuple]) -> None:
            number = (level << 56) | (group << 32) | made[0]
            made[0] += 1
            done.extend((s, number, *rest, False, group) for s, *rest in items)

        # the group is bounded, so all windows may stay open: best fit over items sorted by size
        p = Packer(specs[spec], closed, most=1 << 30)
        rows = sorted(zip(t["tokens"].to_pylist(), t["doc_id"].to_pylist(), t["piece"].to_pylist(), t["token_start"].to_pylist()), key=lambda r: (-r[0], str(r[1]), r[2]))
        for n, doc, k, start in rows:
            p.add(n, (spec, doc, k, start, n))
        while len(p.free) > (0 if last else OPEN):
            p.close(0)
        for items in p.items.values():
            done.extend((s, None, *rest, True, group) for s, *rest in items)
        return pa.Table.from_batches([_batch(done, t.schema.field("doc_id").type)]) if done else _batch_empty(t)

    return again


def _batch_empty(t: pa.Table) -> pa.Table:
    types = [pa.int32(), pa.int64(), t.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
    return pa.table([pa.array([], k) for k in types], names=[*_FIELDS, "open", "part"])


def utilisation(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Containers, tokens, fill and the least possible number of containers of each capacity."""
    caps = packed.sparkSession.createDataFrame(sorted(capacities.items()), "spec_id int, capacity int") if capacities else None
    sums = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("items")).groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.sum("items").alias("items"), F.max("t").alias("fullest"))
    if caps is None:
        return sums.limit(0)
    return sums.join(F.broadcast(caps), "spec_id").select("spec_id", "capacity", "containers", "items", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
