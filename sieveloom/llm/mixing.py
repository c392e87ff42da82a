"""Mixing sources to target shares (problem 7): pivotal dependent rounding.

The size of the mix is the largest at which every source that has rows can give its target share with at most its number of repeats (or a given number of tokens).
Each document then has the same expected number of copies c within its source: floor(c) copies are certain, the fraction is rounded by pivotal steps. A step takes two
documents with fractions and moves tokens between them, at random but without bias, until one of the fractions is 0 or 1; the sum of fraction times tokens doesn't change. A
partition is left with at most one fraction a source, and these residuals are combined by a reduction tree of fan-in FAN.

Documents are rounded by classes of size (STEP times as many tokens from one to the next), the largest first. The one document of a source that a class leaves undecided is paired with all smaller documents of
its source together: tokens move between its fraction and their common rate, again at random and without bias, until it is decided or the rate is at its end. So only one of the smallest documents of a source is
ever rounded by itself, and a source misses its tokens by less than that document, as far as its smaller documents can make good for its larger ones.

Random numbers are hashes of the seed and the two ids, so a task that is run again decides alike. Defined results: null and unlisted sources are left out; source names are
compared without case and outer blanks; null and empty texts have no tokens and are left out; targets of null or no share are ignored; several targets of one name count as the
first by share; equal ids are separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.text import map_batches
from sieveloom.llm.tokens import TOKENIZER, count_tokens
from sieveloom.operators.common import materialize

FAN, STEP = 256, 16
_EPS = 1e-12


def pivot(a: tuple, b: tuple, seed: int) -> tuple[tuple, tuple]:
    """One step on (doc, tokens, fraction) a and b: at least one fraction becomes 0 or 1, and the sum of tokens times fraction stays."""
    (i, n, p), (j, m, q) = a, b
    up, down = min((1 - p) * n, q * m), min(p * n, (1 - q) * m)
    u = xxhash.xxh3_64_intdigest(f"{i}\x1f{j}", seed) / 2**64
    move = up if u * (up + down) < down else -down
    p, q = p + move / n, q - move / m
    snap = lambda x: 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
    return (i, n, snap(p)), (j, m, snap(q))


def settle(doc: tuple, rate: float, most: float, tokens: float, seed: int) -> tuple[float, float]:
    """One step between (doc, tokens, fraction) and `tokens` others whose common rate of copies may be anything from 0 to `most`: the new fraction and the new rate."""
    i, n, p = doc
    up, down = min((1 - p) * n, rate * tokens), min(p * n, max(0.0, most - rate) * tokens)
    if up + down <= 0:
        return p, rate
    u = xxhash.xxh3_64_intdigest(f"{i}\x1frest", seed) / 2**64
    move = up if u * (up + down) < down else -down
    p = p + move / n
    return (0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p), min(most, max(0.0, rate - move / tokens))


class Pivots:
    """Pivotal rounding of a stream; done(doc, tokens, 0 or 1) is called for each document but the last undecided one."""

    def __init__(self, seed: int, done):
        self.seed, self.done, self.held = seed, done, None

    def add(self, doc: tuple) -> None:
        if self.held is not None and 0 < doc[2] < 1:
            self.held, doc = pivot(self.held, doc, self.seed)
        for x in (self.held, doc) if self.held is not None else (doc,):
            if x[2] in (0.0, 1.0):
                self.done(x[0], x[1], int(x[2]))
                if x is self.held:
                    self.held = None
            elif x is not self.held:
                self.held = x


def rates(totals: dict[str, int], targets: dict[str, tuple[float, int]], tokens: float | None = None) -> dict[str, float]:
    """Expected copies of a document of each source."""
    have = {s: t for s, t in targets.items() if totals.get(s)}
    if not have:
        return {}
    most = min(r * totals[s] / w for s, (w, r) in have.items())
    size = most if tokens is None else min(most, tokens)
    return {s: w * size / totals[s] for s, (w, _) in have.items()}


def size_class(tokens: int) -> int:
    k = 0
    while tokens >= STEP:
        tokens //= STEP
        k += 1
    return k


def sizes(docs: DataFrame, names: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, doc_id, tokens, size) of the documents of the named sources that have tokens. docs: (doc_id, source, text), source normalised."""

    def kernel(ids: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        n = count_tokens(texts.to_pylist(), tokenizer)
        at = pa.array([k for k, x in enumerate(n) if x], pa.int64())
        some = [x for x in n if x]
        return pa.record_batch([sources.take(at), ids.take(at), pa.array(some, pa.int32()), pa.array(list(map(size_class, some)), pa.int32())], names=["source", "doc_id", "tokens", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(n,) for n in names], "source string")
    rows = docs.filter("text is not null").join(F.broadcast(wanted), "source", "left_semi")
    return map_batches(rows, ["doc_id", "source", "text"], kernel, f"source string, doc_id {kind}, tokens int, size int")


def mix(docs: DataFrame, targets: dict[str, tuple[float, int]], tokens: float | None = None, seed: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source_name, doc_id, tokens, copies) of the documents in the mix. targets: source -> (share, most repeats), a table of settings.

    The driver holds one rate a source, sums by source and class of size, and one undecided document a source."""
    sized = materialize(sizes(docs, sorted(targets), tokenizer), "sizes", by="size")
    kind = sized.schema["doc_id"].dataType.simpleString()
    schema = f"source string, doc_id {kind}, tokens int, copies int, fraction double, part long"
    mass: dict[str, dict[int, int]] = {}
    for s, k, n in sized.groupBy("source", "size").agg(F.sum("tokens")).collect():
        mass.setdefault(s, {})[k] = n
    rate = rates({s: sum(m.values()) for s, m in mass.items()}, targets, tokens)
    out: list[DataFrame] = []
    alone: list[tuple] = []
    for size in sorted({k for s in rate for k in mass[s]}, reverse=True):
        done, left = _class(sized.filter(F.col("size") == size), {s: c for s, c in rate.items() if size in mass[s]}, kind, schema, seed)
        out += done
        for s, doc, n, p in left:
            base = int(rate[s] + 1e-9)
            rest = sum(m for k, m in mass[s].items() if k < size)
            if rest:
                p, rate[s] = settle((doc, n, p), rate[s], float(targets[s][1]), rest, seed)
            if 0 < p < 1:
                p = float(xxhash.xxh3_64_intdigest(f"{doc}", seed) / 2**64 < p)
            alone.append((s, doc, n, base + int(p)))
    result = sized.sparkSession.createDataFrame(alone, f"source_name string, doc_id {kind}, tokens int, copies int")
    for x in out:
        result = result.union(x.select("source", "doc_id", "tokens", "copies"))
    return result.filter("copies > 0")


def _class(rows: DataFrame, rate: dict[str, float], kind: str, schema: str, seed: int) -> tuple[list[DataFrame], list[tuple]]:
    """Rounds the documents of one class of size at their sources' rates, by pivots within each partition and a tree over what they leave: decided rows, and (source, doc_id, tokens, fraction) of the last document of each source."""

    def batch(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 6
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.string(), like, pa.int32(), pa.int32(), pa.float64(), pa.int64()])], names=["source", "doc_id", "tokens", "copies", "fraction", "part"])

    parts = {s: (int(c + 1e-9), max(0.0, c - int(c + 1e-9))) for s, c in rate.items()}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, like = TaskContext.get().partitionId(), [], pa.int64()
        streams = {s: Pivots(seed, lambda d, n, x, s=s: out.append((s, d, n, parts[s][0] + x, None, part))) for s in parts}
        for b in batches:
            like = b.column(1).type
            for s, d, n in zip(*(c.to_pylist() for c in b.columns)):
                if s in parts:
                    streams[s].add((d, n, parts[s][1] if parts[s][1] > 1e-9 else 0.0))
            yield batch(out, like)
            out.clear()
        yield batch([(s, *p.held[:2], None, p.held[2], part) for s, p in streams.items() if p.held], like)

    def again(key: tuple, t: pa.Table) -> pa.Table:
        s, g, out = key[0].as_py(), key[1].as_py(), []
        stream = Pivots(seed, lambda d, n, x: out.append((s, d, n, parts[s][0] + x, None, g)))
        for row in sorted(zip(t["doc_id"].to_pylist(), t["tokens"].to_pylist(), t["fraction"].to_pylist()), key=lambda r: str(r[0])):
            stream.add(row)
        if stream.held:
            out.append((s, *stream.held[:2], None, stream.held[2], g))
        return pa.Table.from_batches([batch(out, t.schema.field("doc_id").type)])

    now = materialize(rows.select("source", "doc_id", "tokens").mapInArrow(first, schema), "pivots")
    out = [now.filter("fraction is null")]
    groups = (now.agg(F.max("part")).first()[0] or 0) + 1
    while groups > 1:
        left = now.filter("fraction is not null").withColumn("part", F.floor(F.col("part") / FAN))
        now = materialize(left.groupBy("source", "part").applyInArrow(again, schema), "pivots")
        out.append(now.filter("fraction is null"))
        groups = (groups - 1) // FAN + 1
    last = now.filter("fraction is not null").select("source", "doc_id", "tokens", "fraction").collect()
    return out, sorted(map(tuple, last))


def shares(mixed: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """Target and actual share of each source, documents, copies and the most copies of one document."""
    want = mixed.sparkSession.createDataFrame([(s, float(w), int(r)) for s, (w, r) in sorted(targets.items())], "source_name string, target_share double, max_repeats int")
    got = mixed.groupBy("source_name").agg(F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("total"))
    both = F.broadcast(want).join(got, "source_name", "left")
    whole = total.first()[0] or 0
    return both.select("source_name", "target_share", (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(whole, 1)))).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
