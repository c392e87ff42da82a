"""Splits that keep related records together (problem 2): component swap search by annealing.

Components (from components.related; a record without keys is one of its own) start in the split that a hash of their name gives. They are cut by hash into chunks of about CHUNK components, whatever their
size. In each pass all chunks are annealed in parallel: chains of moves and exchanges of whole components lower the deviation from the wanted sizes and label shares, each chunk aiming at its
present state and its part of what all splits lack at the moment. A chunk's part goes by its components' sizes to the power of the pass (POWERS): first large components find their place, later the many
small ones make good what those upset. The best state of a chunk's chains is kept in a pass, and the best of all passes at the end. Labels count in BUCKETS bins, so the table of what the splits lack
is small whatever the labels.

Defined results: null ids are left out; a null label is a label of its own; a repeated id is one record; without records nothing comes out; a component larger than every
wanted size goes where it does least harm; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.operators.common import lookup_join, materialize, release

CHUNK, BUCKETS = 5_000, 16
CHAINS, ROUNDS = 8, 6
POWERS = (2.0, 1.0, 0.5, 0.0)


def hashed_start(names: list, want: np.ndarray, seed: int) -> np.ndarray:
    """Split of each component by a hash of its name, in proportion to the sizes wanted."""
    share = np.cumsum(want.sum(1).clip(0)) / max(1e-9, want.sum(1).clip(0).sum())
    u = np.array([xxhash.xxh3_64_intdigest(str(x), seed) / 2**64 for x in names])
    return np.searchsorted(share, u, side="right").clip(0, len(want) - 1)


def deviation(loads: np.ndarray, want: np.ndarray) -> float:
    """What a state costs: squared deviations of the splits' sizes, and of their labels together once more."""
    off = loads - want
    return float((off.sum(-1) ** 2).sum() + (off * off).sum() / off.shape[-1])


def anneal(start: np.ndarray, counts: np.ndarray, want: np.ndarray, seed: int = 1, chains: int = CHAINS, rounds: int = ROUNDS) -> np.ndarray:
    """Split of each component. start: split by component; counts: (components, labels) records; want: (splits, labels) records wanted. All chains step at once, rounds steps a component."""
    n, n_splits = len(start), len(want)
    counts = counts.astype(np.float64)
    full = np.concatenate([counts.sum(1, keepdims=True), counts], axis=1)
    target = np.concatenate([want.sum(1, keepdims=True), want], axis=1)
    # a record's deviation counts once by size, and once by label in all labels together
    weight = np.concatenate([[1.0], np.full(counts.shape[1], 1.0 / counts.shape[1])]) / max(1.0, full[:, 0].sum()) ** 2
    at = np.tile(start, (chains, 1))
    loads = np.zeros((chains, n_splits, full.shape[1]))
    np.add.at(loads[0], start, full)
    loads[1:] = loads[0]
    off = loads - target
    cost = (off * off * weight).sum((1, 2))
    best_cost, best = cost.copy(), at.copy()
    rng = np.random.default_rng(seed)
    rows = np.arange(chains)
    steps = max(200, rounds * n)
    hot = max(float(np.median(full[:, 0])), 1.0) ** 2 * weight[0] * 4
    big = np.argsort(-full[:, 0], kind="stable")
    for step in range(steps):
        temperature = hot * (1 - step / steps) ** 2 + 1e-30
        # half of the draws favour large components, which matter most
        i = np.where(rng.random(chains) < 0.5, big[(n * rng.random(chains) ** 3).astype(int)], rng.integers(0, n, chains))
        j = rng.integers(0, n, chains)
        a, to = at[rows, i], rng.integers(0, n_splits, chains)
        swap = rng.random(chains) < 0.4
        to = np.where(swap, at[rows, j], to)
        delta = full[i] - np.where(swap, 1.0, 0.0)[:, None] * full[j]
        from_off, to_off = off[rows, a], off[rows, to]
        change = (((from_off - delta) ** 2 - from_off**2 + (to_off + delta) ** 2 - to_off**2) * weight).sum(1)
        take = (a != to) & ((change < 0) | (rng.random(chains) < np.exp(-np.maximum(change, 0) / temperature)))
        k = rows[take]
        if not len(k):
            continue
        off[k, a[k]] -= delta[k]
        off[k, to[k]] += delta[k]
        at[k, i[k]] = to[k]
        s = k[swap[k]]
        at[s, j[s]] = a[s]
        cost[k] += change[k]
        better = k[cost[k] < best_cost[k] - 1e-15]
        best_cost[better] = cost[better]
        best[better] = at[better]
    return best[int(best_cost.argmin())]


def _annealer(lack: np.ndarray, power: float, whole: float, seed: int):
    """Anneals one chunk from its present state towards that state and its part of `lack`, (splits, labels). whole: sum of all components' sizes to that power."""

    def place(key: tuple, t: pa.Table) -> pa.Table:
        counts = np.array([t[f"c{b}"].to_numpy() for b in range(BUCKETS)], dtype=np.float64).T
        now = t["split_no"].to_numpy()
        held = np.zeros_like(lack)
        np.add.at(held, now, counts)
        got = anneal(now, counts, held + lack * ((counts.sum(1) ** power).sum() / max(1.0, whole)), seed)
        return t.set_column(t.schema.get_field_index("split_no"), "split_no", pa.array(got.astype(np.int32)))

    return place


def assign(records: DataFrame, related: DataFrame, label: str, names: list[str], ratio: list[float], seed: int = 1, powers: tuple[float, ...] = POWERS) -> DataFrame:
    """(id, split). records: (id, label column); related: (id, anchor) of the records that have keys."""
    each = records.filter("id is not null").groupBy("id").agg(F.min(label).alias("label"))
    rows = materialize(each.join(related, "id", "left").select("id", F.coalesce("anchor", "id").alias("anchor"), F.pmod(F.xxhash64(F.coalesce("label", F.lit("\x00"))), F.lit(BUCKETS)).alias("b")), "rows")
    columns = [f"c{b}" for b in range(BUCKETS)]
    comps = materialize(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("b") == b).cast("long")).alias(f"c{b}") for b in range(BUCKETS)]), "components")
    total = comps.agg(F.sum("n"), F.count(F.lit(1)), *[F.sum(c) for c in columns], *[F.sum(F.pow("n", F.lit(p))) for p in powers]).first()
    if not total[0]:
        return rows.select("id", F.lit(names[0]).alias("split"))
    want = np.outer(np.array(ratio) / sum(ratio), np.array(total[2 : 2 + BUCKETS], dtype=np.float64))
    chunks = max(1, -(-total[1] // CHUNK))
    schema = ", ".join(["chunk long", "anchor long", "n long", *[f"{c} long" for c in columns], "split_no int"])

    def first(key: tuple, t: pa.Table) -> pa.Table:
        return t.append_column("split_no", pa.array(hashed_start(t["anchor"].to_pylist(), want, seed).astype(np.int32)))

    def loads_of(state: DataFrame) -> np.ndarray:
        out = np.zeros_like(want)
        for r in state.groupBy("split_no").agg(*[F.sum(c) for c in columns]).collect():
            out[r[0]] = r[1:]
        return out

    chunked = comps.select(F.pmod(F.xxhash64("anchor", F.lit(seed)), F.lit(chunks)).alias("chunk"), F.col("anchor").cast("long").alias("anchor"), "n", *columns)
    state = materialize(chunked.groupBy("chunk").applyInArrow(first, schema), "state")
    best, loads = state, loads_of(state)
    least = deviation(loads, want)
    for k, power in enumerate(powers):
        # a number of partitions of our own: small chunks that cost much time must not be coalesced into one task by their bytes
        then = materialize(state.repartition(min(chunks, 10_000), "chunk").groupBy("chunk").applyInArrow(_annealer(want - loads, power, total[2 + BUCKETS + k], seed + k), schema), "state")
        loads = loads_of(then)
        if state is not best:
            release(state)
        state = then
        if (cost := deviation(loads, want)) < least:
            release(best)
            best, least = then, cost
    return lookup_join(rows.select("id", "anchor"), best.select("anchor", "n", "split_no"), "anchor", "n").select("id", F.element_at(F.array(*map(F.lit, names)), F.col("split_no") + 1).alias("split"))
