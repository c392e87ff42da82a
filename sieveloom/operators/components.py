"""Connected components of rows that share keys, by alternating star contraction.

A key is stood for by the smallest row id that has it, so vertices are exact (no hashing of keys) and the smallest row of a component is its name. Rows drop
out at once: what is contracted is the graph of key representatives. All groupings are minima with map-side combining; no neighbourhood is ever collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.operators import common
from sieveloom.operators.common import lookup_join, materialize, release


def _signature(edges: DataFrame) -> tuple:
    """(edges, hash of them, most edges of one vertex), in one job."""
    ends = edges.select(F.col("a").alias("u"), F.xxhash64("a", "b").cast("decimal(20,0)").alias("h")).union(edges.select("b", F.lit(0).cast("decimal(20,0)")))
    r = ends.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return (r[0] or 0) // 2, r[1], r[2] or 0


def star_forest(edges: DataFrame) -> DataFrame:
    """(a, b) with b the smallest vertex of a's component, for each vertex a of the edges but the smallest ones. edges: (a, b), a > b, distinct.

    A contracted giant component is one star: where a vertex has that many edges, they are spread by lookup_join."""
    now = materialize(edges, "edges")
    seen = _signature(now)
    while True:
        hot = seen[2] > common.HOT_ROWS
        done = [now]

        def to_least(rows: DataFrame, key: str, least: DataFrame) -> DataFrame:
            if not hot:
                return rows.join(least.drop("n"), key)
            done.extend([rows, least])
            return lookup_join(rows, least, key, "n", "inner")

        # large star: each vertex sends its larger neighbours to the smallest of its neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = to_least(both, "u", materialize(least, "least") if hot else least).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each vertex sends its smaller neighbours, and itself, to the smallest of them
        if hot:
            large = materialize(large, "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        lowest = materialize(lowest, "least") if hot else lowest
        small = to_least(large, "a", lowest).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).distinct()
        then = materialize(small, "edges")
        for t in done:
            release(t)
        now, before = then, seen
        seen = _signature(now)
        if seen[:2] == before[:2]:
            return now


def related(rows: DataFrame, id_col: str, keys: list[str], via: dict[str, DataFrame] | None = None) -> DataFrame:
    """(id, anchor) for each id with a key: the smallest id it is connected with.

    via[k] has the columns k and o, another of the keys: whatever holds that value of k holds that value of o as well. Null keys connect nothing, a repeated id
    is one record with the keys of all its rows, an empty table gives none, and other columns are ignored."""
    base = rows.select(F.col(id_col).alias("id"), *keys)
    holders = {k: base.filter(F.col(k).isNotNull()).select(k, "id") for k in keys}
    first: dict[str, DataFrame] = {}
    links: list[DataFrame] = []
    through: dict[str, list[DataFrame]] = {k: [] for k in keys}

    def least_of(k: str) -> DataFrame:
        if k not in first:
            held = reduce(DataFrame.union, through[k], holders[k])
            first[k] = materialize(held.groupBy(k).agg(F.min("id").alias(f"m_{k}"), F.count(F.lit(1)).alias("n")), f"key_{k}")
        return first[k]

    for k, pairs in (via or {}).items():
        other = next(c for c in pairs.columns if c != k)
        got = materialize(lookup_join(pairs.dropna().distinct(), least_of(k), k, "n", "inner").select(other, F.col(f"m_{k}").alias("id")), "via")
        through[other].append(got)
    wide = base
    for k in keys:
        wide = lookup_join(wide, least_of(k), k, "n").drop(k)
        links += [lookup_join(g, least_of(k), k, "n", "inner").select(F.greatest("id", f"m_{k}").alias("a"), F.least("id", f"m_{k}").alias("b")) for g in through[k]]
    reps = [F.col(f"m_{k}") for k in keys]
    wide = materialize(wide.filter(reduce(lambda x, y: x | y, [c.isNotNull() for c in reps])).withColumn("m", F.least("id", *reps)), "rows")
    links.append(wide.select(F.explode(F.array(*reps)).alias("a"), F.col("m").alias("b")))
    # a repeated id may stand in rows of different keys: their representatives are linked too
    links.append(wide.groupBy("id").agg(F.max("m").alias("a"), F.min("m").alias("b")).select("a", "b"))
    forest = star_forest(reduce(DataFrame.union, links).filter("a > b").distinct())
    sizes = wide.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    roots = materialize(sizes.join(forest, sizes["m"] == forest["a"], "left").select("m", F.coalesce("b", "m").alias("anchor"), "n"), "roots")
    return lookup_join(wide.select("id", "m"), roots, "m", "n").groupBy("id").agg(F.min("anchor").alias("anchor"))
