"""Components against union-find, joins with hot and null keys."""

import random

from sieveloom.operators import common, components


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return find


def expected_related(rows, via=()):
    pairs = [(("r", r), (k, v)) for r, keys in rows for k, v in keys.items() if v is not None] + [((k, v), (o, w)) for (k, v), (o, w) in via]
    find = union_find(pairs)
    least = {}
    ids = {r for r, keys in rows if any(v is not None for v in keys.values())}
    for r in ids:
        least[find(("r", r))] = min(least.get(find(("r", r)), r), r)
    return {(r, least[find(("r", r))]) for r in ids}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    rows = [(i, f"g{rng.randrange(60)}" if rng.random() < 0.5 else None, rng.randrange(70) if rng.random() < 0.5 else None) for i in range(120)]
    rows += rows[:5] + [(7, "other", None)]
    df = spark.createDataFrame([(i, g, a, "x", 1) for i, g, a in rows], "id long, g string, a long, m string, n int")
    got = {tuple(r) for r in components.related(df, "id", ["g", "a"]).collect()}
    assert got == expected_related([(i, {"g": g, "a": a}) for i, g, a in rows])


def test_components_long_chain_and_hot_key(spark):
    chain = [(i, f"k{i}", f"k{i + 1}") for i in range(64)]
    df = spark.createDataFrame([(i, a, None) for i, a, _ in chain] + [(i, None, b) for i, _, b in chain], "id long, g string, t string")
    via = spark.createDataFrame([(f"k{i}", f"k{i}") for i in range(70)], "t string, g string")
    got = dict(components.related(df, "id", ["g", "t"], via={"t": via}).collect())
    assert got == {i: 0 for i in range(64)}


def test_giant_star_and_null_keys(spark, monkeypatch):
    """One centre with 5,000 vertices, and nine tenths of the keys null: the same components, through the split of hot keys."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    edges = spark.range(1, 5001).selectExpr("id AS a", "CAST(0 AS LONG) AS b").union(spark.createDataFrame([(7001, 7000), (7002, 7001)], "a long, b long"))
    got = dict(components.star_forest(edges).collect())
    assert got == {i: 0 for i in range(1, 5001)} | {7001: 7000, 7002: 7000}
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'g' END AS g", "CASE WHEN id % 100 = 1 THEN 'h' || (id % 200) END AS h")
    got = dict(components.related(rows, "id", ["g", "h"]).collect())
    assert got == {i: 0 for i in range(0, 4000, 10)} | {i: i % 200 for i in range(4000) if i % 100 == 1}


def test_components_empty(spark):
    df = spark.createDataFrame([], "id long, g string")
    assert components.related(df, "id", ["g"]).count() == 0
    assert components.related(spark.createDataFrame([(1, None)], "id long, g string"), "id", ["g"]).count() == 0


def test_lookup_join_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 7) END AS k")
    right = left.dropna().groupBy("k").agg({"id": "count"}).withColumnRenamed("count(id)", "n").selectExpr("k", "n", "upper(k) AS v")
    want = {(r["id"], r["k"], None if r["k"] is None else r["k"].upper()) for r in left.collect()}
    assert {tuple(r) for r in common.lookup_join(left, right, "k", "n").collect()} == want
    assert {tuple(r) for r in common.lookup_join(left, right, "k", "n", "inner").collect()} == {w for w in want if w[1] is not None}


def test_null_keys_do_not_meet_in_one_task(spark, monkeypatch):
    """Nine tenths of the keys null, and a hot one among the rest: no partition of the join has over three times the median."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        for rows in (20_000, 200):
            monkeypatch.setattr(common, "HOT_ROWS", rows)
            left = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN CASE WHEN id % 20 = 0 THEN 'hot' ELSE 'k' || (id % 2000) END END AS k")
            right = left.dropna().groupBy("k").agg({"id": "count"}).withColumnRenamed("count(id)", "n").selectExpr("k", "n", "upper(k) AS v")
            sizes = sorted(common.lookup_join(left, right, "k", "n").selectExpr("spark_partition_id() AS p").groupBy("p").count().toPandas()["count"])
            assert sum(sizes) == 20_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
