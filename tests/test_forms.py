"""Matching against a plain walk, rules that fail, shards and their digests, and forms against the rules' own."""

import random

from pyspark.sql import functions as F

from sieveloom.operators import matching as mt
from sieveloom.operators import rules
from sieveloom.plans import forms


def walk(takers, offers, fits, cost):
    used, out = set(), []
    for t in takers:
        free = sorted((cost(t, o), i) for i, o in enumerate(offers) if i not in used and fits(t, o))
        out.append(free[0][1] if free else -1)
        used.add(out[-1])
    return out


def test_one_to_one_against_a_plain_walk(spark):
    rng = random.Random(1)
    one = lambda: (rng.choice("ab"), rng.choice(["x", "y", None]), s := rng.randrange(6), s + rng.randrange(1, 4))
    rows = [(k, [one() for _ in range(rng.randrange(5))], [one() for _ in range(rng.randrange(5))]) for k in range(200)] + [(900, None, []), (901, [], None)]
    shape = "array<struct<value:string,suggestion:string,start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, t {shape}, o {shape}")
    same, over = (lambda a, b: a[2:] == b[2:]), (lambda a, b: a[2] < b[3] and b[2] < a[3])
    cases = [
        (mt.touching, mt.inexact, lambda a, b: over(a, b) and (a[0] == b[0] or same(a, b)), lambda a, b: int(not same(a, b))),
        (mt.same_value, mt.inexact_or_wrong, lambda a, b: a[0] == b[0] and over(a, b), lambda a, b: 2 * (not same(a, b)) + (a[1] is None or a[1] != b[1])),
        (mt.exact, None, lambda a, b: a[0] == b[0] and same(a, b) and (a[1] is None or b[1] is None or a[1] == b[1]), lambda a, b: 0),
    ]
    for fits, cost, py_fits, py_cost in cases:
        got = {r["id"]: r["at"] for r in df.select("id", mt.one_to_one(F.col("t"), F.col("o"), fits, cost).alias("at")).collect()}
        assert got == {k: walk(t or [], o or [], py_fits, py_cost) for k, t, o in rows}


def test_a_failing_rule_costs_its_own_findings_only(spark):
    def broken(m):
        raise ValueError("no")

    text = " hai  dấu !!"
    before, failed = rules.run_rules(text, "ACCENTED", frozenset(), [], rules.tokens(text))
    assert not failed and {f[0] for f in before} >= {"LEADING_WHITESPACE", "REPEATED_PUNCTUATION"}
    kept = rules.REGISTRY["LEADING_WHITESPACE"]
    rules.REGISTRY["LEADING_WHITESPACE"] = broken
    try:
        after, failed = rules.run_rules(text, "ACCENTED", frozenset(), [], rules.tokens(text))
    finally:
        rules.REGISTRY["LEADING_WHITESPACE"] = kept
    assert failed == ["LEADING_WHITESPACE"] and after == [f for f in before if f[0] != "LEADING_WHITESPACE"]
    results = spark.createDataFrame([("a", ["X"]), ("b", ["X", "Y"]), ("c", [])], "id string, degraded array<string>")
    assert {(r["rule_id"], r["messages"], tuple(r["latest"])) for r in rules.degraded(results, "id").collect()} == {("X", 2, ("b", "a")), ("Y", 1, ("b",))}


def test_forms_of_repeated_marks_are_the_rules(spark):
    import re

    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("a!?,;:. ") for _ in range(30))
        assert [m.span() for m in re.finditer(forms._AGAIN, text)] == [m.span() for m in rules._AGAIN.finditer(text)]


def test_shards_carry_their_digests(spark, tmp_path):
    from sieveloom.sources import files

    df = spark.range(1000).selectExpr("id AS key", "concat('v', id % 7) AS v")
    got = files.dump_shards(df, f"file://{tmp_path}/d", "key", 4).collect()
    assert sum(r["rows"] for r in got) == 1000 and 1 < len(got) <= 4
    again = files.dump_shards(df.orderBy(F.desc("key")), f"file://{tmp_path}/e", "key", 4).collect()
    assert sum(r["digest"] for r in got) == sum(r["digest"] for r in again)
    ends = sorted((r["first_key"], r["last_key"]) for r in got)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_csv_sink(spark, tmp_path):
    from sieveloom.sources import files

    files.write_whole(spark.createDataFrame([("a,b", 1), ('q"r', 2)], "t string, n int"), f"file://{tmp_path}/c", kind="csv", manifest={"of": "test"}, header="true")
    assert sorted(map(tuple, spark.read.option("header", True).schema("t string, n int").csv(f"{tmp_path}/c").collect())) == [("a,b", 1), ('q"r', 2)]
