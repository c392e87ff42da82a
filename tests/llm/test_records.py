"""Splits, copies and overlaps against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveloom.functions.text import canonical, folded_words
from sieveloom.llm import copies, overlaps, queries, splits
from tests.test_components import expected_related
from sieveloom.sources.tables import table

D = "/root/testdata/sf0.001"


def test_p2_on_tables(spark):
    key = lambda g: (g.strip(" \t\r\n\xa0\u200b\ufeff\u2003").lower() or None) if g is not None else None
    rows = [(r["row_id"], {"g": key(r["group_id"]), "t": r["template_id"], "a": r["author_id"] or None}) for r in table(spark, D, "sms_dataset").collect()]
    used = {k["t"] for _, k in rows}
    via = [(("t", r["template_id"]), ("g", key(r["template_group"]))) for r in table(spark, D, "templates").collect() if key(r["template_group"]) and r["template_id"] in used]
    want = {(a, r) for r, a in expected_related(rows, via) if a != r}
    assert {tuple(r) for r in queries.p2_found(spark, D).collect()} == want


def test_splits_keep_components_and_shares(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc")) for i in range(3000)] + [(0, "a"), (None, "a"), (3000, None)]
    anchors = {i: i - i % rng.choice([1, 2, 3, 5, 40]) for i in range(3000)}
    related = spark.createDataFrame([(i, a) for i, a in anchors.items() if i % 11], "id long, anchor long")
    records = spark.createDataFrame(rows, "id long, label string")
    got = {r["id"]: r["split"] for r in splits.assign(records, related, "label", ["train", "validation", "test"], [0.8, 0.1, 0.1]).collect()}
    assert len(got) == 3001
    of = defaultdict(set)
    for i in got:
        of[anchors[i] if i % 11 and i in anchors else i].add(got[i])
    assert all(len(v) == 1 for v in of.values())
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(v == name for v in got.values()) / 3001 - share) < 0.02


def test_splits_giant_component_and_empty(spark):
    records = spark.createDataFrame([(i, "a") for i in range(90)], "id long, label string")
    related = spark.createDataFrame([(i, 0) for i in range(60)], "id long, anchor long")
    got = {r["id"]: r["split"] for r in splits.assign(records, related, "label", ["a", "b"], [0.7, 0.3]).collect()}
    assert len({got[i] for i in range(60)}) == 1 and sum(v == "a" for v in got.values()) in range(60, 67)
    assert splits.assign(records.limit(0), related.limit(0), "label", ["a", "b"], [0.5, 0.5]).count() == 0


def test_splits_in_many_chunks_make_good_what_a_giant_upsets(spark, monkeypatch):
    """A component of a third of all records sits in one of many chunks; the others' passes bring the sizes and labels of all splits near their targets."""
    monkeypatch.setattr(splits, "CHUNK", 40)
    rng = random.Random(2)
    rows = [(i, rng.choice("aab")) for i in range(3000)]
    related = spark.createDataFrame([(i, 0 if i < 1000 else i - i % 4) for i in range(3000)], "id long, anchor long")
    got = dict(splits.assign(spark.createDataFrame(rows, "id long, label string"), related, "label", ["x", "y", "z"], [0.5, 0.3, 0.2]).collect())
    assert len({got[i] for i in range(1000)}) == 1
    for name, share in (("x", 0.5), ("y", 0.3), ("z", 0.2)):
        mine = [i for i in got if got[i] == name]
        assert abs(len(mine) / 3000 - share) < 0.02, name
        assert abs(sum(rows[i][1] == "b" for i in mine) / 3000 - share / 3) < 0.03, name


COPIES = [
    ("a1", "Mã  10:32, Xin chào!"),
    ("a2", "mã 10:32 xin\u200b CHÀO"),
    ("a3", "mã 10.32 xin chào"),
    ("a4", "ma 10:32 xin chao"),
    ("b1", "Hạn: 1/2; Mã đơn: X1"),
    ("b2", "mã đơn : x1\nHạn: 1/2"),
    ("b3", "Hạn 1/2 Mã đơn X1"),
    ("c1", ""),
    ("c2", " ... "),
    ("d1", None),
    ("e1", "lâu " * 30000),
    ("e2", "LÂU, " * 30000),
    (None, "x"),
]


def test_copies_by_case(spark):
    df = spark.createDataFrame([(i, t, "zz", 1) for i, t in COPIES + COPIES[:2]], "id string, text string, plain string, n int")
    got = {tuple(r) for r in copies.copies_found(copies.structures(df, "t", "id", "text")).collect()}
    assert got == {("t", "a1", "a2"), ("t", "b1", "b2"), ("t", "b1", "b3"), ("t", "c1", "c2"), ("t", "e1", "e2")}
    counted = {r["record_id"]: r["copies"] for r in copies.copies_counted(copies.structures(df, "t", "id", "text")).collect()}
    assert counted == {"a1": 2, "a3": 1, "a4": 1, "b1": 3, "c1": 2, "e1": 2}


def test_copies_slots(spark):
    rows = [("1", "Hi {a}", '{"a": ["x"], "b": [1]}'), ("2", "hi {a}!", '{"b":[1],\n"a":["x"]}'), ("3", "Hi {a}", '{"a": ["y"], "b": [1]}'), ("4", "Hi {a}", None), ("5", "hi a", None), ("6", "Hi a", "{broken")]
    df = spark.createDataFrame(rows, "id string, text string, slots string")
    got = {tuple(r) for r in copies.copies_found(copies.structures(df, "t", "id", "text", "slots")).collect()}
    assert got == {("t", "1", "2"), ("t", "4", "5")}


def test_copies_are_merkle_hashed_and_compared_in_full(spark, monkeypatch):
    """A digest is made of child digests alone, field order doesn't count, and records that share a digest by chance are told apart by their structures."""
    a, b = copies.record_nodes("t", "Hạn: 1/2; Mã: X1", None), copies.record_nodes("t", "mã: x1 | hạn: 1/2", None)
    assert a[0] != b[0] and a[1] == b[1] and len(a[1][0]) == 16
    inner = [copies.node("p", [copies.leaf("a", x), copies.leaf("b", y)]) for x, y in (("hạn", "1/2"), ("mã", "x1"))]
    assert a[1][0] == copies.node("r", [copies.leaf("d", "t"), copies.node("f", inner, ordered=False)])[0]
    assert copies.slots_node('{"a": [1, 2], "b": {"c": "x", "d": null}}') == copies.slots_node('{"b": {"d": null, "c": "x"}, "a": [1, 2]}') != copies.slots_node('{"b": {"d": null, "c": "x"}, "a": [2, 1]}')
    df = spark.createDataFrame([(i, t) for i, t in COPIES if i], "id string, text string")
    records = copies.structures(df, "t", "id", "text").withColumn("plain", copies.F.lit(b"same").cast("binary"))
    assert {tuple(r) for r in copies.copies_found(records).collect()} == {("t", "a1", "a2"), ("t", "b1", "b2"), ("t", "b1", "b3"), ("t", "c1", "c2"), ("t", "e1", "e2")}


def test_copies_hot_class(spark, monkeypatch):
    from sieveloom.operators import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    df = spark.createDataFrame([(f"{i:04}", "Một  mẫu" if i % 3 else f"riêng {i // 6}") for i in range(300)], "id string, text string")
    got = {r["record_id"]: r["copies"] for r in copies.copies_counted(copies.structures(df, "t", "id", "text")).collect()}
    assert got == {"0001": 200} | {f"{i:04}": 2 for i in range(0, 300, 6)}


def test_copies_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert copies.copies_found(copies.structures(df, "t", "id", "text")).count() == 0


def test_field_lists():
    assert copies.parse_fields("Gói https://a.example/x\nNhắc nhẹ: kiện") is None
    assert copies.parse_fields("lúc 07:01\nlúc 08:02") is None
    assert len(copies.parse_fields("Hạn: 1/2 | Giá: 3\nđồng")) == 2
    assert canonical("a\u0301  B") == canonical("á b")


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(diag + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


words = st.lists(st.sampled_from("abcde"), max_size=14)


@settings(max_examples=400, deadline=None)
@given(words, words, st.integers(0, 5))
def test_banded_edit_distance(a, b, k):
    assert overlaps.edit_within(a, b, k) == (edit(a, b) <= k)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefghij"), min_size=1, max_size=18), st.randoms(use_true_random=False), st.integers(1, 2000))
def test_signatures_meet(a, rng, texts):
    """Any two texts within the allowance share a path, whatever the frequencies."""
    b = list(a)
    for _ in range(overlaps.allowance(len(a))):
        kind, at = rng.randrange(3), rng.randrange(len(b) + 1)
        if kind == 0:
            b.insert(at, rng.choice("abcdefghijk"))
        elif b:
            at = min(at, len(b) - 1)
            b[at : at + 1] = [] if kind == 1 else [rng.choice("abcdefghijk")]
    if edit(a, b) > overlaps.allowance(max(len(a), len(b))):
        return
    freq = {c: 1 + 97 * (ord(c) * 31 % 17) for c in "abcdefghijk"}

    def paths(t):
        seen, ranked = defaultdict(int), []
        for c in t:
            seen[c] += 1
            ranked.append((freq[c] / seen[c], ord(c) * 1000 + seen[c]))
        ranked.sort()
        return {p for p, _ in overlaps.signatures([x for _, x in ranked], [f for f, _ in ranked], len(t), float(texts))}

    assert paths(a) & paths(b)


@pytest.mark.parametrize("n", [25, 31, 33, 63, 66, 127, 140, 255, 270, 600])
def test_signatures_meet_across_length_classes(n):
    """Texts at the edges of the length classes share a path with every near text, and have no more paths than the bound, whatever the number of texts."""
    rng = random.Random(n)
    freq = {f"w{i}": 1 + 5000 // (i + 1) for i in range(400)}
    words_of = lambda m: [f"w{min(399, int(400 * rng.random() ** 2))}" for _ in range(m)]

    def paths(t, texts):
        seen, ranked = defaultdict(int), []
        for c in t:
            seen[c] += 1
            ranked.append((freq[c] * (texts / 5000) / seen[c], int(c[1:]) * 1000 + seen[c]))
        ranked.sort()
        got = overlaps.signatures([x for _, x in ranked], [f for f, _ in ranked], len(t), float(texts))
        assert len(got) <= overlaps.most_signatures(len(t))
        return {p for p, _ in got}

    for texts in (5_000, 5_000_000_000):
        for _ in range(12):
            a = words_of(n)
            b = list(a)
            more = rng.random()
            for _ in range(overlaps.allowance(n)):
                at = rng.randrange(len(b))
                b[at : at + 1] = words_of(1) if rng.random() < 0.4 else [b[at], *words_of(1)] if rng.random() < more else []
            k = overlaps.allowance(max(len(a), len(b)))
            if overlaps.edit_within(a, b, k):
                assert paths(a, texts) & paths(b, texts)


def test_cross_split_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 24))) for _ in range(60)]
    rows = []
    for i in range(240):
        t = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(["Đ9", "z1", "à2"])
        rows.append((f"i{i:03}", rng.choice([1, 1, 2, None]), "  ".join(t)))
    rows += [("n1", 1, None), ("n2", 2, None), ("e1", 1, ""), ("e2", 2, " .. "), ("l1", 1, "w x y " * 700), ("l2", 2, "W, x y " * 700 + "end"), ("i000", 2, rows[0][2]), rows[3]]
    df = spark.createDataFrame([(a, s, t, "q") for a, s, t in rows], "id string, side int, text string, cls string").filter("side is not null")
    got = {tuple(r) for r in overlaps.cross_split(df).collect()}
    want = set()
    for a, s, x in rows:
        for b, r, y in rows:
            if s == 1 and r == 2 and a != b and x is not None and y is not None:
                p, q = folded_words(x), folded_words(y)
                if abs(len(p) - len(q)) <= max(len(p), len(q)) // 5 and (len(p) > 1000 or edit(p, q) <= max(len(p), len(q)) // 5):
                    want.add((min(a, b), max(a, b)))
    assert got == want


def test_partners_counts_without_expanding(spark):
    rows = [("a", 1, "x y z"), ("b", 1, "X y, z"), ("c", 2, "x y z"), ("d", 2, "x y z"), ("c", 1, "x y z"), ("e", 2, "p q r s t"), ("f", 1, "p q r s u"), ("g", 2, "else")]
    df = spark.createDataFrame(rows, "id string, side int, text string")
    assert dict(overlaps.partners(df).collect()) == {"c": 2, "d": 3, "e": 1}


def test_cross_split_empty(spark):
    assert overlaps.cross_split(spark.createDataFrame([], "id string, side int, text string")).count() == 0


@pytest.mark.parametrize("name", ["p2_splits", "p2_report", "p3_found", "p3_counted", "p5_found", "p5_report"])
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, D).count() > 0
