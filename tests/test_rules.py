"""Message rules on cases, and their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from sieveloom.functions import unicode as u
from sieveloom.operators import evaluate, lexicon, ngrams, rules
from sieveloom.plans import checks, prep, training

D = "/root/testdata/sf0.001"


def found(text, mode="ACCENTED", abbr=frozenset()):
    return [(r, s, e) for r, s, e, _ in rules.resolve(rules.findings(text, mode, abbr, rules.ranges(text), rules.tokens(text)))]


@pytest.mark.parametrize("text, want", [
    ("  a", [("LEADING_WHITESPACE", 0, 2)]), ("a \t", [("TRAILING_WHITESPACE", 1, 3)]), ("   ", [("LEADING_WHITESPACE", 0, 3)]), ("a  b", [("MULTIPLE_WHITESPACE", 1, 3)]),
    ("a , b", [("WHITESPACE_BEFORE_PUNCTUATION", 1, 2)]), ("a!! b", [("REPEATED_PUNCTUATION", 1, 3)]), ("a...", []), ("a....", [("REPEATED_PUNCTUATION", 1, 5)]),
    ("a,b", [("MISSING_WHITESPACE_AFTER_PUNCTUATION", 1, 2)]), ("A.B.C", []), ("lúc 08:30", []), ("1.500.000d", []), ("x.,y", [("MISSING_WHITESPACE_AFTER_PUNCTUATION", 2, 3)]),
    ("a\u200bb", [("ZERO_WIDTH_CHARACTER", 1, 2)]), ("a\xa0b", [("NON_BREAKING_SPACE", 1, 2)]), ("a\x07", [("INVALID_CHARACTER", 1, 2)]), ("", []), ("xem https://a.vn/b,c", [("MISSING_WHITESPACE_AFTER_PUNCTUATION", 18, 19)]),
])
def test_findings(text, want):
    assert found(text) == want


def test_accents_and_abbreviations():
    assert found("Mã đơn", "NON_ACCENTED") == [("ACCENT_CHARACTER_IN_NON_ACCENT_MODE", 0, 2), ("ACCENT_CHARACTER_IN_NON_ACCENT_MODE", 3, 6)]
    assert found("e\u0323 u", "NON_ACCENTED") == [("ACCENT_CHARACTER_IN_NON_ACCENT_MODE", 0, 2)]
    assert found("soan TC gui", abbr=frozenset({"TC"})) == [("ABBREVIATION_DETECTED", 5, 7)]


@pytest.mark.parametrize("text, want", [
    ("xem www.a.com, nhé", [(4, 13, "URL")]), ("a.vn/x?y=1&z", [(0, 12, "URL")]), ("thư a@b.vn.", [(4, 10, "EMAIL")]), ("gọi 0912 345 678", [(4, 16, "PHONE")]),
    ("ngày 31/12/2025", [(5, 15, "DATE")]), ("32/13", []), ("08:30", [(0, 5, "TIME")]), ("1,000,000", [(0, 9, "NUMBER")]), ("mã DH123456", [(3, 11, "PRODUCT_CODE")]), ("{{ten}} ${otp} {x}", [(0, 7, "PLACEHOLDER"), (8, 14, "PLACEHOLDER"), (15, 18, "PLACEHOLDER")]),
])
def test_protected_spans(text, want):
    assert rules.ranges(text) == want


def test_tokens_tile_the_text():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("aà đ1.,!😀\xa0\u200b\n-e\u0301") for _ in range(rng.randrange(30)))
        toks = rules.tokens(t)
        assert "".join(x[0] for x in toks) == t and all(t[s:e] == raw for raw, _, s, e, _ in toks)
    assert rules.utf16("a😀b", 2) == 3


def test_results_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "a  b", "ACCENTED", "x"), (3, "mã", "NON_ACCENTED", "x"), (4, "", "?", "x"), (5, "a, " * 50000, "ACCENTED", "x")], "id int, text string, message_mode string, start string")
    got = {r["id"]: r for r in rules.checked(df).collect()}
    assert got[1]["issues"] is None and got[2]["valid"] and len(got[2]["issues"]) == 1 and not got[3]["valid"] and got[4]["issues"] == [] and got[5]["summary"]["word_count"] == 50000
    assert rules.checked(df.limit(0)).count() == 0


def test_window_equals_fold(spark):
    a = {tuple(r) for r in checks.conflicts_window(spark, D).collect()}
    b = {tuple(r)[:2] + tuple(r)[3:6] for r in checks.issues_final(spark, D).collect()}
    assert a == b


def test_verify(spark):
    rows = [("POSSIBLE_SPELLING_ERROR", "Abc", "abd", 0.5), ("POSSIBLE_SPELLING_ERROR", "xyz", "xya", 0.5), ("POSSIBLE_SPELLING_ERROR", "cho", "chợ", 0.5), ("POSSIBLE_SPELLING_ERROR", "hai", "hại", 0.97), ("POSSIBLE_SPELLING_ERROR", "ba", "bà", 0.1), ("LEADING_WHITESPACE", " ", None, None)]
    f = spark.createDataFrame(rows, "rule_id string, value string, suggestion string, confidence double")
    lex = spark.createDataFrame([("abc",), ("cho",), ("hai",), ("ba",)], "word string")
    chan = spark.createDataFrame([("cho", "chợ", 5), ("ba", "bà", 2)], "source string, target string, n long")
    assert {r["value"] for r in rules.verify(f, lex, chan).collect()} == {"xyz", "cho", "hai", " "}


def test_unicode_functions(spark):
    assert u.osa("khcah", "khach") == 0.8 and u.osa("abc", "abc") == 0 and u.osa("", "ab") == 2 and u.osa("ab", "ba") == 0.8
    assert u.accent_key_of("Đây") == "day" and u.tone_flip("má", "mà") and not u.tone_flip("ma", "mo") and u.fnv1a("a") == 0xE40C292C
    r = spark.createDataFrame([("Ma\u0301", None), (None, "a")], "a string, b string").select(u.nfc("a").alias("a"), u.osa_distance("a", "b").alias("d"), u.telex_decode(F.lit("ddaaw")).alias("t")).collect()
    assert r[0]["a"] == "Má" and r[1]["a"] is None and r[0]["d"] is None and r[0]["t"] == "đaă"


def test_greedy_match():
    same = lambda a, b: a == b
    assert evaluate.match_one_to_one([1, 1, 2], [1, 2], same) == [0, -1, 1]


def test_ranked_pool(spark):
    v = spark.createDataFrame([("khach", 9), ("khac", 5), ("khanh", 1)], "word string, freq long")
    got = {(r["word"], r["pool_rank"]) for r in lexicon.ranked(lexicon.pool(spark.createDataFrame([("khcah",)], "word string"), v, 2)).collect()}
    assert ("khach", 1) in got


@pytest.mark.parametrize("name", [n for m in (checks, prep, training) for n in m.QUERIES if n not in m.SQL and n not in ("lane_findings", "lane_scores")])
def test_other_queries_run(spark, name):
    f = {**checks.QUERIES, **prep.QUERIES, **training.QUERIES}[name]
    assert f(spark, D).count() > 0
