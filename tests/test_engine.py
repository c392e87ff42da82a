"""Linguistic lanes, sources and streams."""

import pytest
from pyspark.sql import functions as F

from sieveloom.config import Config
from sieveloom.functions.unicode import accent_key_of
from sieveloom.operators import lanes, ngrams, prep, rules
from sieveloom.sources import files
from sieveloom.streaming import messages as stream

LINES = ["quý khách vui lòng giữ tin này", "xin cảm ơn quý khách", "hẹn gặp lại quý khách hôm nay", "đơn hàng đã giao tại quầy", "mời quý khách đến cửa hàng hôm nay", "giao hàng tại nhà trước giờ hẹn"] * 8


@pytest.fixture(scope="module")
def model(spark):
    rows = ngrams.lines(spark.createDataFrame([(t, i) for i, t in enumerate(LINES)], "text string, i int"), "text", "i")
    u, b, t = (ngrams.count_grams(rows, n).cache() for n in (1, 2, 3))
    lexicon = u.select(F.col("gram").alias("word"), F.col("c").alias("freq"), F.lit("corpus").alias("src"))
    pairs = spark.createDataFrame([("khahc", "khách", 3), ("tajiq", "tại", 5)], "source string, target string, n long")
    allowed = spark.createDataFrame([("abcshop",)], "word string")
    cfg = Config().override(plain_form_frequency=50, spelling_frequency=2, boundary_frequency=2, word_boundary="ACTIVE")
    return lanes.Model(u, b, t, lexicon, pairs, allowed, cfg), prep.direct(pairs, u.select(F.col("gram").alias("word")))


def test_lanes_on_cases(spark, model):
    texts = ["xin cam on quy khach", "mời quý kháhc đến cửa hàng", "hẹn gặplại quý khách hôm nay", "xin cảm ơn quý khách", "giao hàng tại abcshop hôm nay", None, "", "xin cảm ơn quý khách " * 400, "mã quy22 khach12 0912345678 a@b.vn"]
    rows = [(i, t, "ACCENTED", "x") for i, t in enumerate(texts)] + [(50, texts[0], "NON_ACCENTED", "x"), (0, texts[0], "ACCENTED", "x")]
    m = spark.createDataFrame(rows, "msg_id long, text string, mode string, lane string")
    got = {(r["msg_id"], r["rule_id"], r["value"], r["suggestion"]) for r in lanes.find(m, *model)[0].collect()}
    want = {(0, "POSSIBLE_MISSING_DIACRITIC", "cam", "cảm"), (0, "POSSIBLE_MISSING_DIACRITIC", "on", "ơn"), (0, "POSSIBLE_MISSING_DIACRITIC", "quy", "quý"), (0, "POSSIBLE_MISSING_DIACRITIC", "khach", "khách"), (1, "POSSIBLE_SPELLING_ERROR", "kháhc", "khách"), (2, "POSSIBLE_WORD_BOUNDARY_ERROR", "gặplại", "gặp lại")}
    assert want <= got and not {g for g in got if g[0] > 2}


def test_validate(spark, model):
    from sieveloom.operators.engine import validate, validate_text

    df = spark.createDataFrame([(1, "xin cam  on quý khách", "ACCENTED"), (2, None, "ACCENTED"), (3, "mã", "NON_ACCENTED"), (4, "", "ACCENTED"), (1, "xin cam  on quý khách", "ACCENTED")], "msg_id long, text string, mode string")
    got = {r["msg_id"]: r for r in validate(df, *model).collect()}
    assert [(i["rule_id"], i["start"]) for i in got[1]["issues"]] == [("POSSIBLE_MISSING_DIACRITIC", 4), ("MULTIPLE_WHITESPACE", 7), ("POSSIBLE_MISSING_DIACRITIC", 9)]
    assert got[1]["summary"]["linguistic_issue_count"] == 2 and got[1]["valid"] and not got[2]["valid"] and got[2]["issues"] == [] and got[3]["has_errors"] and got[4]["valid"]
    assert validate_text(spark, "a  b")["issues"][0]["rule_id"] == "MULTIPLE_WHITESPACE"


def test_corpus_labels_meet_rules_and_lanes(spark, model, tmp_path, monkeypatch):
    """All messages are validated, each in its own mode, and a label of a linguistic rule in the corpus can be caught."""
    from sieveloom.plans import checks
    from sieveloom.plans import prep as plans

    label = "array<struct<rule_id:string,issue_value:string,suggestion:string,position_start:int,position_end:int>>"
    rows = [("c1", "a", "xin cam  on quý khách", "ACCENTED", [("POSSIBLE_MISSING_DIACRITIC", "cam", "cảm", 4, 7), ("MULTIPLE_WHITESPACE", None, None, 7, 9)]), ("c2", "b", "xin cam on quý khách", "NON_ACCENTED", []), ("c3", "b", "hẹn gặplại quý khách hôm nay", None, [])]
    corpus = spark.createDataFrame(rows, f"id string, category string, text string, message_mode string, expect {label}")
    corpus = corpus.selectExpr("*", "'S_VN' AS brand", "'x' AS source_name", "CAST(array('ABBREVIATION_DETECTED') AS array<string>) AS forbid", "false AS clean", "true AS fully_labeled", "CAST(null AS array<string>) AS fully_labeled_rule_ids")
    corpus.write.parquet(f"file://{tmp_path}/corpus.parquet")
    spark.createDataFrame([(1, "xin cam on quý khách", "train", "x"), (2, "xin cảm ơn quý khách", "dev", "x"), (2, "xin cảm ơn quý khách", "dev", "x")], "row_id long, text string, split string, brandname string").write.parquet(f"file://{tmp_path}/sms_dataset.parquet")
    spark.createDataFrame([("r:1", ("xin  chào mã", "NON_ACCENTED"))], "run_id string, result struct<input_text:string,message_mode:string>").write.parquet(f"file://{tmp_path}/special_case_results.parquet")
    monkeypatch.setattr(checks, "_lane_model", lambda spark, d: model)
    d = str(tmp_path)
    assert {tuple(r) for r in plans.match_strict(spark, d).select("id", "expected", "caught", "forbidden").collect()} == {("c1", 2, 2, 0), ("c2", 0, 0, 0), ("c3", 0, 0, 0)}
    got = {(r["message_table"], r["msg_id"]): (r["linguistic_issue_count"], r["has_errors"]) for r in checks.validated(spark, d).collect()}
    assert got == {("corpus", "c1"): (2, False), ("corpus", "c2"): (0, True), ("corpus", "c3"): (0, False), ("sms_dataset", "1"): (2, False), ("sms_dataset", "2"): (0, False), ("special_case_results", "r:1"): (0, True)}


def test_candidate_pool_holds_siblings_and_the_bare_spelling(spark, model):
    """Siblings of the own key beyond the cap come in for accented words, and the spelling without accents stays, however rare."""
    m, _ = model
    counts = [("vé", 90), ("về", 80), ("vẽ", 70), ("vẻ", 60), ("vệ", 50), ("ve", 1), *[(w, 40) for w in "má mà mả mã mạ mâ mấ mầ mẩ mẫ mậ mă".split()], ("ma", 2)]
    u = spark.createDataFrame(counts, "gram string, c long")
    own = lanes.Model(u, m.b, m.t, m.lexicon, m.pairs, m.allowed, m.cfg)
    got = {}
    for r in lanes.candidate_pool(spark.createDataFrame([("vể",), ("veh",), ("mah",)], "word string"), own).collect():
        assert (r["word"], r["cand"]) not in got
        got[r["word"], r["cand"]] = r["freq"]
    assert {(c, f) for (w, c), f in got.items() if w == "vể" and c[0] == "v"} == set(counts[:6])
    assert {c for w, c in got if w == "veh" and c[0] == "v"} == {"vé", "về", "vẽ", "ve"} and got["mah", "ma"] == 2 and sum(w == "mah" and c[0] == "m" for w, c in got) == 4


def test_real_words_need_a_proven_pair(spark, model):
    m, direct = model
    pairs = spark.createDataFrame([("hang", "hàng", 1), ("nhà", "này", 4)], "source string, target string, n long")
    own = lanes.Model(m.u, m.b, m.t, m.lexicon, pairs, m.allowed, m.cfg)
    msg = spark.createDataFrame([(1, "vui lòng giữ tin nhà", "ACCENTED")], "msg_id long, text string, mode string")
    words = lanes.classified(lanes.positions(msg), own)
    assert {(r["value"], r["suggestion"]) for r in lanes.real_words(words, own).collect()} <= {("nhà", "này")}
    assert lanes.real_words(words, m).count() == 0


def test_missing_diacritics_near_protected_spans(spark, model):
    """A known bare word without a proven pair and below the floor passes close to a protected span, if its suggestion is attested more often."""
    m, direct = model
    known = m.lexicon.unionByName(spark.createDataFrame([("gio", 3, "corpus")], "word string, freq long, src string"))
    own = lanes.Model(m.u, m.b, m.t, known, m.pairs, m.allowed, m.cfg.override(confidence_floor=1.0))
    texts = ["giao hàng tại nhà trước gio 0912345678", "giao hàng tại nhà trước gio hẹn 0912345678", "giao hàng tại nhà trước gio hẹn", "a@b.vn gio hẹn gặp lại"]
    df = spark.createDataFrame([(i, t, "ACCENTED") for i, t in enumerate(texts)], "msg_id long, text string, mode string")
    words = lanes.classified(lanes.positions(df), own)
    raw = lanes.missing_diacritics(words, own).collect()
    assert {r["msg_id"] for r in raw if (r["value"], r["suggestion"]) == ("gio", "giờ")} == {0, 1, 2, 3} and all(r["confidence"] < own.cfg.confidence_floor for r in raw)
    assert {(r["msg_id"], r["value"], r["suggestion"]) for r in lanes.find(df, own, direct)[0].collect()} == {(0, "gio", "giờ"), (3, "gio", "giờ")}
    no = lanes.Model(m.u, m.b.filter("gram not like '%giờ%'"), m.t.filter("gram not like '%giờ%'"), known, m.pairs, m.allowed, m.cfg)
    found = spark.createDataFrame([(0, "POSSIBLE_MISSING_DIACRITIC", 24, 27, "giờ")], "msg_id long, rule_id string, start int, end int, suggestion string")
    spans = df.select("msg_id", rules.ranges_udf("text", "mode").alias("ranges"))
    assert [r["spared"] for r in lanes.with_spared(found, spans, words, own).collect()] == [True] and [r["spared"] for r in lanes.with_spared(found, spans, words, no).collect()] == [None]


def test_lanes_shadow_off_and_empty(spark, model):
    m = spark.createDataFrame([(1, "hẹn gặplại quý khách hôm nay", "ACCENTED")], "msg_id long, text string, mode string")
    quiet = lanes.Model(*[getattr(model[0], x) for x in ("u", "b", "t", "lexicon", "pairs", "allowed")], model[0].cfg.override(word_boundary="SHADOW", spelling="OFF"))
    served, shadow = lanes.find(m, quiet, model[1])
    assert "POSSIBLE_WORD_BOUNDARY_ERROR" not in {r["rule_id"] for r in served.collect()} and shadow.count() == 1
    assert lanes.find(m.limit(0), *model)[0].count() == 0
    with pytest.raises(KeyError):
        Config().override(nothing=1)


def test_beam_and_scores():
    c = lanes.Counts({"a": 4, "b": 2, "c": 3, "a b": 2, "b c": 1, "a b c": 1}, 9.0, 3.0)
    assert abs(c.p1("a") - 4.5 / 10.5) < 1e-12 and abs(c.p2("b", "a") - (2 + 2 * c.p1("b")) / 6) < 1e-12 and c.p2("b", "z") == c.p1("b")
    assert abs(c.p3("c", "b", "a") - (1 + c.p2("c", "b")) / 3) < 1e-12 and abs(c.pair("a", "b") - (2 + 20 * c.p1("a") * c.p1("b")) / 29) < 1e-12
    assert lanes.beam(c, [[("a", 1, False)], [("c", 3, False), ("b", 2, False)]], 5, 0.8) == ["a", "b"]
    assert accent_key_of("Đường") == "duong"


def test_ngram_file_round_trip_and_breaks(spark, tmp_path):
    u, b, t = (spark.createDataFrame(x, "gram string, c long") for x in ([("a", 3), ("b", 2)], [("a b", 2)], [("a b a", 1)]))
    files.write_ngrams(u, b, t, f"file://{tmp_path}/lm")
    files.write_ngrams(u, b, t, f"file://{tmp_path}/lm")
    x, y, z, n = files.read_ngrams(spark, f"file://{tmp_path}/lm")
    assert n == 5 and {tuple(r) for r in x.collect()} == {("a", 3), ("b", 2)} and y.count() == z.count() == 1
    cases = ["U\ta\t1", "#tokens=1\n#tokens=1\nU\ta\t1", "#tokens=1\nX\ta\t1", "#tokens=1\nB\ta b\t1\nU\ta\t1", "#tokens=1\nU\ta", "#tokens=1\nU\t\t1", "#tokens=1\nU\ta\t0", "#tokens=1\nU\ta\t1.5", "#tokens=1\nU\ta\t1\nU\ta\t2"]
    for i, text in enumerate(cases):
        (tmp_path / f"bad{i}").write_text(text + "\n")
        with pytest.raises(files.BadFile):
            files.read_ngrams(spark, f"file://{tmp_path}/bad{i}")
    with pytest.raises(FileNotFoundError):
        files.read_ngrams(spark, f"file://{tmp_path}/none")


def test_other_files(spark, tmp_path):
    (tmp_path / "lex").write_text("Mã\t3\tn\nmã\t5\tv\n")
    assert [tuple(r) for r in files.read_lexicon(spark, f"file://{tmp_path}/lex").collect()] == [("mã", 5, "v")]
    (tmp_path / "stop").write_text("# c\n A \n\na\n")
    assert [r[0] for r in files.read_lines(spark, f"file://{tmp_path}/stop").collect()] == ["a"]
    (tmp_path / "rows.json").write_text('{"rows": [{"a": 1}, {"a": 2}]}')
    from pyspark.sql import types as T

    assert files.read_rows(spark, f"file://{tmp_path}/rows.json", T.StructType([T.StructField("a", T.IntegerType())])).count() == 2
    df = spark.range(3)
    files.write_evaluation(df, f"file://{tmp_path}/ev", {"split": "dev"})
    head, rows = files.read_evaluation(spark, f"file://{tmp_path}/ev", "id long")
    assert head["split"] == "dev" and rows.count() == 3
    with pytest.raises(files.BadFile):
        files.read_evaluation(spark, f"file://{tmp_path}/lex", "id long")
    files.write_whole(df, f"file://{tmp_path}/t", manifest={"source": "x"})
    files.write_whole(df.limit(1), f"file://{tmp_path}/t", manifest={"source": "x"})
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 1 and '"rows": 1' in (tmp_path / "t.manifest.json").read_text()
    assert files.kept(spark, f"file://{tmp_path}/k", lambda: df).count() == files.kept(spark, f"file://{tmp_path}/k", lambda: 1 / 0).count() == 3
    assert files.first_shards(["b", "a"], 1) == ["a"] and files.both_texts(spark.createDataFrame([("a", None), ("b", "c")], "text string, corrected_text string")).count() == 3
    with pytest.raises(PermissionError):
        files.guard(["/x/Test/a"], ["test"])
    with pytest.raises(PermissionError):
        files.allow_split("test")
    assert files.allow_split("test", final=True) == "test"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a  b", "ACCENTED", "2026-01-01 00:00:00"), (2, None, "ACCENTED", "2026-01-01 00:01:00"), (3, "x", "?", "2026-01-01 00:02:00"), (4, "y" * 20000, "ACCENTED", "2026-01-01 00:02:00"), (5, "mã", "NON_ACCENTED", "2026-01-01 00:09:00")]
    df = spark.createDataFrame(rows, "id long, text string, message_mode string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(f"file://{tmp_path}/in")
    src = stream.file_stream(spark, f"file://{tmp_path}/in", df.schema)
    got = stream.drain(stream.checked(src).select("id", "valid"))
    assert {tuple(r) for r in got.collect()} == {(1, True), (5, False)}
    assert {r["reason"] for r in stream.drain(stream.admitted(src)[1].select("id", "reason")).collect()} == {"no text", "unknown mode", "too large"}
    rates = stream.issue_rates(stream.checked(df), "at").collect()
    assert {(r["rule_id"], r["n"]) for r in rates} == {("MULTIPLE_WHITESPACE", 1), ("ACCENT_CHARACTER_IN_NON_ACCENT_MODE", 1)}
    seen = []
    q = stream.with_dimensions(src, lambda: "v1", lambda b, dim: seen.append((b.count(), dim))).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.awaitTermination()
    assert seen == [(5, "v1")]


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_no_plan_holds_all_lanes(spark, model):
    """A driver of little memory must do: what find() and validate() return is no plan of all lanes at once."""
    from sieveloom.operators.engine import validate

    m = spark.createDataFrame([(1, "xin cam on quy khach", "ACCENTED")], "msg_id long, text string, mode string")
    assert joins(lanes.find(m, *model)[0]) <= 10 and joins(validate(m, *model)) <= 16


def test_counts_are_the_same_with_marks(spark, model):
    """The marks hold all n-grams of the model, and what they spare counts nothing."""
    from sieveloom.operators import evidence

    m, _ = model
    grams = (m.u, m.b, m.t)
    held = evidence.marks(*grams)
    assert all(x.filter(~held(F.col("gram"))).count() == 0 for x in grams)
    rows = spark.createDataFrame([(None, "xin", "cảm", "cam", "ơn", "quý"), ("xin", None, "x", "tại", None, None), (None, "hẹn", "gặp", "gập", "lại", "quý")], "prev2 string, prev1 string, cand string, word string, next1 string, next2 string")
    want = evidence.attest(rows, grams)
    assert {r.asDict().__repr__() for r in evidence.attest(rows, grams, held=held).select(want.columns).collect()} == {r.asDict().__repr__() for r in want.collect()}


def test_words_of_a_message(spark):
    """Neighbours and anchors need no window: a word is anchored by one past blanks and at most three other tokens of its sentence."""
    m = spark.createDataFrame([(1, "một hai, (1) ba. bốn 2 - 3 ; năm", "ACCENTED"), (2, "", "ACCENTED"), (3, None, "ACCENTED")], "msg_id long, text string, mode string")
    got = [(r["word"], r["prev2"], r["prev1"], r["next1"], r["next2"], r["anchored"]) for r in lanes.positions(m).orderBy("idx").collect()]
    assert got == [("một", None, None, "hai", "ba", True), ("hai", None, "một", "ba", "bốn", True), ("ba", "một", "hai", "bốn", "năm", False), ("bốn", "hai", "ba", "năm", None, False), ("năm", "ba", "bốn", None, None, False)]
