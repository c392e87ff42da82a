"""Queries of the message rules: tokens, protected spans, findings, conflicts, summaries, with SQL where it can place characters."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.operators import rules
from sieveloom.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Abbreviations that a message may be told of, for brands whose name ends so (a setting of these queries).
ABBREVIATIONS, BRANDS = frozenset({"TC", "TP", "OTP", "STK", "CCCD", "CMND", "KH"}), "_VN"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def messages(spark, d):
    return spread(table(spark, d, "corpus").select("id", "text", "message_mode", "brand", "category", "source_name", "expect", "forbid", "clean", "fully_labeled", "fully_labeled_rule_ids"))


def results(spark, d):
    return rules.checked(messages(spark, d), enabled=F.coalesce(F.col("brand").endswith(BRANDS), F.lit(False)), abbreviations=ABBREVIATIONS)


_SP = r"\t\n\x{0b}\x{0c}\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_CH = "ch AS (SELECT id, text, message_mode, i, substr(text, i, 1) AS c, CASE WHEN i > 1 THEN substr(text, i - 1, 1) END AS p FROM (SELECT id, text, message_mode, unnest(range(1, length(text) + 1)) AS i FROM corpus WHERE text IS NOT NULL))"


@query(rf"""WITH t AS (SELECT regexp_extract_all(text, '[{_SP}]+|[\p{{L}}\p{{M}}]+|[0-9]+|[^{_SP}\p{{L}}\p{{M}}0-9]+') AS ts FROM corpus), u AS (SELECT unnest(ts) AS x FROM t)
SELECT CASE WHEN regexp_full_match(x, '[{_SP}]+') THEN 'WHITESPACE' WHEN regexp_full_match(x, '[\p{{L}}\p{{M}}]+') THEN 'WORD' WHEN regexp_full_match(x, '[0-9]+') THEN 'NUMBER' WHEN regexp_full_match(x, '[.,!?:;\-–—/\\()\[\]{{}}"''`~@#$%^&*+=|<>]+') THEN 'PUNCTUATION' ELSE 'OTHER' END AS type, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM u GROUP BY ALL""")
def tok_types(spark, d):
    t = messages(spark, d).select(F.explode(rules.tokens_udf("text", "message_mode")).alias("t"))
    return t.groupBy("t.type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t.end") - F.col("t.start")).alias("chars"))


@query(rf"""WITH {_CH}, l AS (SELECT id, text, length(regexp_extract(text, '^[{_SP}]+')) AS a, length(regexp_extract(text, '[{_SP}]+$')) AS z FROM corpus WHERE text IS NOT NULL)
SELECT DISTINCT * FROM (SELECT id, 'LEADING_WHITESPACE' AS rule_id, 0 AS start, CAST(a AS INT) AS "end" FROM l WHERE a > 0 UNION ALL SELECT id, 'TRAILING_WHITESPACE', CAST(length(text) - z AS INT), CAST(length(text) AS INT) FROM l WHERE z > 0 AND z < length(text)
UNION ALL SELECT id, 'NON_BREAKING_SPACE', CAST(i - 1 AS INT), CAST(i AS INT) FROM ch WHERE c = chr(160)
UNION ALL SELECT id, 'ZERO_WIDTH_CHARACTER', CAST(i - 1 AS INT), CAST(i AS INT) FROM ch WHERE unicode(c) IN (8203, 8204, 8205, 65279)
UNION ALL SELECT id, 'INVALID_CHARACTER', CAST(i - 1 AS INT), CAST(i AS INT) FROM ch WHERE (unicode(c) < 32 AND unicode(c) NOT IN (9, 10, 13)) OR unicode(c) BETWEEN 127 AND 159)""")
def rule_blanks(spark, d):
    """Findings of the rules that nothing silences, before conflicts."""
    wanted = ["LEADING_WHITESPACE", "TRAILING_WHITESPACE", "NON_BREAKING_SPACE", "ZERO_WIDTH_CHARACTER", "INVALID_CHARACTER"]
    return raw_findings(spark, d).filter(F.col("rule_id").isin(wanted)).select("id", "rule_id", "start", "end")


def raw_findings(spark, d):
    """Findings before conflicts: (id, rule_id, start, end, value, ord)."""
    @F.pandas_udf("array<struct<rule_id:string,start:int,end:int,value:string>>")
    def run(texts: pd.Series, modes: pd.Series, on: pd.Series) -> pd.Series:
        out = []
        for t, m, o in zip(texts, modes, on):
            got = [] if t is None else rules.findings(t, m, ABBREVIATIONS if o else frozenset(), rules.ranges(t), rules.tokens(t))
            out.append([{"rule_id": r, "start": s, "end": e, "value": t[s:e]} for r, s, e, _ in got])
        return pd.Series(out, dtype=object)

    on = F.coalesce(F.col("brand").endswith(BRANDS), F.lit(False))
    return messages(spark, d).select("id", F.posexplode(run("text", "message_mode", on)).alias("ord", "f")).select("id", "f.*", "ord")


@query(rf"""WITH w AS (SELECT id, unnest(regexp_extract_all(nfc_normalize(text), '[\p{{L}}\p{{M}}]+')) AS w FROM corpus)
SELECT id, count(*) AS words FROM w WHERE strip_accents(w) <> w OR regexp_matches(w, '[đĐ]') GROUP BY id""")
def rule_accent_mode(spark, d):
    """Words with accents in each message, if all messages were to be without: no message of that mode has any here."""
    forced = rules.checked(messages(spark, d).withColumn("message_mode", F.lit("NON_ACCENTED")))
    return rules.issues(forced, "id").filter("rule_id = 'ACCENT_CHARACTER_IN_NON_ACCENT_MODE'").groupBy("id").agg(F.count(F.lit(1)).alias("words"))


@query()
def ranges_resolved(spark, d):
    """Protected spans of each message; a sequential fold, tested on cases."""
    return messages(spark, d).select("id", F.explode(rules.ranges_udf("text", "message_mode")).alias("r")).select("id", "r.*")


@query(r"""SELECT id, CAST(len(regexp_extract_all(text, '(?i)[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+')) AS BIGINT) AS spans FROM corpus WHERE regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+')""")
def ranges_email(spark, d):
    return ranges_resolved(spark, d).filter("type = 'EMAIL'").groupBy("id").agg(F.count(F.lit(1)).alias("spans"))


@query()
def issues_final(spark, d):
    """Findings after suppression and conflicts, with severity and value."""
    return rules.issues(results(spark, d), "id").select("id", "rule_id", "severity", "start", "end", "value", F.get("suggestions", F.lit(0)).alias("suggestion"))


@query(rf"""WITH w AS (SELECT id, message_mode, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+'), lambda x: lower(nfc_normalize(x))) AS ws FROM corpus WHERE text IS NOT NULL), s AS (SELECT id, message_mode, len(ws) AS n, len(list_filter(ws, lambda x: replace(strip_accents(x), 'đ', 'd') = x)) AS bare FROM w)
SELECT id, CAST(n AS INT) AS word_count, floor(CASE WHEN n > 0 THEN bare / n ELSE 0 END * 1000 + 0.5) / 1000 AS unaccented_word_ratio, coalesce(message_mode = 'ACCENTED', false) AND n >= 5 AND bare / n >= 0.8 AS unaccented_content FROM s""")
def msg_summary(spark, d):
    return results(spark, d).filter("text is not null").select("id", "summary.word_count", "summary.unaccented_word_ratio", "summary.unaccented_content")


@query()
def message_results(spark, d):
    """One row for each message: validity, findings by severity and linguistic share."""
    r = results(spark, d).filter("text is not null")
    return r.select("id", "valid", "has_errors", F.size("issues").alias("findings"), F.exists("issues", lambda i: i["severity"] == "WARNING").alias("has_warnings"))


@query()
def conflicts_window(spark, d):
    """Raw findings resolved by a window: one for each exact span. Equal to the fold of issues_final, which a test checks."""
    return rules.resolve_conflicts(raw_findings(spark, d), "id", "ord").select("id", "rule_id", "start", "end", "value")


@query("SELECT id, CASE WHEN text IS NULL THEN 'no text' WHEN message_mode IS NULL OR message_mode NOT IN ('ACCENTED', 'NON_ACCENTED') THEN 'unknown mode' ELSE 'too large' END AS reason FROM corpus WHERE text IS NULL OR message_mode IS NULL OR message_mode NOT IN ('ACCENTED', 'NON_ACCENTED') OR octet_length(encode(text)) > 16384")
def quarantine(spark, d):
    """Requests that may not be checked: no text, an unknown mode, or too many bytes."""
    known = F.coalesce(F.col("message_mode").isin("ACCENTED", "NON_ACCENTED"), F.lit(False))
    reason = F.when(F.col("text").isNull(), "no text").when(~known, "unknown mode").when(F.octet_length("text") > 16384, "too large")
    return messages(spark, d).select("id", reason.alias("reason")).filter("reason is not null")


@query(SQL["msg_summary"] + " WHERE s.id IN (SELECT id FROM corpus WHERE message_mode IN ('ACCENTED', 'NON_ACCENTED') AND octet_length(encode(text)) <= 16384)")
def stream_summary(spark, d):
    """Summaries of the corpus read as a stream of files; the same rows as in batch, without refused messages."""
    from sieveloom.streaming import messages as stream

    schema = table(spark, d, "corpus").schema
    got = stream.checked(stream.file_stream(spark, f"{d}/corpus.parq*et", schema).select("id", "text", "message_mode"))
    return stream.drain(got.select("id", "summary.word_count", "summary.unaccented_word_ratio", "summary.unaccented_content"))


# ---- linguistic findings on the labelled messages ----


def _lane_model(spark, d):
    """Model of the corrected training messages, with their proven pairs; held-out splits are never read."""
    from sieveloom.config import Config
    from sieveloom.operators import lanes, ngrams
    from sieveloom.operators.common import materialize, over_all
    from sieveloom.operators.prep import channel, direct
    from sieveloom.plans import prep as pq
    from sieveloom.functions.keys import key

    rows = table(spark, d, "sms_dataset").filter(key("split") == "train").select("row_id", "clean").filter("clean is not null").distinct()
    lines = materialize(ngrams.lines(over_all(rows, "row_id"), "clean", "row_id"), "lines")
    u, b, t = (materialize(ngrams.count_grams(lines, n), "grams") for n in (1, 2, 3))
    lexicon = u.filter("c >= 3").select(F.col("gram").alias("word"), F.col("c").alias("freq"), F.lit("corpus").alias("src"))
    pairs = materialize(channel(pq.pairs(spark, d, "train")), "pairs")
    allowed = table(spark, d, "sms_dataset").select(F.lower("brandname").alias("word")).dropna().distinct()
    # least frequencies for a model of a few hundred thousand words
    cfg = Config().override(plain_form_frequency=50, spelling_frequency=5, boundary_frequency=5, word_boundary="ACTIVE")
    return lanes.Model(u, b, t, lexicon, pairs, allowed, cfg), direct(pairs, u.select(F.col("gram").alias("word")))


def _labelled(spark, d):
    from sieveloom.functions.keys import key

    return table(spark, d, "sms_dataset").filter(key("split").isin("dev", "test")).dropDuplicates(["row_id"])


def _lane_findings(spark, d):
    from sieveloom.operators import lanes

    m, direct = _lane_model(spark, d)
    return lanes.find(_labelled(spark, d).select(F.col("row_id").alias("msg_id"), "text", F.lit("ACCENTED").alias("mode")), m, direct)[0]


@query()
def lane_findings(spark, d):
    """Linguistic findings on the held-out messages; tested on cases."""
    return _lane_findings(spark, d)


@query()
def lane_stages(spark, d):
    """Where the spelling lane leaves each word of the held-out messages, by what the labels say of it: its failures by stage."""
    from sieveloom.operators import lanes

    m, _ = _lane_model(spark, d)
    rows = _labelled(spark, d)
    words = lanes.classified(lanes.positions(rows.select(F.col("row_id").alias("msg_id"), "text", F.lit("ACCENTED").alias("mode"))), m)
    labels = rows.select(F.col("row_id").alias("msg_id"), F.explode("expect").alias("x")).select("msg_id", F.col("x.position_start").alias("start"), "x.rule_id", F.lower("x.suggestion").alias("want")).dropDuplicates(["msg_id", "start"])
    j = lanes.spelling_stages(words, m).join(labels, ["msg_id", "start"], "left")
    right = F.coalesce(F.col("cand") == F.col("want"), F.lit(False))
    return j.groupBy("stage", F.coalesce("rule_id", F.lit("no label")).alias("label")).agg(F.count(F.lit(1)).alias("words"), F.sum(right.cast("long")).alias("best_is_right"))


@query()
def rule_health(spark, d):
    """Findings of each registered rule, before conflicts, and the messages on which it failed."""
    names = spark.createDataFrame([(n,) for n in rules.REGISTRY], "rule_id string")
    found = raw_findings(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    failed = rules.degraded(results(spark, d), "id").select("rule_id", F.col("messages").alias("failed"))
    return F.broadcast(names).join(found, "rule_id", "left").join(failed, "rule_id", "left").fillna(0, ["findings", "failed"])


@query()
def lane_scores(spark, d):
    """Precision, recall and F0.5 of the findings against the labels by error profile, strictly by rule, place and suggestion, and by place alone."""
    from sieveloom.operators.evaluate import f_beta, ratio

    rows = _labelled(spark, d)
    labels = rows.select(F.col("row_id").alias("msg_id"), F.explode("expect").alias("x")).select("msg_id", "x.rule_id", F.col("x.position_start").alias("start"), F.lower("x.suggestion").alias("want")).distinct()
    found = _lane_findings(spark, d).select("msg_id", F.col("rule_id").alias("f_rule"), "start", "suggestion")
    j = labels.join(found, ["msg_id", "start"], "full_outer").join(rows.select(F.col("row_id").alias("msg_id"), "profile"), "msg_id")
    strict = (F.col("rule_id") == F.col("f_rule")) & ((F.col("want") == F.col("suggestion")) | F.col("want").isNull())
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    s = j.groupBy("profile").agg(F.count("rule_id").alias("labels"), F.count("f_rule").alias("findings"), n(strict).alias("strict_hits"), n(F.col("rule_id").isNotNull() & F.col("f_rule").isNotNull()).alias("placed_hits"))
    s = s.withColumn("precision", ratio(F.col("strict_hits"), F.col("findings"))).withColumn("recall", ratio(F.col("strict_hits"), F.col("labels")))
    return s.withColumn("f05", f_beta(F.col("precision"), F.col("recall")))


def _validate(spark, d, rows):
    """Results of rules and lanes together for messages (msg_id, text, mode, brand), by the model of the training messages."""
    from sieveloom.operators.engine import validate

    return validate(rows, *_lane_model(spark, d), F.coalesce(F.col("brand").endswith(BRANDS), F.lit(False)), ABBREVIATIONS)


def joint_results(spark, d):
    """Messages of the corpus with their issues by rules and lanes together."""
    own = messages(spark, d)
    found = _validate(spark, d, own.select(F.col("id").alias("msg_id"), "text", F.col("message_mode").alias("mode"), "brand"))
    return own.join(found.select(F.col("msg_id").alias("id"), "issues"), "id", "left")


def all_messages(spark, d):
    """(message_table, msg_id, text, mode, brand) of corpus, sms_dataset (all splits; its messages are written with accents) and special_case_results, once an id, which holds the table's name."""
    parts = [
        messages(spark, d).select(F.lit("corpus").alias("message_table"), F.col("id").alias("key"), "text", F.col("message_mode").alias("mode"), "brand"),
        table(spark, d, "sms_dataset").select(F.lit("sms_dataset"), F.col("row_id").cast("string"), "text", F.lit("ACCENTED"), "brandname"),
        table(spark, d, "special_case_results").select(F.lit("special_case_results"), "run_id", "result.input_text", "result.message_mode", F.lit(None).cast("string")),
    ]
    return reduce(DataFrame.union, parts).withColumn("msg_id", F.concat_ws(":", "message_table", "key")).drop("key").dropDuplicates(["msg_id"])


@query()
def validated(spark, d):
    """Results of all messages, each in its own mode, by rules and lanes together; the id is that of its table."""
    r = _validate(spark, d, all_messages(spark, d))
    return r.select(F.expr("substring(msg_id, 1, instr(msg_id, ':') - 1)").alias("message_table"), F.expr("substring(msg_id, instr(msg_id, ':') + 1)").alias("msg_id"), "valid", "has_errors", "has_warnings", F.size("issues").alias("findings"), "summary.word_count", "summary.linguistic_issue_count", "summary.unaccented_content")
