"""Queries of text forms, labels against findings, and small model tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions import surfaces as sf
from sieveloom.functions.unicode import accent_key, nfc, words
from sieveloom.operators import lexicon as lx
from sieveloom.operators import matching as mt
from sieveloom.operators import ngrams as ng
from sieveloom.operators import prep
from sieveloom.plans import checks, language
from sieveloom.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SP, _W, _KEY, _MODEL, _FAM, _TOK = checks._SP, language._W, language._KEY, language._MODEL, language._FAM, language._TOK


# ---- text forms ----

_CODES = r"[0-9][0-9\p{L}.-]*[0-9\p{L}]|\p{L}[\p{L}.-]*[0-9](?:[0-9\p{L}.-]*[0-9\p{L}])?"


@query(f"SELECT w AS gram, count(*) AS c FROM (SELECT unnest({_W.format(f'regexp_replace(line, {chr(39)}{_CODES}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}) AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM corpus WHERE text IS NOT NULL) WHERE NOT regexp_matches(line, '^[ \\t]*#')) GROUP BY 1")
def ngram_raw(spark, d):
    """Words of raw lines, without comment lines, codes blanked first."""
    lines = spread(table(spark, d, "corpus").select("text")).filter("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).filter(~F.col("line").rlike(r"^[ \t]*#"))
    return ng.count_grams(lines.select(words(nfc(sf.blank_codes(F.col("line")))).alias("words")), 1)


_STRIPPED = r"regexp_replace({0}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"


@query(f"""WITH v AS (SELECT DISTINCT x.issue_value AS v FROM (SELECT unnest(expect) AS x FROM corpus) WHERE x.issue_value IS NOT NULL UNION SELECT DISTINCT text FROM corpus WHERE text IS NOT NULL)
SELECT v AS surface, {_STRIPPED.format('lower(nfc_normalize(v))')} AS label_surface, {_STRIPPED.format('lower(v)')} AS plain_surface, regexp_replace(lower(nfc_normalize(v)), '^[\\p{{P}}\\p{{Z}}]+|[\\p{{P}}\\p{{Z}}]+$', '', 'g') AS mark_surface FROM v""")
def label_surfaces(spark, d):
    """The forms in which labels and findings are compared, of the corpus's labelled values and texts."""
    c = table(spark, d, "corpus")
    v = c.select(F.explode("expect").alias("x")).select(F.col("x.issue_value").alias("v")).union(c.select("text")).filter("v is not null").distinct()
    return v.select(F.col("v").alias("surface"), sf.label_surface("v").alias("label_surface"), sf.plain_surface(F.col("v")).alias("plain_surface"), sf.mark_surface("v").alias("mark_surface"))


@query(r"""WITH p AS (SELECT regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \n]+', '<url>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '<email>', 'g'), '(\+84|0)[0-9]{9}', '<phone>', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(nfc_normalize(t)), '<[^>]+>|\{\{[^}]+\}\}|[\p{L}\p{N}_]+')) AS token FROM p) GROUP BY token""")
def model_tokens(spark, d):
    """Tokens a model would read, of the documents with addresses and numbers as marks."""
    docs = spread(table(spark, d, "documents").select("text")).filter("text is not null").select(prep.placeholders(F.col("text")).alias("t"))
    return docs.select(F.explode(sf.model_tokens("t")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {language._VOC}, s AS (SELECT word, '<' || word || '>' AS w FROM voc), g AS (SELECT word, list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4))) AS l FROM s)
SELECT word, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:32], '|') AS runs FROM g""")
def char_runs(spark, d):
    return language.vocabulary(spark, d).select("word", F.array_join(sf.first_runs(F.col("word")), "|").alias("runs"))


@query(r"SELECT DISTINCT row_id, p.char_start AS char_start, CASE WHEN regexp_matches(substr(text, p.char_start + 1), '^[\p{L}\p{M}]') THEN regexp_extract(substr(text, 1, p.char_start), '[\p{L}\p{M}]+$') || regexp_extract(substr(text, p.char_start + 1), '^[\p{L}\p{M}]+') END AS word FROM (SELECT row_id, text, unnest(correction_pairs) AS p FROM sms_dataset WHERE text IS NOT NULL)")
def word_at_label(spark, d):
    """The word that covers the place where each correction starts."""
    p = table(spark, d, "sms_dataset").filter("text is not null").select("row_id", "text", F.explode("correction_pairs").alias("p"))
    return p.select("row_id", "p.char_start", sf.word_at(F.col("text"), F.col("p.char_start")).alias("word")).distinct()


@query("SELECT DISTINCT run_id, sha256(CAST(json_object('branch', config.branch, 'config_key', config.config_key, 'label', config.label, 'profile', config.profile) AS VARCHAR)) AS digest FROM special_case_results WHERE config IS NOT NULL")
def config_digest(spark, d):
    """Digest of each run's settings as canonical JSON."""
    c = table(spark, d, "special_case_results").filter("config is not null").select("run_id", "config.*")
    return c.select("run_id", F.sha2(sf.canonical_json("branch", "config_key", "label", "profile"), 256).alias("digest")).distinct()


@query("""WITH e AS (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m, embedding FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT vec_id, CASE WHEN m > 0 THEN m / 127 ELSE 1.0::DOUBLE END AS scale, embedding FROM e)
SELECT vec_id, scale, array_to_string(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE / scale + 0.5) AS INT)), ',') AS vals FROM s""")
def embed_int8(spark, d):
    """Each embedding on its own symmetric scale of eight bits."""
    e = table(spark, d, "embeddings").filter("embedding is not null").select("vec_id", sf.int8(F.col("embedding")).alias("q"))
    return e.select("vec_id", "q.scale", F.array_join(F.col("q.values").cast("array<string>"), ",").alias("vals"))


# ---- rules whose places regular expressions give, before protected spans silence any ----

_AGAIN = r"!{2,}|\?{2,}|,{2,}|;{2,}|:{2,}|\.{4,}"


def _count(c: str, form: str) -> F.Column:
    return F.size(F.regexp_extract_all(c, F.lit(form), F.lit(0))).cast("long")


@query(f"SELECT id, len(regexp_extract_all(text, '{_AGAIN}')) AS runs, list_max(list_transform(regexp_extract_all(text, '{_AGAIN}'), lambda x: length(x))) AS longest FROM corpus WHERE regexp_matches(text, '{_AGAIN}')")
def rule_repeated_punct(spark, d):
    """Runs of a repeated mark, and the longest of them; the rule's own form gives the same places (a test compares them)."""
    c = table(spark, d, "corpus").filter(F.col("text").rlike(_AGAIN)).select("id", F.regexp_extract_all("text", F.lit(_AGAIN), F.lit(0)).alias("r"))
    return c.select("id", F.size("r").cast("long").alias("runs"), F.array_max(F.transform("r", lambda x: F.length(x))).cast("long").alias("longest"))


@query(rf"SELECT id, len(regexp_extract_all(text, '[{_SP}]+[.,!?:;]')) - CASE WHEN regexp_matches(text, '^[{_SP}]+[.,!?:;]') THEN 1 ELSE 0 END AS before_mark, len(regexp_extract_all(text, ' {{2,}}')) AS runs FROM corpus WHERE text IS NOT NULL")
def rule_spacing(spark, d):
    """Blanks before a mark, but not at the start, and runs of spaces."""
    sp = checks._SP
    c = table(spark, d, "corpus").filter("text is not null")
    return c.select("id", (_count("text", f"[{sp}]+[.,!?:;]") - F.when(F.col("text").rlike(f"^[{sp}]+[.,!?:;]"), 1).otherwise(0)).alias("before_mark"), _count("text", " {2,}").alias("runs"))


@query(r"""SELECT id, len(regexp_extract_all(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]')) AS hidden, len(regexp_extract_all(text, '\x{a0}')) AS no_break, len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]')) AS control FROM corpus WHERE text IS NOT NULL""")
def rule_unicode(spark, d):
    """Hidden, no-break and control characters of each message."""
    c = table(spark, d, "corpus").filter("text is not null")
    return c.select("id", _count("text", r"[\x{200b}\x{200c}\x{200d}\x{feff}]").alias("hidden"), _count("text", r"\x{a0}").alias("no_break"), _count("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]").alias("control"))


_ABBR = ", ".join(f"'{a}'" for a in sorted(checks.ABBREVIATIONS))


@query(rf"SELECT id, w AS abbreviation, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+')) AS w FROM corpus) WHERE w IN ({_ABBR}) GROUP BY ALL")
def rule_abbrev(spark, d):
    """Abbreviations as written, joined to the table of those that are told of."""
    known = spark.createDataFrame([(a,) for a in sorted(checks.ABBREVIATIONS)], "abbreviation string")
    w = table(spark, d, "corpus").select("id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("abbreviation"))
    return w.join(F.broadcast(known), "abbreviation").groupBy("id", "abbreviation").agg(F.count(F.lit(1)).alias("n"))


_RAW = {
    "PLACEHOLDER": rf"\{{\{{[{_SP}]*[\w.]+[{_SP}]*\}}\}}|\$\{{[^}}{_SP}]+\}}|\{{[\w.]+\}}", "PRODUCT_CODE": r"\b[a-z]{1,6}-\d{2,}[a-z0-9]*\b|\b[a-z]{2,6}\d{2,}[a-z0-9]*\b", "PHONE": rf"(?:(?:\+|00)?84|0)(?:[{_SP}.-]?\d){{8,10}}",
    "DATE": r"\b(?:0?[1-9]|[12]\d|3[01])[/.-](?:0?[1-9]|1[0-2])(?:[/.-](?:\d{4}|\d{2}))?\b", "TIME": r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
}


@query("SELECT kind, id, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, id, len(regexp_extract_all(text, '(?i){p}')) AS n FROM corpus" for k, p in _RAW.items()) + ") WHERE n > 0")
def ranges_raw(spark, d):
    """Forms of protected spans in each message by kind, before overlaps are resolved; by the same forms as the rules, in the JVM."""
    c = table(spark, d, "corpus").filter("text is not null")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _count("text", f"(?i){p}").alias("n")) for k, p in _RAW.items()])
    return c.select("id", F.explode(kinds).alias("x")).select("x.kind", "id", "x.n").filter("n > 0")


# ---- labels and findings ----


def labels_and_findings(spark, d) -> DataFrame:
    """(row_id, profile, labels, found): the labels of each message, and findings to score as a stand-in finder would give them: every correction, but each third message with its places one character too
    wide, each fifth with no better suggestion than the word itself, and each seventh with every finding twice."""
    rows = table(spark, d, "sms_dataset").groupBy("row_id").agg(F.min(F.struct("ingested_at", "profile", "correction_pairs", "expect")).alias("r")).select("row_id", "r.*")
    shape = lambda x, v, s, a, b: F.struct(sf.plain_surface(x[v]).alias("value"), sf.plain_surface(x[s]).alias("suggestion"), x[a].alias("start"), x[b].alias("end"))
    labels = F.array_sort(F.transform("expect", lambda x: shape(x, "issue_value", "suggestion", "position_start", "position_end")), lambda a, b: F.coalesce(a["start"], F.lit(-1)) - F.coalesce(b["start"], F.lit(-1)))
    wide, poor, twice = (F.when(F.col("row_id") % k == 0, 1).otherwise(0) for k in (3, 5, 7))
    found = F.transform("correction_pairs", lambda x: F.struct(
        sf.plain_surface(x["error"]).alias("value"), F.when(poor == 1, sf.plain_surface(x["error"])).otherwise(sf.plain_surface(x["correction"])).alias("suggestion"), (x["char_start"] - wide).alias("start"), (x["char_end"] + wide).alias("end"),
    ))
    return rows.select("row_id", "profile", labels.alias("labels"), F.when(twice == 1, F.concat(found, found)).otherwise(found).alias("found")).filter("labels is not null and found is not null")


_S = _STRIPPED.format
_LF = f"""r AS (SELECT row_id, profile, expect, correction_pairs FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) AS k FROM sms_dataset) WHERE k = 1 AND expect IS NOT NULL AND correction_pairs IS NOT NULL),
le AS (SELECT row_id, list({{'value': {_S('lower(x.issue_value)')}, 'suggestion': {_S('lower(x.suggestion)')}, 'start': x.position_start, 'end': x.position_end}} ORDER BY coalesce(x.position_start, -1)) AS labels FROM (SELECT row_id, unnest(expect) AS x FROM r) GROUP BY row_id),
fe AS (SELECT row_id, list({{'value': {_S('lower(x.error)')}, 'suggestion': CASE WHEN row_id % 5 = 0 THEN {_S('lower(x.error)')} ELSE {_S('lower(x.correction)')} END, 'start': x.char_start - (row_id % 3 = 0)::INT, 'end': x.char_end + (row_id % 3 = 0)::INT}} ORDER BY i) AS found FROM (SELECT row_id, unnest(correction_pairs) AS x, generate_subscripts(correction_pairs, 1) AS i FROM r) GROUP BY row_id),
lf AS (SELECT r.row_id, r.profile, coalesce(labels, []) AS labels, CASE WHEN r.row_id % 7 = 0 THEN list_concat(coalesce(found, []), coalesce(found, [])) ELSE coalesce(found, []) END AS found FROM r LEFT JOIN le USING (row_id) LEFT JOIN fe USING (row_id))"""


def _greedy(takers: str, offers: str, fits: str, cost: str = "0") -> str:
    """SQL that walks the takers of each message; {{t}} and {{o}} stand for a taker and an offer."""
    t, o = f"{takers}[k + 1]", f"{offers}[i]"
    cond, pen = (x.replace("{t}", t).replace("{o}", o) for x in (fits, cost))
    pick = f"list_min(list_transform(list_filter(range(1, len({offers}) + 1), lambda i: NOT list_contains(used, i) AND coalesce({cond}, false)), lambda i: ({pen}) * 1000000 + i)) % 1000000"
    return f"RECURSIVE {_LF}, st AS (SELECT row_id, profile, labels, found, 0 AS k, []::BIGINT[] AS used FROM lf UNION ALL SELECT row_id, profile, labels, found, k + 1, list_append(used, coalesce({pick}, -1)) FROM st WHERE k < len({takers})), fin AS (SELECT *, len(list_filter(used, lambda i: i > 0)) AS hit FROM st WHERE k = len({takers}))"


_SAME, _OVER = '({t}.start = {o}.start AND {t}."end" = {o}."end")', '({t}.start < {o}."end" AND {o}.start < {t}."end")'
_SCORES = "SELECT profile, CAST(sum(len(labels)) AS BIGINT) AS labels, CAST(sum(len(found)) AS BIGINT) AS findings, CAST(sum(hit) AS BIGINT) AS hits"
_FIXED = ', CAST(sum(len(list_filter(range(1, len(labels) + 1), lambda j: used[j] > 0 AND labels[j].suggestion = found[used[j]].suggestion))) AS BIGINT) AS corrected'


def _scored(rows: DataFrame, hits, corrected=None) -> DataFrame:
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    return rows.groupBy("profile").agg(total(F.size("labels"), "labels"), total(F.size("found"), "findings"), total(hits, "hits"), *([total(corrected, "corrected")] if corrected is not None else []))


@query("WITH " + _greedy("found", "labels", f"{{t}}.value = {{o}}.value AND ({{o}}.start IS NULL OR {{o}}.\"end\" IS NULL OR {_SAME}) AND ({{o}}.suggestion IS NULL OR {{t}}.suggestion = {{o}}.suggestion)") + f" {_SCORES} FROM fin GROUP BY profile")
def match_exact(spark, d):
    """Findings in turn take the first free label of their value, place and suggestion."""
    rows = labels_and_findings(spark, d).withColumn("at", mt.one_to_one(F.col("found"), F.col("labels"), mt.exact))
    return _scored(rows, mt.hits(F.col("at")))


@query("WITH " + _greedy("labels", "found", f"{_OVER} AND ({{t}}.value = {{o}}.value OR {_SAME})", f"(NOT {_SAME})::INT") + f" {_SCORES}{_FIXED} FROM fin GROUP BY profile")
def match_overlap(spark, d):
    """Labels in turn take a free finding that overlaps them with their value or place, one of exactly their place first; detected and corrected apart."""
    rows = labels_and_findings(spark, d).withColumn("at", mt.one_to_one(F.col("labels"), F.col("found"), mt.touching, mt.inexact))
    return _scored(rows, mt.hits(F.col("at")), mt.corrected(F.col("labels"), F.col("found"), F.col("at")))


@query("WITH " + _greedy("labels", "found", f"{{t}}.value = {{o}}.value AND ({_SAME} OR {_OVER})", f"2 * (NOT {_SAME})::INT + (NOT coalesce({{t}}.suggestion = {{o}}.suggestion, false))::INT") + f" {_SCORES}{_FIXED} FROM fin GROUP BY profile")
def match_preferred(spark, d):
    """Labels in turn take the free finding of their value that fits best: exact place, then suggestion, then order."""
    rows = labels_and_findings(spark, d).withColumn("at", mt.one_to_one(F.col("labels"), F.col("found"), mt.same_value, mt.inexact_or_wrong))
    return _scored(rows, mt.hits(F.col("at")), mt.corrected(F.col("labels"), F.col("found"), F.col("at")))


@query(f"""WITH {_LF}, m AS (SELECT profile, labels, found, len(list_filter(range(1, len(labels) + 1), lambda j: len(list_filter(range(1, len(found) + 1), lambda i: coalesce((labels[j].start IS NULL OR labels[j]."end" IS NULL OR (found[i].start >= labels[j].start AND found[i]."end" <= labels[j]."end")) AND labels[j].value = found[i].value AND labels[j].suggestion = found[i].suggestion, false))) > 0)) AS hit FROM lf) {_SCORES} FROM m GROUP BY profile""")
def match_semantic(spark, d):
    """Labels for which some finding within their place has their value and suggestion, however often it is used."""
    rows = labels_and_findings(spark, d)
    return _scored(rows, F.size(F.filter("labels", lambda a: F.exists("found", lambda b: F.coalesce(mt.means_the_same(a, b), F.lit(False))))))


@query("""WITH x AS (SELECT row_id, text, x FROM (SELECT DISTINCT row_id, text, expect FROM sms_dataset WHERE text IS NOT NULL), (SELECT unnest(expect) AS x)), y AS (SELECT CASE WHEN x.rule_id IS NULL THEN 'no rule' WHEN x.position_start IS NULL OR x.position_end IS NULL THEN 'no place' WHEN x.position_start < 0 OR x.position_end > length(text) OR x.position_end <= x.position_start THEN 'bad place'
WHEN substr(text, x.position_start + 1, x.position_end - x.position_start) <> x.issue_value THEN 'other text' ELSE 'well formed' END AS verdict FROM x) SELECT verdict, count(*) AS n FROM y GROUP BY verdict""")
def label_shapes(spark, d):
    """What is wrong with a label's form: rule, place, or the text that stands there."""
    x = table(spark, d, "sms_dataset").filter("text is not null").select("row_id", "text", "expect").distinct().select("text", F.explode("expect").alias("x")).select("text", "x.*")
    a, b = F.col("position_start"), F.col("position_end")
    verdict = (
        F.when(F.col("rule_id").isNull(), "no rule").when(a.isNull() | b.isNull(), "no place").when((a < 0) | (b > F.length("text")) | (b <= a), "bad place")
        .when(F.substring(F.col("text"), a + 1, b - a) != F.col("issue_value"), "other text").otherwise("well formed")
    )
    return x.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# ---- model tables ----


@query(f"WITH {language._VOC}, v AS (SELECT unnest({language._DEL}) AS variant, word FROM voc) SELECT count(DISTINCT word) AS keys, (SELECT count(DISTINCT variant) FROM v) AS variants, count(*) AS edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM v GROUP BY variant)) AS largest FROM v")
def index_stats(spark, d):
    return lx.index_stats(lx.delete_index(language.vocabulary(spark, d)))


@query(f"""WITH {_FAM}, k AS (SELECT akey, gram, c, gram = akey AS bare FROM fam QUALIFY gram = akey OR row_number() OVER (PARTITION BY akey, gram = akey ORDER BY c DESC, gram) <= 3)
SELECT akey, gram, c, CAST(row_number() OVER (PARTITION BY akey ORDER BY bare, c DESC, gram) AS INT) AS pos FROM k QUALIFY pos <= 4""")
def fam_retained(spark, d):
    """Up to four spellings of each key, of which the one without accents is always considered."""
    return lx.retained(language.fams(spark, d), 4)


@query(f"""WITH {language._POOL}, fk AS (SELECT gram, {_KEY.format('gram')} AS akey FROM u), sib AS (SELECT unk.word AS input, gram AS word FROM unk JOIN fk ON fk.akey = {_KEY.format('unk.word')} AND gram <> unk.word)
SELECT input, word, min(source) AS source FROM (SELECT input, word, 0 AS source FROM sib UNION ALL SELECT input, word, 1 FROM pool) GROUP BY ALL""")
def pool_union(spark, d):
    """Candidates of unknown words: siblings of the same key first, then near words; each once."""
    unknown = language.unknown_words(spark, d)
    siblings = unknown.withColumn("akey", accent_key("word")).join(language.fams(spark, d).select("akey", "gram"), "akey").filter("gram <> word").select(F.col("word").alias("input"), F.col("gram").alias("word"))
    return lx.first_of(siblings, lx.pool(unknown, language.vocabulary(spark, d)))


@query(f"WITH {_MODEL} SELECT gram AS word, CAST(least(greatest(c * 500, 1000), 990000) AS BIGINT) AS freq FROM u WHERE c >= 2")
def lexicon_scaled(spark, d):
    return language.vocabulary(spark, d).select("word", lx.scaled(F.col("freq")).cast("long").alias("freq"))


_OVERLAY = f"{language._CLEAN}, {language._DOCS}, wl AS (SELECT words, 1 AS w FROM docl WHERE len(words) > 0 UNION ALL SELECT words, 3 FROM clnl WHERE len(words) > 0)"


@query(f"WITH {_OVERLAY} SELECT * FROM ({language._grams('wl', 3, 'w')}) WHERE c >= 3")
def ngram_overlay(spark, d):
    """Trigrams of the documents counted again with the corrected messages over them."""
    docs, clean = language.document_lines(spark, d), language.clean_lines(spark, d)
    return ng.overlay(ng.count_grams(docs, 1), docs, clean, 3, 3)[0]


@query(f"WITH {_OVERLAY} SELECT (SELECT count(DISTINCT w) FROM (SELECT unnest(words) AS w FROM docl)) AS vocabulary, CAST((SELECT sum(len(words)) FROM docl) + (SELECT 2 * sum(len(words)) FROM clnl) AS BIGINT) AS tokens")
def overlay_header(spark, d):
    docs, clean = language.document_lines(spark, d), language.clean_lines(spark, d)
    return ng.overlay(ng.count_grams(docs, 1), docs, clean, 3, 3)[1]


@query(f"""WITH {_MODEL}, m AS (SELECT sum(c) AS total, count(*) AS voc FROM u), s AS (SELECT gram, c, string_split(gram, ' ') AS w FROM t WHERE c >= 2),
j AS (SELECT s.gram, s.c, coalesce(b.c, 0) AS c2, total, (x.c + 0.5::DOUBLE) / (total + 0.5::DOUBLE * voc) AS pa, (y.c + 0.5::DOUBLE) / (total + 0.5::DOUBLE * voc) AS pb, (z.c + 0.5::DOUBLE) / (total + 0.5::DOUBLE * voc) AS pc FROM s CROSS JOIN m LEFT JOIN b ON b.gram = w[1] || ' ' || w[2] JOIN u x ON x.gram = w[1] JOIN u y ON y.gram = w[2] JOIN u z ON z.gram = w[3])
SELECT gram, floor(ln(greatest((c2 + 20 * pa * pb) / (total + 20), 2.220446049250313e-16)) * 1e6 + 0.5) / 1e6 AS pair, floor(ln(greatest((c + 10 * pa * pb * pc) / (total + 10), 2.220446049250313e-16)) * 1e6 + 0.5) / 1e6 AS triple FROM j""")
def lm_joint(spark, d):
    """Log of the smoothed joint probabilities of each trigram and of its first pair."""
    u, b, t = language.counted(spark, d)
    meta = u.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("voc"))
    rows = ng.split_gram(t.filter("c >= 2"), 3).withColumn("two", F.concat_ws(" ", "w1", "w2")).join(F.broadcast(meta)).join(b.select(F.col("gram").alias("two"), F.col("c").alias("c2")), "two", "left").fillna(0, ["c2"])
    for i in (1, 2, 3):
        rows = rows.join(u.select(F.col("gram").alias(f"w{i}"), F.col("c").alias(f"u{i}")), f"w{i}")
    p = [ng.p_uni(F.col(f"u{i}"), F.col("total"), F.col("voc")) for i in (1, 2, 3)]
    total = F.col("total")
    return rows.select("gram", language.r6(ng.log_floor(ng.joint_pair(F.col("c2"), p[0], p[1], total))).alias("pair"), language.r6(ng.log_floor(ng.joint_triple(F.col("c"), *p, total))).alias("triple"))
