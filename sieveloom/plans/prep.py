"""Queries of data preparation and evaluation, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.functions.unicode import accent_key, fold_key, nfc, without_accents, words
from sieveloom.operators import calibration, components, evaluate, prep
from sieveloom.operators.common import lookup_join, materialize
from sieveloom.plans import checks, language
from sieveloom.functions.keys import key
from sieveloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_B = prep.BLANK


def _collapse(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_B}+', ' ', 'g'), '^ | $', '', 'g')"


def _trim(c: str) -> str:
    return f"lower(regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g'))"


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_exact(spark, d):
    """One document for each text, with its number of copies; grouped by digest and text."""
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query(f"WITH l AS (SELECT doc_id, {_collapse('lower(nfc_normalize(line))')} AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) SELECT sha256(k) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM l WHERE k <> '' GROUP BY k")
def dedupe_lines(spark, d):
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    keyed = lines.select("doc_id", prep.collapse(fold_key("line")).alias("k")).filter("k <> ''")
    return keyed.groupBy(F.sha2("k", 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def _template(c: str) -> str:
    coded = rf"regexp_replace({c}, '(^|[^A-Za-z0-9])[A-Z0-9]*[A-Z][0-9A-Z]{{5,}}', '\1<var>', 'g')"
    linked = rf"regexp_replace(lower({_collapse(coded)}), '(https?://|www\.)[^ ]+|[a-z0-9-]+\.example[^ ]*', '<var>', 'g')"
    return f"regexp_replace({linked}, '[0-9]+([.,:/-][0-9]+)*', '<var>', 'g')"


@query(f"SELECT template, count(*) AS n, min(id) AS first_id FROM (SELECT id, {_template('text')} AS template FROM corpus WHERE text IS NOT NULL) GROUP BY template")
def dedupe_template(spark, d):
    t = table(spark, d, "corpus").filter("text is not null").select("id", prep.template(F.col("text")).alias("template"))
    return t.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \n]+', '<url>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '<email>', 'g'), '(\+84|0)[0-9]{9}', '<phone>', 'g') AS text FROM documents WHERE text IS NOT NULL")
def placeholderize(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", prep.placeholders(F.col("text")).alias("text"))


@query("SELECT doc_id, " + _collapse("replace(replace(replace(replace(replace(regexp_replace('<p>' || text || '&nbsp;</p>', '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')") + " AS text FROM documents WHERE text IS NOT NULL")
def clean_pages(spark, d):
    """Markup cleaning, over the documents wrapped as a page."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", prep.clean_markup(F.concat(F.lit("<p>"), "text", F.lit("&nbsp;</p>"))).alias("text"))


_SENT = rf"sent AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?…]){_B}+', '\1' || chr(30), 'g'), chr(30))) AS s FROM documents WHERE text IS NOT NULL)"


@query(rf"""WITH {_SENT}, w AS (SELECT doc_id, s, regexp_extract_all(s, '[^ \n\t]+') AS ts FROM sent) SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM w
WHERE len(ts) >= 3 AND len(list_filter(ts, lambda x: regexp_full_match(x, '[\x00-\x7F]+'))) * 2 <= len(ts) GROUP BY doc_id""")
def sentences(spark, d):
    """Sentences of three or more tokens of which at most half are ASCII."""
    s = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(prep.sentences(F.col("text"))).alias("s"))
    t = s.withColumn("ts", F.regexp_extract_all("s", F.lit(r"[^ \n\t]+"), F.lit(0)))
    plain = F.size(F.filter("ts", lambda x: x.rlike(r"^[\x00-\x7F]+$")))
    return t.filter((F.size("ts") >= 3) & (plain * 2 <= F.size("ts"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("s")).cast("long").alias("chars"))


@query(f"WITH h AS (SELECT DISTINCT {_collapse('lower(nfc_normalize(text))')} AS k FROM corpus_2 WHERE text IS NOT NULL), l AS (SELECT doc_id, {_collapse('lower(nfc_normalize(line))')} AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) SELECT doc_id, count(*) AS lines FROM l WHERE k <> '' AND k NOT IN (SELECT k FROM h) GROUP BY doc_id")
def holdout_anti(spark, d):
    """Lines of each document that aren't held-out texts."""
    held = table(spark, d, "corpus_2").filter("text is not null").select(prep.collapse(fold_key("text")).alias("k")).distinct()
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", prep.collapse(fold_key("line")).alias("k")).filter("k <> ''")
    return lines.join(held, "k", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


_HEX = "CAST('0x' || substr(sha256({0}), 1, {1}) AS BIGINT)"


@query("SELECT DISTINCT row_id, CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'dev' ELSE 'test' END AS split FROM (SELECT row_id, " + _HEX.format("'split:' || " + _trim("group_id"), 8) + " % 100 AS p FROM sms_dataset WHERE group_id IS NOT NULL)")
def split_hash(spark, d):
    rows = table(spark, d, "sms_dataset").select("row_id", key("group_id").alias("g")).filter("g is not null")
    return rows.select("row_id", prep.split_of(prep.hash_percent(F.col("g"), "split:"), 70, 15).alias("split")).distinct()


@query("SELECT id, CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'dev' ELSE 'test' END AS split, CAST(b % 5 AS INT) AS fold FROM (SELECT id, b % 100 AS p, b FROM (SELECT id, " + _HEX.format("id", 2) + " AS b FROM corpus))")
def split_salted(spark, d):
    """The uneven byte split, and five folds."""
    b = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int")
    return table(spark, d, "corpus").select("id", prep.split_of(prep.byte_percent(F.col("id")), 80, 10).alias("split"), (b % 5).alias("fold"))


@query("""WITH g AS (SELECT """ + _trim("group_id") + """ AS g, count(*) AS s FROM sms_dataset WHERE group_id IS NOT NULL GROUP BY 1), r AS (SELECT g, sum(s) OVER (ORDER BY sha256(g)) - s / 2 AS mid, sum(s) OVER () AS total FROM g WHERE g <> '')
SELECT g, CASE WHEN mid < total * 0.8::DOUBLE THEN 'train' WHEN mid < total * 0.9::DOUBLE THEN 'dev' ELSE 'test' END AS split FROM r""")
def grouped_split(spark, d):
    g = table(spark, d, "sms_dataset").select(key("group_id").alias("g")).filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("s"))
    return prep.prefix_split(g, "g", "s", ["train", "dev", "test"], [0.8, 0.1])


def components_sql(edges: str) -> str:
    """SQL for the smallest row id that each row is connected with. edges: SELECT r, k of row ids and keys, or of two keys as (null, k, k2)."""
    return f"""RECURSIVE ed AS (SELECT DISTINCT CASE WHEN r IS NULL THEN k2 ELSE 'r:' || r END AS a, k AS b, r FROM ({edges}) WHERE k IS NOT NULL), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
cc(node, comp) USING KEY (node) AS (SELECT node, min(comp) FROM (SELECT a AS node, coalesce(r, 9000000000000000000) AS comp FROM ed UNION ALL SELECT b, 9000000000000000000 FROM ed) GROUP BY node
UNION SELECT bo.b, min(x.comp) FROM cc x JOIN bo ON x.node = bo.a JOIN recurring.cc u ON u.node = bo.b WHERE x.comp < u.comp GROUP BY bo.b),
rel AS (SELECT CAST(substr(node, 3) AS BIGINT) AS id, comp AS anchor FROM cc WHERE node LIKE 'r:%')"""


@query("WITH " + components_sql("SELECT row_index AS r, 't:' || text_fingerprint AS k, NULL AS k2 FROM split_index UNION ALL SELECT row_index, 'c:' || corrected_fingerprint, NULL FROM split_index UNION ALL SELECT row_index, 'm:' || template_fingerprint, NULL FROM split_index") + " SELECT id, anchor FROM rel")
def leak_components(spark, d):
    """Rows of the split index that share a fingerprint, by the smallest row they are connected with."""
    rows = table(spark, d, "split_index").select("row_index", "text_fingerprint", "corrected_fingerprint", "template_fingerprint")
    return components.related(rows, "row_index", ["text_fingerprint", "corrected_fingerprint", "template_fingerprint"])


_FOUR = " UNION ALL ".join(f"SELECT row_index AS r, '{c[0]}:' || {e} AS k, NULL AS k2 FROM split_index" for c, e in (("text", "text_fingerprint"), ("corrected", "corrected_fingerprint"), ("model", "template_fingerprint"), ("group", "nullif(" + _trim("group_id") + ", '')")))


@query("WITH " + components_sql(_FOUR) + """, al AS (SELECT DISTINCT i.row_index AS id, coalesce(anchor, i.row_index) AS g FROM split_index i LEFT JOIN rel ON rel.id = i.row_index), c AS (SELECT CAST(g AS VARCHAR) AS g, count(*) AS s FROM al GROUP BY g),
r AS (SELECT g, sum(s) OVER (ORDER BY sha256(g)) - s / 2 AS mid, sum(s) OVER () AS total FROM c) SELECT al.id AS row_index, CASE WHEN mid < total * 0.8::DOUBLE THEN 'train' WHEN mid < total * 0.9::DOUBLE THEN 'dev' ELSE 'test' END AS split FROM al JOIN r ON r.g = CAST(al.g AS VARCHAR)""")
def component_split(spark, d):
    """Rows that share any of four keys (three fingerprints and the group) go to one split, components in the order of their digests."""
    rows = table(spark, d, "split_index").select("row_index", "text_fingerprint", "corrected_fingerprint", "template_fingerprint", key("group_id").alias("g"))
    related = components.related(rows, "row_index", ["text_fingerprint", "corrected_fingerprint", "template_fingerprint", "g"])
    each = materialize(rows.select("row_index").distinct().join(related.withColumnRenamed("id", "row_index"), "row_index", "left").select("row_index", F.coalesce("anchor", "row_index").cast("string").alias("g")), "rows")
    sizes = materialize(each.groupBy("g").agg(F.count(F.lit(1)).alias("s")), "sizes")
    where = materialize(prep.prefix_split(sizes, "g", "s", ["train", "dev", "test"], [0.8, 0.1]).join(sizes, "g"), "splits")
    return lookup_join(each, where, "g", "s").select("row_index", "split")


@query("""WITH s AS (SELECT DISTINCT row_index, """ + _trim("split") + """ AS split, template_fingerprint AS f FROM split_index WHERE split IS NOT NULL AND template_fingerprint IS NOT NULL)
SELECT f AS fingerprint, count(DISTINCT split) AS splits, count(*) AS n FROM s WHERE split <> '' GROUP BY f HAVING count(DISTINCT split) > 1""")
def leak_audit(spark, d):
    s = table(spark, d, "split_index").select("row_index", key("split").alias("split"), F.col("template_fingerprint").alias("f")).dropna().distinct()
    return s.groupBy(F.col("f").alias("fingerprint")).agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")


@query("""WITH s AS (SELECT DISTINCT row_index, """ + _trim("split") + """ AS split, text_fingerprint AS f FROM split_index WHERE split IS NOT NULL AND text_fingerprint IS NOT NULL), x AS (SELECT DISTINCT split, f FROM s WHERE split <> '')
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM x a JOIN x b ON a.f = b.f AND a.split < b.split GROUP BY ALL""")
def split_intersections(spark, d):
    """Fingerprints that two splits share; one flag row a fingerprint, no join of rows."""
    s = table(spark, d, "split_index").select(key("split").alias("split"), F.col("text_fingerprint").alias("f")).dropna()
    in_ = s.groupBy("f").agg(F.sort_array(F.collect_set("split")).alias("ss")).filter("size(ss) > 1")
    pairs = in_.select(F.posexplode("ss").alias("i", "split_a"), "ss").select("split_a", F.explode(F.filter("ss", lambda x: x > F.col("split_a"))).alias("split_b"))
    return pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


_STRIP = "replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D')"


@query("SELECT DISTINCT row_id, " + _STRIP.format("nfc_normalize(clean)") + r" AS stripped, len(list_filter(regexp_extract_all(nfc_normalize(clean), '[\p{L}\p{M}]+'), lambda w: " + _STRIP.format("w") + " <> w)) AS changed FROM sms_dataset WHERE clean IS NOT NULL")
def synth_strip(spark, d):
    """Loss of all accents, with the number of words it changes."""
    rows = table(spark, d, "sms_dataset").filter("clean is not null").select("row_id", nfc("clean").alias("c")).distinct().withColumn("stripped", without_accents("c"))
    # NFC letters strip to one letter each, so words keep their places
    both = F.arrays_zip(F.regexp_extract_all("c", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)).alias("a"), F.regexp_extract_all("stripped", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)).alias("b"))
    return rows.select("row_id", "stripped", F.size(F.filter(both, lambda x: x["a"] != x["b"])).cast("long").alias("changed"))


@query("WITH w AS (SELECT DISTINCT row_id, list_filter(" + language._W.format("clean") + ", lambda w: " + language._KEY.format("w") + " <> w) AS ws FROM sms_dataset WHERE clean IS NOT NULL) SELECT row_id, ws[1 + " + _HEX.format("CAST(row_id AS VARCHAR)", 8) + " % len(ws)] AS word FROM w WHERE len(ws) > 0")
def synth_single(spark, d):
    """The one word of each record that loses its accents, chosen by digest."""
    rows = table(spark, d, "sms_dataset").filter("clean is not null").select("row_id", "clean").distinct()
    w = rows.select("row_id", F.filter(F.arrays_zip(words(nfc("clean")).alias("w"), words(accent_key("clean")).alias("k")), lambda x: x["w"] != x["k"]).alias("ws")).filter("size(ws) > 0")
    at = F.conv(F.substring(F.sha2(F.col("row_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % F.size("ws")
    return w.select("row_id", F.element_at("ws", (at + 1).cast("int"))["w"].alias("word"))


def pairs(spark, d, *splits: str) -> DataFrame:
    """(row_id, split, profile, text, error, correction, char_start) of the corrections of sms_dataset."""
    rows = table(spark, d, "sms_dataset").select("row_id", key("split").alias("split"), "profile", "text", "correction_pairs").dropDuplicates(["row_id"])
    out = rows.select("row_id", "split", "profile", "text", F.explode("correction_pairs").alias("p")).select("row_id", "split", "profile", "text", nfc("p.error").alias("error"), nfc("p.correction").alias("correction"), F.col("p.char_start").alias("char_start"))
    return out.filter(F.col("split").isin(*splits)) if splits else out


_PAIRS = "pr AS (SELECT row_id, " + _trim("split") + " AS split, profile, text, lower(nfc_normalize(p.error)) AS source, lower(nfc_normalize(p.correction)) AS target, p.char_start AS char_start FROM (SELECT row_id, split, profile, text, unnest(correction_pairs) AS p FROM (SELECT DISTINCT ON (row_id) * FROM sms_dataset)))"
_CHAN = _PAIRS + ", ch AS (SELECT source, target, count(*) AS n FROM pr WHERE split = 'train' AND source <> target GROUP BY ALL)"


def channel(spark, d) -> DataFrame:
    return prep.channel(pairs(spark, d, "train"))


@query(f"WITH {_CHAN} SELECT * FROM ch")
def channel_pairs(spark, d):
    return channel(spark, d)


@query(f"WITH {_CHAN}, {language._MODEL} SELECT source, max(target) AS target, max(n) AS n FROM ch GROUP BY source HAVING count(*) = 1 AND source NOT IN (SELECT gram FROM u)")
def channel_direct(spark, d):
    return prep.direct(channel(spark, d), language.model(spark, d)[0].select(F.col("gram").alias("word")))


@query(f"WITH {_CHAN}, o AS (SELECT split, source, target, EXISTS (SELECT 1 FROM ch WHERE ch.source = pr.source AND ch.target = pr.target) AS seen FROM pr WHERE split IN ('dev', 'test') AND source <> target) SELECT split, count(*) AS labels, CAST(sum(seen::INT) AS BIGINT) AS seen_labels, count(DISTINCT source || chr(9) || target) AS pairs, count(DISTINCT CASE WHEN seen THEN source || chr(9) || target END) AS seen_pairs FROM o GROUP BY split")
def pair_overlap(spark, d):
    held = pairs(spark, d, "dev", "test").select("split", F.lower("error").alias("source"), F.lower("correction").alias("target")).filter("source <> target")
    j = held.join(channel(spark, d), ["source", "target"], "left").withColumn("pair", F.concat_ws("\t", "source", "target"))
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("labels"), F.count("n").alias("seen_labels"), F.count_distinct("pair").alias("pairs"), F.count_distinct(F.when(F.col("n").isNotNull(), F.col("pair"))).alias("seen_pairs"))


@query(f"WITH {_PAIRS}, f AS (SELECT source, target, CAST({_HEX.format('CAST(row_id AS VARCHAR)', 2)} % 5 AS INT) AS fold FROM pr WHERE split = 'train' AND source <> target), g AS (SELECT source, target, fold, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY source, target) AS a FROM g) SELECT fold, CAST(sum(n) AS BIGINT) AS labels, CAST(sum(CASE WHEN a > n THEN n ELSE 0 END) AS BIGINT) AS seen FROM t GROUP BY fold")
def oof_folds(spark, d):
    """Labels of each fold whose pair stands in another fold; by counts, without joining folds."""
    f = pairs(spark, d, "train").select(F.lower("error").alias("source"), F.lower("correction").alias("target"), (F.conv(F.substring(F.sha2(F.col("row_id").cast("string"), 256), 1, 2), 16, 10).cast("int") % 5).alias("fold")).filter("source <> target")
    g = f.groupBy("source", "target", "fold").agg(F.count(F.lit(1)).alias("n"))
    t = g.withColumn("a", F.sum("n").over(Window.partitionBy("source", "target")))
    return t.groupBy("fold").agg(F.sum("n").alias("labels"), F.sum(F.when(F.col("a") > F.col("n"), F.col("n")).otherwise(0)).alias("seen"))


_K = language._KEY
_REL = f"""CASE WHEN source = target THEN 'IDENTITY' WHEN length(target) - length(replace(target, ' ', '')) > length(source) - length(replace(source, ' ', '')) THEN 'SPLIT' WHEN length(target) - length(replace(target, ' ', '')) < length(source) - length(replace(source, ' ', '')) THEN 'MERGE'
WHEN {_K.format('source')} = {_K.format('target')} AND source = {_K.format('source')} THEN 'UNACCENTED_SAME_KEY' WHEN {_K.format('source')} = {_K.format('target')} THEN 'ACCENTED_SAME_KEY' WHEN source NOT LIKE '% %' THEN 'DIFFERENT_KEY_SINGLE' ELSE 'DIFFERENT_KEY_MULTI' END"""


def related_pairs(spark, d) -> DataFrame:
    p = pairs(spark, d).select("row_id", "split", "profile", F.lower("error").alias("source"), F.lower("correction").alias("target"))
    return p.withColumn("relation", prep.relation(F.col("source"), F.col("target"), accent_key("source"), accent_key("target")))


@query(f"WITH {_PAIRS} SELECT profile, {_REL} AS relation, count(*) AS n FROM pr GROUP BY ALL")
def correction_relations(spark, d):
    return related_pairs(spark, d).groupBy("profile", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(rf"WITH {_PAIRS} SELECT row_id, char_start, CAST(len(regexp_extract_all(substr(text, 1, char_start), '[\p{{L}}\p{{M}}]+')) AS INT) AS word_idx FROM pr")
def label_word_index(spark, d):
    """Index of the word at which each label starts."""
    return pairs(spark, d).select("row_id", "char_start", F.size(F.regexp_extract_all(F.expr("substring(text, 1, char_start)"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("word_idx"))


@query("WITH p AS (SELECT row_id, unnest(correction_pairs) AS p FROM (SELECT DISTINCT ON (row_id) * FROM sms_dataset)) SELECT row_id, p.char_start AS char_start, CAST(p.char_start + coalesce(sum(length(p.correction) - (p.char_end - p.char_start)) OVER (PARTITION BY row_id ORDER BY p.char_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_start FROM p")
def edit_rebase(spark, d):
    """Where each correction starts once those before it are applied."""
    p = table(spark, d, "sms_dataset").dropDuplicates(["row_id"]).select("row_id", F.explode("correction_pairs").alias("p")).select("row_id", "p.char_start", (F.length("p.correction") - (F.col("p.char_end") - F.col("p.char_start"))).alias("g"))
    by = Window.partitionBy("row_id").orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("row_id", "char_start", (F.col("char_start") + F.coalesce(F.sum("g").over(by), F.lit(0))).cast("long").alias("new_start"))


_RUNS = "rn AS (SELECT DISTINCT ON (run_id) run_id, config.config_key AS config_key, result.latency_ms AS ms, length(result.input_text) AS n, result.category AS category FROM special_case_results)"


def runs(spark, d) -> DataFrame:
    return table(spark, d, "special_case_results").dropDuplicates(["run_id"]).select("run_id", F.col("config.config_key").alias("config_key"), F.col("result.latency_ms").alias("ms"), F.length("result.input_text").alias("n"), F.col("result.category").alias("category"))


@query(f"WITH {_RUNS}, s AS (SELECT config_key, list_sort(list(ms)) AS l FROM rn WHERE ms IS NOT NULL GROUP BY config_key) SELECT config_key, l[1 + least(len(l) - 1, CAST(floor(0.5::DOUBLE * len(l)) AS INT))] AS p50_floor, l[1 + least(len(l) - 1, CAST(floor(0.95::DOUBLE * len(l)) AS INT))] AS p95_floor, l[CAST(ceil(0.95::DOUBLE * len(l)) AS INT)] AS p95_rank, floor(l[CAST(ceil(0.99::DOUBLE * len(l)) AS INT)] * 100 + 0.5) / 100 AS p99_2dp FROM s")
def percentiles3(spark, d):
    """The three percentile definitions over latencies, by configuration; ranks come from counts of distinct values, never from a whole group in one row."""
    v = runs(spark, d).filter("ms is not null").groupBy("config_key", "ms").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy("config_key"))
    cum = v.withColumn("hi", F.sum("k").over(Window.partitionBy("config_key").orderBy("ms"))).withColumn("total", total).withColumn("lo", F.col("hi") - F.col("k"))
    at = lambda rank: F.max(F.when((F.col("lo") < rank) & (rank <= F.col("hi")), F.col("ms")))
    low = lambda p: F.least(F.col("total"), F.floor(F.col("total") * F.lit(p)) + 1)
    near = lambda p: F.ceil(F.col("total") * F.lit(p))
    return cum.groupBy("config_key").agg(at(low(0.5)).alias("p50_floor"), at(low(0.95)).alias("p95_floor"), at(near(0.95)).alias("p95_rank"), (F.floor(at(near(0.99)) * 100 + 0.5) / 100).alias("p99_2dp"))


@query(f"WITH {_RUNS} SELECT config_key, CASE WHEN n <= 80 THEN '0-80' WHEN n <= 160 THEN '81-160' ELSE '161-' END AS bucket, count(*) AS runs, floor(avg(ms) * 1e6 + 0.5) / 1e6 AS mean_ms, max(ms) AS slowest FROM rn WHERE n IS NOT NULL AND ms IS NOT NULL GROUP BY ALL")
def len_buckets(spark, d):
    r = runs(spark, d).filter("n is not null and ms is not null")
    bucket = F.when(F.col("n") <= 80, "0-80").when(F.col("n") <= 160, "81-160").otherwise("161-")
    return r.groupBy("config_key", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("runs"), language.r6(F.avg("ms")).alias("mean_ms"), F.max("ms").alias("slowest"))


def guesses(spark, d) -> DataFrame:
    """A baseline to evaluate: each error of one word is corrected to the most frequent spelling of its key. (row_id, split, profile, relation, source, target, guess, p, margin, rank, ok)"""
    fam = language.fams(spark, d).withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("akey")))
    best = fam.groupBy("akey").agg(F.max(F.when(F.col("rnk") == 1, F.col("gram"))).alias("guess"), F.max(F.when(F.col("rnk") == 1, F.col("share"))).alias("p"), F.coalesce(F.max(F.when(F.col("rnk") == 2, F.col("share"))), F.lit(0.0)).alias("p2"))
    rows = related_pairs(spark, d).withColumn("akey", accent_key("source")).join(best, "akey", "left")
    rank = fam.select("akey", F.col("gram").alias("target"), F.col("rnk").alias("rank"))
    rows = rows.join(rank, ["akey", "target"], "left")
    return rows.select("row_id", "split", "profile", "relation", "source", "target", "guess", F.coalesce("p", F.lit(0.0)).alias("p"), (F.coalesce("p", F.lit(0.0)) - F.coalesce("p2", F.lit(0.0))).alias("margin"), "rank", F.coalesce(F.col("guess") == F.col("target"), F.lit(False)).alias("ok"))


_GUESS = f"""{_PAIRS}, {language._FAM}, sh AS (SELECT akey, gram, rnk, c / sum(c) OVER (PARTITION BY akey) AS share FROM fam), best AS (SELECT akey, max(CASE WHEN rnk = 1 THEN gram END) AS guess, max(CASE WHEN rnk = 1 THEN share END) AS p, coalesce(max(CASE WHEN rnk = 2 THEN share END), 0) AS p2 FROM sh GROUP BY akey),
gs AS (SELECT row_id, split, profile, {_REL} AS relation, source, target, guess, coalesce(p, 0) AS p, coalesce(p, 0) - coalesce(p2, 0) AS margin, fam.rnk AS rank, coalesce(guess = target, false) AS ok FROM pr LEFT JOIN best ON best.akey = {_K.format('source')} LEFT JOIN fam ON fam.akey = {_K.format('source')} AND fam.gram = target)"""


@query(f"WITH {_GUESS} SELECT profile, count(*) AS labels, count(guess) AS emitted, CAST(sum(ok::INT) AS BIGINT) AS hits, floor(CASE WHEN count(guess) = 0 THEN 0 ELSE sum(ok::INT) / count(guess) END * 1e6 + 0.5) / 1e6 AS precision, floor(sum(ok::INT) / count(*) * 1e6 + 0.5) / 1e6 AS recall FROM gs GROUP BY profile")
def prf_by_profile(spark, d):
    g = guesses(spark, d).groupBy("profile").agg(F.count(F.lit(1)).alias("labels"), F.count("guess").alias("emitted"), F.sum(F.col("ok").cast("long")).alias("hits"))
    return g.withColumn("precision", language.r6(evaluate.ratio(F.col("hits"), F.col("emitted")))).withColumn("recall", language.r6(evaluate.ratio(F.col("hits"), F.col("labels"))))


@query(f"WITH {_GUESS} SELECT CAST(least(9, floor(p * 10)) AS INT) AS bin, count(*) AS n, floor(avg(p) * 1e6 + 0.5) / 1e6 AS confidence, floor(avg(ok::INT) * 1e6 + 0.5) / 1e6 AS accuracy FROM gs GROUP BY 1")
def ece10(spark, d):
    return evaluate.calibration_error(guesses(spark, d)).select("bin", "n", language.r6(F.col("confidence")).alias("confidence"), language.r6(F.col("accuracy")).alias("accuracy"))


@query(f"WITH {_GUESS}, eb AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS c, avg(ok::INT) AS a FROM gs GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, floor(sum(n * abs(c - a)) / sum(n) * 1e6 + 0.5) / 1e6 AS ece FROM eb")
def ece_total(spark, d):
    b = evaluate.calibration_error(guesses(spark, d))
    return b.agg(F.sum("n").alias("n"), language.r6(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


_TS = [0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2]


@query(f"WITH {_GUESS}, g AS (SELECT unnest([{', '.join(map(str, _TS))}]::DOUBLE[]) AS t) SELECT t, floor(avg(-ln(greatest(CASE WHEN ok THEN 1 / (1 + exp(-margin / t)) ELSE 1 - 1 / (1 + exp(-margin / t)) END, 1e-12))) * 1e6 + 0.5) / 1e6 AS nll FROM gs, g GROUP BY t")
def nll_grid(spark, d):
    return evaluate.nll(guesses(spark, d), _TS).select("t", language.r6(F.col("nll")).alias("nll"))


@query()
def temperature(spark, d):
    """The temperature with the least negative log-likelihood: the best of a grid, then ternary steps on a summary of margins in 1,000 bins."""
    return calibration.fit_temperature(guesses(spark, d).select("margin", "ok"))


_TH = [round(0.05 * k, 2) for k in range(1, 20)]
_REPLAY = f"WITH {_GUESS}, g AS (SELECT unnest([{', '.join(map(str, _TH))}]::DOUBLE[]) AS threshold), r AS (SELECT threshold, CAST(sum((p >= threshold)::INT) AS BIGINT) AS emitted, CAST(sum((p >= threshold AND ok)::INT) AS BIGINT) AS hits, count(*) AS labels FROM gs, g GROUP BY threshold), q AS (SELECT *, CASE WHEN emitted = 0 THEN 0 ELSE hits / emitted END AS pr, hits / labels AS rc FROM r), z AS (SELECT threshold, emitted, hits, labels, floor(pr * 1e6 + 0.5) / 1e6 AS precision, floor(rc * 1e6 + 0.5) / 1e6 AS recall, floor(CASE WHEN 0.25 * pr + rc = 0 THEN 0 ELSE 1.25 * pr * rc / (0.25 * pr + rc) END * 1e6 + 0.5) / 1e6 AS f05 FROM q)"


@query(_REPLAY + " SELECT * FROM z")
def replay_grid(spark, d):
    return evaluate.replay(guesses(spark, d), _TH).select("threshold", "emitted", "hits", "labels", *[language.r6(F.col(c)).alias(c) for c in ("precision", "recall", "f05")])


@query(_REPLAY + " SELECT * FROM z WHERE precision >= 0.5 ORDER BY f05 DESC, precision DESC, threshold LIMIT 1")
def select_winner(spark, d):
    return replay_grid(spark, d).filter("precision >= 0.5").orderBy(F.desc("f05"), F.desc("precision"), "threshold").limit(1)


@query(f"""WITH {_GUESS}, g AS (SELECT a::DOUBLE AS least_p, b::DOUBLE AS least_margin FROM (SELECT unnest([0.0, 0.3, 0.5, 0.7, 0.9]) AS a), (SELECT unnest([0.0, 0.1, 0.3, 0.6]) AS b)),
r AS (SELECT least_p, least_margin, CAST(sum((p >= least_p AND margin >= least_margin)::INT) AS BIGINT) AS emitted, CAST(sum((p >= least_p AND margin >= least_margin AND ok)::INT) AS BIGINT) AS hits, count(*) AS labels FROM gs, g GROUP BY ALL),
q AS (SELECT *, CASE WHEN emitted = 0 THEN 0 ELSE hits / emitted END AS pr, hits / labels AS rc FROM r), z AS (SELECT *, CASE WHEN 0.25 * pr + rc = 0 THEN 0 ELSE 1.25 * pr * rc / (0.25 * pr + rc) END AS f FROM q)
SELECT least_p, least_margin, emitted, hits, labels, floor(f * 1e6 + 0.5) / 1e6 AS f05 FROM z WHERE f > 0 AND pr >= (SELECT pr FROM z WHERE least_p = 0.5 AND least_margin = 0.1) - 0.02 ORDER BY f DESC, least_p, least_margin LIMIT 1""")
def tuned(spark, d):
    """Confidence and margin with the best F0.5 among those whose precision holds."""
    got = evaluate.tune(guesses(spark, d), {"p": [0.0, 0.3, 0.5, 0.7, 0.9], "margin": [0.0, 0.1, 0.3, 0.6]}, {"p": 0.5, "margin": 0.1})
    return got.select("least_p", "least_margin", "emitted", "hits", "labels", language.r6(F.col("f05")).alias("f05"))


@query(f"WITH {_GUESS} SELECT relation, CAST(count(*) FILTER (ok) AS BIGINT) AS hit, CAST(count(*) FILTER (NOT ok AND guess IS NOT NULL AND rank IS NOT NULL) AS BIGINT) AS outranked, CAST(count(*) FILTER (NOT ok AND guess IS NOT NULL AND rank IS NULL) AS BIGINT) AS not_in_pool, CAST(count(*) FILTER (guess IS NULL) AS BIGINT) AS no_candidate, count(*) AS labels FROM gs GROUP BY relation")
def stage_pivot(spark, d):
    """Each label falls into exactly one stage, by relation."""
    stage = F.when(F.col("ok"), "hit").when(F.col("guess").isNull(), "no_candidate").when(F.col("rank").isNotNull(), "outranked").otherwise("not_in_pool")
    p = guesses(spark, d).withColumn("stage", stage).groupBy("relation").pivot("stage", ["hit", "outranked", "not_in_pool", "no_candidate"]).count().fillna(0)
    return p.withColumn("labels", F.col("hit") + F.col("outranked") + F.col("not_in_pool") + F.col("no_candidate"))


_ORACLE = f"WITH {_GUESS}, o AS (SELECT k, count(*) AS labels, CAST(sum((rank <= k)::INT) AS BIGINT) AS within_k FROM gs, (SELECT unnest([1, 2, 3, 4, 8, 12]) AS k) GROUP BY k)"


@query(_ORACLE + " SELECT k, labels, within_k, floor(within_k / labels * 1e6 + 0.5) / 1e6 AS retention FROM o")
def oracle_at_k(spark, d):
    """Share of labels whose correction stands among the first k spellings of the key."""
    ks = [1, 2, 3, 4, 8, 12]
    g = guesses(spark, d).agg(F.count(F.lit(1)).alias("labels"), *[F.coalesce(F.sum((F.col("rank") <= k).cast("long")), F.lit(0)).alias(f"k{k}") for k in ks])
    return g.select("labels", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("within_k")) for k in ks])).alias("x")).select("x.k", "labels", "x.within_k", language.r6(F.col("x.within_k") / F.col("labels")).alias("retention"))


@query(_ORACLE + " SELECT min(k) AS k FROM o WHERE within_k / labels >= (SELECT max(within_k / labels) FROM o WHERE k = 8) - 0.005")
def freeze_k(spark, d):
    o = oracle_at_k(spark, d)
    return o.agg(F.min(F.when(F.col("retention") >= F.lit(0), F.struct("k", "retention"))).alias("x"), F.max(F.when(F.col("k") == 8, F.col("retention"))).alias("r8"), F.collect_list(F.struct("k", "retention")).alias("all")).select(F.array_min(F.transform(F.filter("all", lambda x: x["retention"] >= F.col("r8") - 0.005), lambda x: x["k"])).alias("k"))


@query()
def match_strict(spark, d):
    """Labels of the corpus matched one-to-one with the findings of rules and lanes together."""
    return evaluate.strict_match(checks.joint_results(spark, d).filter("text is not null"), ["id", "category"])


@query()
def bench_categories(spark, d):
    """Rows, labels, caught, extras, forbidden and recall by category, and over all."""
    m = match_strict(spark, d).rollup("category").agg(F.count(F.lit(1)).alias("row_count"), F.sum("expected").alias("expected"), F.sum("caught").alias("caught"), F.sum("extras").alias("extras"), F.sum("forbidden").alias("forbidden"))
    return m.withColumn("recall", evaluate.ratio(F.col("caught"), F.col("expected"), 1.0))


@query("SELECT x.rule_id AS rule_id, count(*) AS labels, CAST(sum((x.position_start IS NOT NULL)::INT) AS BIGINT) AS placed, CAST(sum(coalesce(fully_labeled, false)::INT) AS BIGINT) AS in_full FROM (SELECT fully_labeled, unnest(expect) AS x FROM corpus) GROUP BY 1")
def label_scope(spark, d):
    e = table(spark, d, "corpus").select("fully_labeled", F.explode("expect").alias("x"))
    return e.groupBy("x.rule_id").agg(F.count(F.lit(1)).alias("labels"), F.count("x.position_start").alias("placed"), F.sum(F.coalesce("fully_labeled", F.lit(False)).cast("long")).alias("in_full"))


@query()
def clean_false_alarms(spark, d):
    """Of messages labelled clean: how many have findings, findings per 100 messages and per 1,000 words."""
    r = checks.results(spark, d).filter("clean and text is not null").agg(F.count(F.lit(1)).alias("messages"), F.sum((F.size("issues") > 0).cast("long")).alias("flagged"), F.sum(F.size("issues")).alias("findings"), F.sum("summary.word_count").alias("words"))
    return r.select("*", evaluate.ratio(F.col("flagged"), F.col("messages")).alias("flagged_share"), evaluate.ratio(F.col("findings") * 100, F.col("messages")).alias("per_100_messages"), evaluate.ratio(F.col("findings") * 1000, F.col("words")).alias("per_1000_words"))


@query("SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL")
def events_window(spark, d):
    """Events by type and hour, an extension over event-shaped input."""
    e = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_type", F.floor(F.unix_timestamp("w.start") / 3600).alias("hour"), "n")
