"""Queries of the training-text problems: personal information (1), splits (2), copies (3), leaked items (4), overlaps between splits (5), packing (6), mixing (7), repetition (8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.llm import copies, leaks, mixing, overlaps, packing, pii, repetition, splits
from sieveloom.operators import components
from sieveloom.operators.common import materialize
from sieveloom.functions.keys import key
from sieveloom.plans.prep import components_sql
from sieveloom.sources.tables import spread, table


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(record_table, record_key, text) of the two tables of messages."""
    corpus = table(spark, d, "corpus").select(F.lit("corpus").alias("record_table"), F.col("id").alias("record_key"), "text")
    return spread(corpus.union(table(spark, d, "special_case_results").select(F.lit("special_case_results"), "run_id", "result.input_text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of the forms that these tables ask for: national subscriber and identity numbers."""
    return pii.find(messages(spark, d), forms=pii.national).select("record_table", "record_key", "pii_kind", "char_start").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(messages(spark, d), forms=pii.national)


def related_rows(spark: SparkSession, d: str) -> DataFrame:
    """(id, anchor) of the rows of sms_dataset that have any key."""
    rows = table(spark, d, "sms_dataset").select("row_id", key("group_id").alias("g"), F.col("template_id").alias("t"), F.when(F.col("author_id") != 0, F.col("author_id")).alias("a")).filter("row_id is not null")
    via = table(spark, d, "templates").select(F.col("template_id").alias("t"), key("template_group").alias("g"))
    return components.related(rows, "row_id", ["t", "g", "a"], via={"t": via})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return related_rows(spark, d).filter("anchor <> id").select(F.col("anchor").alias("anchor_row_id"), F.col("id").alias("row_id"))


#: Splits of p2_splits and their shares of the rows.
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sms_dataset").select(F.col("row_id").alias("id"), F.col("profile").alias("label"))
    return splits.assign(rows, related_rows(spark, d), "label", list(SPLITS), list(SPLITS.values())).select(F.col("id").alias("row_id"), "split")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of each split and label."""
    got = materialize(p2_splits(spark, d), "splits")
    labels = table(spark, d, "sms_dataset").groupBy("row_id").agg(F.min("profile").alias("profile"))
    total = F.lit(float(max(1, got.count())))
    return got.join(labels, "row_id").groupBy("split", "profile").agg(F.count(F.lit(1)).alias("row_count")).withColumn("share", F.col("row_count") / total)


def _copy_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.structures(spread(table(spark, d, "corpus").select("id", "text")), "corpus", "id", "text").union(copies.structures(table(spark, d, "templates"), "templates", "template_id", "text", "slots"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies_found(_copy_records(spark, d))


def p3_counted(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies_counted(_copy_records(spark, d))


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """(id, side, text) of the corpus rows in train (1) and in dev or test (2)."""
    split = key("split")
    sides = table(spark, d, "split_index").select("row_index", F.when(split == "train", 1).when(split.isin("dev", "test"), 2).alias("side")).filter("side is not null").distinct()
    return table(spark, d, "corpus").select("row_index", "id", "text").join(sides, "row_index").select("id", "side", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.cross_split(split_rows(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and evaluation records in pairs, per split and source of the evaluation record."""
    split = table(spark, d, "split_index").select("row_index", key("split").alias("split")).filter("split in ('dev', 'test')").distinct()
    rows = table(spark, d, "corpus").select("row_index", "id", "source_name").join(split, "row_index").select("id", "split", "source_name")
    return overlaps.partners(split_rows(spark, d)).join(rows, "id").groupBy("split", "source_name").agg(F.sum("pairs").alias("pairs"), F.count_distinct("id").alias("records"))


def held_out_items(spark: SparkSession, d: str) -> DataFrame:
    """(item_table, item_id, text): all of corpus_2, held-out templates, and corpus rows in dev or test."""
    fixed = table(spark, d, "corpus_2").select(F.lit("corpus_2").alias("item_table"), F.col("id").alias("item_id"), "text")
    templates = table(spark, d, "templates").filter(key("purpose") == "held_out").select(F.lit("templates"), "template_id", "text")
    rows = table(spark, d, "split_index").filter(key("split").isin("dev", "test")).select("row_index").distinct()
    corpus = table(spark, d, "corpus").join(rows, "row_index", "left_semi").select(F.lit("corpus"), "id", "text")
    return fixed.union(templates).union(corpus).filter("item_id is not null and text is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(spread(table(spark, d, "documents").select("doc_id", "text")), held_out_items(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents and leaked items by item table and document source."""
    source = table(spark, d, "documents").select("doc_id", key("source").alias("source"))
    return p4_found(spark, d).join(source, "doc_id").groupBy("item_table", "source").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("item_id").alias("items"))


def capacities(spark: SparkSession, d: str) -> dict[int, int]:
    """Capacity by spec id; a small table of settings."""
    return {r[0]: r[1] for r in table(spark, d, "pack_specs").select("spec_id", "capacity_tokens").dropna().collect()}


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spread(table(spark, d, "documents").select("doc_id", "text")), capacities(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p6_packed(spark, d), capacities(spark, d))


def targets(spark: SparkSession, d: str) -> dict[str, tuple[float, int]]:
    """Target share and most repeats by source; a small table of settings."""
    rows = table(spark, d, "mix_targets").select(key("source_name"), "target_share", "max_repeats").dropna().collect()
    return {s: (w, r) for s, w, r in sorted(rows, reverse=True) if w > 0 and r > 0}


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", key("source").alias("source"), "text"))
    return mixing.mix(docs, targets(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(materialize(p7_mixed(spark, d), "mixed"), targets(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), found_only=True).select("doc_id").distinct()


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(spread(table(spark, d, "documents").select("doc_id", "text", "lang")))


_ALL = (
    p1_found, p1_redacted, p2_found, p2_splits, p2_report, p3_found, p3_counted, p4_found, p4_report, p5_found, p5_report, p6_packed, p6_report, p7_mixed, p7_report, p8_found, p8_profile,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_CASED = r"regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}\p{M}]+')"
_FOLDED = r"regexp_extract_all(replace(lower(strip_accents(nfc_normalize(text))), 'đ', 'd'), '[\p{L}\p{N}]+')"
_KEYED = r"lower(regexp_replace({0}, '^[ \t\n\r\x{a0}\x{2003}\x{200b}]+|[ \t\n\r\x{a0}\x{2003}\x{200b}]+$', '', 'g'))"


def oracle_sql() -> dict[str, str]:
    """SQL that finds every component, pair, window and run; the other problems are tested against brute force."""
    held = (
        "SELECT 'corpus_2' AS item_table, id AS item_id, text FROM corpus_2 UNION ALL SELECT 'templates', template_id, text FROM templates WHERE " + _KEYED.replace("{0}", "purpose") + " = 'held_out' "
        "UNION ALL SELECT 'corpus', id, text FROM corpus WHERE row_index IN (SELECT row_index FROM split_index WHERE " + _KEYED.replace("{0}", "split") + " IN ('dev', 'test'))"
    )
    grams = "SELECT {key}, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) AS g FROM ({src}) WHERE len(ws) >= 12"
    docs = grams.format(key="doc_id", src=f"SELECT doc_id, {_FOLDED} AS ws FROM documents WHERE text IS NOT NULL")
    items = grams.format(key="item_table, item_id", src=f"SELECT item_table, item_id, {_FOLDED} AS ws FROM ({held}) WHERE text IS NOT NULL")
    key_of = lambda c: f"nullif({_KEYED.replace('{0}', c)}, '')"
    related = components_sql(
        f"SELECT row_id AS r, 'g:' || {key_of('group_id')} AS k, NULL::VARCHAR AS k2 FROM sms_dataset UNION ALL SELECT row_id, 't:' || template_id, NULL FROM sms_dataset UNION ALL SELECT row_id, 'a:' || author_id, NULL FROM sms_dataset WHERE author_id <> 0 "
        f"UNION ALL SELECT NULL, 't:' || template_id, 'g:' || {key_of('template_group')} FROM templates WHERE {key_of('template_group')} IS NOT NULL"
    )
    return {
        "p2_found": f"WITH {related} SELECT anchor AS anchor_row_id, id AS row_id FROM rel WHERE anchor <> id",
        # words become characters, so that the distance of texts is that of their words; a near pair has few distinct words
        "p5_found": f"""WITH s AS (SELECT DISTINCT row_index, {_KEYED.replace("{0}", "split")} AS split FROM split_index), r AS (SELECT id, split, {_FOLDED} AS ws FROM corpus JOIN s USING (row_index) WHERE text IS NOT NULL AND split IN ('train', 'dev', 'test')),
p AS (SELECT a.id AS i, b.id AS j, a.ws AS x, b.ws AS y, greatest(len(a.ws), len(b.ws)) // 5 AS k, list_distinct(list_concat(a.ws, b.ws)) AS d FROM r a JOIN r b ON a.split = 'train' AND b.split <> 'train' AND a.id <> b.id AND abs(len(a.ws) - len(b.ws)) <= greatest(len(a.ws), len(b.ws)) // 5),
q AS (SELECT i, j, k, array_to_string(list_transform(x, lambda w: chr(31 + list_position(d, w))), '') AS sx, array_to_string(list_transform(y, lambda w: chr(31 + list_position(d, w))), '') AS sy FROM p WHERE len(d) <= least(96, least(len(x), len(y)) + k))
SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM q WHERE levenshtein(sx, sy) <= k""",
        "p4_found": f"SELECT DISTINCT doc_id, item_table, item_id FROM ({docs}) d JOIN ({items}) i ON d.g = i.g",
        "p8_found": f"""WITH w AS (SELECT doc_id, {_CASED} AS ws FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ') ORDER BY i) AS n FROM i), c AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY doc_id)
SELECT doc_id FROM c JOIN w USING (doc_id) WHERE k >= 0.3 * len(ws)""",
    }
