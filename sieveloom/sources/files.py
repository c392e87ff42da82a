"""Files that language models, lexicons, corpora and evaluations are kept in: scans with strict checks, and sinks that appear whole or not at all."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("U", "B", "T")
#: Version of the header line of evaluation files.
HEADER_VERSION = 1


class BadFile(ValueError):
    """A file breaks its format; the message says where and why."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_ngrams(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Unigrams, bigrams and trigrams (gram, c), and the number of tokens, of a text file: `#tokens=N`, then lines kind, key, count, tab-separated, the kinds in order. Raises BadFile with the first break."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    parts = F.split("value", "\t", -1)
    rows = lines.filter(~F.col("value").startswith("#")).select("at", "value", F.size(parts).alias("fields"), F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("gram"), F.get(parts, F.lit(2)).alias("count"))
    why = (
        F.when(F.col("fields") != 3, "not exactly two tabs").when(~F.col("kind").isin(*KINDS), "unknown kind").when(F.col("gram") == "", "empty key").when(~F.col("count").rlike("^[1-9][0-9]{0,17}$"), "count is no positive integer")
        .when(F.size(F.split("gram", " ")) != F.when(F.col("kind") == "U", 1).when(F.col("kind") == "B", 2).otherwise(3), "key of another order")
    )
    bad = rows.withColumn("why", why).filter("why is not null").orderBy("at").limit(1).collect()
    if bad:
        raise BadFile(f"{path}: {bad[0]['why']}: {bad[0]['value'][:80]!r}")
    heads = lines.filter(F.col("value").startswith("#")).collect() if lines.filter(F.col("value").startswith("#")).limit(2).count() < 2 else None
    first = lines.agg(F.min("at")).first()[0]
    if heads is None or len(heads) != 1 or heads[0]["at"] != first or not re.fullmatch(r"#tokens=\d+", heads[0]["value"]):
        raise BadFile(f"{path}: the header #tokens=N must be the first line, and the only one of its kind")
    edges = {r["kind"]: (r["lo"], r["hi"]) for r in rows.groupBy("kind").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect()}
    order = [edges[k] for k in KINDS if k in edges]
    if any(a[1] > b[0] for a, b in zip(order, order[1:])):
        raise BadFile(f"{path}: sections out of order")
    twice = rows.groupBy("kind", "gram").count().filter("count > 1").limit(1).collect()
    if twice:
        raise BadFile(f"{path}: key given twice: {twice[0]['gram']!r}")
    out = [rows.filter(F.col("kind") == k).select("gram", F.col("count").cast("long").alias("c")) for k in KINDS]
    return out[0], out[1], out[2], int(heads[0]["value"].split("=")[1])


def write_ngrams(unigrams: DataFrame, bigrams: DataFrame, trigrams: DataFrame, path: str) -> None:
    """The file of read_ngrams: within a section the most frequent first. Parts are ranges of one order, so their names give the lines' order."""
    spark = unigrams.sparkSession
    total = unigrams.agg(F.sum("c")).first()[0] or 0
    head = spark.createDataFrame([(0, f"#tokens={total}", 0, "")], "kind int, line string, c long, gram string")
    for i, (k, df) in enumerate(zip(KINDS, (unigrams, bigrams, trigrams)), 1):
        head = head.unionByName(df.select(F.lit(i).alias("kind"), F.concat_ws("\t", F.lit(k), "gram", F.col("c").cast("string")).alias("line"), F.col("c").cast("long").alias("c"), "gram"))
    write_whole(head.orderBy("kind", F.desc("c"), "gram").select("line"), path, "text")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, type) of a tab-separated file; of a word given twice the highest frequency."""
    raw = spark.read.csv(path, sep="\t", schema="word string, freq long, type string", comment="#", quote="")
    return raw.filter("word is not null").groupBy(F.lower("word").alias("word")).agg(F.max("freq").alias("freq"), F.max_by("type", "freq").alias("type"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(word): the lines of a list, lower case, without blanks around and without comments."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> '' and not word like '#%'").distinct()


def read_rows(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """The rows of JSON documents {rows: [...]}; a glob reads several."""
    return spark.read.json(path, schema=T.StructType([T.StructField("rows", T.ArrayType(row))]), multiLine=True).select(F.explode("rows").alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of all text files below a folder; unreadable files are passed over."""
    return spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path)


def first_shards(paths: Iterable[str], n: int) -> list[str]:
    """The first n of the sorted paths; all for 0."""
    got = sorted(paths)
    return got[:n] if n else got


def both_texts(df: DataFrame, noisy: str = "text", corrected: str = "corrected_text") -> DataFrame:
    """(text): noisy and corrected text as separate rows."""
    return df.select(F.explode(F.array(noisy, corrected)).alias("text")).filter("text is not null")


def guard(paths: Iterable[str], forbidden: Iterable[str]) -> None:
    """Refuses paths that hold a forbidden marker, before anything is read."""
    marks = [m.lower() for m in forbidden]
    for p in paths:
        if hit := next((m for m in marks if m in p.lower()), None):
            raise PermissionError(f"{p}: holds {hit!r}")


def allow_split(split: str, final: bool = False) -> str:
    """The split, unless it is unknown, or held out and this isn't the final run."""
    if split not in ("train", "dev", "test"):
        raise ValueError(f"unknown split {split!r}")
    if split == "test" and not final:
        raise PermissionError("test is held out: ask for the final run")
    return split


def digest(df: DataFrame) -> F.Column:
    """Sum of the hashes of all rows, whatever their order."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))


def dump_shards(df: DataFrame, path: str, key: str, shards: int) -> DataFrame:
    """Writes at most so many files, each with a range of the key in order; (shard, rows, first_key, last_key, digest) of each."""
    df.repartitionByRange(shards, key).sortWithinPartitions(key).write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    return got.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), digest(got).alias("digest"))


def write_whole(df: DataFrame, path: str, kind: str = "parquet", manifest: dict | None = None, **options: str) -> None:
    """Writes beside the path and renames when all is there; the old content stays until then. With a manifest, a JSON file with it and the number of rows is written last."""
    spark = df.sparkSession
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(tmp)
    target, fs = _fs(spark, path)
    source, _ = _fs(spark, tmp)
    old = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")[0]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot put {path} in place")
    if had:
        fs.delete(old, True)
    if manifest is not None:
        rows, sign = spark.read.options(**options).format(kind).load(path).transform(lambda x: x.agg(F.count(F.lit(1)), digest(x))).first()
        out = fs.create(_fs(spark, f"{path}.manifest.json")[0], True)
        out.write(json.dumps(manifest | {"rows": rows, "digest": str(sign or 0), "format": kind}, sort_keys=True, ensure_ascii=False).encode())
        out.close()


def write_evaluation(df: DataFrame, path: str, header: dict) -> None:
    """Rows as JSON lines, with a header table beside them that read_evaluation asks for."""
    spark = df.sparkSession
    write_whole(spark.createDataFrame([(json.dumps(header | {"version": HEADER_VERSION}, sort_keys=True),)], "value string"), f"{path}/header", "text")
    write_whole(df, f"{path}/rows", "json")


def read_evaluation(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[dict, DataFrame]:
    """Header and rows; refused without exactly one header of this version."""
    if not exists(spark, f"{path}/header"):
        raise BadFile(f"{path}: no header")
    got = spark.read.text(f"{path}/header").limit(2).collect()
    if len(got) != 1 or json.loads(got[0][0]).get("version") != HEADER_VERSION:
        raise BadFile(f"{path}: header of another version")
    return json.loads(got[0][0]), read_jsonl(spark, f"{path}/rows", schema)


def kept(spark: SparkSession, path: str, make) -> DataFrame:
    """A table that is read if it is there, and else made and kept."""
    if not exists(spark, path):
        write_whole(make(), path)
    return spark.read.parquet(path)
