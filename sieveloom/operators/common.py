"""What several operators need: tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has more than this share of all rows (and at least HOT_ROWS): at most 1 / HOT_SHARE keys can be.
HOT_SHARE, HOT_ROWS = 1 / 2000, 20_000
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). One of our own only where none is set and all runs in one process, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    got = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not got:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="sieveloom-")
        sc.setCheckpointDir(got)
        got = sc.getCheckpointDir() or got
    return got.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def _clean_up(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # the session ended first; whoever owns the folder cleans it
        pass


def run_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder, deleted when the driver ends: results are lazy, so their tables must live until then."""
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_clean_up, spark, path)
    return path


def materialize(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts the lineage, and survives the loss of executors. by: a column of few values that later steps filter on, kept as folders."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._sieveloom_path = path
    return got


def release(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more."""
    path = getattr(df, "_sieveloom_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


#: A table of at most so many rows may be broadcast.
SMALL_ROWS = 1 << 18


def if_small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast in joins where it has few rows; it should be materialized, as it is counted."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def over_all(df: DataFrame, *by: str) -> DataFrame:
    """Small rows that are dear to work on, in as many partitions as a shuffle has: adaptive execution would put them into few, by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _scatter(left: DataFrame, key: str, hot: F.Column) -> DataFrame:
    """Adds _salt: 0, but a hash of the rest of the row where the key is null or hot, so that such rows go to all partitions."""
    rest = [c for c in left.columns if c != key] or [key]
    return left.withColumn("_salt", F.when(F.col(key).isNull() | hot, F.xxhash64(*rest)).otherwise(F.lit(0).cast("long")))


def lookup_join(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "left") -> DataFrame:
    """left joined to right, whose key is unique and whose column `rows` (dropped) says how many rows of left have that key.

    Hot keys (at most 1 / HOT_SHARE of them, whatever the data) are looked up by broadcast, and their rows are spread over all partitions of the shuffle
    join that serves the rest, so that no task gets a hot key whole. Rows with a null key, which a left join keeps, are spread as well. right should be materialized: it is read twice."""
    values = [c for c in right.columns if c not in (key, rows)]
    total, most = right.agg(F.sum(rows), F.max(rows)).first()
    least = max(HOT_ROWS, (total or 0) * HOT_SHARE)
    if how == "inner":
        left = left.filter(F.col(key).isNotNull())
    if (most or 0) <= least:
        if how == "inner":
            return left.join(right.drop(rows), key)
        cold = right.select(F.col(key).alias("_ck"), F.lit(0).cast("long").alias("_cs"), *values)
        spread = _scatter(left, key, F.lit(False))
        return spread.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left").select(*left.columns, *values)
    hot = right.filter(F.col(rows) > least).select(F.col(key).alias("_hk"), F.lit(True).alias("_hot"), *[F.col(v).alias(f"_h_{v}") for v in values])
    spread = left.join(F.broadcast(hot), left[key] == hot["_hk"], "left").drop("_hk")
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    spread = _scatter(spread, key, is_hot).withColumn("_k", F.when(~is_hot, F.col(key)))
    cold = right.filter(F.col(rows) <= least).select(F.col(key).alias("_ck"), F.lit(0).cast("long").alias("_cs"), F.lit(True).alias("_cold"), *[F.col(v).alias(f"_c_{v}") for v in values])
    out = spread.join(cold, (F.col("_k") == F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left")
    if how == "inner":
        out = out.filter(F.col("_hot") | F.col("_cold"))
    return out.select(*left.columns, *[F.coalesce(F.col(f"_h_{v}"), F.col(f"_c_{v}")).alias(v) for v in values])
