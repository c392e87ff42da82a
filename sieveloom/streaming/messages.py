"""Messages as a stream. Each is checked by itself, so the batch transformation runs unchanged on a stream; rates over time are windowed under a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.operators import rules
from sieveloom.operators.common import shared_dir

#: Bytes of the largest message that is checked.
MOST_BYTES = 16384


def admitted(messages: DataFrame, text: str = "text", mode: str = "message_mode") -> tuple[DataFrame, DataFrame]:
    """(messages to check, refused messages with a reason): no text, an unknown mode, or too many bytes."""
    known = F.coalesce(F.col(mode).isin("ACCENTED", "NON_ACCENTED"), F.lit(False))
    marked = messages.withColumn("reason", F.when(F.col(text).isNull(), "no text").when(~known, "unknown mode").when(F.octet_length(text) > MOST_BYTES, "too large"))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def checked(stream: DataFrame) -> DataFrame:
    """Results of a stream of messages (text, message_mode, ...), stateless."""
    return rules.checked(admitted(stream)[0])


def with_dimensions(stream: DataFrame, load: Callable[[], object], handle: Callable[[DataFrame, object], None]):
    """A writer that loads the dimensions anew for each micro-batch, so that a new model is taken up without a restart and each batch sees one."""
    return stream.writeStream.foreachBatch(lambda batch, _: handle(batch, load()))


def issue_rates(results: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Messages and findings by rule in each window of event time; rows later than the watermark are dropped by the stream."""
    rows = results.withWatermark(time, late).select(time, F.explode_outer("issues").alias("i"))
    return rows.groupBy(F.window(time, window).alias("w"), F.col("i.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "rule_id", "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has and returns the rows it wrote."""
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that match a glob."""
    return spark.readStream.schema(schema).parquet(path)
