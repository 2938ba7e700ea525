"""The log of probes as a stream: folding and yields as responses arrive, with batch twins in operators.fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.sources.tables import log_columns

LATE = "10 minutes"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of events at a path."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return log_columns(stream).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_fold(log: DataFrame) -> DataFrame:
    """Hits of each keyword per hour and seed; an event that comes twice counts once."""
    once = log.where("n_results > 0").withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["seq"])
    return once.groupBy(F.window("ts", "1 hour").alias("w"), "seed_id", "keyword").agg(F.count("*").alias("weight")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "seed_id", "keyword", "weight")


def stream_yield(log: DataFrame) -> DataFrame:
    """Requests, suggestions and summed time of each struct per hour."""
    by = log.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour").alias("w"), "struct")
    out = by.agg(F.count("*").alias("requests"), F.sum("n_results").alias("suggestions"), F.round(F.sum("time_ms"), 2).alias("sum_ms"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "struct", "requests", "suggestions", "sum_ms")


def merged(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each key: what the last batch that changed it wrote. changes has a column batch."""
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    last = changes.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("_l"))
    return last.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in values))


def run_available(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Reads what is there; each batch writes only the keys that it changed, and they are merged when read.

    In update mode the state of a window goes once the watermark has passed it. A batch that is repeated replaces itself. Events
    that come later than the watermark allows are left out.
    """
    spark = stream.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return merged(spark.read.schema(f"{stream.schema.toDDL()}, batch int").parquet(path), keys)
