"""Streams: idempotent ingestion, windowed counts, sessions, and the accumulator of streamed calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def events_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A file source; event time is cast to a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def unique_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, however often its file comes again within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(stream: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def accumulate(events: DataFrame) -> DataFrame:
    """response_id, text, calls of streamed responses (response_id, seq, kind, id, name, text, args_fragment).

    Texts are joined in order.  A fragment without id belongs to the call last begun; with none begun, to an orphan.
    Calls keep the order of their first event; arguments that are no JSON are marked by a null ``args``.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("response_id").orderBy("seq")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("kind") == "tool_start", F.col("id")), ignorenulls=True).over(running)
    owner = F.when(F.col("kind").isin("tool_start", "tool_delta"), F.coalesce("id", opened, F.lit("orphan")))
    rows = events.withColumn("owner", owner)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("x")))), lambda s: F.coalesce(s["x"], F.lit(""))), "")
    calls = rows.filter("owner is not null").groupBy("response_id", "owner").agg(F.min("seq").alias("first"), F.max("name").alias("name"), joined("args_fragment").alias("raw"))
    parsed = F.expr("try_parse_json(IF(raw = '', '{}', raw))")
    calls = calls.withColumn("args", F.when(parsed.isNotNull(), F.when(F.col("raw") == "", "{}").otherwise(F.col("raw"))))
    listed = calls.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("first", F.col("owner").alias("id"), "name", "args"))).alias("calls"))
    texts = events.groupBy("response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", F.col("text").alias("x"))))), lambda s: s["x"]), "").alias("text"))
    return texts.join(listed, "response_id", "left")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over all that is there into Parquet, and read the result."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over all that is there; executors write each batch's whole result over the one before, and the last one is read."""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(sink).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
