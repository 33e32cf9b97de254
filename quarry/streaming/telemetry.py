"""Structured Streaming over tool events: append, windowed decisions, override correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.telemetry import OVERRIDE_MS

EVENTS = "id long, ts timestamp, session_id string, hook_event string, tool_name string, rule string, decision string, latency_us long, input_hash string, file_path string"
LATE = "10 minutes"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Events from newline-delimited JSON files as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there to a Parquet table by day, each event once also after a restart, and stops."""
    by_day = events.withColumn("day", F.to_date("ts"))
    return by_day.writeStream.format("parquet").partitionBy("day").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """(start, rule, decision, n) per window; events over ten minutes late are left out on streams."""
    e = events.where("rule is not null").withWatermark("ts", LATE)
    return e.groupBy(F.window("ts", window).alias("w"), "rule", "decision").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "rule", "decision", "n")


def overrides(events: DataFrame, window_ms: int = OVERRIDE_MS) -> DataFrame:
    """Asked events with the action that went ahead within the window, null if none did; one row per such pair.

    A stream keeps ten minutes and the window of both sides, then gives up on a partner.
    """
    asked = events.where("hook_event = 'PreToolUse' and decision = 'ask'").select("id", "rule", "session_id", "input_hash", "ts").withWatermark("ts", LATE)
    done = events.where("hook_event = 'PostToolUse'").select(F.col("id").alias("post_id"), F.col("session_id").alias("p_session"), F.col("input_hash").alias("p_hash"), F.col("ts").alias("p_ts")).withWatermark("p_ts", LATE)
    until = F.expr(f"ts + interval {window_ms} milliseconds")
    on = (F.col("session_id") == F.col("p_session")) & (F.col("input_hash") == F.col("p_hash")) & (F.col("p_ts") >= F.col("ts")) & (F.col("p_ts") <= until)
    return asked.join(done, on, "left_outer").select("id", "rule", "ts", "post_id")
