"""Streams: command files parsed as they arrive, and progress of tasks over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.commands import parse


def command_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Intents of the lines of text files dropped into a folder; ``cmd_id`` is a hash of file and line."""
    lines = spark.readStream.format("text").load(folder).select(F.col("value").alias("raw_text"), F.xxhash64(F.col("_metadata.file_path"), "value").alias("cmd_id"))
    return parse(lines)


def task_events(events: DataFrame) -> DataFrame:
    """The events table as task events: ``(task_id, ts, state, current, total)``."""
    state = F.when(F.col("event_type") == "error", "failed").otherwise("running")
    return events.select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), state.alias("state"), F.col("value").alias("current"), F.lit(100.0).alias("total"))


def progress_windows(tasks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, failures and furthest progress per window; late events within the watermark count."""
    agg = tasks.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "failed").alias("failed"), F.max(F.col("current") / F.col("total")).alias("furthest"))
    return agg.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "failed", "furthest")


def task_sessions(tasks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a task's events without a longer pause."""
    return tasks.withWatermark("ts", late).groupBy("task_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("current").alias("current")).select("task_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "current")
