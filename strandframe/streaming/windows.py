"""Windows over event streams, the same code for a batch and a stream. Late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark (which takes a time with a zone); a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    rows = timed(events, late)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("w_start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = LATE) -> DataFrame:
    rows = timed(events, late)
    out = rows.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return out.select(F.col("window.start").alias("w_start"), "n", "top")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    rows = timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), "n")


def annotate(stream: DataFrame, ranges: DataFrame, bucket: int = 50_000) -> DataFrame:
    """A stream of positions (chromosome, start) with the static range each lies in."""
    table = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    table = table.select(F.col("chromosome").alias("r_chromosome"), "bucket", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    at = stream.withColumn("b", F.floor(F.col("start") / bucket))
    return at.join(table, (at.chromosome == table.r_chromosome) & (at.b == table.bucket) & (at.start >= table.r_start) & (at.start < table.r_end)).drop("b", "bucket", "r_chromosome")
