"""Ordered and centred signals: residuals, centring, neighbours, adjusted p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chrom
from . import intervals
from .filters import drop_low_coverage

INSERT_SIZE = 250


def center_all(df: DataFrame, sample: list[str] | None = None, estimator: str = "median", skip_low: bool = False) -> DataFrame:
    """log2 less its centre: an estimate per autosome, then the same estimate of those."""
    f = {"median": lambda c: F.percentile(c, 0.5), "mean": F.avg}[estimator]
    keys = sample or []
    rows = drop_low_coverage(df) if skip_low else df
    by = rows.filter(chrom.is_autosome(F.col("chromosome"))).groupBy(*keys, "chromosome").agg(f("log2").alias("__c"))
    centre = by.groupBy(*keys).agg(f("__c").alias("__c"))
    joined = df.join(centre, keys) if keys else df.join(F.broadcast(centre))  # one row
    return joined.withColumn("log2", F.col("log2") - F.col("__c")).drop("__c")


def residuals_by_chrom(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with ``residual``: log2 less the median of its group."""
    centre = df.groupBy(*keys).agg(F.percentile("log2", 0.5).alias("__m"))
    return df.join(centre, keys).withColumn("residual", F.col("log2") - F.col("__m")).drop("__m")


def residuals_by_segment(df: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Bins within segments with ``residual``: log2 less the segment's."""
    pairs = intervals.overlap_join(df, segments, "inner")
    return pairs.withColumn("residual", F.col("log2") - F.col("r_log2")).withColumnRenamed(f"r_{key}", key).select(*df.columns, key, "residual")


def edge_bias(df: DataFrame, order: list[str], insert: int = INSERT_SIZE, keys: list[str] | None = None) -> DataFrame:
    """df with ``edge``: coverage gained from close neighbours (of the same sample, by ``keys``) less what runs over the bin's own ends."""
    w = Window.partitionBy(*(keys or []), "chromosome").orderBy(*order)
    t, i = (F.col("end") - F.col("start")).cast("double"), float(insert)
    loss = i / (2 * t) - F.when(t < i, F.pow(i - t, 2) / (2 * i * t)).otherwise(0.0)

    def gain(gap: Column) -> Column:
        g = F.greatest(gap, F.lit(0)).cast("double")
        value = F.pow(i - g, 2) / (4 * i * t) - F.when(t + gap < i, F.pow(i - t - g, 2) / (4 * i * t)).otherwise(0.0)
        return F.when(gap < i, value).otherwise(0.0)

    left, right = F.col("start") - F.lag("end").over(w), F.lead("start").over(w) - F.col("end")
    return df.withColumn("edge", F.coalesce(gain(left), F.lit(0.0)) + F.coalesce(gain(right), F.lit(0.0)) - loss)


def p_adjust_bh(df: DataFrame, keys: list[str], p: str = "p", tie: list[str] | None = None) -> DataFrame:
    """df with ``q``: Benjamini-Hochberg, within keys."""
    up = Window.partitionBy(*keys).orderBy(p, *(tie or []))
    down = Window.partitionBy(*keys).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"__r": F.row_number().over(up), "__n": F.count("*").over(Window.partitionBy(*keys))})
    return rows.withColumn("q", F.least(F.min(F.col(p) * F.col("__n") / F.col("__r")).over(down), F.lit(1.0))).drop("__r", "__n")


def rolling(df: DataFrame, keys: list[str], order: list[str], c: str, wing: int, f, name: str) -> DataFrame:
    """f over the 2 * wing + 1 rows around each, with the ends mirrored (the edge row included)."""
    w, every = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(every), "__real": F.lit(True)})
    low = rows.filter(F.col("__i") < wing).withColumn("__i", -1 - F.col("__i"))
    high = rows.filter(F.col("__i") >= F.col("__n") - wing).withColumn("__i", 2 * F.col("__n").cast("int") - 1 - F.col("__i"))
    padded = rows.unionByName(low.withColumn("__real", F.lit(False))).unionByName(high.withColumn("__real", F.lit(False)))
    around = Window.partitionBy(*keys).orderBy("__i").rowsBetween(-wing, wing)
    return padded.withColumn(name, f(F.col(c)).over(around)).filter("__real").drop("__i", "__n", "__real")


def ordinals(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``nth``, its place within keys from 0."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def best_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
