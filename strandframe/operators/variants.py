"""Allele frequencies by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join


def mirrored(freq: Column, above: Column) -> Column:
    """Frequencies folded to one side of a half."""
    return F.when(above, F.abs(freq - 0.5) + 0.5).otherwise(0.5 - F.abs(freq - 0.5))


def tumor_boost(t: Column, n: Column) -> Column:
    return F.when(t < n, 0.5 * t / n).otherwise(1 - 0.5 * (1 - t) / (1 - n))


def baf_by_ranges(snps: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """ranges with ``baf``: the median of frequencies mirrored to the side their median lies on; a lone variant's as it is."""
    pairs = overlap_join(snps, ranges).withColumnRenamed(f"r_{key}", key)
    side = pairs.groupBy(key).agg((F.percentile("alt_freq", 0.5) > 0.5).alias("__above"), F.count("*").alias("__n"))
    pairs = pairs.join(side, key)
    value = F.when(F.col("__n") == 1, F.col("alt_freq")).otherwise(mirrored(F.col("alt_freq"), F.col("__above")))
    return ranges.join(pairs.groupBy(key).agg(F.percentile(value, 0.5).alias("baf")), key, "left")


def baf_counts(snps: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """ranges with ``minor`` and ``total``: reads of the minor allele, and all."""
    pairs = overlap_join(snps, ranges).groupBy(F.col(f"r_{key}").alias(key)).agg(F.sum(F.least("alt_count", F.col("depth") - F.col("alt_count"))).alias("minor"), F.sum("depth").alias("total"))
    return ranges.join(pairs, key, "left").fillna(0, ["minor", "total"])


def het_frac(snps: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """ranges with ``het``: the share of heterozygous variants."""
    pairs = overlap_join(snps, ranges).groupBy(F.col(f"r_{key}").alias(key)).agg(F.avg(((F.col("zygosity") != 0) & (F.col("zygosity") != 1)).cast("double")).alias("het"))
    return ranges.join(pairs, key, "left")
