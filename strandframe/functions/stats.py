"""Estimators as built-in aggregates; those that need two passes take a window first."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as kn

#: Scale of a median absolute deviation to a standard deviation (fixed value).
MAD_SCALE = 1.4826


def _by_the_c_library(f: Callable[[float], float]) -> Callable[..., Column]:
    """A column function of f, one of ``math``: Spark's own log2 and pow differ from the C library's in the last bits."""
    @F.pandas_udf("double")
    def each(x: pd.Series) -> pd.Series:
        return pd.Series([math.nan if v != v else f(v) for v in x.tolist()], dtype=float)

    return lambda c: F.when(c.isNotNull(), F.when(F.isnan(c), c).otherwise(each(c)))


def log2() -> Callable[..., Column]:
    return _by_the_c_library(lambda v: math.log2(v) if 0 < v else -math.inf if v == 0 else math.nan)


def power_of_2() -> Callable[..., Column]:
    return _by_the_c_library(lambda v: math.pow(2.0, v) if v < 1024 else math.inf)


def iqr(c: str) -> Column:
    return F.percentile(c, 0.75) - F.percentile(c, 0.25)


def mad(df: DataFrame, keys: list[str], c: str, name: str = "mad") -> DataFrame:
    """Scaled median absolute deviation per group."""
    centre = df.groupBy(*keys).agg(F.percentile(c, 0.5).alias("__m"))
    return df.join(centre, keys).groupBy(*keys).agg((F.percentile(F.abs(F.col(c) - F.col("__m")), 0.5) * MAD_SCALE).alias(name))


def weighted_mean(c: str, w: str) -> Column:
    """Mean by weight; the plain mean where weights sum to 0."""
    total = F.sum(F.when(F.col(c).isNotNull(), F.col(w)))
    return F.when(total > 0, F.sum(F.col(c) * F.col(w)) / total).otherwise(F.avg(c))


def weighted_std(df: DataFrame, keys: list[str], c: str, w: str, name: str = "std") -> DataFrame:
    """Population standard deviation by weight."""
    m = df.groupBy(*keys).agg((F.sum(F.col(c) * F.col(w)) / F.sum(w)).alias("__m"))
    return df.join(m, keys).groupBy(*keys).agg(F.sqrt(F.sum(F.col(w) * F.pow(F.col(c) - F.col("__m"), 2)) / F.sum(w)).alias(name))


def weighted_median(df: DataFrame, keys: list[str], c: str, w: str, name: str = "median") -> DataFrame:
    """The value at half the weight; the mean of two neighbours where half falls between them; a value of more than half the weight wins."""
    rows = df.filter(F.col(c).isNotNull()).groupBy(*keys, F.col(c).alias("__x")).agg(F.sum(F.coalesce(F.col(w), F.lit(0.0))).alias("__w"), F.max(F.coalesce(F.col(w), F.lit(0.0))).alias("__one"))
    g, o = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__x")
    rows = rows.withColumns({"__cum": F.sum("__w").over(o), "__half": F.sum("__w").over(g) / 2, "__next": F.lead("__x").over(o)})
    rows = rows.filter(F.col("__cum") >= F.col("__half") - 1e-12)
    value = F.when((F.abs(F.col("__cum") - F.col("__half")) <= 1e-12) & F.col("__next").isNotNull() & (F.col("__one") <= F.col("__half")), (F.col("__x") + F.col("__next")) / 2).otherwise(F.col("__x"))
    return rows.groupBy(*keys).agg(F.min_by(value, "__x").alias(name))


def weighted_mad(df: DataFrame, keys: list[str], c: str, w: str, name: str = "mad") -> DataFrame:
    rows = df.join(weighted_median(df, keys, c, w, "__m"), keys).withColumn("__d", F.abs(F.col(c) - F.col("__m")))
    return weighted_median(rows, keys, "__d", w, "__mad").select(*keys, (F.col("__mad") * MAD_SCALE).alias(name))


def gapper(df: DataFrame, keys: list[str], c: str, name: str = "gapper") -> DataFrame:
    """Scale from the gaps between ordered values."""
    o = Window.partitionBy(*keys).orderBy(c)
    rows = df.withColumns({"__gap": F.lead(c).over(o) - F.col(c), "__i": F.row_number().over(o).cast("double"), "__n": F.count("*").over(Window.partitionBy(*keys)).cast("double")})
    n = F.first("__n")
    return rows.groupBy(*keys).agg((F.sum(F.col("__gap") * F.col("__i") * (F.col("__n") - F.col("__i"))) * math.sqrt(math.pi) / (n * (n - 1))).alias(name))


def q_n(df: DataFrame, keys: list[str], c: str, name: str = "q_n") -> DataFrame:
    """First quartile of pairwise distances, scaled by group size; the values of a group are one array, its pairs are not made."""
    @F.pandas_udf("double")
    def quartile(values: pd.Series) -> pd.Series:
        return values.map(lambda x: kn.pair_distance_quantile(x, 0.25)).astype(float)

    groups = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n"), F.collect_list(F.col(c).cast("double")).alias("__x")).filter("__n > 1")
    n = F.col("__n")
    scale = F.when(n <= 10, 1.392).when(n < 400, 1 + 4 / n).otherwise(1.0)
    return groups.withColumn("__q", F.when(F.size("__x") > 1, quartile("__x"))).select(*keys, (F.col("__q") / scale).alias(name))


def mse(df: DataFrame, keys: list[str], c: str, name: str = "mse") -> DataFrame:
    """Mean squared distance from the group mean."""
    return df.groupBy(*keys).agg((F.avg(F.col(c) * F.col(c)) - F.pow(F.avg(c), 2)).alias(name))


def sem(c: str) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def size_weighted_median_depth(df: DataFrame) -> DataFrame:
    """One row: the median of the chromosomes' mean depths, by their length."""
    by = df.groupBy("chromosome").agg(F.avg("depth").alias("depth"), F.max("end").cast("double").alias("size")).withColumn("all", F.lit(1))
    return weighted_median(by, ["all"], "depth", "size", "depth").select("depth")
