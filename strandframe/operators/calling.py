"""Absolute copy numbers of segments, and the filters on calls. All are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chrom, stats

#: Log2 thresholds of 0, 1, 2 and 3 copies (fixed values).
THRESHOLDS = (-1.1, -0.25, 0.2, 0.7)


def _on(letter: str) -> Column:
    return F.upper(chrom.bare(F.col("chromosome"))) == letter


def reference_copies(ploidy: int = 2, haploid_x: bool = False) -> Column:
    """Copies in the reference sample."""
    half = F.lit(ploidy // 2)
    return F.when(_on("Y") | (F.lit(haploid_x) & _on("X")), half).otherwise(F.lit(ploidy))


def expected_copies(ploidy: int = 2, female: bool = True) -> Column:
    """Copies in a normal sample of that sex."""
    half = F.lit(ploidy // 2)
    return F.when(_on("Y"), F.lit(0) if female else half).when(_on("X"), F.lit(ploidy) if female else half).otherwise(F.lit(ploidy))


def threshold(log2: Column, ref: Column, ploidy: int = 2, cuts: Sequence[float] = THRESHOLDS) -> Column:
    """Copies by the first threshold that log2 doesn't exceed; rounded up beyond the last; the reference's for null."""
    out = F.ceil(ref * F.pow(F.lit(2.0), log2)).cast("double")
    for i, cut in reversed(list(enumerate(cuts))):
        out = F.when(log2 <= cut, F.when(ref == ploidy, F.lit(float(i))).otherwise((F.lit(i) * ref / ploidy).cast("int").cast("double"))).otherwise(out)
    return F.when(log2.isNull(), ref.cast("double")).otherwise(out)


def pure(log2: Column, ref: Column) -> Column:
    return ref * F.pow(F.lit(2.0), log2)


def clonal(log2: Column, ref: Column, expect: Column, purity: float) -> Column:
    """Copies in the tumor cells of a sample of that purity."""
    return F.greatest((ref * F.pow(F.lit(2.0), log2) - expect * (1 - purity)) / purity, F.lit(0.0))


def log2_ratio(absolute: Column, ploidy: int = 2, haploid_x: bool = False) -> Column:
    """log2 of absolute copies, against the reference's sex chromosomes."""
    out = F.log2(F.greatest(absolute / ploidy, F.lit(1e-3)))
    return out + F.when(_on("Y") | (F.lit(haploid_x) & _on("X")), 1.0).otherwise(0.0)


def rescale_baf(baf: Column, purity: float) -> Column:
    return F.least(F.greatest((baf - 0.5 * (1 - purity)) / purity, F.lit(0.0)), F.lit(1.0))


def allele_copies(absolute: Column, baf: Column) -> tuple[Column, Column, Column]:
    """(cn, cn1, cn2): total, major and minor copies; the latter null where there is no BAF and copies remain."""
    cn = F.bround(absolute).cast("long")
    upper = F.coalesce(F.abs(baf - 0.5) + 0.5, F.lit(1.0))
    major = F.least(F.greatest(F.bround(absolute * upper).cast("long"), F.lit(0).cast("long")), cn)
    known = baf.isNotNull() | (cn == 0)
    return cn, F.when(known, major), F.when(known, cn - major)


def expect_flat(haploid_x: bool = False) -> Column:
    """log2 of a normal reference."""
    return F.when(_on("Y") | (F.lit(haploid_x) & _on("X")), -1.0).otherwise(0.0)


def shift_xx(log2: Column, haploid_x: bool, female: bool) -> Column:
    """log2 with X moved to what a diploid-X sample against a diploid-X reference shows."""
    shift = (1.0 if not female and not haploid_x else 0.0) - (1.0 if female and haploid_x else 0.0)
    return log2 + F.when(_on("X"), shift).otherwise(0.0)


def squash_runs(df: DataFrame, level: Column, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Neighbouring segments of a chromosome (and sample, by ``keys``) with one level as one: weighted means, summed probes and weights."""
    keys = [*(keys or []), "chromosome"]
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__level", level)
    new = F.lag("__level").over(w).isNotNull() & F.col("__level").isNotNull() & (F.lag("__level").over(w) != F.col("__level"))
    rows = rows.withColumn("__run", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    means = {c: stats.weighted_mean(c, "weight") for c in ("log2", "depth", "baf") if c in df.columns}
    return rows.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[v.alias(k) for k, v in means.items()], F.sum("weight").alias("weight"), F.sum("probes").alias("probes")).drop("__run")


def ampdel_level() -> Column:
    """Deep losses and gains of five copies or more, each a level; all else is one."""
    return F.when(F.col("cn") == 0, -1).when(F.col("cn") >= 5, 1).otherwise(0)


def neutral_level(neutral: Column, order: list[str], keys: list[str] | None = None) -> Column:
    """0 for neutral segments, a level of its own for every other."""
    return F.when(neutral, 0).otherwise(F.row_number().over(Window.partitionBy(*(keys or []), "chromosome").orderBy(*order)))
