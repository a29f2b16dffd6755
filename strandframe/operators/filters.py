"""Projections, predicates and equi-joins of bins, segments and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chrom

#: Log2 of a bin without coverage, least log2 of a reference bin, most spread, GC bounds (fixed values).
NULL_LOG2, MIN_REF_LOG2, MAX_SPREAD, GC = -20.0, -5.0, 1.0, (0.3, 0.7)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Double columns with NaN as null, which is how this engine marks what is missing."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def label() -> Column:
    return F.concat("chromosome", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"))


def autosomes(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows on numbered chromosomes (and those in ``also``); all rows if no name is numbered."""
    numbered = chrom.is_autosome(F.col("chromosome"))
    if df.filter(numbered).isEmpty():
        return df
    return df.filter(numbered | F.col("chromosome").isin(*also))


def drop_low_coverage(df: DataFrame, floor: float = NULL_LOG2 - MIN_REF_LOG2) -> DataFrame:
    """Without bins of log2 below the floor or null, or depth 0 or null."""
    out = df.filter(F.col("log2") >= floor)
    return out.filter(F.col("depth") != 0) if "depth" in df.columns else out


def bad_bin(columns: tuple[str, ...] = ("log2", "depth", "gc"), most_log2: float = -MIN_REF_LOG2, spread: float = MAX_SPREAD, gc: tuple[float, float] = GC) -> Column:
    """True for bins that a reference should not use; every term counts null as bad."""
    terms = {
        "log2": F.abs("log2") <= most_log2, "spread": F.col("spread") <= spread, "depth": F.col("depth") != 0, "gc": F.col("gc").between(*gc),
    }
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(terms[c], F.lit(False))
    return ~good


def heterozygous(df: DataFrame) -> DataFrame:
    """Variants of zygosity neither 0 nor 1 (of the normal, if there is one); all of them if none is."""
    z = F.col("n_zygosity" if "n_zygosity" in df.columns else "zygosity")
    out = df.filter((z != 0) & (z != 1))
    return df if "zygosity" not in df.columns or out.isEmpty() else out


def zygosity_from_freq(df: DataFrame, het: float = 0.25, hom: float = 0.75) -> DataFrame:
    """Zygosity set by allele frequency, for the zygosity columns there are."""
    recode = lambda f: F.when(F.col(f) >= hom, 1.0).when(F.col(f) >= het, 0.5).otherwise(0.0)
    return df.withColumns({z: recode(f) for z, f in (("zygosity", "alt_freq"), ("n_zygosity", "n_alt_freq")) if z in df.columns})


def match_reference(rows: DataFrame, ref: DataFrame, strict: bool = False) -> DataFrame:
    """rows with the reference's columns by exact coordinates; strict: a bin twice in ref or missing there is an error."""
    keys = ["chromosome", "start", "end"]
    if strict:
        if not ref.groupBy(keys).count().filter("count > 1").isEmpty():
            raise ValueError("the reference has a bin twice")
        if not rows.join(ref, keys, "left_anti").isEmpty():
            raise ValueError("the reference lacks bins of the sample")
    return rows.join(ref, keys, "left")


def shared_chroms(df: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        df = df.join(other.select("chromosome").distinct(), "chromosome", "left_semi")
    return df


def missing_chroms(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows on chromosomes that other lacks."""
    return df.join(other.select("chromosome").distinct(), "chromosome", "left_anti")


def bins_before(rows: DataFrame, bins: DataFrame) -> DataFrame:
    """rows with ``before``: how many bins of the chromosome start before the row. One running count over both tables."""
    from .scan import running

    names = rows.columns
    a = bins.select("chromosome", "start", F.lit(1).alias("__bin"), F.lit(1).alias("__after"))
    b = rows.withColumns({"__bin": F.lit(0), "__after": F.lit(0)})  # at equal starts rows come first
    both = b.unionByName(a, allowMissingColumns=True)
    return running(both, ["chromosome"], ["start", "__after"], "before", F.col("__bin")).filter("__bin = 0").select(*names, "before")
