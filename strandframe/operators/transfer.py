"""Fields that segments take from their bins, and copy numbers from another caller's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chrom import is_autosome, sort_key
from .intervals import overlap_join

#: Names that are no genes (fixed values).
IGNORE = ("-", ".", "CGH", "Antitarget", "Background")


def stretch(segments: DataFrame, bins: DataFrame, key: str) -> DataFrame:
    """Segments of which each chromosome's first and last reach to its first and last bin. Fails where a chromosome has no bins."""
    reach = bins.groupBy("chromosome").agg(F.min("start").alias("__lo"), F.max(F.struct("start", "end"))["end"].alias("__hi"))
    place = F.struct("start", "end", key)
    ends = segments.groupBy("chromosome").agg(F.min(place)[key].alias("__first"), F.max(place)[key].alias("__last")).join(reach, "chromosome", "left")
    unknown = F.raise_error(F.concat(F.lit("segments on a chromosome without bins: "), "chromosome")).cast("long")
    ends = ends.withColumn("__lo", F.coalesce("__lo", unknown))
    start = F.when(F.col(key) == F.col("__first"), F.col("__lo")).otherwise(F.col("start"))
    end = F.when(F.col(key) == F.col("__last"), F.col("__hi")).otherwise(F.col("end"))
    return segments.join(ends, "chromosome").withColumns({"start": start, "end": end}).select(segments.columns)


def transfer_fields(segments: DataFrame, bins: DataFrame, key: str, ignore: tuple[str, ...] = IGNORE) -> DataFrame:
    """Stretched segments with gene (distinct names in the order of the bins, "-" for none), weight (sum) and depth (weighted mean).

    Bins without weight don't count; a segment without bins has weight and depth 0. Bins are summed by (segment, gene)
    first, so that a long segment gathers its names, not its bins.
    """
    out = stretch(segments, bins, key)
    depth = F.col("depth") if "depth" in bins.columns else F.pow(F.lit(2.0), F.col("log2"))
    weight = F.col("weight") if "weight" in bins.columns else F.lit(1.0)
    rows = bins.select("chromosome", "start", "end", "gene", depth.alias("depth"), weight.alias("weight"))
    pairs = overlap_join(rows, out.select("chromosome", "start", "end", key))
    sums = (F.sum("weight").alias("w"), F.sum(F.col("depth") * F.col("weight")).alias("dw"))
    by_name = pairs.groupBy(F.col(f"r_{key}").alias(key), "gene").agg(F.min(F.struct("start", "end")).alias("at"), *sums)
    named = F.array_sort(F.collect_list(F.struct("at", "gene")))
    split = F.array_distinct(F.flatten(F.transform(F.filter(named, lambda x: x["gene"].isNotNull()), lambda x: F.split(x["gene"], ","))))
    names = F.array_join(F.filter(split, lambda x: (x != "") & ~x.isin(*ignore)), ",")
    found = by_name.groupBy(key).agg(names.alias("gene"), F.sum("w").alias("weight"), F.sum("dw").alias("dw"))
    gone = [c for c in out.columns if c in ("gene", "weight", "depth")]
    out = out.drop(*gone).join(found, key, "left")
    weight = F.coalesce("weight", F.lit(0.0))
    fields = {"gene": F.coalesce(F.nullif("gene", F.lit("")), F.lit("-")), "weight": weight, "depth": F.when(weight > 0, F.col("dw") / weight).otherwise(0.0)}
    return out.withColumns(fields).drop("dw")


def positions(df: DataFrame, name: str = "row") -> DataFrame:
    """df with the number of each row from 0, in genome order; no window spans the table, only the list of its chromosomes."""
    sizes = df.groupBy("chromosome").agg(F.count("*").alias("__n"))
    before = Window.orderBy(*sort_key(F.col("chromosome")), "chromosome").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("chromosome", "__before")
    nth = F.row_number().over(Window.partitionBy("chromosome").orderBy("start", "end"))
    return df.join(sizes, "chromosome").withColumn(name, F.col("__before") + nth - 1).drop("__before")


def import_theta(segments: DataFrame, theta: DataFrame, ploidy: float = 2.0) -> DataFrame:
    """Autosomal segments with the cn of each solution of sources.results.read_theta, and log2 of it (0 counts as 0.5).

    Every solution is laid on the same rows; those it leaves unknown are dropped from it alone.
    """
    rows = positions(segments.filter(is_autosome(F.col("chromosome"))))
    known = theta.filter("copies IS NOT NULL").select("solution", "row", F.col("copies").alias("cn"))
    log2 = F.log2(F.greatest(F.col("cn").cast("double"), F.lit(0.5)) / ploidy)
    keep = [c for c in segments.columns if c not in ("cn", "log2")]
    return rows.select(*keep, "row").join(known, "row").select("solution", *keep, "cn", log2.alias("log2"))
