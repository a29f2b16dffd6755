"""Reports on bins and segments, and the tables that exports are made of."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chrom, stats
from . import calling
from .filters import label
from .intervals import overlap_join

ANTITARGETS, IGNORED = ("Antitarget", "Background"), ("-", ".", "CGH")


def sex_medians(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median log2 of X, Y and the autosomes."""
    name = F.upper(chrom.bare(F.col("chromosome")))
    median = lambda ok: F.percentile(F.when(ok, F.col("log2")), 0.5)
    return df.groupBy(*keys).agg(median(name == "X").alias("x"), median(name == "Y").alias("y"), median(chrom.is_autosome(F.col("chromosome"))).alias("a"))


def guess_xx(df: DataFrame, keys: list[str], haploid_x: bool = False) -> DataFrame:
    """Medians with ``xx``: whether X and Y lie closer to a female's than a male's expectation; null without X."""
    female, male = (-1.0, 0.0) if haploid_x else (0.0, 1.0)
    x, y = F.col("x") - F.col("a"), F.col("y") - F.col("a")
    lean = lambda r, f, m: F.abs(r + f) / F.greatest(F.abs(r + m), F.lit(1e-6))
    is_male = (lean(x, female, male) > 1) & F.coalesce(lean(y, 20.0, 0.0) > 1, F.lit(True))
    return sex_medians(df, keys).withColumn("xx", F.when(F.col("x").isNotNull(), ~is_male))


def gene_metrics(df: DataFrame, threshold: float = 0.2, min_probes: int = 3) -> DataFrame:
    """Genes whose weighted log2 is at least the threshold either way, over enough bins."""
    rows = df.withColumn("gene", F.explode(F.split("gene", ","))).filter(~F.col("gene").isin(*ANTITARGETS, *IGNORED))
    out = rows.groupBy("gene", "chromosome").agg(F.min("start").alias("start"), F.max("end").alias("end"), stats.weighted_mean("log2", "weight").alias("log2"), F.sum("weight").alias("weight"), F.count("*").alias("probes"))
    return out.filter((F.abs("log2") >= threshold) & (F.col("probes") >= min_probes))


def metrics(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of residuals: standard deviation, scaled MAD, interquartile range."""
    spread = residuals.groupBy(*keys).agg(F.stddev_pop("residual").alias("stdev"), stats.iqr("residual").alias("iqr"))
    return spread.join(stats.mad(residuals, keys, "residual"), keys)


def segment_metrics(bins: DataFrame, segments: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """Per segment: bins, mean, median, spread about the segment's log2, and the interval of its bins."""
    away = F.col("log2") - F.col("r_log2")
    found = overlap_join(bins, segments).groupBy(F.col(f"r_{key}").alias(key)).agg(
        F.count("*").alias("n"), F.avg("log2").alias("mean"), F.percentile("log2", 0.5).alias("median"), F.stddev_pop(away).alias("stdev"), F.avg(away * away).alias("mse"),
        (F.percentile(away, 0.75) - F.percentile(away, 0.25)).alias("iqr"), F.percentile("log2", alpha / 2).alias("pi_lo"), F.percentile("log2", 1 - alpha / 2).alias("pi_hi"),
    )
    return segments.select(key).join(found, key, "left").fillna(0, ["n"])


def instability(segments: DataFrame, ploidy: int = 2) -> DataFrame:
    """One row: the altered share of autosomal bases, and altered segments."""
    size, changed = F.col("end") - F.col("start"), F.col("cn") != ploidy
    rows = segments.filter(chrom.is_autosome(F.col("chromosome")))
    return rows.agg((F.sum(F.when(changed, size)) / F.sum(size)).alias("fraction"), F.sum(changed.cast("long")).alias("n"))


def breaks(bins: DataFrame, segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ends of segments (of a sample, by ``keys`` of the segments) that fall within a gene, with the change in log2 and the gene's bins on either side."""
    keys = keys or []
    w = Window.partitionBy(*keys, "chromosome").orderBy("start")
    ends = segments.withColumns({"after": F.lead("log2").over(w)}).filter("after IS NOT NULL")
    ends = ends.select(*keys, "chromosome", F.col("end").alias("start"), (F.col("end") + 1).alias("end"), (F.col("after") - F.col("log2")).alias("change")).distinct()
    named = bins.filter(~F.col("gene").isin(*ANTITARGETS, *IGNORED))
    genes = named.groupBy("chromosome", "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    hits = overlap_join(ends, genes).filter("start > r_start").select(*keys, "chromosome", F.col("r_gene").alias("gene"), F.col("start").alias("at"), "change", F.col("r_n").alias("n"))
    # breaks among their gene's bins in one order, each before a bin that starts there: a running count, no pairs of breaks and bins
    rows = hits.unionByName(named.select("chromosome", "gene", F.col("start").alias("at")), allowMissingColumns=True)
    before = Window.partitionBy("chromosome", "gene").orderBy("at", F.col("n").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("probes_left", F.sum(F.col("n").isNull().cast("long")).over(before)).filter("n IS NOT NULL")
    return rows.select(*keys, "chromosome", "gene", "at", "change", "probes_left", (F.col("n") - F.col("probes_left")).alias("probes_right"))


def gistic_markers(df: DataFrame) -> DataFrame:
    return df.select("chromosome", F.explode(F.array("start", "end")).alias("pos")).distinct()


def export_bed(segments: DataFrame, name: str, show: str = "variant", ploidy: int = 2, female: bool = True) -> DataFrame:
    """BED rows with a label and copies: all, those not of the ploidy, or those not as expected."""
    keep = {"all": F.lit(True), "ploidy": F.col("cn") != ploidy, "variant": F.col("cn") != calling.expected_copies(ploidy, female)}[show]
    return segments.filter(keep).select("chromosome", "start", "end", F.lit(name).alias("label"), "cn")


def export_seg(segments: DataFrame) -> DataFrame:
    return segments.select(F.col("sample_id").alias("id"), F.col("chromosome").alias("chrom"), (F.col("start") + 1).alias("loc_start"), F.col("end").alias("loc_end"), F.col("probes").alias("num_mark"), F.col("log2").alias("seg_mean"))


def export_vcf(segments: DataFrame, female: bool = True, ploidy: int = 2) -> DataFrame:
    """Duplications and deletions as VCF fields."""
    expect, cn = calling.expected_copies(ploidy, female), F.col("cn")
    gain = cn > expect
    kind, size = F.when(gain, "DUP").otherwise("DEL"), (F.col("end") - F.col("start")).cast("string")
    info = F.concat_ws(";", kind, F.concat(F.lit("END="), F.col("end").cast("string")), F.concat(F.lit("SVLEN="), F.when(gain, "").otherwise("-"), size), F.concat(F.lit("PROBES="), F.col("probes").cast("string")))
    genotype = F.when(gain, "0/1").when(cn == 0, "1/1").otherwise("0/1")
    return segments.filter(cn != expect).select(F.col("chromosome").alias("chrom"), F.greatest(F.col("start"), F.lit(1)).alias("pos"), F.lit("N").alias("ref"), F.concat(F.lit("<"), kind, F.lit(">")).alias("alt"), info.alias("info"), genotype.alias("gt"))


def export_nexus(df: DataFrame) -> DataFrame:
    return df.select("chromosome", "start", "end", "gene", "log2", label().alias("probe"))


def merge_samples(df: DataFrame, samples: list[str]) -> DataFrame:
    """One row a bin, one column a sample."""
    name = F.concat("chromosome", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(":"), "gene")
    return df.groupBy(name.alias("clid")).pivot("sample_id", samples).agg(F.avg("log2"))


def export_theta(segments: DataFrame, depth: int = 500, width: int = 200, read: int = 100) -> DataFrame:
    """Read counts of autosomal segments in the tumor and a normal."""
    bases = F.col("probes") * width * depth
    rows = segments.filter(chrom.is_autosome(F.col("chromosome")))
    tumor = F.floor(bases * stats.power_of_2()(F.col("log2").cast("double")) / read)  # the last bit decides where the count is whole
    return rows.select("seg_id", chrom.bare(F.col("chromosome")).cast("int").alias("chrm"), "start", "end", tumor.cast("long").alias("tumor"), F.floor(bases / read).cast("long").alias("normal"))


def het_density_rejects_haploid(hets: int, total: int, rate: float = 0.05, alpha: float = 0.001, least: int = 10) -> bool:
    """Whether so many heterozygous variants on X are too many for one copy: upper tail of a binomial."""
    if total < least:
        return False
    return sum(math.comb(total, k) * rate**k * (1 - rate) ** (total - k) for k in range(hets, total + 1)) < alpha
