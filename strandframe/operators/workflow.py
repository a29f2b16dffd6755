"""The steps of the workflow that are compositions: bins, coverage, reference, correction, expression."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chrom
from ..functions import kernels as kn
from . import intervals as iv
from .filters import NULL_LOG2
from .segmentation import by_sample, numbers
from .signal import center_all, edge_bias

#: SAM flags of reads that don't count: unmapped, secondary, failed, duplicate (fixed value).
SKIP_FLAGS = 0x704
TARGET_SIZE, ANTITARGET_SIZE, SHRINK, ACCESS_GAP = 200 / 0.75, 150_000, 500, 5000


def access(runs: DataFrame, exclude: DataFrame | None = None, min_gap: int = ACCESS_GAP) -> DataFrame:
    """Accessible regions: sequenced runs less exclusions, small gaps joined."""
    return iv.join_regions(iv.subtract(runs, exclude) if exclude is not None else runs, min_gap)


def targets(baits: DataFrame, split: bool = True, avg_size: float = TARGET_SIZE) -> DataFrame:
    """Baits merged where they overlap, cut to bins, named by the baits that cover each."""
    rows = baits.filter(F.col("end") > F.col("start"))
    tiles = iv.merge(rows, bp=1)
    if split:
        span = F.col("end") - F.col("start")
        tiles = tiles.withColumns({"s": span, "n": F.greatest(F.bround(span / avg_size).cast("long"), F.lit(1))}).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        at = lambda i: F.col("start") + (i * F.col("s") / F.col("n")).cast("long")
        tiles = tiles.select("chromosome", at(F.col("i")).alias("start"), at(F.col("i") + 1).alias("end"))
    named = iv.overlap_join(rows, tiles).groupBy(*[F.col(f"r_{c}").alias(f"t_{c}") for c in ("chromosome", "start", "end")]).agg(iv.labels().alias("gene"))
    return named.withColumnsRenamed({"t_chromosome": "chromosome", "t_start": "start", "t_end": "end"})


def antitargets(target: DataFrame, accessible: DataFrame, avg_size: int = ANTITARGET_SIZE, min_size: int | None = None) -> DataFrame:
    """Bins of accessible regions (shrunk) away from targets (grown)."""
    free = iv.subtract(iv.resize(accessible.select("chromosome", "start", "end"), -SHRINK), iv.resize(target.select("chromosome", "start", "end"), SHRINK))
    return iv.subdivide(free, avg_size, 2 * int(avg_size * 2**-5) if min_size is None else min_size).withColumn("gene", F.lit("Antitarget"))


def coverage(blocks: DataFrame, bins: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Mean depth and log2 of bins, from alignment blocks (chromosome, start, end, flag, mapq)."""
    good = blocks.filter((F.col("flag").bitwiseAND(SKIP_FLAGS) == 0) & (F.col("mapq") >= min_mapq))
    keys = ["chromosome", "start", "end", "gene"]
    sums = iv.overlap_join(good.select("chromosome", "start", "end"), bins.select(keys).distinct(), "trim").groupBy(*[F.col(f"r_{k}").alias(f"b_{k}") for k in keys]).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    out = bins.join(sums, [bins[k] == sums[f"b_{k}"] for k in keys], "left").select(*bins.columns, F.coalesce("bases", F.lit(0)).alias("bases"))
    depth = F.col("bases") / (F.col("end") - F.col("start"))
    return out.withColumn("depth", depth).withColumn("log2", log2_or_null(F.col("depth"))).drop("bases")


def log2_or_null(x: Column) -> Column:
    """log2, with NULL_LOG2 for 0."""
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(NULL_LOG2))


def bin_size(depth: float, per_bin: float = 1e5, least: int = 20, most: int = 50_000) -> int:
    return int(min(max(round(per_bin / depth), least), most)) if depth > 0 else most


def reference(samples: DataFrame, haploid_x: bool = False, female: list[str] | None = None) -> DataFrame:
    """Pooled reference per bin: biweight centre of log2, of the samples beside a flat one, and of depth; the spread of log2 about it.

    Samples are centred, moved to the flat expectation, and their sex chromosomes made comparable: a female's Y is set to -1,
    a male's X and Y are raised by 1. female: the ids of female samples; None for all.
    """
    from .calling import expect_flat

    keys = ["chromosome", "start", "end", "gene"]
    name = F.upper(chrom.bare(F.col("chromosome")))
    is_female = F.lit(True) if female is None else F.col("sample_id").isin(female)
    log2 = F.col("log2") + F.col("flat")
    log2 = F.when(is_female & (name == "Y"), -1.0).when(~is_female & name.isin("X", "Y"), log2 + 1).otherwise(log2)
    rows = center_all(samples, ["sample_id"]).withColumn("flat", expect_flat(haploid_x)).withColumn("log2", log2)

    @F.pandas_udf("log2 double, depth double, spread double")
    def pooled(log2: pd.Series, depth: pd.Series) -> pd.DataFrame:
        out = np.full((len(log2), 3), np.nan)
        size = log2.map(len).to_numpy()
        for k in np.unique(size):  # bins of as many samples are one table
            at = np.flatnonzero(size == k)
            x = np.stack([log2.iloc[i] for i in at]).astype(float)
            out[at, 0] = kn.biweight_locations(x)
            out[at, 2] = kn.biweight_spreads(x, out[at, 0])
        size = depth.map(len).to_numpy()
        for k in np.unique(size[size > 0]):
            at = np.flatnonzero(size == k)
            out[at, 1] = kn.biweight_locations(np.stack([depth.iloc[i] for i in at]).astype(float))
        return pd.DataFrame(out, columns=["log2", "depth", "spread"])

    # one array a bin, as long as there are samples
    rows = rows.groupBy(*keys).agg(F.concat(F.array(F.first("flat")), F.array_sort(F.collect_list("log2"))).alias("x"), F.array_sort(F.collect_list("depth")).alias("d"))
    return rows.select(*keys, pooled("x", "d").alias("p")).select(*keys, "p.*")


def flat_reference(bins: DataFrame, haploid_x: bool = False) -> DataFrame:
    from .calling import expect_flat

    return bins.withColumns({"log2": expect_flat(haploid_x), "depth": F.pow(F.lit(2.0), expect_flat(haploid_x)), "spread": F.lit(0.0)})


def fix(sample: DataFrame, ref: DataFrame, fraction: float = 0.1) -> DataFrame:
    """A sample's log2 ratios: centred, corrected for GC (if the reference has it) and edges, less the reference, weighted by size and spread.

    All that takes the whole sample, centres too, is done in one pass over its rows: Spark would make them again for each.
    """
    keys = ["chromosome", "start", "end", "gene"]
    rows = sample.join(ref.select(*keys, F.col("log2").alias("ref_log2"), "spread", *(["gc"] if "gc" in ref.columns else [])), keys)
    rows = edge_bias(rows, ["start", "end", "gene", "log2"], keys=["sample_id"])
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    biases = [c for c in ("gc", "edge") if c in rows.columns]

    def corrected(column) -> dict[str, np.ndarray]:
        of, log2 = autosomes(column("chromosome")), numbers(column("log2"))
        log2 = log2 - kn.centre(log2, of)
        for key in biases:
            log2 = kn.center_by_window(log2, numbers(column(key)), fraction)
        log2 = log2 - numbers(column("ref_log2"))
        log2 = log2 - kn.centre(log2, of)
        spread, size = numbers(column("spread")) ** 2, np.sqrt(numbers(column("end")) - numbers(column("start")))
        with np.errstate(divide="ignore", invalid="ignore"):
            by_size = np.fmin(np.fmax(1 - spread / (size / np.mean(size)), 1e-4), 1.0)
        return {"log2": log2, "weight": np.fmin(np.fmax(0.9 * (1 - spread) + 0.1 * by_size, 1e-4), 1.0)}

    rows = by_sample(rows, "sample_id", ["log2", "weight"], corrected)
    return rows.select("sample_id", *[c for c in rows.columns if c not in ("sample_id", "ref_log2", "edge")])


def autosomes(chromosome: pa.ChunkedArray) -> np.ndarray:
    """The number of each row's chromosome among the autosomes, -1 for others."""
    coded = chromosome.dictionary_encode().combine_chunks()
    at = [i if re.fullmatch(chrom.AUTOSOME, name) else -1 for i, name in enumerate(coded.dictionary.to_pylist())]
    return np.array([*at, -1], np.int32)[coded.indices.fill_null(len(at)).to_numpy(zero_copy_only=False)]


def gc_content(bins: DataFrame, sequence: DataFrame) -> DataFrame:
    """bins with gc and rmask from pieces of sequence (chromosome, start, end, seq): shares of G and C, and of lower case, among ACGT."""
    cut = iv.overlap_join(sequence, bins.select("chromosome", "start", "end").distinct())
    part = F.expr("substring(seq, cast(greatest(r_start - start, 0) + 1 AS int), cast(least(r_end, end) - greatest(r_start, start) AS int))")
    count = lambda letters: F.length(part) - F.length(F.translate(part, letters, ""))
    sums = cut.groupBy(F.col("r_chromosome").alias("c"), F.col("r_start").alias("s"), F.col("r_end").alias("e")).agg(F.sum(count("GCgc")).alias("gc"), F.sum(count("acgt")).alias("low"), F.sum(count("ACGTacgt")).alias("all"))
    share = lambda x: F.when(F.col("all") > 0, F.col(x) / F.col("all")).otherwise(0.0)
    out = bins.join(sums, [bins.chromosome == sums.c, bins.start == sums.s, bins.end == sums.e], "left")
    return out.select(*[bins[c] for c in bins.columns if c not in ("gc", "rmask")], F.coalesce(share("gc"), F.lit(0.0)).alias("gc"), F.coalesce(share("low"), F.lit(0.0)).alias("rmask"))


def normalize_expression(counts: DataFrame, rounds: int = 4) -> DataFrame:
    """(gene, sample, count) with ``log2``: repeatedly divided by the sample's upper quartile and the gene's median."""
    rows = counts.withColumn("x", F.col("count").cast("double") + 0.5)
    for _ in range(rounds):
        rows = rows.join(rows.groupBy("sample").agg(F.percentile("x", 0.75).alias("q")), "sample").withColumn("x", F.col("x") / F.col("q")).drop("q")
        rows = rows.join(rows.groupBy("gene").agg(F.percentile("x", 0.5).alias("m")), "gene").withColumn("x", F.col("x") / F.col("m")).drop("m")
    return rows.withColumn("log2", F.greatest(F.log2("x"), F.lit(-5.0))).drop("x")


def sample_correlation(samples: DataFrame) -> DataFrame:
    """(a, b, r) for pairs of samples over their shared bins."""
    keys = ["chromosome", "start", "end", "gene"]
    rows = samples.groupBy(*keys, "sample_id").agg(F.avg("log2").alias("x"))
    other = rows.select(*keys, F.col("sample_id").alias("b"), F.col("x").alias("y"))
    return rows.withColumnRenamed("sample_id", "a").join(other, keys).filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))


def chromosome_sizes(df: DataFrame) -> DataFrame:
    k1, k2 = chrom.sort_key(F.col("chromosome"))
    return df.groupBy("chromosome").agg(F.max("end").alias("size")).orderBy(k1, k2)
