"""Contig, probe and region screens, gene look-ups and runs of covered positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chrom
from .filters import bad_bin
from .intervals import overlap_join
from .reports import ANTITARGETS, IGNORED
from .scan import running

#: Largest relative drop between neighbouring chromosome sizes that is not the edge of the big ones (fixed value).
BIG_DROP = 0.5


def big_chroms(sizes: DataFrame) -> DataFrame:
    """One row (n_big, thresh): how many of the (chromosome, size) rows are big, and the least big size.

    Big ones end at the first drop by more than half. A drop after the very largest counts only if there is a later one.
    The window runs over one row a contig.
    """
    w = Window.orderBy(F.col("size").desc())
    rows = sizes.select("size", F.row_number().over(w).alias("nth"), F.lead("size").over(w).alias("below"))
    rows = rows.withColumn("drop", (F.col("size") - F.col("below")) / F.col("size") > BIG_DROP)
    edge = rows.agg(F.min(F.when(F.col("drop"), F.col("nth"))).alias("first"), F.max(F.when(F.col("drop"), F.col("nth"))).alias("last"), F.count("*").alias("n"))
    edge = edge.select(F.when(F.col("last") > 1, F.col("first")).otherwise(F.col("n")).cast("long").alias("n_big"))
    return rows.join(F.broadcast(edge), F.col("nth") == F.col("n_big")).select("n_big", F.col("size").alias("thresh"))


def drop_short_contigs(df: DataFrame) -> DataFrame:
    """Rows on big chromosomes, by the ends of the rows."""
    sizes = df.groupBy("chromosome").agg(F.max("end").alias("size"))
    kept = sizes.join(F.broadcast(big_chroms(sizes)), F.col("size") >= F.col("thresh")).select("chromosome")
    return df.join(F.broadcast(kept), "chromosome", "left_semi")


def is_canonical(name: Column) -> Column:
    """A numbered chromosome, X, Y, or a Roman numeral."""
    return F.upper(chrom.bare(name)).rlike("^([0-9]+|[XYZW]|[IVXL]+)$")


def drop_noncanonical(access: DataFrame, targets: DataFrame) -> DataFrame:
    """access without contigs that hold no target and are not canonical; where no target's is, without those of longer names than the targets'."""
    named = targets.select("chromosome").distinct()
    seen = named.agg(F.max(is_canonical(F.col("chromosome"))).alias("any"), F.max(F.length("chromosome")).alias("longest"))
    own = access.select("chromosome").distinct().join(named.withColumn("hit", F.lit(True)), "chromosome", "left").join(F.broadcast(seen))
    keep = F.col("hit").isNotNull() | F.when(F.col("any"), is_canonical(F.col("chromosome"))).otherwise(F.length("chromosome") <= F.col("longest"))
    return access.join(F.broadcast(own.filter(keep).select("chromosome")), "chromosome", "left_semi")


def drop_small(df: DataFrame, min_length: int) -> DataFrame:
    return df.filter(F.col("end") - F.col("start") >= min_length)


def enriched(df: DataFrame, mode: float, ratio: float = 0.1) -> DataFrame:
    """Rows whose depth is at least a share of the modal depth."""
    return df.filter(F.col("depth") / F.lit(mode) >= ratio)


def targets_only(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("gene").isin(*ANTITARGETS))


def antitargets_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("gene").isin(*ANTITARGETS))


def expressed(counts: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Of (gene, sample, count) the genes with a count of at least 1 in that fraction of the samples."""
    kept = counts.groupBy("gene").agg(F.percentile("count", 1.0 - fraction).alias("q")).filter("q >= 1").select("gene")
    return counts.join(kept, "gene", "left_semi")


def bad_bins_by_gene(reference: DataFrame, columns: tuple[str, ...] = ("log2", "depth")) -> DataFrame:
    """(gene, n_bins, n_bad) of the genes with bins that a reference should not use."""
    return reference.groupBy("gene").agg(F.count("*").alias("n_bins"), F.sum(bad_bin(columns).cast("long")).alias("n_bad")).filter("n_bad > 0")


def status(x: str | None = "chrX", y: str | None = "chrY", alleles: bool = False) -> Column:
    """'altered' or 'neutral' of a called segment; on X and Y each sex's copies are neutral, elsewhere unlike alleles are altered too."""
    at = lambda name: F.lit(False) if name is None else F.col("chromosome") == name
    neutral = F.when(at(x), F.col("cn").isin(1, 2)).when(at(y), F.col("cn").isin(0, 1)).otherwise(F.col("cn") == 2)
    if alleles:
        neutral = neutral & (at(x) | at(y) | F.coalesce(F.col("cn1") == F.col("cn2"), F.lit(True)))
    return F.when(neutral, "neutral").otherwise("altered")


def genes_by_name(bins: DataFrame, names: list[str]) -> DataFrame:
    """(chromosome, start, end, gene): the span of each named gene; genes of one span share a row. Unknown names and names on two chromosomes are errors."""
    rows = bins.withColumn("name", F.explode(F.split("gene", ","))).filter(F.col("name").isin(*names))
    spans = rows.groupBy("name").agg(F.min("chromosome").alias("chromosome"), F.max("chromosome").alias("other"), F.min("start").alias("start"), F.max("end").alias("end"))
    found = {r["name"]: r["chromosome"] == r["other"] for r in spans.select("name", "chromosome", "other").limit(len(names)).collect()}
    for name in names:
        if not found.get(name, False):
            raise ValueError(f"{name} is on more than one chromosome" if name in found else f"no gene is named {name}")
    return spans.groupBy("chromosome", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("gene"))


def genes_by_range(bins: DataFrame, chromosome: str, start: int, end: int) -> DataFrame:
    """(gene, start, end) of the genes with bins in a range: from their first bin's start there to their last one's end."""
    rows = bins.filter((F.col("chromosome") == chromosome) & (F.col("end") > start) & (F.col("start") < end) & ~F.col("gene").isin(*ANTITARGETS, *IGNORED))
    return rows.groupBy("gene").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"))


def segment_vafs(variants: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """(key, above, vaf): the median allele frequency above a half and below, each of more than one variant of a segment."""
    hit = overlap_join(variants.select("chromosome", "start", "end", "alt_freq"), segments.select("chromosome", "start", "end", key))
    found = hit.groupBy(F.col(f"r_{key}").alias(key), (F.col("alt_freq") > 0.5).alias("above")).agg(F.count("*").alias("n"), F.percentile("alt_freq", 0.5).alias("vaf"))
    return found.filter("n > 1").drop("n")


def in_ranges(df: DataFrame, ranges: DataFrame, mode: str = "outer") -> DataFrame:
    """Rows once for each of the ranges they meet, clipped to it if mode is trim."""
    return overlap_join(df, ranges.select("chromosome", "start", "end"), mode).select(df.columns)


def chrom_lengths(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """counts (by chromosome) with length: the bases that the regions of the chromosome have; chromosomes without are left out."""
    sizes = regions.groupBy("chromosome").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    return counts.drop("length").join(F.broadcast(sizes), "chromosome")


def merge_gaps(regions: DataFrame, min_gap: int) -> DataFrame:
    """Regions of a chromosome less than min_gap apart (and not overlapping) become one, with their depth weighted by length."""
    order = ["start", "end"]
    last = running(regions, ["chromosome"], order, "__nth", F.lit(1))
    before = last.select(F.col("chromosome").alias("__c"), (F.col("__nth") + 1).alias("__n"), F.col("end").alias("__end"))
    rows = last.join(before, (F.col("chromosome") == F.col("__c")) & (F.col("__nth") == F.col("__n")), "left")
    gap = F.col("start") - F.col("__end")
    head = F.when(F.col("__end").isNull() | ~gap.between(0, min_gap - 1), 1).otherwise(0)
    rows = running(rows, ["chromosome"], [*order, "__nth"], "__run", head, inclusive=True)
    size = F.col("end") - F.col("start")
    out = rows.groupBy("chromosome", "__run").agg(F.min("start").alias("start"), F.max_by("end", "__nth").alias("end"), (F.sum(F.col("depth") * size) / F.sum(size)).alias("depth"))
    return out.drop("__run")


def covered_runs(positions: DataFrame, min_depth: float) -> DataFrame:
    """(chromosome, start, end, depth): runs of neighbouring (chromosome, pos, depth) of at least min_depth, trimmed to where the depth is half of the run's peak.

    pos counts from 0 and stands once per chromosome. Depth is the mean over the trimmed run. Islands come from a running count by
    tile, so a chromosome is many tasks.
    """
    rows = positions.filter(F.col("depth") >= min_depth).withColumn("start", F.col("pos"))
    rows = running(rows, ["chromosome"], ["start"], "__nth", F.lit(1)).withColumn("__run", F.col("pos") - F.col("__nth"))
    keys = ["chromosome", "__run"]
    rows = rows.join(rows.groupBy(*keys).agg(F.max("depth").alias("__peak")), keys)
    ok = F.col("depth") >= F.col("__peak") / 2
    span = rows.groupBy(*keys).agg(F.min(F.when(ok, F.col("pos"))).alias("__from"), F.max(F.when(ok, F.col("pos"))).alias("__to"))
    rows = rows.join(span, keys).filter(F.col("pos").between(F.col("__from"), F.col("__to")))
    out = rows.groupBy(*keys).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.avg("depth").alias("depth"))
    return out.drop("__run")


def bedgraph_depth(regions: DataFrame, graph: DataFrame) -> DataFrame:
    """regions with basecount (depth times bases of the graph's intervals within) and depth; 0 where the graph has nothing.

    Chromosome names are matched with and without ``chr``. Regions are unique by (chromosome, start, end).
    """
    bare = lambda df: df.withColumn("chromosome", chrom.bare(F.col("chromosome")))
    spans = bare(regions.select("chromosome", "start", "end")).distinct()
    hit = overlap_join(bare(graph.select("chromosome", "start", "end", F.col("depth").alias("__d"))), spans, "trim")
    sums = hit.groupBy("r_chromosome", "r_start", "r_end").agg(F.sum(F.col("__d") * (F.col("end") - F.col("start"))).alias("basecount"))
    mine = [chrom.bare(regions["chromosome"]) == sums["r_chromosome"], regions["start"] == sums["r_start"], regions["end"] == sums["r_end"]]
    out = regions.join(sums, mine, "left").drop("r_chromosome", "r_start", "r_end").withColumn("basecount", F.coalesce("basecount", F.lit(0.0)))
    size = F.col("end") - F.col("start")
    return out.withColumn("depth", F.when(size > 0, F.col("basecount") / size).otherwise(0.0))


def drawn(df: DataFrame, seed: str) -> Column:
    """A hash of the row and a seed: ordering by it shuffles, alike on every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))


def shuffled(df: DataFrame, seed: str = "a5eed") -> DataFrame:
    return df.orderBy(drawn(df, seed))


def midsize_sample(regions: DataFrame, most: int, seed: str = "a5eed") -> DataFrame:
    """Up to ``most`` regions whose size lies between the quartiles of all sizes above 0, drawn by hash."""
    size = F.col("end") - F.col("start")
    ends = regions.filter(size > 0).agg(F.percentile(size, 0.25).alias("__lo"), F.percentile(size, 0.75).alias("__hi"))
    mid = regions.join(F.broadcast(ends), size.between(F.col("__lo"), F.col("__hi")), "left_semi")
    return mid.orderBy(drawn(mid, seed)).limit(most)


def midsize(files: DataFrame) -> DataFrame:
    """The (path, size) of median size, the lower one of an even number; the window runs over one row a file."""
    w = Window.orderBy("size", "path")
    nth = files.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return nth.filter(F.col("__i") == F.floor((F.col("__n") + 1) / 2)).drop("__i", "__n")


def top_breaks(breaks: DataFrame, most: int) -> DataFrame:
    """The breaks with most bins on their poorer side, then of largest change."""
    return breaks.orderBy(F.least("probes_left", "probes_right").desc(), F.abs("change").desc(), "chromosome", "gene", "at").limit(most)


def gene_intervals(bins: DataFrame) -> DataFrame:
    """(chromosome, gene, start, end, probes) of the targeted genes."""
    rows = bins.filter(~F.col("gene").isin(*ANTITARGETS, *IGNORED))
    return rows.groupBy("chromosome", "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("probes"))


def squashed_genes(bins: DataFrame, order: list[str]) -> DataFrame:
    """One row a gene and chromosome: the span, the median log2 and how many bins; antitarget and ignored bins stay as they are."""
    other = F.col("gene").isin(*ANTITARGETS, *IGNORED)
    first, last = F.struct(*order), F.struct(*order)
    genes = bins.filter(~other).groupBy("chromosome", "gene").agg(F.min_by("start", first).alias("start"), F.max_by("end", last).alias("end"), F.percentile("log2", 0.5).alias("log2"), F.count("*").alias("probes"))
    rest = bins.filter(other).select("chromosome", "gene", "start", "end", "log2", F.lit(1).cast("long").alias("probes"))
    return genes.unionByName(rest)
