"""Readers of interval, segment and variant text files. Coordinates come out 0-based half-open."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import nan_to_null

LONGS = ("start", "end", "probes", "cn", "cn1", "cn2", "nbaf")
STRINGS = ("chromosome", "gene", "ref", "alt", "strand", "sample_id")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file's base name as sample_id."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return spark.read.text(path).select("value", name.alias("sample_id")).filter(F.length(F.trim("value")) > 0)


def _fields(df: DataFrame, names: list[str], sep: str = "\t") -> DataFrame:
    parts = F.split("value", sep)
    return df.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)], "sample_id")


def read_tab(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header line: known columns get their types, others double where they can be; rows without log2 go."""
    df = spark.read.csv(path, sep="\t", header=True)
    names = [c.lower() if c.lower() in STRINGS + LONGS else c for c in df.columns]
    df = df.toDF(*names)
    numeric = [c for c in names if c not in STRINGS + LONGS]
    bad = df.agg(*[F.count(F.when(F.expr(f"try_cast(`{c}` AS double)").isNull() & F.col(f"`{c}`").isNotNull(), 1)).alias(c) for c in numeric]).first() if numeric else {}
    cast = {c: F.expr(f"cast(try_cast(`{c}` AS double) AS bigint)") for c in names if c in LONGS} | {c: F.expr(f"try_cast(`{c}` AS double)") for c in numeric if not bad[c]}
    out = nan_to_null(df.withColumns(cast))
    return out.filter("log2 IS NOT NULL") if "log2" in names else out


def read_bed(spark: SparkSession, path: str, columns: int = 6) -> DataFrame:
    """BED of 3 to 6 columns; only the first track of a file with several."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    second = rows.filter(F.col("value").startswith("track")).orderBy("n").limit(2).agg(F.max("n").alias("at"), F.count("*").alias("k")).filter("k = 2").first()
    if second:
        rows = rows.filter(F.col("n") < second["at"])
    rows = rows.filter(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    parts = F.split(F.trim("value"), r"\t| +")
    text = lambda i, default: F.coalesce(F.nullif(F.get(parts, i), F.lit("")), F.lit(default))
    every = [F.get(parts, 0).alias("chromosome"), F.get(parts, 1).cast("long").alias("start"), F.get(parts, 2).cast("long").alias("end"), text(3, "-").alias("gene"), F.expr("try_cast(get(split(trim(value), '\\\\t| +'), 4) AS double)").alias("score"), text(5, ".").alias("strand")]
    return rows.select(*every[: max(3, columns)])


def read_interval(spark: SparkSession, path: str) -> DataFrame:
    """Interval lists with a SAM header."""
    rows = _fields(_lines(spark, path).filter(~F.col("value").startswith("@")), ["chromosome", "start", "end", "strand", "gene"])
    return rows.select("chromosome", (F.col("start").cast("long") - 1).alias("start"), F.col("end").cast("long").alias("end"), "strand", F.coalesce("gene", F.lit("-")).alias("gene"))


def read_picard_hs(spark: SparkSession, path: str) -> DataFrame:
    """Per-target coverage tables."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(F.col("chrom").alias("chromosome"), (F.col("start").cast("long") - 1).alias("start"), F.col("end").cast("long").alias("end"), F.col("name").alias("gene"), F.col("%gc").cast("double").alias("gc"), F.col("mean_coverage").cast("double").alias("depth"), F.col("normalized_coverage").cast("double").alias("ratio"))


def read_gff(spark: SparkSession, path: str, tag: str = r"(Name|gene_id|gene_name|gene)", keep_type: str | None = None) -> DataFrame:
    rows = _fields(_lines(spark, path).filter(~F.col("value").startswith("#")), ["chromosome", "source", "type", "start", "end", "score", "strand", "phase", "attribute"])
    if keep_type:
        rows = rows.filter(F.col("type") == keep_type)
    gene = F.regexp_extract("attribute", tag + r'[= ]"?([^";]+)', 2)
    return rows.select("chromosome", (F.col("start").cast("long") - 1).alias("start"), F.col("end").cast("long").alias("end"), F.when(gene == "", "-").otherwise(gene).alias("gene"), "type", F.expr("try_cast(score AS double)").alias("score"), "strand", "attribute")


def read_refflat(spark: SparkSession, path: str, exons: bool = False, cds: bool = False) -> DataFrame:
    names = ["gene", "accession", "chromosome", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "exon_count", "exon_starts", "exon_ends"]
    rows = _fields(_lines(spark, path), names)
    longs = lambda c: F.transform(F.array_remove(F.split(c, ","), ""), lambda x: x.cast("long"))
    if exons:
        rows = rows.withColumn("x", F.explode(F.arrays_zip(longs("exon_starts").alias("s"), longs("exon_ends").alias("e"))))
        start, end = F.col("x.s"), F.col("x.e")
    else:
        start, end = F.col("cds_start" if cds else "tx_start").cast("long"), F.col("cds_end" if cds else "tx_end").cast("long")
    return rows.select("chromosome", (start - 1).alias("start"), end.alias("end"), "gene", "accession", "strand")


def read_seg(spark: SparkSession, path: str, names: dict[str, str] | None = None, prefix: str = "", from_log10: bool = False) -> DataFrame:
    """SEG files of 5 or 6 columns, any number of samples."""
    parts = F.transform(F.split("value", "\t"), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    rows = spark.read.text(path).filter(F.col("value").contains("\t")).select(parts.alias("p"))
    at = lambda i: F.get("p", i)
    wide = F.size("p") == 6
    log2 = F.when(wide, at(5)).otherwise(at(4))
    rows = rows.withColumns({"log2": F.expr("try_cast(CASE WHEN size(p) = 6 THEN p[5] ELSE p[4] END AS double)")}).filter("log2 IS NOT NULL")
    chromosome = at(1)
    for old, new in (names or {}).items():
        chromosome = F.when(at(1) == old, new).otherwise(chromosome)
    del log2
    value = F.col("log2") * 3.321928094887362 if from_log10 else F.col("log2")
    return rows.select(at(0).alias("sample_id"), F.concat(F.lit(prefix), chromosome).alias("chromosome"), (at(2).cast("double").cast("long") - 1).alias("start"), at(3).cast("double").cast("long").alias("end"), F.when(F.size("p") == 6, at(4).cast("long")).alias("probes"), value.alias("log2"))


def read_dict(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chromosome"), F.lit(0).cast("long").alias("start"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("end"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """chromosome:start-end and a name, 1-based."""
    cut = lambda i: F.regexp_extract("value", r"^(\w[\w.]*):(\d+)-(\d+)[\s:]*(\S*)", i)
    rows = spark.read.text(path).filter(cut(1) != "")
    return rows.select(cut(1).alias("chromosome"), (cut(2).cast("long") - 1).alias("start"), cut(3).cast("long").alias("end"), F.when(cut(4) == "", "-").otherwise(cut(4)).alias("gene"))


def _vcf_info(key: str) -> Column:
    return F.regexp_extract("info", rf"(?:^|;){key}=([^;]+)", 1)


def read_vcf_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of a VCF: the end from INFO, or what the ALT's extra length gives."""
    names = ["chromosome", "pos", "id", "ref", "alt", "qual", "filter", "info"]
    rows = _fields(_lines(spark, path).filter(~F.col("value").startswith("#")), names)
    start = F.col("pos").cast("long") - 1
    end = F.coalesce(F.expr("try_cast(regexp_extract(info, '(?:^|;)END=([^;]+)', 1) AS bigint)"), start + F.greatest(F.length("alt") - F.length("ref"), F.lit(0)))
    return rows.select("chromosome", start.alias("start"), end.alias("end"), "ref", "alt", F.expr("try_cast(qual AS double)").alias("qual"), "filter")


def read_vcf(spark: SparkSession, path: str, sample: str | None = None, normal: str | None = None, min_depth: int = 0, skip_reject: bool = False, skip_somatic: bool = False) -> DataFrame:
    """Variants of one sample (the first, if none is named), one row an ALT, with depth, zygosity and allele frequency; n_ columns for a matched normal."""
    lines = _lines(spark, path)
    header = lines.filter(F.col("value").startswith("#CHROM")).limit(1).first()
    samples = header["value"].split("\t")[9:] if header else []
    if not samples:
        raise ValueError("the file has no samples")
    rows = lines.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    at = lambda i: F.get("p", i)
    rows = rows.select(at(0).alias("chromosome"), (at(1).cast("long") - 1).alias("start"), at(3).alias("ref"), F.posexplode(F.split(at(4), ",")).alias("nth", "alt"), at(6).alias("filter"), at(7).alias("info"), F.split(at(8), ":").alias("keys"), "p")
    rows = rows.filter(~F.col("alt").isin("<NON_REF>", "."))

    def genotype(name: str, prefix: str) -> list[Column]:
        values = F.split(F.get("p", F.lit(9 + samples.index(name))), ":")
        field = lambda k: F.get(values, F.array_position("keys", k).cast("int") - 1)
        number = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("double"))
        ad = F.transform(F.split(field("AD"), ","), number)
        tier = F.concat_ws(",", *[F.when(F.col("alt") == b, field(b + "U")) for b in "ACGT"])
        alt = F.coalesce(F.get(ad, F.when(F.size(ad) > 1, F.col("nth") + 1).otherwise(0)), F.get(F.transform(F.split(field("CLCAD2"), ","), number), F.lit(1)), F.aggregate(F.transform(F.split(field("AO"), ","), number), F.lit(0.0), lambda a, x: a + x), number(F.substring_index(tier, ",", 1)), F.lit(0.0))
        depth = F.coalesce(number(field("DP")), F.aggregate(ad, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), number(_vcf_info("DP")), F.lit(0.0))
        freq = F.when(depth > 0, alt / depth)
        called = F.array_remove(F.split(field("GT"), r"[/|]"), ".")
        known = F.size(called) > 0
        same = F.size(F.array_distinct(called)) == 1
        partial = F.size(F.split(field("GT"), r"[/|]")) > F.size(called)
        z = F.when(known & partial, F.when(F.get(called, F.lit(0)) == "0", 0.0).otherwise(0.5)).when(known & same, F.when(F.get(called, F.lit(0)) == "0", 0.0).otherwise(1.0)).when(known, 0.5)
        z = F.coalesce(z, F.when(freq >= 0.75, 1.0).when(freq >= 0.25, 0.5).otherwise(0.0))
        return [z.alias(f"{prefix}zygosity"), depth.alias(f"{prefix}depth"), alt.alias(f"{prefix}alt_count"), freq.alias(f"{prefix}alt_freq")]

    somatic = F.col("info").rlike("(^|;)SOMATIC(;|$)")
    end = F.coalesce(F.expr("try_cast(regexp_extract(info, '(?:^|;)END=([^;]+)', 1) AS bigint)"), F.col("start") + F.length("alt"))
    out = rows.select("chromosome", "start", end.alias("end"), "ref", "alt", "filter", somatic.alias("somatic"), *genotype(sample or samples[0], ""), *(genotype(normal, "n_") if normal else []))
    if skip_reject:
        out = out.filter(F.col("filter").isin("PASS", ".", ""))
    if skip_somatic:
        out = out.filter(~F.col("somatic"))
    if min_depth:
        out = out.filter(F.col("n_depth" if normal else "depth") >= min_depth)
    return out.drop("filter")


READERS = {"tab": read_tab, "bed": read_bed, "bed3": lambda s, p: read_bed(s, p, 3), "bed4": lambda s, p: read_bed(s, p, 4), "bed6": read_bed, "interval": read_interval, "picardhs": read_picard_hs, "gff": read_gff, "refflat": read_refflat, "seg": read_seg, "dict": read_dict, "text": read_text, "vcf": read_vcf, "vcf-sites": read_vcf_sites}
#: What the first line of content looks like, in the order of trial (fixed values).
PATTERNS = (
    ("gff", r"^\S+\t\S*\t\S+\t\d+\t\d+\t\S+\t[+.?-]\t[012.]\t"), ("vcf", r"^##fileformat=VCF|^#CHROM\tPOS"), ("text", r"^\w[\w.]*:\d+-\d+"),
    ("tab", r"^chromosome\tstart\tend"), ("interval", r"^@(HD|SQ)|^\S+\t\d+\t\d+\t[+-]\t\S+$"), ("refflat", r"^\S+\t\S+\t\S+\t[+-]\t\d+\t\d+\t\d+\t\d+\t\d+\t"), ("bed", r"^\S+[\t ]+\d+[\t ]+\d+"),
)


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file, by its first lines of content."""
    for row in spark.read.text(path).filter(~F.col("value").rlike(r"^\s*$|^track|^browser")).limit(50).collect():
        line = row["value"]
        for name, pattern in PATTERNS:
            if re.search(pattern, line):
                return name
    raise ValueError(f"no known format: {path}")


def read(spark: SparkSession, path: str, fmt: str = "auto", **kw) -> DataFrame:
    """Any format of READERS; auto looks at the file."""
    return READERS[sniff(spark, path) if fmt == "auto" else fmt](spark, path, **kw)
