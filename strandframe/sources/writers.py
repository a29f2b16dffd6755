"""Writers of interval and segment text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chrom


def number(c: Column) -> Column:
    """Six significant digits, without trailing zeros."""
    plain = F.format_string("%.6g", c)
    short = F.when(plain.contains("e"), plain).when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(c.isNull(), F.lit("")).otherwise(short)


def ordered(df: DataFrame) -> DataFrame:
    k1, k2 = chrom.sort_key(F.col("chromosome"))
    return df.orderBy(k1, k2, "start", "end")


def as_text(df: DataFrame, fmt: str = "tab") -> DataFrame:
    """df's rows as the columns that a format holds."""
    name = F.col("gene") if "gene" in df.columns else F.lit("-")
    strand = F.col("strand") if "strand" in df.columns else F.lit(".")
    if fmt == "tab":
        first = ["chromosome", "start", "end", *(c for c in ("gene", "log2") if c in df.columns)]
        rest = sorted(set(df.columns) - set(first))
        return df.select(*[number(F.col(c)).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in [*first, *rest]])
    if fmt == "bed3":
        return df.select("chromosome", "start", "end")
    if fmt in ("bed4", "bed"):
        return df.select("chromosome", "start", "end", name.alias("gene"))
    if fmt == "interval":
        return df.select("chromosome", (F.col("start") + 1).alias("start"), "end", strand.alias("strand"), name.alias("gene"))
    if fmt == "text":
        return df.select(F.concat("chromosome", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string")).alias("label"))
    if fmt == "seg":
        return df.select(F.col("sample_id").alias("ID"), F.col("chromosome").alias("chrom"), (F.col("start") + 1).alias("loc.start"), F.col("end").alias("loc.end"), F.col("probes").alias("num.mark"), number(F.col("log2")).alias("seg.mean"))
    raise ValueError(f"no such format: {fmt}")


def write(df: DataFrame, path: str, fmt: str = "tab", single: bool = False) -> None:
    """df as a folder of text files; one file, written by one task, with ``single``, which is for what a person reads."""
    out = as_text(ordered(df), fmt)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, sep="\t", header=fmt in ("tab", "seg"), emptyValue="")
