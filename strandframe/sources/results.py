"""Results of other steps and callers: small files of one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_purity(spark: SparkSession, path: str) -> tuple[float, float]:
    """(purity, ploidy) of the first row of a table with these columns, the best one."""
    rows = spark.read.csv(path, sep="\t", header=True).select(F.col("purity").cast("double"), F.col("ploidy").cast("double")).limit(1).collect()
    if not rows:
        raise ValueError(f"no rows: {path}")
    purity, ploidy = rows[0]
    if purity is None or not 0 < purity <= 1:
        raise ValueError(f"purity must be above 0 and at most 1, got {purity}: {path}")
    if ploidy is None or ploidy < 1:
        raise ValueError(f"ploidy must be at least 1, got {ploidy}: {path}")
    return purity, ploidy


def read_theta(spark: SparkSession, path: str) -> DataFrame:
    """(solution, row, copies, nll, mu_normal, mu_tumor) of a results file: copies of each segment, by number, in each solution.

    Segments are separated by colons, solutions by commas; what is no number is null.
    """
    body = spark.read.csv(path, sep="\t", header=True).toDF("nll", "mu", "copies", "p").limit(1)
    mu = F.split("mu", ",")
    rows = body.select(F.col("nll").cast("double").alias("nll"), mu.alias("mu"), F.posexplode(F.split("copies", ":")).alias("row", "each"))
    rows = rows.select("nll", "mu", F.col("row").cast("long").alias("row"), F.posexplode(F.split("each", ",")).alias("solution", "text"))
    copies = F.when(F.col("text").rlike("^[0-9]+$"), F.col("text").cast("long"))
    tumor = F.try_element_at("mu", F.col("solution") + 2).cast("double")
    return rows.select("solution", "row", copies.alias("copies"), "nll", F.col("mu")[0].cast("double").alias("mu_normal"), tumor.alias("mu_tumor"))
