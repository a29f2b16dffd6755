"""The corpus pipeline: five stages, each over all that its predecessor kept.

Rows are told apart by themselves, not by doc_id. Defined cases: null or empty texts fail the quality rules; rows without a doc_id
or with a repeated one are documents of their own, and of a group of near duplicates the one with the smallest doc_id stays (null: the
largest; the rows of one doc_id: any one of them); further columns are kept until the mix, which returns its own; an empty table gives
an empty result, and so does an empty benchmark an unchanged corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import decontamination, jaccard, line_dedup, mixing, quality
from strandframe.llm.common import small, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, without the boilerplate that an earlier document keeps; those depleted by that go."""
    kept = quality.judged(docs, places=True).filter("kept")
    kept = kept.withColumn("text", quality.cleaned_text(F.col("text"), F.col("lost_lines"))).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later document keeps; those left without text go."""
    kept = line_dedup.keep_bitmaps(docs)
    text = line_dedup.kept_text(F.col("text"), F.col("keep_runs"))
    kept = kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return kept.filter("n_dropped = 0 OR n_dropped < n_lines AND length(trim(text)) > 0").select(docs.columns)


#: Words of a shingle and percent of Jaccard similarity from which documents are near duplicates; op10's own values are stricter.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of n-gram Jaccard links."""
    # rows are told apart by doc_id, or where that is missing or repeated by a hash of id and text; rows equal in both are one
    repeated = small(table(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id", F.lit(True).alias("__several")), "repeated-ids"))
    rows = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left").drop(repeated["doc_id"])
    rows = rows.withColumn("__row", F.when(F.col("__several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    found = jaccard.components(rows, doc_id="__row", n=NEAR_SHINGLE, percent=NEAR_PERCENT)
    later = table(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__row"), "component_id").distinct(), "copies")
    group = later.unionByName(later.select("component_id").distinct().withColumn("__row", F.col("component_id")))
    ids = rows.select("__row", "doc_id").distinct().join(small(table(group, "groups")), "__row")
    first = F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    kept = ids.groupBy("component_id").agg(first.alias("__row"))
    gone = table(ids.select("__row").join(kept.select("__row"), "__row", "left_anti"), "gone")
    rows = rows.join(small(gone), "__row", "left_anti")
    once = rows.filter("__several IS NULL").unionByName(rows.filter("__several").dropDuplicates(["__row"]))
    return once.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights take it."""
    return mixing.mix(docs).select("doc_id", "source", "lang", "size", "copy_no", "text")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = table(docs, "stage-" + name.replace(" ", "-"))
    return docs


#: Components of links between documents take a fixpoint over all pairs; the test holds run() against a brute-force version.
ORACLE_SQL = None
