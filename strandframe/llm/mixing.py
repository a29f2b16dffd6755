"""Mixing sources to target weights, in DataFrame functions only.

Sizes (words) are summed per source, capped targets are found by water-filling, and
each document is emitted floor(target / source size) times, plus once more if a hash of
its id and text falls below the fraction. One pass sums, one pass emits; the documents themselves
are never shuffled. What is broadcast has one row per source and is size-checked.

Defined cases: null text has size 0; null source is a source of its own, ranked last;
rows without a doc_id or with the same one draw by their texts; rows equal in both draw alike; an empty
table gives an empty result; sources without words have target 0; input columns named
like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table, with_columns, words

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources by code point take the weights in turn. Targets are level * weight, at most
    ``most`` times the size; the level that spends share * total is the largest of the
    levels found when the sources are capped one by one in the order of cap / weight.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(share)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", (total - spent) / left)
    level = F.max("level").over(Window.partitionBy(F.lit(1)))
    return rows.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes each document)."""
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size_of(F.col(f"`{text}`"))).alias("source_size"))
    plan = table(source_targets(table(sizes, "mix-sizes"), weights, most, share), "mix-targets")
    side = small(plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target")))
    # a 32-bit uniform draw, the same wherever and whenever the document is met
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.coalesce(F.col(f"`{text}`"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(2**32)
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(0.0)
    joined = docs.join(side, F.col(f"`{source}`").eqNullSafe(F.col("__source"))).withColumn("__rate", rate)
    out = with_columns(joined, {
        "size": size_of(F.col(f"`{text}`")), "source_size": F.col("__size"), "target": F.col("__target"), "rate": F.col("__rate"),
        "copies": (F.floor("__rate") + (draw < F.col("__rate") - F.floor("__rate")).cast("int")).cast("long"),
    })
    return out.drop("__source", "__size", "__target", "__rate")


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed table: every document as often as mix_plan() takes it, with copy_no from 1."""
    plan = mix_plan(docs, **kw).filter("copies > 0").drop("copy_no")
    return plan.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


TARGETS_SQL = """
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight, source_size * 3 AS cap FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM ranked WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM levels),
taken AS (SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null') || ':' || coalesce(s.text, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""
SQL = r"""
WITH sized AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
""" + TARGETS_SQL + """
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM taken
"""
