"""Interval tables made of the driver's tables, for Spark and, as the same SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import stats

_NAME = "CASE WHEN {k} < 22 THEN concat('chr', CAST({k} + 1 AS {text})) WHEN {k} = 22 THEN 'chrX' ELSE 'chrY' END"
_BINS = """SELECT {chrom} AS chromosome, l_orderkey * 400 + l_linenumber * 37 AS {start}, l_orderkey * 400 + l_linenumber * 37 + 40 + CAST(l_quantity AS BIGINT) * 8 AS {end},
  CASE WHEN l_partkey % 10 = 0 THEN 'Antitarget' ELSE concat('G', CAST(l_partkey % 200 AS {text})) END AS gene, l_quantity AS depth,
  log2(l_extendedprice / 30000) AS log2, 1 - l_discount AS weight, l_returnflag AS sample_id, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM {lineitem}"""
_SEGS = """SELECT {chrom} AS chromosome, o_orderkey * 400 AS {start}, o_orderkey * 400 + 40000 AS {end}, log2(o_totalprice / 250000) AS log2,
  o_orderkey * 100 + n_nationkey AS seg_id FROM {orders} CROSS JOIN {nation} WHERE o_orderkey % 100 = 0 AND n_nationkey < 24"""
_SNPS = """SELECT {chrom} AS chromosome, (event_id * 7919) % 6000000 AS {start}, (event_id * 7919) % 6000000 + 1 AS {end}, event_id AS snp_id,
  value / 500 AS alt_freq, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 1 END AS DOUBLE) / 2 AS zygosity,
  CAST(20 + event_id % 80 AS BIGINT) AS depth, CAST(event_id % 20 AS BIGINT) AS alt_count FROM {events}"""
TABLES = {"bins": (_BINS, "l_suppkey % 24"), "segs": (_SEGS, "n_nationkey"), "snps": (_SNPS, "user_id % 24")}


def _sql(table: tuple[str, str], text: str, quote: str, tables: dict[str, str]) -> str:
    body, k = table
    return body.format(chrom=_NAME.format(k=k, text=text), text=text, start=f"{quote}start{quote}", end=f"{quote}end{quote}", **tables)


def duck(name: str) -> str:
    """A CTE of the adapter for DuckDB."""
    return f"{name} AS ({_sql(TABLES[name], 'VARCHAR', chr(34), {t: t for t in ('lineitem', 'orders', 'nation', 'events')})})"


def _load(spark: SparkSession, sf_dir: str, table: tuple[str, str]) -> DataFrame:
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("lineitem", "orders", "nation", "events")}
    return spark.sql(_sql(table, "STRING", "`", files))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _load(spark, sf_dir, TABLES[name])


def segs_to_the_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segs with the log2 that DuckDB has, to the last bit; for what rounds it down."""
    body, k = TABLES["segs"]
    ratio = "o_totalprice / 250000"
    plain = (body.replace(f"log2({ratio})", ratio), k)
    rows = _load(spark, sf_dir, plain)
    return rows.withColumn("log2", stats.log2()(rows["log2"].cast("double")))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "bins")


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "segs")


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "snps")
