"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandframe.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "seg_id" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["jn_segment_annotation", "jn_subtract", "iv_merge_bp0", "iv_flatten", "ag_weighted_median", "cl_threshold", "rp_breaks", "sm_session", "sm_runs", "iv_merge_gaps", "rp_top_breaks", "wf_bedgraph", "pf_noncanonical", "pf_big_chroms", "jn_segment_vafs", "so_midsize_sample"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "nation", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(repr([None if x != x else x for x in r]) for r in df[cols].astype(object).itertuples(index=False))
    assert key(got) == key(want)
