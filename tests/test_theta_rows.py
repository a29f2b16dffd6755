"""Solutions for all segments of a larger table."""

import duckdb

from strandframe.plans import q_transfer
from strandframe.plans.adapters import segs

LARGE = "/root/testdata/sf0.1"


def test_theta_of_more_than_4000_segments(spark):
    n = segs(spark, LARGE).filter("chromosome NOT IN ('chrX', 'chrY')").count()
    con = duckdb.connect()
    for t in ("lineitem", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGE}/{t}.parquet'")
    want = con.execute(q_transfer.ORACLES["cl_import_theta"]).fetchdf()
    names = ["solution", "chromosome", "start", "end", "seg_id", "cn", "log2"]
    got = q_transfer.QUERIES["cl_import_theta"](spark, LARGE).select(names).toPandas()
    rows = lambda df: sorted(df[names].itertuples(index=False, name=None))
    assert n > 4000 and len(got) == 2 * sum(i % 7 != 0 for i in range(n)) and rows(got) == rows(want)
