"""Read counts that are whole to the last bit."""

import duckdb

from strandframe.operators import reports
from strandframe.plans.registry import ORACLES, QUERIES

FROM = "/root/testdata/sf0.001"


def test_theta_counts_equal_their_sql(spark, tmp_path):
    con = duckdb.connect()
    # prices of which 1 to 5 times the 250th part is a whole number, and their neighbours
    con.execute(f"COPY (SELECT o.* REPLACE (100 * i AS o_orderkey, 250.0 * i / (1 + i % 5) + (i // 5 % 3 - 1) / 100 AS o_totalprice) FROM (SELECT * FROM '{FROM}/orders.parquet' LIMIT 1) o, range(1, 1500) r(i)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (FROM '{FROM}/nation.parquet') TO '{tmp_path}/nation.parquet'")
    for t in ("orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    cols = ["seg_id", "chrm", "start", "end", "tumor", "normal"]
    got = QUERIES["ex_theta"](spark, str(tmp_path)).select(cols).toPandas()
    want = con.execute(ORACLES["ex_theta"]).fetchdf()[cols]
    assert len(got) == 1499 * 22
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_theta_of_missing_and_extreme_log2(spark):
    df = spark.createDataFrame([(i, "chr1", 0, 10, x, 2) for i, x in enumerate([None, 0.0, -5000.0, 1.0])], "seg_id long, chromosome string, start long, end long, log2 double, probes long")
    assert [r.tumor for r in reports.export_theta(df).orderBy("seg_id").collect()] == [None, 2000, 0, 4000]
