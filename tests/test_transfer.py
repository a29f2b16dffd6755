"""Fields from bins, results of other callers, and their queries against DuckDB."""

import duckdb
import pytest

from strandframe.operators import transfer as tr
from strandframe.plans import q_transfer
from strandframe.sources import results

SF = "/root/testdata/sf0.001"


def bins(spark):
    rows = [("c", 0, 10, "A", 2.0, 1.0), ("c", 10, 20, "B,A", 4.0, 3.0), ("c", 20, 30, "Antitarget", 8.0, None), ("c", 50, 60, "-", 1.0, 1.0), ("c", 90, 99, "C", 5.0, 0.0)]
    return spark.createDataFrame(rows, "chromosome string, start long, end long, gene string, depth double, weight double")


def test_transfer_fields(spark):
    segs = spark.createDataFrame([("c", 5, 30, 1), ("c", 30, 50, 2), ("c", 50, 70, 3), ("c", 70, 80, 4)], "chromosome string, start long, end long, id long")
    got = sorted((r.id, r.start, r.end, r.gene, r.weight, r.depth) for r in tr.transfer_fields(segs, bins(spark), "id").collect())
    assert got == [(1, 0, 30, "A,B", 4.0, 3.5), (2, 30, 50, "-", 0.0, 0.0), (3, 50, 70, "-", 1.0, 1.0), (4, 70, 99, "C", 0.0, 0.0)]


def test_transfer_replaces_fields_and_needs_bins(spark):
    segs = spark.createDataFrame([("c", 0, 99, 1, "old", 7.0)], "chromosome string, start long, end long, id long, gene string, weight double")
    assert tr.transfer_fields(segs, bins(spark), "id").first().gene == "A,B,C"
    with pytest.raises(Exception, match="without bins"):
        tr.transfer_fields(segs.selectExpr("'d' AS chromosome", "start", "end", "id"), bins(spark), "id").collect()


def test_theta(spark, tmp_path):
    path = tmp_path / "x.results"
    path.write_text("#NLL\tmu\tC\tp*\n12.5\t0.2,0.5,0.3\t2,2:X,3:0,1\t0.5,X,0.1\n")
    theta = results.read_theta(spark, str(path))
    assert sorted((r.solution, r.row, r.copies, r.mu_tumor) for r in theta.collect() if r.copies is not None) == [(0, 0, 2, 0.5), (0, 2, 0, 0.5), (1, 0, 2, 0.3), (1, 1, 3, 0.3), (1, 2, 1, 0.3)]
    segs = spark.createDataFrame([("chr10", 5, 9), ("chr2", 1, 2), ("chr2", 0, 1), ("chrX", 0, 5)], "chromosome string, start long, end long")
    got = sorted((r.solution, r.chromosome, r.start, r.cn, r.log2) for r in tr.import_theta(segs, theta).collect())
    assert got == [(0, "chr10", 5, 0, -2.0), (0, "chr2", 0, 2, 0.0), (1, "chr10", 5, 1, -1.0), (1, "chr2", 0, 2, 0.0), (1, "chr2", 1, 3, pytest.approx(0.5849625))]


@pytest.mark.parametrize("text, ok", [("0.7\t2.1", True), ("0\t2", False), ("1.2\t2", False), ("0.5\t0.4", False)])
def test_purity(spark, tmp_path, text, ok):
    path = tmp_path / "p.tsv"
    path.write_text(f"purity\tploidy\tscore\n{text}\t9\n0.1\t2\t8\n")
    if ok:
        assert results.read_purity(spark, str(path)) == (0.7, 2.1)
    else:
        with pytest.raises(ValueError, match="must be"):
            results.read_purity(spark, str(path))


@pytest.mark.parametrize("name", sorted(q_transfer.QUERIES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(q_transfer.ORACLES[name]).fetchdf()
    got = q_transfer.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    assert rows and [tuple(map(str, r)) for r in rows] == [tuple(map(str, r)) for r in sorted(want[names].itertuples(index=False, name=None), key=repr)]
