"""Kernels on groups that are too large for windows or pairs in full."""

import numpy as np
import pytest

from strandframe.functions import kernels as kn
from strandframe.operators import segmentation as sg


def test_rolling_median_of_wide_windows():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, 2000), 1)
    holes = np.where(rng.random(2000) < 0.002, np.nan, x)
    for y, width in ((x, 0.1), (x, 701), (x, 0.99), (holes, 0.2)):
        want = kn.rolling(y, width, lambda v: np.median(v, 1))
        assert np.array_equal(kn.rolling_median(y, width), want, equal_nan=True)


def test_rolling_median_needs_no_table_of_windows():
    x = np.random.default_rng(4).normal(0, 1, 1_000_000)  # 100,001 values each: 800 GB as a table
    got = kn.rolling_median(x, 0.1)
    wing = kn.wing_of(0.1, len(x))
    for i in (wing, 123_456, 500_000):
        assert got[i] == np.median(x[i - wing : i + wing + 1])


def test_center_by_key_as_the_kernel(spark):
    rng = np.random.default_rng(5)
    rows = [("chr%d" % (i % 3), int(i), int(i + 5), float(rng.normal()), float(i % 7), None if i % 2 else "A", f"g{i}") for i in range(3000)]
    rows[5] = (*rows[5][:3], None, *rows[5][4:])
    df = spark.createDataFrame(rows, "chromosome string, start long, end long, log2 double, weight double, sample_id string, gene string")
    got = sg.center_by_key(df, "sample_id", "weight")
    assert got.dtypes == df.dtypes
    got, own = got.toPandas(), df.toPandas()
    for name in ("A", None):
        part = lambda t: t[t["sample_id"].isna() if name is None else t["sample_id"] == name].sort_values(["chromosome", "start"])
        a, b = part(got), part(own)
        assert list(a["gene"]) == list(b["gene"])
        assert np.array_equal(a["log2"], kn.center_by_window(b["log2"], b["weight"], 0.1), equal_nan=True)


def test_fix_of_a_sample_too_large_for_a_table_of_windows(spark):
    from strandframe.operators import workflow as wf

    at = spark.range(400_000).selectExpr("'chr1' AS chromosome", "id * 400 AS start", "id * 400 + 60 + id % 300 AS end", "concat('g', id) AS gene", "CAST(id % 50 AS double) AS depth", "sin(id) AS log2", "'A' AS sample_id")
    ref = at.selectExpr("chromosome", "start", "end", "gene", "0.0D AS log2", "0.1D AS spread")
    assert wf.fix(at, ref).filter("log2 IS NOT NULL AND weight > 0").count() == 400_000  # 20,001 wide: 64 GB


def _mode_of_all_pairs(x):
    x = np.sort(x)
    width = x.std(ddof=1) * len(x) ** -0.2
    return x[np.array([np.exp(-0.5 * ((x - at) / width) ** 2).sum() for at in x]).argmax()]


def test_mode_equals_that_of_all_pairs():
    rng = np.random.default_rng(6)
    for x in (rng.normal(0, 1, 4000), np.append(rng.normal(5000, 1, 3000), [1e7, -1e5]), np.round(rng.standard_cauchy(4000), 2)):
        assert kn.modal_location(x) == _mode_of_all_pairs(x)


def test_estimates_of_a_large_group():
    x = np.random.default_rng(7).normal(0, 1, 400_000)  # 160 billion pairs; 640 MB of resamples at once
    assert abs(kn.modal_location(x)) < 0.2
    lo, hi = kn.bootstrap_ci(x, np.ones(len(x)))
    assert lo < x.mean() < hi


def test_bootstrap_in_parts_equals_that_in_one():
    rng = np.random.default_rng(8)
    x, w = rng.normal(0, 1, 30_001), rng.random(30_001)
    pick = np.random.default_rng(kn.SEED).integers(0, len(x), (100, len(x)))
    means = (x[pick] * w[pick]).sum(1) / w[pick].sum(1)
    assert kn.bootstrap_ci(x, w) == tuple(np.quantile(means, [0.025, 0.975]))


def test_bic_merge_of_many_segments():
    rng = np.random.default_rng(9)
    n = 50_000  # a pass over all pairs for each merge would take hours
    for at, x in ((1, np.zeros(n)), (None, rng.normal(0, 0.5, n))):
        found = kn.bic_merge(x, 1.0 + np.arange(n) % 7, 1 + np.arange(n) % 5, 0.3)
        assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]] and found[-1][1] == n
        assert at is None or len(found) == at


def test_bic_merge_takes_the_first_of_equal_gains():
    assert kn.bic_merge([0.0, 0.0, 9.0, 0.0, 0.0], [1.0] * 5, [9] * 5, 0.3) == [(0, 2), (2, 3), (3, 5)]
    assert kn.bic_merge([], [], [], 0.3) == [] and kn.bic_merge([1.0], [1.0], [1], 0.3) == [(0, 1)]


def test_pair_distance_quantile_equals_that_of_all_pairs():
    rng = np.random.default_rng(10)
    for n in (2, 3, 7, 60, 301):
        for x in (rng.normal(0, 1, n), np.round(rng.normal(0, 1, n), 1), np.zeros(n)):
            i, j = np.triu_indices(n, 1)
            assert kn.pair_distance_quantile(x, 0.25) == pytest.approx(np.quantile(np.abs(x[i] - x[j]), 0.25), rel=1e-14, abs=0)


def test_q_n_of_a_large_group(spark):
    from strandframe.functions import stats

    df = spark.range(200_000).selectExpr("'a' AS k", "CASE WHEN id > 1 THEN CAST(id AS double) END AS x")  # 20 billion pairs
    df = df.unionByName(spark.createDataFrame([("one", 1.0), ("none", None), ("none", None), (None, 1.0), (None, 2.0)], "k string, x double"))
    got = {r.k: r.q_n for r in stats.q_n(df, ["k"], "x").collect()}
    m = 199_998
    within = lambda d: d * m - d * (d + 1) // 2
    assert set(got) == {"a", "none"} and got["none"] is None
    assert within(got["a"] - 1) <= (m * (m - 1) // 2 - 1) // 4 < within(got["a"])


def test_fix_makes_the_rows_of_a_sample_once(spark):
    from pyspark.sql import functions as F

    from strandframe.operators import workflow as wf
    from strandframe.operators.signal import center_all, edge_bias

    keys = ["chromosome", "start", "end", "gene"]
    at = spark.range(3000).selectExpr("if(id % 5 < 4, concat('chr', id % 5), 'chrX') AS chromosome", "id * 100 AS start", "id * 100 + 60 + id % 300 AS end", "concat('g', id) AS gene", "if(id % 50 = 7, NULL, sin(id)) AS log2", "if(id % 3 = 0, 'A', 'B') AS sample_id")
    one = at.unionByName(at.filter("chromosome = 'chrX'").withColumn("sample_id", F.lit("without autosomes")))
    ref = at.selectExpr(*keys, "cos(start) AS log2", "(start % 700) / 500D AS spread", "(start % 900) / 900D AS gc")
    got = wf.fix(one, ref)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # it was twice for each bias
    rows = center_all(one.filter("sample_id <> 'without autosomes'"), ["sample_id"]).join(ref.withColumnRenamed("log2", "ref_log2"), keys)
    for key in ("gc", "edge"):
        rows = sg.center_by_key(edge_bias(rows, ["start", "end", "gene", "log2"], keys=["sample_id"]), "sample_id", key)
    want = center_all(rows.withColumn("log2", F.col("log2") - F.col("ref_log2")), ["sample_id"]).toPandas().sort_values(["sample_id", "start"])
    got = got.toPandas().sort_values(["sample_id", "start"])
    assert (got["sample_id"] == "without autosomes").sum() == 600  # they were dropped
    got = got[got["sample_id"] != "without autosomes"]
    assert len(got) == 3000 and np.allclose(got["log2"], want["log2"], rtol=0, atol=1e-12, equal_nan=True)
    size = np.sqrt(got["end"] - got["start"])
    by_size = (1 - got["spread"] ** 2 / (size / size.groupby(got["sample_id"]).transform("mean"))).clip(1e-4, 1)
    assert np.allclose(got["weight"], (0.9 * (1 - got["spread"] ** 2) + 0.1 * by_size).clip(1e-4, 1), rtol=1e-12)
