"""Kernels, calls, readers and streams."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import kernels as kn
from strandframe.operators import calling, reports, workflow
from strandframe.operators import segmentation as sg
from strandframe.sources import readers, writers
from strandframe.streaming import windows

VALUES = st.lists(st.floats(-50, 50), min_size=2, max_size=40)


@settings(max_examples=40, deadline=None)
@given(VALUES, st.floats(-5, 5))
def test_location_moves_with_the_data(x, by):
    x = np.round(x, 3)
    assert min(x) - 1e-6 <= kn.biweight_location(x) <= max(x) + 1e-6
    assert kn.biweight_location(x + by) == pytest.approx(kn.biweight_location(x) + by, abs=0.05)
    assert kn.biweight_midvariance(x) >= 0


def test_haar_finds_a_step():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 0.1, 200), rng.normal(1.5, 0.1, 150), rng.normal(0, 0.1, 200)))
    assert np.abs(kn.haar(x, np.ones(len(x))) - [200, 350]).max() <= 2


def test_hmm_and_cbs_find_a_gain():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 0.1, 60), rng.normal(0.58, 0.1, 50), rng.normal(0, 0.1, 60)))
    states = kn.hmm_states(x, np.arange(len(x)) * 1000.0, 0.15)
    assert [s[0] for s in kn.runs(states)] == [0, 60, 110] and states[80] == 3
    assert any(abs(a - 60) <= 2 and abs(b - 110) <= 2 for a, b in kn.cbs(x, 0.01, 100))


def test_smoothers_keep_a_line():
    x = np.arange(60.0)
    for y in (kn.savgol(x, 7), kn.lowess(x, 0.3), kn.rolling_median(x, 5)):
        assert np.abs(y - x)[8:-8].max() < 1e-6


def test_bootstrap_holds_the_mean():
    x = np.random.default_rng(3).normal(2, 1, 200)
    lo, hi = kn.bootstrap_ci(x, np.ones(200))
    assert lo < x.mean() < hi and (lo, hi) == kn.bootstrap_ci(x, np.ones(200))


def test_bic_merges_equal_neighbours():
    assert kn.bic_merge([0.0, 0.01, 2.0, 2.01], [1, 1, 1, 1], [50, 50, 50, 50], 0.2) == [(0, 2), (2, 4)]


def test_threshold_and_purity(spark):
    df = spark.createDataFrame([("chr1", x) for x in (-2.0, -1.1, -0.5, 0.0, 0.5, 1.0, None)] + [("chrX", -0.5)], "chromosome string, log2 double")
    ref = calling.reference_copies(2, True)
    assert [r[0] for r in df.select(calling.threshold(F.col("log2"), ref)).collect()] == [0, 0, 1, 2, 3, 4, 2, 0]
    assert df.select(calling.clonal(F.lit(-9.0), ref, calling.expected_copies(), 0.5).alias("x")).filter("x < 0").isEmpty()


def test_segments_of_a_sample(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 0.05, 120), rng.normal(1, 0.05, 120)))
    df = spark.createDataFrame(pd.DataFrame({"sample_id": "s", "chromosome": "chr1", "start": np.arange(240) * 1000, "end": np.arange(240) * 1000 + 900, "gene": "-", "depth": 1.0, "log2": x, "weight": 1.0}))
    for method in ("haar", "hmm", "cbs"):
        out = sg.segment(df, method=method, alpha=1e-3).orderBy("start").collect()
        assert abs(out[0].log2) < 0.1 and abs(out[-1].log2 - 1) < 0.1 and sum(r.probes for r in out) == 240, method
    assert reports.het_density_rejects_haploid(9, 20) and not reports.het_density_rejects_haploid(1, 20)


def test_gc_content(spark):
    bins = spark.createDataFrame([("c", 2, 6, "g"), ("c", 90, 95, "h")], "chromosome string, start long, end long, gene string")
    seq = spark.createDataFrame([("c", 0, 4, "ACgt"), ("c", 4, 8, "GGNN")], "chromosome string, start long, end long, seq string")
    assert {r.gene: (r.gc, r.rmask) for r in workflow.gc_content(bins, seq).collect()} == {"g": (0.75, 0.5), "h": (0.0, 0.0)}


FILES = {
    "bed": 'browser x\ntrack name="a"\nchr1\t0\t10\tG\t5\t+\nchr1\t20\t30\ntrack name="b"\nchr2\t1\t2\n',
    "interval": "@HD\tVN:1\n@SQ\tSN:chr1\tLN:99\nchr1\t1\t10\t+\tG\nchr1\t21\t30\t-\tH\n",
    "gff": '##gff-version 3\nchr1\tsrc\texon\t1\t10\t.\t+\t.\tgene_id "G"; x=1\nchr1\tsrc\tCDS\t21\t30\t.\t-\t0\tother=1\n',
    "text": "chr1:1-10 G\nchr1:21-30\n",
    "refflat": "G\tNM\tchr1\t+\t1\t30\t5\t25\t2\t1,21,\t10,30,\n",
    "tab": "chromosome\tstart\tend\tgene\tlog2\nchr1\t0\t10\tG\t0.5\nchr1\t20\t30\tH\t\nchr1\t20\t30\t-\t-1\n",
}


@pytest.mark.parametrize("fmt", sorted(FILES))
def test_readers(spark, tmp_path, fmt):
    path = tmp_path / f"x.{fmt}"
    path.write_text(FILES[fmt])
    assert readers.sniff(spark, str(path)) == fmt
    kw = {"exons": True} if fmt == "refflat" else {}
    assert sorted((r.chromosome, r.start, r.end) for r in readers.read(spark, str(path), **kw).collect()) == [("chr1", 0, 10), ("chr1", 20, 30)]


def test_seg_and_dict(spark, tmp_path):
    (tmp_path / "s.seg").write_text('"ID"\t"chrom"\t"loc.start"\t"loc.end"\t"num.mark"\t"seg.mean"\nstray\nA\t23\t1\t10\t3\t0.5\nB\t1\t11\t20\t4\t-1\n')
    got = readers.read_seg(spark, str(tmp_path / "s.seg"), {"23": "X"}, "chr").collect()
    assert sorted((r.sample_id, r.chromosome, r.start, r.probes) for r in got) == [("A", "chrX", 0, 3), ("B", "chr1", 10, 4)]
    (tmp_path / "s.dict").write_text("@HD\tVN:1\n@SQ\tSN:chr1\tLN:99\n")
    assert [tuple(r) for r in readers.read_dict(spark, str(tmp_path / "s.dict")).collect()] == [("chr1", 0, 99)]


def test_vcf(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tT\tN\n"
    body = ["1\t10\t.\tA\tG,T\t.\tPASS\tSOMATIC\tGT:AD:DP\t0/1:6,3,1:10\t0/0:9,0,0:9", "1\t20\t.\tA\tC\t.\tREJECT\tDP=8\tGT\t./.\t0/.", "1\t30\t.\tA\tAT\t.\tPASS\t.\tAU:CU:GU:TU:DP\t1,1:0,0:0,0:0,0:4\t1,1:0,0:0,0:0,0:2"]
    (tmp_path / "v.vcf").write_text(head + "\n".join(body) + "\n")
    rows = readers.read(spark, str(tmp_path / "v.vcf"), normal="N").orderBy("start", "alt").collect()
    assert [(r.start, r.alt, r.zygosity, r.alt_count, r.depth, r.n_zygosity) for r in rows] == [(9, "G", 0.5, 3, 10, 0.0), (9, "T", 0.5, 1, 10, 0.0), (19, "C", 0.0, 0, 8, 0.0), (29, "AT", 0.0, 0, 4, 0.0)]
    assert readers.read_vcf(spark, str(tmp_path / "v.vcf"), skip_somatic=True, skip_reject=True).count() == 1


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr2", 5, 9, "G", 0.25), ("chr10", 1, 3, "H", -1234567.0), ("chr1", 7, 8, "-", 1e-7)], "chromosome string, start long, end long, gene string, log2 double")
    writers.write(df, str(tmp_path / "out"))
    back = readers.read_tab(spark, str(tmp_path / "out"))
    assert [r.chromosome for r in writers.ordered(back).collect()] == ["chr1", "chr2", "chr10"]
    assert {r.gene: r.log2 for r in back.collect()} == {"G": 0.25, "H": -1.23457e6, "-": 1e-7}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    for f in (windows.tumbling, windows.sliding):
        stream = f(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
        name = f"t_{f.__name__}"
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        key = lambda rows: sorted(tuple(r) for r in rows)
        assert key(spark.table(name).collect()) == key(f(batch).collect())
