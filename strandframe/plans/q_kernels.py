"""Queries of the grouped kernels and the workflow, and of the streaming operators' batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segmentation as sg
from ..operators import workflow as wf
from ..streaming import windows
from .adapters import bins, duck, segs

QUERIES, ORACLES = {}, {}
B, S = duck("bins"), duck("segs")


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _segments(s, d):
    return segs(s, d).withColumns({"weight": 1.0 + F.col("seg_id") % 7, "probes": 1 + F.col("seg_id") % 5})


def _reference(s, d):
    return wf.reference(bins(s, d))


QUERIES |= {
    "ag_biweight_mode_ci": lambda s, d: sg.estimates(bins(s, d), ["sample_id", "chromosome"]),
    "kn_savgol": lambda s, d: sg.smooth(segs(s, d), ["chromosome"], "savgol", 9),
    "kn_lowess": lambda s, d: sg.smooth(segs(s, d), ["chromosome"], "lowess", 0.2),
    "kn_outliers": lambda s, d: sg.flag_outliers(segs(s, d), ["chromosome"]),
    "kn_center_by_window": lambda s, d: sg.center_by_key(bins(s, d).select("sample_id", "chromosome", "start", "end", "gene", "log2", "weight"), "sample_id", "weight"),
    "kn_none": lambda s, d: sg.segment(bins(s, d), method="none"),
    "kn_haar": lambda s, d: sg.segment(bins(s, d), method="haar", alpha=1e-2),
    "kn_hmm": lambda s, d: sg.segment(bins(s, d), method="hmm"),
    "kn_hmm_germline": lambda s, d: sg.segment(bins(s, d), method="hmm-germline"),
    "kn_bic": lambda s, d: sg.bic(_segments(s, d), 0.3),
    "kn_purity_grid": lambda s, d: sg.purity_grid(_segments(s, d), [x / 10 for x in range(2, 11)], [1.5 + x / 2 for x in range(8)]),
    "kn_bintest": lambda s, d: sg.bintest(bins(s, d), segs(s, d), 0.05),
    "wf_reference": _reference,
    "wf_targets": lambda s, d: wf.targets(bins(s, d)),
    "wf_antitargets": lambda s, d: wf.antitargets(bins(s, d), segs(s, d), 10_000, 500),
    "wf_fix": lambda s, d: wf.fix(bins(s, d), _reference(s, d)),
}


def _coverage(s, d):
    blocks = bins(s, d).select("chromosome", "start", "end", F.when(F.col("depth") > 45, 1024).otherwise(0).alias("flag"), F.col("depth").cast("int").alias("mapq"))
    out = wf.coverage(blocks, segs(s, d).withColumn("gene", F.lit("-")).drop("log2"), 5)
    return out.select("seg_id", F.round("depth", 6).alias("depth"), F.round("log2", 6).alias("log2"))


QUERIES["wf_coverage"] = _coverage
ORACLES["wf_coverage"] = f"""WITH {B}, {S}, c AS (SELECT s.seg_id, coalesce(sum(least(b."end", s."end") - greatest(b."start", s."start")), 0) / 40000.0::DOUBLE AS depth FROM segs s LEFT JOIN (SELECT * FROM bins WHERE depth <= 45 AND depth >= 5) b
  ON b.chromosome = s.chromosome AND b."end" > s."start" AND b."start" < s."end" GROUP BY 1) SELECT seg_id, round(depth, 6) AS depth, round(CASE WHEN depth > 0 THEN log2(depth) ELSE -20 END, 6) AS log2 FROM c"""
QUERIES["wf_sample_correlation"] = lambda s, d: wf.sample_correlation(bins(s, d).withColumns({"start": F.floor(F.col("start") / 20000), "end": F.lit(0), "gene": F.lit("-")})).withColumn("r", F.round("r", 6))
ORACLES["wf_sample_correlation"] = f"""WITH {B}, m AS (SELECT chromosome, "start" // 20000 AS t, sample_id, avg(log2) AS x FROM bins GROUP BY 1, 2, 3)
SELECT a.sample_id AS a, b.sample_id AS b, round(corr(a.x, b.x), 6) AS r FROM m a JOIN m b USING (chromosome, t) WHERE a.sample_id < b.sample_id GROUP BY 1, 2"""
QUERIES["sm_tumbling"] = lambda s, d: windows.tumbling(_events(s, d)).withColumn("value", F.round("value", 4))
ORACLES["sm_tumbling"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"
QUERIES["sm_sliding"] = lambda s, d: windows.sliding(_events(s, d))
ORACLES["sm_sliding"] = "SELECT w_start, count(*) AS n, max(value) AS top FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w_start FROM events) GROUP BY 1"
QUERIES["sm_session"] = lambda s, d: windows.sessions(_events(s, d))
ORACLES["sm_session"] = """SELECT user_id, min(ts) AS s_start, max(ts) + INTERVAL 30 MINUTE AS s_end, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, run"""
