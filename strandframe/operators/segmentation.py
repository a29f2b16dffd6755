"""Segmentation and the other steps that run a kernel on each (sample, chromosome arm)."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as kn
from .filters import drop_low_coverage
from .intervals import by_arm, overlap_join

SEGMENT = "{keys}, chromosome string, start long, end long, log2 double, probes long, weight double"
METHODS = ("none", "haar", "hmm", "hmm-germline", "cbs")


def grouped(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """f(frame of a group) by keys."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def _cuts(rows: pd.DataFrame, method: str, alpha: float) -> list[tuple[int, int]]:
    x, n = rows["log2"].to_numpy(float), len(rows)
    if method == "none" or n < 4:
        return [(0, n)] if n else []
    if method == "haar":
        at = kn.haar(x, rows["weight"], alpha).tolist()
        return list(zip([0, *at], [*at, n], strict=True))
    if method == "cbs":
        return kn.cbs(x, alpha)
    smooth = kn.savgol(x, 7)
    sd = max(kn.biweight_midvariance(x, 0.0), 0.05)
    copies = 4 if method == "hmm-germline" else 6
    return kn.runs(kn.hmm_states(smooth, rows["start"], sd, copies))


def segment(df: DataFrame, sample: str = "sample_id", method: str = "haar", alpha: float = 1e-4, skip_outliers: bool = True, min_gap: int = 100_000) -> DataFrame:
    """Segments of each sample and chromosome arm: weighted means and bin counts between breakpoints."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    rows = drop_low_coverage(df).filter("weight > 0 AND log2 IS NOT NULL")
    rows = rows.withColumn("chromosome_", F.col("chromosome")).withColumn("chromosome", F.concat_ws("|", sample, "chromosome"))
    rows = by_arm(rows, ["start", "end", "log2", "weight"], min_gap).withColumn("chromosome", F.col("chromosome_"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "end", "log2", "weight"], kind="stable")
        if skip_outliers:
            group = group[~kn.outliers(group["log2"])]
        out = []
        for lo, hi in _cuts(group, method, alpha):
            part = group.iloc[lo:hi]
            out.append((part[sample].iloc[0], part["chromosome"].iloc[0], int(part["start"].iloc[0]), int(part["end"].max()), float(np.average(part["log2"], weights=part["weight"])), len(part), float(part["weight"].sum())))
        return pd.DataFrame(out, columns=[sample, "chromosome", "start", "end", "log2", "probes", "weight"])

    return grouped(rows, [sample, "chromosome", "arm"], one, SEGMENT.format(keys=f"{sample} string"))


def bintest(df: DataFrame, segments: DataFrame, alpha: float = 0.005) -> DataFrame:
    """Bins whose residual is too great for their weight, with adjusted p-values."""
    pairs = overlap_join(df, segments, "inner").withColumn("z", (F.col("log2") - F.col("r_log2")) / F.sqrt(F.greatest(1 - F.col("weight"), F.lit(1e-9))))

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series(kn.normal_two_sided(z))

    from .signal import p_adjust_bh

    return p_adjust_bh(pairs.withColumn("p", p("z")), ["sample_id"], tie=["chromosome", "start", "end", "gene"]).filter(F.col("q") < alpha).select(*df.columns, "p", "q")


def purity_grid(segments: DataFrame, purities: list[float], ploidies: list[float], copies: int = 8, width: float = 0.1) -> DataFrame:
    """(purity, ploidy, score): how densely segments lie about the ratios that whole copies give. The grid is a short list of settings."""
    spark = segments.sparkSession
    grid = spark.createDataFrame([(float(p), float(q)) for p in purities for q in ploidies], "purity double, ploidy double")
    at = grid.withColumn("cn", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    at = at.withColumn("ratio", (F.col("purity") * F.col("cn") + 2 * (1 - F.col("purity"))) / (F.col("purity") * F.col("ploidy") + 2 * (1 - F.col("purity"))))
    points = at.select("purity", "ploidy", "ratio").collect()  # of the settings, not of the data
    near = F.array(*[F.struct(F.lit(r.purity).alias("purity"), F.lit(r.ploidy).alias("ploidy"), F.lit(r.ratio).alias("ratio")) for r in points])
    score = F.col("weight") * F.exp(-0.5 * F.pow((F.pow(F.lit(2.0), "log2") - F.col("s.ratio")) / width, 2))
    return segments.withColumn("s", F.explode(near)).groupBy("s.purity", "s.ploidy").agg(F.sum(score).alias("score"))


def smooth(df: DataFrame, keys: list[str], kernel: str, width: float) -> DataFrame:
    """df's (keys, start, end, log2) with ``smooth``, by savgol, lowess or median."""
    f = {"savgol": lambda x: kn.savgol(x, int(width)), "lowess": lambda x: kn.lowess(x, width), "median": lambda x: kn.rolling_median(x, width)}[kernel]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "end", "log2"], kind="stable")
        return group.assign(smooth=f(group["log2"].to_numpy(float)))

    cols = [*keys, "start", "end", "log2"]
    types = dict(df.dtypes)
    return grouped(df.select(cols), keys, one, ", ".join(f"`{c}` {types[c]}" for c in cols) + ", smooth double")


def flag_outliers(df: DataFrame, keys: list[str], width: int = 50) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "end", "log2"], kind="stable")
        return group.assign(outlier=kn.outliers(group["log2"].to_numpy(float), width, factor=2.0))

    cols = [*keys, "start", "end", "log2"]
    types = dict(df.dtypes)
    return grouped(df.select(cols), keys, one, ", ".join(f"`{c}` {types[c]}" for c in cols) + ", outlier boolean")


def by_sample(df: DataFrame, sample: str, new: list[str], f: Callable[[Callable[[str], pa.ChunkedArray]], dict[str, np.ndarray]]) -> DataFrame:
    """df with the numbers in its columns ``new`` as f makes them of all rows of a sample; f is given what reads a column of them.

    A sample is one task and its rows come in order. They wait in a file of the worker's own; only the columns that f reads are held in memory.
    """
    order = [sample, "chromosome", "start", "end", "log2"]
    order += [c for c in df.columns if c not in order]
    rows = df.withColumns({c: F.col(c).cast("double") for c in new}).select(df.columns)
    rows = rows.repartition(sample).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])

    def made(path: str) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(path) as file:
            reader = pa.ipc.open_file(file)
            batches = range(reader.num_record_batches)
            columns, at = f(lambda c: pa.chunked_array([reader.get_batch(i).column(c) for i in batches])), 0
            for i in batches:
                batch = reader.get_batch(i)
                for c, x in columns.items():
                    batch = batch.set_column(batch.schema.get_field_index(c), c, pa.array(x[at : at + len(batch)], from_pandas=True))
                at += len(batch)
                yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[object, pa.RecordBatch]]:
            for batch in batches:
                names, lo = batch.column(sample).to_pylist(), 0
                for name, same in groupby(names):
                    size = sum(1 for _ in same)
                    yield name, batch.slice(lo, size)
                    lo += size

        for _, own in groupby(pieces(), key=lambda p: p[0]):
            with tempfile.TemporaryDirectory() as folder:
                path, writer = f"{folder}/rows", None
                for _, batch in own:
                    writer = writer or pa.ipc.new_file(path, batch.schema)
                    writer.write_batch(batch)
                writer.close()
                yield from made(path)

    return rows.mapInArrow(run, rows.schema)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column as doubles, NaN where it is null."""
    return column.cast(pa.float64()).to_numpy()


def center_by_key(df: DataFrame, sample: str, key: str, fraction: float = 0.1) -> DataFrame:
    """log2 corrected for a bias key within each sample, whose windows run over all of it."""
    return by_sample(df, sample, ["log2"], lambda column: {"log2": kn.center_by_window(numbers(column("log2")), numbers(column(key)), fraction)})


def estimates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Biweight location and midvariance, mode and a bootstrap interval per group."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        x, w = group["log2"].to_numpy(float), group["weight"].to_numpy(float)
        order = np.lexsort((w, x))
        lo, hi = kn.bootstrap_ci(x[order], w[order])
        return pd.DataFrame([[*group[keys].iloc[0], kn.biweight_location(x), kn.biweight_midvariance(x), kn.modal_location(x), lo, hi]], columns=[*keys, "location", "midvariance", "mode", "ci_lo", "ci_hi"])

    types = dict(df.dtypes)
    return grouped(df.select(*keys, "log2", "weight"), keys, one, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", location double, midvariance double, mode double, ci_lo double, ci_hi double")


def bic(segments: DataFrame, noise: float) -> DataFrame:
    """Segments merged by BIC within each chromosome; the noise is of the whole sample."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start", kind="stable").reset_index(drop=True)
        start, end, log2, probes, weight = (group[c].to_numpy() for c in ("start", "end", "log2", "probes", "weight"))
        name, out = group["chromosome"].iloc[0], []
        for lo, hi in kn.bic_merge(log2, weight, probes, noise):
            p = slice(lo, hi)  # of arrays: a frame for each of very many segments takes longer than merging them
            out.append((name, int(start[p].min()), int(end[p].max()), float(np.average(log2[p], weights=weight[p])), int(np.nansum(probes[p])), float(np.nansum(weight[p]))))
        return pd.DataFrame(out, columns=["chromosome", "start", "end", "log2", "probes", "weight"])

    return grouped(segments.select("chromosome", "start", "end", "log2", "probes", "weight"), ["chromosome"], one, "chromosome string, start long, end long, log2 double, probes long, weight double")
