"""Substring dedup over a log-structured index of window fingerprints.

The index is a list of immutable runs; a run holds the fingerprints of a batch's distinct 20-word windows,
sorted, in buckets. A new batch is dealt to the same buckets and merge-joined with every run there: a
window found in a run is an earlier one's copy, and so is one that comes earlier in the batch. The batch's own windows
become the next run; when there are more than fan_out, compaction merges them into one. Batches
are added in the order of doc_id, so runs need no places, and a hot passage is one entry.

A fingerprint is the window's anchor (48 bits of the hash of its least 6-word gram, see repeats.py, which
also routes it) and 40 bits of a hash of the whole window; entries are matched by a mix of both
and each match is verified on all 88 bits. Windows of one anchor travel together, 5 bytes each.

An index can be opened again: what runs it has is in its folder, in a manifest that is written after each run.

Defined cases: null text has no words; null doc_id is smaller than any other, and none of such rows is smaller than another; rows of
one doc_id are judged apart, none of them smaller than another, and equal rows get equal results; within an index a batch must not
repeat ids of an earlier one with other texts; empty table, empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed, repeats
from .common import shared_dir
from .ragged import SPACES_BYTES, WORD_BASE, Texts, mix, span_hashes

WINDOW, GRAM, FAN_OUT, WIDTH = 20, 6, 4, 5
_UNITS = repeats.Units(WINDOW, GRAM, words=True, within=True)
_MANIFEST = "version int, buckets int, fan_out int, runs array<string>"
_OUT = "kind int, bucket int, a binary, b binary, c binary"


def _narrow(h: np.ndarray) -> np.ndarray:
    """The upper 5 bytes of hashes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :])


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // WIDTH, 8), np.uint8)
    out[:, 8 - WIDTH :] = np.frombuffer(blob, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _bodies(t: Texts, values: np.ndarray, c: repeats.Chunks) -> tuple[bytes, np.ndarray]:
    at = np.arange(c.count.sum()) + np.repeat(c.start - (np.cumsum(c.count) - c.count), c.count)
    return _narrow(span_hashes(values, at, at + WINDOW, WORD_BASE + 2)).tobytes(), c.count * WIDTH


def _row(kind: int, bucket: int, a: bytes, b: bytes, c: bytes) -> tuple:
    return kind, bucket, a, b, c


def _table(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], pa.binary() if i > 1 else pa.int32()) for i in range(5)], names=names)


def _run_row(bucket: int, key: np.ndarray, window: np.ndarray) -> tuple:
    """A run's fingerprints of one bucket: sorted distinct anchors, their numbers of windows, the windows."""
    order = np.lexsort((window, key))
    key, window = key[order], window[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1])
    key, window = key[new], window[new]
    heads = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
    return _row(1, bucket, repeats._cut(key[heads]).tobytes(), np.diff(np.append(heads, len(key))).astype(np.uint32).tobytes(), _narrow(window).tobytes())


def _run_entries(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    key = [np.repeat(repeats._uncut(a), np.frombuffer(b, np.uint32)) for a, b, _ in rows]
    return (np.concatenate(key), np.concatenate([_wide(c) for *_, c in rows])) if key else (np.zeros(0, np.uint64),) * 2


def _mixed(key: np.ndarray, window: np.ndarray) -> np.ndarray:
    return mix(key) ^ (window * np.uint64(0x9E3779B97F4A7C15))


class FingerprintIndex:
    """Runs of window fingerprints in a folder that all executors share."""

    def __init__(self, spark: SparkSession, n_buckets: int, path: str | None = None, fan_out: int = FAN_OUT):
        self.spark, self.n, self.fan_out = spark, n_buckets, fan_out
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that was written to a folder, as its last manifest has it."""
        last = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        out = cls(spark, last["buckets"], path, last["fan_out"])
        out.runs, out.version = [f"{path}/{r}" for r in last["runs"]], last["version"]
        return out

    def _note(self) -> None:
        self.version += 1
        runs = [r.removeprefix(f"{self.path}/") for r in self.runs]
        self.spark.createDataFrame([(self.version, self.n, self.fan_out, runs)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def add(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """Removed windows of a batch (id, who, text; see repeats.documents()) of later documents, packed by document; with keep, the batch becomes a run."""
        n, old = self.n, None
        for run in self.runs:
            rows = self.spark.read.schema("bucket int, a binary, b binary, c binary").parquet(run)
            old = rows if old is None else old.unionByName(rows)
        entries = repeats.chunk_entries(batch, _UNITS, _bodies, n).select(F.lit(0).alias("age"), "bucket", "key", "doc", "who", "start", "count", "body")
        if old is not None:
            none = F.lit(b"")
            entries = entries.unionByName(old.select(F.lit(1).alias("age"), "bucket", F.col("a").alias("key"), none.alias("doc"), none.alias("who"), none.alias("start"), F.col("b").alias("count"), F.col("c").alias("body")))

        def merge(group: pa.Table) -> pa.Table:
            packed.give_back()  # what the bucket before held
            bucket = group["bucket"][0].as_py()
            age = np.array(group["age"].to_pylist())
            new, history = group.filter(pa.array(age == 0)), group.filter(pa.array(age == 1))
            get = lambda c, kind: np.frombuffer(b"".join(new[c].to_pylist()), kind)
            doc, start, count = get("doc", np.int64), get("start", np.uint32).astype(np.int64), get("count", np.uint32).astype(np.int64)
            who = doc + get("who", np.int64)
            if bucket < 0:
                return _table([_row(0, -1 - bucket, who.tobytes(), start.astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes())])
            key = np.repeat((get("key", np.uint64) >> np.uint64(16)) << np.uint64(16), count)
            window = _wide(b"".join(new["body"].to_pylist()))
            owner = np.repeat(np.arange(len(count)), count)
            place = start[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            gone, _ = repeats.repeats_earlier((key, window), doc[owner], who[owner], place, within=True)
            if len(history):
                k, w = _run_entries(list(zip(*(history[c].to_pylist() for c in ("key", "count", "body")), strict=True)))
                h = _mixed(k, w)
                sort = np.argsort(h, kind="stable")
                k, w, h = k[sort], w[sort], h[sort]
                at = np.minimum(np.searchsorted(h, _mixed(key, window)), len(h) - 1)
                gone |= (k[at] == key) & (w[at] == window)
            rows = [_row(0, b, d.tobytes(), s.astype(np.uint32).tobytes(), c.astype(np.uint32).tobytes()) for b, d, s, c in repeats.removed_runs(gone, who, start, count, n)]
            if keep and not gone.all():
                rows.append(_run_row(bucket, key[~gone], window[~gone]))
            return _table(rows)

        at = f"{self.path}/batch-{len(self.runs)}-{uuid.uuid4().hex[:8]}"
        packed.by_bucket(entries, merge, _OUT).write.partitionBy("kind").parquet(at)
        # what this writes is read by its own schema: a kind without rows has no folder
        found = self.spark.read.schema("bucket int, a binary, b binary, c binary, kind int").parquet(at)
        if keep and not found.filter("kind = 1").isEmpty():
            self.runs.append(f"{at}/kind=1")
            if len(self.runs) > self.fan_out:
                self.compact()
            self._note()
        return found.filter("kind = 0").select("bucket", F.col("a").alias("doc"), F.col("b").alias("start"), F.col("c").alias("count"))

    def compact(self) -> None:
        """Merges all runs into one."""
        rows = self.spark.read.schema("bucket int, a binary, b binary, c binary").parquet(*self.runs)

        def merge(group: pa.Table) -> pa.Table:
            key, window = _run_entries(list(zip(*(group[c].to_pylist() for c in "abc"), strict=True)))
            return _table([_run_row(group["bucket"][0].as_py(), key, window)])

        at = f"{self.path}/compacted-{uuid.uuid4().hex[:8]}"
        packed.by_bucket(rows, merge, _OUT).drop("kind").write.parquet(at)
        self.runs = [at]


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: tuple[float, ...] = (0.25,), index: FingerprintIndex | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """(id, text, spans): every document with the spans of words to remove, null for none.

    The table is added to the index in batches, cut at these quantiles of doc_id. Without an index a new one is made for this
    table alone, and its last batch, which nothing follows, does not become a run.
    """
    spark = docs.sparkSession
    slim, last = repeats.documents(docs, doc_id, text), index is not None
    index = index or FingerprintIndex(spark, repeats.buckets_of(slim, each=2 << 20), fan_out=fan_out)
    cuts = sorted({int(c) for c in (slim.filter(F.col("id") != repeats.NO_ID).approxQuantile("id", list(parts), 0.01) if parts else [])})
    windows, low = None, None
    for high in [*cuts, None]:
        batch = slim if low is None else slim.filter(F.col("id") > low)
        batch = batch if high is None else batch.filter(F.col("id") <= high)
        found = index.add(batch, keep=last or high is not None)
        windows, low = found if windows is None else windows.unionByName(found), high
    return repeats.with_spans(slim, repeats.doc_spans(windows, WINDOW))


def op6_fingerprint_index(spark, sf_dir: str) -> DataFrame:
    docs = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), parts=(0.1, 0.25), fan_out=1)

    def digest(batches):
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or "").encode().translate(SPACES_BYTES).split()
                cut, kept, at = np.frombuffer(spans or b"", np.uint32).tolist(), [], 0
                for lo, hi in zip(cut[::2], cut[1::2], strict=True):
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                rows.append((None if doc == repeats.NO_ID else doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
        packed.give_back()

    return docs.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
