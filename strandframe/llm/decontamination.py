"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by size (shingle count, powers of two). Of each item with n shingles
the floor(n / 5) + 1 with the smallest hashes, its bottom-k MinHash sketch, are probes: a document
that contains 80% of the shingles lacks at most floor(n / 5), so it holds one probe at least
and no contained item is missed. (Signatures of whole documents can't do that: against a long
document the Jaccard similarity of a short item is next to 0.) A document is only met with the partitions of
items that are small enough to lie in it. Documents are scanned once, as they lie,
with no shuffle; a document that holds a probe is verified by the words of its shingles. Items
go to the executors as text and sorted arrays of probes, in blocks of at most BLOCK_BYTES of text, each block one scan.

Words are runs of ASCII letters, digits and any byte above 127, A-Z lower-cased. Defined cases:
null or empty texts and items of fewer than five words hold no shingle and match nothing;
repeated documents each get their rows; repeated items match each on its own; an empty table on either side gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import ASCII_LOWER, Texts, grams, pieces, split_words

SHINGLE, PERCENT = 5, 80
BLOCK_BYTES = 32 << 20
IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class Items:
    """Sketches and texts of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [item_id for item_id, _ in items]
        raw = [(text or "").encode() for _, text in items]
        self.texts = Texts(0, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))))
        words = split_words(self.texts, IS_WORD, ASCII_LOWER)
        at, hashes = grams(words, SHINGLE)
        row = words.row[at]
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        row, hashes = row[new], hashes[new]
        size = np.bincount(row, minlength=len(items))
        nth = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        probe = nth < (size * (100 - PERCENT) // 100 + 1)[row]
        row, hashes = row[probe], hashes[probe]
        partition = np.frexp(size)[1][row]  # powers of two
        #: of each partition: the least size in it, probes in order, the item of each
        self.partitions = []
        for c in np.unique(partition).tolist():
            mine = np.flatnonzero(partition == c)
            mine = mine[np.argsort(hashes[mine], kind="stable")]
            self.partitions.append((int(size[row[mine]].min()), hashes[mine], row[mine].astype(np.int32)))
        self.filter = np.zeros(1 << 22, bool)  # low bits of all probes: most shingles end here
        self.filter[hashes & np.uint64(len(self.filter) - 1)] = True
        self.known: dict[int, frozenset] = {}

    def shingles(self, item: int) -> frozenset:
        """The shingles of an item, as text; those of items met before are kept up to a number."""
        found = self.known.get(item)
        if found is None:
            raw = np.frombuffer(self.texts.text(item), np.uint8)
            one = Texts(0, raw, np.array([0, len(raw)]))
            words = split_words(one, IS_WORD, ASCII_LOWER)
            found = frozenset(strings(one, words, grams(words, SHINGLE)[0]))
            if len(self.known) >= 2000:
                self.known.clear()
            self.known[item] = found
        return found

    def search(self, texts: Texts):
        """(row, item, shingles, shared shingles) for each item that is contained in a row."""
        words = split_words(texts, IS_WORD, ASCII_LOWER)
        at, hashes = grams(words, SHINGLE)
        of_row = words.row[at]
        held = np.bincount(of_row, minlength=len(texts.offsets))
        near = self.filter[hashes & np.uint64(len(self.filter) - 1)]
        some, rows = hashes[near], of_row[near]
        pairs = set()
        for least, probes, of in self.partitions:
            able = held[rows] * 100 >= least * PERCENT
            lo = np.searchsorted(probes, some[able], "left")
            n = np.searchsorted(probes, some[able], "right") - lo
            hit = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            pairs.update(zip(np.repeat(rows[able], n).tolist(), of[hit].tolist(), strict=True))
        by_row = defaultdict(list)
        for row, item in pairs:
            by_row[row].append(item)
        for row, found in sorted(by_row.items()):
            lo, hi = np.searchsorted(of_row, [row, row + 1])
            held_here = set(strings(texts, words, at[lo:hi]))
            for item in sorted(found):
                wanted = self.shingles(item)
                shared = len(wanted & held_here)
                if shared * 100 >= PERCENT * len(wanted):
                    yield row, item, len(wanted), shared


def strings(texts: Texts, words, at: np.ndarray) -> list[bytes]:
    """The shingles that start at the words ``at``, as text."""
    raw = ASCII_LOWER[texts.data].tobytes()
    cut = [raw[s:e] for s, e in zip(words.starts[at[0] :].tolist(), words.ends[at[0] :].tolist(), strict=True)][: at[-1] - at[0] + SHINGLE] if len(at) else []
    return [b" ".join(cut[i : i + SHINGLE]) for i in (at - at[0]).tolist()] if len(at) else []


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int):
    """Blocks of items, read one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`")).toLocalIterator():
        block.append(tuple(r))
        size += len(r[1] or "")
        if size >= most:
            yield block
            block, size = [], 0
    yield block


def contained_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items of which a document holds at least 80% of the shingles."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_shingles long, n_shared long"
    arrow = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
    slim, out = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(Items(block))

        def scan(batches, sent=sent):
            items = sent.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[t.first + row], items.ids[i], of, n) for t in pieces(batch.column(1)) for row, i, of, n in items.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], schema=arrow)

        part = slim.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that contain no item, whatever their other columns hold."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(Items(block))

        def scan(batches, sent=sent):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for t in pieces(batch.column(at)):
                    for row, *_ in sent.value.search(t):
                        keep[t.first + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


CONTAINED_SQL = r"""
split_docs AS (SELECT doc_id, row_number() OVER () AS doc_row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {docs}),
split_items AS (SELECT item_id, row_number() OVER () AS item_row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_shingles AS (SELECT DISTINCT doc_id, doc_row, w[i:i + 4] AS s FROM (SELECT doc_id, doc_row, w, unnest(generate_series(1, len(w) - 4)) AS i FROM split_docs)),
item_shingles AS (SELECT DISTINCT item_id, item_row, w[i:i + 4] AS s FROM (SELECT item_id, item_row, w, unnest(generate_series(1, len(w) - 4)) AS i FROM split_items)),
item_sizes AS (SELECT item_row, count(*) AS n_shingles FROM item_shingles GROUP BY item_row),
shared AS (SELECT doc_id, doc_row, item_id, n_shingles, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (s) JOIN item_sizes USING (item_row)
  GROUP BY doc_id, doc_row, item_id, item_row, n_shingles HAVING count(*) * 100 >= 80 * n_shingles),
contained AS (SELECT doc_id, item_id, n_shingles, n_shared FROM shared)
"""
SQL = "WITH " + CONTAINED_SQL.format(docs="documents") + "SELECT *, n_shared / n_shingles AS containment FROM contained"
