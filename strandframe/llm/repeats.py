"""Where fixed-length windows of documents occur more than once, in bounded memory.

A window of N units (bytes or words) holds an anchor: the k-gram of least hash in it, the leftmost of
equals. Equal windows have equal anchors, so only windows whose anchor repeats need comparing, and
those that share one anchor (a chunk) travel together:

1. anchors: every document's anchor hashes meet in hash buckets; repeated ones are flagged
   at their documents;
2. chunks: flagged documents send the chunks of their flagged anchors to buckets of the anchor's
   hash, where the operator compares the windows (suffix arrays, or runs of window hashes);
3. spans: covered units are gathered per document.

Entries travel as packed arrays, a few large rows; buckets grow in number with the input, not in size. Keys
and chunks that repeat within a worker's flush are settled there, byte for byte, so a hot passage sends one
chunk a flush, not one a document.

A document is known by two numbers: ``id`` orders it, ``who`` tells it from others. They are the same but
for rows without an id or whose id has several texts; there ``who`` is a hash of id and text. So equal rows are one
document, and rows of one id with different texts are documents of which none comes before the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import small, table
from .ragged import BYTE_VALUE, IS_SPACE, WORD_BASE, Texts, mix, pieces, span_hashes, split_words

_AT = 28  # low bits that hold a place while anchors are chosen
NO_ID = -(2**63)


@dataclass
class Units:
    """What windows are made of: a window's units, an anchor's units, whether repeats within a document count."""

    window: int
    gram: int
    words: bool
    within: bool

    def of(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(values, offsets of the rows)."""
        if not self.words:
            return BYTE_VALUE[t.data], t.offsets
        w = split_words(t, ~IS_SPACE)
        return w.hashes, w.bounds(len(t.offsets) - 1)


@dataclass
class Chunks:
    """Runs of windows that share one anchor: the anchor's hash, row, first window within the values, windows."""

    key: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray

    def take(self, which: np.ndarray) -> Chunks:
        return Chunks(self.key[which], self.row[which], self.start[which], self.count[which])


def chunks_of(values: np.ndarray, offsets: np.ndarray, u: Units) -> Chunks:
    none = Chunks(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    n = len(values) - u.gram + 1
    if len(values) < u.window:
        return none
    grams = span_hashes(values, np.arange(n), np.arange(u.gram, n + u.gram), WORD_BASE)
    low = np.uint64((1 << _AT) - 1)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)
    width, want = 1, u.window - u.gram + 1
    while width < want:  # least of ever wider runs of grams
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & low).astype(np.int64)
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= u.window)
    per = size[rows] - u.window + 1
    if not len(rows):
        return none
    starts = np.arange(per.sum()) + np.repeat(offsets[rows] - (np.cumsum(per) - per), per)
    row, anchor = np.repeat(rows, per), anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    return Chunks(grams[anchor[at]], row[at], starts[at], np.diff(np.append(at, len(starts))))


def _sorted_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, sizes) of the groups of equal keys[0], each sorted by the further keys."""
    order = np.lexsort(keys[::-1])
    first = keys[0][order]
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(first)))


def _cut(key: np.ndarray) -> np.ndarray:
    """The upper 6 bytes of each key, as bytes."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def _uncut(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, who, text) of every row."""
    slim = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text}`").alias("text"))
    own = F.xxhash64("id", F.coalesce("text", F.lit("")))
    several = slim.filter(F.col("id") != NO_ID).groupBy("id").agg(F.count("*").alias("n"), F.min(own).alias("lo"), F.max(own).alias("hi")).filter("lo <> hi")
    several = small(table(several.select("id", F.lit(True).alias("__several")), "ids-of-several-texts"))
    who = F.when(F.col("__several") | (F.col("id") == NO_ID), own).otherwise(F.col("id"))
    return slim.join(several, "id", "left").select("id", who.alias("who"), "text")


def _ids(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return np.asarray(batch.column(column), np.int64)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """The bucket of anchor hashes. They are least ones, which crowd at the low end, so they are mixed first."""
    return (((mix(key) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _runs(bucket: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal numbers."""
    at = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(bucket)], strict=True)) if len(bucket) else []


def to_docs(doc: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Entries dealt by document."""
    bucket = ((mix(doc.view(np.uint64)) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    order = np.lexsort((doc, bucket))
    for lo, hi in _runs(bucket[order]):
        yield int(bucket[order[lo]]), [c[order[lo:hi]] for c in (doc, *columns)]


def anchor_entries(docs: DataFrame, u: Units, n: int) -> DataFrame:
    """(bucket, c0: keys, c1: documents as differences): anchors dealt by hash. Buckets below 0 hold, dealt by document, those
    that repeat within a flush; c0 then has the low 32 bits of the cut keys."""

    def flush(keys: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, starts, size = _sorted_groups(keys, doc)
        keys, doc = keys[order], doc[order]
        many = np.repeat(size > 1, size)
        names, c0, c1 = [], [], []
        for bucket, (d, k) in to_docs(doc[many], [((keys[many] >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)], n):
            names.append(-1 - bucket)
            c0.append(k.tobytes())
            c1.append(np.diff(d, prepend=0).tobytes())
        keys, doc = keys[starts], doc[starts]
        bucket = bucket_of(keys, n)
        order = np.lexsort((doc, bucket))
        keys, doc, bucket = keys[order], doc[order], bucket[order]
        for lo, hi in _runs(bucket):
            names.append(int(bucket[lo]))
            c0.append(_cut(keys[lo:hi]).tobytes())
            c1.append(np.diff(doc[lo:hi], prepend=0).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(c0, pa.binary()), pa.array(c1, pa.binary())], names=["bucket", "c0", "c1"])

    def scan(batches):
        keys, doc, held = [], [], 0
        for batch in batches:
            ids = _ids(batch)
            for t in pieces(batch.column(1)):
                c = chunks_of(*u.of(t), u)
                k, d = c.key, ids[t.first + c.row]
                if not u.within and len(k):
                    order = np.lexsort((d, k))
                    k, d = k[order], d[order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                    k, d = k[new], d[new]
                keys.append(k)
                doc.append(d)
                held += len(k)
                if held >= packed.FLUSH:
                    yield from flush(np.concatenate(keys), np.concatenate(doc))
                    keys, doc, held = [], [], 0
        if held:
            yield from flush(np.concatenate(keys), np.concatenate(doc))

    return docs.select("who", "text").mapInArrow(scan, packed.schema(2))


def decoded(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents) of the rows of a bucket of anchor_entries()."""
    keys = [_uncut(b) for b in group["c0"].to_pylist()]
    docs = [np.cumsum(np.frombuffer(b, np.int64)) for b in group["c1"].to_pylist()]
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def low_bits(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def doc_rows(doc: np.ndarray, value: np.ndarray, n: int) -> pa.Table:
    """Packed rows dealt by document: (bucket, c0: values, c1: documents)."""
    names, c0, c1 = [], [], []
    for bucket, (d, v) in to_docs(doc, [value], n):
        names.append(bucket)
        c0.append(v.tobytes())
        c1.append(np.diff(d, prepend=0).tobytes())
    return pa.table([pa.array(names, pa.int32()), pa.array(c0, pa.binary()), pa.array(c1, pa.binary())], names=["bucket", "c0", "c1"])


def repeated(group: pa.Table, n: int) -> pa.Table:
    """Of one bucket: packed rows dealt by document, of anchors found twice."""
    bucket = group["bucket"][0].as_py()
    if bucket < 0:
        return group.set_column(0, "bucket", pa.array([-1 - bucket] * len(group), pa.int32()))
    keys, doc = decoded(group)
    order, starts, size = _sorted_groups(keys, doc)
    many = np.repeat(size > 1, size)
    return doc_rows(doc[order][many], low_bits(keys[order][many]), n)


def flagged_docs(entries: DataFrame) -> DataFrame:
    """(who, flags): each document's repeated anchors, sorted, from packed rows dealt by document."""

    def gather(group: pa.Table) -> pa.Table:
        doc = np.concatenate([np.cumsum(np.frombuffer(b, np.int64)) for b in group["c1"].to_pylist()])
        key = np.concatenate([np.frombuffer(b, np.uint32) for b in group["c0"].to_pylist()])
        order, starts, size = _sorted_groups(doc, key)
        doc, key = doc[order], key[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        ends = np.cumsum(np.add.reduceat(new, starts, dtype=np.int64)) if len(starts) else np.zeros(0, np.int64)
        blob, lo = key[new].tobytes(), np.concatenate(([0], ends[:-1])) * 4
        return pa.table([pa.array(doc[starts]), pa.array([blob[a:b] for a, b in zip(lo.tolist(), (ends * 4).tolist(), strict=True)], pa.binary())], names=["who", "flags"])

    return packed.by_bucket(entries, gather, "who long, flags binary")


#: Of the chunks of a bucket (key, id, start, windows, size of content, contents): which windows repeat earlier ones.
Settle = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes], np.ndarray]
#: doc: ids; who: who less id, mostly 0.
CHUNK_SCHEMA = "bucket int, key binary, doc binary, who binary, start binary, count binary, body binary, size binary"


def _chunk_row(bucket: int, key, doc, who, start, count, body: bytes, size) -> list:
    return [bucket, key.tobytes(), doc.tobytes(), (who - doc).tobytes(), start.astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes(), body, size.astype(np.uint32).tobytes()]


def _chunk_batch(rows: list[list]) -> pa.RecordBatch:
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(len(names))], names=names)


def repeats_earlier(group: tuple[np.ndarray, ...], doc: np.ndarray, who: np.ndarray, start: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in groups of equal keys: (whether one of a smaller id, or with ``within`` of the same document and an earlier start, is in the group too; the group's entry of least id)."""
    order = np.lexsort((start, who, doc, *group[::-1]))
    w, d, s = who[order], doc[order], start[order]
    head = np.zeros(len(order), bool)
    head[:1] = True
    for g in group:
        head[1:] |= g[order[1:]] != g[order[:-1]]
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    gone = d > d[first]
    if within:
        own = head.copy()
        own[1:] |= (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        gone |= s > s[np.maximum.accumulate(np.where(own, np.arange(len(order)), 0))]
    out, least = np.zeros(len(order), bool), np.empty(len(order), np.int64)
    out[order], least[order] = gone, order[first]
    return out, least


def chunk_entries(docs: DataFrame, u: Units, body: Callable[[Texts, np.ndarray, Chunks], tuple[bytes, np.ndarray]], n: int) -> DataFrame:
    """Chunks of (id, who, text), of flagged anchors only if there is a further column flags, dealt by the anchor's hash. Copies within a
    flush of an earlier chunk are settled at once: buckets below 0 have them, dealt by document, as removed windows."""

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        key, doc, who, start, count, mark, size = (np.concatenate([p[i] for p in parts]) for i in range(7))
        blob = b"".join(p[7] for p in parts)
        ends = np.cumsum(size)
        gone, least = repeats_earlier((mark,), doc, who, start, u.within)
        content = lambda i: blob[ends[i] - size[i] : ends[i]]
        for i in np.flatnonzero(gone).tolist():  # equal marks are not trusted
            gone[i] = content(i) == content(least[i])
        rows = []
        for bucket, (w, s, c) in to_docs(who[gone], [start[gone], count[gone]], n):
            rows.append(_chunk_row(-1 - bucket, key[:0], w, w, s, c, b"", s[:0]))
        stay = np.flatnonzero(~gone)
        bucket = bucket_of(key[stay], n)
        by = np.argsort(bucket, kind="stable")
        order, bucket = stay[by], bucket[by]
        for lo, hi in _runs(bucket):
            w = order[lo:hi]
            text = b"".join([blob[a:b] for a, b in zip((ends[w] - size[w]).tolist(), ends[w].tolist(), strict=True)])
            rows.append(_chunk_row(int(bucket[lo]), key[w], doc[w], who[w], start[w], count[w], text, size[w]))
        yield _chunk_batch(rows)

    def scan(batches):
        parts, held = [], 0
        for batch in batches:
            ids, who, flags = _ids(batch), _ids(batch, 1), batch.column(3) if batch.num_columns > 3 else None
            for t in pieces(batch.column(2)):
                values, offsets = u.of(t)
                c = chunks_of(values, offsets, u)
                rows = len(t.offsets) - 1
                if flags is not None:
                    mine = [np.frombuffer(flags[t.first + i].as_py(), np.uint32) for i in range(rows)]
                    # flags of all rows as one array of (row, flag)
                    have = np.repeat(np.arange(rows, dtype=np.uint64), [len(m) for m in mine]) << np.uint64(32) | np.concatenate(mine).astype(np.uint64)
                    want = c.row.astype(np.uint64) << np.uint64(32) | low_bits(c.key).astype(np.uint64)
                    c = c.take(np.isin(want, have))
                if not len(c.key):
                    continue
                blob, size = body(t, values, c)
                content = span_hashes(values, c.start, c.start + c.count + (u.window - 1), WORD_BASE)
                parts.append((c.key, ids[t.first + c.row], who[t.first + c.row], c.start - offsets[c.row], c.count, content, size, blob))
                held += len(blob)
                if held >= 4 << 20:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)
        parts = []
        packed.give_back()

    return docs.mapInArrow(scan, CHUNK_SCHEMA)


def removed_runs(gone: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, n: int) -> list[tuple]:
    """(bucket, documents, first windows, windows) of the runs of removed windows of chunks, dealt by document."""
    if not gone.any():
        return []
    owner = np.repeat(np.arange(len(count)), count)
    first = np.ones(len(gone), bool)
    first[1:] = (owner[1:] != owner[:-1]) | ~gone[:-1]
    heads = np.flatnonzero(gone & first)
    total = np.concatenate(([0], np.cumsum(gone)))
    length = total[np.append(heads[1:], len(gone))] - total[heads]
    at = start[owner[heads]] + heads - (np.cumsum(count) - count)[owner[heads]]
    return [(b, *c) for b, c in to_docs(doc[owner[heads]], [at, length], n)]


SPAN_SCHEMA = "bucket int, doc binary, start binary, count binary"


def settled(chunks: DataFrame, settle: Settle, n: int) -> DataFrame:
    """Removed windows of each bucket as (first window, windows) runs, packed rows dealt by document."""

    def one(group: pa.Table) -> pa.Table:
        packed.give_back()  # what the bucket before held
        bucket = group["bucket"][0].as_py()
        get = lambda c, kind: np.frombuffer(b"".join(group[c].to_pylist()), kind)
        doc, start, count = get("doc", np.int64), get("start", np.uint32).astype(np.int64), get("count", np.uint32).astype(np.int64)
        who = doc + get("who", np.int64)
        if bucket < 0:
            runs = [(-1 - bucket, who, start, count)]
        else:
            size = get("size", np.uint32).astype(np.int64)
            gone = settle(get("key", np.uint64), doc, start, count, size, b"".join(group["body"].to_pylist()))
            runs = removed_runs(gone, who, start, count, n)
        rows = [[b, d.tobytes(), s.astype(np.uint32).tobytes(), c.astype(np.uint32).tobytes()] for b, d, s, c in runs]
        names = [c.split()[0] for c in SPAN_SCHEMA.split(", ")]
        return pa.table([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(4)], names=names)

    return packed.by_bucket(chunks, one, SPAN_SCHEMA)


def doc_spans(windows: DataFrame, window: int) -> DataFrame:
    """(who, spans): the units that removed windows cover, as uint32 (start, end) pairs of maximal runs."""

    def gather(group: pa.Table) -> pa.Table:
        get = lambda c, kind: np.frombuffer(b"".join(group[c].to_pylist()), kind)
        doc, start, count = get("doc", np.int64), get("start", np.uint32).astype(np.int64), get("count", np.uint32).astype(np.int64)
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], (start + count + window - 1)[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = doc[1:] != doc[:-1]
        # ends so far within the document: documents are lifted apart so that one running maximum does
        lift = np.cumsum(fresh) * (np.int64(1) << 33)
        reach = np.maximum.accumulate(end + lift)
        new = fresh.copy()
        new[1:] |= start[1:] + lift[1:] > reach[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(doc)) - 1 if len(at) else at
        pairs = np.stack((start[at], reach[last] - lift[last]), 1).astype(np.uint32)
        heads = np.flatnonzero(np.diff(doc[at], prepend=doc[at][:1] - 1)) if len(at) else at
        blob, bounds = pairs.tobytes(), np.append(heads, len(at)) * 8
        return pa.table([pa.array(doc[at][heads]), pa.array([blob[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], names=["who", "spans"])

    return packed.by_bucket(windows, gather, "who long, spans binary")


def flagged_texts(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, who, text, flags) of the flagged documents; flags is a written table."""
    ids = small(flags.select("who"))
    return docs.join(ids, "who", "left_semi").join(flags, "who").select("id", "who", "text", "flags")


def buckets_of(docs: DataFrame, text: str = "text", each: int = 4 << 20) -> int:
    """Buckets that keep one to a few times ``each`` bytes of text apiece."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(16, -(-total // each))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text, spans) of every row of (id, who, text); spans null where nothing is removed."""
    return docs.join(small(table(spans, "spans")), "who", "left").select("id", "text", "spans")
