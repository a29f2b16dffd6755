"""Suffix-array dedup of byte strings shared between documents.

Documents are cut to the chunks whose 50-byte windows may occur in another document (repeats.py),
and each bucket of chunks gets a suffix array by two-stage sorting: only the suffixes that are smaller than
their successors are sorted directly; scanning the first-byte buckets in order induces the
others. Adjacent common prefixes then group equal windows; a window is removed if
a document of smaller id holds it. Whole chunks that an earlier document has are settled before, so that copies need no
sorting. Everything is exact: bytes are compared in both, and an anchor's hash only routes.

Defined cases: null text is empty; null doc_id is smaller than any other, and none of such rows is smaller than another; repeats within a document
stay; rows of one doc_id are judged apart, none of them smaller than another, and equal rows get equal results;
empty table, empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import table
from .ragged import Texts

WINDOW, GRAM = 50, 24
#: Bytes of one suffix array; a bucket with more is cut between anchors.
BLOCK = 2 << 20


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number that orders like them."""
    padded = np.concatenate((text, np.zeros(72, np.uint8)))
    return np.ndarray((len(text) + 64,), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes of a byte array, in order of at least their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = _words(text)
    wide = np.append(text.astype(np.int16), np.int16(-1))
    step = np.flatnonzero(wide[:-1] != wide[1:])
    turn = step[np.searchsorted(step, np.arange(n))]  # where the run of equal bytes ends
    rising = wide[turn] < wide[turn + 1]  # smaller than its successor
    direct = np.flatnonzero(rising)
    direct = direct[np.argsort(words[direct], kind="stable")]
    group = np.cumsum(np.diff(words[direct], prepend=words[direct][:1]) != 0) if len(direct) else direct
    for at in range(8, depth, 8):
        tied = np.zeros(len(direct), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        some, of = direct[where], group[where]
        key = words[np.minimum(some + at, n + 63)]
        order = np.lexsort((key, of))
        direct[where] = some[order]
        key, of = key[order], of[order]
        new = np.zeros(len(direct), np.int64)
        new[where[1:]] = (of[1:] == of[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(new)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(text[-1])].append(np.array([n - 1]))  # induced by the empty suffix
    if rising[n - 1]:
        waiting[int(text[-1])].clear()
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        level = front
        while len(level):  # runs of c induce within their own bucket
            level = level[level > 0] - 1
            level = level[(text[level] == c) & ~rising[level]]
            front = np.concatenate((front, level))
        found = np.concatenate((front, direct[bounds[c] : bounds[c + 1]]))
        out.append(found)
        before = found[found > 0] - 1
        before = before[~rising[before] & (text[before] > c)]
        if len(before):
            order = before[np.argsort(text[before], kind="stable")]
            first = text[order]
            for lo, hi in zip(at := np.flatnonzero(np.diff(first, prepend=first[0] ^ 1)), np.append(at[1:], len(order)), strict=True):
                waiting[int(first[lo])].append(order[lo:hi])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Whether each place but the first shares ``depth`` bytes with the one before it."""
    words = _words(text)
    a, b = places[:-1], places[1:]
    same = np.ones(len(a), bool)
    for at in [*range(0, depth - 7, 8), depth - 8]:
        same &= words[a + at] == words[b + at]
    return same


def settle(key, doc, start, count, size, body: bytes) -> np.ndarray:
    """Which windows of a bucket's chunks also start in a document of smaller id."""
    ends = np.cumsum(size)
    # copies of a chunk of an earlier document need no sorting: all their windows go
    cut, first = [body[e - s : e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)], {}
    ids = doc.tolist()
    for i in np.argsort(doc, kind="stable").tolist():
        first.setdefault(cut[i], ids[i])
    copy = np.array([d > first[c] for c, d in zip(cut, ids, strict=True)], bool)
    gone = np.repeat(copy, count)
    order = np.argsort(key, kind="stable")
    order = order[~copy[order]]
    total = np.cumsum(size[order])
    first_window, text = np.cumsum(count) - count, np.frombuffer(body, np.uint8)
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK, "right")))
        while hi < len(order) and key[order[hi]] == key[order[hi - 1]]:
            hi += 1  # an anchor's chunks stay together
        some = order[lo:hi]
        part = np.concatenate([text[e - s : e] for e, s in zip(ends[some].tolist(), size[some].tolist(), strict=True)])
        begin = np.cumsum(size[some]) - size[some]
        owner = np.repeat(np.arange(len(some)), count[some])
        nth = np.arange(len(owner)) - (np.cumsum(count[some]) - count[some])[owner]
        is_window = np.full(len(part), -1)
        is_window[begin[owner] + nth] = np.arange(len(owner))
        places = suffix_array(part, WINDOW)
        places = places[is_window[places] >= 0]
        window = is_window[places]
        group = np.concatenate(([0], np.cumsum(~common_prefixes(part, places, WINDOW))))
        docs = doc[some][owner[window]]
        least = np.minimum.reduceat(docs, np.flatnonzero(np.diff(group, prepend=-1)))[group]
        hit = window[docs > least]
        gone[first_window[some][owner[hit]] + nth[hit]] = True
        lo = hi
    return gone


def _bodies(t: Texts, values: np.ndarray, c: repeats.Chunks) -> tuple[bytes, np.ndarray]:
    size = c.count + (WINDOW - 1)
    at = np.arange(size.sum()) + np.repeat(c.start - (np.cumsum(size) - size), size)
    return t.data[at].tobytes(), size


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, spans): every document with the byte spans to remove, null for none."""
    u = repeats.Units(WINDOW, GRAM, words=False, within=False)
    slim = repeats.documents(docs, doc_id, text)
    n = repeats.buckets_of(slim, each=2 << 20)
    found = repeats.packed.by_bucket(repeats.anchor_entries(slim, u, n), lambda g: repeats.repeated(g, n), repeats.packed.schema(2))
    flags = table(repeats.flagged_docs(found), "suffix-flags")
    chunks = repeats.chunk_entries(repeats.flagged_texts(slim, flags), u, _bodies, n)
    spans = repeats.doc_spans(repeats.settled(chunks, settle, n), WINDOW)
    return repeats.with_spans(slim, spans)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = shared_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def digest(batches):
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, cut = (text or "").encode(), np.frombuffer(spans or b"", np.uint32).tolist()
                hashed, at = hashlib.sha256(), 0
                for lo, hi in zip(cut[::2], cut[1::2], strict=True):
                    hashed.update(raw[at:lo])
                    at = hi
                hashed.update(raw[at:])
                gone = sum(min(hi, len(raw)) - min(lo, len(raw)) for lo, hi in zip(cut[::2], cut[1::2], strict=True))
                rows.append((None if doc == repeats.NO_ID else doc, len(raw), gone, len(cut) // 2, hashed.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(5)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
