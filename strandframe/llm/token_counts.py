"""Token counts by rank-synchronous merging of ragged arrays.

A piece model splits text where a space follows something else: no piece reaches over that
place (checked when the model is loaded), so the parts between are counted alone. The parts of
a batch are hashed and only new ones are merged: their symbols stand in one ragged array, and
every round applies the lowest-ranked pair (the leftmost of equals) of every part at once, until none has a
pair left. Surviving symbols are tokens; characters outside the vocabulary count their UTF-8 bytes.
Of parts of more than LONG symbols, the places of the lowest rank are merged all at once, rank after rank (_by_rank).

Only documents move through Python, in pieces of bounded size; what a worker remembers is bounded
by KNOWN parts. Defined cases: null and empty texts have no tokens; repeated rows get equal results; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import BASE, BYTE_VALUE, pieces, span_hashes

LONG, KNOWN = 256, 600_000
SPACE = "▁"
_NONE = np.iinfo(np.int64).max


class PieceModel:
    """The merge table of a BPE piece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        if any(model.is_unused(i) for i in every):
            raise ValueError("models with unused pieces are not supported")
        plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        names = {model.id_to_piece(i): i for i in plain}
        if any(a != SPACE and b == SPACE for name in names for a, b in zip(name, name[1:], strict=False)):
            raise ValueError("a piece reaches over the start of a word")
        scores = {name: model.get_score(i) for name, i in names.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(names)
        for c in sorted({c for name in names for c in name} - set(names)):
            symbols[c] = len(every) + len(symbols)
        bits = self.bits = max(symbols.values()).bit_length()
        table = {}
        for name, i in names.items():
            for cut in range(1, len(name)):
                if name[:cut] in symbols and name[cut:] in symbols:
                    table[symbols[name[:cut]] << bits | symbols[name[cut:]]] = (order[scores[name]], i)
        self.keys = np.array(sorted(table), np.int64)
        self.rank = np.array([table[k][0] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.merged = np.array([table[k][1] for k in self.keys.tolist()] + [0], np.int64)
        #: symbols whose making can make a pair of no higher rank than their own
        self.hasty = np.zeros(max(symbols.values()) + 1, bool)
        own = {i: order[scores[name]] for name, i in names.items()}
        for key, (rank, _) in table.items():
            for part in (key >> bits, key & ((1 << bits) - 1)):
                self.hasty[part] |= own.get(part, -1) >= rank
        # of a code point: its symbol, or minus its UTF-8 bytes
        self.symbol = -np.repeat([1, 2, 3, 4], [0x80, 0x780, 0xF800, 0x100000]).astype(np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.symbol[0x20] = self.symbol[ord(SPACE)]
        #: tokens that a symbol is: 1, unless its character is no piece
        self.tokens = np.ones(max(symbols.values()) + 1, np.int64)
        for c, i in symbols.items():
            if c not in names:
                self.tokens[i] = len(c.encode())

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the merge table; its end for those that don't merge."""
        key = np.where((left >= 0) & (right >= 0), left << self.bits | right, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at, len(self.keys))

    def count(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each part; symbols holds the parts one after the other."""
        out, ids = np.zeros(len(lengths), np.int64), np.arange(len(lengths))
        far = lengths > LONG
        if far.any():
            out[far] = self._by_rank(symbols[np.repeat(far, lengths)], lengths[far])
        keep = lengths <= LONG
        symbols, lengths, ids = symbols[np.repeat(keep, lengths)], lengths[keep], ids[keep]

        def survivors(symbols, lengths, ids):
            each = np.where(symbols >= 0, self.tokens[np.maximum(symbols, 0)], -symbols)
            total = np.concatenate(([0], np.cumsum(each)))
            ends = np.cumsum(lengths)
            out[ids] = total[ends] - total[ends - lengths]

        at = np.full(len(symbols), len(self.keys))
        if len(symbols):
            at[:-1] = self.pairs(symbols[:-1], symbols[1:])
            at[np.cumsum(lengths) - 1] = len(self.keys)  # no pair over the end of a part
        while len(symbols):
            rank, starts = self.rank[at], np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                gone = np.repeat(done, lengths)
                survivors(symbols[gone], lengths[done], ids[done])
                symbols, at, rank, lengths, ids, least = symbols[~gone], at[~gone], rank[~gone], lengths[~done], ids[~done], least[~done]
                if not len(symbols):
                    break
                starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            part = np.searchsorted(starts, hits, "right") - 1
            hits = hits[np.concatenate(([True], part[1:] != part[:-1]))]  # the leftmost of each part
            symbols[hits] = self.merged[at[hits]]
            at[hits] = at[hits + 1]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, at, hits, lengths = symbols[keep], at[keep], hits - np.arange(len(hits)), lengths - 1
            starts = np.cumsum(lengths) - lengths
            last = starts + lengths - 1
            right = hits[hits != last]
            at[right] = self.pairs(symbols[right], symbols[right + 1])
            at[hits[hits == last]] = len(self.keys)
            left = hits[hits != starts] - 1
            at[left] = self.pairs(symbols[left], symbols[left + 1])
        return out

    def _by_rank(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of long parts: rank by rank, all places of all parts whose pair has the least rank are merged at once.

        That is the order of merging one pair after the other, as long as a merge makes no pair of a lower rank; of pieces
        that could (self.hasty), the places up to the first that does are merged, and the rest wait. Rounds are bounded by ranks, not by the length of a part.
        """
        n, none = len(symbols), len(self.keys)
        part = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = -1, -1
        live, pair = np.ones(n, bool), np.full(n, none)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(places: np.ndarray) -> None:
            """Finds the pairs that start at some places, and lines them up by rank."""
            right = after[places]
            pair[places] = np.where(right >= 0, self.pairs(symbols[places], symbols[right]), none)
            rank = self.rank[pair[places]]
            order = np.argsort(rank, kind="stable")
            order = order[: np.searchsorted(rank[order], _NONE)]
            if len(order):
                places, rank = places[order], rank[order]
                cut = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
                for r, some in zip(rank[cut].tolist(), np.split(places, cut[1:]), strict=True):
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(some)

        look(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at] & (self.rank[pair[at]] == r)]
            if not len(at):
                continue
            every = at
            chain = np.concatenate(([True], after[at[:-1]] != at[1:]))  # places that overlap the one before: every other is merged
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            new = self.merged[pair[at]]
            if self.hasty[new].any():  # none after the first of its part that makes a pair of no higher rank
                left, right = before[at], after[after[at]]
                beside = symbols[left]
                beside[1:] = np.where(left[1:] == after[at[:-1]], new[:-1], beside[1:])
                made = np.minimum(self.rank[np.where(left >= 0, self.pairs(beside, new), none)], self.rank[np.where(right >= 0, self.pairs(new, symbols[right]), none)])
                hasty = np.cumsum(made <= r) - (made <= r)
                head = np.concatenate(([True], part[at[1:]] != part[at[:-1]]))
                keep = hasty == hasty[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
                at, new = at[keep], new[keep]
            gone = after[at]
            symbols[at] = new
            live[gone] = False
            after[at] = after[gone]
            some = after[at] >= 0
            before[after[at][some]] = at[some]
            pair[at] = none
            left = before[at]
            look(np.unique(np.concatenate((at, left[left >= 0]))))
            rest = every[live[every] & (self.rank[pair[every]] == r)]
            if len(rest):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(rest)
        each = np.where(symbols >= 0, self.tokens[np.maximum(symbols, 0)], -symbols)
        return np.bincount(part[live], weights=each[live], minlength=len(lengths)).astype(np.int64)


class Counter:
    """Counts texts with a model; remembers up to KNOWN parts."""

    def __init__(self, path: str):
        self.model, self.known = PieceModel(path), {}

    def counts(self, column: pa.Array) -> np.ndarray:
        # the library takes SPACE for a space, and puts one before a text that isn't empty
        column = pc.replace_substring(column.fill_null(""), SPACE, " ")
        column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar("", column.type), column, pa.scalar(" ", column.type)))
        out = np.zeros(len(column), np.int64)
        for t in pieces(column):
            if len(t.data):
                self._piece(t, out[t.first : t.first + len(t.offsets) - 1])
        return out

    def _piece(self, t, out: np.ndarray) -> None:
        space = t.data == 32
        first = np.zeros(len(space) + 1, bool)
        first[t.offsets] = True
        starts = np.flatnonzero(first[:-1] | (space & ~np.concatenate(([True], space[:-1]))))
        ends = np.append(starts[1:], len(space))
        # 112 bits name a part: the hash is looked up, the upper bits of a second one are kept beside the count
        hashes, checks = (span_hashes(BYTE_VALUE[t.data], starts, ends, base) for base in (BASE, BASE + 2))
        checks = checks >> np.uint64(16)
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if (checks != checks[where][back]).any():  # unlike parts of one hash
            _, where, back = np.unique(np.stack((hashes, checks), 1), axis=0, return_index=True, return_inverse=True)
            unique, back = hashes[where], back.ravel()
        keys, marks = unique.tolist(), checks[where].tolist()
        if len(self.known) > KNOWN:
            self.known.clear()
        found = [self.known.get(k, -1) for k in keys]
        n = np.array([v & 0xFFFFFFFF if v >> 32 == m else -1 for v, m in zip(found, marks, strict=True)], np.int64)
        new = np.flatnonzero(n < 0)
        if len(new):
            lo, hi = starts[where[new]], ends[where[new]]
            size = hi - lo
            flat = t.data[np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)]
            points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
            heads = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
            bounds = heads[np.concatenate(([0], np.cumsum(size)))]
            n[new] = self.model.count(self.model.symbol[points], np.diff(bounds))
            self.known.update((keys[i], marks[i] << 32 | count) for i, count in zip(new.tolist(), n[new].tolist(), strict=True))
        total = np.concatenate(([0], np.cumsum(n[back])))
        rows = np.searchsorted(starts, t.offsets)
        out += total[rows[1:]] - total[rows[:-1]]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document; path: the model file, present on every executor."""

    def scan(batches):
        counter = Counter(path)
        for batch in batches:
            column = batch.column(1)
            size = pc.binary_length(column.fill_null("")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(counter.counts(column), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long")


def op9_token_counts(spark, sf_dir: str, most: int = 4096) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > most)
