"""Language ID of mixed-language text: per-word scores and a Viterbi path over the words.

A word's script (by the lead bytes of its UTF-8 letters) leaves the languages that use it in
training as candidates; hashed byte n-grams of the word score them (naive Bayes log-likelihoods, learned
from labelled documents). The Viterbi path pays SWITCH for each change of language, so it
labels spans; a document's language is the one that most letters lie in, its score that share.

Training counts n-grams over at most SAMPLE whole documents of each language, those of smallest
hash of the id: the one bounded sample here, and a parameter. Everything else covers all rows. The model is one
array of languages x 2**BITS floats, however large the corpus.

Defined cases: null text and texts without a letter are `und` with score 0; with nothing to learn from all texts
are; equal counts go to the first language by name; repeated rows get equal results;
empty table, empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ragged import ASCII_LOWER, BYTE_VALUE, Texts, mix, pieces, split_words

SAMPLE, BITS, SWITCH, SMOOTH = 400, 16, 12.0, 0.5
#: Letters: ASCII letters and every byte of a longer sequence; all else parts words.
IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: Scripts by lead byte: 0 Latin, 1 Greek, 2 Cyrillic, 3 Armenian and Hebrew, 4 Arabic, 5 Indic and South-East Asian, 6 CJK, 7 Hangul, 8 other.
_RANGES = ((0x41, 0x7B, 0), (0xC3, 0xCE, 0), (0xCE, 0xD0, 1), (0xD0, 0xD4, 2), (0xD4, 0xD8, 3), (0xD8, 0xDC, 4), (0xDC, 0xE0, 8), (0xE0, 0xE1, 5), (0xE1, 0xE2, 8), (0xE2, 0xE3, 8), (0xE3, 0xEA, 6), (0xEA, 0xEE, 7), (0xEE, 0xF8, 8))
SCRIPT = np.full(256, 9, np.uint8)
for _lo, _hi, _script in _RANGES:
    SCRIPT[_lo:_hi] = _script
N_SCRIPTS = 9


def _features(t: Texts):
    """Words of letters; then of every 1- to 4-gram within a word (with a mark at its ends) the slot and word."""
    words = split_words(t, IS_LETTER, ASCII_LOWER)
    size = words.ends - words.starts + 2
    first = np.cumsum(size) - size
    flat = np.full(int(size.sum()), 32, np.uint8)
    at = np.arange(len(flat)) - np.repeat(first, size)
    inner = (at > 0) & (at < np.repeat(size, size) - 1)
    flat[inner] = ASCII_LOWER[t.data[(np.repeat(words.starts, size) + at - 1)[inner]]]
    owner = np.repeat(np.arange(len(size)), size)
    h, slots, owners = np.zeros(len(flat), np.uint64), [], []
    for n in range(1, 5):
        h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + BYTE_VALUE[flat[n - 1 :]]
        if n > 1:
            ok = owner[: len(flat) - n + 1] == owner[n - 1 :]
            slots.append((mix(h[ok]) & np.uint64((1 << BITS) - 1)).astype(np.int32))
            owners.append(owner[: len(ok)][ok])
    return words, np.concatenate(slots), np.concatenate(owners)


def _scripts(t: Texts, words) -> np.ndarray:
    """The commonest script of each word, by lead bytes; N_SCRIPTS if it has none."""
    of = SCRIPT[t.data]
    lead = np.flatnonzero(of < N_SCRIPTS)
    owner = np.searchsorted(words.starts, lead, "right") - 1
    inside = (owner >= 0) & (lead < words.ends[np.maximum(owner, 0)]) if len(words.ends) else np.zeros(len(lead), bool)
    count = np.bincount(owner[inside] * N_SCRIPTS + of[lead[inside]], minlength=len(words.starts) * N_SCRIPTS).reshape(-1, N_SCRIPTS)
    return np.where(count.any(1), count.argmax(1), N_SCRIPTS) if len(count) else np.zeros(0, np.int64)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: language x slot; scripts: language x script, counts of words."""
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.scores = np.log((counts + SMOOTH) / (total + SMOOTH * counts.shape[1])).astype(np.float32).T.copy()
        used = scripts > 0.005 * scripts.sum(1, keepdims=True)
        used[:, ~used.any(0)] = True  # a script that none uses narrows nothing
        self.candidate = np.where(np.hstack((used, np.ones((len(langs), 1), bool))), 0.0, -50.0).astype(np.float32).T.copy()

    def label(self, t: Texts) -> tuple[object, np.ndarray]:
        """The words of a piece and the language number of each."""
        words, slots, owners = _features(t)
        n, k = len(words.starts), len(self.langs)
        score = np.stack([np.bincount(owners, weights=self.scores[slots, j], minlength=n) for j in range(k)], 1) if n else np.zeros((0, k))
        score += self.candidate[_scripts(t, words)]
        return words, viterbi(score, words.bounds(len(t.offsets) - 1))


def viterbi(score: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path over score[lo:hi] for each two neighbours of bounds, all rows in step."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    begin, size = bounds[:-1][order], size[order]
    label, back = np.zeros(len(score), np.int32), np.zeros(score.shape, bool)  # back: came from the best of the word before
    best = np.zeros(len(score), np.int32)
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(most), "left")  # rows that have a word at each step
    state = score[begin[: live[0]]].copy() if most else None
    last = np.zeros(len(size), np.int32)
    for i in range(most):
        rows = live[i]
        if i:
            at = begin[:rows] + i
            top = state[:rows].argmax(1)
            jump = state[np.arange(rows), top] - switch
            best[at] = top
            moved = jump[:, None] > state[:rows]
            back[at] = moved
            state[:rows] = np.where(moved, jump[:, None], state[:rows]) + score[at]
        done = live[i + 1] if i + 1 < most else 0
        last[done:rows] = state[done:rows].argmax(1)
    for i in range(most - 1, -1, -1):
        rows = live[i]
        at = begin[:rows] + i
        label[at] = last[:rows]
        last[:rows] = np.where(back[at, last[:rows]], best[at], last[:rows])
    return label


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the labelled rows; None if there are none. Counts are made where the rows lie and summed per language."""
    rows = labelled.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # ids are ranked first (of which Spark keeps ``sample`` a task and language), then their texts are fetched
    ids = rows.select("lang", "doc_id").withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= sample).select("lang", "doc_id").distinct()
    rows = rows.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").select("lang", "text")

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            for t in pieces(batch.column(1)):
                words, slots, owners = _features(t)
                scripts = _scripts(t, words)
                name = langs[t.first : t.first + len(t.offsets) - 1]
                for x in sorted(set(name.tolist())):
                    mine = (name == x)[words.row] if len(words.row) else np.zeros(0, bool)
                    both = np.concatenate((np.bincount(slots[mine[owners]], minlength=1 << BITS), np.bincount(scripts[mine], minlength=N_SCRIPTS + 1)))
                    found[x] = found.get(x, 0) + both
        names = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[x].astype(np.int64).tobytes() for x in names], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for r in rows.coalesce(16).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    if not total:
        return None
    langs = sorted(total)
    both = np.stack([total[x] for x in langs]).astype(np.float64)
    return Model(langs, both[:, : 1 << BITS], both[:, 1 << BITS : -1])


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of one text, in UTF-8 bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words, label = model.label(Texts(0, raw, np.array([0, len(raw)])))
    cut = np.flatnonzero(np.diff(label, prepend=-1))
    return [(int(words.starts[a]), int(words.ends[b - 1]), model.langs[label[a]]) for a, b in zip(cut, np.append(cut[1:], len(label)), strict=True)]


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = sent.value
        for batch in batches:
            pred, share = np.full(len(batch), -1), np.zeros(len(batch))
            for t in pieces(batch.column(1)) if model else ():
                words, label = model.label(t)
                rows, k = len(t.offsets) - 1, len(model.langs)
                letters = np.bincount(words.row * k + label, weights=words.ends - words.starts, minlength=rows * k).reshape(rows, k)
                plain = np.concatenate(([0], np.cumsum((t.data < 128) & IS_LETTER[t.data])))
                lettered = plain[t.offsets[1:]] > plain[t.offsets[:-1]]
                for i in np.flatnonzero(~lettered & letters.any(1)):  # only longer sequences: are they letters?
                    lettered[i] = any(c.isalpha() for c in t.text(i).decode())
                top = letters.argmax(1)
                total = letters.sum(1)
                pred[t.first : t.first + rows] = np.where(lettered, top, -1)
                share[t.first : t.first + rows] = np.where(lettered, letters[np.arange(rows), top] / np.maximum(total, 1), 0)
            names = [model.langs[p] if p >= 0 else "und" for p in pred.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(F.coalesce(~held_out(F.col("doc_id")), F.lit(False))))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
