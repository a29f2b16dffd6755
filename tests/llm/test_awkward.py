"""Awkward rows: repeated and missing ids, clashing columns, very long texts, many languages, small sets."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import common, decontamination, fingerprint_index, jaccard, language_id, line_dedup, mixing, quality, suffix_dedup, token_counts, url_filter
from test_operators import WORD, brute_components

A = " ".join(f"shared{i}" for i in range(60))
B = " ".join(f"other{i}" for i in range(60))
C = " ".join(f"third{i}" for i in range(30))
#: (doc_id, text): rows of one id with different texts, equal rows, rows without an id
ROWS = [(1, A), (7, A), (7, B), (7, A), (9, B + " " + C), (None, C + " " + B), (None, A), (None, A), (None, None), (3, ""), (12, A[:200] + " end"), (0, "é" * 70)]


def brute(rows, n, split, within):
    """Per row: (units, removed mask); rows equal in id and text are one document."""
    least = -(2**63)
    docs = sorted({(least if d is None else d, t or "") for d, t in rows})
    out, starts = {}, {}
    for doc in docs:
        units = split(doc[1])
        for i in range(len(units) - n + 1):
            starts.setdefault(bytes(units[i : i + n]) if isinstance(units, bytes) else tuple(units[i : i + n]), []).append((doc, i))
    for doc in docs:
        units = split(doc[1])
        gone = np.zeros(len(units), bool)
        for i in range(len(units) - n + 1):
            k = bytes(units[i : i + n]) if isinstance(units, bytes) else tuple(units[i : i + n])
            if any(d[0] < doc[0] or (within and d == doc and j < i) for d, j in starts[k]):
                gone[i : i + n] = True
        out[doc] = units, gone
    return [(d, *out[least if d is None else d, t or ""]) for d, t in rows]


def written(spark, tmp_path, rows=ROWS):
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"WHO": F.lit("x"), "spans": F.lit(1), "__row": F.lit(2), "id": F.lit(3), "flags": F.lit(4)}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_suffix_dedup_of_repeated_ids(spark, tmp_path):
    want = [(d, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()) for d, raw, gone in brute(ROWS, 50, str.encode, False)]
    got = [tuple(r) for r in suffix_dedup.op3_suffix_dedup(spark, written(spark, tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(w[2] for w in want)


def test_index_of_repeated_ids(spark, tmp_path):
    rows = [*ROWS, (20, C + " " + C), (21, "\t".join(A.split()) + "\n" + A)]
    want = []
    for d, words, gone in brute(rows, 20, WORD.findall, True):
        want.append((d, len(words), int(gone.sum()), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()))
    got = [tuple(r) for r in fingerprint_index.op6_fingerprint_index(spark, written(spark, tmp_path, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(w[2] for w in want)


def test_query_of_the_index(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    seen, want = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        words = WORD.findall(t or "")
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - 19):
            k = tuple(words[i : i + 20])
            if k in seen:
                gone[i : i + 20] = True
            seen.add(k)
        want[d] = (len(words), int(gone.sum()), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fingerprint_index.op6_fingerprint_index(spark, sf_dir).collect()} == want


def test_index_opens_again(spark, tmp_path):
    index = fingerprint_index.FingerprintIndex(spark, 16, f"{tmp_path}/index", fan_out=1)
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for d, text in ((1, A), (2, B)):
        fingerprint_index.repeated_words(batch([(d, text)]), parts=(), index=index).collect()
    again = fingerprint_index.FingerprintIndex.open(spark, f"{tmp_path}/index")
    assert len(again.runs) == 1  # compacted
    found = fingerprint_index.repeated_words(batch([(3, A), (4, C), (5, "x " + B)]), parts=(), index=again).collect()
    assert {r.id: np.frombuffer(r.spans or b"", np.uint32).tolist() for r in found} == {3: [0, 60], 4: [], 5: [1, 61]}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_small_sets_lose_no_link(spark, n, percent):
    rnd, rows = random.Random(n), []
    word = lambda: f"{rnd.getrandbits(40):x}"
    for k in range(0, 6000, 2):
        w = [word() for _ in range(rnd.randint(1, 32))]
        v = [*w, word()] if rnd.random() < 0.5 else w[: max(1, len(w) - rnd.randint(0, 2))]
        rows += [(k, " ".join(w)), (k + 1, " ".join(v))]
    want = brute_components(rows, n, percent)
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n=n, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_a_word_less(spark):
    text = "160d7ba19f ce3438cad9 178bfa80b6 523be396a7 23aab47925 56753f6409 d6eb8f1b1d ad2089de0 75439428a8 11a3dd5314 b949ebdcb8 fabef7b176"
    rows = spark.createDataFrame([(1, text), (2, text.rsplit(" ", 1)[0]), (2, "other"), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(rows.withColumn("NAME", F.lit(1))).collect())))
    assert got == sorted(map(repr, [(1, 10, 1), (2, 9, 1), (2, 1, 2), (None, 10, 1), (None, 0, None)]))


def test_hot_columns(spark):
    """One group of near copies over the limit of a column, with members that link only along chains."""
    rnd = random.Random(5)
    base, rows = [f"b{i}" for i in range(100)], []
    for k in range(150):
        w = list(base)
        for i in range(k // 10 * 2):  # ever further from the first
            w[(7 * i) % 100] = f"c{i}"
        w[rnd.randrange(100)] = f"own{k}"
        rows.append((k, " ".join(w)))
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_viterbi_of_many_languages():
    rng = np.random.default_rng(1)
    for k in (1, 2, 200, 300):
        score = rng.normal(0, 8, (40, k))
        bounds = np.array([0, 7, 7, 8, 40])
        got = language_id.viterbi(score.copy(), bounds, 12.0)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo == hi:
                continue
            best = score[lo].copy()
            for i in range(lo + 1, hi):
                best = np.maximum(best, best.max() - 12.0) + score[i]
            path = got[lo:hi]
            value = score[np.arange(lo, hi), path].sum() - 12.0 * (path[1:] != path[:-1]).sum()
            assert value == pytest.approx(best.max())


def test_two_hundred_languages(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}q{i % 26}" for w in "stuvwxyz"), f"l{i:03}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(df, language_id.train(df))
    assert sum(r.lang_pred == f"l{r.doc_id:03}" for r in found.collect()) >= 195


def test_mix_of_rows_without_ids(spark):
    rows = [(None if i % 2 else 1, f"w{i} x y z", "ab"[i % 3 == 0]) for i in range(4000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.1 * r.target


def test_line_dedup_sorts_once(spark, tmp_path):
    at = line_dedup.table(line_dedup._positions(spark.createDataFrame(ROWS, "doc_id long, text string"), "doc_id", "text", 10), "test-positions")
    plan = line_dedup.first_occurrences(at)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [h" in plan and "rangepartitioning" in plan and "hashpartitioning" not in plan


def test_lines_of_repeated_ids(spark):
    line = "a line that is long enough to be counted, and shared"
    rows = [(i, f"{line}\nown {i}\n{line}") for i in range(6)] + [(5, line.upper()), (5, "x"), (None, f" {line}\t"), (None, f"{line}\nown 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"H": F.lit(1), "gone": F.lit(2), "N_lines": F.lit(3), "keeper": F.lit(4)})
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in line_dedup.keep_bitmaps(df).collect()}
    assert got == {(d, t): (t.count("\n") + 1, 0 if d == 5 else sum(x.strip().lower() == line for x in t.split("\n"))) for d, t in rows}


@pytest.mark.parametrize("bytes_each", [8 << 20, 1 << 10])
def test_files_of_small_line_tables(spark, monkeypatch, bytes_each):
    """Many shuffle partitions don't make many files; a smaller share of bytes for each makes more of them, with the same rows."""
    made = {}
    monkeypatch.setattr(common, "PARTITION_BYTES", bytes_each, raising=False)
    monkeypatch.setattr(line_dedup, "table", lambda df, name: made.setdefault(name, common.table(df, name)))
    lines = [f"line {k} is long enough to be counted, as are all others" for k in range(300)]
    rows = [(i, "\n".join([*lines[i % 7 :: 7], f"own {i}"])) for i in range(70)]
    held = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {d: (t.count("\n") + 1, 0 if d >= 63 else t.count("\n")) for d, t in rows}
    for name in ("lines-frequent", "lines-gone"):
        assert (len(made[name].inputFiles()) == 1) == (bytes_each > 1 << 10)


def test_clashing_columns(spark, sf_dir):
    base = [(1, "some words of a text that is long enough to count as one\nand a second line of it", "a"), (None, None, None), (1, "", "b")]
    df = spark.createDataFrame(base, "doc_id long, text string, source string").withColumns({c: F.lit(9) for c in ("N_words", "kept", "lost", "name", "root", "g", "n", "size", "rate", "key", "host", "verdict", "item_id", "lang_pred", "score", "counts")})
    assert quality.judged(df).count() == 3 and mixing.mix_plan(df).count() == 3
    assert jaccard.components(df).count() == 3
    assert language_id.identify(df, None).filter("lang_pred = 'und'").count() == 3
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("doc_id", F.lit(1))
    assert decontamination.contained_items(df, items).count() == 0 and decontamination.clean(df, items).count() == 3
    pages = df.withColumns({"url": F.lit("http://a.com/"), "listed": F.lit(1), "path": F.lit(2)})
    assert url_filter.judge(pages, spark.createDataFrame([("a.com",)], "key string")).filter("verdict = 'block'").count() == 3


@pytest.fixture(scope="module")
def long_rows():
    """Texts over the 512 KB that are worked on at once."""
    rnd = random.Random(3)
    text = " ".join(f"{rnd.getrandbits(30):x}" for _ in range(90_000))
    assert len(text) > 1 << 19
    return [(1, text), (2, text + " tail"), (3, "head\n" + text[100:]), (4, "short")]


def test_very_long_texts(spark, tmp_path, long_rows):
    at = written(spark, tmp_path, long_rows)
    assert {r.doc_id: r.component_id for r in jaccard.op10_jaccard_join(spark, at).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    n = {d: len(t) for d, t in long_rows}
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.op3_suffix_dedup(spark, at).collect()}
    assert got == {1: (n[1], 0), 2: (n[2], n[1]), 3: (n[3], n[1] - 100), 4: (5, 0)}
    words = {d: t.split() for d, t in long_rows}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in fingerprint_index.op6_fingerprint_index(spark, at).collect()}
    cut = sum(w == v for w, v in zip(reversed(words[3]), reversed(words[1])))
    assert got[1] == (90_000, 0) and got[2] == (90_001, 90_000) and got[3][1] == cut and got[4] == (1, 0)
    found = decontamination.contained_items(spark.createDataFrame(long_rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words[1][50_000:50_040]))], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 3]


def test_long_parts_without_spaces():
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, rnd = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    base = "thequickbrownfoxjumpsoverthelazydogandthenreturnshomeagainwithoutanyothercompany"
    odd = ["a" * 5001, "ab" * 4000, "aab" * 3000, base * 60, "".join(rnd.choice(base) for _ in range(20_000)), "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(3000)), "short one", "".join(rnd.choice("aeioué\U0001F600t") for _ in range(4000))]
    assert token_counts.Counter(path).counts(pa.array(odd)).tolist() == [len(model.encode(t)) for t in odd]


def test_ties_of_rules_and_keepers(spark):
    pages = spark.createDataFrame([(1, "http://x.org/fr/"), (2, "http://EXAMPLE.org/es/1"), (2, "http://a.example.org/en/12"), (None, "http://b.com/de/#x")], "page_id long, url string")
    got = sorted(map(repr, ((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame([], "key string")).collect())))
    assert got == sorted(map(repr, [(1, "org/", "allow"), (2, "example.org/es/", "block"), (2, "example.org/en/1", "block"), (None, "com/de/", "block")]))
