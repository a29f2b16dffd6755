"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text. Then normalised lines are hashed and the distinct documents
that hold each are counted per host (here: source). Lines above the limit are boilerplate: every
document but the first loses them, and a document that is left with too little is
rejected. Distinct documents are distinct texts, so that copies of one document do not make its own
lines boilerplate (copies are for the dedup operators). Counting pre-aggregates before both of its
shuffles, so a hot line or host is a few rows by then.

Defined cases: null text has no words and no lines; null host is a host of its own; a line is kept in
the smallest doc_id (null: the smallest) of those that hold it; rows of equal id and text get
equal results; empty table, empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, ascii_lower, small, table, with_columns, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line is boilerplate in more distinct documents of its host than both of these.
LIMIT_DOCS, LIMIT_SHARE = 50, 0.01
#: A document that lost lines is rejected with fewer words left, or a smaller share of its words.
LEFT_WORDS, LEFT_SHARE = 20, 0.3
_NO_ID = -(2**63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column, n: int = WINDOW) -> Column:
    """Words in n-word windows that occur at least twice in the array w (n: a power of two)."""

    def pairs(step: int) -> Callable[[Column], Column]:
        """Hashes of h[i], h[i + step] for all i."""
        return lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(step + 1), F.size(h) - step), lambda x, y: F.xxhash64(x, y))

    def windows(h: Column) -> Column:
        step = 1
        while step < n:
            h = let(h, pairs(step))
            step *= 2
        return h

    def covered(g: Column) -> Column:
        ranked = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twin = lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False)))
        starts = F.array_sort(F.transform(let(ranked, twin), lambda e: e["i"]))
        add = lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")), add, lambda a: a["n"])

    found = let(windows(F.transform(w, lambda x: F.xxhash64(x))), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))
    return F.when(F.size(w) > n, found).otherwise(0).cast("long")


def base_metrics(text: Column, w: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": repeat_words(w),
    }


def _lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """(id, row, host, line, n, pos): hashes of the normalised lines of each text that have words, with their number of words and place in it."""
    t = F.col(f"`{text}`")
    base = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(t).alias("row"), F.xxhash64(F.col(f"`{host}`")).alias("host"), F.posexplode(F.split(t, "\n")).alias("pos", "line"))
    base = base.withColumn("n", F.size(words(F.col("line")))).filter("n > 0")
    norm = F.regexp_replace(F.regexp_replace(ascii_lower(F.btrim("line", F.lit(SPACES))), "[0-9]", "0"), SPACE, " ")
    return base.select("id", "row", "host", F.xxhash64(norm).alias("line"), "n", "pos")


def boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """(host, line, keeper): hashes of the lines above the limits of their host, and the id that keeps each."""
    found = _lines(docs, doc_id, text, host).groupBy("host", "line").agg(F.count_distinct("row").alias("n_docs"), F.min("id").alias("keeper"))
    hosts = docs.groupBy(F.xxhash64(F.col(f"`{host}`")).alias("host")).agg(F.count("*").alias("of"))
    found = found.filter(F.col("n_docs") > limit_docs).join(hosts, "host")
    return found.filter(F.col("n_docs") > F.col("of") * limit_share).select("host", "line", "keeper")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE, places: bool = False) -> DataFrame:
    """docs with the base metrics, base_failed, n_lost (words in removed lines) and kept; with places also lost_lines, the removed lines' places (null: none)."""
    limits = small(table(boilerplate(docs, doc_id, text, host, limit_docs, limit_share), "quality-lines"))
    hit = _lines(docs, doc_id, text, host).join(limits, ["host", "line"]).filter(F.col("id") != F.col("keeper"))
    lost = small(table(hit.groupBy("id", "row", "host").agg(F.sum("n").alias("lost"), *([F.collect_set("pos").alias("at")] if places else [])), "quality-lost"))
    lost = lost.select(*[F.col(c).alias(f"__{c}") for c in lost.columns])
    mine = [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NO_ID)) == F.col("__id"), F.xxhash64(F.col(f"`{text}`")) == F.col("__row"), F.xxhash64(F.col(f"`{host}`")) == F.col("__host")]
    metrics = base_metrics(F.col(f"`{text}`"), F.col("__words"))
    out = with_columns(docs.withColumn("__words", words(F.col(f"`{text}`"))), metrics).drop("__words").join(lost, mine, "left")
    n, gone = F.col("n_words"), F.coalesce(F.col("__lost"), F.lit(0)).cast("long")
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    depleted = (gone > 0) & ((n - gone < left_words) | (n - gone < n * left_share))
    return with_columns(out, {"base_failed": failed, "n_lost": gone, "kept": ~failed & ~depleted} | ({"lost_lines": F.col("__at")} if places else {})).drop(*lost.columns)


def cleaned_text(text: Column, lost_lines: Column) -> Column:
    """The text without the lines at the places that judged() found."""
    left = lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), lost_lines), lambda i: F.get(a, i)), "\n")
    return F.when(lost_lines.isNull(), text).otherwise(let(F.split(text, "\n"), left))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "kept")


JUDGED_SQL = r"""
texts AS (SELECT doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS row FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
wins AS (SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM worded)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(8, i - last))::BIGINT AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS last FROM twice) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, source, row, unnest(string_split(text, chr(10))) AS line FROM texts),
dup_lines AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm_lines AS (SELECT doc_id, source, row, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(regexp_replace(translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS line
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
freq AS (SELECT source, line, min(doc_id) AS keeper FROM norm_lines GROUP BY source, line
  HAVING count(DISTINCT row) > 50 AND count(DISTINCT row) > 0.01 * (SELECT count(*) FROM texts t WHERE t.source IS NOT DISTINCT FROM norm_lines.source)),
lost AS (SELECT l.doc_id, sum(l.n)::BIGINT AS n FROM norm_lines l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line AND l.doc_id <> f.keeper GROUP BY l.doc_id),
measured AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lost
  FROM worded d LEFT JOIN dup_lines u USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
"""
SQL = "WITH " + JUDGED_SQL + """
SELECT *, NOT base_failed AND NOT (n_lost > 0 AND (n_words - n_lost < 20 OR n_words - n_lost < 0.3 * n_words)) AS kept FROM judged
"""
