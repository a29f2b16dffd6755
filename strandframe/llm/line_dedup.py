"""Line dedup across documents, in DataFrame functions only.

Lines that are long enough are hashed (128 bits) and written once with their document and position. They are
range-partitioned by (hash, document), so that a hot line spreads over many tasks, with document and position
as secondary sort; a window streams over that order and passes each document's first occurrence of a line. Only
partial counts per line are shuffled after that. Lines above the limit form a small table; the written
positions are met with it. The result has no text: for each document the kept lines as a run-length
bitmap.

Defined cases: null or empty text is one empty line; a document is a doc_id, so rows that
repeat a doc_id count once, and each of them keeps its line if it is the largest; null
doc_id counts as the smallest id; equal rows get equal results; empty table, empty result;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, few, small, table, with_columns

MIN_CHARS, MIN_DOCS = 40, 5
_NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _positions(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(id, row, h, h2, pos): the lines whose key is long enough. row: a hash of the text, to tell rows of one id apart."""
    base = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("row"), F.posexplode(lines_of(F.col(f"`{text}`"))).alias("pos", "line"))
    key = line_key(F.col("line"))
    return base.filter(F.length("line") >= min_chars).filter(F.length(key) >= min_chars).select("id", "row", key.alias("key"), "pos").select("id", "row", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "pos")


def first_occurrences(at: DataFrame) -> DataFrame:
    """(h, h2, id): of the lines in ``at`` the first in each document, streamed in the order of line, document and position."""
    order = Window.partitionBy("h", "h2", "id").orderBy("pos")
    at = at.repartitionByRange("h", "h2", "id")  # the window needs no other exchange
    return at.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("h", "h2", "id")


def frequent_lines(at: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h, h2, keeper): lines found in at least min_docs documents, and the largest id that holds each."""
    found = first_occurrences(at).groupBy("h", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    return found.filter(F.col("n") >= min_docs).select("h", "h2", "keeper")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with n_lines, n_dropped and keep_runs: array of (start, n), the kept lines; null where all are kept."""
    at = table(_positions(docs, doc_id, text, min_chars), "line-positions")
    frequent = small(table(few(frequent_lines(at, min_docs), at), "lines-frequent"))
    hit = at.join(frequent, ["h", "h2"]).filter(F.col("id") != F.col("keeper"))
    gone = table(few(hit.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone")), at), "lines-gone")
    gone = small(gone).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    mine = [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NO_ID)) == F.col("__id"), F.xxhash64(F.col(f"`{text}`")) == F.col("__row")]
    joined = docs.join(gone, mine, "left").withColumn("__n", F.size(lines_of(F.col(f"`{text}`"))))
    d, n = F.col("__gone"), F.col("__n")

    def run(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(d, i - 1) + 1)
        end = F.when(i == F.size(d), n).otherwise(F.get(d, i))
        return F.struct(start.alias("start"), (end - start).alias("n"))

    runs = F.when(d.isNotNull(), F.filter(F.transform(F.sequence(F.lit(0), F.size(d)), run), lambda r: r["n"] > 0))
    out = with_columns(joined, {"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size(d), F.lit(0)).cast("long"), "keep_runs": runs})
    return out.drop("__id", "__row", "__gone", "__n")


def kept_text(text: Column, runs: Column) -> Column:
    """The text that a keep bitmap leaves."""
    lines = lines_of(text)
    left = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["n"]))), "\n")
    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(left)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = keep_bitmaps(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep_runs")), 256).alias("kept_sha256"))


KEYED_SQL = r"""
keyed AS (SELECT doc_id, line, pos, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {docs})),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key AND length(k.key) >= 40)
"""
SQL = "WITH " + KEYED_SQL.format(docs="documents") + """
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
