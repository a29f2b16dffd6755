"""The pipeline against a brute-force version of its stages, on the smallest tables and on awkward rows."""

import corpus_pipeline as cp
import duckdb
import pytest
from strandframe.llm import decontamination, line_dedup, mixing, quality

from test_operators import brute_components

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{DIR}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DIR}/benchmark.parquet'")
    con.execute(f"DELETE FROM documents WHERE doc_id IN (SELECT doc_id FROM ({quality.SQL}) WHERE NOT kept)")
    lines = line_dedup.KEYED_SQL.format(docs="documents")
    con.execute(f"CREATE TABLE next AS WITH {lines}, cut AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS left_text FROM marked GROUP BY doc_id) SELECT d.doc_id, c.left_text AS text, lang, source FROM documents d JOIN cut c USING (doc_id) WHERE dropped = 0 OR dropped < n AND length(trim(left_text)) > 0")
    con.execute("DROP TABLE documents; ALTER TABLE next RENAME TO documents")
    found = brute_components(con.execute("SELECT doc_id, text FROM documents").fetchall(), n=5, percent=80)
    gone = [d for d, (_, root) in found.items() if root != d]
    if gone:
        con.execute(f"DELETE FROM documents WHERE doc_id IN ({','.join(map(str, gone))})")
    con.execute(f"DELETE FROM documents WHERE doc_id IN (SELECT doc_id FROM ({decontamination.SQL}))")
    sized = mixing.SQL[: mixing.SQL.index(mixing.TARGETS_SQL)]
    want = con.execute(sized + mixing.TARGETS_SQL + "SELECT doc_id, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT FROM taken").fetchall()
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    got = [(r.doc_id, r.copy_no, r.text) for r in cp.run(spark, DIR).collect()]
    assert sorted(got) == sorted((d, k, text[d]) for d, copies in want for k in range(1, copies + 1))


def test_copies_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (None, text), (5, text), (5, other), (None, other + " x"), (None, None), (7, ""), (None, "")]
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, [(1, text), (5, other), (None, None), (7, ""), (None, "")]))


def test_leaks_without_ids(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first().text
    rows = [(None, f"a {item} b", 1), (3, item, 2), (3, "clean words only here", 3), (None, "more clean words", 4)]
    got = cp.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string, item_id long"), sf_dir).collect()
    assert sorted(r.item_id for r in got) == [3, 4]


@pytest.mark.parametrize("table", ["documents", "benchmark"])
def test_empty_tables(spark, tmp_path, table):
    for t in ("documents", "benchmark"):
        df = spark.read.parquet(f"{DIR}/{t}.parquet")
        (df.limit(0) if t == table else df).write.parquet(f"{tmp_path}/{t}.parquet")
    assert (cp.run(spark, str(tmp_path)).count() == 0) == (table == "documents")
