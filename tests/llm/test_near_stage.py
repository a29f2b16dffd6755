"""The near-duplicate stage of the pipeline at five words and 0.8."""

import corpus_pipeline as cp
from test_operators import brute_components


def test_two_replaced_words_in_a_hundred(spark):
    words = [f"w{i}" for i in range(100)]
    near = [*words[:30], "x", *words[31:70], "y", *words[71:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))]
    assert brute_components(rows)[2][1] == 2 and brute_components(rows, 5, 80)[2][1] == 1
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_stage_against_brute_force(spark, docs):
    found = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    got = cp.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, (_, root) in found.items() if root == d)
