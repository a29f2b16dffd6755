"""The order of columns in the n-gram join: slots of counts, and what they tell apart."""

import numpy as np
import pyarrow as pa

from strandframe.llm import jaccard
from strandframe.llm.common import table
from strandframe.llm.ragged import pieces

OLD = 1 << 17


def _slots(texts):
    (t,) = pieces(pa.array(texts))
    return (jaccard.shingle_sets(t)[1] >> np.uint64(40)).astype(np.int64)


def test_a_rare_shingle_is_not_taken_for_a_frequent_one(spark):
    texts = [f"a{i} b{i} c{i}" for i in range(3000)]
    slot = _slots(texts)
    assert len(slot) == len(texts)
    order = np.argsort(slot % OLD, kind="stable")
    meet = np.flatnonzero((slot[order[1:]] % OLD == slot[order[:-1]] % OLD) & (slot[order[1:]] != slot[order[:-1]]))
    often, once = order[meet[0]], order[meet[0] + 1]  # one slot of the smaller table
    docs = [(k, texts[often]) for k in range(60)] + [(60, texts[once])]
    sets = table(jaccard.sets_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3), "sets")
    ranks = jaccard.column_ranks(sets)
    assert ranks[slot[once] % jaccard.SLOTS] == 4 < ranks[slot[often] % jaccard.SLOTS] == int(4 * np.log2(61))
    assert (ranks > 0).sum() == 2


def test_no_counts_of_an_empty_table(spark):
    sets = table(jaccard.sets_of(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), 3), "sets")
    assert not jaccard.column_ranks(sets).any()


def test_counts_come_back_from_their_planes():
    counts = np.random.default_rng(1).integers(0, 2**31 - 1, jaccard.SLOTS)
    assert np.array_equal(jaccard._counted(jaccard._planes(counts)), counts)
    assert np.array_equal(jaccard._counted(jaccard._planes(counts.astype(np.int32))), counts)
