"""Antitargets of whole tables against marked bases."""

import numpy as np

from strandframe.plans import q_kernels
from strandframe.plans.adapters import bins, segs

TINY = "/root/testdata/sf0.001"


def test_antitargets_of_all_chromosomes(spark):
    got = q_kernels.QUERIES["wf_antitargets"](spark, TINY).toPandas()
    free, taken = segs(spark, TINY).toPandas(), bins(spark, TINY).toPandas()
    want = []
    for chromosome, rows in free.groupby("chromosome"):
        hit = np.zeros(int(rows.end.max()) + 2, np.int8)
        for s, e in zip(rows.start, rows.end, strict=True):
            hit[max(s + 500, 0) : e - 500] = 1
        for s, e in zip(*(taken[taken.chromosome == chromosome][c] for c in ("start", "end")), strict=True):
            hit[max(s - 500, 0) : e + 500] = 0
        edge = np.flatnonzero(np.diff(hit, prepend=0))
        for s, e in edge.reshape(-1, 2).tolist():
            if e - s >= 500:
                n = max(round((e - s) / 10_000), 1)
                want += [(chromosome, s + int(i * (e - s) / n), s + int((i + 1) * (e - s) / n)) for i in range(n)]
    assert len({w[0] for w in want}) == 24
    assert sorted(got[["chromosome", "start", "end"]].itertuples(index=False, name=None)) == sorted(want)
