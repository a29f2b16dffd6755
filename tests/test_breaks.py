"""Breaks against brute force and the query's SQL."""

import duckdb
import numpy as np
import pytest

from strandframe.plans import q_copynumber
from strandframe.plans.adapters import bins, segs

TINY = "/root/testdata/sf0.001"


def test_breaks_are_whole(spark):
    got = q_copynumber.QUERIES["rp_breaks"](spark, TINY).toPandas()
    ends, where = segs(spark, TINY).toPandas(), bins(spark, TINY).toPandas()
    where = where[~where.gene.isin(["Antitarget", "Background", "-", ".", "CGH"])]
    want = []
    for chromosome, part in ends.sort_values("start").groupby("chromosome"):
        at, change = part.end.to_numpy()[:-1], np.diff(part.log2.to_numpy())
        for gene, b in where[where.chromosome == chromosome].groupby("gene"):
            for k in np.flatnonzero((at > b.start.min()) & (at < b.end.max())):
                want.append((chromosome, gene, int(at[k]), int((b.start < at[k]).sum()), int((b.start >= at[k]).sum()), change[k]))
    con = duckdb.connect()
    for t in ("lineitem", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    sql = q_copynumber.ORACLES["rp_breaks"]
    names = ["chromosome", "gene", "at", "probes_left", "probes_right", "change"]
    rows = lambda df: sorted(df[names].itertuples(index=False, name=None))
    assert rows(got) == rows(con.execute(sql).fetchdf())
    got = sorted(got[["chromosome", "gene", "at", "probes_left", "probes_right", "change"]].itertuples(index=False, name=None))
    assert len({a for _, _, a, *_ in got}) > 1 and [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in sorted(want)], abs=1e-6)
