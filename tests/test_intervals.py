"""Interval algebra on literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import filters, scan
from strandframe.operators import intervals as iv

ONE = [("chr1", 1, 20, "A"), ("chr1", 3, 8, "B"), ("chr1", 5, 6, "C"), ("chr1", 11, 15, "D"), ("chr1", 19, 23, "E")]


def table(spark, rows):
    return spark.createDataFrame(rows, "chromosome string, start long, end long, gene string")


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_merge_and_flatten(spark):
    df = table(spark, ONE)
    assert [(r.start, r.end, r.g) for r in iv.merge(df, combine={"g": iv.labels()}).collect()] == [(1, 23, "A,B,C,D,E")]
    assert len(spans(iv.flatten(df))) == 9


@pytest.mark.parametrize(("bp", "want"), [(1, [(100, 300), (400, 500), (500, 600), (700, 800)]), (0, [(100, 300), (400, 600), (700, 800)]), (-101, [(100, 800)])])
def test_merge_gap(spark, bp, want):
    df = table(spark, [("c", a, b, "x") for a, b in ((100, 200), (150, 300), (400, 500), (500, 600), (700, 750), (720, 800))])
    assert spans(iv.merge(df, bp)) == want


def test_flatten_splits_weight(spark):
    df = spark.createDataFrame([("c", 0, 400, 4.0, 7), ("c", 300, 600, 3.0, 5)], "chromosome string, start long, end long, weight double, probes long")
    assert [(r.start, r.end, r.weight, r.probes) for r in iv.flatten(df).orderBy("start").collect()] == [(0, 300, 3.0, 5), (300, 400, 2.0, 4), (400, 600, 2.0, 3)]


def test_cut_and_subtract(spark):
    df = table(spark, [("c", 1, 20, "A"), ("c", 1, 20, "A")])
    assert spans(iv.cut(df, table(spark, [("c", 5, 10, ""), ("c", 15, 25, "")]))) == sorted([(1, 5), (5, 10), (10, 15), (15, 20)] * 2)
    assert spans(iv.subtract(df.distinct(), table(spark, [("c", 0, 3, ""), ("c", 7, 9, ""), ("c", 9, 12, ""), ("d", 13, 14, "")]))) == [(3, 7), (12, 20)]


def test_squash_by_gene(spark):
    df = table(spark, [("c", 1, 5, "X"), ("c", 5, 10, "X"), ("c", 10, 15, "Y"), ("c", 15, 20, "Y"), ("c", 20, 25, "X")])
    assert sorted((r.start, r.end, r.gene) for r in iv.squash(df, "gene").collect()) == [(1, 10, "X"), (10, 20, "Y"), (20, 25, "X")]


def test_zero_width_at_zero(spark):
    df = table(spark, [("c", 0, 0, "z"), ("c", 0, 5, "a")])
    assert iv.in_range(df, "c", 0, 3).count() == 1 and iv.in_range(df, "c", None, 3).count() == 2


def random_rows(n, seed, wide):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = rnd.randrange(0, 400_000)
        out.append((f"chr{rnd.randrange(3)}", a, a + rnd.choice([0, 1, 30, 3000, wide]), f"g{i}"))
    return out


@pytest.mark.parametrize("mode", iv.MODES)
def test_bucketed_join_is_the_naive_one(spark, mode):
    a, b = random_rows(150, 1, 200_000), random_rows(120, 2, 90_000)
    got = sorted((r.gene, r.r_gene, r.start, r.end) for r in iv.overlap_join(table(spark, a), table(spark, b), mode, bucket=1000).collect())
    want = []
    for c, s, e, g in a:
        for rc, rs, re, rg in b:
            if c == rc and ((s >= rs and e <= re) if mode == "inner" else (e > rs and s < re)):
                want.append((g, rg, max(s, rs), min(e, re)) if mode == "trim" else (g, rg, s, e))
    assert got == sorted(want)


def test_left_join_keeps_empty_ranges(spark):
    got = iv.overlap_join(table(spark, [("c", 1, 2, "a")]), table(spark, [("c", 0, 9, "x"), ("c", 50, 60, "y")]), how="left").collect()
    assert sorted((r.gene or "", r.r_gene) for r in got) == [("", "y"), ("a", "x")]


def test_tiled_running_is_the_plain_one(spark):
    rows = random_rows(300, 3, 500)
    for kind, f in (("sum", sum), ("max", max)):
        got = {r.gene: r.v for r in scan.running(table(spark, rows), ["chromosome"], ["start", "end", "gene"], "v", F.col("end"), kind, tile=7_000).collect()}
        for c, s, e, g in rows:
            before = [x[2] for x in rows if x[0] == c and (x[1], x[2], x[3]) < (s, e, g)]
            assert got[g] == (f(before) if before else (0 if kind == "sum" else None))


def test_subdivide_keeps_length(spark):
    df = table(spark, [("c", 0, 1000, "a"), ("c", 2000, 2050, "b"), ("c", 3000, 3700, "d")])
    out = spans(iv.subdivide(df, 300, 100))
    assert sum(b - a for a, b in out) == 1700 and all(b > a for a, b in out)


def test_masks_take_null_as_bad(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.5), (None, 1.0, 0.5), (1.0, None, 0.5), (1.0, 1.0, None), (float("nan"), 1.0, 0.5)], "log2 double, depth double, gc double")
    assert filters.nan_to_null(df).filter(~filters.bad_bin()).count() == 1


def test_tiled_previous_is_the_plain_one(spark):
    rows = random_rows(300, 5, 500)
    got = {r.gene: (r.e, r.g, r.nth) for r in scan.previous(table(spark, rows), ["chromosome"], ["start", "end", "gene"], {"e": "end", "g": "gene"}, "nth", tile=7_000).collect()}
    assert len(got) == len(rows)
    for c, s, e, g in rows:
        before = [x for x in rows if x[0] == c and (x[1], x[2], x[3]) < (s, e, g)]
        last = max(before, key=lambda x: x[1:]) if before else (None,) * 4
        assert got[g] == (last[2], last[3], len(before))


def test_order_dependent_operators_over_many_tiles(spark):
    rnd, rows = random.Random(9), []
    for c in ("c", "d"):
        at = 0
        for i in range(120):
            at += rnd.choice([0, 0, 300_000, 2_500_000])
            rows.append((c, at, at + 700_000, rnd.choice(["X", "Y"])))
            at += 700_000
    runs, arms = [], {}
    for c in ("c", "d"):
        mine = [r for r in rows if r[0] == c]
        for r in mine:
            if runs and runs[-1][0] == c and runs[-1][2] == r[1] and runs[-1][3] == r[3]:
                runs[-1][2] = r[2]
            else:
                runs.append([*r])
        margin = max(10, round(len(mine) * 0.1))
        cut = max(((mine[i][1] - mine[i - 1][2], -i) for i in range(margin + 1, len(mine) - margin) if mine[i][1] - mine[i - 1][2] >= 100_000))
        arms |= {(c, r[1]): int(i >= -cut[1]) for i, r in enumerate(mine)}
    df = table(spark, rows)
    assert sorted(map(list, ((r.chromosome, r.start, r.end, r.gene) for r in iv.squash(df, "gene").collect()))) == sorted(runs)
    assert {(r.chromosome, r.start): r.arm for r in iv.by_arm(df, ["start", "end"], min_arm_bins=10).collect()} == arms
    assert {(r.chromosome, r.gene, r.first) for r in iv.by_gene(df, ["start", "end"]).collect()} >= {(c, g, min(i for i, r in enumerate([x for x in rows if x[0] == c]) if r[3] == g)) for c in "cd" for g in "XY"}


def test_rows_without_chromosome_stay(spark):
    got = iv.by_arm(table(spark, [("c", 1, 2, "a"), (None, 5, 6, "b")]), ["start", "end"]).collect()
    assert sorted((r.gene, r.arm) for r in got) == [("a", 0), ("b", 0)]
