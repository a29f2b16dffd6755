"""Interval algebra on (chromosome, start, end), 0-based half-open.

Joins are equi-joins on (chromosome, bucket), but for rows of very many buckets, which are joined by chromosome. What
depends on the order of rows (islands, runs, arms, places of genes) comes from tiled scans, so no chromosome is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import previous, running

#: Bases of a join bucket, and the buckets beyond which a row is joined by chromosome instead.
BUCKET, WIDE = 50_000, 64
MODES = ("outer", "inner", "trim")


def _fits(mode: str, p: str, q: str) -> Column:
    ps, pe, qs, qe = (F.col(x) for x in (f"{p}start", f"{p}end", f"{q}start", f"{q}end"))
    return (ps >= qs) & (pe <= qe) if mode == "inner" else (pe > qs) & (ps < qe)


def overlap_join(rows: DataFrame, ranges: DataFrame, mode: str = "outer", how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Pairs of rows and ranges; the columns of ranges are prefixed r_. how="left" keeps ranges without rows.

    outer: any overlap; inner: rows within the range; trim: outer, then clipped to the range. Each pair
    meets in the one bucket where the later of the two begins.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    right = ranges.select(*[F.col(c).alias(f"r_{c}") for c in ranges.columns])
    first, last = lambda p: F.floor(F.col(f"{p}start") / bucket), lambda p: F.floor(F.greatest(f"{p}start", f"{p}end") / bucket)

    def spread(df: DataFrame, p: str) -> DataFrame:
        return df.withColumn(f"__{p}first", first(p)).filter(last(p) - first(p) < WIDE).withColumn(f"__{p}bucket", F.explode(F.sequence(f"__{p}first", last(p))))

    left, both = rows.withColumnsRenamed({}), F.col("chromosome") == F.col("r_chromosome")
    near = spread(left, "").join(spread(right, "r_"), both & (F.col("__bucket") == F.col("__r_bucket")) & _fits(mode, "", "r_"))
    near = near.filter(F.col("__bucket") == F.greatest("__first", "__r_first"))
    names = [*rows.columns, *right.columns]
    wide, r_wide = last("") - first("") >= WIDE, last("r_") - first("r_") >= WIDE
    pairs = near.select(names)
    pairs = pairs.unionByName(left.filter(wide).join(right, both & _fits(mode, "", "r_")).select(names))
    pairs = pairs.unionByName(left.filter(~wide).join(right.filter(r_wide), both & _fits(mode, "", "r_")).select(names))
    if mode == "trim":
        pairs = pairs.withColumns({"start": F.greatest("start", "r_start"), "end": F.least("end", "r_end")})
    if how == "left":
        keys = [f"r_{c}" for c in ranges.columns]
        lone = right.join(pairs.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct(), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        pairs = pairs.unionByName(lone, allowMissingColumns=True)
    return pairs


def in_range(df: DataFrame, chromosome: str, start: int | None = None, end: int | None = None, mode: str = "outer") -> DataFrame:
    """Rows of one range; a bound of None is open."""
    lo, hi = F.lit(-1 if start is None else start), F.lit(2**63 - 1 if end is None else end)
    out = df.filter(F.col("chromosome") == chromosome).withColumns({"q_start": lo, "q_end": hi}).filter(_fits(mode, "", "q_"))
    if mode == "trim":
        out = out.withColumns({"start": F.greatest("start", "q_start"), "end": F.least("end", "q_end")})
    return out.select(df.columns)


def into_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], column: str, summary: Column, default: object = None, name: str | None = None, order: list[str] | None = None) -> DataFrame:
    """ranges (unique by keys) with a summary of a column of the overlapping rows: the default for none, the value itself for one."""
    first = F.min_by(column, F.struct(*(order or ["start", "end", column])))
    found = overlap_join(rows, ranges).groupBy(*[F.col(f"r_{k}").alias(k) for k in keys]).agg(F.count("*").alias("__n"), F.when(F.count("*") == 1, first).otherwise(summary).alias("__value"))
    out = ranges.join(found, keys, "left")
    return out.withColumn(name or column, F.when(F.col("__n").isNull(), F.lit(default)).otherwise(F.col("__value"))).drop("__n", "__value")


def intersection(rows: DataFrame, ranges: DataFrame, mode: str = "outer") -> DataFrame:
    """Rows once per range they meet, with their own columns."""
    return overlap_join(rows, ranges, mode).select(rows.columns)


def islands(df: DataFrame, bp: int = 0, keys: list[str] | None = None) -> DataFrame:
    """df with ``island``, the start of the cluster each row is in. bp=0 joins touching rows, below 0 bridges gaps, above 0 asks for overlap."""
    keys = ["chromosome", *(keys or [])]
    order = ["start", "end"]
    out = running(df, keys, order, "__reach", F.col("end"), "max")
    gap = F.col("start") - F.col("__reach")
    new = F.col("__reach").isNull() | ((gap >= 0) if bp >= 1 else (gap > -bp))
    out = out.withColumn("__head", F.when(new, F.col("start")))
    return running(out, keys, order, "island", F.col("__head"), "max", inclusive=True).drop("__reach", "__head")


def labels(column: str = "gene") -> Column:
    """Distinct names in the order of their first row, joined by commas; empty and missing ones are left out."""
    pairs = F.array_sort(F.collect_set(F.struct("start", "end", F.col(column).alias("x"))))
    return F.array_join(F.array_distinct(F.filter(F.transform(pairs, lambda p: p["x"]), lambda x: x.isNotNull() & (x != "") & (x != "-"))), ",")


def merge(df: DataFrame, bp: int = 0, stranded: bool = False, combine: dict[str, Column] | None = None) -> DataFrame:
    """One row per cluster: (chromosome, start, end) and the combined columns."""
    keys = ["strand"] if stranded else []
    grouped = islands(df, bp, keys).groupBy("chromosome", *keys, "island")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), *[v.alias(k) for k, v in (combine or {}).items()]).drop("island")


def total_range_size(df: DataFrame) -> DataFrame:
    """One row: the bases that the rows cover."""
    return merge(df, bp=1).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("size"))


def squash(df: DataFrame, by: str | None = None, combine: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Consecutive rows that touch (and agree on ``by``) become one."""
    order = [*(order or ["start", "end"])]
    order += [c for c in ("end", by) if c and c not in order]
    rows = previous(df, ["chromosome"], order, {"__end": "end"} | ({"__by": by} if by else {}))
    new = F.col("__end").isNull() | (F.col("__end") != F.col("start"))
    if by:
        new = new | (F.col("__by") != F.col(by))
    runs = running(rows, ["chromosome"], order, "__run", new.cast("long"), inclusive=True)
    keep = [F.first(by).alias(by)] if by else []
    return runs.groupBy("chromosome", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *keep, *[v.alias(k) for k, v in (combine or {}).items()]).drop("__run")


def _pieces(df: DataFrame, cuts: Column) -> DataFrame:
    """Rows split at the sorted inner places of an array column."""
    edges = F.concat(F.array("start"), cuts, F.array("end"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.get(edges, i).alias("s"), F.get(edges, i + 1).alias("e")))
    return df.withColumn("__p", F.explode(pieces)).withColumns({"start": F.col("__p.s"), "end": F.col("__p.e")}).drop("__p")


def cut(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows split at the bounds of other that lie strictly within them. Equal rows are split alike."""
    points = other.select("chromosome", F.explode(F.array("start", "end")).alias("start")).distinct().withColumn("end", F.col("start") + 1)
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("__copies"))
    hits = overlap_join(points, rows.select(*df.columns)).filter(F.col("start") > F.col("r_start"))
    found = hits.groupBy(*[F.col(f"r_{c}").alias(c) for c in df.columns]).agg(F.array_sort(F.collect_set("start")).alias("__cuts"))
    out = rows.join(found, [rows[c].eqNullSafe(found[c]) for c in df.columns], "left").select(*[rows[c] for c in df.columns], "__copies", F.coalesce("__cuts", F.array().cast("array<bigint>")).alias("__cuts"))
    return _pieces(out, F.col("__cuts")).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(df.columns)


def subtract(df: DataFrame, other: DataFrame) -> DataFrame:
    """The parts of rows that other doesn't cover."""
    holes = merge(other)
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("__copies"))
    hits = overlap_join(holes, rows.select(*df.columns)).groupBy(*[F.col(f"r_{c}").alias(c) for c in df.columns]).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__holes"))
    out = rows.join(hits, [rows[c].eqNullSafe(hits[c]) for c in df.columns], "left").select(*[rows[c] for c in df.columns], "__copies", "__holes")
    h = F.col("__holes")
    gaps = F.when(h.isNull(), F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h)), lambda i: F.struct(F.when(i == 0, F.col("start")).otherwise(F.get(h, i - 1)["end"]).alias("s"), F.when(i == F.size(h), F.col("end")).otherwise(F.get(h, i)["start"]).alias("e")))
    )
    left = out.withColumn("__g", F.explode(gaps)).filter("__holes IS NULL OR __g.s < __g.e").withColumns({"start": F.col("__g.s"), "end": F.col("__g.e")})
    return left.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(df.columns)


def flatten(df: DataFrame, combine: dict[str, Column] | None = None, split_columns: tuple[str, ...] = ("weight", "probes")) -> DataFrame:
    """Disjoint pieces between all bounds of overlapping rows, with combined columns of the rows that cover each; split columns go by length."""
    points = df.select("chromosome", F.explode(F.array("start", "end")).alias("start")).distinct()
    pieces = previous(points, ["chromosome"], ["start"], {"__before": "start"}).filter("__before IS NOT NULL")
    pieces = pieces.select("chromosome", F.col("__before").alias("start"), F.col("start").alias("end"))
    pairs = overlap_join(df, pieces)
    share = (F.col("r_end") - F.col("r_start")) / (F.col("end") - F.col("start"))
    parts = {c: F.sum(F.col(c) * share) for c in split_columns if c in df.columns}
    if "probes" in parts:
        parts["probes"] = F.sum(F.bround(F.col("probes") * share))
    found = pairs.groupBy(F.col("r_chromosome").alias("chromosome"), F.col("r_start").alias("p_start"), F.col("r_end").alias("p_end"))
    found = found.agg(F.count("*").alias("__n"), *[v.alias(k) for k, v in (parts | (combine or {})).items()]).drop("__n")
    return found.withColumnsRenamed({"p_start": "start", "p_end": "end"})


def subdivide(df: DataFrame, avg_size: int, min_size: int = 0) -> DataFrame:
    """Merged rows of at least min_size, each cut to about avg_size."""
    span = F.col("end") - F.col("start")
    rows = merge(df).filter(span >= min_size)
    rows = rows.withColumns({"__span": span, "__n": F.greatest(F.bround(span / avg_size).cast("long"), F.lit(1))})
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    at = lambda i: (F.col("start") + (i * F.col("__span") / F.col("__n")).cast("long")).cast("long")
    return rows.select("chromosome", at(F.col("__i")).alias("start"), at(F.col("__i") + 1).alias("end"))


def resize(df: DataFrame, bp: int, sizes: dict[str, int] | None = None) -> DataFrame:
    """Rows grown (or shrunk) by bp at both ends, within the chromosome; rows shrunk to nothing go."""
    end = F.col("end") + bp
    for name, most in (sizes or {}).items():
        end = F.when(F.col("chromosome") == name, F.least(end, F.lit(most))).otherwise(end)
    out = df.withColumns({"start": F.greatest(F.col("start") - bp, F.lit(0).cast("long")), "end": end})
    return out.filter(F.col("end") > F.col("start")) if bp < 0 else out


def join_regions(df: DataFrame, min_gap: int) -> DataFrame:
    """Runs with gaps below min_gap joined."""
    return merge(df, bp=-(min_gap - 1))


def by_arm(df: DataFrame, order: list[str], min_gap: int = 100_000, min_arm_bins: int = 50) -> DataFrame:
    """df with arm 0 or 1: chromosomes are split at their largest gap that is far enough from both ends."""
    of = df.groupBy("chromosome").agg(F.count("*").alias("__n"))
    rows = previous(df, ["chromosome"], order, {"__end": "end"}, number="__i")
    rows = rows.withColumn("__gap", F.col("start") - F.col("__end")).drop("__end")
    margin = F.greatest(F.lit(min_arm_bins), F.bround(F.col("__n") * 0.1).cast("int"))
    ok = (F.col("__n") > 2 * margin + 1) & F.col("__i").between(margin + 1, F.col("__n") - margin - 1) & (F.col("__gap") >= min_gap)
    # of a chromosome's gaps only those that are wide enough meet its count of rows
    best = rows.filter(F.col("__gap") >= min_gap).join(of, "chromosome").filter(ok)
    best = best.groupBy("chromosome").agg(F.max(F.struct("__gap", (-F.col("__i")).alias("m"))).alias("b")).select("chromosome", (-F.col("b.m")).alias("__cut"))
    return rows.join(best, "chromosome", "left").withColumn("arm", F.when(F.col("__i") >= F.col("__cut"), 1).otherwise(0)).drop("__i", "__gap", "__cut")


def by_gene(df: DataFrame, order: list[str], ignore: tuple[str, ...] = ("-", ".", "CGH"), antitargets: tuple[str, ...] = ("Antitarget", "Background")) -> DataFrame:
    """(chromosome, gene, first, last): row spans of genes in the order of their first rows, and Antitarget for the rows between them."""
    rows = running(df, ["chromosome"], order, "i", F.lit(1))
    size = rows.groupBy("chromosome").agg(F.max("i").alias("top"))
    names = rows.withColumn("gene", F.explode(F.split("gene", ","))).filter(~F.col("gene").isin(*ignore, *antitargets))
    spans = names.groupBy("chromosome", "gene").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    g = Window.partitionBy("chromosome").orderBy("first", "gene")
    spans = spans.withColumns({"before": F.coalesce(F.lag("last").over(g) + 1, F.lit(0)), "nth": F.row_number().over(g), "of": F.count("*").over(Window.partitionBy("chromosome"))})
    gaps = spans.filter("before < first").select("chromosome", F.lit("Antitarget").alias("gene"), F.col("before").alias("first"), (F.col("first") - 1).alias("last"))
    ends = size.join(spans.filter("nth = of").select("chromosome", (F.col("last") + 1).alias("from")), "chromosome", "left").withColumn("from", F.coalesce("from", F.lit(0))).filter("from <= top")
    return spans.select("chromosome", "gene", "first", "last").unionByName(gaps).unionByName(ends.select("chromosome", F.lit("Antitarget").alias("gene"), F.col("from").alias("first"), F.col("top").alias("last")))
