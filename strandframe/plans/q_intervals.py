"""Queries over the interval operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chrom
from ..operators import filters
from ..operators import intervals as iv
from .adapters import bins, duck, segs, snps

QUERIES, ORACLES = {}, {}
B, S, V = duck("bins"), duck("segs"), duck("snps")
R = lambda c: f"round({c}, 6)"


def query(name: str, sql: str | None, *tables: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {', '.join(tables)} " if tables else "") + sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


BIN_COLS = 'chromosome, "start", "end", gene, depth, round(log2, 6) AS log2, round(weight, 6) AS weight'


def bin_cols(df):
    return df.select("chromosome", "start", "end", "gene", "depth", r6("log2").alias("log2"), r6("weight").alias("weight"))


@query("sc_bins", f"SELECT {BIN_COLS} FROM bins", B)
def sc_bins(spark, d):
    return bin_cols(bins(spark, d))


@query("pf_labels", """SELECT chromosome || ':' || ("start" + 1) || '-' || "end" AS label FROM bins""", B)
def pf_labels(spark, d):
    return bins(spark, d).select(filters.label().alias("label"))


@query("pf_autosomes", f"SELECT {BIN_COLS} FROM bins WHERE regexp_matches(chromosome, '^chr[0-9]+$')", B)
def pf_autosomes(spark, d):
    return bin_cols(filters.autosomes(bins(spark, d)))


@query("pf_par_x", f"""SELECT {BIN_COLS} FROM bins WHERE chromosome = 'chrX' AND (("start" >= 60000 AND "end" <= 2699520) OR ("start" >= 154931043 AND "end" <= 155260560))""", B)
def pf_par_x(spark, d):
    return bin_cols(bins(spark, d).filter(chrom.in_par(F.col("chromosome"), F.col("start"), F.col("end"), "GRCh37", "X")))


@query("pf_low_coverage", f"SELECT {BIN_COLS} FROM bins WHERE log2 >= -2 AND depth > 5", B)
def pf_low_coverage(spark, d):
    return bin_cols(filters.drop_low_coverage(bins(spark, d).withColumn("depth", F.when(F.col("depth") > 5, F.col("depth"))), floor=-2))


@query("pf_bad_bins", f"SELECT {BIN_COLS} FROM bins WHERE NOT (abs(log2) > 2 OR depth = 0 OR weight < 0.3 OR weight > 0.95)", B)
def pf_bad_bins(spark, d):
    return bin_cols(bins(spark, d).withColumn("gc", F.col("weight")).filter(~filters.bad_bin(most_log2=2, gc=(0.3, 0.95))))


for _mode, _test in (("outer", '"end" > 100000 AND "start" < 900000'), ("inner", '"start" >= 100000 AND "end" <= 900000'), ("trim", '"end" > 100000 AND "start" < 900000')):
    _sql = f"SELECT chromosome, {'greatest("start", 100000)' if _mode == 'trim' else '"start"'} AS \"start\", {'least("end", 900000)' if _mode == 'trim' else '"end"'} AS \"end\", gene FROM bins WHERE chromosome = 'chr3' AND {_test}"
    query(f"pf_in_range_{_mode}", _sql, B)(lambda spark, d, m=_mode: iv.in_range(bins(spark, d), "chr3", 100000, 900000, m).select("chromosome", "start", "end", "gene"))


@query("pf_het", "SELECT snp_id, alt_freq, zygosity FROM snps WHERE zygosity <> 0 AND zygosity <> 1", V)
def pf_het(spark, d):
    return filters.heterozygous(snps(spark, d)).select("snp_id", "alt_freq", "zygosity")


@query("pf_zygosity_from_freq", "SELECT snp_id, CASE WHEN alt_freq >= 0.75 THEN 1.0 WHEN alt_freq >= 0.25 THEN 0.5 ELSE 0.0 END::DOUBLE AS zygosity FROM snps", V)
def pf_zygosity_from_freq(spark, d):
    return filters.zygosity_from_freq(snps(spark, d)).select("snp_id", "zygosity")


@query("so_chrom_order", """SELECT chromosome, k1, k2, row_number() OVER (ORDER BY k1, k2) AS nth, n FROM (SELECT chromosome,
  CASE WHEN chromosome IN ('chrX', 'chrY') THEN 1000 ELSE substr(chromosome, 4)::INT END AS k1, CASE WHEN chromosome IN ('chrX', 'chrY') THEN substr(chromosome, 4) ELSE '' END AS k2, count(*) AS n FROM bins GROUP BY chromosome)""", B)
def so_chrom_order(spark, d):
    k1, k2 = chrom.sort_key(F.col("chromosome"))
    from pyspark.sql import Window

    return bins(spark, d).groupBy("chromosome").agg(F.count("*").alias("n")).withColumns({"k1": k1, "k2": k2}).withColumn("nth", F.row_number().over(Window.orderBy("k1", "k2")))


PAIRS = """b.chromosome, b."start" AS b_start, b."end" AS b_end, b.gene, s.seg_id FROM bins b JOIN segs s ON b.chromosome = s.chromosome AND """


@query("jn_segment_annotation", """SELECT s.seg_id, count(b.gene) AS n, round(avg(b.log2), 6) AS mean_log2, round(quantile_cont(b.log2, 0.5), 6) AS median_log2, round(sum(b.weight), 6) AS weight,
  coalesce(string_agg(DISTINCT b.gene, ',' ORDER BY b.gene), '') AS genes FROM segs s LEFT JOIN bins b ON b.chromosome = s.chromosome AND b."end" > s."start" AND b."start" < s."end" GROUP BY s.seg_id""", B, S)
def jn_segment_annotation(spark, d):
    """Each segment with the bins in it: the flagship."""
    ranges = segs(spark, d)
    pairs = iv.overlap_join(bins(spark, d).select("chromosome", "start", "end", "gene", "log2", "weight"), ranges.select("chromosome", "start", "end", "seg_id"))
    found = pairs.groupBy(F.col("r_seg_id").alias("seg_id")).agg(F.count("*").alias("n"), r6(F.avg("log2")).alias("mean_log2"), r6(F.percentile("log2", 0.5)).alias("median_log2"), r6(F.sum("weight")).alias("weight"), F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"))
    out = ranges.select("seg_id").join(found, "seg_id", "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "genes": F.coalesce("genes", F.lit(""))})


@query("jn_overlap_outer", f'SELECT {PAIRS} b."end" > s."start" AND b."start" < s."end"', B, S)
def jn_overlap_outer(spark, d):
    return iv.overlap_join(bins(spark, d), segs(spark, d)).select("chromosome", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "gene", F.col("r_seg_id").alias("seg_id"))


@query("jn_overlap_inner", f'SELECT {PAIRS} b."start" >= s."start" AND b."end" <= s."end"', B, S)
def jn_overlap_inner(spark, d):
    return iv.overlap_join(bins(spark, d), segs(spark, d), "inner").select("chromosome", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "gene", F.col("r_seg_id").alias("seg_id"))


@query("jn_overlap_trim", """SELECT b.chromosome, greatest(b."start", s."start") AS b_start, least(b."end", s."end") AS b_end, b.gene, s.seg_id FROM bins b JOIN segs s ON b.chromosome = s.chromosome AND b."end" > s."start" AND b."start" < s."end" """, B, S)
def jn_overlap_trim(spark, d):
    return iv.overlap_join(bins(spark, d), segs(spark, d), "trim").select("chromosome", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "gene", F.col("r_seg_id").alias("seg_id"))


INTO = """SELECT s.seg_id, {} AS v FROM segs s LEFT JOIN bins b ON b.chromosome = s.chromosome AND b."end" > s."start" AND b."start" < s."end" GROUP BY s.seg_id"""


@query("jn_into_ranges_median", INTO.format("round(CASE WHEN count(b.gene) = 0 THEN -9 ELSE quantile_cont(b.log2, 0.5) END, 6)"), B, S)
def jn_into_ranges_median(spark, d):
    return iv.into_ranges(bins(spark, d), segs(spark, d), ["seg_id"], "log2", F.percentile("log2", 0.5), -9.0, "v").select("seg_id", r6("v").alias("v"))


@query("jn_into_ranges_first", INTO.format("""CASE WHEN count(b.gene) = 0 THEN 'none' ELSE arg_min(b.gene, (b."start", b."end", b.gene)) END"""), B, S)
def jn_into_ranges_first(spark, d):
    first = F.min_by("gene", F.struct("start", "end", "gene"))
    return iv.into_ranges(bins(spark, d), segs(spark, d), ["seg_id"], "gene", first, "none", "v").select("seg_id", "v")


@query("jn_into_ranges_genes", """SELECT seg_id, coalesce(string_agg(gene, ',' ORDER BY s, e, gene), '-') AS v FROM (SELECT s.seg_id, b.gene, min((b."start", b."end", b.gene)) AS k, k[1] AS s, k[2] AS e
  FROM segs s LEFT JOIN bins b ON b.chromosome = s.chromosome AND b."end" > s."start" AND b."start" < s."end" GROUP BY s.seg_id, b.gene) GROUP BY seg_id""", B, S)
def jn_into_ranges_genes(spark, d):
    return iv.into_ranges(bins(spark, d), segs(spark, d), ["seg_id"], "gene", iv.labels(), "-", "v").select("seg_id", "v")


@query("jn_intersection", """SELECT b.chromosome, b."start", b."end", b.gene, round(b.log2, 6) AS log2 FROM bins b JOIN segs s ON b.chromosome = s.chromosome AND b."start" >= s."start" AND b."end" <= s."end" """, B, S)
def jn_intersection(spark, d):
    return iv.intersection(bins(spark, d), segs(spark, d), "inner").select("chromosome", "start", "end", "gene", r6("log2").alias("log2"))


MERGED = """reach AS (SELECT *, max("end") OVER (PARTITION BY {k} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {t}),
heads AS (SELECT *, sum(CASE WHEN r IS NULL OR "start" - r {op} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM reach)"""
merged = lambda op, t="bins", k="chromosome": MERGED.format(op=op, t=t, k=k)


@query("jn_subtract", """, holes AS (SELECT chromosome, min("start") AS hs, max("end") AS he FROM heads GROUP BY chromosome, island),
hit AS (SELECT s.*, hs, he FROM segs s LEFT JOIN holes h ON s.chromosome = h.chromosome AND he > s."start" AND hs < s."end"),
gaps AS (SELECT seg_id, chromosome, coalesce(lag(he) OVER w, "start") AS a, coalesce(hs, "end") AS b FROM hit WINDOW w AS (PARTITION BY seg_id ORDER BY hs)
  UNION ALL SELECT seg_id, any_value(chromosome), max(he), any_value("end") FROM hit GROUP BY seg_id HAVING count(hs) > 0)
SELECT seg_id, chromosome, a AS "start", b AS "end" FROM gaps WHERE a < b""".replace(", holes", "SELECT * FROM (WITH holes", 1) + ")", B, S, merged("> 0"))
def jn_subtract(spark, d):
    return iv.subtract(segs(spark, d).select("chromosome", "start", "end", "seg_id"), bins(spark, d))


@query("jn_cut", """SELECT seg_id, "start", lead_at AS "end" FROM (SELECT seg_id, p AS "start", lead(p) OVER (PARTITION BY seg_id ORDER BY p) AS lead_at FROM (
  SELECT seg_id, "start" AS p FROM segs UNION SELECT seg_id, "end" FROM segs UNION
  SELECT s.seg_id, x.p FROM segs s JOIN (SELECT DISTINCT chromosome, unnest(["start", "end"]) AS p FROM bins) x ON x.chromosome = s.chromosome AND x.p > s."start" AND x.p < s."end")) WHERE lead_at IS NOT NULL""", B, S)
def jn_cut(spark, d):
    return iv.cut(segs(spark, d).select("chromosome", "start", "end", "seg_id"), bins(spark, d)).select("seg_id", "start", "end")


@query("jn_match_reference", """, ref AS (SELECT chromosome, "start", "end", avg(log2) AS ref_log2 FROM bins GROUP BY 1, 2, 3)
SELECT b.chromosome, b."start", b."end", b.gene, round(b.log2 - r.ref_log2, 6) AS log2 FROM bins b LEFT JOIN ref r USING (chromosome, "start", "end")""".replace(", ref AS", "SELECT * FROM (WITH ref AS", 1) + ")", B)
def jn_match_reference(spark, d):
    rows = bins(spark, d)
    ref = rows.groupBy("chromosome", "start", "end").agg(F.avg("log2").alias("ref_log2"))
    return filters.match_reference(rows, ref).select("chromosome", "start", "end", "gene", r6(F.col("log2") - F.col("ref_log2")).alias("log2"))


@query("jn_semi_chrom", "SELECT chromosome, count(*) AS n FROM bins WHERE chromosome IN (SELECT chromosome FROM segs WHERE log2 > 0.5) GROUP BY chromosome", B, S)
def jn_semi_chrom(spark, d):
    return filters.shared_chroms(bins(spark, d), segs(spark, d).filter("log2 > 0.5")).groupBy("chromosome").agg(F.count("*").alias("n"))


@query("jn_anti_chrom", "SELECT chromosome, count(*) AS n FROM bins WHERE chromosome NOT IN (SELECT chromosome FROM segs WHERE seg_id % 100 < 12) GROUP BY chromosome", B, S)
def jn_anti_chrom(spark, d):
    return filters.missing_chroms(bins(spark, d), segs(spark, d).filter("seg_id % 100 < 12")).groupBy("chromosome").agg(F.count("*").alias("n"))


@query("jn_asof_bin_index", """SELECT s.seg_id, (SELECT count(*) FROM bins b WHERE b.chromosome = s.chromosome AND b."start" < s."start") AS before FROM segs s""", B, S)
def jn_asof_bin_index(spark, d):
    return filters.bins_before(segs(spark, d), bins(spark, d)).select("seg_id", "before")


def _merge(name: str, bp: int, op: str, **kw):
    k = "chromosome, strand" if kw.get("stranded") else "chromosome"
    sql = f'SELECT {k}, min("start") AS "start", max("end") AS "end", count(*) AS n, round(sum(weight), 6) AS weight FROM heads GROUP BY {k}, island'

    @query(name, sql, B, merged(op, k=k))
    def run(spark, d):
        return iv.merge(bins(spark, d), bp, combine={"n": F.count("*"), "weight": r6(F.sum("weight"))}, **kw)


_merge("iv_merge_bp0", 0, "> 0")
_merge("iv_merge_bp1", 1, ">= 0")
_merge("iv_merge_gap500", -500, "> 500")
_merge("iv_merge_stranded", 0, "> 0", stranded=True)
_merge("iv_join_regions", -4999, "> 4999")


@query("iv_flatten", """, pts AS (SELECT DISTINCT chromosome, unnest(["start", "end"]) AS p FROM bins),
pcs AS (SELECT chromosome, p AS s, lead(p) OVER (PARTITION BY chromosome ORDER BY p) AS e FROM pts)
SELECT p.chromosome, s AS "start", e AS "end", count(*) AS n, round(sum(b.weight * (e - s) / (b."end" - b."start")) + 1e-9, 6) AS weight FROM pcs p JOIN bins b ON b.chromosome = p.chromosome AND b."end" > s AND b."start" < e GROUP BY 1, 2, 3""".replace(", pts AS", "SELECT * FROM (WITH pts AS", 1) + ")", B)
def iv_flatten(spark, d):
    return iv.flatten(bins(spark, d), {"n": F.count("*")}).withColumn("weight", r6(F.col("weight") + 1e-9))


ORDER = ["start", "end", "gene", "log2", "depth", "weight"]
O = '"start", "end", gene, log2, depth, weight'
SQUASH = """runs AS (SELECT *, sum(brk) OVER (PARTITION BY chromosome ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag("end") OVER w IS NULL OR lag("end") OVER w <> "start" {by} THEN 1 ELSE 0 END AS brk FROM {t} WINDOW w AS (PARTITION BY chromosome ORDER BY {o})))"""
TILES = """tiles AS (SELECT chromosome, "start" // 1000 * 1000 AS "start", "start" // 1000 * 1000 + 1000 AS "end", CASE WHEN avg(log2) > 0 THEN 'gain' ELSE 'loss' END AS gene, count(*) AS n FROM bins GROUP BY 1, "start" // 1000)"""


def tiles(spark, d):
    at = F.floor(F.col("start") / 1000) * 1000
    return bins(spark, d).groupBy("chromosome", at.alias("t")).agg(F.when(F.avg("log2") > 0, "gain").otherwise("loss").alias("gene"), F.count("*").alias("n")).select("chromosome", F.col("t").alias("start"), (F.col("t") + 1000).alias("end"), "gene", "n")


@query("iv_squash", 'SELECT chromosome, min("start") AS "start", max("end") AS "end", sum(n)::BIGINT AS n FROM runs GROUP BY chromosome, run', B, TILES, SQUASH.format(t="tiles", by="", o='"start"'))
def iv_squash(spark, d):
    return iv.squash(tiles(spark, d), combine={"n": F.sum("n")}, order=["start"])


@query("iv_squash_by_gene", 'SELECT chromosome, gene, min("start") AS "start", max("end") AS "end", sum(n)::BIGINT AS n FROM runs GROUP BY chromosome, run, gene', B, TILES, SQUASH.format(t="tiles", by="OR lag(gene) OVER w <> gene", o='"start"'))
def iv_squash_by_gene(spark, d):
    return iv.squash(tiles(spark, d), "gene", combine={"n": F.sum("n")}, order=["start"])


@query("iv_subdivide", """, m AS (SELECT chromosome, min("start") AS s, max("end") AS e FROM heads GROUP BY chromosome, island), k AS (SELECT *, greatest(round_even((e - s) / 150, 0)::BIGINT, 1) AS n FROM m WHERE e - s >= 100),
x AS (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM k)
SELECT chromosome, s + trunc(i * (e - s) / n)::BIGINT AS "start", s + trunc((i + 1) * (e - s) / n)::BIGINT AS "end" FROM x""".replace(", m AS", "SELECT * FROM (WITH m AS", 1) + ")", B, merged("> 0"))
def iv_subdivide(spark, d):
    return iv.subdivide(bins(spark, d), 150, 100)


@query("iv_resize_grow", 'SELECT chromosome, greatest("start" - 700, 0) AS "start", CASE WHEN chromosome = \'chr1\' THEN least("end" + 700, 1000000) ELSE "end" + 700 END AS "end", gene FROM bins', B)
def iv_resize_grow(spark, d):
    return iv.resize(bins(spark, d), 700, {"chr1": 1_000_000}).select("chromosome", "start", "end", "gene")


@query("iv_resize_shrink", 'SELECT chromosome, "start" + 100 AS "start", "end" - 100 AS "end", gene FROM bins WHERE "end" - 100 > "start" + 100', B)
def iv_resize_shrink(spark, d):
    return iv.resize(bins(spark, d), -100).select("chromosome", "start", "end", "gene")


@query("iv_total_size", 'SELECT sum(e - s)::BIGINT AS size FROM (SELECT min("start") AS s, max("end") AS e FROM heads GROUP BY chromosome, island)', B, merged(">= 0"))
def iv_total_size(spark, d):
    return iv.total_range_size(bins(spark, d))


NUMBERED = f'nb AS (SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY {O}) - 1 AS i, "start" - lag("end") OVER (PARTITION BY chromosome ORDER BY {O}) AS gap, count(*) OVER (PARTITION BY chromosome) AS n FROM bins)'


@query("iv_by_arm", """, c AS (SELECT chromosome, arg_max(i, (gap, -i)) AS cut FROM nb WHERE n > 2 * greatest(50, round_even(n * 0.1, 0)) + 1 AND i BETWEEN greatest(50, round_even(n * 0.1, 0)) + 1 AND n - greatest(50, round_even(n * 0.1, 0)) - 1 AND gap >= 1000 GROUP BY chromosome)
SELECT chromosome, CASE WHEN i >= cut THEN 1 ELSE 0 END AS arm, count(*) AS n, min("start") AS "start", max("end") AS "end" FROM nb LEFT JOIN c USING (chromosome) GROUP BY 1, 2""".replace(", c AS", "SELECT * FROM (WITH c AS", 1) + ")", B, NUMBERED)
def iv_by_arm(spark, d):
    return iv.by_arm(bins(spark, d), ORDER, min_gap=1000).groupBy("chromosome", "arm").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("iv_by_gene", """, g AS (SELECT chromosome, gene, min(i) AS "first", max(i) AS "last" FROM nb WHERE gene <> 'Antitarget' GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag("last") OVER (PARTITION BY chromosome ORDER BY "first", gene) + 1, 0) AS b, row_number() OVER (PARTITION BY chromosome ORDER BY "first" DESC, gene DESC) AS back FROM g)
SELECT chromosome, gene, "first", "last" FROM g UNION ALL SELECT chromosome, 'Antitarget', b, "first" - 1 FROM l WHERE b < "first"
UNION ALL SELECT t.chromosome, 'Antitarget', coalesce(l."last" + 1, 0), t.top FROM (SELECT chromosome, max(i) AS top FROM nb GROUP BY 1) t LEFT JOIN l ON t.chromosome = l.chromosome AND l.back = 1 WHERE coalesce(l."last" + 1, 0) <= t.top""".replace(", g AS", "SELECT * FROM (WITH g AS", 1) + ")", B, NUMBERED)
def iv_by_gene(spark, d):
    return iv.by_gene(bins(spark, d), ORDER)
