"""Queries over estimators, signals, calls and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chrom, stats
from ..operators import calling, reports, signal, variants
from ..operators import intervals as iv
from .adapters import bins, duck, segs, segs_to_the_bit, snps

QUERIES, ORACLES = {}, {}
B, S, V = duck("bins"), duck("segs"), duck("snps")
ORDER = ["start", "end", "gene", "log2", "depth", "weight"]
O = '"start", "end", gene, log2, depth, weight'


def query(name: str, sql: str | None, *tables: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {', '.join(tables)} " if tables else "") + sql
        return f

    return keep


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


Q = "quantile_cont"
# aggregates
query("ag_median_chrom", f"SELECT chromosome, count(*) AS n, round({Q}(log2, 0.5), 6) AS m, round(avg(depth), 6) AS depth FROM bins GROUP BY 1", B)(
    lambda s, d: rounded(bins(s, d).groupBy("chromosome").agg(F.count("*").alias("n"), F.percentile("log2", 0.5).alias("m"), F.avg("depth").alias("depth")), "m", "depth"))
query("ag_iqr", f"SELECT chromosome, round({Q}(log2, 0.75) - {Q}(log2, 0.25), 6) AS iqr FROM bins GROUP BY 1", B)(
    lambda s, d: rounded(bins(s, d).groupBy("chromosome").agg(stats.iqr("log2").alias("iqr")), "iqr"))
query("ag_mad", f"SELECT chromosome, round(1.4826 * {Q}(abs(log2 - m), 0.5), 6) AS mad FROM bins JOIN (SELECT chromosome, {Q}(log2, 0.5) AS m FROM bins GROUP BY 1) USING (chromosome) GROUP BY 1", B)(
    lambda s, d: rounded(stats.mad(bins(s, d), ["chromosome"], "log2"), "mad"))
WMED = """wm_{n} AS (SELECT chromosome, arg_min(CASE WHEN abs(cum - half) <= 1e-12 AND nxt IS NOT NULL AND one <= half THEN (x + nxt) / 2 ELSE x END, x) AS m FROM (
  SELECT chromosome, x, one, sum(w) OVER o AS cum, sum(w) OVER (PARTITION BY chromosome) / 2 AS half, lead(x) OVER o AS nxt FROM (SELECT chromosome, {x} AS x, sum(weight) AS w, max(weight) AS one FROM {t} GROUP BY 1, 2)
  WINDOW o AS (PARTITION BY chromosome ORDER BY x)) WHERE cum >= half - 1e-12 GROUP BY chromosome)"""
query("ag_weighted_median", "SELECT chromosome, round(m, 6) AS median FROM wm_a", B, WMED.format(n="a", x="log2", t="bins"))(
    lambda s, d: rounded(stats.weighted_median(bins(s, d), ["chromosome"], "log2", "weight"), "median"))
query("ag_weighted_mad", "SELECT chromosome, round(m * 1.4826, 6) AS mad FROM wm_b", B, WMED.format(n="a", x="log2", t="bins"), WMED.format(n="b", x="abs(log2 - m)", t="(bins JOIN wm_a USING (chromosome))"))(
    lambda s, d: rounded(stats.weighted_mad(bins(s, d), ["chromosome"], "log2", "weight"), "mad"))
query("ag_weighted_std", "SELECT chromosome, round(sqrt(sum(weight * (log2 - m) ** 2) / sum(weight)), 6) AS std FROM bins JOIN (SELECT chromosome, sum(log2 * weight) / sum(weight) AS m FROM bins GROUP BY 1) USING (chromosome) GROUP BY 1", B)(
    lambda s, d: rounded(stats.weighted_std(bins(s, d), ["chromosome"], "log2", "weight"), "std"))
query("ag_gapper", "SELECT chromosome, round(sum(gap * i * (n - i)) * sqrt(pi()) / (any_value(n)::DOUBLE * (any_value(n) - 1)), 6) AS gapper FROM (SELECT chromosome, lead(log2) OVER o - log2 AS gap, row_number() OVER o AS i, count(*) OVER (PARTITION BY chromosome) AS n FROM bins WINDOW o AS (PARTITION BY chromosome ORDER BY log2)) GROUP BY 1", B)(
    lambda s, d: rounded(stats.gapper(bins(s, d), ["chromosome"], "log2"), "gapper"))
query("ag_qn", f"SELECT chromosome, round({Q}(abs(a - b), 0.25) / CASE WHEN any_value(n) <= 10 THEN 1.392 WHEN any_value(n) < 400 THEN 1 + 4 / any_value(n) ELSE 1 END, 6) AS q_n FROM (SELECT x.chromosome, x.log2 AS a, y.log2 AS b, n FROM (SELECT *, count(*) OVER (PARTITION BY chromosome) AS n FROM segs) x JOIN segs y ON x.chromosome = y.chromosome AND x.seg_id < y.seg_id) GROUP BY 1", S)(
    lambda s, d: rounded(stats.q_n(segs(s, d), ["chromosome"], "log2"), "q_n"))
query("ag_mse", "SELECT chromosome, round(avg(log2 * log2) - avg(log2) ** 2, 6) AS mse FROM bins GROUP BY 1", B)(
    lambda s, d: rounded(stats.mse(bins(s, d), ["chromosome"], "log2"), "mse"))
query("ag_sem", "SELECT chromosome, round(stddev_samp(log2) / sqrt(count(log2)), 6) AS sem FROM bins GROUP BY 1", B)(
    lambda s, d: rounded(bins(s, d).groupBy("chromosome").agg(stats.sem("log2").alias("sem")), "sem"))
query("ag_segment_mean", "SELECT chromosome, gene, round(sum(log2 * weight) / sum(weight), 6) AS mean FROM bins GROUP BY 1, 2", B)(
    lambda s, d: rounded(bins(s, d).groupBy("chromosome", "gene").agg(stats.weighted_mean("log2", "weight").alias("mean")), "mean"))
query("ag_sex_medians", f"SELECT sample_id, round({Q}(log2, 0.5) FILTER (chromosome = 'chrX'), 6) AS x, round({Q}(log2, 0.5) FILTER (chromosome = 'chrY'), 6) AS y, round({Q}(log2, 0.5) FILTER (chromosome NOT IN ('chrX', 'chrY')), 6) AS a FROM bins GROUP BY 1", B)(
    lambda s, d: rounded(reports.sex_medians(bins(s, d), ["sample_id"]), "x", "y", "a"))
HITS = """hits AS (SELECT s.seg_id, v.* FROM segs s JOIN snps v ON s.chromosome = v.chromosome AND v."end" > s."start" AND v."start" < s."end")"""
query("ag_baf", f"""SELECT s.seg_id, round(m, 6) AS baf FROM segs s LEFT JOIN (SELECT seg_id, {Q}(CASE WHEN n = 1 THEN alt_freq WHEN above THEN abs(alt_freq - 0.5) + 0.5 ELSE 0.5 - abs(alt_freq - 0.5) END, 0.5) AS m
  FROM hits JOIN (SELECT seg_id, {Q}(alt_freq, 0.5) > 0.5 AS above, count(*) AS n FROM hits GROUP BY 1) USING (seg_id) GROUP BY 1) USING (seg_id)""", S, V, HITS)(
    lambda s, d: rounded(variants.baf_by_ranges(snps(s, d), segs(s, d), "seg_id").select("seg_id", "baf"), "baf"))
query("ag_baf_counts", "SELECT seg_id, coalesce(sum(least(alt_count, depth - alt_count)), 0)::BIGINT AS minor, coalesce(sum(depth), 0)::BIGINT AS total FROM segs LEFT JOIN hits USING (seg_id) GROUP BY 1", S, V, HITS)(
    lambda s, d: variants.baf_counts(snps(s, d), segs(s, d), "seg_id").select("seg_id", "minor", "total"))
query("ag_het_frac", "SELECT seg_id, round(avg((zygosity <> 0 AND zygosity <> 1)::INT), 6) AS het FROM segs LEFT JOIN hits USING (seg_id) GROUP BY 1", S, V, HITS)(
    lambda s, d: rounded(variants.het_frac(snps(s, d), segs(s, d), "seg_id").select("seg_id", "het"), "het"))
query("ag_depth_weighted", "SELECT round(m, 6) AS depth FROM wm_a", B, """by_chrom AS (SELECT 1 AS chromosome, avg(depth) AS log2, max("end")::DOUBLE AS weight FROM bins GROUP BY bins.chromosome)""", WMED.format(n="a", x="log2", t="by_chrom"))(
    lambda s, d: rounded(stats.size_weighted_median_depth(bins(s, d)), "depth"))
query("ag_size_by_chrom", 'SELECT chromosome, min("start") AS "start", max("end") AS "end", sum("end" - "start")::BIGINT AS size FROM bins GROUP BY 1', B)(
    lambda s, d: bins(s, d).groupBy("chromosome").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("size")))
query("ag_correlation", "SELECT sample_id, round(corr(log2, depth), 6) AS r FROM bins GROUP BY 1", B)(
    lambda s, d: rounded(bins(s, d).groupBy("sample_id").agg(F.corr("log2", "depth").alias("r")), "r"))
# windows
MIRROR = """numbered AS (SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY {o}) - 1 AS i, count(*) OVER (PARTITION BY chromosome) AS n FROM {t}),
padded AS (SELECT chromosome, "start", log2, i, true AS seen FROM numbered UNION ALL SELECT chromosome, "start", log2, -1 - i, false FROM numbered WHERE i < {w} UNION ALL SELECT chromosome, "start", log2, 2 * n - 1 - i, false FROM numbered WHERE i >= n - {w})"""
for _n, _f, _g in (("median", f"{Q}(log2, 0.5)", lambda c: F.percentile(c, 0.5)), ("quantile", f"{Q}(log2, 0.95)", lambda c: F.percentile(c, 0.95)), ("std", "stddev_samp(log2)", F.stddev_samp)):
    query(f"wn_rolling_{_n}", f'SELECT chromosome, "start", round(v, 6) AS v FROM (SELECT *, {_f} OVER (PARTITION BY chromosome ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v FROM padded) WHERE seen', S, MIRROR.format(o='"start"', t="segs", w=5))(
        lambda s, d, g=_g: rounded(signal.rolling(segs(s, d), ["chromosome"], ["start"], "log2", 5, g, "v").select("chromosome", "start", "v"), "v"))
query("wn_residuals_chrom", f'SELECT chromosome, "start", "end", gene, round(log2 - m, 6) AS residual FROM bins JOIN (SELECT chromosome, {Q}(log2, 0.5) AS m FROM bins GROUP BY 1) USING (chromosome)', B)(
    lambda s, d: rounded(signal.residuals_by_chrom(bins(s, d), ["chromosome"]).select("chromosome", "start", "end", "gene", "residual"), "residual"))
query("wn_residuals_segment", 'SELECT s.seg_id, b."start", b."end", b.gene, round(b.log2 - s.log2, 6) AS residual FROM bins b JOIN segs s ON b.chromosome = s.chromosome AND b."start" >= s."start" AND b."end" <= s."end"', B, S)(
    lambda s, d: rounded(signal.residuals_by_segment(bins(s, d), segs(s, d), "seg_id").select("seg_id", "start", "end", "gene", "residual"), "residual"))
query("wn_center_all", f"SELECT chromosome, sample_id, \"start\", gene, round(log2 - c, 6) AS log2 FROM bins JOIN (SELECT sample_id, {Q}(m, 0.5) AS c FROM (SELECT sample_id, chromosome, {Q}(log2, 0.5) AS m FROM bins WHERE chromosome NOT IN ('chrX', 'chrY') GROUP BY 1, 2) GROUP BY 1) USING (sample_id)", B)(
    lambda s, d: rounded(signal.center_all(bins(s, d), ["sample_id"]).select("chromosome", "sample_id", "start", "gene", "log2"), "log2"))
_gain = "CASE WHEN {g} < 250 THEN (250 - greatest({g}, 0)) ** 2 / (1000.0::DOUBLE * t) - CASE WHEN t + {g} < 250 THEN (250 - t - greatest({g}, 0)) ** 2 / (1000.0::DOUBLE * t) ELSE 0 END ELSE 0 END"
query("wn_edge_bias", f"""SELECT chromosome, "start", "end", gene, round(coalesce({_gain.format(g='lg')}, 0) + coalesce({_gain.format(g='rg')}, 0) - (250 / (2.0::DOUBLE * t) - CASE WHEN t < 250 THEN (250 - t) ** 2 / (500.0::DOUBLE * t) ELSE 0 END) + 1e-9, 5) AS edge
  FROM (SELECT *, ("end" - "start")::DOUBLE AS t, "start" - lag("end") OVER o AS lg, lead("start") OVER o - "end" AS rg FROM bins WINDOW o AS (PARTITION BY chromosome ORDER BY {O}))""", B)(
    lambda s, d: rounded(signal.edge_bias(bins(s, d), ORDER).select("chromosome", "start", "end", "gene", (F.col("edge") + 1e-9).alias("edge")), "edge", digits=5))
query("wn_bh_adjust", "SELECT seg_id, round(least(min(p * n / r) OVER (PARTITION BY chromosome ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY p, seg_id) AS r, count(*) OVER (PARTITION BY chromosome) AS n FROM (SELECT *, exp(-abs(log2) * 3) AS p FROM segs))", S)(
    lambda s, d: rounded(signal.p_adjust_bh(segs(s, d).withColumn("p", F.exp(-F.abs("log2") * 3)), ["chromosome"], tie=["seg_id"]).select("seg_id", "q"), "q"))
query("wn_bin_ordinals", f'SELECT chromosome, "start", "end", gene, row_number() OVER (PARTITION BY chromosome ORDER BY {O}) - 1 AS nth FROM bins', B)(
    lambda s, d: signal.ordinals(bins(s, d), ["chromosome"], ORDER).select("chromosome", "start", "end", "gene", "nth"))
query("wn_dedupe_transcripts", 'SELECT gene, "start", "end" FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY depth DESC, "end" - "start" DESC, chromosome, "start") AS r FROM bins) WHERE r = 1', B)(
    lambda s, d: signal.best_per_key(bins(s, d), ["gene"], [F.desc("depth"), F.desc(F.col("end") - F.col("start")), "chromosome", "start"]).select("gene", "start", "end"))
# set operations
query("st_union_samples", "SELECT sample_id, count(*) AS n, round(sum(log2), 4) AS log2 FROM (SELECT sample_id, log2 FROM bins UNION ALL SELECT 'S', log2 FROM segs) GROUP BY 1", B, S)(
    lambda s, d: rounded(bins(s, d).select("sample_id", "log2").unionByName(segs(s, d).withColumn("sample_id", F.lit("S")), allowMissingColumns=True).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("log2").alias("log2")), "log2", digits=4))
query("st_gistic_markers", 'SELECT DISTINCT chromosome, unnest(["start", "end"]) AS pos FROM bins', B)(lambda s, d: reports.gistic_markers(bins(s, d)))
query("st_chrom_intersect", "SELECT chromosome FROM bins WHERE log2 > 1.8 INTERSECT SELECT chromosome FROM segs WHERE log2 > 0.9", B, S)(
    lambda s, d: bins(s, d).filter("log2 > 1.8").select("chromosome").intersect(segs(s, d).filter("log2 > 0.9").select("chromosome")))
query("st_chrom_except", "SELECT chromosome FROM bins EXCEPT SELECT chromosome FROM segs WHERE seg_id % 100 < 9", B, S)(
    lambda s, d: bins(s, d).select("chromosome").distinct().join(segs(s, d).filter("seg_id % 100 < 9").select("chromosome").distinct(), "chromosome", "left_anti"))
# calls
REF = "CASE WHEN chromosome IN ('chrX', 'chrY') THEN 1 ELSE 2 END"
EXP = "CASE WHEN chromosome = 'chrY' THEN 0 ELSE 2 END"


def ref():
    return calling.reference_copies(2, haploid_x=True)


query("cl_threshold", f"SELECT seg_id, (CASE WHEN log2 <= -1.1 THEN 0 WHEN log2 <= -0.25 THEN trunc(1 * r / 2) WHEN log2 <= 0.2 THEN r WHEN log2 <= 0.7 THEN trunc(3 * r / 2) ELSE ceil(r * 2 ** log2) END)::BIGINT AS cn FROM (SELECT *, {REF} AS r FROM segs)", S)(
    lambda s, d: segs(s, d).select("seg_id", calling.threshold(F.col("log2"), ref()).cast("long").alias("cn")))
query("cl_clonal", f"SELECT seg_id, round(greatest((r * 2 ** log2 - e * 0.4) / 0.6, 0), 6) AS cn FROM (SELECT *, {REF} AS r, {EXP} AS e FROM segs)", S)(
    lambda s, d: rounded(segs(s, d).select("seg_id", calling.clonal(F.col("log2"), ref(), calling.expected_copies(), 0.6).alias("cn")), "cn"))
query("cl_pure", f"SELECT seg_id, round({REF} * 2 ** log2, 6) AS cn FROM segs", S)(lambda s, d: rounded(segs(s, d).select("seg_id", calling.pure(F.col("log2"), ref()).alias("cn")), "cn"))
query("cl_expected", f"SELECT seg_id, {EXP} AS expect, {REF} AS ref FROM segs", S)(lambda s, d: segs(s, d).select("seg_id", calling.expected_copies().alias("expect"), ref().alias("ref")))
query("cl_log2_ratios", f"SELECT seg_id, round(log2(greatest({REF} * 2 ** log2 / 2, 1e-3)) + CASE WHEN chromosome IN ('chrX', 'chrY') THEN 1 ELSE 0 END, 6) AS ratio FROM segs", S)(
    lambda s, d: rounded(segs(s, d).select("seg_id", calling.log2_ratio(calling.pure(F.col("log2"), ref()), 2, True).alias("ratio")), "ratio"))
query("cl_rescale_baf", "SELECT snp_id, round(least(greatest((alt_freq - 0.15) / 0.7, 0), 1), 6) AS baf FROM snps", V)(lambda s, d: rounded(snps(s, d).select("snp_id", calling.rescale_baf(F.col("alt_freq"), 0.7).alias("baf")), "baf"))


def alleles(s, d):
    rows = segs(s, d).withColumns({"cn_abs": calling.pure(F.col("log2"), ref()), "baf": F.when(F.col("seg_id") % 3 != 0, (F.col("seg_id") % 101) / 100.0)})
    cn, cn1, cn2 = calling.allele_copies(F.col("cn_abs"), F.col("baf"))
    return rows.select("seg_id", cn.alias("cn"), cn1.alias("cn1"), cn2.alias("cn2")).fillna(-1, ["cn1", "cn2"])


query("cl_allele_copies", f"""SELECT seg_id, cn, CASE WHEN known THEN major ELSE -1 END AS cn1, CASE WHEN known THEN cn - major ELSE -1 END AS cn2 FROM (SELECT *, least(greatest(round_even(a * coalesce(abs(baf - 0.5) + 0.5, 1), 0)::BIGINT, 0), cn) AS major, baf IS NOT NULL OR cn = 0 AS known
  FROM (SELECT *, round_even(a, 0)::BIGINT AS cn FROM (SELECT seg_id, {REF} * 2 ** log2 AS a, CASE WHEN seg_id % 3 <> 0 THEN (seg_id % 101) / 100.0::DOUBLE END AS baf FROM segs)))""", S)(alleles)
CALLED = f"called AS (SELECT *, round_even({REF} * 2 ** log2, 0)::BIGINT AS cn, 1.0::DOUBLE + seg_id % 7 AS weight, 1 + seg_id % 5 AS probes FROM segs)"
RUNS = """SELECT chromosome, min("start") AS "start", max("end") AS "end", round(sum(log2 * weight) / sum(weight), 6) AS log2, sum(weight) AS weight, sum(probes)::BIGINT AS probes
  FROM (SELECT *, sum(brk) OVER (PARTITION BY chromosome ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(lv) OVER (PARTITION BY chromosome ORDER BY "start") <> lv THEN 1 ELSE 0 END AS brk FROM (SELECT *, {level} AS lv FROM called))) GROUP BY chromosome, run"""
OWN = 'CASE WHEN {} THEN 0 ELSE row_number() OVER (PARTITION BY chromosome ORDER BY "start") END'


def called(s, d, rows=segs):
    return rows(s, d).withColumns({"cn": F.bround(calling.pure(F.col("log2"), ref())).cast("long"), "weight": 1.0 + F.col("seg_id") % 7, "probes": 1 + F.col("seg_id") % 5})


def _runs(name, level_sql, level):
    query(name, RUNS.format(level=level_sql), S, CALLED)(lambda s, d: rounded(calling.squash_runs(called(s, d), level(), ["start"]), "log2"))


_runs("cl_filter_ampdel", "CASE WHEN cn = 0 THEN -1 WHEN cn >= 5 THEN 1 ELSE 0 END", calling.ampdel_level)
_runs("cl_merge_cn", "cn", lambda: F.col("cn"))
_runs("cl_filter_cn_neutral", OWN.format("cn = 2"), lambda: calling.neutral_level(F.col("cn") == 2, ["start"]))
_runs("cl_filter_ci", OWN.format("log2 - 0.3 <= 0 AND log2 + 0.3 >= 0"), lambda: calling.neutral_level((F.col("log2") - 0.3 <= 0) & (F.col("log2") + 0.3 >= 0), ["start"]))
_runs("cl_filter_sem", OWN.format("abs(log2) <= 1.96 * 0.1"), lambda: calling.neutral_level(F.abs("log2") <= 1.96 * 0.1, ["start"]))
query("cl_shift_xx", "SELECT seg_id, round(log2 + CASE WHEN chromosome = 'chrX' THEN 1 ELSE 0 END, 6) AS log2 FROM segs", S)(lambda s, d: rounded(segs(s, d).select("seg_id", calling.shift_xx(F.col("log2"), False, False).alias("log2")), "log2"))
query("cl_flat_expectation", "SELECT seg_id, (CASE WHEN chromosome IN ('chrX', 'chrY') THEN -1 ELSE 0 END)::DOUBLE AS log2 FROM segs", S)(lambda s, d: segs(s, d).select("seg_id", calling.expect_flat(True).alias("log2")))
# reports and exports
query("rp_genemetrics", "SELECT gene, chromosome, min(\"start\") AS \"start\", max(\"end\") AS \"end\", round(sum(log2 * weight) / sum(weight), 6) AS log2, round(sum(weight), 6) AS weight, count(*) AS probes FROM bins WHERE gene <> 'Antitarget' GROUP BY 1, 2 HAVING count(*) >= 3 AND abs(sum(log2 * weight) / sum(weight)) >= 0.2", B)(
    lambda s, d: rounded(reports.gene_metrics(bins(s, d)), "log2", "weight"))
query("rp_metrics_core", f"SELECT sample_id, round(stddev_pop(r), 6) AS stdev, round(1.4826 * {Q}(abs(r - mr), 0.5), 6) AS mad, round({Q}(r, 0.75) - {Q}(r, 0.25), 6) AS iqr FROM (SELECT *, median(r) OVER (PARTITION BY sample_id) AS mr FROM (SELECT sample_id, log2 - {Q}(log2, 0.5) OVER (PARTITION BY sample_id, chromosome) AS r FROM bins)) GROUP BY 1", B)(
    lambda s, d: rounded(reports.metrics(signal.residuals_by_chrom(bins(s, d), ["sample_id", "chromosome"]), ["sample_id"]), "stdev", "mad", "iqr"))
query("rp_segmetrics_core", f"""SELECT s.seg_id, count(b.log2) AS n, round(avg(b.log2), 6) AS mean, round({Q}(b.log2, 0.5), 6) AS median, round(stddev_pop(b.log2 - s.log2), 6) AS stdev, round(avg((b.log2 - s.log2) ** 2), 6) AS mse,
  round({Q}(b.log2 - s.log2, 0.75) - {Q}(b.log2 - s.log2, 0.25), 6) AS iqr, round({Q}(b.log2, 0.025), 6) AS pi_lo, round({Q}(b.log2, 0.975), 6) AS pi_hi FROM segs s LEFT JOIN bins b ON b.chromosome = s.chromosome AND b."end" > s."start" AND b."start" < s."end" GROUP BY 1""", B, S)(
    lambda s, d: rounded(reports.segment_metrics(bins(s, d), segs(s, d), "seg_id"), "mean", "median", "stdev", "mse", "iqr", "pi_lo", "pi_hi"))
query("rp_instability", "SELECT (sum(\"end\" - \"start\") FILTER (cn <> 2))::DOUBLE / sum(\"end\" - \"start\") AS fraction, count(*) FILTER (cn <> 2) AS n FROM called WHERE chromosome NOT IN ('chrX', 'chrY')", S, CALLED)(
    lambda s, d: reports.instability(called(s, d)))
query("rp_breaks", """, j AS (SELECT chromosome, "end" AS at, log2, lead(log2) OVER w AS after, lead("start") OVER w AS nxt FROM segs WINDOW w AS (PARTITION BY chromosome ORDER BY "start")),
g AS (SELECT chromosome, gene, min("start") AS s, max("end") AS e FROM bins WHERE gene <> 'Antitarget' GROUP BY 1, 2)
SELECT g.chromosome, g.gene, j.at, round(after - log2, 6) AS change, (SELECT count(*) FROM bins b WHERE b.chromosome = g.chromosome AND b.gene = g.gene AND b."start" < j.at) AS probes_left, (SELECT count(*) FROM bins b WHERE b.chromosome = g.chromosome AND b.gene = g.gene AND b."start" >= j.at) AS probes_right
FROM j JOIN g ON g.chromosome = j.chromosome AND j.at > s AND j.at < e WHERE after IS NOT NULL""".replace(", j AS", "SELECT * FROM (WITH j AS", 1) + ")", B, S)(
    lambda s, d: rounded(reports.breaks(bins(s, d), segs(s, d)), "change"))
query("ex_bed", """SELECT chromosome, "start", "end", 'S' AS label, cn FROM called WHERE cn <> CASE WHEN chromosome = 'chrY' THEN 0 ELSE 2 END""", S, CALLED)(lambda s, d: reports.export_bed(called(s, d), "S"))
query("ex_seg", """SELECT sample_id AS id, chromosome AS chrom, "start" + 1 AS loc_start, "end" AS loc_end, probes AS num_mark, round(log2, 6) AS seg_mean FROM (SELECT *, 'S' AS sample_id FROM called)""", S, CALLED)(
    lambda s, d: rounded(reports.export_seg(called(s, d).withColumn("sample_id", F.lit("S"))), "seg_mean"))
query("ex_vcf_core", """SELECT chromosome AS chrom, greatest("start", 1) AS pos, 'N' AS ref, CASE WHEN cn > e THEN '<DUP>' ELSE '<DEL>' END AS alt, CASE WHEN cn > e THEN 'DUP' ELSE 'DEL' END || ';END=' || "end" || ';SVLEN=' || CASE WHEN cn > e THEN '' ELSE '-' END || ("end" - "start") || ';PROBES=' || probes AS info,
  CASE WHEN cn > e THEN '0/1' WHEN cn = 0 THEN '1/1' ELSE '0/1' END AS gt FROM (SELECT *, CASE WHEN chromosome = 'chrY' THEN 0 ELSE 2 END AS e FROM called) WHERE cn <> e""", S, CALLED)(lambda s, d: reports.export_vcf(called(s, d)))
query("ex_nexus", """SELECT chromosome, "start", "end", gene, round(log2, 6) AS log2, chromosome || ':' || ("start" + 1) || '-' || "end" AS probe FROM bins""", B)(lambda s, d: rounded(reports.export_nexus(bins(s, d)), "log2"))
query("ex_pivot_jtv", """SELECT chromosome || ':' || "start" || '-' || "end" || ':' || gene AS clid, round(avg(log2) FILTER (sample_id = 'A'), 6) AS A, round(avg(log2) FILTER (sample_id = 'N'), 6) AS N, round(avg(log2) FILTER (sample_id = 'R'), 6) AS R FROM bins GROUP BY 1""", B)(
    lambda s, d: rounded(reports.merge_samples(bins(s, d), ["A", "N", "R"]), "A", "N", "R"))
query("ex_theta", """SELECT seg_id, chrm, "start", "end", floor(probes * 200 * 500 * 2 ** log2 / 100)::BIGINT AS tumor, floor(probes * 200 * 500 / 100)::BIGINT AS normal FROM (SELECT *, substr(chromosome, 4)::INT AS chrm FROM called WHERE chromosome NOT IN ('chrX', 'chrY'))""", S, CALLED)(lambda s, d: reports.export_theta(called(s, d, segs_to_the_bit)))
