"""Queries over screens, gene look-ups, covered runs and bedGraph depth, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..operators import screens as sc
from .adapters import bins, duck, segs, snps
from .q_copynumber import CALLED, called

QUERIES, ORACLES = {}, {}
B, S, V = duck("bins"), duck("segs"), duck("snps")


def query(name: str, sql: str, *tables: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = (f"WITH {', '.join(tables)} " if tables else "") + sql
        return f

    return keep


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _sizes(s, d):
    ends = segs(s, d).groupBy("chromosome").agg(F.max("end").alias("size"))
    return ends.withColumn("size", F.when(F.col("chromosome").isin("chrX", "chrY", "chr3"), F.floor(F.col("size") / 10)).otherwise(F.col("size")))


query("pf_big_chroms", """SELECT n_big, thresh FROM (SELECT size AS thresh, nth, CASE WHEN max(nth) FILTER (fall) OVER () > 1 THEN min(nth) FILTER (fall) OVER () ELSE count(*) OVER () END AS n_big
  FROM (SELECT size, row_number() OVER w AS nth, (size - lead(size) OVER w) / size::DOUBLE > 0.5 AS fall FROM (SELECT CASE WHEN chromosome IN ('chrX', 'chrY', 'chr3') THEN max("end") // 10 ELSE max("end") END AS size FROM segs GROUP BY chromosome) WINDOW w AS (ORDER BY size DESC))) WHERE nth = n_big""", S)(
    lambda s, d: sc.big_chroms(_sizes(s, d)))


def _contigs(s, d):
    alt = F.when(F.col("seg_id") % 7 == 0, F.concat(F.lit("alt_"), F.col("chromosome"))).when(F.col("seg_id") % 7 == 1, F.lit("chrM")).otherwise(F.col("chromosome"))
    return segs(s, d).withColumn("chromosome", alt)


query("pf_noncanonical", """SELECT * FROM (SELECT CASE WHEN seg_id % 7 = 0 THEN 'alt_' || chromosome WHEN seg_id % 7 = 1 THEN 'chrM' ELSE chromosome END AS chromosome, "start", "end", seg_id FROM segs) WHERE chromosome LIKE 'chr%' AND chromosome <> 'chrM'""", S)(
    lambda s, d: sc.drop_noncanonical(_contigs(s, d), bins(s, d)).select("chromosome", "start", "end", "seg_id"))
query("pf_drop_small", """SELECT chromosome, "start", "end", gene, count(*) AS n FROM bins WHERE "end" - "start" >= 200 GROUP BY ALL""", B)(
    lambda s, d: sc.drop_small(bins(s, d), 200).groupBy("chromosome", "start", "end", "gene").agg(F.count("*").alias("n")))
query("pf_targets", "SELECT gene, count(*) AS n, round(avg(log2), 6) AS log2 FROM bins WHERE gene NOT IN ('Antitarget', 'Background') GROUP BY 1", B)(
    lambda s, d: rounded(sc.targets_only(bins(s, d)).groupBy("gene").agg(F.count("*").alias("n"), F.avg("log2").alias("log2")), "log2"))
query("pf_antitargets", "SELECT chromosome, \"start\", \"end\", round(log2, 6) AS log2 FROM bins WHERE gene IN ('Antitarget', 'Background')", B)(
    lambda s, d: rounded(sc.antitargets_only(bins(s, d)).select("chromosome", "start", "end", "log2"), "log2"))


def _counts(s, d):
    return bins(s, d).groupBy(F.concat_ws(".", "chromosome", "gene").alias("gene"), F.col("sample_id").alias("sample")).agg(F.sum((F.col("depth") > 40).cast("long")).alias("count"))


query("pf_expressed", """SELECT gene, sample, count FROM (SELECT *, quantile_cont(count, 0.7) OVER (PARTITION BY gene) AS q FROM (SELECT chromosome || '.' || gene AS gene, sample_id AS sample, count(*) FILTER (depth > 40) AS count FROM bins GROUP BY 1, 2)) WHERE q >= 1""", B)(
    lambda s, d: sc.expressed(_counts(s, d), 0.3))
query("rp_bad_bins", "SELECT gene, count(*) AS n_bins, count(*) FILTER (NOT (abs(log2) <= 5 AND depth <> 0)) AS n_bad FROM (SELECT gene, log2 * 4 AS log2, depth FROM bins) GROUP BY 1 HAVING n_bad > 0", B)(
    lambda s, d: sc.bad_bins_by_gene(bins(s, d).withColumn("log2", F.col("log2") * 4)))
query("pf_status", """SELECT seg_id, CASE WHEN CASE WHEN chromosome = 'chrX' THEN cn IN (1, 2) WHEN chromosome = 'chrY' THEN cn IN (0, 1) ELSE cn = 2 END THEN 'neutral' ELSE 'altered' END AS status FROM called""", S, CALLED)(
    lambda s, d: called(s, d).select("seg_id", sc.status().alias("status")))
_NAMES = [f"chr{i}.G{3 * i}" for i in range(1, 23)]
query("jn_genes_by_name", f"""SELECT chromosome, "start", "end", string_agg(name, ',' ORDER BY name) AS gene FROM (SELECT chromosome || '.' || gene AS name, chromosome, min("start") AS "start", max("end") AS "end" FROM bins WHERE name IN ({', '.join(map(repr, _NAMES))}) GROUP BY 1, 2) GROUP BY 1, 2, 3""", B)(
    lambda s, d: sc.genes_by_name((b := bins(s, d).withColumn("gene", F.concat_ws(".", "chromosome", "gene"))), [r.gene for r in b.filter(F.col("gene").isin(_NAMES)).select("gene").distinct().limit(len(_NAMES)).collect()]))
query("jn_genes_by_range", """SELECT gene, min("start") AS "start", arg_max("end", "start" * 1000 + "end" - "start") AS "end" FROM bins WHERE chromosome = 'chr5' AND "end" > 100000 AND "start" < 900000 AND gene <> 'Antitarget' GROUP BY 1""", B)(
    lambda s, d: sc.genes_by_range(bins(s, d), "chr5", 100_000, 900_000))
query("jn_segment_vafs", """SELECT s.seg_id, alt_freq > 0.5 AS above, round(quantile_cont(alt_freq, 0.5), 6) AS vaf FROM snps v JOIN segs s ON s.chromosome = v.chromosome AND v."end" > s."start" AND v."start" < s."end" GROUP BY 1, 2 HAVING count(*) > 1""", S, V)(
    lambda s, d: rounded(sc.segment_vafs(snps(s, d), segs(s, d), "seg_id"), "vaf"))


def _ranges(s, d):
    return segs(s, d).select("chromosome", "start", (F.col("start") + 1500).alias("end"))


query("pf_in_ranges_trim", """SELECT b.chromosome, greatest(b."start", s."start") AS "start", least(b."end", s."start" + 1500) AS "end", b.gene, round(b.log2, 6) AS log2 FROM bins b JOIN segs s ON s.chromosome = b.chromosome AND b."end" > s."start" AND b."start" < s."start" + 1500""", B, S)(
    lambda s, d: rounded(sc.in_ranges(bins(s, d), _ranges(s, d), "trim").select("chromosome", "start", "end", "gene", "log2"), "log2"))
query("jn_chrom_lengths", """SELECT chromosome, n, length FROM (SELECT chromosome, count(*) AS n FROM bins GROUP BY 1) JOIN (SELECT chromosome, sum("end" - "start")::BIGINT AS length FROM segs GROUP BY 1) USING (chromosome)""", B, S)(
    lambda s, d: sc.chrom_lengths(bins(s, d).groupBy("chromosome").agg(F.count("*").alias("n")), segs(s, d)))


def _covered(s, d):
    per = bins(s, d).groupBy("chromosome", F.floor(F.col("start") / 4000).alias("pos")).agg(F.sum("depth").cast("double").alias("depth"))
    return sc.covered_runs(per, 30)


RUNS = """per AS (SELECT chromosome, "start" // 4000 AS pos, sum(depth)::DOUBLE AS depth FROM bins GROUP BY 1, 2),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY chromosome ORDER BY pos) AS run FROM per WHERE depth >= 30),
peaks AS (SELECT *, max(depth) OVER (PARTITION BY chromosome, run) AS peak FROM isl),
spans AS (SELECT *, min(CASE WHEN depth >= peak / 2 THEN pos END) OVER (PARTITION BY chromosome, run) AS lo, max(CASE WHEN depth >= peak / 2 THEN pos END) OVER (PARTITION BY chromosome, run) AS hi FROM peaks),
runs AS (SELECT chromosome, min(pos) AS "start", max(pos) + 1 AS "end", avg(depth) AS depth FROM spans WHERE pos BETWEEN lo AND hi GROUP BY chromosome, run)"""
query("sm_runs", 'SELECT chromosome, "start", "end", round(depth, 6) AS depth FROM runs', B, RUNS)(lambda s, d: rounded(_covered(s, d), "depth"))
query("iv_merge_gaps", """SELECT chromosome, min("start") AS "start", max("end") AS "end", round(sum(depth * ("end" - "start")) / sum("end" - "start"), 6) AS depth
  FROM (SELECT *, sum(head) OVER (PARTITION BY chromosome ORDER BY "start") AS run FROM (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY chromosome ORDER BY "start") BETWEEN 0 AND 2 THEN 0 ELSE 1 END AS head FROM runs)) GROUP BY chromosome, run""", B, RUNS)(
    lambda s, d: rounded(sc.merge_gaps(_covered(s, d), 3), "depth"))


def _graph(s, d):
    return bins(s, d).select(F.regexp_replace("chromosome", "^chr", "").alias("chromosome"), "start", "end", F.col("depth").cast("double").alias("depth")).filter("chromosome <> 'Y'")


query("wf_bedgraph", """SELECT s.seg_id, round(coalesce(sum(b.depth * (least(b."end", s."end") - greatest(b."start", s."start"))), 0)::DOUBLE, 4) AS basecount, round(coalesce(sum(b.depth * (least(b."end", s."end") - greatest(b."start", s."start"))), 0)::DOUBLE / 40000, 6) AS depth
  FROM segs s LEFT JOIN (SELECT * FROM bins WHERE chromosome <> 'chrY') b ON b.chromosome = s.chromosome AND b."end" > s."start" AND b."start" < s."end" GROUP BY 1""", B, S)(
    lambda s, d: sc.bedgraph_depth(segs(s, d).drop("log2"), _graph(s, d)).select("seg_id", F.round("basecount", 4).alias("basecount"), F.round("depth", 6).alias("depth")))
query("so_midsize_sample", """SELECT chromosome, "start", "end" FROM (SELECT DISTINCT chromosome, "start", "end" FROM bins), (SELECT quantile_cont("end" - "start", 0.25) AS lo, quantile_cont("end" - "start", 0.75) AS hi FROM (SELECT DISTINCT chromosome, "start", "end" FROM bins))
  WHERE "end" - "start" BETWEEN lo AND hi ORDER BY md5('a5eed:' || chromosome || ':' || "start" || ':' || "end") LIMIT 500""", B)(
    lambda s, d: sc.midsize_sample(bins(s, d).select("chromosome", "start", "end").distinct(), 500))
query("so_midsize", """SELECT chromosome AS path, size FROM (SELECT *, row_number() OVER (ORDER BY size, chromosome) AS i, count(*) OVER () AS n FROM (SELECT chromosome, count(*) AS size FROM bins GROUP BY 1)) WHERE i = (n + 1) // 2""", B)(
    lambda s, d: sc.midsize(bins(s, d).groupBy(F.col("chromosome").alias("path")).agg(F.count("*").alias("size"))))
query("so_shuffle", """SELECT seg_id, md5('a5eed:' || chromosome || ':' || "start" || ':' || seg_id) AS place FROM segs""", S)(
    lambda s, d: (lambda x: sc.shuffled(x).select("seg_id", sc.drawn(x, "a5eed").alias("place")))(segs(s, d).select("chromosome", "start", "seg_id")))
query("rp_gene_intervals", """SELECT chromosome, gene, min("start") AS "start", max("end") AS "end", count(*) AS probes FROM bins WHERE gene <> 'Antitarget' GROUP BY 1, 2""", B)(lambda s, d: sc.gene_intervals(bins(s, d)))
query("rp_squash_genes", """SELECT chromosome, gene, min("start") AS "start", arg_max("end", "start" * 1000 + "end" - "start") AS "end", round(quantile_cont(log2, 0.5), 6) AS log2, count(*) AS probes FROM bins WHERE gene <> 'Antitarget' GROUP BY 1, 2
  UNION ALL SELECT chromosome, gene, "start", "end", round(log2, 6), 1 FROM bins WHERE gene = 'Antitarget'""", B)(
    lambda s, d: rounded(sc.squashed_genes(bins(s, d), ["start", "end"]), "log2"))
query("rp_top_breaks", """, j AS (SELECT chromosome, "end" AS at, log2, lead(log2) OVER w AS after FROM segs WINDOW w AS (PARTITION BY chromosome ORDER BY "start")),
g AS (SELECT chromosome, gene, min("start") AS s, max("end") AS e FROM bins WHERE gene <> 'Antitarget' GROUP BY 1, 2),
hit AS (SELECT g.chromosome, g.gene, j.at, after - log2 AS change, (SELECT count(*) FROM bins b WHERE b.chromosome = g.chromosome AND b.gene = g.gene AND b."start" < j.at) AS probes_left, (SELECT count(*) FROM bins b WHERE b.chromosome = g.chromosome AND b.gene = g.gene AND b."start" >= j.at) AS probes_right
FROM j JOIN g ON g.chromosome = j.chromosome AND j.at > s AND j.at < e WHERE after IS NOT NULL)
SELECT chromosome, gene, "at", round(change, 6) AS change, probes_left, probes_right FROM hit ORDER BY least(probes_left, probes_right) DESC, abs(change) DESC, chromosome, gene, "at" LIMIT 100""".replace(", j AS", "SELECT * FROM (WITH j AS", 1) + ")", B, S)(
    lambda s, d: rounded(sc.top_breaks(reports.breaks(bins(s, d), segs(s, d)), 100), "change"))
