"""Queries over fields that segments take from elsewhere, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chrom import is_autosome
from ..operators import filters
from ..operators import transfer as tr
from .adapters import bins, duck, segs

B, S = duck("bins"), duck("segs")


def transfer_fields(spark, d):
    b = bins(spark, d)
    out = tr.transfer_fields(filters.shared_chroms(segs(spark, d), b), b, "seg_id")
    # depth to 8 digits, here and in the SQL: at 6, one mean at sf0.01 is a tie, 27.1796875, which the order of summation decides
    return out.select("chromosome", "start", "end", "seg_id", "gene", *[F.round(c, n).alias(c) for c, n in (("log2", 6), ("weight", 6), ("depth", 8))])


TRANSFER = f"""WITH {B}, {S}, known AS (SELECT * FROM segs WHERE chromosome IN (SELECT chromosome FROM bins)),
reach AS (SELECT chromosome, min("start") AS lo, arg_max("end", "start" * 1000 + "end" - "start") AS hi FROM bins GROUP BY 1),
put AS (SELECT chromosome, seg_id, log2, CASE WHEN "start" = min("start") OVER c THEN lo ELSE "start" END AS "start", CASE WHEN "start" = max("start") OVER c THEN hi ELSE "end" END AS "end"
  FROM known JOIN reach USING (chromosome) WINDOW c AS (PARTITION BY chromosome)),
hit AS (SELECT seg_id, gene, b."start" * 1000 + b."end" - b."start" AS place, depth, weight FROM put p JOIN bins b ON b.chromosome = p.chromosome AND b."end" > p."start" AND b."start" < p."end"),
named AS (SELECT seg_id, string_agg(gene, ',' ORDER BY place, gene) AS gene FROM (SELECT seg_id, gene, min(place) AS place FROM hit WHERE gene <> 'Antitarget' GROUP BY 1, 2) GROUP BY 1),
summed AS (SELECT seg_id, sum(weight) AS w, sum(depth * weight) AS dw FROM hit GROUP BY 1)
SELECT chromosome, "start", "end", seg_id, coalesce(gene, '-') AS gene, round(log2, 6) AS log2, round(coalesce(w, 0), 6) AS weight, round(coalesce(dw / w, 0), 8) AS depth
FROM put LEFT JOIN named USING (seg_id) LEFT JOIN summed USING (seg_id)"""


def import_theta(spark, d):
    rows = tr.positions(segs(spark, d).filter(is_autosome(F.col("chromosome"))))
    theta = rows.select("row", F.explode(F.array(F.lit(0), F.lit(1))).alias("solution"))
    theta = theta.withColumn("copies", F.when(F.col("row") % 7 != 0, (F.col("row") + F.col("solution")) % 5))
    out = tr.import_theta(segs(spark, d), theta)
    return out.select("solution", "chromosome", "start", "end", "seg_id", "cn", F.round("log2", 6).alias("log2"))


THETA = f"""WITH {S}, auto AS (SELECT *, row_number() OVER (ORDER BY CAST(regexp_extract(chromosome, '[0-9]+') AS INTEGER), "start", "end") - 1 AS row FROM segs WHERE regexp_matches(chromosome, '^chr[0-9]+$')),
theta AS (SELECT s AS solution, i AS row, CASE WHEN i % 7 <> 0 THEN (i + s) % 5 END AS copies FROM (SELECT row FROM auto) t(i), range(2) u(s))
SELECT CAST(solution AS INTEGER) AS solution, chromosome, "start", "end", seg_id, copies AS cn, round(log2(greatest(copies, 0.5) / 2), 6) AS log2 FROM auto JOIN theta USING (row) WHERE copies IS NOT NULL"""

QUERIES = {"wf_transfer_fields": transfer_fields, "cl_import_theta": import_theta}
ORACLES = {"wf_transfer_fields": TRANSFER, "cl_import_theta": THETA}
