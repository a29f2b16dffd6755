"""Columns that share the overlap join's own names, and look-ups that must fail."""

import pytest
from pyspark.sql import functions as F

from strandframe.operators import intervals as iv
from strandframe.operators import screens

SCHEMA = "chromosome string, start long, end long, gene string"


def test_overlap_join_keeps_columns(spark):
    rows = spark.createDataFrame([("chr1", 10, 90, "A"), ("chr1", 200_000, 200_100, "B")], SCHEMA).withColumns({"first": F.lit(777), "bucket": F.lit(778)})
    got = iv.overlap_join(rows, rows.select("chromosome", "start", "end")).select("gene", "first", "bucket").collect()
    assert sorted(map(tuple, got)) == [("A", 777, 778), ("B", 777, 778)]


def test_names_that_no_or_two_places_have(spark):
    bins = spark.createDataFrame([("chr1", 10, 90, "A,B"), ("chr1", 100, 150, "A,B"), ("chr2", 1, 5, "C"), ("chr3", 1, 5, "C")], SCHEMA)
    assert [tuple(r) for r in screens.genes_by_name(bins, ["A", "B"]).collect()] == [("chr1", 10, 150, "A,B")]
    for name in ("C", "D"):
        with pytest.raises(ValueError):
            screens.genes_by_name(bins, [name])
