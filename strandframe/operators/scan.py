"""Running totals within ordered groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a tile; the windows below run over one tile of a chromosome at a time.
TILE = 1_000_000


def running(df: DataFrame, keys: list[str], order: list, name: str, value: Column, kind: str = "sum", inclusive: bool = False, tile: int = TILE) -> DataFrame:
    """df with the running sum or max of value within keys, over the rows before (or up to) each.

    The order must begin with ``start``. Each tile is scanned on its own and gets what comes before it
    from a table of one row a tile, so a chromosome is as many tasks as it has tiles. Rows with a null key
    or start stay, and see only rows of their own tile.
    """
    f = {"sum": F.sum, "max": F.max}[kind]
    rows = df.withColumn("__tile", F.floor(F.col("start") / tile)).withColumn("__value", value)
    every = Window.partitionBy(*keys, "__tile")
    local = every.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn("__local", f("__value").over(local))
    before = Window.partitionBy(*keys).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "__tile").agg(f("__value").alias("__of")).withColumn("__carry", f("__of").over(before)).drop("__of")
    rows = rows.join(carry, [*keys, "__tile"], "left")
    total = F.greatest("__local", "__carry") if kind == "max" else F.coalesce("__local", F.lit(0)) + F.coalesce("__carry", F.lit(0))
    return rows.withColumn(name, total).drop("__tile", "__value", "__local", "__carry")


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], number: str | None = None, tile: int = TILE) -> DataFrame:
    """df with columns (new name: column) of the row before each within keys, null for the first, and the row's
    number from 0 as ``number``; tiled as running() is."""
    order = [*order, *[c for c in columns.values() if c not in order]]
    taken = F.struct(*[F.col(c).alias(k) for k, c in columns.items()])
    rows = df.withColumn("__tile", F.floor(F.col("start") / tile))
    every = Window.partitionBy(*keys, "__tile").orderBy(*order)
    rows = rows.withColumn("__local", F.lag(taken).over(every))
    if number:
        rows = rows.withColumn(number, F.row_number().over(every) - 1)
    before = Window.partitionBy(*keys).orderBy("__tile")
    ends = df.withColumn("__tile", F.floor(F.col("start") / tile)).groupBy(*keys, "__tile").agg(F.max_by(taken, F.struct(*order)).alias("__last"), F.count("*").alias("__of"))
    ends = ends.withColumn("__last", F.lag("__last").over(before)).withColumn("__of", F.sum("__of").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(ends, [*keys, "__tile"], "left").withColumn("__local", F.coalesce("__local", "__last"))
    if number:
        rows = rows.withColumn(number, F.col(number) + F.coalesce("__of", F.lit(0).cast("long")))
    return rows.withColumns({k: F.col(f"__local.{k}") for k in columns}).drop("__tile", "__local", "__last", "__of")
