"""Running totals, positions and neighbours in order, without one task for a whole group.

Rows are dealt out by range of (group, order) and written with the number of their range. Within a range windows
do the work; what a range needs of the earlier ones is one row, as only its first group can go on from before.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import keep

PART = "__part"


def ranged(df: DataFrame, cols: list[str], parts: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``cols``; adds the range's number, which rises with them."""
    spark = df.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return keep(df.repartitionByRange(parts, *[F.col(f"`{c}`") for c in cols]).withColumn(PART, F.spark_partition_id()), "ranged")


def carried(rows: DataFrame, groups: list[str], value: Column, over) -> DataFrame:
    """(range, group, carry) where an earlier range holds rows of the group: at most one row a range."""
    per = rows.groupBy(PART, *groups).agg(value.alias("v"))
    before = over(F.col("v")).over(Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("carry", before).where(F.col("carry").isNotNull()).drop("v")


def with_carry(rows: DataFrame, carry: DataFrame, groups: list[str]) -> DataFrame:
    a, b = rows.alias("a"), F.broadcast(carry).alias("b")
    on = reduce(and_, [F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`")) for g in [PART, *groups]])
    return a.join(b, on, "left").select("a.*", "b.carry")


def running_total(df: DataFrame, groups: list[str], order: list[str], weight: Column, out: str) -> DataFrame:
    """Adds the sum of ``weight`` over the earlier rows of the row's group; ``order`` must leave no ties."""
    rows = ranged(df.withColumn("__w", weight.cast("long")), [*groups, *order])
    own = F.sum("__w").over(Window.partitionBy(PART, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    got = with_carry(rows.withColumn("__own", own), carried(rows, groups, F.sum("__w"), F.sum), groups)
    return got.withColumn(out, F.coalesce("__own", F.lit(0)) + F.coalesce("carry", F.lit(0))).drop("__own", "__w", "carry", PART)


def pieces(df: DataFrame, groups: list[str], time: str, order: list[str], gap: float, out: str) -> DataFrame:
    """Adds the number of the row's piece: a group is cut where its next row comes more than ``gap`` later."""
    rows = ranged(df, [*groups, *order])
    w = Window.partitionBy(PART, *groups).orderBy(*order)
    got = with_carry(rows.withColumn("__before", F.lag(time).over(w)), carried(rows, groups, F.max(time), F.max), groups)
    before = F.coalesce("__before", "carry")
    cut = keep(got.withColumn("__cut", (before.isNull() | (F.col(time) - before > gap)).cast("long")).drop("__before", "carry"), "cut")
    own = F.sum("__cut").over(w)
    got = with_carry(cut.withColumn("__own", own), carried(cut, groups, F.sum("__cut"), F.sum), groups)
    return got.withColumn(out, F.col("__own") + F.coalesce("carry", F.lit(0))).drop("__own", "__cut", "carry", PART)
