"""Row numbers and running sums over a whole table, or over large groups, without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.shared import materialize


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt to ranges of an order and written, with the range's number in __range."""
    return materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], name: str = "k") -> DataFrame:
    """df with each row's number from 1 in that order, which should be unique.

    Rows are dealt to ranges and written; the ranges' counts, a row for each, give the number that each begins with.
    """
    rows = ranged(df, order)
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__first"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    # a row for each range, of which there are as many as the session has shuffle partitions
    return rows.withColumn("__inner", inner).join(F.broadcast(first), "__range").withColumn(name, (F.col("__inner") + F.col("__first")).cast("long")).drop("__range", "__inner", "__first")


def running(df: DataFrame, keys: list[str], order: str, amount: str, name: str = "through") -> DataFrame:
    """df with the sum of an amount over a key's rows up to each row, by an order that is unique within a key.

    A key's rows can be any share of the table: they are dealt to ranges of (keys, order), sums of a range's keys say
    what stands before each range, and the rest is summed within a range.
    """
    rows = ranged(df, [*map(F.col, keys), F.col(order)])
    part = rows.groupBy("__range", *keys).agg(F.sum(amount).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    first = part.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.sum(amount).over(Window.partitionBy("__range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    on = [F.col("__range") == F.col("__r")] + [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.withColumn("__inner", inner).join(first, on).withColumn(name, F.col("__inner") + F.col("__before")).select(*df.columns, name)
