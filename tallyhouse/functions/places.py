"""Places of rows within groups, in an order, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.raw import table_of


def placed(rows: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, within their group.

    Rows are dealt to ranges of (group, order), so a large group takes many tasks, and are written in that order with
    the range that they are in. A row's place is its place in its range's part of the group, plus the sizes of the
    group's parts in the ranges before: the last is a table of one row per range and group.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the number that Spark gives to rows as they are written: the range above 33 bits, and the place in the range below
    written = table_of(ranged.withColumn("_at", F.monotonically_increasing_id()), "places").withColumn("_range", F.shiftright("_at", 33))
    key = F.struct(F.col(group)).alias("_group")
    parts = written.groupBy("_range", key).agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_here")
    parts = parts.select("_range", "_group", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", "_group").orderBy("_at"))
    out = written.withColumn("_group", F.struct(F.col(group))).withColumn("_own", own).join(parts, ["_range", "_group"])
    return out.withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).select(*rows.columns, name)
