"""Figures: a group's numerator, denominator and small-sample flag, from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MIN_GROUP_SIZE, is_small


def valid(df: DataFrame, *fields: str) -> DataFrame:
    """The records that hold a value in every named field."""
    return df.dropna(subset=list(fields))


def rates(df: DataFrame, label: Column, flag: Column, *measures: Column, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(group_label, numerator, denominator, measures..., small_sample): the true flags among each group; the group's size decides."""
    out = df.groupBy(label.alias("group_label")).agg(F.count_if(flag).alias("numerator"), F.count("*").alias("denominator"), *measures)
    return out.withColumn("small_sample", is_small(F.col("denominator"), minimum))


def counts(df: DataFrame, label: Column, *measures: Column, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(group_label, numerator, denominator, small_sample, measures...): each group's count of all; the count decides."""
    out = df.groupBy(label.alias("group_label")).agg(F.count("*").alias("numerator"), *measures)
    whole = Window.partitionBy(F.lit(1))  # over groups, not records
    return out.withColumn("denominator", F.sum("numerator").over(whole)).withColumn("small_sample", is_small(F.col("numerator"), minimum))


def span(day: str) -> list[Column]:
    """Measures of each group for with_span()."""
    return [F.min(day).alias("first_in"), F.max(day).alias("last_in")]


def with_span(figures: DataFrame) -> DataFrame:
    """figures, which have the measures of span(), with the first and last day observed in all groups."""
    whole = Window.partitionBy(F.lit(1))  # over groups, not records
    return figures.withColumn("first_day", F.min("first_in").over(whole)).withColumn("last_day", F.max("last_in").over(whole))


def partial(bounds: tuple[Column, Column]) -> Column:
    """Whether the observed days fail to cover the whole period."""
    return (F.col("first_day") > bounds[0]) | (F.col("last_day") < bounds[1])
