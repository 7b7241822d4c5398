"""Tables from stored result documents. A part that is missing or misshapen becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import ratio_text, share, share_text


def groups(documents: DataFrame) -> DataFrame:
    """(analysis, entry): the entries of each document (analysis, doc), as variants."""
    record = F.try_parse_json("doc")
    return documents.select("analysis", F.explode_outer(F.try_variant_get(record, "$.groups", "array<variant>")).alias("entry"))


def figure_rows(documents: DataFrame, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(analysis, label, records, of, share, small_sample, extra...): a row for each stored figure; extra are (name, type) of entry fields."""
    get = lambda path, kind: F.try_variant_get("entry", f"$.{path}", kind)
    rows = groups(documents).select(
        "analysis", get("figure.group", "string").alias("label"), get("figure.numerator", "bigint").alias("records"), get("figure.denominator", "bigint").alias("of"),
        get("figure.small_sample", "boolean").alias("small_sample"), *[get(n, k).alias(n) for n, k in extra],
    )
    return rows.withColumn("share", share(F.col("records"), F.col("of")))


def split_rows(documents: DataFrame) -> DataFrame:
    """(analysis, split, label, records, of, share, ratio, small_sample, partial_period): a row for each figure of every split."""
    get = lambda path, kind: F.try_variant_get("entry", f"$.{path}", kind)
    rows = groups(documents).where("entry is not null").select(
        "analysis", get("split", "string").alias("split"), get("figure.group", "string").alias("label"), get("figure.numerator", "bigint").alias("records"),
        get("figure.denominator", "bigint").alias("of"), get("figure.small_sample", "boolean").alias("small_sample"), get("partial_period", "boolean").alias("partial_period"),
    )
    records, of = F.col("records"), F.col("of")
    return rows.withColumn("share", F.when(records.isNull(), "n/a").otherwise(share_text(records, of))).withColumn("ratio", ratio_text(records, of))


def limitations(figures: DataFrame) -> DataFrame:
    """(analysis, figures, small_samples, partial_periods) over a table of figures."""
    return figures.groupBy("analysis").agg(F.count("*").alias("figures"), F.count_if("small_sample").alias("small_samples"), F.count_if(F.coalesce("partial_period", F.lit(False))).alias("partial_periods"))


def whole_limitations(figures: DataFrame, availability: DataFrame) -> DataFrame:
    """(analysis, figures, small_samples, partial_periods, reason) for each analysis of availability; one that is unavailable has its reason and no counts."""
    counted = limitations(figures)
    names = [c for c in counted.columns if c != "analysis"]
    rows = availability.select("analysis", "status", "reason").join(counted, "analysis", "left")
    return rows.select("analysis", *[F.when(F.col("status") == "available", F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c) for c in names], "reason")
