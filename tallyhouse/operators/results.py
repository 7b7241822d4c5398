"""Result documents, and the history of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions.places import placed
from tallyhouse.sources.raw import remove, table_of, there

#: The fields of a stored result, and the statuses that are stored.
ENVELOPE = ("schema_version", "result_id", "generated_at", "status", "input", "data_quality", "analyses", "notices")
STORED = ("completed", "completed_with_warnings")
SCHEMA_VERSION = "1.0"


def readout(history: DataFrame) -> DataFrame:
    """history (history_id, position, line) with is_blank, is_valid and, of valid lines, result_id, generated_at, status, version."""
    record = F.try_parse_json("line")
    keys = F.when(F.schema_of_variant(record).startswith("OBJECT"), F.json_object_keys("line"))
    valid = F.coalesce(F.size(F.array_intersect(keys, F.array(*map(F.lit, ENVELOPE)))) == len(ENVELOPE), F.lit(False))
    field = lambda name: F.when(valid, F.try_variant_get(record, f"$.{name}", "string"))
    return history.select(
        "history_id", "position", "line", (F.trim("line") == "").alias("is_blank"), valid.alias("is_valid"), field("result_id").alias("result_id"),
        field("generated_at").alias("generated_at"), field("status").alias("status"), field("schema_version").alias("version"),
    )


def readout_counts(history: DataFrame) -> DataFrame:
    """(history_id, results, malformed): blank lines are neither."""
    return readout(history).groupBy("history_id").agg(F.count_if("is_valid").alias("results"), F.count_if(~F.col("is_valid") & ~F.col("is_blank")).alias("malformed"))


def storable(results: DataFrame, status: str = "status") -> DataFrame:
    return results.where(F.col(status).isin(*STORED))


def append(results: DataFrame, path: str) -> None:
    """Append the storable results that a table does not hold yet to it; it is partitioned by run date, null where generated_at cannot be read.

    Results are known by result_id: one that the table holds is left out, so an append that is tried again adds nothing,
    and of several with one id one is stored. Results without an id are always stored. One writer at a time.
    """
    spark = results.sparkSession
    new = storable(results).withColumn("run_date", F.try_to_timestamp("generated_at").cast("date"))
    named = new.where("result_id is not null").dropDuplicates(["result_id"])
    if there(spark, path):
        named = named.join(spark.read.schema(new.schema).parquet(path).select("result_id").where("result_id is not null"), "result_id", "left_anti").select(*new.columns)
    # what is to be added is settled before the table that it was compared with changes
    table_of(named.unionByName(new.where("result_id is null")), "new-results").write.mode("append").partitionBy("run_date").parquet(path)


def prune(spark: SparkSession, path: str, limit: int) -> None:
    """Keep the latest limit results of a table of append(), by generated_at, later result_id first where times are equal; unreadable times are the oldest.

    Dates are counted first. Dates that stay whole are not touched, dates that go whole are removed, and of the one date
    that the limit falls into the rows that stay are written anew. Tried again, it finds nothing to do.
    """
    if not there(spark, path):
        return
    table = spark.read.parquet(path)
    # one row per date
    newest = F.col("run_date").desc_nulls_last()
    dates = table.groupBy("run_date").agg(F.count("*").alias("n"))
    dates = dates.withColumn("after", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(newest)) - F.col("n"))
    for day, n, after in dates.where(F.col("after") + F.col("n") > limit).orderBy(newest).select("run_date", "n", "after").collect():
        name = f"run_date={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"
        if after >= limit:
            remove(spark, f"{path}/{name}")
            continue
        own = table.where(F.col("run_date").eqNullSafe(F.lit(day)))
        time = F.try_to_timestamp("generated_at").desc_nulls_last()
        kept = table_of(own.orderBy(time, F.desc("result_id")).limit(limit - after), "kept-results")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def retain(history: DataFrame, limit: int) -> DataFrame:
    """history with the latest limit valid lines of each history, in place; malformed and blank lines stay."""
    rows = readout(history)
    place = F.row_number().over(Window.partitionBy("history_id").orderBy(F.desc("position")))
    # a limit on a rank alone is applied before rows move, so a hot history costs a few rows per task
    latest = rows.where("is_valid").select("history_id", "position", "line").withColumn("place", place).where(F.col("place") <= limit).drop("place")
    return latest.unionByName(rows.where("not is_valid").select("history_id", "position", "line"))


def listing(history: DataFrame) -> DataFrame:
    """(history_id, place, position, result_id, generated_at, supported): valid results, newest first; of equal times the later line; unreadable times last.

    Places come from ranges of the whole order, so a history of most lines is spread over many tasks.
    """
    rows = readout(history).where("is_valid").withColumn("time", F.try_to_timestamp("generated_at"))
    supported = F.coalesce(F.split_part("version", F.lit("."), F.lit(1)) == "1", F.lit(False))
    rows = rows.select("history_id", "position", "result_id", "generated_at", supported.alias("supported"), "time")
    out = placed(rows, "history_id", [F.col("time").desc_nulls_last(), F.desc("position")])
    return out.select("history_id", "place", "position", "result_id", "generated_at", "supported")


def figure(numerator: str = "numerator", denominator: str = "denominator") -> Column:
    return F.struct(F.col("group_label").alias("group"), F.col(numerator).alias("numerator"), F.col(denominator).alias("denominator"), "small_sample")


def document(analysis: str, figures: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(analysis, doc): an analysis as one JSON document of its figures, in label order; figures are groups, not records."""
    entry = F.struct(F.col("group_label").alias("order"), figure().alias("figure"), *extra)
    entries = F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["figure"].alias("figure"), *[x[c].alias(c) for c in extra]))
    body = F.struct(F.lit("available").alias("status"), F.col("groups"))
    return figures.agg(entries.alias("groups")).select(F.lit(analysis).alias("analysis"), F.to_json(body).alias("doc"))


def documents(figures: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(analysis, doc): each analysis of a long table (findings.figures) as one JSON document, in order of split and label.

    parts (findings.part_status) adds the splits that are unavailable with their reasons, in place of figures; an
    analysis without any available split is unavailable itself.
    """
    entry = F.struct("split", F.col("group_label").alias("order"), figure().alias("figure"), "partial_period", F.to_json("details").alias("details"))
    entries = F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["split"].alias("split"), x["figure"].alias("figure"), x["partial_period"].alias("partial_period"), F.from_json(x["details"], "map<string,string>").alias("details")))
    if parts is None:
        body = F.struct(F.lit("available").alias("status"), F.col("groups"))
        return figures.groupBy("analysis").agg(entries.alias("groups")).select("analysis", F.to_json(body).alias("doc"))
    gone = F.col("status") == "unavailable"
    lists = parts.groupBy("analysis").agg(
        F.sort_array(F.collect_list(F.when(gone, F.struct("split", "status", "reason")))).alias("unavailable"), F.bool_and(gone).alias("none"), F.min_by("reason", "split").alias("reason")
    )
    shown = figures.join(F.broadcast(parts.where(gone).select("analysis", "split")), ["analysis", "split"], "left_anti").groupBy("analysis").agg(entries.alias("groups"))
    state = F.when(F.col("none"), "unavailable").otherwise("available")
    body = F.struct(state.alias("status"), F.when(F.col("none"), F.col("reason")).alias("reason"), F.when(~F.col("none"), F.col("groups")).alias("groups"), "unavailable")
    return lists.join(shown, "analysis", "left").select("analysis", F.to_json(body).alias("doc"))


def failed(issues: DataFrame) -> DataFrame:
    """(position, document) of inputs that gave no result: their code, and no analyses. Never stored."""
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("failed").alias("status"), F.struct("code").alias("error"))
    return issues.select("position", F.to_json(body).alias("document"))
