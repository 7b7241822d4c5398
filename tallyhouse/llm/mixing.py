"""Mixing sources to target weights by systematic sampling of documents.

Every source has a target in words; its documents have the same expected number of copies, target by size. Documents of
a source stand in a fixed order, their expected copies are summed up along it, one random offset is added, and a
document is emitted once for every whole number that its stretch of the sum crosses. The order is by blocks of a hash of
the id, and by size within a block, so that short and long documents are taken alike; a block is a few thousand
rows, so no task holds a source, and the sum at the start of a block follows from the number of rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import SPACE_CLASS, meet, staged
from tallyhouse.llm.fim import draws

#: A source's weight, by its place among the sources, over and over.
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with target and rate, the expected copies of each document.

    Sources by code point, null last, share so much of all sizes by their weights; a source takes at most so many times
    its own size, and what it leaves is shared by the others, by weight, until none has more. Windows are over sources,
    one row each.
    """
    whole = Window.partitionBy(F.lit(1))
    place = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1)).withColumn("limit", F.col("source_size") * F.lit(most))
    # sources reach their limits in the order of limit by weight; a source is at its limit if the level that the ones before it leave is as high
    rising = whole.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("limit", "weight")}
    rows = rows.withColumns({"all": F.sum("source_size").over(whole) * F.lit(share), "open": F.sum("weight").over(whole) - sums["weight"], "left": sums["limit"]})
    rows = rows.withColumn("left", F.col("all") - F.col("left")).withColumn("full", F.col("limit") * F.col("open") <= F.col("weight") * F.col("left"))
    level = F.first(F.when(~F.col("full"), F.col("left") / F.col("open")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight")))
    rate = F.when(F.col("full") & (F.col("source_size") > 0), F.lit(most)).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.withColumn("rate", rate).select(*sources.columns, "target", "rate")


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE_CLASS[1:-1]}]+")), F.lit(0)).cast("bigint")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 13, block_rows: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of docs; taken is copies times size, in words.

    The same table, seed and block_rows give the same copies. Null texts have size 0; rows without a source are a source
    of their own. Repeated rows stand side by side and are each taken or not. In a source without words nobody is taken.
    An empty table gives no rows. A source's taken words differ from its target by no more than a long document or so
    per block.
    """
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sized = staged(sized.withColumn("key", key).withColumn("draw", draws(seed, F.col("doc_id"), 1)[0]), "sizes")
    groups = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("copies"))
    planned = targets(groups, weights, share, most)
    offset = draws(seed, planned["source"], 1)[0] / F.lit(4294967296.0)
    blocks = F.ceil(F.col("copies") / F.lit(block_rows))
    planned = staged(planned.select("key", "source_size", "target", "rate", offset.alias("offset"), blocks.alias("blocks"), "copies"), "targets")
    placed = meet(sized, planned, "key", "inner").withColumn("block", F.pmod(F.col("draw"), F.col("blocks")))
    placed = staged(placed.drop("copies", "draw", "blocks"), "placed")
    per_block = placed.groupBy("key", "block").agg(F.count("*").alias("here"))
    before = per_block.select("key", "block", (F.sum("here").over(Window.partitionBy("key").orderBy("block")) - F.col("here")).alias("before"))
    in_block = Window.partitionBy("key", "block").orderBy("size", "doc_id")
    summed = placed.withColumn("place", F.row_number().over(in_block)).join(before, ["key", "block"]).withColumn("place", F.col("before") + F.col("place"))
    crossed = lambda place: F.floor(F.col("offset") + F.col("rate") * place)
    copies = (crossed(F.col("place")) - crossed(F.col("place") - 1)).cast("bigint")
    return summed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of mix() as often as they are taken, with copy, from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
