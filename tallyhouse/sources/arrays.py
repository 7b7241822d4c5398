"""The objects of one JSON array per file, found by byte ranges, so that a file may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.sources.raw import remove, scratch, table_of

_WHITE = r"[ \t\r\n]*"
_OBJECT_FIRST, _OBJECT_NEXT = rf"^{_WHITE}\[{_WHITE}\{{", rf"^{_WHITE},{_WHITE}\{{"
_EMPTY, _END = rf"^{_WHITE}\[{_WHITE}\]{_WHITE}$", rf"^{_WHITE}\]{_WHITE}$"
#: What stands before the first brace that is in no string.
_BEFORE_BRACE = r'(?s)^((?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+)'


def _turns(text: Column, inside: bool) -> tuple[Column, Column]:
    """(quotes, change of depth) of a piece that ends before a closing brace, by whether it begins inside a string; the brace counts."""
    clean = F.regexp_replace(text, r"(?s)\\.", "")
    quotes = F.length(clean) - F.length(F.translate(clean, '"', ""))
    bare = F.regexp_replace(F.concat(F.lit('"'), clean) if inside else clean, '"[^"]*("|$)', "")
    change = F.length(F.translate(bare, "]", "")) - F.length(F.translate(bare, "{[", ""))
    return quotes, (change - F.when((quotes % 2 == 1) == F.lit(inside), 1).otherwise(0)).cast("bigint")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, with its state within its byte range, once for each state that the range can begin in.

    Spark splits the file at closing braces by byte ranges. Whether a range begins inside a string, and how deep, is
    known only from the ranges before it; so run0, low0, ends0 assume that it begins outside, run1, low1, ends1 inside.
    low is the least depth behind a closing brace, where objects of the array end if any does; a range's last piece is
    left out of it, since it may be the file's last, behind which there is no brace.
    """
    read = spark.read.option("lineSep", "}").text(path)
    rows = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")
    )
    (quotes, out), (_, within) = _turns(F.col("text"), False), _turns(F.col("text"), True)
    rows = rows.select("*", quotes.cast("bigint").alias("quotes"), out.alias("d0"), within.alias("d1"))
    whole = Window.partitionBy("file", "block")
    in_order = whole.orderBy("at")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).withColumn("is_last", F.lead("at").over(in_order).isNull())
    even, ends_even = F.col("q") == 0, (F.col("q") + F.col("quotes")) % 2 == 0
    own = {0: F.when(even, F.col("d0")).otherwise(F.col("d1")), 1: F.when(even, F.col("d1")).otherwise(F.col("d0"))}
    rows = rows.select("*", *[own[k].alias(f"own{k}") for k in own]).drop("d0", "d1")
    rows = rows.select("*", *[F.sum(f"own{k}").over(in_order).alias(f"run{k}") for k in own], ends_even.alias("bare0"), (~ends_even).alias("bare1"))
    rows = rows.select("*", *[F.min(F.when(F.col(f"bare{k}") & ~F.col("is_last"), F.col(f"run{k}"))).over(whole).alias(f"low{k}") for k in own])
    rows = rows.select("*", *[F.coalesce(F.col(f"bare{k}") & ~F.col("is_last") & (F.col(f"run{k}") == F.col(f"low{k}")), F.lit(False)).alias(f"end{k}") for k in own])
    return rows.select("*", *[F.coalesce(F.sum(F.col(f"end{k}").cast("bigint")).over(before), F.lit(0)).alias(f"ends{k}") for k in own])


def _ranges(pieces: DataFrame) -> DataFrame:
    """One row per byte range: the state that it begins in, and the objects that end before it."""
    last = lambda c: F.max(F.when(F.col("is_last"), F.col(c)))
    per = pieces.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("flips"), *[e for k in (0, 1) for e in (last(f"run{k}").alias(f"run{k}"), last(f"bare{k}").alias(f"bare{k}"), F.max(f"low{k}").alias(f"low{k}"), F.sum(F.col(f"end{k}").cast("bigint")).alias(f"ends{k}"))]
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = per.select("*", F.coalesce(F.sum("flips").over(before) % 2, F.lit(0)).alias("inside"), F.lead("block").over(order).isNull().alias("ends_file"))
    real = {c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("run", "bare", "low", "ends")}
    rows = rows.select("file", "block", "inside", "ends_file", *[real[c].alias(f"r_{c}") for c in real])
    rows = rows.withColumn("depth", F.coalesce(F.sum("r_run").over(before), F.lit(0)))
    ends_whole = F.col("depth") + F.col("r_low") == 1
    closes = F.col("r_bare") & ~F.col("ends_file")
    found = F.when(ends_whole, F.col("r_ends")).otherwise(0) + F.when(closes & (F.col("depth") + F.col("r_run") == 1), 1).otherwise(0)
    broken = (F.coalesce(F.col("depth") + F.col("r_low"), F.lit(1)) < 1) | (closes & (F.col("depth") + F.col("r_run") < 1))
    rows = rows.select("file", "block", "inside", "ends_file", "depth", F.coalesce(ends_whole, F.lit(False)).alias("has_ends"), found.alias("_found"), broken.alias("broken"))
    return rows.withColumn("base", F.coalesce(F.sum("_found").over(before), F.lit(0))).drop("_found")


def _placed(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """pieces with the object that they belong to (position), whether they open or end one, and their depth."""
    rows = pieces.join(ranges, ["file", "block"])
    real = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    after = F.col("depth") + real("run")
    is_tail = F.col("is_last") & F.col("ends_file")
    ends = F.when(F.col("is_last"), ~is_tail & real("bare") & (after == 1)).otherwise(F.col("has_ends") & real("end"))
    position = F.col("base") + F.when(F.col("has_ends"), real("ends")).otherwise(0)
    begins = after - real("own")
    opens = ((F.col("inside") + F.col("q")) % 2 == 0) & ((begins == 1) | ((begins == 0) & (position == 0)))
    return rows.select("file", "size", "block", "at", "text", "broken", position.alias("position"), opens.alias("opens"), ends.alias("ends"), is_tail.alias("is_tail"), after.alias("after"), real("bare").alias("bare"))


def _is_json(text: Column) -> Column:
    """Whether text is one JSON value and nothing else; the parser does not look behind a value, but does between members."""
    return F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit(',"b":0}'))).isNotNull()


def _opening_fault(text: Column, position: Column, is_tail: Column) -> Column:
    """Why a piece that follows an object, or begins the array, neither opens an object nor ends the array; null if it does.

    Plain values are parsed. An array that holds objects is no object, whatever comes behind its first one.
    """
    first = position == 0
    fine = F.when(is_tail, ~first & text.rlike(_END)).otherwise(F.when(first, text.rlike(_OBJECT_FIRST)).otherwise(text.rlike(_OBJECT_NEXT)))
    gap = F.regexp_extract(text, _BEFORE_BRACE, 1)
    bare = F.regexp_replace(F.regexp_replace(gap, r"(?s)\\.", ""), '"[^"]*"', "")
    # arrays that are open where the brace stands are closed there
    open_ = F.greatest(F.length(F.translate(bare, "]", "")) - F.length(F.translate(bare, "[", "")), F.lit(0)) + F.when(first, 0).otherwise(1)
    part = F.when(is_tail, text).otherwise(F.concat(gap, F.lit("0"), F.repeat(F.lit("]"), open_)))
    array = F.concat(F.when(first, F.lit("")).otherwise(F.lit("[0")), part)
    plain = F.when(_is_json(array), "RECORD_NOT_OBJECT").otherwise("INPUT_INVALID_JSON")
    return F.when(~fine, F.when(is_tail & first & text.rlike(_EMPTY), "INPUT_EMPTY").otherwise(plain))


def _faults(rows: DataFrame) -> dict[str, int]:
    """How many files have each fault that shows before an object is put together."""
    place = F.struct("block", "at")
    text, tail = F.col("text"), F.col("is_tail")
    opening = F.when(F.col("opens"), _opening_fault(text, F.col("position"), tail))
    per = rows.groupBy("file").agg(
        F.min_by(F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1), place).alias("head"),
        F.bool_or(F.col("broken") | ~F.is_valid_utf8(text)).alias("broken"),
        F.max(F.when(tail & ~F.col("opens"), True)).alias("cut"),
        *[F.bool_or(F.coalesce(opening == c, F.lit(False))).alias(c) for c in ("INPUT_INVALID_JSON", "RECORD_NOT_OBJECT", "INPUT_EMPTY")],
        # the whole of another value: an object that its last brace or white space ends, or a plain value; left counts a brace behind the last piece
        F.max(F.when(tail & F.col("bare"), F.col("after"))).alias("left"),
        F.max(F.when(tail, F.trim(F.translate(text, "\t\r\n", "   ")) == "")).alias("blank_tail"),
        (F.sum(F.octet_length(text)) + F.count("*") == F.max("size")).alias("closed"),
        F.max(F.when(tail & (F.col("position") == 0), _is_json(text))).alias("plain"),
    )
    is_object = (F.col("head") == "{") & F.coalesce(F.when(F.col("closed"), F.col("left") == 0).otherwise((F.col("left") == -1) & F.col("blank_tail")), F.lit(False))
    other = F.when(is_object | (~F.col("head").isin("{", "") & F.coalesce("plain", F.lit(False))), "INPUT_NOT_ARRAY").otherwise("INPUT_INVALID_JSON")
    bad = F.col("broken") | F.coalesce("cut", F.lit(False)) & ~F.col("RECORD_NOT_OBJECT") | F.col("INPUT_INVALID_JSON")
    code = F.when(F.col("head") != "[", other).when(bad, "INPUT_INVALID_JSON").when(F.col("RECORD_NOT_OBJECT"), "RECORD_NOT_OBJECT").when(F.col("INPUT_EMPTY"), "INPUT_EMPTY").otherwise("none")
    return {r.code: r["count"] for r in per.select(code.alias("code")).groupBy("code").count().collect()}


def array_objects(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict[str, int]]:
    """((file, position, line) of the objects of the array in each file, {code: files or objects with that fault}).

    position counts from 0 in its file; line is the object's text as the file has it. With a fault other than an empty
    array the table may be None. Faults: INPUT_INVALID_JSON, INPUT_NOT_ARRAY, RECORD_NOT_OBJECT, INPUT_EMPTY. An object
    without an inner one is a piece of its own; pieces of others meet by (file, position), so one object is one value and
    a file is not. The text is shuffled once, by byte range.
    """
    root = scratch(spark, "array")
    stored = {}

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        stored[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")
        return stored[name]

    try:
        return _objects(table(_pieces(spark, path), "pieces"), table(_ranges(stored["pieces"]), "ranges"))
    finally:
        remove(spark, root)


def _objects(pieces: DataFrame, ranges: DataFrame) -> tuple[DataFrame | None, dict[str, int]]:
    """array_objects() of the pieces and ranges; the objects are a table of their own, which needs neither."""
    rows = _placed(pieces, ranges)
    faults = _faults(rows)
    if not faults:
        return None, {"INPUT_INVALID_JSON": 1}
    faults.pop("none", None)
    if set(faults) - {"INPUT_EMPTY"}:
        return None, faults
    rows = rows.where(~F.col("is_tail"))
    whole = F.col("opens") & F.col("ends")
    alone = rows.where(whole).select("file", "position", F.concat("text", F.lit("}")).alias("text"))
    met = rows.where(~whole).groupBy("file", "position").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts"))
    met = met.select("file", "position", F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}")).alias("text"))
    line = F.regexp_replace("text", rf"^{_WHITE}[\[,]{_WHITE}", "")
    seen = Observation("array")
    found = alone.unionByName(met).select("file", F.col("position").cast("bigint").alias("position"), line.alias("line"))
    found = table_of(found.observe(seen, F.count_if(F.try_parse_json("line").isNull()).alias("bad")), "array-objects")
    return found, {**faults, **({"INPUT_INVALID_JSON": seen.get["bad"]} if seen.get["bad"] else {})}


def write_arrays(rows: DataFrame, by: str, path: str, order: str = "position", line: str = "line") -> None:
    """Write rows' objects as one JSON array file per value of by, in folders below path, in their order."""
    w = Window.partitionBy(by).orderBy(order)
    first, last = F.lag(F.lit(True)).over(w).isNull(), F.lead(F.lit(True)).over(w).isNull()
    text = F.concat(F.when(first, "[").otherwise(","), F.col(line), F.when(last, "]").otherwise(""))
    rows.select(by, order, text.alias("value")).sortWithinPartitions(by, order).select(by, "value").write.partitionBy(by).text(path)
