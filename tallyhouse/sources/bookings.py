"""Bookings: the field contract, and a table of bookings derived from an order table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a booking record and their kinds.
KINDS = {
    "booking_id": "identifier",
    "hotel": "text",
    "is_canceled": "boolean",
    "lead_time": "integer",
    "booking_date": "date",
    "arrival_date": "date",
    "stays_in_weekend_nights": "integer",
    "stays_in_week_nights": "integer",
    "adults": "integer",
    "children": "integer",
    "babies": "integer",
    "meal": "text",
    "country": "text",
    "market_segment": "text",
    "is_repeated_guest": "boolean",
    "previous_cancellations": "integer",
    "assigned_room_type": "text",
    "booking_changes": "integer",
    "deposit_type": "text",
    "agent": "identifier",
    "customer_type": "text",
    "price_per_night": "decimal",
    "required_car_parking_spaces": "integer",
    "total_of_special_requests": "integer",
}
FIELDS = sorted(KINDS)
TYPES = {"text": "string", "identifier": "string", "integer": "bigint", "boolean": "boolean", "date": "date", "decimal": "decimal(18,6)"}


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt evenly over as many tasks as a shuffle has.

    For narrow rows before costly work on each: a table of a few bytes a row has few files, row groups or shuffled
    partitions, and would leave that work to as few tasks.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def from_orders(spark: SparkSession, sf_dir: str, *keep: str, costly: bool = False) -> DataFrame:
    """One booking per order, with customer and nation attributes, and columns of the order to keep. Nulls, zeros, mismatches and repeated ids are part of the mapping. costly says that much work on each booking follows."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # an order without a customer or nation is a booking without their attributes
    joined = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if costly:
        joined = spread(joined.select(*dict.fromkeys(("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice", *keep)), "c_mktsegment", "n_name"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    gap = (k * 7 + (k % 13) * 11) % 260
    unless = lambda m, value: F.when(k % m != 0, value)
    one_in = lambda m: F.when(k % m == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") % 50000
    price = F.when(k % 67 == 0, None).when(k % 89 == 0, F.lit(0).cast("decimal(18,2)")).otherwise((cents.cast("decimal(18,2)") / 100).cast("decimal(18,2)"))
    return joined.select(
        *keep,
        F.when((k % 97 == 0) & (k > 0), k - 1).otherwise(k).cast("string").alias("booking_id"),
        unless(53, F.col("o_orderstatus") == "F").alias("is_canceled"),
        unless(43, gap + F.when(k % 17 == 0, 1).otherwise(0)).cast("bigint").alias("lead_time"),
        unless(41, day).alias("booking_date"),
        unless(47, F.date_add(day, gap.cast("int"))).alias("arrival_date"),
        unless(59, k % 3).cast("bigint").alias("stays_in_weekend_nights"),
        (F.floor(k / 3) % 6).cast("bigint").alias("stays_in_week_nights"),
        (1 + k % 3).cast("bigint").alias("adults"),
        unless(61, one_in(5)).alias("children"),
        one_in(11).alias("babies"),
        unless(23, F.array(*map(F.lit, ("BB", "HB", "FB", "SC")))[(k % 4).cast("int")]).alias("meal"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("market_segment"),
        F.col("o_orderpriority").alias("customer_type"),
        (k % 10 == 0).alias("is_repeated_guest"),
        one_in(7).alias("previous_cancellations"),
        F.char(65 + k % 8).alias("assigned_room_type"),
        F.array(*map(F.lit, ("No Deposit", "Non Refund", "Refundable")))[(k % 3).cast("int")].alias("deposit_type"),
        (k % 4).cast("bigint").alias("booking_changes"),
        (k % 5).cast("bigint").alias("total_of_special_requests"),
        one_in(6).alias("required_car_parking_spaces"),
        (k % 50).cast("string").alias("agent"),
        F.lit("H1").alias("hotel"),
        price.alias("price_per_night"),
    )


#: An invented calendar, as (month, day), and the years it has data for.
HOLIDAYS = ((1, 1), (1, 7), (4, 14), (4, 15), (4, 16), (5, 1), (9, 24), (11, 9))
CALENDAR_YEARS = range(1995, 2002)


def calendar(spark: SparkSession, holidays: tuple = HOLIDAYS, years: range = CALENDAR_YEARS) -> DataFrame:
    """(date, name): a calendar of the same days every year. Any table of this form serves: it is data, not code."""
    days = spark.range(years.start, years.stop).select(F.col("id").cast("int").alias("year"), F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in holidays])).alias("x"))
    return days.select(F.make_date("year", "x.m", "x.d").alias("date"), F.format_string("holiday %02d-%02d", "x.m", "x.d").alias("name"))
