"""Raw records and stored lines derived from an order table, in the forms that the readers meet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.bookings import FIELDS, from_orders, spread

#: One JSON line per order key k, as an expression that both engines read: good cells, bad cells, lines that are no records.
JSON_LINE = """
CASE WHEN k % 101 = 0 THEN 'not json' WHEN k % 103 = 0 THEN '[1,2]' WHEN k % 107 = 0 THEN '   ' ELSE
'{"booking_id":' || cast(k as string)
|| CASE k % 10 WHEN 0 THEN ',"lead_time":"12"' WHEN 1 THEN ',"lead_time":3.5' WHEN 2 THEN ',"lead_time":true' WHEN 3 THEN ',"lead_time":-1' WHEN 4 THEN ',"lead_time":null'
   WHEN 5 THEN '' WHEN 6 THEN ',"lead_time":""' WHEN 7 THEN ',"lead_time":2.0' ELSE ',"lead_time":' || cast(k % 300 as string) END
|| CASE k % 7 WHEN 0 THEN ',"arrival_date":"2022-13-01"' WHEN 1 THEN ',"arrival_date":"01-02-2022"' WHEN 2 THEN ',"arrival_date":5' WHEN 3 THEN ',"arrival_date":"2021-02-30"'
   WHEN 4 THEN ',"arrival_date":"   "' ELSE ',"arrival_date":"2021-0' || cast(1 + k % 9 as string) || '-1' || cast(k % 10 as string) || '"' END
|| CASE k % 8 WHEN 0 THEN ',"is_canceled":2' WHEN 1 THEN ',"is_canceled":"true"' WHEN 2 THEN ',"is_canceled":1' WHEN 3 THEN ',"is_canceled":0' WHEN 4 THEN ',"is_canceled":true'
   WHEN 5 THEN ',"is_canceled":1.0' WHEN 6 THEN ',"is_canceled":false' ELSE ',"is_canceled":null' END
|| CASE k % 9 WHEN 0 THEN ',"price_per_night":"19.0"' WHEN 1 THEN ',"price_per_night":-1' WHEN 2 THEN ',"price_per_night":0' WHEN 3 THEN ',"price_per_night":27.31'
   WHEN 4 THEN ',"price_per_night":true' WHEN 5 THEN ',"price_per_night":[1]' WHEN 6 THEN ',"price_per_night":1e2' ELSE ',"price_per_night":' || cast(k % 1000 as string) || '.5' END
|| CASE k % 5 WHEN 0 THEN ',"agent":17' WHEN 1 THEN ',"agent":"  x9 "' WHEN 2 THEN ',"agent":true' WHEN 3 THEN ',"agent":1.5' ELSE ',"agent":"a"' END
|| CASE k % 6 WHEN 0 THEN ',"meal":5' WHEN 1 THEN ',"meal":" BB "' WHEN 2 THEN ',"meal":""' WHEN 3 THEN ',"meal":null' ELSE ',"meal":"HB"' END
|| CASE WHEN k % 19 = 0 THEN ',"zz":1' ELSE '' END || CASE WHEN k % 23 = 0 THEN ',"zy":{"a":2}' ELSE '' END || '}' END
"""

#: One ;-separated line per order key.
CSV_LINE = """
cast(k as string) || ';' || CASE k % 5 WHEN 0 THEN '0' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'yes' WHEN 3 THEN '' ELSE '1' END
|| ';' || CASE k % 4 WHEN 0 THEN 'abc' WHEN 1 THEN '-3' ELSE cast(k % 300 as string) END
|| ';' || CASE k % 3 WHEN 0 THEN '31-02-2021' WHEN 1 THEN '2022/01/01' ELSE '0' || cast(1 + k % 9 as string) || '-03-2021' END
|| ';' || CASE WHEN k % 7 = 0 THEN '' ELSE 'BB' END || ';' || CASE k % 6 WHEN 0 THEN '-5' WHEN 1 THEN 'x' ELSE cast(k % 500 as string) || '.25' END || ';x'
"""
CSV_HEADER = "booking_id;is_canceled;lead_time;booking_date;meal;price_per_night;extra"

#: One stored line per order; the customer is the history.
HISTORY_LINE = """
CASE WHEN k % 7 = 0 THEN 'garbage' WHEN k % 11 = 0 THEN '{"schema_version":' WHEN k % 13 = 0 THEN '   ' WHEN k % 17 = 0 THEN '[1,2]' WHEN k % 19 = 0 THEN '{"schema_version":"1.0","result_id":"x"}'
ELSE '{"schema_version":"' || CASE WHEN k % 6 = 0 THEN '2.0' ELSE '1.1' END || '","result_id":"r' || cast(k as string) || '","generated_at":"'
|| CASE WHEN k % 23 = 0 THEN 'unreadable' ELSE '20' || cast(10 + k % 13 as string) || '-0' || cast(1 + k % 9 as string) || '-1' || cast(k % 10 as string) || 'T10:00:00Z' END
|| '","status":"' || CASE k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'completed_with_warnings' ELSE 'failed' END || '","input":{},"data_quality":{},"analyses":{},"notices":[]}' END
"""

#: One generated answer per customer with orders: n orders of which c were cancelled; t = customer key % 16 picks its fault.
ANSWER = """
CASE t WHEN 1 THEN 'not json at all' WHEN 8 THEN '```json' || chr(10) ELSE '' END || CASE WHEN t = 1 THEN '' ELSE
'{"executive_summary":"' || CASE t WHEN 2 THEN 'Cancellations rose because of price.' WHEN 3 THEN 'Revenue is  guaranteed here.' WHEN 9 THEN repeat('long ', 130) WHEN 13 THEN '  ' ELSE ' Shares are observed only. ' END
|| '","improvement_suggestions":' || CASE t WHEN 10 THEN '[]' WHEN 14 THEN '"none"' ELSE
'[{"suggestion":"' || CASE t WHEN 7 THEN 'Do it now.' WHEN 12 THEN 'You could ensure   deposits.' ELSE 'Consider testing deposits; it Might help.' END
|| '","evidence":"' || CASE t WHEN 4 THEN 'A share of 0.123457% was seen in a small sample.' WHEN 15 THEN 'Worth EUR 1,234.50 of a small sample.' WHEN 6 THEN 'It is ' || cast(c as string) || ' of ' || cast(n as string) || '.' WHEN 0 THEN cast(n as string) || ' percent, a Small Sample.' ELSE cast(c as string) || ' of ' || cast(n as string) || ', a small sample.' END
|| '","sample_size":' || CASE t WHEN 5 THEN cast(n + 1000 as string) WHEN 11 THEN '"' || cast(n as string) || '"' ELSE cast(n as string) END || '}]' END || '}' END
|| CASE WHEN t = 8 THEN chr(10) || '```' ELSE '' END
"""


#: What an answer is asked about, of the same n and c: counts below an object that is named like a count of days are no sample sizes.
FINDINGS = """
'{"analysis":"cancellations","findings":{"overall":{"group":"all","numerator":' || cast(c as string) || ',"denominator":' || cast(n as string) || ',"small_sample":true},"windows_days":[1,[3]],"median_days":61,"mean_days":2,'
|| '"holiday_days":{"day_kind":"holiday","group":{"numerator":' || cast(n + 1000 as string) || '}},"rate":' || CASE n % 2 WHEN 0 THEN '0.1234567' ELSE '0.123457' END
|| ',"total":"' || CASE c % 2 WHEN 0 THEN '1234.5' ELSE '1234.51' END || '","' || CASE t WHEN 3 THEN 'rise due to' ELSE 'note' END || '":"' || CASE t WHEN 5 THEN 'It DRIVES, because of it.' WHEN 6 THEN 'Overdrives apart' ELSE 'Shares are observed.' END
|| '"},"data_quality":{"record_count":' || cast(n + 7 as string) || '}}'
"""


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyhouse-')}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table_of(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.col("o_orderkey"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, line)."""
    return spread(_orders(spark, sf_dir).select("k")).select(F.col("k").alias("position"), F.expr(JSON_LINE).alias("line"))


def booking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, line): every booking of an order as a JSON object, with some cells of another type, some of no real date, and an extra name."""
    rows = from_orders(spark, sf_dir, "o_orderkey", costly=True)
    k = F.col("o_orderkey")
    bad = {"lead_time": (29, '"12"'), "arrival_date": (31, '"2022-13-01"')}
    own = {f: F.when(k % m == 0, F.parse_json(F.lit(x))).otherwise(F.col(f).cast("string" if f == "arrival_date" else "bigint").cast("variant")) for f, (m, x) in bad.items()}
    extra = F.when(k % 19 == 0, F.lit(1)).alias("zz")
    return rows.select(k.alias("position"), F.to_json(F.struct(*[own.get(f, F.col(f)).alias(f) for f in FIELDS], extra)).alias("line"))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(F.expr(CSV_LINE).alias("line"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(history_id, position, line)."""
    return _orders(spark, sf_dir).select(F.col("o_custkey").alias("history_id"), F.col("k").alias("position"), F.expr(HISTORY_LINE).alias("line"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, answer_text, findings_text): an answer about a customer's cancellations, and the findings that it was asked about."""
    found = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    rows = spread(found).withColumn("t", F.col("o_custkey") % 16)
    return rows.select(F.col("o_custkey").alias("answer_id"), F.expr(ANSWER).alias("answer_text"), F.expr(FINDINGS).alias("findings_text"))
