"""Places within groups, with a group of most rows and many ranges."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.places import placed


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_places(spark, parts):
    rows = [("hot", (i * 7919) % 900, i) for i in range(900)] + [(f"h{i % 40}", i % 5, i) for i in range(300)] + [(None, 1, 2), (None, 3, 4)]
    df = spark.createDataFrame(rows, "history_id string, time int, position int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = placed(df, "history_id", [F.desc("time"), F.desc("position")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for h in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == h), key=lambda r: (-r[1], -r[2])), 1):
            want[r] = place
    assert {(r.history_id, r.time, r.position): r.place for r in out} == want and len(out) == len(rows)


def test_no_rows(spark):
    assert placed(spark.createDataFrame([], "g int, o int"), "g", [F.col("o")]).count() == 0
