"""Exported lines are in files of a bounded size, however few tasks write them, so that no digest needs a sort."""

from tallyhouse.plans import registry, stored
from tallyhouse.sources import raw

SF = "/root/testdata/sf0.001"


def test_files_of_result_json_are_bounded(spark, monkeypatch):
    seen = []

    def of_file(spark, path, *_):
        seen.append(path)
        return spark.createDataFrame([("run-1", "{}")], "result_id string, document string")

    monkeypatch.setattr(stored.report, "of_file", of_file)
    monkeypatch.setattr(stored, "LINES_A_FILE", 100)
    registry.QUERIES["result_json"](spark, SF)
    lines = spark.read.text(seen[0]).selectExpr("value AS line", "_metadata.file_path AS file")
    sizes = [r["count"] for r in lines.groupBy("file").count().collect()]
    wanted = raw.booking_lines(spark, SF).select("line")
    assert max(sizes) <= 100 and sum(sizes) == wanted.count()
    assert lines.select("line").exceptAll(wanted).isEmpty()
