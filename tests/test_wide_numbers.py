"""Whole numbers that no bigint or double holds keep their digits."""

from epistrata.operators import schema_drift as sd
from tests.test_schema_drift import C, frame, info


def test_no_digit_is_lost(spark):
    files = frame(spark, [("r", 1, info({"a": C}))])
    recs = spark.createDataFrame([
        (1, 0, '{"big": 12345678901234567890, "text": "12345678901234567890", "mix": 9007199254740993, "ok": 9007199254740993, "list": [9007199254740993, 1.5]}'), (2, 0, '{"big": 1, "text": "7", "mix": 0.5, "ok": 1, "list": [1]}'),
    ], "record_id long, file_id long, record string")
    rows = {r["_record_id"]: r for r in sd.unified_records(files, recs).table.collect()}
    assert [rows[1][k] for k in ("big", "text", "mix", "ok", "list")] == ["12345678901234567890", "12345678901234567890", "9007199254740993", 9007199254740993, ["9007199254740993", "1.5"]]
    assert [rows[2][k] for k in ("big", "text", "mix", "ok", "list")] == ["1", "7", "0.5", 1, ["1"]]
