"""Files of a field are counted, not estimated."""

from pyspark.sql import functions as F

from epistrata.operators import schema_drift as sd
from tests.test_schema_drift import FILES


def test_files_of_a_field_are_exact(spark):
    n = 5003
    ids = spark.range(n).select(F.col("id").alias("file_id"))
    files = ids.select("file_id", F.lit("r").alias("repo_id"), F.col("file_id").alias("file_index"), F.lit("p").alias("path"), F.lit(None).cast("timestamp").alias("written_at"), F.lit("{}").alias("info"), F.lit("x").alias("extra"), F.col("file_id").alias("record_id"))
    assert files.columns == [x.split()[0] for x in FILES.split(", ")]
    record = F.when(F.col("file_id") % 2 == 0, '{"a": 1, "b": "x"}').when(F.col("file_id") % 3 == 0, '{"a": 2.5}').otherwise('{"a": null}')
    recs = ids.select((F.col("file_id") * 2).alias("record_id"), "file_id", record.alias("record")).unionByName(ids.limit(100).select((F.col("file_id") * 2 + 1).alias("record_id"), "file_id", F.lit('{"a": 3}').alias("record")))
    changes = spark.createDataFrame([], sd.schema_changes(files.limit(1)).schema)
    got = {r.field: (r.files, r.kinds, r.renamed_in) for r in sd.unified_records(files, recs, changes).fields.collect()}
    assert got == {"a": (n, ["decimal", "null", "whole"], 0), "b": ((n + 1) // 2, ["text"], 0)}
