import json

from epistrata.runtime import Workspace
from epistrata.streaming import compaction as cp

SCHEMA = "file_id long, payload string, path string, record string, n_rows int"


def table(spark, rows):
    path = Workspace(spark, "small").path("in")
    spark.createDataFrame([(i, p, "p", "r", 1) for i, p in rows], SCHEMA).write.parquet(path)
    return path


def line(e, i, **more):
    return json.dumps({"episode_index": e, "index": i, **more})


def keys(df):
    return sorted((r.episode_index, r["index"]) for r in df.collect())


def test_lines():
    assert list(cp.parse_lines('﻿{"episode_index": 1.0, "index": "2e0"}\r\n\r\n{"episode_index":1,"index":3\n[1]\n{"episode_index":1,"index":3} x\n{"episode_index":1,"index":4.5}\n{"index":1}\n{"episode_index":true,"index":1}\r{"episode_index":9007199254740993,"index":9007199254740993.0}')) == [
        (0, 1, 2, '{"episode_index": 1.0, "index": "2e0"}'), (8, 9007199254740993, 9007199254740993, '{"episode_index":9007199254740993,"index":9007199254740993.0}'),
    ]
    assert cp.whole_number("NaN") is None and cp.whole_number(2**63) is None and cp.whole_number("1e400000") is None and cp.whole_number(-0.0) is None


def test_each_record_once(spark):
    path = table(spark, [(1, "\n".join([line(1, 1), line(1, 2), line(1, 1.0)])), (2, line(1, 2, x=5)), (3, ""), (4, None), (5, line(2, 1) + "\r\n" + line(2, 2)[:-3])])
    out = cp.compact_small_files(cp.payload_stream(spark, path))
    assert keys(out.records) == [(1, 1), (1, 2), (2, 1)] and keys(out.duplicates) == [(1, 1), (1, 2)]
    kept = {(r.episode_index, r["index"]): r.file_id for r in out.records.collect()}
    assert kept[1, 2] == 1


def test_no_input(spark):
    out = cp.compact_small_files(cp.payload_stream(spark, table(spark, [(1, None)])))
    assert keys(out.records) == [] and keys(out.duplicates) == []


def test_retries_replace_and_new_files_follow(spark):
    root = Workspace(spark, "compact").path("root")
    path = table(spark, [(k, line(k, 0)) for k in range(20)])
    c = cp.Compactor(spark, root)
    first = c.run(cp.payload_stream(spark, path))
    assert len(keys(first.records)) == 20
    batch = spark.read.parquet(path)
    c.write_batch(batch, 0)
    c.write_batch(batch, 0)  # the same batch again
    assert len(keys(c.result().records)) == 20 and keys(c.result().duplicates) == []
    spark.createDataFrame([(99, line(3, 0) + "\n" + line(77, 0), "p", "r", 1)], SCHEMA).write.mode("append").parquet(path)
    again = c.run(cp.payload_stream(spark, path))
    assert len(keys(again.records)) == 21 and keys(again.duplicates) == [(3, 0)]
    assert len(keys(c.run(cp.payload_stream(spark, path)).records)) == 21  # nothing new


def test_many_batches_give_what_one_gives(spark):
    path = Workspace(spark, "small").path("in")
    rows = [(k, "\n".join(line(k % 5, j) for j in range(k % 7)), "p", "r", 1) for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(path)
    one, many = (cp.compact_small_files(cp.payload_stream(spark, path, n)) for n in (100, 1))
    assert keys(one.records) == keys(many.records) and keys(one.duplicates) == keys(many.duplicates)


def test_a_huge_episode_fills_many_files(spark):
    path = table(spark, [(k, "\n".join(line(1, 100 * k + j) for j in range(100))) for k in range(20)])
    out = cp.compact_small_files(cp.payload_stream(spark, path), target_bytes=20_000)
    sizes = [r["count"] for r in out.records.groupBy("_metadata.file_name").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) > 3 and max(sizes) < 1000


def test_folder_of_jsonl(spark):
    src = Workspace(spark, "jsonl").path("in")
    spark.createDataFrame([(line(1, k),) for k in range(9)], "value string").repartition(9).write.text(src)
    assert keys(cp.compact_small_files(cp.jsonl_stream(spark, src)).records) == [(1, k) for k in range(9)]
