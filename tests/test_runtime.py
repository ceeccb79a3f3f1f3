from pyspark.sql import functions as F

from epistrata import runtime


def test_hot_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.range(0, 1000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    assert runtime.hot_parts(left, ["k"])
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, runtime.hot_join(left, right, ["k"], how).collect())) == want


def test_lookup_join_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(runtime, "LOOKUP_ROWS", 5)
    left, right = spark.range(100).withColumn("k", F.col("id") % 10), spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("y"))
    out = runtime.lookup_join(left, right, ["k"])
    assert out.count() == 100 and "BroadcastHint" not in out._jdf.queryExecution().logical().toString()


def test_workspace_reads_the_shared_folder(spark):
    ws = runtime.Workspace(spark, "t")
    df = ws.save(spark.range(3), "a")
    assert df.count() == 3 and ws.root.startswith(runtime.shared_dir(spark))
    path = ws._paths[id(df)]
    ws.drop(df)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_parts_follow_the_counts(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    df = spark.range(1100).select(F.when(F.col("id") < 1000, 1).otherwise(2 + F.col("id") % 100).alias("k"))
    assert list(runtime.hot_parts(df, ["k"]).values()) == [100]
    many = spark.range(2000).select((F.col("id") % 100).alias("k"))
    assert len(runtime.hot_parts(many, ["k"])) == 100 and set(runtime.hot_parts(many, ["k"]).values()) == {2}
    monkeypatch.setattr(runtime, "HOT_KEYS", 4)
    assert list(runtime.hot_parts(df, ["k"]).values()) == [4]


def test_dear_sides_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    left, right = spark.range(50).withColumn("k", F.col("id") % 5), spark.range(5).mapInArrow(count, "id long").select(F.col("id").alias("k"))
    assert runtime.lookup_join(left, right, ["k"]).count() == 50 and seen.value == 5


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master, applicationId = "spark://x:1", "a"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    import pytest

    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_dir(Session())


def test_close_deletes_all_tables(spark):
    ws = runtime.Workspace(spark, "t")
    ws.save(spark.range(3), "a")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ws.root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(p)
    ws.close()
    assert not fs.exists(p) and ws not in runtime._open
