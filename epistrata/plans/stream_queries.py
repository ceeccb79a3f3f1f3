"""Queries of action and observation streams, batch and stateful, and of event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.plans.pipeline import AGGREGATES
from epistrata.plans.register import query, r
from epistrata.plans.views import EV, FR, frames, raw_frames, table, tasks, with_
from epistrata.runtime import Workspace
from epistrata.streaming import queues


def _streamed(spark: SparkSession, df: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Write df as stream input, run the built stream over it, and read what came out."""
    ws = Workspace(spark, "stream")
    src = ws.path("in")
    df.write.parquet(src)
    out = build(spark.readStream.schema(df.schema).parquet(src))
    path = ws.path("out")
    queues.run_to_table(out, path, ws.path("checkpoint"), mode)
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


#: Overlapping chunks of a whole episode: chunk c holds steps 10 c to 10 c + 29 and arrives when 10 c + 4 is executed (the first before any).
_ARRIVE = "ar as (select fr.*, c from fr, unnest(range(greatest(0, fi // 10 - 2), fi // 10 + 1)) t(c) where c = 0 or fi > 10 * c + 4)"
#: x after arrival c where a step is in at most three, by the weights' names w0 and w1.
_FOLD = "case row_number() over w when 1 then x when 2 then w0 * lag(x) over w + w1 * x else w0 * (w0 * lag(x, 2) over w + w1 * lag(x) over w) + w1 * x end"


def _arrivals(f: DataFrame) -> DataFrame:
    """Adds seq and latest: a row for every chunk that holds the frame."""
    last = F.floor(F.col("frame_index") / 10)
    out = f.withColumn("seq", F.explode(F.sequence(F.greatest(F.lit(0), last - 2), last)))
    return out.withColumn("latest", F.when(F.col("seq") == 0, F.lit(-1).cast("bigint")).otherwise(10 * F.col("seq") + 4)).withColumnsRenamed({"episode_index": "robot", "frame_index": "timestep"})


@query(with_(FR) + "select i as \"index\", t.task, round(greatest(0, least(2.0, fi / 30.0)), 4) as video_ts from fr left join tasks t on t.task_index = fr.task")
def stream_make_frame(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of frames joined with the static tasks."""
    f = frames(spark, sf, "frame_index", "task_index")
    ts = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("frame_index") / 30.0))
    t = tasks(spark, sf)
    return _streamed(spark, f, lambda s: s.join(t, ["task_index"], "left").select("index", "task", r(ts, 4).alias("video_ts")))


@query(with_(FR) + "select i as \"index\" from fr")
def stream_iter(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, frames(spark, sf).select("index"), lambda s: s)


@query(with_(FR) + "select i as \"index\", k, lag_x as back from (select i, ep, 5::bigint as k, lag(i, 5) over (partition by ep order by fi, i) as lag_x from fr)")
def stream_backtrack(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.operators.windows import by_frame

    return frames(spark, sf, "frame_index").select("index", F.lit(5).cast("bigint").alias("k"), F.lag("index", 5).over(by_frame()).alias("back"))


@query(with_(FR) + "select ep as episode_index, i as \"index\" from (select *, row_number() over (partition by ep order by i desc) as k from fr) where k <= 20")
def stream_online_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """The last 20 rows of each key over several batches of a stream."""
    ws = Workspace(spark, "online")
    src = ws.path("in")
    raw_frames(spark, sf).repartition(4).write.parquet(src)
    stream = spark.readStream.schema("index long, episode_index long").option("maxFilesPerTrigger", 1).parquet(src)
    buffer = queues.Retention(ws.path("buffer"), "episode_index", ["index"], 20)
    queues.run_to_table(stream, "", ws.path("checkpoint"), each=buffer.write_batch)
    return buffer.rows(spark).select("episode_index", "index")


@query(with_(FR) + "select ep as episode_index, i % 16 as slot, max(i) as \"index\" from fr group by 1, 2")
def stream_replay_add(spark: SparkSession, sf: str) -> DataFrame:
    """The ring buffer of each key as streaming state: at most its capacity of rows a key."""
    f = raw_frames(spark, sf).withColumn("seq", F.col("index"))
    return _streamed(spark, f, lambda s: queues.ring_slots(s, "episode_index", "seq", 16).select("episode_index", "slot", "index"), "complete")


@query(with_(FR, _ARRIVE, "v as (select *, (case when c % 2 = 0 then action[1] else state[1] end)::double as x, 0.3 as w0, 0.7 as w1 from ar)") + f"select ep as robot, c as seq, fi as timestep, round({_FOLD}, 5) as x from v window w as (partition by ep, fi order by c)")
def stream_action_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Whole episodes as overlapping chunks, even ones of actions and odd ones of states: the queue after every arrival."""
    a = _arrivals(frames(spark, sf, "frame_index", "action", "state"))
    a = a.withColumn("action", F.when(F.col("seq") % 2 == 0, F.col("action")).otherwise(F.col("state")))
    out = queues.merge_arrivals(a, AGGREGATES["weighted_average"])
    return out.select("robot", "seq", "timestep", r(F.get("action", F.lit(0))).alias("x"))


@query(with_(FR) + "select name, ep as robot, fi as timestep, round(case when action is null then state[1]::double else w0 * action[1]::double + w1 * state[1]::double end, 5) as x from fr, (values ('weighted_average', 0.3, 0.7), ('latest_only', 0.0, 1.0), ('average', 0.5, 0.5), ('conservative', 0.7, 0.3)) t(name, w0, w1)")
def udf_agg_fn(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame's action merged with its state by each of the named functions."""
    f = frames(spark, sf, "frame_index", "action", "state").withColumnsRenamed({"episode_index": "robot", "frame_index": "timestep"})
    latest = f.select("robot").distinct().withColumn("latest", F.lit(-1))
    out = None
    for name, w in AGGREGATES.items():
        merged = queues.merge_actions(f.select("robot", "timestep", "action"), f.select("robot", "timestep", F.col("state").alias("action")), latest, w)
        part = merged.select(F.lit(name).alias("name"), "robot", "timestep", r(F.get("action", F.lit(0))).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


@query(with_(FR, _ARRIVE, "v as (select *, state[1]::double * (case when c % 2 = 0 then 1 else 0.5 end) as x, 0.5 as w0, 0.5 as w1 from ar)") + f"select ep as robot, c as seq, fi as timestep, round({_FOLD}, 5) as x from v window w as (partition by ep, fi order by c)")
def stream_action_state(spark: SparkSession, sf: str) -> DataFrame:
    """Whole episodes as overlapping chunks; the stream stops after five arrivals of each robot and goes on from its state."""
    a = _arrivals(frames(spark, sf, "frame_index", "state")).withColumn("x", F.get("state", F.lit(0)).cast("double") * F.when(F.col("seq") % 2 == 0, 1.0).otherwise(0.5))
    steps = F.sort_array(F.collect_list(F.struct("timestep", "x")))
    chunks = a.groupBy("robot", "seq", "latest").agg(steps.alias("a")).select("robot", "seq", "latest", F.transform("a", lambda s: s["timestep"]).alias("timesteps"), F.transform("a", lambda s: F.array(s["x"])).alias("actions"))
    ws = Workspace(spark, "stream")
    chunks = ws.save(chunks, "chunks")
    src, path, checkpoint = ws.path("in"), ws.path("out"), ws.path("checkpoint")
    for part in ("seq < 5", "seq >= 5"):
        chunks.filter(part).write.mode("append").parquet(src)
        out = queues.merge_action_stream(spark.readStream.schema(chunks.schema).parquet(src), AGGREGATES["average"])
        queues.run_to_table(out, path, checkpoint)
    return spark.read.schema(out.schema).parquet(path).select("robot", "seq", "timestep", r(F.get("action", F.lit(0))).alias("x"))


@query(with_(FR, "c as (select ep, fi // 10 as seq, row_number() over (partition by ep order by fi, i) - 1 as p, action from fr)", "n as (select ep, seq, count(*) as n from c group by 1, 2)", "u as (select ep, sum(least(3, b)) as used from (select ep, lag(n, 1, 0) over (partition by ep order by seq) as b from n) group by 1)") + "select ep as robot, (p - used)::integer as pos, round(action[1]::double, 5) as x from c join u using (ep) where p >= used")
def stream_action_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Whole episodes as chunks of ten appended one after the other, with three actions (at most the last chunk) consumed in between."""
    from pyspark.sql.window import Window

    f = frames(spark, sf, "frame_index", "action").withColumn("seq", F.floor(F.col("frame_index") / 10))
    ch = f.groupBy(F.col("episode_index").alias("robot"), "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "index", "action"))), lambda s: s["action"]).alias("chunk"))
    before = F.lag(F.size("chunk"), 1, 0).over(Window.partitionBy("robot").orderBy("seq"))
    ch = ch.withColumn("consumed", F.least(F.lit(3), before)).withColumn("delay", F.lit(0))
    return queues.queue_after(ch, replace=False).select("robot", "pos", r(F.get("action", F.lit(0)).cast("double")).alias("x"))


@query(with_(FR) + "select ep as robot, k::bigint + 7 as timestep, round(10 + k * 0.05, 4) as timestamp, round(action[k + 1]::double, 5) as x from fr, (select unnest(range(0, 6)) as k) where fi = 0 and len(action) = 6")
def stream_time_chunk(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "action").filter((F.col("frame_index") == 0) & (F.size("action") == 6)).select(F.col("episode_index").alias("robot"), F.col("action").alias("chunk"), F.lit(10.0).alias("t0"), F.lit(7).cast("bigint").alias("i0"))
    return queues.timed_chunk(f, 0.05).select("robot", "timestep", r("timestamp", 4).alias("timestamp"), r(F.col("action").cast("double")).alias("x"))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "state").filter(F.size("state") == 6)
    return f.select(F.col("episode_index").alias("robot"), F.col("index").alias("seq"), F.col("frame_index").alias("timestep"), F.col("state").cast("array<double>").alias("state"), (F.col("frame_index") % 40 == 0).alias("must_go"))


@query()
def stream_obs_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return queues.dedup_observations(_observations(spark, sf), 0.5)


@query()
def stream_obs_dedup_state(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, _observations(spark, sf), lambda s: queues.dedup_observation_stream(s, 0.5))


@query(with_(FR) + "select ep as episode_index, max(i) as newest from fr group by ep")
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest row of each key, kept as streaming state."""
    f = raw_frames(spark, sf).withColumn("newest", F.col("index"))
    return _streamed(spark, f, lambda s: queues.latest_per(s, "episode_index", "index").select("episode_index", "newest"), "complete")


_CALL = "ca as (select event_type as m, user_id % 2 as arm, epoch_us(ts) / 1e6 as t, event_type <> 'error' or event_id % 2 = 0 as ok, value, event_id from events)"


@query(with_(_CALL) + "select event_id, count(*) over w as \"count\", count(case when ok then 1 end) over w as good, round(max(case when ok then value end) over w, 3) as max_latency_ms from ca window w as (partition by m, arm order by t range between 3600 preceding and current row)")
def stream_rate_window(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("m"), (F.col("user_id") % 2).alias("arm"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), ((F.col("event_type") != "error") | (F.col("event_id") % 2 == 0)).alias("ok"), "value", "event_id")
    return queues.rate_window(e, ["m", "arm"], "t", "ok", "value", 3600).select("event_id", "count", "good", "max_latency_ms")


@query(with_(FR) + "select i as \"index\", case when iv > 0.5 then true else false end as human from fr")
def stream_record_loop(spark: SparkSession, sf: str) -> DataFrame:
    """A toggle where an intervention begins and a release on its last frame label the frames as recorded."""
    from epistrata.operators.windows import by_frame

    f = frames(spark, sf, "frame_index", "intervention").withColumn("h", F.coalesce(F.col("intervention"), F.lit(0.0)) > 0.5)
    w = by_frame()
    begin, end = F.col("h") & ~F.coalesce(F.lag("h").over(w), F.lit(False)), F.col("h") & ~F.coalesce(F.lead("h").over(w), F.lit(False))
    ev = F.when(begin, "toggle").when(end, "release")
    one = begin & end
    f = f.withColumn("event", ev).withColumn("single", one)
    # an intervention of a single frame begins and ends at once: its toggle has no release, so its successor toggles back
    nxt = F.coalesce(F.lag("single").over(w), F.lit(False))
    fixed = f.withColumn("event", F.when(nxt & F.col("event").isNull(), "toggle").otherwise(F.col("event")))
    return queues.record_labels(fixed, "episode_index", ["frame_index", "index"]).select("index", F.col("is_intervention").alias("human"))


@query(with_(FR) + "select i as \"index\", k, coalesce(lag(fi, 3 - k::integer) over (partition by ep, k order by fi, i), first_value(fi) over (partition by ep, k order by fi, i)) as x from fr, (select unnest(range(0, 4)) as k)")
def stream_populate_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = queues.queue_window(frames(spark, sf, "frame_index"), "episode_index", ["frame_index", "index"], "frame_index", 4)
    return q.select("index", F.posexplode("queue").alias("k", "x")).withColumn("k", F.col("k").cast("bigint"))


@query(with_(EV, "c as (select *, epoch_us(ts) / 1e6 as t, lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts, fi) as p from ev)") + "select event_id, round(case when t - p > 0 then 1 / (t - p) else 0 end, 6) as rate from c")
def stream_monitor_tcp(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, sf, "events").withColumn("fi", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return queues.counter_rate(e, "user_id", "t", "fi").select("event_id", r("rate", 6).alias("rate"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling event-time windows over the whole table as one bounded stream."""
    out = _streamed(spark, _events(spark, sf), lambda s: queues.event_windows(s, "ts", "event_type", "value", "1 day", late="3650 days"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total", 3).alias("total"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return queues.sessions(e, "ts", "user_id", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")

