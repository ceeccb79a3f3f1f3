"""Queries of statistics, error metrics, rollups and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.operators import episodes as ops
from epistrata.operators import metrics, stats
from epistrata.plans.register import query, r
from epistrata.plans.views import EP, EV, FR, episodes, frames, table, with_
from epistrata.runtime import with_one_row

_V = "v as (select i, ep, 'state' as feature, d, state[d + 1]::double as x from fr, (select unnest(range(0, 6)) as d) where d < len(state) union all select i, ep, 'advantage', 0, adv from fr where adv is not null and not isnan(adv))"
_S = "min(x) as \"min\", max(x) as \"max\", round(avg(x), 4) as mean, round(stddev_pop(x), 4) as std, count(x) as \"count\""
_Q = "round(quantile_cont(x, 0.01), 4) as q01, round(quantile_cont(x, 0.1), 4) as q10, round(quantile_cont(x, 0.5), 4) as q50, round(quantile_cont(x, 0.9), 4) as q90, round(quantile_cont(x, 0.99), 4) as q99"
QS = ["q01", "q10", "q50", "q90", "q99"]


def _round(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def _dim(df: DataFrame) -> DataFrame:
    return df.withColumn("d", F.col("dim").cast("bigint")).drop("dim")


@query(with_(FR, _V) + f"select feature, d, {_S}, {_Q} from v group by feature, d")
def agg_feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.feature_stats(frames(spark, sf, "state", "advantage"), ["state", "advantage"])
    return _dim(_round(s, ["mean", "std", *QS]))


@query(with_(FR, _V) + f"select feature, d, {_Q} from v group by feature, d")
def agg_exact_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.feature_stats(frames(spark, sf, "state", "advantage"), ["state", "advantage"])
    return _dim(_round(s.drop("min", "max", "mean", "std", "count"), QS))


@query(with_(FR, _V) + f"select ep as episode_index, feature, d, {_S}, {_Q} from v group by ep, feature, d")
def agg_episode_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.feature_stats(frames(spark, sf, "state", "advantage"), ["state", "advantage"], ["episode_index"])
    return _dim(_round(s, ["mean", "std", *QS]))


@query(with_(FR, _V) + f"select feature, d, {_S} from v group by feature, d")
def agg_merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Merged episode statistics against those of all frames: moments must agree."""
    s = stats.feature_stats(frames(spark, sf, "state", "advantage"), ["state", "advantage"], ["episode_index"])
    return _dim(_round(stats.merge_stats(s).drop(*QS), ["mean", "std"]))


@query(with_(FR, _V, f"e as (select ep, feature, d, count(x) as n, quantile_cont(x, 0.5) as m, quantile_cont(x, 0.99) as h from v group by ep, feature, d)") + "select feature, d, round(sum(n * m) / sum(n), 4) as q50, round(sum(n * h) / sum(n), 4) as q99 from e group by feature, d")
def agg_quantile_augment(spark: SparkSession, sf: str) -> DataFrame:
    """Merged quantiles are weighted means of the episodes'."""
    s = stats.feature_stats(frames(spark, sf, "state", "advantage"), ["state", "advantage"], ["episode_index"])
    return _dim(_round(stats.merge_stats(s), ["q50", "q99"])).select("feature", "d", "q50", "q99")


@query(with_(FR, _V, "e as (select feature, d, min(x) - 1e-10 as lo, max(x) - min(x) + 2e-10 as w, count(*) as n from v group by feature, d)", "h as (select v.feature, v.d, least(floor((x - lo) / (w / 5000)), 4999) as b, count(*) as c from v join e on e.feature = v.feature and e.d = v.d group by 1, 2, 3)", "u as (select *, sum(c) over (partition by feature, d order by b) as upto from h)", "q as (select u.feature, u.d, min_by(struct_pack(b := b, c := c, upto := upto), b) as s from u join e on e.feature = u.feature and e.d = u.d where upto >= 0.5 * n group by 1, 2)") + "select q.feature, q.d, round(lo + w * (s.b + (0.5 * n - (s.upto - s.c)) / s.c) / 5000, 3) as q50 from q join e on e.feature = q.feature and e.d = q.d")
def agg_running_quantile(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.sketched_stats(frames(spark, sf, "state", "advantage"), ["state", "advantage"])
    return _dim(_round(s, ["q50"], 3)).select("feature", "d", "q50")


@query("select 'x' as feature, round(x, 4) as q50 from (select max(value) as x from events)")
def agg_basic_stats(spark: SparkSession, sf: str) -> DataFrame:
    """One value: its quantiles are its mean."""
    one = table(spark, sf, "events").agg(F.max("value").alias("x"))
    return stats.feature_stats(one, ["x"]).select("feature", r("q50", 4).alias("q50"))


@query(with_(FR, _V) + "select 0::bigint as invalid, count(*) as checked from (select distinct ep, feature, d from v)")
def agg_validate_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.feature_stats(frames(spark, sf, "state", "advantage"), ["state", "advantage"], ["episode_index"])
    return with_one_row(stats.invalid_stats(s).agg(F.count(F.lit(1)).alias("invalid")), s.agg(F.count(F.lit(1)).alias("checked")))


@query("select 'value' as feature, 0::bigint as d, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std from events union all select 'o_totalprice', 0, round(avg(o_totalprice), 3), round(stddev_pop(o_totalprice), 3) from orders")
def agg_numeric_stats(spark: SparkSession, sf: str) -> DataFrame:
    a = stats.feature_stats(table(spark, sf, "events"), ["value"], exact=False)
    b = stats.feature_stats(table(spark, sf, "orders"), ["o_totalprice"], exact=False)
    cut = lambda d, k: _dim(_round(d, ["mean", "std"], k)).select("feature", "d", "mean", "std")
    return cut(a, 4).unionByName(cut(b, 3))


@query(with_(FR, _V) + "select feature, round(avg(x), 4) as mean from v where feature = 'advantage' group by feature union all select 'camera', 0.5")
def join_image_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.feature_stats(frames(spark, sf, "advantage"), ["advantage"]).select("feature", "mean")
    old = spark.createDataFrame([("advantage", 9.0), ("camera", 0.5)], "feature string, mean double")
    return stats.stats_override(s, old).select("feature", r("mean", 4).alias("mean"))


@query("select min(value) as low, max(value) as high, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std from events")
def agg_pred_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.agg(F.min("value").alias("low"), F.max("value").alias("high"), r(F.avg("value"), 4).alias("mean"), r(F.stddev_pop("value"), 4).alias("std"))


# --- reports ---

_REP = (
    "fi_ as (select ep, count(*) as n, count(case when coalesce(iv, 0) > 0 then 1 end) as k from fr group by ep)",
    "a as (select count(*) as episodes, count(case when label = 'success' then 1 end) as success, count(case when label = 'failure' then 1 end) as failure, count(case when coalesce(label, '') not in ('success', 'failure') then 1 end) as unlabeled, avg(length / fps) as mean_s, min(length / fps) as min_s, max(length / fps) as max_s, count(distinct tasks[1]) as tasks from eps)",
    "b as (select sum(n)::bigint as frames, sum(k)::bigint as intervention_frames, count(case when k > 0 then 1 end) as intervention_episodes from fi_)",
)


@query(with_(FR, EP, *_REP) + "select episodes, success, failure, unlabeled, round(mean_s, 4) as mean_s, round(min_s, 4) as min_s, round(max_s, 4) as max_s, tasks, frames, intervention_frames, intervention_episodes, round(success / episodes, 4) as success_ratio, round(success / (success + failure), 4) as labeled_success_ratio, round(intervention_frames / frames, 4) as intervention_ratio, round(intervention_episodes / episodes, 4) as intervention_episode_ratio from a, b")
def agg_report(spark: SparkSession, sf: str) -> DataFrame:
    rep = metrics.dataset_report(frames(spark, sf, "intervention"), episodes(spark, sf))
    return _round(rep, ["mean_s", "min_s", "max_s", "success_ratio", "labeled_success_ratio", "intervention_ratio", "intervention_episode_ratio"])


@query(with_(EP, "m as (select min(length)::double as lo, max(length)::double as hi from eps)", "h as (select least(floor((length - lo) / ((hi - lo) / 20)), 19)::integer as bin, count(*) as n from eps, m group by 1)") + "select b::integer as bin, round(lo + b * (hi - lo) / 20, 4) as low, coalesce(n, 0) as n from m cross join (select unnest(range(0, 20)) as b) k left join h on h.bin = b")
def agg_len_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.length_histogram(episodes(spark, sf)).select("bin", r("low", 4).alias("low"), "n")


@query(with_(EP) + "select trim(t) as task, min(ep) as first_episode from (select ep, unnest(tasks) as t from eps) where trim(t) <> '' group by 1")
def agg_ordered_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ordered_tasks(episodes(spark, sf))


@query(with_(EP) + "select label as status, count(*) as n from eps group by label")
def agg_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.status_counts(episodes(spark, sf), "label")


@query(with_(EP) + "select repo_id, count(*) as total_episodes, sum(length)::bigint as total_frames, '0:' || count(*) as train from eps group by repo_id")
def agg_dataset_totals(spark: SparkSession, sf: str) -> DataFrame:
    return episodes(spark, sf).groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_episodes"), F.sum("length").cast("bigint").alias("total_frames")).withColumn("train", F.concat(F.lit("0:"), F.col("total_episodes").cast("string")))


@query(with_(FR, "g as (select ep, segment, a, least(b, m) as b from (select ep, max(fi) as m from fr group by ep) cross join (values ('reach', 0, 9), ('grasp', 15, 24), ('place', 25, 39)) t(segment, a, b) where a < least(b, m))", "t as (select ep, segment, b - a as d, sum(b - a) over (partition by ep) as tot from g)", "p as (select segment, avg(d / tot) as p from t group by segment)") + "select segment, round(p / sum(p) over (), 5) as share from p")
def agg_temporal_props(spark: SparkSession, sf: str) -> DataFrame:
    m = frames(spark, sf, "frame_index").groupBy("episode_index").agg(F.max("frame_index").alias("m"))
    seg = F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(a).alias("start"), F.least(F.lit(b), F.col("m")).alias("end")) for n, a, b in (("reach", 0, 9), ("grasp", 15, 24), ("place", 25, 39))]))
    s = m.select("episode_index", seg.alias("s")).select("episode_index", "s.*").filter("start < end")
    return metrics.temporal_shares(s).select("segment", r("share").alias("share"))


# --- errors ---

_ERR = "k as (select (abs(action[1]::double - state[1]::double) + abs(action[2]::double - state[2]::double)) / 2 as a, (power(action[1]::double - state[1]::double, 2) + power(action[2]::double - state[2]::double, 2)) / 2 as s, sqrt(power(state[1]::double, 2) + power(state[2]::double, 2)) as t from fr where len(action) = 6 and len(state) = 6)"
_ERR_OUT = "count(*) as frames, round(avg(a), 4) as mae, round(sqrt(avg(s)), 4) as rmse, round(avg(sqrt(2 * s)), 4) as l2_mean, round(quantile_cont(sqrt(2 * s), 0.5), 4) as l2_median, round(quantile_cont(sqrt(2 * s), 0.9), 4) as l2_p90"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf, "action", "state").filter((F.size("action") == 6) & (F.size("state") == 6))


@query(with_(FR, _ERR) + f"select {_ERR_OUT}, round(avg(t), 4) as target_l2, round(avg(sqrt(2 * s)) / (avg(t) + 1e-8), 4) as relative_l2 from k")
def agg_action_error(spark: SparkSession, sf: str) -> DataFrame:
    e = metrics.action_error(_pairs(spark, sf), "action", "state", [0, 1])
    return _round(e, ["mae", "rmse", "l2_mean", "l2_median", "l2_p90", "target_l2", "relative_l2"])


@query(with_(FR) + "select d::integer as dim, round(avg(abs(action[d + 1]::double - state[d + 1]::double)), 4) as mae, round(avg(action[d + 1]::double), 4) as pred_mean, round(avg(state[d + 1]::double), 4) as target_mean from fr, (select unnest(range(2, 5)) as d) where len(action) = 6 and len(state) = 6 group by d")
def agg_part_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.per_dim_error(_pairs(spark, sf), "action", "state", [2, 3, 4]), ["mae", "pred_mean", "target_mean"])


@query(with_(FR, "k as (select sqrt(power(action[1]::double, 2) + power(action[2]::double, 2) + power(action[3]::double, 2)) as a, sqrt(power(action[4]::double, 2) + power(action[5]::double, 2) + power(action[6]::double, 2)) as b from fr where len(action) = 6)") + "select round(avg(a), 4) as left_mean, round(quantile_cont(a, 0.9), 4) as left_p90, round(avg(b), 4) as right_mean, round(quantile_cont(b, 0.9), 4) as right_p90, round(avg((a > b)::integer), 4) as left_dominant, round(avg((b > a)::integer), 4) as right_dominant, round(avg((a > 0.5)::integer), 4) as left_active, round(avg((b > 0.5)::integer), 4) as right_active from k")
def agg_arm_usage(spark: SparkSession, sf: str) -> DataFrame:
    u = metrics.arm_usage(frames(spark, sf, "action").filter(F.size("action") == 6), [0, 1, 2], [3, 4, 5], 0.5).drop("wrong_over_correct")
    return _round(u, u.columns)


_ROLL = (
    EV,
    "d as (select user_id, min(case when event_type = 'purchase' then fi end) as fd from ev group by user_id)",
    "o as (select ev.user_id, sum(value) as sum_reward, max(value) as max_reward, bool_or(event_type = 'purchase') as success from ev join d on d.user_id = ev.user_id where fd is null or fi <= fd group by ev.user_id)",
)


def _rollouts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select(F.col("user_id").alias("episode_index"), (F.row_number().over(w) - 1).alias("frame_index"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("success"))
    return metrics.rollout_summary(e.withColumn("done", F.col("success")))


@query(with_(*_ROLL) + "select user_id as episode_index, round(sum_reward, 4) as sum_reward, round(max_reward, 4) as max_reward, success from o")
def agg_episode_rollout(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_rollouts(spark, sf), ["sum_reward", "max_reward"])


@query(with_(*_ROLL, "g as (select user_id % 3 as grp, user_id % 5 as tsk, * from o)") + "select grp, tsk, count(*) as episodes, round(avg(sum_reward), 3) as avg_sum_reward, round(avg(max_reward), 3) as avg_max_reward, round(avg(success::integer) * 100, 3) as pc_success from g group by grouping sets ((grp, tsk), (grp), ())")
def agg_eval_rollups(spark: SparkSession, sf: str) -> DataFrame:
    o = _rollouts(spark, sf).withColumn("g", F.col("episode_index") % 3).withColumn("t", F.col("episode_index") % 5)
    out = metrics.eval_rollups(o, "g", "t").drop("level")
    return _round(out, ["avg_sum_reward", "avg_max_reward", "pc_success"], 3)


_LAT = "lt as (select sensor_key as k, timestamp as t, abs(reading) as ms, sample_id from (select distinct sample_id, sensor_key, timestamp, reading from sensor_samples) where timestamp is not null and reading is not null and not isnan(reading))"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sensor_samples").drop("ingested_at", "episode_index").distinct()
    return s.filter("timestamp is not null and reading is not null and not isnan(reading)").select(F.col("sensor_key").alias("k"), F.col("timestamp").alias("t"), F.abs("reading").alias("ms"), "sample_id")


@query(with_(_LAT, "g as (select *, t - lag(t) over (partition by k order by t, ms) as gap from lt)") + "select k, count(*) as calls, round((count(*) - 1) / (max(t) - min(t)), 3) as hz, round(avg(ms), 4) as mean, round(quantile_cont(ms, 0.5), 4) as p50, round(quantile_cont(ms, 0.95), 4) as p95, max(ms) as \"max\", round(avg(gap), 5) as gap_mean from g group by k")
def agg_latency(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.latency_summary(_samples(spark, sf), "k", "t", "ms")
    return s.select("k", "calls", r("hz", 3).alias("hz"), r("mean", 4).alias("mean"), r("p50", 4).alias("p50"), r("p95", 4).alias("p95"), "max", r("gap_mean").alias("gap_mean"))


@query(with_(_LAT) + "select sample_id, round(quantile_cont(ms, 0.95) over (partition by k order by t, sample_id rows between 99 preceding and current row), 4) as p, max(ms) over (partition by k order by t, sample_id) as peak from lt")
def agg_latency_tracker(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.latency_tracker(_samples(spark, sf), "k", ["t", "sample_id"], "ms")
    return s.select("sample_id", r("p", 4).alias("p"), "peak")


@query(with_(FR) + "select ep as episode_index, round(case when max(ts) - min(ts) > 1e-6 then (count(ts) - 1) / (max(ts) - min(ts)) else 0 end, 3) as fps from fr where ts is not null group by ep")
def agg_fps(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "timestamp").filter("timestamp is not null")
    span = F.max("timestamp") - F.min("timestamp")
    return f.groupBy("episode_index").agg(r(F.when(span > 1e-6, (F.count("timestamp") - 1) / F.when(span > 1e-6, span)).otherwise(0.0), 3).alias("fps"))


@query("select event_id, round(sum(value) over w, 3) as total, round(avg(value) over w, 9) as running_mean from events window w as (partition by user_id order by ts, event_id)")
def agg_timer(spark: SparkSession, sf: str) -> DataFrame:
    t = metrics.running_timer(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return t.select("event_id", r("total", 3).alias("total"), r("running_mean", 9).alias("running_mean"))


@query(with_(FR) + "select d::integer as dim, round(min(state[d + 1]::double), 4) as low, round(max(state[d + 1]::double), 4) as high from fr, (select unnest(range(0, 6)) as d) where ts >= 0.5 and len(state) = 6 group by d")
def agg_joint_limits(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.joint_limits(frames(spark, sf, "timestamp", "state").filter(F.size("state") == 6), "state", 6, 0.5)


@query("select round(avg(n), 4) as mean, round(quantile_cont(n, 0.99), 4) as p99, min(n) as least, max(n) as most, round(60.0 / avg(n), 4) as ratio from (select len(string_split(task, ' ')) as n from tasks)")
def agg_compression(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tasks").select(F.size(F.split("task", " ")).cast("bigint").alias("n"))
    return _round(metrics.compression(t, "n", 60), ["mean", "p99", "ratio"])


@query("select round(avg(m), 4) as mse, count(*) as n from (select vec_id, avg(power(a - b, 2)) as m from (select vec_id, unnest(embedding)::double as a, unnest(list_reverse(embedding))::double as b from embeddings) group by vec_id)")
def agg_video_ratio(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("other", F.reverse("embedding"))
    return metrics.image_error(e, "embedding", "other", 1.0).agg(r(F.avg("mse"), 4).alias("mse"), F.count(F.lit(1)).alias("n"))


@query("select user_id::varchar as job, round(avg(case when u <= 10 then value end), 4) as first, round(avg(case when d <= 10 then value end), 4) as last, round(min(case when d <= 20 then value end), 4) as least_recent from (select *, row_number() over (partition by user_id order by fi, value) as u, row_number() over (partition by user_id order by fi desc, value desc) as d from (" + "select user_id, round(value, 4) as value, row_number() over (partition by user_id order by ts, event_id) as fi from events" + ")) group by user_id")
def agg_loss_progress(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("fi", F.row_number().over(w))
    lines = e.select(F.format_string("INFO job=%s step:%d lr:1e-4 loss:%s", F.col("user_id").cast("string"), F.col("fi"), F.round("value", 4).cast("string")).alias("line"))
    out = metrics.loss_progress(metrics.log_losses(lines))
    return _round(out.drop("stop"), ["first", "last", "least_recent"])


@query("select * from (values (0, 0), (0, 1), (1, 2), (2, 3), (2, 4), (3, 5)) t(batch, item)")
def agg_frame_size_est(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy packing by sizes; it depends on order, so it is a fold over the file list."""
    packed = ops.greedy_batches([40.0, 50.0, 300.0, 10.0, 20.0, 90.0], 100.0, 2)
    return spark.createDataFrame([(b, i) for b, items in enumerate(packed) for i in items], "batch int, item int")


@query(with_(FR, "e as (select ep, count(*) as n, avg(case when iv > 0.5 then 1.0 else 0.0 end) as s from fr group by ep)") + "select round(avg(s), 5) as mean_share, count(*) as episodes from e")
def agg_intervention_share(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "intervention").groupBy("episode_index").agg(F.avg(F.when(F.col("intervention") > 0.5, 1.0).otherwise(0.0)).alias("s"))
    return f.agg(r(F.avg("s")).alias("mean_share"), F.count(F.lit(1)).alias("episodes"))


