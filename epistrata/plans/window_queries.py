"""Queries of sequence analytics inside an episode (advantages, weights, offsets, chunks, stages, rollouts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.functions import arrays
from epistrata.operators import advantage, joins, windows
from epistrata.plans.register import query, r
from epistrata.plans.views import EP, FR, episodes, frames, raw_frames, with_, tasks
from epistrata.runtime import Workspace

N = 10

# --- advantages: the value is -min(1, |second state dimension|) ---

_ACP = (
    FR,
    EP,
    "tm as (select tasks[1] as task1, max(length) as tmax from eps group by 1)",
    "info as (select ep, length, tmax, label = 'success' as ok from eps join tm on tasks[1] = task1)",
    "t0 as (select fr.i, fr.ep, fi, fr.task, iv, -least(1.0, abs(state[2]::double)) as v, greatest(-1.0, least(0.0, (-(length - fi - 1) - case when ok then 0 else tmax end) / (tmax * 2.0))) as g, fi - row_number() over (partition by fr.ep order by fi, fr.i) as run from fr join info on info.ep = fr.ep)",
    "t1 as (select *, g - coalesce(lead(g) over (partition by ep, run order by fi, i), 0) as rew from t0)",
    f"t2 as (select *, sum(rew) over (partition by ep, run order by fi, i rows between current row and {N - 1} following) + coalesce(lead(v, {N}) over (partition by ep, run order by fi, i), 0) - v as adv from t1)",
    "th as (select task, quantile_cont(adv, 0.7) as thr from t2 group by task)",
    "t3 as (select t2.*, case when coalesce(iv, 0) > 0.5 then 1 when round(adv, 9) >= round(thr, 9) then 1 else 0 end as ind from t2 left join th on th.task = t2.task)",
)


def _value() -> Column:
    return -F.least(F.lit(1.0), F.abs(arrays.at(F.col("state"), 1)))


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = episodes(spark, sf).withColumn("success", F.coalesce(F.col("label") == "success", F.lit(False)))
    f = raw_frames(spark, sf, "frame_index", "task_index", "state", "intervention").join(e.select("episode_index"), ["episode_index"], "left_semi")
    return f.withColumn("value", _value()).drop("state"), e


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    return advantage.advantages(*_inputs(spark, sf), N)


@query(with_(*_ACP) + "select i as \"index\", round(g, 6) as target from t0")
def acp_value_target(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf).select("index", r("target", 6).alias("target"))


@query(with_(*_ACP) + "select i as \"index\", round(rew, 6) as reward from t1")
def acp_dense_reward(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf).select("index", r("reward", 6).alias("reward"))


@query(with_(*_ACP) + "select i as \"index\", round(adv, 6) as advantage from t2")
def acp_n_step_advantage(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf).select("index", r("advantage", 6).alias("advantage"))


def _indicated(spark: SparkSession, sf: str) -> DataFrame:
    df = Workspace(spark, "annotate").save(_chain(spark, sf).withColumn("advantage", F.round("advantage", 9)), "advantages")
    return advantage.indicators(df, advantage.task_thresholds(df).withColumn("threshold", F.round("threshold", 9)))


@query(with_(*_ACP) + "select i as \"index\", ind as indicator from t3")
def acp_indicator(spark: SparkSession, sf: str) -> DataFrame:
    return _indicated(spark, sf).select("index", "indicator")


@query(with_(*_ACP) + "select task as task_index, round(thr, 6) as threshold from th")
def agg_task_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return advantage.task_thresholds(_chain(spark, sf)).select("task_index", r("threshold", 6).alias("threshold"))


@query(with_(*_ACP) + "select task1 as task, tmax as max_length from tm")
def agg_task_max_len(spark: SparkSession, sf: str) -> DataFrame:
    return advantage.task_max_length(episodes(spark, sf))


@query(with_(*_ACP) + "select count(*) as total, count(case when ind = 1 then 1 end) as positives, 0::bigint as invalid, round(avg(ind), 6) as ratio from t3")
def agg_indicator_stats(spark: SparkSession, sf: str) -> DataFrame:
    return advantage.indicator_summary(_indicated(spark, sf)).select("total", "positives", "invalid", r("ratio", 6).alias("ratio"))


@query(with_(*_ACP) + "select task as task_index, round(avg(ind), 6) as ratio from t3 group by task")
def agg_positive_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _indicated(spark, sf).groupBy("task_index").agg(r(F.avg("indicator"), 6).alias("ratio"))


@query(with_(*_ACP) + "select task as task_index, count(*) as frames, round(avg(g), 5) as mean_target, round(avg(adv), 5) as mean_advantage, sum(ind)::bigint as positives from t3 group by task")
def acp_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the whole chain, by task."""
    return _indicated(spark, sf).groupBy("task_index").agg(F.count(F.lit(1)).alias("frames"), r(F.avg("target")).alias("mean_target"), r(F.avg("advantage")).alias("mean_advantage"), F.sum("indicator").cast("bigint").alias("positives"))


# --- progress weights: progress is |first state dimension|, null on every frame of odd index tens ---

_P = "p as (select i, ep, case when (i // 10) % 2 = 0 or fi = 0 then abs(state[1]::double) end as p, max(i) over (partition by ep) as last from fr)"
_D = "d as (select a.i, a.ep, b.p - a.p as delta from p a left join p b on b.ep = a.ep and b.i = least(a.i + 15, a.last))"
_M = "m as (select greatest(avg(delta), 0) as mu, greatest(stddev_pop(delta), 1e-6) as sd from d where delta is not null)"
_W = "w as (select i, ep, case when delta is null then 1.0 when delta > 0.1 then 1.0 when delta >= 0 then greatest(0, least(1, (delta - (mu - 2 * sd)) / (4 * sd + 1e-6))) else 0.0 end as w from d, m)"


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "state")
    p = F.when((F.floor(F.col("index") / 10) % 2 == 0) | (F.col("frame_index") == 0), F.abs(arrays.at(F.col("state"), 0)))
    return advantage.progress_deltas(f.withColumn("progress", p), 15)


@query(with_(FR, _P, _D) + "select i as \"index\", round(delta, 6) as delta from d")
def rabc_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _progress(spark, sf).select("index", r("delta", 6).alias("delta"))


@query(with_(FR, _P, _D, _M) + "select round(mu, 6) as mean, round(sd, 6) as std from m")
def agg_global_moments(spark: SparkSession, sf: str) -> DataFrame:
    return advantage.delta_moments(_progress(spark, sf)).select(r("mean", 6).alias("mean"), r("std", 6).alias("std"))


@query(with_(FR, _P, _D, _M, _W) + "select i as \"index\", round(w, 5) as weight from w")
def rabc_weight(spark: SparkSession, sf: str) -> DataFrame:
    return advantage.progress_weights(_progress(spark, sf), 0.1).select("index", r("weight").alias("weight"))


@query(with_(FR, _P, _D, _M, _W) + "select i as \"index\", round(w * count(*) over (partition by i // 256) / (sum(w) over (partition by i // 256) + 1e-6), 5) as batch_weight from w")
def rabc_batch_norm(spark: SparkSession, sf: str) -> DataFrame:
    w = advantage.progress_weights(_progress(spark, sf), 0.1).withColumn("batch", F.floor(F.col("index") / 256))
    return advantage.batch_weights(w).select("index", r("batch_weight").alias("batch_weight"))


# --- offsets and chunks ---

_B = "b as (select *, row_number() over (partition by ep order by fi, i) as rn, count(*) over (partition by ep) as n from fr)"
_OFF = "o as (select unnest([-10, -1, 0, 3]) as d)"


@query(with_(EP) + "select distinct fps, d, d as offset_frames from eps, (select unnest(range(-10, 10)) as d) where fps > 0")
def seq_delta_gather(spark: SparkSession, sf: str) -> DataFrame:
    """Times on the grid of every rate in the dataset, as frame offsets."""
    rates = sorted(x["fps"] for x in episodes(spark, sf).filter("fps > 0").select("fps").distinct().collect())  # a few rates
    rows = [(f, d, n) for f in rates for d, n in zip(range(-10, 10), windows.delta_offsets([i / f for i in range(-10, 10)], f))]
    return spark.createDataFrame(rows, "fps bigint, d bigint, offset_frames bigint")


@query(with_(EP) + "select distinct fps, feature, k, round(o / fps, 8) as s from eps, (values ('action', 1, 0.0), ('action', 2, 1.0), ('observation.state', 1, -1.0), ('observation.state', 2, 0.0)) t(feature, k, o) where fps > 0")
def seq_resolve_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rates = sorted(x["fps"] for x in episodes(spark, sf).filter("fps > 0").select("fps").distinct().collect())  # a few rates
    rows = [(f, n, k + 1, round(float(t), 8)) for f in rates for n, ts in windows.resolve_deltas(["action", "observation.state", "timestamp"], [0, 1], [-1, 0], None, f).items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "fps bigint, feature string, k int, s double")


@query(with_(FR, _B, _OFF) + "select b.i as \"index\", d, round(c.ts, 5) as x, b.rn + d < 1 or b.rn + d > b.n as pad from b cross join o join b c on c.ep = b.ep and c.rn = greatest(1, least(b.n, b.rn + d))")
def join_delta_window(spark: SparkSession, sf: str) -> DataFrame:
    ds = [-10, -1, 0, 3]
    f = windows.in_stretches(frames(spark, sf, "frame_index", "timestamp"), 10, 3)
    w = windows.drop_halo(windows.offset_window(f, "timestamp", ds))
    z = w.select("index", F.posexplode(F.arrays_zip("timestamp_window", "timestamp_is_pad")).alias("k", "z"))
    d = F.element_at(F.array(*[F.lit(x) for x in ds]), F.col("k") + 1)
    return z.select("index", d.alias("d"), r("z.timestamp_window").alias("x"), F.col("z.timestamp_is_pad").alias("pad"))


@query(with_(FR, _B, _OFF) + "select b.i as \"index\", d, round(c.ts, 5) as x, b.rn + d < 1 or b.rn + d > b.n as pad from b cross join o join b c on c.ep = b.ep and c.rn = b.rn + case when b.rn + d between 1 and b.n then d when d < 0 and b.rn - 1 >= 1 then case when d < -1 then -1 else 0 end else 0 end")
def stream_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets -10 and -1 fail together: beyond reach, -10 repeats what -1 read."""
    ds = [-10, -1, 0, 3]
    w = windows.stream_offset_window(frames(spark, sf, "frame_index", "timestamp"), "timestamp", ds)
    z = w.select("index", F.posexplode(F.arrays_zip("timestamp_window", "timestamp_is_pad")).alias("k", "z"))
    d = F.element_at(F.array(*[F.lit(x) for x in ds]), F.col("k") + 1)
    return z.select("index", d.alias("d"), r("z.timestamp_window").alias("x"), F.col("z.timestamp_is_pad").alias("pad"))


@query(with_(FR, _B) + "select b.i as \"index\", k, round(c.action[1]::double, 5) as x from b cross join (select unnest(range(0, 4)) as k) kk join b c on c.ep = b.ep and c.rn = b.rn + k where b.rn + 3 <= b.n")
def seq_action_chunks(spark: SparkSession, sf: str) -> DataFrame:
    ch = windows.action_chunks(frames(spark, sf, "frame_index", "action"), 4)
    return ch.select("index", F.posexplode("chunk").alias("k", "a")).select("index", F.col("k").cast("bigint").alias("k"), r(arrays.at(F.col("a"), 0)).alias("x"))


@query(with_(FR) + "select i as \"index\", d, round(case when d < 3 then action[d + 1]::double - state[d + 1]::double else action[d + 1]::double end, 5) as x from fr, (select unnest(range(0, 6)) as d) where len(action) = 6 and len(state) = 6")
def seq_delta_transform(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "action", "state").filter((F.size("action") == 6) & (F.size("state") == 6))
    return f.select("index", F.posexplode(arrays.subtract_dims(F.col("action"), F.col("state"), range(3), 6)).alias("d", "x")).select("index", F.col("d").cast("bigint").alias("d"), r("x").alias("x"))


@query(with_(FR, _B) + "select b.i as \"index\", b.rn = b.n as done, round(c.state[1]::double, 5) as x from b join b c on c.ep = b.ep and c.rn = least(b.n, b.rn + 1)")
def seq_next_state(spark: SparkSession, sf: str) -> DataFrame:
    return windows.next_states(frames(spark, sf, "frame_index", "state")).select("index", "done", r(arrays.at(F.col("next_state"), 0)).alias("x"))


@query(with_(FR, _B) + "select b.i as \"index\", round(coalesce((b.state[1]::double - c.state[1]::double) / 0.04, 0), 4) as v from b left join b c on c.ep = b.ep and c.rn = b.rn - 1 where len(b.state) = 6")
def seq_joint_velocity(spark: SparkSession, sf: str) -> DataFrame:
    v = windows.joint_velocity(frames(spark, sf, "frame_index", "state"), 0.04, 6)
    return v.filter(F.size("state") == 6).select("index", r(arrays.at(F.col("state_v"), 6), 4).alias("v"))


ARMS = {"left": ((0, 1, 2, 3), (0, 1, 2, 3)), "right": ((2, 3, 4, 5), (2, 3, 4, 5))}


def _err(lag: str, cumulative: bool = False) -> str:
    arm = lambda name, k: f"select b.ep, b.fi, {lag} as lag, '{name}' as arm, " + ", ".join(f"c.state[{i}]::double - b.state[{i}]::double as m{i - k}, b.{'cmd' if cumulative else 'action'}[{i}]::double as a{i - k}" for i in range(k, k + 4)) + f" from {'bc' if cumulative else 'b'} b join b c on c.ep = b.ep and c.rn = b.rn + {lag}"
    return arm("left", 1) + " union all " + arm("right", 3)


_ERRS = "sqrt(m0*m0+m1*m1+m2*m2) as actual, sqrt(a0*a0+a1*a1+a2*a2) as command, sqrt((m0-a0)*(m0-a0)+(m1-a1)*(m1-a1)+(m2-a2)*(m2-a2)) as err, abs(m3-a3) as rot"


@query(with_(FR, _B, f"e as ({_err('1')})", f"k as (select ep, fi, arm, {_ERRS} from e)") + "select ep as episode_index, fi as frame_index, arm, round(command, 4) as command, round(actual, 4) as actual, round(err, 4) as err, round(rot, 4) as rot from k where command is not null and actual is not null")
def seq_tracking_error(spark: SparkSession, sf: str) -> DataFrame:
    t = windows.tracking_errors(frames(spark, sf, "frame_index", "state", "action"), [1], ARMS)
    return t.select("episode_index", "frame_index", "arm", r("command_norm_xyz", 4).alias("command"), r("actual_norm_xyz", 4).alias("actual"), r("error_norm_xyz", 4).alias("err"), r("error_norm_rot", 4).alias("rot"))


_SWEEP = "select arm, lag, count(*) as steps, round(avg(command), 4) as command_mean, round(avg(err), 4) as error_mean, round(quantile_cont(err, 0.5), 4) as error_median, round(quantile_cont(err, 0.95), 4) as error_p95 from k group by arm, lag"


@query(with_(FR, _B, f"e as ({_err('1')} union all {_err('2')} union all {_err('3')})", f"k as (select arm, lag, {_ERRS} from e)") + _SWEEP)
def agg_tracking_lag(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.tracking_sweep(frames(spark, sf, "frame_index", "state", "action"), [1, 2, 3], ARMS)
    return s.select("arm", "lag", "steps", r("command_mean", 4).alias("command_mean"), r("error_mean", 4).alias("error_mean"), r("error_median", 4).alias("error_median"), r("error_p95", 4).alias("error_p95"))


_CUM = lambda n: f"bc as (select *, [{', '.join(f'sum(action[{k}]::double) over (partition by ep order by fi, i rows between current row and {n - 1} following)' for k in range(1, 7))}] as cmd from b)"


@query(with_(FR, _B, _CUM(5), f"e as ({_err('5', True)})", f"k as (select arm, lag, {_ERRS} from e)") + _SWEEP)
def agg_tracking_window(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.tracking_sweep(frames(spark, sf, "frame_index", "state", "action"), [5], ARMS, cumulative=True)
    return s.select("arm", "lag", "steps", r("command_mean", 4).alias("command_mean"), r("error_mean", 4).alias("error_mean"), r("error_median", 4).alias("error_median"), r("error_p95", 4).alias("error_p95"))


# --- signals ---


def _open() -> Column:
    return arrays.at(F.col("state"), 5) > 0.5


@query()
def seq_debounce(spark: SparkSession, sf: str) -> DataFrame:
    return windows.debounce(frames(spark, sf, "frame_index", "state"), _open(), 3)


_EDGE = (
    _B,
    "s as (select ep, rn - 1 as pos, n, coalesce(state[6]::double > 0.5, false) as opened, lag(coalesce(state[6]::double > 0.5, false)) over (partition by ep order by fi, i) as prev from b)",
    "e as (select *, prev and not opened as cl, not prev and opened as re from s)",
    "fc as (select ep, min(case when cl then pos end) as first_close from e group by ep)",
    "cyc as (select e.ep, max(n) as length, count(case when cl then 1 end) as closes, count(case when re then 1 end) as releases, max(first_close) as first_close, min(case when re and pos > first_close then pos end) as first_release from e join fc on fc.ep = e.ep group by e.ep)",
)


@query(with_(FR, *_EDGE) + "select ep as episode_index, length, closes, releases, first_close, first_release, case when first_release is not null then least(length, first_release + 5) end as split from cyc")
def seq_transitions(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "state").withColumn("on", F.coalesce(_open(), F.lit(False)))
    return windows.first_cycle(f, 5)


@query(with_(FR, *_EDGE, "sp as (select ep, least(length, first_release + 5) as split from cyc where first_release is not null)") + "select b.ep as episode_index, (rn - 1 >= split)::integer as segment, i as \"index\", rn - 1 - case when rn - 1 >= split then split else 0 end as frame_index, round((rn - 1 - case when rn - 1 >= split then split else 0 end) / 30.0, 5) as timestamp from b join sp on sp.ep = b.ep")
def seq_segment_cut(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "state").withColumn("on", F.coalesce(_open(), F.lit(False)))
    return windows.cut_segments(f, windows.first_cycle(f, 5), 30.0).withColumn("timestamp", r("timestamp"))


# --- interpolation and stages ---


@query(with_(FR, "k as (select ep, fi, abs(state[1]::double) as p from fr where (i // 10) % 2 = 0)", "n as (select i, ep, fi, (select max(k.fi) from k where k.ep = fr.ep and k.fi <= fr.fi) as lo, (select min(k.fi) from k where k.ep = fr.ep and k.fi >= fr.fi) as hi from fr)") + "select n.i as \"index\", round(case when lo is null then b.p when hi is null or lo = hi then a.p else a.p + (b.p - a.p) * (n.fi - lo) / (hi - lo) end, 5) as x from n left join k a on a.ep = n.ep and a.fi = lo left join k b on b.ep = n.ep and b.fi = hi")
def seq_interp(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "state").withColumn("p", F.when(F.floor(F.col("index") / 10) % 2 == 0, F.abs(arrays.at(F.col("state"), 0))))
    return windows.interpolate(f, "p").select("index", r("p_filled").alias("x"))


@query(with_(FR) + "select i as \"index\", row_number() over (partition by ep order by fi % 5, fi, i) as pos from fr")
def seq_stride_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("episode_index").orderBy(F.col("frame_index") % 5, "frame_index", "index")
    return frames(spark, sf, "frame_index").select("index", F.row_number().over(w).cast("bigint").alias("pos"))


#: Segments of an episode: 0..9 "reach", 15..24 "grasp", 25..39 "place"; with a gap at 10..14.
_SEG = [("reach", 0, 9), ("grasp", 15, 24), ("place", 25, 39)]
_STAGE = "case when fi > 39 then 2.999 when fi <= 9 then 0 + fi / 9.0 when fi < 15 then 1.0 when fi <= 24 then 1 + (fi - 15) / 9.0 else case when fi = 39 then 2.999 else 2 + (fi - 25) / 14.0 end end"


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index")
    segs = f.select("episode_index").distinct().select("episode_index", F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in _SEG])).alias("s")).select("episode_index", "s.*")
    st = joins.stage_arrays(segs, ["reach", "grasp", "place"])
    near = f.join(st, ["episode_index"])
    return near.select("index", "episode_index", "frame_index", windows.stage_and_tau(F.col("frame_index"), F.lit(100), F.col("stages"), 3).alias("x"))


@query(with_(FR) + f"select i as \"index\", round({_STAGE}, 5) as x from fr")
def join_stage_interval(spark: SparkSession, sf: str) -> DataFrame:
    return _staged(spark, sf).select("index", r("x").alias("x"))


@query(with_(FR) + f"select i as \"index\", round({_STAGE} - floor({_STAGE}), 5) as tau from fr")
def seq_stage_tau(spark: SparkSession, sf: str) -> DataFrame:
    return _staged(spark, sf).select("index", r(F.col("x") - F.floor("x")).alias("tau"))


@query(with_(FR) + f"select i as \"index\", round(case when x < 1 then x * 0.2 when x < 2 then 0.2 + (x - 1) * 0.3 else 0.5 + (x - 2) * 0.5 end, 5) as x from (select i, {_STAGE} as x from fr)")
def seq_stage_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _staged(spark, sf).select("index", r(windows.normalized_stage(F.col("x"), windows.breakpoints([0.2, 0.3, 0.5]))).alias("x"))


@query(with_(FR) + f"select i as \"index\", round(case when x < 1 then x * 0.2 when x < 2 then 0.2 + (x - 1) * 0.3 else 0.5 + (x - 2) * 0.5 end, 5) as x, k, greatest(0, least(99, fi + (k - 2) * 5)) as frame from (select i, fi, {_STAGE} as x from fr), (select unnest(range(0, 5)) as k)")
def seq_batch_targets(spark: SparkSession, sf: str) -> DataFrame:
    s = _staged(spark, sf).withColumn("n", windows.normalized_stage(F.col("x"), windows.breakpoints([0.2, 0.3, 0.5])))
    idx, _ = windows.bidirectional_indices(F.col("frame_index"), F.lit(0), F.lit(100), 4, 5)
    return s.select("index", r("n").alias("x"), F.posexplode(idx).alias("k", "frame")).withColumn("k", F.col("k").cast("bigint"))


@query(with_(FR) + "select i as \"index\", k, greatest(0, least(99, fi + (k - 2) * 5)) as frame, (fi + (k - 2) * 5 <> greatest(0, least(99, fi + (k - 2) * 5)))::integer as outside from fr, (select unnest(range(0, 5)) as k)")
def seq_bidir_indices(spark: SparkSession, sf: str) -> DataFrame:
    idx, out = windows.bidirectional_indices(F.col("frame_index"), F.lit(0), F.lit(100), 4, 5)
    z = frames(spark, sf, "frame_index").select("index", F.posexplode(F.arrays_zip(idx.alias("a"), out.alias("b"))).alias("k", "z"))
    return z.select("index", F.col("k").cast("bigint").alias("k"), F.col("z.a").alias("frame"), F.col("z.b").alias("outside"))


@query(with_(FR) + "select i as \"index\", k::bigint as k, greatest(0, fi - 10 - k * 5) as frame from fr, (select unnest(range(1, 4)) as k) where k <= least(3, (fi - 10) // 5) and fi > 10")
def seq_rewind(spark: SparkSession, sf: str) -> DataFrame:
    rw = windows.rewind_indices(F.col("frame_index"), F.lit(0), 4, 3, 5, F.lit(3))
    return frames(spark, sf, "frame_index").select("index", F.posexplode(rw).alias("k", "frame")).select("index", (F.col("k") + 1).cast("bigint").alias("k"), "frame")


@query(with_(FR, _B) + "select i as \"index\" from b where rn > 2 and rn <= n - 3 and ep % 2 = 0")
def seq_sampler(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index").filter("episode_index % 2 = 0")
    return windows.trimmed_frames(f, 2, 3).select("index")


@query(with_(FR, _B) + "select i as \"index\" from b where rn > 2 and rn <= n - 3")
def seq_sampler_all(spark: SparkSession, sf: str) -> DataFrame:
    return windows.trimmed_frames(frames(spark, sf, "frame_index"), 2, 3).select("index")


@query(with_(FR, _B, "f as (select i, coalesce(iv, 0) > 0.5 as o, n - rn >= case when coalesce(iv, 0) > 0.5 then 0 else 4 end as keep from b)", "c as (select count(case when keep and o then 1 end) as a, count(case when keep and not o then 1 end) as z from f)") + "select i as \"index\", round(case when not keep then 0 when o then 0.3 / a else 0.7 / z end, 9) as weight from f, c")
def seq_sampler_weights(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "intervention")
    return windows.sampler_weights(f, F.coalesce(F.col("intervention"), F.lit(0.0)) > 0.5, 0.3, 4, 0).select("index", r("weight", 9).alias("weight"))


#: Weights of the cubic fit to seven values, by 42, at the first three places and in the middle.
_FIT7 = ((39, 8, -4, -4, 1, 4, -2), (8, 19, 16, 6, -4, -7, 4), (-4, 16, 19, 12, 2, -4, 1), (-4, 6, 12, 14, 12, 6, -4))
_FIT7_SQL = [" + ".join(f"{x} * lead(v, {j - k}) over w" for j, x in enumerate(row)) for k, row in enumerate(_FIT7)]
_FIT7_END = [" + ".join(f"{x} * lead(v, {k - j}) over w" for j, x in enumerate(row)) for k, row in enumerate(_FIT7)]


@query(with_(FR, "s as (select i, ep, fi, state[1]::double as v from fr where state[1] is not null)", "p as (select *, row_number() over w - 1 as p, count(*) over (partition by ep) - row_number() over w as q, count(*) over (partition by ep) as n, " + ", ".join(f"{a} as a{k}, {b} as b{k}" for k, (a, b) in enumerate(zip(_FIT7_SQL, _FIT7_END))) + " from s window w as (partition by ep order by fi, i))") + "select i as \"index\", ep as episode_index, round(case when n < 7 then v when p = 0 then a0 / 42 when p = 1 then a1 / 42 when p = 2 then a2 / 42 when q = 0 then b0 / 42 when q = 1 then b1 / 42 when q = 2 then b2 / 42 else a3 / 42 end, 4) as value from p")
def seq_value_smooth(spark: SparkSession, sf: str) -> DataFrame:
    f = windows.in_stretches(frames(spark, sf, "frame_index", "state").withColumn("v", arrays.at(F.col("state"), 0)).filter("v is not null"), 6, 6)
    whole = windows.drop_halo(windows.smoothed(f, "v", 7))
    return whole.select("episode_index", "index", r("value", 4).alias("value"))


@query(with_(FR, _B, "ch as (select b.ep, b.rn as made, b.rn + k as step, c.action[1]::double as x from b cross join (select unnest(range(0, 3)) as k) kk join b c on c.ep = b.ep and c.rn = b.rn + k where b.rn + 2 <= b.n)", "ag as (select ep, step, x, exp(-0.1 * (row_number() over (partition by ep, step order by made) - 1)) as w from ch)") + "select ep as episode_index, step, round(sum(x * w) / sum(w), 5) as value from ag group by ep, step")
def seq_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    f = frames(spark, sf, "frame_index", "action")
    w = Window.partitionBy("episode_index").orderBy("frame_index", "index")
    ch = windows.action_chunks(f, 3).drop("step")
    steps = f.select("index", F.row_number().over(w).cast("bigint").alias("step"))
    e = windows.ensemble(ch.join(steps, ["index"]), 0.1, 3).filter("dim = 0")
    return e.select("episode_index", "step", r("value").alias("value"))


@query("select task_index, k, round(case when k < s then 1 when k < e then x else 0 end, 6) as linear, case when k < s then 1.0 else 0.0 end as zeros, case when k < e then 1.0 else 0.0 end as ones, round(case when k < s then 1 when k < e then x * (exp(x) - 1) / (exp(1) - 1) else 0 end, 6) as expo from (select *, 1 - (k - s + 1) / (e - s + 1.0) as x from (select task_index, least(task_index % 5, 3 + task_index % 7) as s, 3 + task_index % 7 as e, k from tasks, (select unnest(range(0, 12)) as k)))")
def seq_prefix_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The schedules for a start and an end that differ by task."""
    rows = []
    for t in sorted(x["task_index"] for x in tasks(spark, sf).select("task_index").collect()):  # a few dozen
        cols = [windows.prefix_weights(t % 5, 3 + t % 7, 12, s) for s in ("linear", "zeros", "ones", "exp")]
        rows += [(t, k, *map(float, row)) for k, row in enumerate(zip(*cols))]
    out = spark.createDataFrame(rows, "task_index bigint, k bigint, linear double, zeros double, ones double, expo double")
    return out.select("task_index", "k", r("linear", 6).alias("linear"), "zeros", "ones", r("expo", 6).alias("expo"))


# --- rollouts: done where the intervention flag is set ---


@query(with_(FR, "fd as (select ep, coalesce(min(case when iv > 0.5 then fi end), 0) as d from fr group by ep)") + "select i as \"index\" from fr join fd on fd.ep = fr.ep where fi <= d + 1")
def seq_first_done(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "intervention").withColumn("done", F.col("intervention") > 0.5)
    return windows.until_first_done(f).select("index")


@query(with_(FR) + "select i as \"index\", coalesce(bool_or(coalesce(iv, 0) > 0.5) over (partition by ep order by fi, i), false) or fi >= 79 as \"over\" from fr")
def seq_cumulative_done(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "intervention").withColumn("done", F.coalesce(F.col("intervention"), F.lit(0.0)) > 0.5)
    return windows.running_done(f, 80).select("index", "over")


@query(with_(FR, _B, "cut as (select *, least(n, 20) as m from b)") + "select ep as episode_index, rn - 1 as frame_index, round((rn - 1) / 30.0, 5) as timestamp, round(action[1]::double, 5) as x from cut where rn <= m union all select ep, m, round(m / 30.0, 5), round(action[1]::double, 5) from cut where rn = m")
def seq_compile_rollout(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "action")
    one = f.groupBy("episode_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "index", "action"))), lambda s: s["action"]).alias("actions")).withColumn("done_step", F.lit(19))
    out = windows.rollout_frames(one, 30.0)
    return out.select("episode_index", "frame_index", r("timestamp").alias("timestamp"), r(arrays.at(F.col("action"), 0)).alias("x"))


@query(with_(FR) + "select ep as episode_index, arg_min(i, fi * 1000000000 + i) as first_index, arg_max(i, fi * 1000000000 + i) as last_index from fr group by ep")
def seq_boundary_rows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.boundary_rows(frames(spark, sf, "frame_index"))


@query(with_(FR) + "select ep as episode_index, min(adv) as low, max(adv) as high from fr where adv is not null and not isnan(adv) group by ep")
def seq_value_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return windows.value_bounds(frames(spark, sf, "advantage"), "advantage")


@query(with_(FR, "e as (select *, coalesce(iv, 0) > 0.5 as onn, lag(coalesce(iv, 0) > 0.5) over (partition by ep order by fi, i) as was from fr)", "l as (select i, last_value(case when onn and not coalesce(was, false) then state[1]::double end ignore nulls) over (partition by ep order by fi, i rows between unbounded preceding and current row) as x from e)") + "select i as \"index\", round(x, 5) as reference from l")
def math_ee_ref(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "intervention", "state").withColumn("on", F.coalesce(F.col("intervention"), F.lit(0.0)) > 0.5)
    return windows.latched(f, "on", arrays.at(F.col("state"), 0), "reference").select("index", r("reference").alias("reference"))


@query(with_(FR, _B, "k as (select i, ep, rn, greatest(-0.5, least(0.5, state[1]::double)) as x, greatest(-0.5, least(0.5, state[2]::double)) as y from b)") + "select k.i as \"index\", round(k.x, 5) as x, coalesce(sqrt((k.x - p.x) * (k.x - p.x) + (k.y - p.y) * (k.y - p.y)) > 0.05, false) as jumps from k left join k p on p.ep = k.ep and p.rn = k.rn - 1")
def math_ee_bounds(spark: SparkSession, sf: str) -> DataFrame:
    b = windows.bounded_steps(frames(spark, sf, "frame_index", "state"), "state", [-0.5, -0.5], [0.5, 0.5], 0.05)
    return b.select("index", r(arrays.at(F.col("clipped"), 0)).alias("x"), "jumps")

