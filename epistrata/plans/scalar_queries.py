"""Queries of text, JSON, vector and normalization functions over the test tables."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.functions import arrays, text
from epistrata.operators import stats
from epistrata.plans.register import exploded, query, r, sql_hash
from epistrata.plans.views import EP, FR, episodes, frames, table, tasks, with_

BIN = "case when {x} < -1 then -1 else least(255, floor(({x} + 1) * 128)) end"


def _sql_bins(state: str) -> str:
    parts = [f"cast({BIN.format(x=f'{state}[{i}]::double')} as integer)" for i in range(1, 7)] + ["128"] * 2
    return " || ' ' || ".join(f"{p}" for p in parts)


# --- text ---


@query(with_(FR) + "select i as \"index\", case when coalesce(t.task, '') = '' then '' else t.task || chr(10) end || case when adv > 0 then 'Advantage: positive' else 'Advantage: negative' end as prompt from fr left join tasks t on t.task_index = fr.task where adv is not null and not isnan(adv)")
def str_acp_tag(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "task_index", "advantage").filter("advantage is not null and not isnan(advantage)")
    return f.join(tasks(spark, sf), ["task_index"], "left").select("index", text.advantage_tag(F.col("task"), F.col("advantage") > 0).alias("prompt"))


@query(with_(FR) + f"select i as \"index\", case when {sql_hash('i', 11)} / 4503599627370496.0 < 0.3 then 'task' else 'task' || chr(10) || case when iv > 0.5 then 'Advantage: positive' else 'Advantage: negative' end end as prompt from fr where iv is not null")
def str_acp_hook(spark: SparkSession, sf: str) -> DataFrame:
    """Tags dropped by a draw from the frame's index."""
    f = frames(spark, sf, "intervention").filter("intervention is not null").withColumn("ind", F.col("intervention").cast("int"))
    return f.select("index", text.tagged_or_dropped(F.lit("task"), F.col("ind"), F.col("index"), 0.3, 11).alias("prompt"))


@query("select task_index, trim(replace(replace(trim(task), '_', ' '), chr(10), ' ')) as prompt from tasks")
def str_clean_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return tasks(spark, sf).select("task_index", text.clean_prompt(F.col("task")).alias("prompt"))


@query(with_(FR) + f"select i as \"index\", 'Task: ' || trim(t.task) || ', State: ' || {_sql_bins('state')} || chr(10) || 'Value: ' as prompt from fr join tasks t on t.task_index = fr.task where len(state) = 6")
def str_value_prompt(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "task_index", "state").filter(F.size("state") == 6).join(tasks(spark, sf), ["task_index"])
    return f.select("index", text.value_prompt(F.col("task"), F.col("state"), 8).alias("prompt"))


@query(with_(FR) + f"select i as \"index\", 'Task: ' || trim(t.task) || ', State: ' || {_sql_bins('state')} || ';' || chr(10) || 'Action: ' as prompt from fr join tasks t on t.task_index = fr.task where len(state) = 6")
def str_pi05_prompt(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "task_index", "state").filter(F.size("state") == 6).join(tasks(spark, sf), ["task_index"])
    return f.select("index", text.action_prompt(F.col("task"), F.col("state"), 8).alias("prompt"))


@query("select task_index, case when ends_with(task, chr(10)) then task else task || chr(10) end as a, case when ends_with(task, '.') then task else task || '.' end as b from tasks")
def str_newline(spark: SparkSession, sf: str) -> DataFrame:
    return tasks(spark, sf).select("task_index", text.with_suffix(F.col("task")).alias("a"), text.with_suffix(F.col("task"), ".", "Do the task.").alias("b"))


@query("select task_index, regexp_replace(lower(task), '[^a-z0-9 ]', '', 'g') as plain from tasks")
def str_formalize(spark: SparkSession, sf: str) -> DataFrame:
    return tasks(spark, sf).select("task_index", text.formalize(F.col("task")).alias("plain"))


@query(with_(EP) + "select coalesce(nullif(label, ''), 'unlabeled') as label, count(*) as n from eps group by 1")
def str_label_norm(spark: SparkSession, sf: str) -> DataFrame:
    return episodes(spark, sf).groupBy(text.label_or_unlabeled(F.col("episode_success")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, cast(floor(value) as integer) as seconds from events")
def str_mmss(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.seconds_of(text.clock_of(F.floor("value"))).alias("seconds"))


@query("select event_id, lpad(cast(cast(floor(floor(value) / 60) as bigint) as varchar), 2, '0') || ':' || lpad(cast(cast(floor(value) as bigint) % 60 as varchar), 2, '0') as clock from events")
def str_mmss_format(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.clock_of(F.floor("value")).alias("clock"))


@query(with_(EP) + "select ep as episode_index, ep as parsed from eps")
def str_episode_from_path(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf).withColumn("path", F.format_string("videos/top/episode_%06d.mp4", "episode_index"))
    return e.select("episode_index", text.episode_of_path(F.col("path")).alias("parsed"))


@query("select file_id, case when try_cast(info as json) is not null then json_extract_string(info, '$.codebase_version') end as version from info_files where try_cast(info as json) is not null")
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Objects wrapped in a model's talk and fences come back whole."""
    i = table(spark, sf, "info_files")
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("info"), F.lit("\n```\nDone."))
    fixed = text.repaired_json(wrapped)
    ok = F.try_parse_json("info").isNotNull()
    return i.filter(ok).select("file_id", F.get_json_object(fixed, "$.codebase_version").alias("version"))


@query("select task_index, task || '/' || task as answer from tasks")
def json_response_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.struct(F.col("task").alias("text"))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(t, F.struct(F.lit("/").alias("text")), t).alias("parts")).alias("content"))).alias("candidates")))
    return tasks(spark, sf).select("task_index", text.response_text(answer).alias("answer"))


@query("select file_id, count(*) as leaves from (select file_id, unnest(json_keys(info, '$.features')) as k from info_files where try_cast(info as json) is not null) group by file_id")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Nested features as rows of path and value: as many dtype leaves as features."""
    from epistrata.sources.dataset import flatten

    import json

    def run(it):
        for pdf in it:
            rows = []
            for fid, info in zip(pdf["file_id"], pdf["info"]):
                try:
                    flat = flatten(json.loads(info))
                except ValueError:
                    continue
                rows.append((fid, sum(k.startswith("features/") and k.endswith("/dtype") for k in flat)))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["file_id", "leaves"])

    return table(spark, sf, "info_files").select("file_id", "info").mapInPandas(run, "file_id long, leaves long").filter("leaves > 0")


@query("select event_id, cast(floor(x / 86400) as bigint) as days, cast(floor(x / 3600) as bigint) % 24 as hours, cast(floor(x / 60) as bigint) % 60 as minutes, round(x - floor(x / 60) * 60, 4) as seconds from (select event_id, value * 1000 as x from events)")
def str_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").select("event_id", text.elapsed_parts(F.col("value") * 1000).alias("p"))
    return p.select("event_id", "p.days", "p.hours", "p.minutes", r("p.seconds", 4).alias("seconds"))


@query(with_(EP) + "select ep as episode_index, trim(t) as task from (select ep, unnest(tasks) as t from eps) where trim(t) <> ''")
def str_flatten_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return episodes(spark, sf).select("episode_index", F.explode(text.flat_tasks(F.col("tasks"))).alias("task"))


@query("select task_index, d, case when d < n then ('0x' || substr(hex(encode(task)), 2 * d::integer + 1, 2))::integer + 3 when d = n then 1 else 0 end as id, d <= n as real from (select task_index, task, octet_length(encode(task)) as n from tasks), (select unnest(range(0, 96)) as d)")
def str_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-level ids of whole task texts, padded; ids of a vocabulary file go through the same step and are tested against its own encoder."""
    from epistrata.plans.steps import Tokenize

    t = Tokenize(max_length=96)(tasks(spark, sf))
    z = t.select("task_index", F.posexplode(F.arrays_zip(F.col("`observation.language.tokens`").alias("id"), F.col("`observation.language.attention_mask`").alias("real"))).alias("d", "z"))
    return z.select("task_index", F.col("d").cast("bigint").alias("d"), F.col("z.id").alias("id"), F.col("z.real").alias("real"))


@query(with_(FR) + "select i as \"index\", d::integer as d, (case when d = 0 then 2 when d <= 6 then 49999 - cast(floor(abs(action[d]::double) * 100) as integer) when d = 7 then 1 else 0 end)::integer as token, d < 8 as real from fr, (select unnest(range(0, 10)) as d) where len(action) = 6")
def str_action_tokens(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "action").filter(F.size("action") == 6)
    raw = F.transform("action", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int"))
    t = text.action_token_ids(raw, 50_257, 257, [2], [1], 10)
    return f.select("index", t.alias("t")).select("index", F.posexplode(F.arrays_zip("t.ids", "t.mask")).alias("d", "z")).select("index", "d", F.col("z.ids").alias("token"), F.col("z.mask").alias("real"))


@query(with_(EP) + f"select ep as episode_index, (['pick up', 'put down', 'move'])[{sql_hash('ep', 5)} % 3 + 1] as word from eps")
def str_perturb(spark: SparkSession, sf: str) -> DataFrame:
    return episodes(spark, sf).select("episode_index", text.picked(["pick up", "put down", "move"], F.col("episode_index"), 5).alias("word"))


# --- vectors ---

_NORM_SQL = "s as (select d, min(x) as lo, max(x) as hi, avg(x) as m, stddev_pop(x) as sd, quantile_cont(x, 0.01) as a, quantile_cont(x, 0.99) as b, quantile_cont(x, 0.1) as a1, quantile_cont(x, 0.9) as b1 from v group by d)"
_V_SQL = "v as (select i, d, state[d + 1]::double as x from fr, (select unnest(range(0, 6)) as d) where len(state) = 6)"


def _state_stats(f: DataFrame) -> dict[str, list[float]]:
    return stats.as_arrays(stats.feature_stats(f.filter(F.size("state") == 6), ["state"]), "state")


@query(with_(FR, _V_SQL, _NORM_SQL) + "select i as \"index\", v.d, round((x - m) / (sd + 1e-8), 4) as mean_std, round(2 * (x - lo) / (hi - lo) - 1, 4) as min_max, round(2 * (x - a) / (b - a) - 1, 4) as quantiles, round(2 * (x - a1) / (b1 - a1) - 1, 4) as quantile10 from v join s using (d)")
def norm_modes(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6)
    s = _state_stats(f)
    modes = ("mean_std", "min_max", "quantiles", "quantile10")
    z = f.select("index", F.posexplode(F.arrays_zip(*[arrays.normalize(F.col("state"), s, m).alias(m) for m in modes])).alias("d", "z"))
    return z.select("index", F.col("d").cast("bigint").alias("d"), *[r(f"z.{m}", 4).alias(m) for m in modes])


@query(with_(FR, _V_SQL, _NORM_SQL) + "select i as \"index\", v.d, round((x - m) / (sd + 1e-8) * sd + m, 4) as mean_std, round(x, 4) as min_max from v join s using (d)")
def norm_inverse(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6)
    s = _state_stats(f)
    back = lambda m: arrays.normalize(arrays.normalize(F.col("state"), s, m), s, m, inverse=True)
    z = f.select("index", F.posexplode(F.arrays_zip(back("mean_std").alias("a"), back("min_max").alias("b"))).alias("d", "z"))
    return z.select("index", F.col("d").cast("bigint").alias("d"), r("z.a", 4).alias("mean_std"), r("z.b", 4).alias("min_max"))


@query(with_(FR) + "select i as \"index\", round((state[1]::double - 0.5) / 2.00000001, 5) as x from fr where len(state) = 6")
def norm_hotswap(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.plans.pipeline import Normalize, Pipeline

    p = Pipeline([Normalize({"state": "mean_std"})]).hotswap_stats({"state": {"mean": [0.5] * 6, "std": [2.0] * 6}})
    return p(frames(spark, sf, "state").filter(F.size("state") == 6)).select("index", r(F.get("state", F.lit(0))).alias("x"))


@query(with_(FR, _V_SQL, _NORM_SQL) + "select i as \"index\", v.d, round((x - m) / greatest(sd, 1e-8), 4) as mean_std, round(2 * (greatest(a, least(b, x)) - a) / greatest(b - a, 1e-8) - 1, 4) as quantiles from v join s using (d)")
def norm_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6)
    s = _state_stats(f)
    z = f.select("index", F.posexplode(F.arrays_zip(arrays.normalize_clipped(F.col("state"), s, "mean_std").alias("a"), arrays.normalize_clipped(F.col("state"), s, "quantiles").alias("b"))).alias("d", "z"))
    return z.select("index", F.col("d").cast("bigint").alias("d"), r("z.a", 4).alias("mean_std"), r("z.b", 4).alias("quantiles"))


@query(with_(FR) + "select i as \"index\", d, case when d < 6 then round(state[d + 1]::double, 5) else 0.0 end as x, d < 6 as real from fr, (select unnest(range(0, 8)) as d) where len(state) = 6")
def norm_groot(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6)
    x, m = arrays.min_max_masked(F.col("state"), [-1.0] * 6, [1.0] * 6, 8)
    z = f.select("index", F.posexplode(F.arrays_zip(x.alias("x"), m.alias("m"))).alias("d", "z"))
    return z.select("index", F.col("d").cast("bigint").alias("d"), r("z.x").alias("x"), F.col("z.m").alias("real"))


@query(with_(FR, _V_SQL) + f"select i as \"index\", d, cast({BIN.format(x='x')} as integer) as bin from v")
def math_digitize(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6).select("index", F.posexplode("state").alias("d", "x"))
    return f.select("index", F.col("d").cast("bigint").alias("d"), arrays.digitize(F.col("x")).alias("bin"))


@query(with_(FR) + "select i as \"index\", cast(floor(p) as integer) as low_bin, round(1 - (p - floor(p)), 5) as low_weight from (select i, greatest(0, least(200, (adv + 1) / 0.005)) as p from fr where adv is not null and not isnan(adv))")
def math_bins(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "advantage").filter("advantage is not null and not isnan(advantage)")
    b = arrays.two_hot(F.col("advantage"), 201, -1.0, 0.0)
    return f.select("index", b.alias("b")).select("index", "b.low_bin", r("b.low_weight").alias("low_weight"))


@query(with_(FR, "w as (select i, d, exp(state[d + 1]::double - list_max(state)::double) as e, -1 + d / 5.0 as c from fr, (select unnest(range(0, 6)) as d) where len(state) = 6)") + "select i as \"index\", round(sum(e * c) / sum(e), 5) as x from w group by i")
def math_expected(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6)
    return f.select("index", r(arrays.expected_value(F.col("state"), -1.0, 0.0)).alias("x"))


@query(with_(FR, "w as (select i, sum(exp(state[d + 1]::double)) as z, sum(state[d + 1]::double) as s from fr, (select unnest(range(0, 6)) as d) where len(state) = 6 group by i)") + "select i as \"index\", round(ln(z) - s / 6, 5) as loss from w")
def math_soft_ce(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6)
    return f.select("index", r(arrays.soft_cross_entropy(F.col("state"), F.array_repeat(F.lit(1.0 / 6), 6))).alias("loss"))


@query(with_(FR) + "select i as \"index\", d, case when d < 6 then round(state[d + 1]::double, 5) else 0.0 end as x from fr, (select unnest(range(0, 9)) as d) where len(state) = 6")
def math_pad(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6)
    return exploded(f, ["index"], arrays.pad(F.col("state"), 9, cut=True)).withColumn("d", F.col("d").cast("bigint"))


@query(with_(FR) + "select i as \"index\", sqrt(action[1]::double * action[1] + action[2]::double * action[2] + action[3]::double * action[3]) > 0.5 as enabled, round(action[1]::double * 2, 5) as target_x, round(action[6]::double, 5) as gripper_vel from fr where len(action) = 6")
def math_delta_action(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "action").filter(F.size("action") == 6)
    a = [arrays.at(F.col("action"), i) for i in range(6)]
    t = f.select("index", arrays.delta_to_target(a[0], a[1], a[2], a[5], 2.0, 0.5).alias("t"))
    return t.select("index", "t.enabled", r("t.target_x").alias("target_x"), r("t.gripper_vel").alias("gripper_vel"))


@query(with_(FR) + "select i as \"index\", case when (state[6]::double < 0.5 and action[6]::double > 0.5) or (state[6]::double > 0.75 and action[6]::double < 0.5) then -0.01 else 0.0 end as penalty from fr where len(action) = 6 and len(state) = 6")
def math_gripper_penalty(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "action", "state").filter((F.size("action") == 6) & (F.size("state") == 6))
    return f.select("index", F.abs(arrays.gripper_penalty(arrays.at(F.col("state"), 5), arrays.at(F.col("action"), 5), most=1.0)).alias("p")).select("index", F.when(F.col("p") > 0, -0.01).otherwise(0.0).alias("penalty"))


@query(with_(FR) + "select i as \"index\", round(case when iv > 0.5 then state[1] else action[1] end::double, 5) as x, adv > 0.5 or fi >= 100 as done, case when adv > 0.5 then 1.0 else 0.0 end as reward from fr where len(action) = 6 and len(state) = 6 and iv is not null and adv is not null and not isnan(adv)")
def math_intervention(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.plans.pipeline import Intervention

    f = frames(spark, sf).filter((F.size("action") == 6) & (F.size("state") == 6) & F.col("intervention").isNotNull() & F.col("advantage").isNotNull() & ~F.isnan("advantage"))
    f = f.withColumns({"is_intervention": F.col("intervention") > 0.5, "teleop_action": F.col("state"), "terminate": F.col("frame_index") >= 100, "success": F.col("advantage") > 0.5})
    return Intervention()(f).select("index", r(arrays.at(F.col("action"), 0)).alias("x"), "done", "reward")


@query(with_(FR) + "select i as \"index\", case when abs(adv - 1) <= 0.01 then 1.0 else 0.25 end as reward, abs(adv - 1) <= 0.01 as done from fr where adv is not null and not isnan(adv)")
def math_reward_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.plans.pipeline import RewardClassifier

    f = frames(spark, sf, "advantage").filter("advantage is not null and not isnan(advantage)").withColumns({"predicted": F.col("advantage"), "reward": F.lit(0.25), "done": F.lit(False)})
    return RewardClassifier()(f).select("index", "reward", "done")


@query(with_(FR) + "select i as \"index\", fi + 1 >= 50 as truncated from fr")
def math_time_limit(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.plans.pipeline import TimeLimit

    return TimeLimit(50)(frames(spark, sf, "frame_index")).select("index", "truncated")


@query(with_(FR) + "select i as \"index\", round(greatest(0, least(1, state[6]::double + action[6]::double * 0.5)), 5) as pos from fr where len(action) = 6 and len(state) = 6")
def math_gripper_vel(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "action", "state").filter((F.size("action") == 6) & (F.size("state") == 6))
    return f.select("index", r(arrays.gripper_position(arrays.at(F.col("state"), 5), arrays.at(F.col("action"), 5), 0.5, 0.0, 1.0)).alias("pos"))


@query(with_(FR) + "select i as \"index\", case when iv > 0.5 then round(-(state[2]::double), 5) else 0.0 end as x, case when iv > 0.5 then round(state[1]::double, 5) else 0.0 end as y from fr where len(state) = 6 and iv is not null")
def math_phone_map(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state", "intervention").filter((F.size("state") == 6) & F.col("intervention").isNotNull())
    t = arrays.phone_to_target(F.col("intervention") > 0.5, F.col("state"), F.slice("state", 4, 3), F.lit(1), F.lit(0))
    return f.select("index", t.alias("t")).select("index", (r("t.target_x") + 0.0).alias("x"), r("t.target_y").alias("y"))


_Q = "q as (select i, state[1]::double / n as x, state[2]::double / n as y, state[3]::double / n as z, state[4]::double / n as w from (select i, state, sqrt(state[1]::double * state[1] + state[2]::double * state[2] + state[3]::double * state[3] + state[4]::double * state[4]) as n from fr where len(state) = 6) where n > 0.1)"


def _quats(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "state").filter(F.size("state") == 6)
    n = arrays.norm(F.col("state"), range(4))
    return f.filter(n > 0.1).select("index", "state", F.array(*[arrays.at(F.col("state"), i) / n for i in range(4)]).alias("q"))


@query(with_(FR, _Q) + "select i as \"index\", round(x * 2 * acos(greatest(-1, least(1, w))) / sqrt(greatest(0, 1 - w * w)), 4) as ax, round(z * 2 * acos(greatest(-1, least(1, w))) / sqrt(greatest(0, 1 - w * w)), 4) as az from q where 1 - w * w > 1e-6")
def rot_quat_axis(spark: SparkSession, sf: str) -> DataFrame:
    q = _quats(spark, sf).filter(1 - arrays.at(F.col("q"), 3) * arrays.at(F.col("q"), 3) > 1e-6).select("index", arrays.quat_to_axis_angle(F.col("q")).alias("a"))
    return q.select("index", r(arrays.at(F.col("a"), 0), 4).alias("ax"), r(arrays.at(F.col("a"), 2), 4).alias("az"))


@query(with_(FR, _Q) + "select i as \"index\", round(1 - 2 * (y * y + z * z), 4) as m00, round(2 * (x * y + z * w), 4) as m10, round(abs(w), 4) as back_w, 1.0 as len from q")
def rot_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Matrix of a quaternion, and the quaternion back from its rotation vector and from the matrix; q times its inverse has length 1."""
    q = _quats(spark, sf)
    m = arrays.quat_to_matrix(F.col("q"))
    back = arrays.rotvec_to_quat(arrays.quat_to_rotvec(arrays.matrix_to_quat(m)))
    one = arrays.quat_multiply(F.col("q"), arrays.quat_inverse(F.col("q")))
    return q.select("index", r(arrays.at(m, 0), 4).alias("m00"), r(arrays.at(m, 3), 4).alias("m10"), r(F.abs(arrays.at(back, 3)), 4).alias("back_w"), r(arrays.norm(one, range(4)), 4).alias("len"))


@query(with_(FR, _Q) + "select i as \"index\", round(2 * atan2(sqrt(x * x + y * y + z * z), abs(w)), 3) as angle from q")
def rot_6d(spark: SparkSession, sf: str) -> DataFrame:
    """The first two columns of a quaternion's matrix give its angle back."""
    q = _quats(spark, sf)
    m = arrays.quat_to_matrix(F.col("q"))
    six = F.array(*[arrays.at(m, i) for i in (0, 3, 6, 1, 4, 7)])
    return q.select("index", r(arrays.norm(arrays.six_d_to_axis_angle(six), range(3)), 3).alias("angle"))


@query(with_(FR) + "select i as \"index\", d, round(case when d < 6 then state[d + 1] else action[6] end::double, 5) as x from fr, (select unnest(range(0, 7)) as d) where len(state) = 6 and len(action) = 6")
def state_libero(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.plans.pipeline import ConcatState

    f = frames(spark, sf, "state", "action").filter((F.size("action") == 6) & (F.size("state") == 6)).select("index", F.struct(F.col("state").alias("arm"), F.slice("action", 6, 1).alias("gripper")).alias("robot"))
    return exploded(ConcatState(["robot.arm", "robot.gripper"], "v")(f), ["index"], F.col("v")).withColumn("d", F.col("d").cast("bigint"))


@query(with_(EP) + "select ep as episode_index, 3 as domain_id from eps")
def add_domain_id(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.plans.pipeline import AddConstant

    return AddConstant("domain_id", 3)(episodes(spark, sf)).select("episode_index", "domain_id")


@query("select vec_id, d, round((case when d = 0 then 1 when d = 1 then 2 when d = 2 then 4 else 5 end) / 255.0, 5) as x from embeddings, (select unnest(range(0, 4)) as d)")
def img_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Two pixels of two channels, channel by channel."""
    e = table(spark, sf, "embeddings").select("vec_id", F.array(*[F.lit(k) for k in (1, 4, 2, 5)]).alias("p"))
    out = exploded(e, ["vec_id"], arrays.image_to_chw(F.col("p"), 1, 2, 2))
    return out.withColumn("d", F.col("d").cast("bigint"))


@query("select vec_id, d, round(embedding[(d // 3 + 2) * 8 + d % 3 + 2]::double, 5) as x from embeddings, (select unnest(range(0, 6)) as d)")
def img_crop_resize(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as images of 8 x 8: two rows from the third, three columns from the second."""
    e = table(spark, sf, "embeddings")
    out = exploded(e, ["vec_id"], arrays.crop(F.col("embedding"), 8, 8, 1, 2, 1, 2, 3))
    return out.withColumn("d", F.col("d").cast("bigint"))


@query(f"select vec_id, round(embedding[1]::double * (0.8 + 0.4 * ({sql_hash('vec_id', 3)} / 4503599627370496.0)), 5) as x from embeddings")
def img_augment(spark: SparkSession, sf: str) -> DataFrame:
    """Brightness jittered by a factor drawn from the row's id."""
    k = 0.8 + 0.4 * text.hash_uniform(F.col("vec_id"), seed=3)
    return table(spark, sf, "embeddings").select("vec_id", r(F.element_at("embedding", 1).cast("double") * k).alias("x"))


@query(with_(FR) + "select i as \"index\", round(ts, 5) as timestamp from fr")
def dtype_coerce(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.plans.pipeline import CastFloats

    return CastFloats("double")(frames(spark, sf, "timestamp")).select("index", r("timestamp").alias("timestamp"))


@query("select task_index, 1 as n from tasks")
def batch_dim(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of one: a set of rows needs no batch dimension, so wrapping and unwrapping is the identity."""
    return tasks(spark, sf).select("task_index", F.size(F.array("task")).alias("n"))


