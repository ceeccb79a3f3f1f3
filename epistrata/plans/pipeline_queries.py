"""Queries of the step registry, pipelines, row functions and the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.functions import arrays
from epistrata.plans import pipeline as pl
from epistrata.plans import steps  # noqa: F401  registers its steps
from epistrata.plans.register import query, r
from epistrata.plans.source_queries import _written
from epistrata.plans.views import EP, FR, episodes, frames, table, tasks, with_
from epistrata.runtime import Workspace
from epistrata.sources import dataset


def _steps() -> pl.Pipeline:
    n = pl.Normalize({"state": "mean_std"})
    n.stats = {"state": {"mean": [0.5] * 6, "std": [2.0] * 6}}
    return pl.Pipeline([n, pl.TimeLimit(40), pl.AddConstant("domain_id", 4), pl.CastFloats("double")], "prep")


_PIPE = "select i as \"index\", round((state[1]::double - 0.5) / 2.00000001, 4) as x, fi + 1 >= 40 as truncated, 4 as domain_id from fr where len(state) = 6"


@query(with_(FR) + _PIPE)
def udf_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf, "frame_index", "state").filter(F.size("state") == 6)
    return _steps()(f).select("index", r(F.get("state", F.lit(0)), 4).alias("x"), "truncated", "domain_id")


@query(with_(FR) + _PIPE)
def udf_pipeline_io(spark: SparkSession, sf: str) -> DataFrame:
    """Saved and loaded again; an override sets the limit back."""
    f = frames(spark, sf, "frame_index", "state").filter(F.size("state") == 6)
    folder, p = Workspace(spark, "pipeline").path("saved"), _steps()
    p.steps[1].max_episode_steps = 7
    p.save(folder, spark)
    loaded = pl.Pipeline.load(folder, "prep", {"time_limit_processor": {"max_episode_steps": 40}}, spark)
    return loaded(f).select("index", r(F.get("state", F.lit(0)), 4).alias("x"), "truncated", "domain_id")


@query("select 'truncated' as name, 'boolean' as type union all select 'domain_id', 'int' union all select 'state', 'array<double>'")
def udf_transform_features(spark: SparkSession, sf: str) -> DataFrame:
    s = _steps().schema(frames(spark, sf, "frame_index", "state"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s if f.name in ("truncated", "domain_id", "state")], "name string, type string")


@query("select 'truncated' as name, 'boolean' as type union all select 'domain_id', 'int' union all select 'action', 'array<double>'")
def project_pipeline_features(spark: SparkSession, sf: str) -> DataFrame:
    s = pl.Pipeline([pl.TimeLimit(40), pl.AddConstant("domain_id", 4), pl.CastFloats("double")]).schema(frames(spark, sf, "frame_index", "action"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s if f.name in ("truncated", "domain_id", "action")], "name string, type string")


#: The names under which pipelines are saved.
STEP_NAMES = """groot_pack_inputs_v3 groot_eagle_encode_v3 groot_eagle_collate_v3 groot_action_unpack_unnormalize_v1 pi0_new_line_processor pi05_prepare_state_tokenizer_processor_step pi0_fast_prepare_state_tokenizer_processor_step smolvla_new_line_processor wall_x_task_processor xvla_image_scale xvla_image_to_float xvla_imagenet_normalize xvla_add_domain_id xvla_rotation_6d_to_axis_angle to_batch_processor_action to_batch_processor_observation to_batch_processor_complementary_data to_batch_processor map_tensor_to_delta_action_dict map_delta_action_to_robot_action device_processor libero_processor isaaclab_arena_processor torch2numpy_action_processor numpy2torch_action_processor add_teleop_action_as_complementary_data add_teleop_action_as_info image_crop_resize_processor time_limit_processor gripper_penalty_processor intervention_action_processor reward_classifier_processor normalizer_processor unnormalizer_processor observation_processor robot_action_to_policy_action_processor policy_action_to_robot_action_processor rename_observations_processor tokenizer_processor action_tokenizer_processor joint_velocity_processor current_processor ee_reference_and_delta ee_bounds_and_safety gripper_velocity_to_joint map_phone_action_to_robot_action pistar06_prepare_task_prompt pistar06_prepare_images"""


@query("select unnest(string_split('" + STEP_NAMES + "', ' ')) as name, true as refused")
def udf_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Every step by its name; a name that is taken is refused."""
    rows = []
    for n in pl.Registry.names():
        try:
            pl.Registry.register(n)(pl.Step)
            rows.append((n, False))
        except ValueError:
            rows.append((n, True))
    own = spark.createDataFrame(rows, "name string, refused boolean")
    return own.filter(~F.col("name").isin("add_domain_id", "new_line_processor", "prepare_task_prompt", "state_processor"))


class _Doubled(pl.ActionStep):
    def column(self, name, col, kind):
        return F.transform(col, lambda x: x.cast("double") * 2)


@query(with_(FR) + "select i as \"index\", round(action[1]::double * 2, 5) as x, round(state[1]::double, 5) as y from fr where len(action) = 6 and len(state) = 6")
def udf_step_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """An action step leaves other columns alone."""
    f = frames(spark, sf, "action", "state").filter((F.size("action") == 6) & (F.size("state") == 6))
    return _Doubled()(f).select("index", r(F.get("action", F.lit(0))).alias("x"), r(arrays.at(F.col("state"), 0)).alias("y"))


@query(with_(FR) + "select i as \"index\", ep * 1000 + fi as code from fr")
def udf_row_callable(spark: SparkSession, sf: str) -> DataFrame:
    return pl.row_callable(frames(spark, sf, "frame_index"), "code", "bigint", lambda row, e, f: e * 1000 + f).select("index", "code")


@query(with_(FR) + "select i as \"index\", t.task || chr(10) || case when adv > 0 then 'Advantage: positive' else 'Advantage: negative' end as prompt, round(-least(1, abs(adv)), 5) as target from fr join tasks t on t.task_index = fr.task where adv is not null and not isnan(adv)")
def udf_batch_hook(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.functions.text import advantage_tag

    f = frames(spark, sf, "advantage", "task_index").filter("advantage is not null and not isnan(advantage)").join(tasks(spark, sf), ["task_index"])
    targets = f.select("index", (-F.least(F.lit(1.0), F.abs("advantage"))).alias("target"))
    return f.join(targets, ["index"]).select("index", advantage_tag(F.col("task"), F.col("advantage") > 0).alias("prompt"), r("target").alias("target"))


@query(with_(FR) + "select i as \"index\", round(action[2]::double, 5) as lift, round(action[6]::double, 5) as last from fr where len(action) = 6")
def udf_policy_bridge(spark: SparkSession, sf: str) -> DataFrame:
    names = ["pan", "lift", "flex", "roll", "yaw", "gripper"]
    f = pl.Pipeline([pl.VectorToNames("action", names), pl.NamesToVector(names, "again")])(frames(spark, sf, "action").filter(F.size("action") == 6))
    return f.select("index", r("lift").alias("lift"), r(F.get("again", F.lit(5))).alias("last"))


@query(with_(FR, "s as (select distinct episode_index as ep, timestamp as t, sensor_key, sample_id from sensor_samples where timestamp is not null)") + "select i as \"index\", sensor_key, max(sample_id) as sample_id from fr join s on s.ep = fr.ep and abs(s.t - fr.ts) <= 0.005 group by 1, 2")
def udf_teleop_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded readings of every device attached to frames by time."""
    from epistrata.operators.joins import within_time

    return within_time(frames(spark, sf, "timestamp"), table(spark, sf, "sensor_samples"), 0.005)


@query(with_(FR) + "select i as \"index\", 12 as n, round(action[6]::double, 4) as last from fr where len(state) = 6 and len(action) = 6")
def udf_motor_current(spark: SparkSession, sf: str) -> DataFrame:
    """The registered step, with the commands as the recorded readings."""
    f = frames(spark, sf, "state", "action").filter((F.size("state") == 6) & (F.size("action") == 6)).withColumnsRenamed({"state": "observation.state", "action": "observation.motor_currents"})
    out = steps.MotorCurrents()(f)
    return out.select("index", F.size("`observation.state`").alias("n"), r(F.get("`observation.state`", F.lit(11)), 4).alias("last"))


@query("select replace(sensor_key, '_', '.') as feature, 'mean' as stat, tolerance_s as value from sync_configs union all select replace(sensor_key, '_', '.'), 'std', 2 * tolerance_s from sync_configs")
def udf_migrate(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics kept under two prefixes, beside other weights."""
    rows = table(spark, sf, "sync_configs").collect()
    state = {f"normalize_inputs.buffer_{x['sensor_key']}.mean": [x["tolerance_s"]] for x in rows} | {f"unnormalize_targets.{x['sensor_key']}.std": [2 * x["tolerance_s"]] for x in rows} | {"model.weight": [9.0]}
    return spark.createDataFrame([(f, k, float(v[0])) for f, d in pl.migrated_stats(state).items() for k, v in d.items()], "feature string, stat string, value double")


# --- command line ---


_KEPT = "k as (select eps.*, row_number() over (order by ep) - 1 as ne, coalesce(n, 0) as n from eps left join (select ep as e, count(*) as n from fr group by ep) c on c.e = eps.ep where not (ep between 2 and 3 or ep = 9))"


def _whole(spark: SparkSession, sf: str, which: str = "true") -> str:
    """The test tables as a dataset on disk, episodes with what is known of them."""
    root = Workspace(spark, "edit").path("root")
    f = frames(spark, sf, "frame_index", "timestamp", "task_index", "action").filter(which)
    dataset.write_frames(f, root)
    e = dataset.episode_rows(episodes(spark, sf).filter(which).select("episode_index", "tasks", "length", "episode_success", "fps", "operator_id").withColumn("stats/action/count", F.col("length")))
    dataset.write_meta(spark, root, {"fps": 30, "features": {"action": {"dtype": "float32", "shape": [6], "names": None}, "top": {"dtype": "video", "shape": [4, 4, 3], "names": None}}, "splits": {"train": "0:1"}}, tasks(spark, sf), e, {"action": {"mean": [9.0] * 6}, "top": {"mean": [0.5]}})
    return root


@query(with_(FR, EP, _KEPT) + "select ne as episode_index, n as length, sum(n) over (order by ne)::bigint - n as dataset_from_index, episode_success, fps, operator_id, length as \"stats/action/count\", array_to_string(tasks, '|') as tasks, (select round(avg(action[1]::double), 4) from fr join k on k.ep = fr.ep where len(action) = 6) as mean, '0:' || (select count(*) from k) as split from k")
def cli_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes deleted in place: the others with every column, anew numbered, statistics and splits of what is left."""
    from epistrata import cli

    root = _whole(spark, sf)
    cli.edit(spark, root, None, "delete_episodes", "2-3,9")
    info, told = dataset.scan_info(spark, root), {(x["feature"], x["stat"], x["dim"]): x["value"] for x in dataset.scan_stats(spark, root).collect()}
    e = dataset.scan_episodes(spark, root, stats=True).withColumn("tasks", F.array_join("tasks", "|"))
    return e.drop("dataset_to_index").withColumn("mean", r(F.lit(told["action", "mean", 0]), 4)).withColumn("split", F.lit(info["splits"]["train"])).filter(F.lit(told["top", "mean", 0] == 0.5))


@query(with_(FR, EP, "h as (select ep, ep % 2 as part, row_number() over (partition by ep % 2 order by ep) - 1 + case when ep % 2 = 1 then (select count(*) from eps where ep % 2 = 0) else 0 end as ne from eps)", "g as (select ne, row_number() over (order by ne, fi, i) - 1 as x, fi, task as k from fr join h on h.ep = fr.ep)") + "select ne as episode_index, x as \"index\", fi as frame_index, t.task as text from g join tasks t on t.task_index = g.k")
def cli_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves of a dataset merged on disk."""
    from epistrata import cli

    roots = [_whole(spark, sf, f"episode_index % 2 = {k}") for k in (0, 1)]
    out = cli.edit(spark, roots[0], Workspace(spark, "merge").path("out"), "merge", others=roots[1:])[0]
    return dataset.scan_frames(spark, out).join(dataset.scan_tasks(spark, out).withColumnRenamed("task", "text"), ["task_index"]).select("episode_index", "index", "frame_index", "text")


@query(with_(FR, EP) + "select i as \"index\" from fr join eps on eps.ep = fr.ep")
def cli_value_infer(spark: SparkSession, sf: str) -> DataFrame:
    """Advantages and indicators written in place: a value on every frame."""
    from epistrata import cli

    root = Workspace(spark, "acp").path("root")
    f = frames(spark, sf, "frame_index", "task_index").join(episodes(spark, sf).select("episode_index"), ["episode_index"], "left_semi").withColumn("value", F.lit(-0.5))
    dataset.write_frames(f, root)
    dataset.write_meta(spark, root, {"fps": 30, "features": {}}, tasks(spark, sf), episodes(spark, sf).select("episode_index", "tasks", "length", "episode_success"))
    cli.acp(spark, root, "value", n_step=10)
    out = dataset.scan_frames(spark, root)
    return out.filter(F.col("`complementary_info.advantage`").isNotNull() & F.col("`complementary_info.acp_indicator`").isin(0, 1)).select("index")


@query(with_(EP) + "select 'episodes: ' || count(*) as line from eps")
def cli_report(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata import cli

    return spark.createDataFrame([(cli.report(spark, _written(spark, sf), 30.0).splitlines()[0],)], "line string")


@query(with_(EP) + "select ep as episode_index, case when ep < 10 then 'success' else 'failure' end as episode_success from eps")
def cli_patch_success(spark: SparkSession, sf: str) -> DataFrame:
    from epistrata.operators.episodes import label_success

    return label_success(episodes(spark, sf), list(range(10)), (), "failure", overwrite=True).select("episode_index", "episode_success")


@query(with_(EP) + "select ep as episode_index, length from eps where ep <> 58 order by length, ep limit 5")
def cli_prepare_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """One episode dropped, one task and label for all; the five shortest as a report."""
    from epistrata.operators import episodes as ops

    e = ops.label_success(ops.drop_episodes(episodes(spark, sf), [58]), (), (), "success", overwrite=True)
    ops.retask(e, "the task")
    return e.orderBy("length", "episode_index").limit(5).select("episode_index", "length")


@query(with_(FR, "b as (select *, row_number() over (partition by ep order by fi, i) as rn, count(*) over (partition by ep) as n from fr)") + "select count(*) as chunks from b where rn + 7 <= n")
def cli_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of eight actions, what an action tokenizer is given."""
    from epistrata.operators.windows import action_chunks

    return action_chunks(frames(spark, sf, "frame_index", "action"), 8).agg(F.count("chunk").alias("chunks"))


@query(with_(FR, EP, "tm as (select tasks[1] as t, max(length) as m from eps group by 1)") + "select i as \"index\", round(greatest(-1.0, least(0.0, (-(length - fi - 1) - case when label = 'success' then 0 else m end) / (m * 2.0))), 5) as target from fr join eps on eps.ep = fr.ep join tm on tm.t = tasks[1]")
def cli_value_train(spark: SparkSession, sf: str) -> DataFrame:
    """What a value network is trained on: the targets. The network is not part of this engine."""
    from epistrata.operators.advantage import value_targets

    e = episodes(spark, sf).withColumn("success", F.coalesce(F.col("label") == "success", F.lit(False)))
    f = frames(spark, sf, "frame_index").join(e.select("episode_index"), ["episode_index"], "left_semi")
    return value_targets(f, e).select("index", r("target").alias("target"))


@query(with_(FR) + "select ep % 4 as shard, count(*) as frames, count(distinct ep) as episodes from fr group by 1")
def cli_slurm(spark: SparkSession, sf: str) -> DataFrame:
    """Ported shards brought together as one dataset: a union that Spark runs in parallel."""
    from epistrata.operators.episodes import union_checked

    f = frames(spark, sf, "frame_index")
    out = None
    for k in range(4):
        part = f.filter(F.col("episode_index") % 4 == k).withColumn("shard", F.lit(k).cast("bigint"))
        out = part if out is None else union_checked(out, part)
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("episode_index").alias("episodes"))
