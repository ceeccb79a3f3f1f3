"""Registered steps by their names, on a small table, and pipelines saved and loaded through any file system."""

import math

import pytest
from pyspark.sql import functions as F

from epistrata.functions import tokens
from epistrata.plans import pipeline as pl
from epistrata.plans import steps

NAMES = """groot_pack_inputs_v3 groot_eagle_encode_v3 groot_eagle_collate_v3 groot_action_unpack_unnormalize_v1 pi0_new_line_processor pi05_prepare_state_tokenizer_processor_step
pi0_fast_prepare_state_tokenizer_processor_step smolvla_new_line_processor wall_x_task_processor xvla_image_scale xvla_image_to_float xvla_imagenet_normalize xvla_add_domain_id xvla_rotation_6d_to_axis_angle
to_batch_processor_action to_batch_processor_observation to_batch_processor_complementary_data to_batch_processor map_tensor_to_delta_action_dict map_delta_action_to_robot_action device_processor libero_processor
isaaclab_arena_processor torch2numpy_action_processor numpy2torch_action_processor add_teleop_action_as_complementary_data add_teleop_action_as_info image_crop_resize_processor time_limit_processor
gripper_penalty_processor intervention_action_processor reward_classifier_processor normalizer_processor unnormalizer_processor observation_processor robot_action_to_policy_action_processor
policy_action_to_robot_action_processor rename_observations_processor tokenizer_processor action_tokenizer_processor joint_velocity_processor current_processor ee_reference_and_delta ee_bounds_and_safety
gripper_velocity_to_joint map_phone_action_to_robot_action pistar06_prepare_task_prompt pistar06_prepare_images""".split()


def test_all_names_are_registered():
    assert len(NAMES) == 48 and set(NAMES) <= set(pl.Registry.names())


@pytest.fixture(scope="module")
def rows(spark):
    rows = [(e, k, 10 * e + k, [0.1 * k, 0.5, -1.0, 0.0, 2.0, k / 4], [1.0, 0.0, 0.0, 0.0, 1.0, 0.9], ["Lift it", None][e], [0, 255, 51, 102, 0, 255, 51, 102, 0, 255, 51, 102]) for e in range(2) for k in range(4)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, index long, `observation.state` array<float>, action array<float>, task string, `observation.images.top` array<int>").orderBy("index")


def first(step, df):
    out = step(df).orderBy("index") if "index" in df.columns else step(df)
    return out.collect()


def test_prompts(rows):
    assert first(steps.Pi0NewLine(), rows)[0].task == "Lift it\n" and first(steps.FullStop(), rows)[-1].task == "Execute the robot action."
    p = first(steps.ActionPrompt(8), rows)[0].task
    assert p.startswith("Task: Lift it, State: 128 192 0 128 255 128 128 128;") and p.endswith("Action: ") and first(steps.FastActionPrompt(8), rows)[0].task.endswith("128;\n")
    assert first(steps.TaskValuePrompt(include_state_in_prompt=False), rows)[0].task == "Task: Lift it\nValue: "


def test_tokens_are_the_bytes_or_the_vocabulary(rows):
    r = first(steps.Tokenize(max_length=12), rows)[0].asDict()
    assert r["observation.language.tokens"] == [b + 3 for b in b"Lift it"] + [1] + [0] * 4 and r["observation.language.attention_mask"] == [True] * 8 + [False] * 4
    r = first(steps.Tokenize(max_length=4, padding_side="left"), rows)[-1].asDict()
    assert r["observation.language.tokens"] == [0, 0, 0, 1]
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    r = first(steps.Tokenize(path, 6), rows)[0].asDict()
    ids = tokens.encoder(path)("Lift it")
    assert r["observation.language.tokens"] == (ids + [0] * 6)[:6]
    e = steps.CollateLanguage(max_length=9)(steps.EncodeLanguage(task_key="task")(rows)).orderBy("index").first().asDict()
    assert len(e["observation.language.tokens"]) == 9


def test_vectors(rows):
    pack = steps.PackInputs(max_state_dim=8, max_action_dim=4, formalize_language=True)
    pack.load_state({"observation.state": {"min": [0.0, 0.5, -2.0, -1.0, 0.0, 0.0], "max": [1.0, 0.5, 0.0, 1.0, 4.0, 1.0]}})
    r = first(pack, rows)[0].asDict()
    assert r["observation.state"] == pytest.approx([-1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0]) and sum(r["observation.state_mask"]) == 6 and len(r["action"]) == 4 and r["language"] == "lift it" and r["embodiment_id"] == 31
    un = steps.UnpackAction(env_action_dim=2)
    un.load_state({"action": {"min": [0.0, 7.0], "max": [10.0, 7.0]}})
    assert first(un, rows)[0].action == pytest.approx([10.0, 7.0])
    six = rows.withColumn("action", F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.7)]))
    assert first(steps.SixDAction(), six)[0].action == pytest.approx([1, 2, 3, 0, 0, 0, 1])
    assert first(steps.PolicyToRobot(["a", "b"]), rows)[0]["a.pos"] == 1.0
    v = first(steps.JointVelocity(0.1), rows)
    assert len(v[0]["observation.state"]) == 12 and v[1]["observation.state"][6] == pytest.approx(1.0, abs=1e-5) and v[4]["observation.state"][6] == 0.0
    cur = rows.withColumn("observation.motor_currents", F.array(F.lit(5.0)))
    assert first(steps.MotorCurrents(), cur)[0]["observation.state"][-1] == 5.0
    for name in ("to_batch_processor", "to_batch_processor_action", "numpy2torch_action_processor", "torch2numpy_action_processor"):
        assert first(pl.Registry.get(name)(), rows)[0].action == pytest.approx([1.0, 0.0, 0.0, 0.0, 1.0, 0.9])
    codes = rows.withColumn("action.codes", F.array(F.lit(0), F.lit(5)))
    r = first(steps.ActionTokens(max_action_tokens=3, fast_skip_tokens=128, vocabulary=1000), codes)[0].asDict()
    assert r["action.tokens"] == [871, 866, 0] and r["action.token_mask"] == [True, True, False]


def test_images(rows):
    n = "observation.images.top"
    f = steps.ImageToFloat()(rows)
    assert first(steps.ImageToFloat(), rows)[0][n][:3] == pytest.approx([0.0, 1.0, 0.2]) and first(steps.ImageTimes255(), f)[0][n][1] == pytest.approx(255.0)
    assert first(steps.ImageNormalize(), f)[0][n][0] == pytest.approx(-0.485 / 0.229)
    with pytest.raises(Exception, match="beyond"):
        steps.ImageToFloat()(rows.withColumn(n, F.array(F.lit(300)))).collect()
    same = steps.CropResize(resize_size=[2, 2], shapes={n: [2, 2, 3]})
    assert first(same, rows)[0][n] == pytest.approx(rows.first()[n])
    half = steps.CropResize({n: [0, 0, 1, 2]}, [1, 1], {n: [2, 2, 3]})
    px = rows.first()[n]
    assert first(half, rows)[0][n] == pytest.approx([(px[k] + px[3 + k]) / 2 for k in range(3)])
    r = first(steps.VanillaObservation({"pixels.top": [2, 2, 3]}), rows.withColumn("pixels.top", F.col(f"`{n}`")).withColumn("agent_pos", F.array(F.lit(1.0))).drop(n, "observation.state"))[0]
    assert r[n][0] == 0.0 and len(r[n]) == 12 and r["observation.state"] == [1.0]
    r = first(steps.PrepareImages([n, "observation.images.wrist"]), rows)[0]
    assert r[f"{n}_mask"] and not r["observation.images.wrist_mask"] and max(r[n]) == 1.0


def test_environments_and_devices(rows, spark):
    q = [0.0, 0.0, math.sin(0.5), math.cos(0.5)]
    robot = F.struct(F.struct(F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0)]).alias("pos"), F.array(*[F.lit(x) for x in q]).alias("quat")).alias("eef"), F.struct(F.array(F.lit(8.0), F.lit(9.0)).alias("qpos")).alias("gripper"))
    n = "observation.images.top"
    r = first(steps.LiberoState({n: [2, 2, 3]}), rows.withColumn("observation.robot_state", robot))[0]
    assert r["observation.state"] == pytest.approx([1, 2, 3, 0, 0, 1, 8, 9]) and r[n][:3] == rows.first()[n][9:]
    r = first(steps.ArenaState(["a", "b"], ["cam"]), rows.withColumn("observation.a", F.array(F.lit(1.0))).withColumn("observation.b", F.array(F.lit(2.0))).withColumn("observation.cam", F.lit(1)))[0]
    assert r["observation.state"] == [1.0, 2.0] and r["observation.images.cam"] == 1
    dev = rows.withColumn("device.action", F.array(F.lit(4.0))).withColumn("device.success", F.lit(1))
    assert first(steps.TeleopAction(), dev)[0]["complementary_info.teleop_action"] == [4.0]
    r = first(steps.TeleopEvents(), dev)[0]
    assert r["info.success"] and not r["info.is_intervention"]
    cmd = rows.withColumn("enabled", F.col("frame_index") >= 1).withColumn("observation.ee_pose", F.array(F.col("frame_index").cast("double"), F.lit(0.0), F.lit(0.0)))
    for k in "xyz":
        cmd = cmd.withColumn(f"target_{k}", F.lit(0.5))
    got = [r["ee.x"] for r in first(steps.ReferenceAndDelta({"x": 2.0, "y": 1.0, "z": 1.0}), cmd)][:4]
    assert got == [0.0, 2.0, 2.0, 2.0]
    got = first(steps.BoundedTarget({"min": [-1.0] * 3, "max": [1.0] * 3}, 0.05), steps.ReferenceAndDelta()(cmd))
    assert max(r["ee.x"] for r in got) == 1.0 and got[1]["ee.jumps"] and not got[2]["ee.jumps"]
    g = rows.withColumn("observation.gripper.pos", F.lit(50.0)).withColumn("gripper_vel", F.lit(2.0))
    assert first(steps.GripperVelocity(), g)[0]["ee.gripper_pos"] == 90.0
    ph = rows.withColumn("phone.enabled", F.lit(True)).withColumn("phone.pos", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).withColumn("phone.rot", F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))).withColumn("phone.slider", F.lit(0.5))
    r = first(steps.PhoneAction(), ph)[0]
    assert (r.target_x, r.target_y, r.target_z, r.gripper_vel) == (-2.0, 1.0, 3.0, 0.5)


def test_a_saved_pipeline_of_another_writer_loads(spark, rows, tmp_path):
    import json

    folder = f"file://{tmp_path}/p"
    p = pl.Pipeline([steps.Pi0NewLine(), steps.PackInputs(max_state_dim=7)], "prep")
    p.steps[1].load_state({"action": {"min": [0.0], "max": [1.0]}})
    p.save(folder, spark)
    q = pl.Pipeline.load(folder, "prep", {"groot_pack_inputs_v3": {"max_state_dim": 9}}, spark)
    assert q.steps[1].max_state_dim == 9 and q.steps[1].stats == p.steps[1].stats
    with pytest.raises(KeyError):
        pl.Pipeline.load(folder, "prep", {"nobody": {}}, spark)
    other = {"name": "x", "steps": [{"registry_name": "device_processor", "config": {"device": "cuda", "float_dtype": "float32"}}, {"registry_name": "robot_action_to_policy_action_processor", "config": {"motor_names": ["a"]}}, {"registry_name": "to_batch_processor", "config": {}}]}
    (tmp_path / "x.json").write_text(json.dumps(other))
    x = pl.Pipeline.load(f"file://{tmp_path}", "x", spark=spark)
    assert x(rows.withColumn("a", F.lit(2.0))).first().action == [2.0]
    other["steps"][0]["config"]["unheard_of"] = 1
    (tmp_path / "x.json").write_text(json.dumps(other))
    with pytest.raises(TypeError, match="unheard_of"):
        pl.Pipeline.load(f"file://{tmp_path}", "x", spark=spark)


def test_statistics_do_not_vanish():
    got = pl.migrated_stats({"unnormalize_outputs.action.mean": [1.0], "normalize_targets.action.std": [2.0], "unnormalize_targets.action.max": [3.0], "normalize_inputs.buffer_observation_state.min": [4.0], "model.weight": [0.0]})
    assert got == {"action": {"mean": [1.0], "std": [2.0], "max": [3.0]}, "observation.state": {"min": [4.0]}}
    with pytest.raises(ValueError, match="my_normalizer|unnormalize_x"):
        pl.migrated_stats({"unnormalize_x.action.mean": [1.0]})
