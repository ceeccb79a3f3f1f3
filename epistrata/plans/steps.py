"""Registered steps of robot policies over frame tables: one row a frame, vectors as arrays, images as flat arrays of height x width x channels.

A step leaves columns it does not find as they are, so one pipeline serves tables with and without actions, prompts or images. Options that only
concern devices or remote downloads are read from saved pipelines and have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistrata.functions import arrays, text, tokens
from epistrata.operators import windows
from epistrata.plans.pipeline import ActionStep, AddConstant, Normalize, Registry, Step, Suffix
from epistrata.runtime import c

STATE, ACTION, IMAGES = "observation.state", "action", "observation.images."
#: Channel means and deviations of the common image collection.
IMAGE_MEAN, IMAGE_STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]
#: Numbers of robot bodies.
EMBODIMENTS = {"new_embodiment": 31, "oxe_droid": 17, "agibot_genie1": 26, "gr1": 24, "so100": 2, "unitree_g1": 3}


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns replaced in place or added, by literal names."""
    kept = [columns[n].alias(n) if n in columns else c(n) for n in df.columns]
    return df.select(*kept, *[x.alias(n) for n, x in columns.items() if n not in df.columns])


def _images(df: DataFrame, keys: list[str] | None) -> list[str]:
    return [n for n in df.columns if (n in keys if keys is not None else n.startswith(IMAGES))]


# --- prompts ---


@Registry.register("pi0_new_line_processor")
@dataclass
class Pi0NewLine(Suffix):
    pass


@Registry.register("smolvla_new_line_processor")
@dataclass
class SmolNewLine(Suffix):
    pass


@Registry.register("wall_x_task_processor")
@dataclass
class FullStop(Suffix):
    suffix: str = "."
    default: str | None = "Execute the robot action."


@Registry.register("pi05_prepare_state_tokenizer_processor_step")
@dataclass
class ActionPrompt(Step):
    """The task's prompt with the state in bins."""

    max_state_dim: int = 32
    task_key: str = "task"
    state_feature: str = STATE
    ending: ClassVar[str] = ";\nAction: "

    def __call__(self, df: DataFrame) -> DataFrame:
        return _with(df, {self.task_key: text.action_prompt(c(self.task_key), c(self.state_feature), self.max_state_dim, self.ending)})


@Registry.register("pi0_fast_prepare_state_tokenizer_processor_step")
@dataclass
class FastActionPrompt(ActionPrompt):
    ending: ClassVar[str] = ";\n"


@Registry.register("pistar06_prepare_task_prompt")
@dataclass
class TaskValuePrompt(Step):
    task_key: str = "task"
    include_state_in_prompt: bool = True
    state_feature: str = STATE
    max_state_dim: int = 32
    state_discretization_bins: int = 256

    def __call__(self, df: DataFrame) -> DataFrame:
        head = F.concat(F.lit("Task: "), text.clean_prompt(c(self.task_key)))
        state = F.concat(F.lit(", State: "), text.state_bins(c(self.state_feature), self.max_state_dim, self.state_discretization_bins)) if self.include_state_in_prompt else F.lit("")
        return _with(df, {self.task_key: F.concat(head, state, F.lit("\nValue: "))})


@Registry.register("tokenizer_processor")
@dataclass
class Tokenize(Step):
    """Adds observation.language.tokens and .attention_mask: ids of the task by the vocabulary at ``tokenizer_name``, or its bytes where that is null."""

    tokenizer_name: str | None = None
    max_length: int = 512
    task_key: str = "task"
    padding_side: str = "right"
    padding: str = "max_length"
    truncation: bool = True
    to: ClassVar[str] = "observation.language."

    def __call__(self, df: DataFrame) -> DataFrame:
        t = tokens.token_ids(c(self.task_key), self.tokenizer_name, self.max_length if self.truncation else None)
        width = F.lit(self.max_length) if self.padding == "max_length" else F.size("t")
        blank = lambda what: F.array_repeat(what, F.greatest(width - F.size("t"), F.lit(0)))
        side = (lambda a, b: F.concat(b, a)) if self.padding_side == "left" else F.concat
        out = df.withColumn("t", t) if "t" not in df.columns else None
        if out is None:
            raise ValueError("column t is in use")
        kept = [c(n) for n in df.columns if not n.startswith(self.to)]
        return out.select(*kept, side(F.col("t"), blank(F.lit(0))).alias(f"{self.to}tokens"), side(F.transform("t", lambda _: F.lit(True)), blank(F.lit(False))).alias(f"{self.to}attention_mask"))


@Registry.register("groot_eagle_encode_v3")
@dataclass
class EncodeLanguage(Tokenize):
    """The language field as token ids; pictures are for the model's own encoder."""

    tokenizer_assets_repo: str | None = None
    task_key: str = "language"
    padding: str = "longest"


@Registry.register("groot_eagle_collate_v3")
@dataclass
class CollateLanguage(Step):
    """Token ids and masks of rows brought to one length."""

    tokenizer_assets_repo: str | None = None
    max_length: int = 512
    to: ClassVar[str] = "observation.language."

    def __call__(self, df: DataFrame) -> DataFrame:
        out = {}
        for n, fill in ((f"{self.to}tokens", F.lit(0)), (f"{self.to}attention_mask", F.lit(False))):
            if n in df.columns:
                out[n] = F.slice(F.concat(c(n), F.array_repeat(fill, self.max_length)), 1, self.max_length)
        return _with(df, out)


@Registry.register("action_tokenizer_processor")
@dataclass
class ActionTokens(Step):
    """Adds action.tokens and action.token_mask from the ids an action codec wrote to ``column``."""

    action_tokenizer_name: str | None = None
    trust_remote_code: bool = True
    max_action_tokens: int = 256
    fast_skip_tokens: int = 128
    paligemma_tokenizer_name: str | None = None
    column: str = "action.codes"
    vocabulary: int = 257_152
    prefix: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)

    def __call__(self, df: DataFrame) -> DataFrame:
        t = text.action_token_ids(c(self.column), self.vocabulary, self.fast_skip_tokens, self.prefix, self.end, self.max_action_tokens)
        return _with(df, {"action.tokens": t["ids"], "action.token_mask": t["mask"]})


# --- vectors ---


class _Ranged(Normalize):
    """Keeps statistics as its state."""

    def ends(self, name: str, width: int) -> tuple[list[float], list[float]]:
        s = self.stats.get(name, {})
        fit = lambda v, fill: (list(v) + [fill] * width)[:width]
        return fit(s.get("min", []), 0.0), fit(s.get("max", []), 1.0 if "max" not in s else 0.0)


@Registry.register("groot_pack_inputs_v3")
@dataclass
class PackInputs(_Ranged):
    """Language, padded state and action with their masks, and the body's number."""

    state_horizon: int = 1
    action_horizon: int = 16
    max_state_dim: int = 64
    max_action_dim: int = 32
    language_key: str = "task"
    formalize_language: bool = False
    embodiment_tag: str = "new_embodiment"
    embodiment_mapping: dict[str, int] = field(default_factory=lambda: dict(EMBODIMENTS))
    normalize_min_max: bool = True
    state_width: int = 6
    action_width: int = 6

    def __call__(self, df: DataFrame) -> DataFrame:
        out: dict[str, Column] = {}
        if self.language_key in df.columns:
            said = F.coalesce(F.nullif(c(self.language_key), F.lit("")), F.lit("Perform the task."))
            out["language"] = text.formalize(said) if self.formalize_language else said
        for name, own, most in ((STATE, self.state_width, self.max_state_dim), (ACTION, self.action_width, self.max_action_dim)):
            if name not in df.columns:
                continue
            n = min(own, most)
            if self.normalize_min_max and name in self.stats:
                low, high = self.ends(name, own)
                out[name], out[f"{name}_mask"] = arrays.min_max_masked(c(name), low, high, most)
            else:
                out[name] = F.array(*arrays.dims(c(name), n), *[F.lit(0.0)] * (most - n))
                out[f"{name}_mask"] = F.array(*[F.lit(i < n) for i in range(most)])
        out["embodiment_id"] = F.lit(self.embodiment_mapping.get(self.embodiment_tag, 0))
        return _with(df, out)


@Registry.register("groot_action_unpack_unnormalize_v1")
@dataclass
class UnpackAction(_Ranged):
    """The action's real dimensions, back from [-1, 1]; a range of zero gives its minimum."""

    env_action_dim: int = 0
    normalize_min_max: bool = True
    width: int = 6

    def __call__(self, df: DataFrame) -> DataFrame:
        n = self.env_action_dim or self.width
        v = [arrays.at(c(ACTION), i) for i in range(n)]
        if self.normalize_min_max and self.stats:
            low, high = self.ends(ACTION, n)
            v = [F.lit(a) if a == b else (x + 1.0) * 0.5 * (b - a) + a for x, a, b in zip(v, low, high)]
        return _with(df, {ACTION: F.array(*v)})


@Registry.register("xvla_rotation_6d_to_axis_angle")
@dataclass
class SixDAction(Step):
    """Ten numbers (position, six of a rotation, gripper) as seven: position, axis times angle, and the gripper as -1 or 1."""

    expected_action_dim: int = 10

    def __call__(self, df: DataFrame) -> DataFrame:
        a = c(ACTION)
        grip = F.when(arrays.at(a, 9) > 0.5, 1.0).otherwise(-1.0)
        return _with(df, {ACTION: F.concat(F.slice(a, 1, 3).cast("array<double>"), arrays.six_d_to_axis_angle(F.slice(a, 4, 6)), F.array(grip))})


@Registry.register("xvla_add_domain_id")
@dataclass
class DomainId(Step):
    domain_id: int = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        return AddConstant("domain_id", self.domain_id)(df)


class _Same(Step):
    """A table is a batch already: rows need no batch dimension, so values stay."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return df


@Registry.register("to_batch_processor_action")
@dataclass
class BatchAction(_Same):
    pass


@Registry.register("to_batch_processor_observation")
@dataclass
class BatchObservation(_Same):
    pass


@Registry.register("to_batch_processor_complementary_data")
@dataclass
class BatchComplementary(_Same):
    pass


@Registry.register("to_batch_processor")
@dataclass
class Batch(_Same):
    pass


class _FloatAction(ActionStep):
    def column(self, name: str, col: Column, kind: T.DataType) -> Column:
        return col.cast("array<float>") if isinstance(kind, T.ArrayType) else col.cast("float") if isinstance(kind, T.NumericType) else col


@Registry.register("torch2numpy_action_processor")
@dataclass
class ActionOut(_FloatAction):
    squeeze_batch_dim: bool = True


@Registry.register("numpy2torch_action_processor")
@dataclass
class ActionIn(_FloatAction):
    pass


@Registry.register("policy_action_to_robot_action_processor")
@dataclass
class PolicyToRobot(Step):
    motor_names: list[str] = field(default_factory=list)

    def __call__(self, df: DataFrame) -> DataFrame:
        return _with(df, {f"{n}.pos": arrays.at(c(ACTION), i) for i, n in enumerate(self.motor_names)})


@Registry.register("joint_velocity_processor")
@dataclass
class JointVelocity(Step):
    """The state with its finite differences behind it."""

    dt: float = 0.1
    width: int = 6
    column: str = STATE

    def __call__(self, df: DataFrame) -> DataFrame:
        out = windows.joint_velocity(df, self.dt, self.width, self.column)
        return out.select(*[c(f"{self.column}_v").alias(n) if n == self.column else c(n) for n in df.columns])


@Registry.register("current_processor")
@dataclass
class MotorCurrents(Step):
    """The state with recorded motor currents behind it."""

    column: str = "observation.motor_currents"

    def __call__(self, df: DataFrame) -> DataFrame:
        return _with(df, {STATE: F.concat(c(STATE).cast("array<double>"), c(self.column).cast("array<double>"))})


# --- environments and devices ---


@Registry.register("libero_processor")
@dataclass
class LiberoState(Step):
    """Position, axis times angle and gripper joints of observation.robot_state as one vector; images turned by 180 degrees."""

    shapes: dict[str, list[int]] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        def turned(n: str, h: int, w: int, k: int) -> Column:
            return F.flatten(F.transform(F.sequence(F.lit(h * w - 1), F.lit(0)), lambda p: F.slice(c(n), p * k + 1, F.lit(k))))

        out = {n: turned(n, *shape) for n, shape in self.shapes.items() if n in df.columns}
        robot = "observation.robot_state"
        if robot not in df.columns:
            return _with(df, out)
        s = c(robot)
        parts = [s["eef"]["pos"].cast("array<double>"), arrays.quat_to_axis_angle(s["eef"]["quat"]), s["gripper"]["qpos"].cast("array<double>")]
        return _with(df, out | {STATE: F.concat(*parts).cast("array<float>")}).drop(robot)


@Registry.register("isaaclab_arena_processor")
@dataclass
class ArenaState(Step):
    """Named parts of the observation as one state vector, cameras under their image names."""

    state_keys: list[str] = field(default_factory=list)
    camera_keys: list[str] = field(default_factory=list)

    def __call__(self, df: DataFrame) -> DataFrame:
        have = [f"observation.{k}" for k in self.state_keys if f"observation.{k}" in df.columns]
        out = _with(df, {STATE: F.concat(*[c(n).cast("array<float>") for n in have])} if have else {}).drop(*[n for n in have if n != STATE])
        cameras = {f"observation.{k}": f"{IMAGES}{k}" for k in self.camera_keys}
        return out.select(*[c(n).alias(cameras.get(n, n)) for n in out.columns])


@Registry.register("add_teleop_action_as_complementary_data")
@dataclass
class TeleopAction(Step):
    """A recorded action of a device beside the frame's own."""

    column: str = "device.action"

    def __call__(self, df: DataFrame) -> DataFrame:
        return _with(df, {"complementary_info.teleop_action": c(self.column)})


@Registry.register("add_teleop_action_as_info")
@dataclass
class TeleopEvents(Step):
    """Recorded events of a device as info columns; an event that was not recorded is false."""

    prefix: str = "device."
    events: list[str] = field(default_factory=lambda: ["is_intervention", "terminate_episode", "success", "rerecord_episode"])

    def __call__(self, df: DataFrame) -> DataFrame:
        return _with(df, {f"info.{e}": F.coalesce(c(self.prefix + e).cast("boolean"), F.lit(False)) if self.prefix + e in df.columns else F.lit(False) for e in self.events})


@Registry.register("ee_reference_and_delta")
@dataclass
class ReferenceAndDelta(Step):
    """The end effector's target: a reference pose (latched when the command is enabled, or the present one) moved by scaled deltas; while disabled the reference stays."""

    end_effector_step_sizes: dict[str, float] = field(default_factory=lambda: {"x": 1.0, "y": 1.0, "z": 1.0})
    motor_names: list[str] = field(default_factory=list)
    use_latched_reference: bool = True
    use_ik_solution: bool = False
    pose: str = "observation.ee_pose"

    def __call__(self, df: DataFrame) -> DataFrame:
        on = F.coalesce(c("enabled"), F.lit(False))
        if self.use_latched_reference:
            out = windows.latched(df.withColumn("__on", on), "__on", c(self.pose), "__ref").drop("__on").withColumn("__ref", F.coalesce("__ref", c(self.pose)))
        else:
            out = df.withColumn("__ref", c(self.pose))
        moved = {f"ee.{k}": F.when(on, arrays.at(F.col("__ref"), i) + c(f"target_{k}") * self.end_effector_step_sizes[k]).otherwise(arrays.at(F.col("__ref"), i)) for i, k in enumerate("xyz")}
        return _with(out, moved).drop("__ref")


@Registry.register("ee_bounds_and_safety")
@dataclass
class BoundedTarget(Step):
    """Targets clipped to a box; ``ee.jumps`` where a target is farther from the one before than allowed."""

    end_effector_bounds: dict[str, list[float]] = field(default_factory=lambda: {"min": [-1.0] * 3, "max": [1.0] * 3})
    max_ee_step_m: float = 0.05

    def __call__(self, df: DataFrame) -> DataFrame:
        packed = df.withColumn("__ee", F.array(*[c(f"ee.{k}") for k in "xyz"]))
        out = windows.bounded_steps(packed, "__ee", self.end_effector_bounds["min"], self.end_effector_bounds["max"], self.max_ee_step_m)
        return _with(out, {f"ee.{k}": arrays.at(F.col("clipped"), i) for i, k in enumerate("xyz")} | {"ee.jumps": F.col("jumps")}).drop("__ee", "clipped", "jumps")


@Registry.register("gripper_velocity_to_joint")
@dataclass
class GripperVelocity(Step):
    """The gripper's position after its speed command."""

    speed_factor: float = 20.0
    clip_min: float = 0.0
    clip_max: float = 100.0
    discrete_gripper: bool = False
    position: str = "observation.gripper.pos"

    def __call__(self, df: DataFrame) -> DataFrame:
        return _with(df, {"ee.gripper_pos": arrays.gripper_position(c(self.position), c("gripper_vel"), self.speed_factor, self.clip_min, self.clip_max, self.discrete_gripper)})


@Registry.register("map_phone_action_to_robot_action")
@dataclass
class PhoneAction(Step):
    """A phone's pose and buttons as targets; ``platform`` ios has one slider, android two buttons."""

    platform: str = "ios"

    def __call__(self, df: DataFrame) -> DataFrame:
        up, down = (c("phone.slider"), F.lit(0.0)) if self.platform == "ios" else (c("phone.up"), c("phone.down"))
        t = arrays.phone_to_target(c("phone.enabled"), c("phone.pos"), c("phone.rot"), up, down)
        names = ["enabled", *[f"target_{k}" for k in ("x", "y", "z", "wx", "wy", "wz")], "gripper_vel"]
        return _with(df, {n: t[n] for n in names})


# --- images ---


@Registry.register("xvla_image_scale")
@dataclass
class ImageTimes255(Step):
    image_keys: list[str] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        return _with(df, {n: F.transform(c(n), lambda x: x.cast("double") * 255.0) for n in _images(df, self.image_keys)})


@Registry.register("xvla_image_to_float")
@dataclass
class ImageToFloat(Step):
    """Bytes over 255; values beyond 0 to 255 raise if ranges are checked."""

    image_keys: list[str] | None = None
    validate_range: bool = True

    def __call__(self, df: DataFrame) -> DataFrame:
        def one(n: str) -> Column:
            out = F.transform(c(n), lambda x: x.cast("double") / 255.0)
            if not self.validate_range:
                return out
            ok = F.assert_true(F.forall(c(n), lambda x: (x >= 0) & (x <= 255)), F.lit(f"{n} has values beyond 0 to 255"))
            return F.when(ok.isNull(), out)

        return _with(df, {n: one(n) for n in _images(df, self.image_keys)})


@Registry.register("xvla_imagenet_normalize")
@dataclass
class ImageNormalize(Step):
    """Channel by channel images of numbers in [0, 1] with the common means and deviations."""

    image_keys: list[str] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        def one(n: str) -> Column:
            per = (F.size(c(n)) / 3).cast("int")
            pick = lambda values, k: F.element_at(F.array(*[F.lit(x) for x in values]), k)
            return F.transform(c(n), lambda x, i: (x - pick(IMAGE_MEAN, F.floor(i / per).cast("int") + 1)) / pick(IMAGE_STD, F.floor(i / per).cast("int") + 1))

        return _with(df, {n: one(n) for n in _images(df, self.image_keys)})


@Registry.register("image_crop_resize_processor")
@dataclass
class CropResize(Step):
    """Rectangles (top, left, height, width) of images, then bilinear to ``resize_size``."""

    crop_params_dict: dict[str, list[int]] | None = None
    resize_size: list[int] | None = None
    shapes: dict[str, list[int]] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        out = {}
        for n, (h, w, k) in self.shapes.items():
            if n not in df.columns:
                continue
            x = c(n)
            if self.crop_params_dict and n in self.crop_params_dict:
                top, left, ch, cw = self.crop_params_dict[n]
                x, h, w = arrays.crop(x, h, w, k, top, left, ch, cw), min(h, top + ch) - top, min(w, left + cw) - left
            if self.resize_size:
                x = arrays.resize(x, h, w, k, *self.resize_size)
            out[n] = x
        return _with(df, out)


@Registry.register("observation_processor")
@dataclass
class VanillaObservation(Step):
    """Pictures as numbers in [0, 1], channel by channel, under image names; agent_pos as the state."""

    shapes: dict[str, list[int]] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        names = {"pixels": "observation.image", "agent_pos": STATE, "environment_state": "observation.environment_state"}
        names |= {n: IMAGES + n.removeprefix("pixels.") for n in df.columns if n.startswith("pixels.")}
        as_image = lambda n: arrays.image_to_chw(c(n), *self.shapes[n])
        return df.select(*[(as_image(n) if n in self.shapes else c(n).cast("array<float>") if n in ("agent_pos", "environment_state") else c(n)).alias(names.get(n, n)) for n in df.columns])


@Registry.register("pistar06_prepare_images")
@dataclass
class PrepareImages(Step):
    """The cameras wanted, as numbers in [0, 1]; a camera that is missing is an error unless all are."""

    camera_features: list[str] = field(default_factory=list)

    def __call__(self, df: DataFrame) -> DataFrame:
        have = [n for n in self.camera_features if n in df.columns]
        if not have and self.camera_features:
            raise ValueError(f"none of {self.camera_features} is there")
        return _with(df, {n: F.transform(c(n), lambda x: F.when(x > 1, x.cast("double") / 255.0).otherwise(x.cast("double"))) for n in have} | {f"{n}_mask": F.lit(n in have) for n in self.camera_features})
