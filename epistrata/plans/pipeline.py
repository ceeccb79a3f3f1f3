"""Composable row transforms: a registry of named steps, pipelines of them, their schema function and their saved form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistrata.functions import arrays, text
from epistrata.runtime import c
from epistrata.sources.dataset import read_text, write_text

#: Saved options that concern devices, downloads or a model's feature list, not the data.
NO_MEANING = frozenset({"device", "kinematics", "robot", "teleop_device", "pretrained_path", "features", "norm_map", "normalize_observation_keys", "use_gripper", "success_threshold", "current_step", "tokenizer_assets_repo"})
Hook = Callable[[int, DataFrame], None]


class Registry:
    """Step classes by name; a name can be taken once."""

    _steps: ClassVar[dict[str, type["Step"]]] = {}

    @classmethod
    def register(cls, name: str) -> Callable[[type["Step"]], type["Step"]]:
        def add(step: type["Step"]) -> type["Step"]:
            if name in cls._steps:
                raise ValueError(f"{name} is registered")
            cls._steps[name] = step
            step.registry_name = name
            return step

        return add

    @classmethod
    def get(cls, name: str) -> type["Step"]:
        if name not in cls._steps:
            raise KeyError(f"{name} is not registered; there are {sorted(cls._steps)}")
        return cls._steps[name]

    @classmethod
    def names(cls) -> list[str]:
        return sorted(cls._steps)

    @classmethod
    def unregister(cls, name: str) -> None:
        cls._steps.pop(name)


class Step:
    """A DataFrame to DataFrame function with a configuration and, if it needs one, a state."""

    registry_name: ClassVar[str | None] = None
    #: Names that saved pipelines use for options here.
    aliases: ClassVar[dict[str, str]] = {}

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> "Step":
        """A step from saved options. Those of devices and downloads have no meaning here; any other that is not known is an error."""
        known = {f.name for f in fields(cls)} if is_dataclass(cls) else set()
        named = {cls.aliases.get(k, k): v for k, v in config.items()}
        if lost := sorted(k for k in named if k not in known and k not in NO_MEANING):
            raise TypeError(f"{cls.registry_name} has no option {lost}")
        return cls(**{k: v for k, v in named.items() if k in known})

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def config(self) -> dict[str, Any]:
        return asdict(self) if is_dataclass(self) else {}

    def state(self) -> dict[str, Any]:
        return {}

    def load_state(self, state: dict[str, Any]) -> None:
        pass


class PrefixStep(Step):
    """A step on the columns of one kind (observation., action, complementary_info., next.), one by one."""

    prefix: ClassVar[str] = ""

    def column(self, name: str, col: Column, kind: T.DataType) -> Column:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        out = [self.column(f.name, c(f.name), f.dataType).alias(f.name) if f.name.startswith(self.prefix) else c(f.name) for f in df.schema.fields]
        return df.select(*out)


class ObservationStep(PrefixStep):
    prefix = "observation."


class ActionStep(PrefixStep):
    prefix = "action"


class ComplementaryStep(PrefixStep):
    prefix = "complementary_info."


@dataclass
class Pipeline:
    """Steps in order. Lazy: nothing runs until the result is used."""

    steps: list[Step]
    name: str = "pipeline"
    before: list[Hook] = field(default_factory=list)
    after: list[Hook] = field(default_factory=list)

    def __call__(self, df: DataFrame) -> DataFrame:
        for df in self.step_through(df):
            pass
        return df

    def step_through(self, df: DataFrame) -> Iterator[DataFrame]:
        """The frame as it came in, then after each step."""
        yield df
        for i, step in enumerate(self.steps):
            for h in self.before:
                h(i, df)
            df = step(df)
            for h in self.after:
                h(i, df)
            yield df

    def __getitem__(self, i: int | slice) -> "Step | Pipeline":
        return Pipeline(self.steps[i], self.name, self.before, self.after) if isinstance(i, slice) else self.steps[i]

    def __len__(self) -> int:
        return len(self.steps)

    def schema(self, df: DataFrame) -> T.StructType:
        """Schema of the result; no row is read."""
        return self(df.limit(0)).schema

    def save(self, folder: str, spark: SparkSession | None = None) -> None:
        """<name>.json with the steps' configurations, and a state file for each step that has one, through Hadoop's file system: any folder Spark can write."""
        spark = spark or SparkSession.active()
        out = []
        for i, s in enumerate(self.steps):
            if s.registry_name is None:
                raise ValueError(f"step {i} is not registered")
            entry: dict[str, Any] = {"registry_name": s.registry_name, "config": s.config()}
            if state := s.state():
                entry["state_file"] = f"{self.name}_step_{i}_{s.registry_name}.json"
                write_text(spark, f"{folder}/{entry['state_file']}", json.dumps(state))
            out.append(entry)
        write_text(spark, f"{folder}/{self.name}.json", json.dumps({"name": self.name, "steps": out}, indent=2))

    @classmethod
    def load(cls, folder: str, name: str = "pipeline", overrides: dict[str, dict[str, Any]] | None = None, spark: SparkSession | None = None) -> "Pipeline":
        """A saved pipeline; overrides change a step's configuration by its name, and an override that fits no step is an error."""
        spark, left = spark or SparkSession.active(), dict(overrides or {})
        spec = json.loads(read_text(spark, f"{folder}/{name}.json"))
        steps = []
        for e in spec["steps"]:
            step = Registry.get(e["registry_name"]).from_config({**e["config"], **left.pop(e["registry_name"], {})})
            if "state_file" in e:
                step.load_state(json.loads(read_text(spark, f"{folder}/{e['state_file']}")))
            steps.append(step)
        if left:
            raise KeyError(f"overrides for no step: {sorted(left)}")
        return cls(steps, spec["name"])

    def hotswap_stats(self, stats: dict[str, dict[str, list[float]]]) -> "Pipeline":
        """The same pipeline with other statistics in its normalizing steps."""
        steps = []
        for s in self.steps:
            if isinstance(s, Normalize):
                s = type(s)(**{**s.config()})
                s.stats = stats
            steps.append(s)
        return Pipeline(steps, self.name, self.before, self.after)


@Registry.register("rename_observations_processor")
@dataclass
class Rename(Step):
    rename_map: dict[str, str] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.select(*[c(n).alias(self.rename_map.get(n, n)) for n in df.columns])

    def rename_stats(self, stats: dict[str, Any]) -> dict[str, Any]:
        return {self.rename_map.get(k, k): v for k, v in stats.items()}


@Registry.register("normalizer_processor")
@dataclass
class Normalize(Step):
    """Vectors by the statistics under their column's name; a column without statistics stays."""

    modes: dict[str, str] = field(default_factory=dict)
    eps: float = arrays.EPS
    inverse: ClassVar[bool] = False

    def __post_init__(self) -> None:
        self.stats: dict[str, dict[str, list[float]]] = {}

    def state(self) -> dict[str, Any]:
        return self.stats

    def load_state(self, state: dict[str, Any]) -> None:
        self.stats = state

    def __call__(self, df: DataFrame) -> DataFrame:
        todo = {n: m for n, m in self.modes.items() if n in df.columns and n in self.stats}
        return df.select(*[arrays.normalize(c(n), self.stats[n], todo[n], self.inverse, self.eps).alias(n) if n in todo else c(n) for n in df.columns])


@Registry.register("unnormalizer_processor")
@dataclass
class Unnormalize(Normalize):
    inverse: ClassVar[bool] = True


@Registry.register("device_processor")
@dataclass
class CastFloats(PrefixStep):
    """Floats to one width; devices have no meaning here."""

    float_dtype: str | None = "float"
    kinds: ClassVar[dict[str | None, str]] = {None: "float", "float": "float", "float32": "float", "double": "double", "float64": "double"}

    def column(self, name: str, col: Column, kind: T.DataType) -> Column:
        to = self.kinds[self.float_dtype]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            return col.cast(f"array<{to}>")
        return col.cast(to) if isinstance(kind, (T.FloatType, T.DoubleType)) else col


@Registry.register("add_domain_id")
@dataclass
class AddConstant(Step):
    name: str = "domain_id"
    value: int = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, F.lit(self.value))


@Registry.register("new_line_processor")
@dataclass
class Suffix(Step):
    column: str = "task"
    suffix: str = "\n"
    default: str | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, text.with_suffix(c(self.column), self.suffix, self.default))


@Registry.register("prepare_task_prompt")
@dataclass
class ValuePrompt(Step):
    column: str = "task"
    state_column: str | None = "state"
    width: int = 32

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, text.value_prompt(c(self.column), c(self.state_column) if self.state_column else None, self.width))


@Registry.register("map_tensor_to_delta_action_dict")
@dataclass
class VectorToNames(Step):
    column: str = "action"
    names: list[str] = field(default_factory=list)
    aliases: ClassVar[dict[str, str]] = {"motor_names": "names"}

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[arrays.at(c(self.column), i).alias(n) for i, n in enumerate(self.names)])


@Registry.register("robot_action_to_policy_action_processor")
@dataclass
class NamesToVector(Step):
    names: list[str] = field(default_factory=list)
    column: str = "action"
    aliases: ClassVar[dict[str, str]] = {"motor_names": "names"}

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.array(*[c(n).cast("double") for n in self.names]))


@Registry.register("map_delta_action_to_robot_action")
@dataclass
class DeltaToTarget(Step):
    position_scale: float = 1.0
    noise_threshold: float = 1e-3

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("target", arrays.delta_to_target(c("delta_x"), c("delta_y"), c("delta_z"), c("gripper"), self.position_scale, self.noise_threshold))


@Registry.register("time_limit_processor")
@dataclass
class TimeLimit(Step):
    max_episode_steps: int = 100

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("truncated", F.col("frame_index") + 1 >= self.max_episode_steps)


@Registry.register("gripper_penalty_processor")
@dataclass
class GripperPenalty(Step):
    penalty: float = -0.01
    max_gripper_pos: float = 30.0

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("discrete_penalty", arrays.gripper_penalty(c("gripper_pos"), c("gripper_action"), self.penalty, self.max_gripper_pos))


@Registry.register("intervention_action_processor")
@dataclass
class Intervention(Step):
    """The teleoperator's action where a human intervenes; done on termination, and on success if wanted; reward is success."""

    terminate_on_success: bool = True

    def __call__(self, df: DataFrame) -> DataFrame:
        act = F.when(c("is_intervention") & c("teleop_action").isNotNull(), c("teleop_action")).otherwise(c("action"))
        done = c("terminate") | (c("success") if self.terminate_on_success else F.lit(False))
        return df.withColumns({"action": act, "done": done, "reward": c("success").cast("double")})


@Registry.register("reward_classifier_processor")
@dataclass
class RewardClassifier(Step):
    """Reward and done where the predicted success is 1 to within 0.01."""

    success_reward: float = 1.0
    terminate_on_success: bool = True

    def __call__(self, df: DataFrame) -> DataFrame:
        hit = F.coalesce(F.abs(c("predicted") - 1.0) <= 0.01, F.lit(False))
        done = F.coalesce(c("done"), F.lit(False)) | (hit & F.lit(self.terminate_on_success))
        return df.withColumns({"reward": F.when(hit, self.success_reward).otherwise(c("reward")), "done": done})


@Registry.register("state_processor")
@dataclass
class ConcatState(Step):
    """State parts, nested or not, joined into one vector."""

    parts: list[str] = field(default_factory=list)
    to: str = "observation.state"

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.to, F.concat(*[F.col(p).cast("array<double>") for p in self.parts]))


#: Where models keep statistics; of several that fit a key the first counts. One is spelt as models were saved.
STATS_PREFIXES = ("normalize_inputs.buffer_", "unnormalize_outputs.buffer_", "normalize_targets.buffer_", "normalize.", "unnormalize.", "input_normalizer.", "output_normalizer.", "normalalize_inputs.", "normalize_inputs.", "unnormalize_outputs.", "normalize_targets.", "unnormalize_targets.")


def migrated_stats(state: dict[str, list[float]]) -> dict[str, dict[str, list[float]]]:
    """Statistics inside a model's state, keys like ``normalize_inputs.buffer_observation_state.mean``, as feature -> stat; underscores become dots, and of keys for one statistic the last counts.

    A key that speaks of normalizing but has no known prefix or no feature's name is an error: statistics do not vanish. Other weights are passed over.
    """
    out: dict[str, dict[str, list[float]]] = {}
    lost = []
    for key, v in state.items():
        tail = next((key.removeprefix(p) for p in STATS_PREFIXES if key.startswith(p)), "")
        name, _, stat = tail.rpartition(".")
        if name:
            out.setdefault(name.replace("_", "."), {})[stat] = v
        elif "normalize" in key.split(".")[0]:
            lost.append(key)
    if lost:
        raise ValueError(f"statistics under unknown keys: {sorted(lost)}")
    return out


#: How an old and a new action for one step become one.
AGGREGATES: dict[str, tuple[float, float]] = {"weighted_average": (0.3, 0.7), "latest_only": (0.0, 1.0), "average": (0.5, 0.5), "conservative": (0.7, 0.3)}


def row_callable(df: DataFrame, name: str, kind: str, f: Callable[[dict[str, Any], int, int], Any]) -> DataFrame:
    """Adds a column computed by any Python function of (row, episode, frame), in Arrow batches."""

    def run(it):
        for pdf in it:
            rows = pdf.to_dict("records")
            pdf[name] = [f(r, r["episode_index"], r["frame_index"]) for r in rows]
            yield pdf

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))
