"""Command line: edit, acp, report, label and convert datasets on disk."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.operators import advantage, metrics, stats
from epistrata.operators import episodes as ops
from epistrata.runtime import c
from epistrata.session import local_session
from epistrata.sources import dataset


#: Columns every dataset has; they have no statistics.
KEYS = ("index", "episode_index", "frame_index", "timestamp", "task_index")


def _load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return dataset.scan_frames(spark, root), dataset.scan_episodes(spark, root, stats=True), dataset.scan_tasks(spark, root)


def _stats(frames: DataFrame, features: dict[str, dict], old: dict[str, dict]) -> dict[str, dict]:
    """Statistics of the frames' numeric features as lists by name; those of media are carried over."""
    numeric = [n for n, s in features.items() if n in frames.columns and n not in KEYS and s["dtype"] not in ("video", "image", "string", "bool") and len(s.get("shape") or (1,)) == 1]
    out = {n: old[n] for n, s in features.items() if n in old and s["dtype"] in ("video", "image")}
    if not numeric:
        return out
    for r in stats.feature_stats(frames, numeric).orderBy("feature", "dim").collect():  # a row a dimension of the schema
        for k in ("min", "max", "mean", "std", "count", *stats.NAMES):
            out.setdefault(r["feature"], {}).setdefault(k, []).append(r[k])
    return out


def _save(spark: SparkSession, target: str, source: str, frames: DataFrame, episodes: DataFrame, tasks: DataFrame, dropped: Sequence[str] = (), split: str = "train") -> None:
    """Frames, episodes with all their columns, tasks, info with totals and splits, recomputed statistics, and the media files."""
    dataset.write_frames(frames, target)
    written = dataset.scan_frames(spark, target)
    info = dataset.scan_info(spark, source)
    info["features"] = {n: {**s, "shape": list(s["shape"])} for n, s in info.get("features", {}).items() if n not in dropped}
    old = json.loads(dataset.read_text(spark, f"{source}/meta/stats.json")) if dataset.exists(spark, f"{source}/meta/stats.json") else {}
    n = episodes.agg(F.count(F.lit(1)).alias("e"), F.coalesce(F.sum("length"), F.lit(0)).alias("f")).first()
    info |= {"total_episodes": n["e"], "total_frames": n["f"], "total_tasks": tasks.count(), "splits": {split: f"0:{n['e']}"}}
    dataset.write_meta(spark, target, info, tasks, episodes, _stats(written, info["features"], old))
    if source != target and dataset.exists(spark, f"{source}/videos"):
        dataset.copy_folder(spark, f"{source}/videos", f"{target}/videos")


def _only(frames: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of these episodes and the episodes themselves under dense new keys; every column of an episode but its places in old files is kept."""
    lengths = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("__n"))
    e = episodes.dropDuplicates(["episode_index"]).join(lengths, ["episode_index"], "left").withColumn("length", F.coalesce("__n", F.lit(0)))
    keys = ops.dense_episodes(e.select("episode_index", "length"))
    stale = [n for n in e.columns if n.startswith(("data/", "meta/")) or n in ("__n", "dataset_from_index", "dataset_to_index")]
    named = keys.select("episode_index", "new_index", F.col("from_index").alias("dataset_from_index"), F.col("to_index").alias("dataset_to_index"))
    out = e.drop(*stale).join(named, ["episode_index"]).withColumn("episode_index", F.col("new_index")).drop("new_index")
    return ops.reindex(frames, keys=keys).drop("old_episode_index"), out


def merge(spark: SparkSession, roots: Sequence[str], target: str) -> str:
    """Datasets of one frame rate and one set of features as one: keys by running totals, tasks by their text, episodes with the columns of all."""
    infos = [dataset.scan_info(spark, r) for r in roots]
    for r, i in zip(roots[1:], infos[1:]):
        if i.get("fps") != infos[0].get("fps") or i.get("features") != infos[0].get("features"):
            raise ValueError(f"{r} differs from {roots[0]} in fps or features")
        if dataset.exists(spark, f"{r}/videos"):
            raise ValueError("datasets with videos need a codec to be merged")
    parts, every = [], None
    shift = 0
    for r in roots:
        f, e = _only(*_load(spark, r)[:2])
        parts.append((f, e, dataset.scan_tasks(spark, r)))
        moved = e.withColumn("episode_index", F.col("episode_index") + shift)
        every = moved if every is None else every.unionByName(moved, allowMissingColumns=True)
        shift += e.count()
    frames, tasks = ops.merge_datasets(parts)
    _save(spark, target, roots[0], frames, dataset.episode_rows(every), tasks)
    return target


def edit(spark: SparkSession, root: str, out: str | None, operation: str, episodes: str = "", task: str | None = None, features: Sequence[str] = (), splits: dict[str, float] | None = None, others: Sequence[str] = ()) -> list[str]:
    """delete_episodes, split, merge (with ``others``), remove_feature or modify_tasks. Without ``out`` the old folder is renamed to <root>_old and the new one takes its place.

    Episodes keep every column; statistics are computed anew, splits and totals follow the rows, media files are copied as they are.
    """
    if out is None and operation in ("delete_episodes", "remove_feature", "modify_tasks") and dataset.exists(spark, f"{root}_old"):
        raise ValueError(f"{root}_old is in the way")
    f, e, t = _load(spark, root)
    target = out or f"{root}_new"
    if operation == "merge":
        if out is None:
            raise ValueError("a merge needs a folder of its own")
        return [merge(spark, [root, *others], out)]
    if operation == "split":
        ranges = ops.fraction_ranges(e.count(), splits or {})
        pos = ops.dense_episodes(e)
        made = []
        for name, (a, b) in ranges.items():
            part = e.join(pos.filter((F.col("new_index") >= a) & (F.col("new_index") < b)).select("episode_index"), ["episode_index"], "left_semi")
            made.append(f"{out or root}_{name}")
            _save(spark, made[-1], root, *_only(f.join(part.select("episode_index"), ["episode_index"], "left_semi"), part), t, split=name)
        return made
    if operation == "delete_episodes":
        ranges = ops.parse_episode_spec(episodes)
        unknown = sum(b - a + 1 for a, b in ranges) - e.filter(ops.in_ranges(ranges)).select("episode_index").distinct().count()
        left = e.filter(~ops.in_ranges(ranges))
        if unknown or not left.limit(1).count():
            raise ValueError(f"{unknown} unknown episodes" if unknown else "all episodes would be deleted")
        _save(spark, target, root, *_only(f.filter(~ops.in_ranges(ranges)), left), t)
    elif operation == "remove_feature":
        kept = [n for n in e.columns if not any(n.startswith((f"stats/{x}/", f"videos/{x}/")) for x in features)]
        _save(spark, target, root, ops.remove_features(f, features), e.select(*[c(n) for n in kept]), t, features)
    elif operation == "modify_tasks":
        new = ops.retask(e, task)
        texts = new.select("task", "task_index").distinct()
        moved = f.drop("task_index").join(new.select("episode_index", "task_index"), ["episode_index"])
        _save(spark, target, root, moved, e.drop("tasks").join(new.select("episode_index", F.array("task").alias("tasks")), ["episode_index"]), texts)
    else:
        raise ValueError(f"unknown operation: {operation}")
    if out is not None:
        return [target]
    fs, p = dataset._fs(spark, root)
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.rename(p, P(f"{root}_old"))
    fs.rename(P(target), p)
    return [root]


def acp(spark: SparkSession, root: str, value: str, success: str = "episode_success", n_step: int = 50, ratio: float = 0.3) -> None:
    """Write advantage and indicator columns beside an existing value column."""
    f, e, _ = _load(spark, root)
    e = e.withColumn("success", F.lower(F.trim(success)) == "success")
    human = F.col("`complementary_info.is_intervention`") if "complementary_info.is_intervention" in f.columns else F.lit(0.0)
    df = advantage.annotate(f.withColumn("value", F.col(f"`{value}`").cast("double")).withColumn("intervention", human), e, n_step, ratio)
    new = df.select("index", F.col("advantage").cast("float").alias("complementary_info.advantage"), F.col("indicator").cast("bigint").alias("complementary_info.acp_indicator"))
    dataset.update_columns(spark, root, new, {"complementary_info.advantage": float("nan"), "complementary_info.acp_indicator": 0})


def report(spark: SparkSession, root: str, fps: float) -> str:
    f, e, _ = _load(spark, root)
    label = F.lower(F.trim("episode_success")) if "episode_success" in e.columns else F.lit(None).cast("string")
    human = F.col("`complementary_info.is_intervention`") if "complementary_info.is_intervention" in f.columns else F.lit(0.0)
    e = e.withColumn("label", label).withColumn("fps", F.lit(fps))
    return metrics.text_report(metrics.dataset_report(f.withColumn("intervention", human), e), e)


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="epistrata", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("edit")
    a.add_argument("root")
    a.add_argument("operation", choices=["delete_episodes", "split", "merge", "remove_feature", "modify_tasks"])
    a.add_argument("--out")
    a.add_argument("--episodes", default="")
    a.add_argument("--task")
    a.add_argument("--features", nargs="*", default=[])
    a.add_argument("--splits", type=json.loads)
    a.add_argument("--others", nargs="*", default=[])
    a = sub.add_parser("acp")
    a.add_argument("root")
    a.add_argument("--value", required=True)
    a.add_argument("--n-step", type=int, default=50)
    a.add_argument("--ratio", type=float, default=0.3)
    a = sub.add_parser("report")
    a.add_argument("root")
    a.add_argument("--fps", type=float, default=30.0)
    a = sub.add_parser("convert")
    a.add_argument("old")
    a.add_argument("new")
    x = p.parse_args(argv)
    spark = local_session()
    if x.command == "edit":
        print(*edit(spark, x.root, x.out, x.operation, x.episodes, x.task, x.features, x.splits, x.others), sep="\n")
    elif x.command == "acp":
        acp(spark, x.root, x.value, n_step=x.n_step, ratio=x.ratio)
    elif x.command == "report":
        print(report(spark, x.root, x.fps))
    else:
        dataset.convert_per_episode_layout(spark, x.old, x.new)


if __name__ == "__main__":
    main()
