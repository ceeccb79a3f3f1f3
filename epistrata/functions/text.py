"""Column expressions over task texts, prompts, labels and JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistrata.functions import arrays

#: Spellings of the two outcome labels.
SUCCESS_WORDS = ["success", "true", "1", "s"]
FAILURE_WORDS = ["failure", "false", "0", "f"]
POSITIVE_TAG = "Advantage: positive"
NEGATIVE_TAG = "Advantage: negative"


def advantage_tag(task: Column, positive: Column) -> Column:
    """The task with a line that says whether its advantage is positive; the line alone if the task is empty."""
    tag = F.when(positive, POSITIVE_TAG).otherwise(NEGATIVE_TAG)
    return F.when(F.coalesce(task, F.lit("")) == "", tag).otherwise(F.concat(task, F.lit("\n"), tag))


def hash_number(*keys: Column, seed: int) -> Column:
    """A whole number below 2^52 that depends on the keys and the seed only: the first 13 hexadecimal digits of their MD5. SQL engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed)))), 1, 13), 16, 10).cast("long")


def hash_uniform(*keys: Column, seed: int) -> Column:
    """A number in [0, 1) by hash: what a random draw is here."""
    return hash_number(*keys, seed=seed) / float(1 << 52)


def tagged_or_dropped(task: Column, indicator: Column, key: Column, drop: float, seed: int) -> Column:
    """advantage_tag, left off with probability ``drop`` drawn from the key. An indicator other than 0 and 1 raises."""
    legal = F.assert_true(indicator.isin(0, 1), F.concat(F.lit("the indicator must be 0 or 1, not "), indicator.cast("string")))
    return F.when(legal.isNotNull(), task).when(hash_uniform(key, seed=seed) < drop, task).otherwise(advantage_tag(task, indicator == 1))


def clean_prompt(task: Column) -> Column:
    """Outer white space off, underscores and line ends to blanks."""
    outer = r"^\s+|\s+$"
    return F.regexp_replace(F.translate(F.regexp_replace(task, outer, ""), "_\n", "  "), outer, "")


def state_bins(state: Column, width: int, bins: int = 256) -> Column:
    """Blank-separated bins of a state padded with zeros to width."""
    return F.array_join(F.transform(arrays.pad(state, width), lambda x: arrays.digitize(x, bins).cast("string")), " ")


def value_prompt(task: Column, state: Column | None, width: int = 32) -> Column:
    head = F.concat(F.lit("Task: "), clean_prompt(task))
    return F.concat(head, F.lit(", State: "), state_bins(state, width), F.lit("\nValue: ")) if state is not None else F.concat(head, F.lit("\nValue: "))


def action_prompt(task: Column, state: Column, width: int = 32, ending: str = ";\nAction: ") -> Column:
    """Prompt of an action model; the fast variant ends after ``;\\n``."""
    return F.concat(F.lit("Task: "), clean_prompt(task), F.lit(", State: "), state_bins(state, width), F.lit(ending))


def with_suffix(text: Column, suffix: str = "\n", default: str | None = None) -> Column:
    """The text ending in the suffix; a default where it is null."""
    x = F.coalesce(text, F.lit(default)) if default is not None else text
    return F.when(x.endswith(suffix), x).otherwise(F.concat(x, F.lit(suffix)))


def formalize(text: Column, default: str = "perform the task") -> Column:
    """Lower case, letters, digits and white space only."""
    return F.regexp_replace(F.lower(F.coalesce(F.nullif(text, F.lit("")), F.lit(default))), r"[^\p{L}\p{N}\s]", "")


def outcome(label: Column) -> Column:
    """success or failure for their spellings, other labels in lower case."""
    x = F.lower(F.trim(label.cast("string")))
    return F.when(x.isin(SUCCESS_WORDS), "success").when(x.isin(FAILURE_WORDS), "failure").otherwise(x)


def label_or_unlabeled(label: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(label)), F.lit("")), F.lit("unlabeled"))


def seconds_of(clock: Column) -> Column:
    """Seconds of MM:SS or SS."""
    p = F.split(clock, ":")
    return F.when(F.size(p) > 1, F.get(p, F.lit(0)).cast("int") * 60 + F.get(p, F.lit(1)).cast("int")).otherwise(F.get(p, F.lit(0)).cast("int"))


def clock_of(seconds: Column) -> Column:
    """MM:SS of seconds, cut to whole ones."""
    s = seconds.cast("long")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def episode_of_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"episode_(\d+)", 1), F.lit("")).cast("long")


def repaired_json(text: Column) -> Column:
    """The outermost object in a model's answer, without code fences and with bad unicode escapes doubled; null if there is none."""
    body = F.regexp_replace(text, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    fixed = F.regexp_replace(inner, r"\\u(?![0-9a-fA-F]{4})", r"\\\\u")
    return F.nullif(fixed, F.lit(""))


def response_text(response: Column) -> Column:
    """The text parts of a model's JSON answer, joined."""
    parts = F.from_json(response, "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>")
    return F.array_join(F.transform(F.filter(F.flatten(parts["candidates"]["content"]["parts"]), lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")


def elapsed_parts(seconds: Column) -> Column:
    """struct(days, hours, minutes, seconds)."""
    s = seconds.cast("double")
    day = F.floor(s / 86400)
    hour = F.floor((s - day * 86400) / 3600)
    minute = F.floor((s - day * 86400 - hour * 3600) / 60)
    return F.struct(day.cast("long").alias("days"), hour.cast("long").alias("hours"), minute.cast("long").alias("minutes"), (s - day * 86400 - hour * 3600 - minute * 60).alias("seconds"))


def big_number(x: Column, digits: int = 0) -> Column:
    """1234 as 1K: the number over the largest power of 1000 below it, with its letter."""
    out = F.format_string(f"%.{digits}f", x.cast("double"))
    for k, letter in enumerate("KMBTQ", start=1):
        out = F.when(F.abs(x) >= 1000**k, F.concat(F.format_string(f"%.{digits}f", x / float(1000**k)), F.lit(letter))).otherwise(out)
    return out


def flat_tasks(tasks: Column) -> Column:
    """Texts of a list of tasks, trimmed, without empty ones."""
    return F.filter(F.transform(tasks, lambda t: F.trim(t)), lambda t: t != "")


def tokenized(text: Column, encode: Callable[[str], list[int]], width: int, pad_id: int = 0) -> Column:
    """struct(ids, mask) by any tokenizer, padded or cut to width; in Arrow batches."""

    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.BooleanType()))]))
    def run(s: pd.Series) -> pd.DataFrame:
        ids = [encode(x or "")[:width] for x in s]
        return pd.DataFrame({"ids": [i + [pad_id] * (width - len(i)) for i in ids], "mask": [[True] * len(i) + [False] * (width - len(i)) for i in ids]})

    return run(text)


def action_token_ids(tokens: Column, vocabulary: int, skip: int, prefix: Sequence[int], end: Sequence[int], width: int, pad_id: int = 0) -> Column:
    """struct(ids, mask): prefix, each action token mapped to vocabulary - 1 - skip - token, end; padded or cut to width."""
    body = F.concat(F.array(*[F.lit(int(p)) for p in prefix]), F.transform(tokens, lambda t: (F.lit(vocabulary - 1 - skip) - t).cast("int")), F.array(*[F.lit(int(p)) for p in end]))
    n = F.least(F.size(body), F.lit(width))
    ids = F.slice(F.concat(body, F.array_repeat(F.lit(pad_id), width)), 1, width)
    return F.struct(ids.alias("ids"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: k <= n).alias("mask"))


def picked(words: Sequence[str], key: Column, seed: int) -> Column:
    """One of the words, by a hash of the key."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(hash_number(key, seed=seed), F.lit(len(words))) + 1).cast("int"))
