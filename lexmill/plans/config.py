"""Configurations as rows: inheritance, flattening, differences, rules."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OVERRIDE = "_override_"
# Environment variables of data folders, and where the data are by default.
DATA_DIRS = {"GSM8K_DATA_DIR": "datasets/gsm8k", "ALPACA_DATA_DIR": "datasets/alpaca", "QA_RL_DATA_DIR": "datasets/qa_rl"}


def merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``; a section that is marked replaces its other."""
    if over.get(OVERRIDE):
        return {k: v for k, v in over.items() if k != OVERRIDE}
    both = lambda k: merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over[k], dict) else _bare(over[k])
    return {**base, **{k: both(k) for k in over if k != OVERRIDE}}


def _bare(value: Any) -> Any:
    return merge({}, value) if isinstance(value, dict) else value


def resolve(path: str | Path, load=None) -> dict:
    """A YAML file with the files that it names as defaults below it."""
    if load is None:
        import yaml

        load = yaml.safe_load
    path = Path(path)
    own = load(path.read_text(encoding="utf-8")) or {}
    parents = own.pop("defaults", None) or []
    out: dict = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        out = merge(out, resolve(path.parent / parent, load))
    return merge(out, own)


def flatten(value: Any, prefix: str = "", lists: bool = True) -> dict[str, str]:
    """Dotted paths to strings: ``a.b``, ``c[0]``; null is "null"."""
    if isinstance(value, dict) and (value or not prefix):
        parts = ((f"{prefix}.{k}" if prefix else str(k), v) for k, v in value.items())
    elif lists and isinstance(value, list) and value:
        parts = ((f"{prefix}[{i}]", v) for i, v in enumerate(value))
    else:
        return {prefix: "null" if value is None else str(value)}
    return {k: v for path, x in parts for k, v in flatten(x, path, lists).items()}


def frame(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    """(name, path, value) of a few configurations."""
    rows = [(name, p, v) for name, c in configs.items() for p, v in flatten(c).items()]
    return spark.createDataFrame(rows, "name string, path string, value string")


def flatten_json(json: Column) -> Column:
    """A JSON document's scalar leaves as a map of paths (``a.b``, ``c[0]``) to
    strings, objects and lists at any depth; null is "null". Empty objects and
    lists have no leaves. Levels are opened one after the other, as many as the
    document's brackets can nest."""
    names = "map<string,string>"
    start = F.struct(F.array(F.struct(F.lit("").alias("key"), json.alias("value"))).alias("open"), F.array().cast("array<struct<key:string,value:string>>").alias("done"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    opens = lambda v: F.coalesce(F.substr(F.ltrim(v), F.lit(1), F.lit(1)), F.lit(""))

    def inner(e: Column) -> Column:
        dot = F.when(e["key"] == "", "").otherwise(F.concat(e["key"], F.lit(".")))
        fields = F.transform(F.coalesce(F.map_entries(F.from_json(e["value"], names)), none), lambda x: F.struct(F.concat(dot, x["key"]).alias("key"), x["value"].alias("value")))
        items = F.transform(F.coalesce(F.from_json(e["value"], "array<string>"), F.array().cast("array<string>")), lambda x, k: F.struct(F.concat(e["key"], F.lit("["), k.cast("string"), F.lit("]")).alias("key"), x.alias("value")))
        return F.when(opens(e["value"]) == "{", fields).otherwise(items)

    nested = lambda e: opens(e["value"]).isin("{", "[")
    leaf = lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("null")).alias("value"))

    def level(s: Column, _: Column) -> Column:
        more = F.flatten(F.transform(F.filter(s["open"], nested), inner))
        return F.struct(more.alias("open"), F.concat(s["done"], F.transform(F.filter(s["open"], lambda e: ~nested(e)), leaf)).alias("done"))

    depth = F.coalesce(F.regexp_count(json, F.lit(r"[\[{]")), F.lit(0)) + 1
    done = F.aggregate(F.sequence(F.lit(1), depth), start, level, lambda s: s["done"])
    return F.map_from_entries(F.when(json.isNotNull(), done))


def layered(rows: DataFrame, priority: str, keys: list[str], path: str = "path", value: str = "value") -> DataFrame:
    """Flattened layers merged: the layer with the highest priority sets a path."""
    return rows.groupBy(*keys, path).agg(F.max_by(value, priority).alias(value))


def difference(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, change (changed, only_left, only_right), left_value, right_value."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    change = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "changed")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", "left_value", "right_value")


def whole(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).cast("long"))


def violations(configs: DataFrame, name: str = "name") -> DataFrame:
    """(name, level, rule) of the rules that a configuration breaks; configs
    has a map of paths. Values that are not plain numbers are passed over."""
    at = lambda p: whole(F.col("conf")[p])
    prompts, answers, batch = at("grpo.num_prompts_per_step"), at("grpo.num_generations_per_prompt"), at("policy.train_global_batch_size")
    rules = [
        ("error", "batch_product", batch != prompts * answers),
        ("error", "val_batch", at("grpo.val_batch_size") > at("grpo.max_val_samples")),
        ("error", "max_num_steps", at("grpo.max_num_steps") <= 0),
        ("error", "val_period", at("grpo.val_period") <= 0),
        ("error", "max_total_sequence_length", at("policy.max_total_sequence_length") <= 0),
    ]
    made = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.coalesce(broken, F.lit(False)).alias("broken")) for level, rule, broken in rules))
    return configs.select(name, F.explode(F.filter(made, lambda r: r["broken"])).alias("r")).select(name, "r.level", "r.rule")


def data_path(raw: Column, root: str) -> Column:
    """A local path for a configured one; null if other variables are in it."""
    out = F.when(F.contains(raw, F.lit("${")), None).when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(root + "/"), raw))
    for var, folder in DATA_DIRS.items():
        for mark in (f"${{oc.env:{var}}}", f"${{{var}}}"):
            rest = F.regexp_replace(F.substr(raw, F.lit(len(mark) + 1)), "^/+", "")
            out = F.when(raw.startswith(mark), F.concat(F.lit(f"{root}/{folder}/"), rest)).otherwise(out)
    return F.when(raw != "", out)


def missing_files(paths: dict[str, str]) -> list[tuple[str, str]]:
    return [("warn", name) for name, p in paths.items() if not os.path.exists(p)]
