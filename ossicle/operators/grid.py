"""Parameter grids, conditions and what is left to do."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..functions.psychoacoustic import variants

SWEEP_KEYS = [f"psychoacoustic.{k}" for k in "masked_noise bark_perturbation erb_perturbation frame_budget".split()]
MARGINS = [0.0, 5.0, *(10.0 * i for i in range(1, 6))]
_CONDITION = "condition_id string, kind string, transform_key string, family string, params_json string, margin_db double"


def parameter_grid(spark: SparkSession, grid: dict[str, list[Any]]) -> DataFrame:
    """(condition_index, params_json) of all combinations."""
    rows = [(i, json.dumps(p, sort_keys=True)) for i, p in enumerate(variants(grid))]
    return spark.createDataFrame(rows, "condition_index long, params_json string")


def condition_list(keys: list[str] | None = None, sweep: bool = True) -> list[tuple]:
    """The original, each transform with its defaults, margin sweeps and a control; equal (key, parameters) once."""
    out = [("original", "original", "baseline.identity", "O", "{}", None)]
    seen = set()

    def add(name, kind, key, params, margin=None):
        t = registry.get(key)
        mark = (key, json.dumps(t.defaults | params, sort_keys=True))
        if mark not in seen:
            seen.add(mark)
            out.append((name, kind, key, t.family, json.dumps(params, sort_keys=True), margin))

    for key in keys or registry.keys():
        add(key, "transform", key, {})
    if sweep:
        for key in SWEEP_KEYS:
            for m in MARGINS:
                add(f"sweep.{key}.{m:g}", "sweep", key, {"margin_db": m}, m)
        out.append(("control.white_matched", "control", "noise.white", "E", "{}", None))
    return out


def conditions(spark: SparkSession, keys: list[str] | None = None, sweep: bool = True) -> DataFrame:
    return spark.createDataFrame(condition_list(keys, sweep), _CONDITION)


def tasks(conditions: DataFrame, utterances: DataFrame, done: DataFrame | None = None, utt: str = "utt_id") -> DataFrame:
    """Every condition for every utterance but those in done; conditions are a bounded list."""
    out = utterances.join(F.broadcast(conditions))
    return out if done is None else out.join(done.select("condition_id", utt).distinct(), ["condition_id", utt], "left_anti")


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(k, t.family, t.description, json.dumps(t.defaults, sort_keys=True)) for k, t in sorted(registry.load().items())]
    return spark.createDataFrame(rows, "key string, family string, description string, defaults_json string")


def family_counts(spark: SparkSession) -> DataFrame:
    families = spark.createDataFrame(list(registry.FAMILIES.items()), "family string, name string")
    return families.join(catalog(spark).groupBy("family").count(), "family", "left").select("family", "name", F.coalesce("count", F.lit(0)).alias("n"))
