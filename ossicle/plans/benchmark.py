"""Jobs: conditions times utterances, through transforms, to metric rows; and what follows from them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..functions.channel import DEFENSES
from ..functions.metrics import NAMES, Reference, all_metrics, stoi_proxy
from ..functions.psychoacoustic import budget_noise
from ..operators import grid, text

_KEYS = "condition_id kind transform_key family params_json margin_db utt_id spk".split()
_ROWS = "condition_id string, kind string, transform_key string, family string, params_json string, margin_db double, utt_id string, spk string, dur_s double, status string, error string, " + ", ".join(f"{n} double" for n in NAMES)


def matched_noise(x: np.ndarray, sr: int, seed: int) -> np.ndarray:
    """White noise with the energy of a perturbation at margin zero."""
    rng = np.random.default_rng(seed)
    noise = rng.standard_normal(len(x))
    return x + noise * np.linalg.norm(budget_noise(x, sr, rng, 0.0)) / max(np.linalg.norm(noise), 1e-12)


def process(x: np.ndarray, sr: int, kind: str, key: str, params: dict, seed: int) -> np.ndarray:
    if kind == "original":
        return x
    return matched_noise(x, sr, seed) if kind == "control" else registry.apply(key, x, sr, params, seed)


def measure(tasks: DataFrame) -> DataFrame:
    """Metric rows of tasks (see :func:`grid.tasks`); a failure is a row with status error.

    The waveforms end here.  Metrics that aren't finite become null.  Seeds come from the condition and the utterance.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def utterance(x: np.ndarray, tasks: list) -> list[list]:
            """The rows of conditions that share a waveform: it is looked at once, and what comes of it measured together."""
            heads, done, what = [], [], {}
            for i, r in enumerate(tasks):
                heads.append([getattr(r, k) for k in _KEYS[:6]] + [str(r.utt_id), r.spk, len(x) / r.sample_rate])
                try:
                    done.append((i, process(x, r.sample_rate, r.kind, r.transform_key, json.loads(r.params_json), registry.seed_of(r.condition_id, r.utt_id))))
                except Exception as e:  # noqa: BLE001  a row tells what went wrong
                    what[i] = f"{type(e).__name__}: {e}"[:200]
            table = np.full((len(tasks), len(NAMES)), np.nan)
            table[[i for i, _ in done]] = Reference(x, tasks[0].sample_rate).table([y for _, y in done]) if done else np.nan
            return [[*h, "error" if i in what else "ok", what.get(i), *(v if np.isfinite(v) else None for v in row)] for i, (h, row) in enumerate(zip(heads, table.tolist()))]

        for part in parts:
            rows, tasks, x = [], [], np.zeros(0)
            for r in part.itertuples(index=False):
                w = np.asarray(r.waveform if r.waveform is not None else [], float)
                if tasks and (tasks[0].sample_rate != r.sample_rate or not np.array_equal(x, w, equal_nan=True)):
                    rows += utterance(x, tasks)
                    tasks = []
                x = w
                tasks.append(r)
            rows += utterance(x, tasks) if tasks else []
            yield pd.DataFrame(rows, columns=[*_KEYS, "dur_s", "status", "error", *NAMES])

    return tasks.select(*_KEYS, "sample_rate", "waveform").mapInPandas(run, _ROWS)


def benchmark(spark: SparkSession, signals: DataFrame, keys: list[str] | None = None, done: DataFrame | None = None, sweep: bool = True) -> DataFrame:
    """The metric rows of all conditions for all signals but those that are done."""
    return measure(grid.tasks(grid.conditions(spark, keys, sweep), signals, done))


def transformed(signals: DataFrame, key: str, params: dict | None = None) -> DataFrame:
    """signals with one transform applied to the waveform."""
    registry.get(key)

    @F.pandas_udf("array<double>")
    def change(w: pd.Series, sr: pd.Series, utt: pd.Series) -> pd.Series:
        return pd.Series([registry.apply(key, np.asarray(x, float), r, params, registry.seed_of(key, u)) for x, r, u in zip(w, sr, utt)])

    return signals.withColumn("waveform", change("waveform", "sample_rate", "utt_id"))


def chained(signals: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    for key, params in steps:
        signals = transformed(signals, key, params)
    return signals


def register_sql(spark: SparkSession, keys: list[str] | None = None) -> None:
    """Each transform as a SQL function of a waveform and a rate, dots as underscores."""

    def of(key: str):
        def change(w: pd.Series, sr: pd.Series) -> pd.Series:
            return pd.Series([registry.apply(key, np.asarray(x, float), r) for x, r in zip(w, sr)])

        return F.pandas_udf(change, "array<double>")

    for key in keys or registry.keys():
        spark.udf.register(key.replace(".", "_"), of(key))


def defended(signals: DataFrame, key: str) -> DataFrame:
    """(utt_id, defense, before, after): likeness to the original of the transformed signal, and after a defence."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                x = np.asarray(r.waveform, float)
                y = registry.apply(key, x, r.sample_rate, None, registry.seed_of(key, r.utt_id))
                rows += [(str(r.utt_id), name, stoi_proxy(x, y), stoi_proxy(x, f(y, r.sample_rate))) for name, f in DEFENSES.items()]
            yield pd.DataFrame(rows, columns=["utt_id", "defense", "before", "after"])

    return signals.select("utt_id", "sample_rate", "waveform").mapInPandas(run, "utt_id string, defense string, before double, after double")


#: Recognisers by name: from a reference and the metadata columns to a hypothesis column.  The mock one is native.
RECOGNISERS: dict[str, Callable] = {"mock": lambda ref, masker_db, jitter_ms: text.mock_transcript(ref, masker_db, jitter_ms)}


def register_recogniser(name: str, hypothesis: Callable) -> None:
    if name in RECOGNISERS:
        raise ValueError(f"{name} is registered already")
    RECOGNISERS[name] = hypothesis


def recognised(transcripts: DataFrame, engines: list[str], ref: str = "ref") -> DataFrame:
    """transcripts with (engine, hyp, wer) for each engine."""
    if unknown := set(engines) - set(RECOGNISERS):
        raise ValueError(f"unknown engines {sorted(unknown)}")
    cells = F.array(*(F.struct(F.lit(e).alias("engine"), RECOGNISERS[e](F.col(ref), F.col("masker_db"), F.col("jitter_ms")).alias("hyp")) for e in engines))
    rows = transcripts.select("*", F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c")
    return rows.withColumn("wer", text.word_error_rate(F.col(ref), F.col("hyp")))


def run_config(spark: SparkSession, config: dict, signals: DataFrame) -> DataFrame:
    """A grid experiment: ``transform`` with ``parameters`` lists, or a list ``transforms`` of such."""
    specs = config.get("transforms") or [{"type": config["transform"], "parameters": config.get("parameters", {})}]
    names = {(i, k): v if isinstance(v, list) else [v] for i, s in enumerate(specs) for k, v in (s.get("parameters") or {}).items()}
    from ..functions.psychoacoustic import variants

    rows = []
    for n, combo in enumerate(variants({f"{i}.{k}": v for (i, k), v in names.items()})):
        steps = [(s["type"], {k.split(".", 1)[1]: v for k, v in combo.items() if k.startswith(f"{i}.")}) for i, s in enumerate(specs)]
        rows.append((n, json.dumps(steps, sort_keys=True)))
    conditions = spark.createDataFrame(rows, "condition_index long, steps string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                x = np.asarray(r.waveform, float)
                m = all_metrics(x, registry.chain([tuple(s) for s in json.loads(r.steps)], x, r.sample_rate, registry.seed_of(r.condition_index, r.utt_id)), r.sample_rate)
                out.append((r.condition_index, r.steps, str(r.utt_id), *(m[n] if np.isfinite(m[n]) else None for n in NAMES)))
            yield pd.DataFrame(out, columns=["condition_index", "steps", "utt_id", *NAMES])

    joined = signals.select("utt_id", "sample_rate", "waveform").join(F.broadcast(conditions))
    return joined.mapInPandas(run, "condition_index long, steps string, utt_id string, " + ", ".join(f"{n} double" for n in NAMES))
