"""Fact rows as CSV, experiment manifests as JSON, and exports of small tables."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ENGINES

TEXT = "condition_id kind transform_key family params_json margin_db utt_id spk dur_s status error snr_db stoi_proxy mbsd si_sdr_db rms_ratio ref_text".split()
COLUMNS = TEXT + [f"{p}_{e}" for p in ("wer", "hyp") for e in ENGINES]
NUMBERS = [*"margin_db dur_s snr_db stoi_proxy mbsd si_sdr_db rms_ratio".split(), *(f"wer_{e}" for e in ENGINES)]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The 25-column fact table: empty, NaN and infinite numbers are null."""
    raw = spark.read.option("header", "true").schema(", ".join(f"{c} string" for c in COLUMNS)).csv(path)
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') as double)")
    finite = lambda c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), number(c))
    return raw.withColumns({c: finite(c) for c in NUMBERS})


def append_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    w = rows.write.mode("append").option("header", "true")
    (w.partitionBy(by) if by else w).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(experiment_id, condition_index, sample_id, params, metric, value): nested and top-level metrics, top level first."""
    kind = "manifest_version string, experiment_id string, timestamp string, results array<struct<condition_index: long, condition_params: map<string,string>, sample_index: long, sample_id: string, metrics: map<string,double>, duration_seconds: double, snr_db: double, rmse: double, mse: double>>"
    m = spark.read.schema(kind).option("multiLine", "true").json(path).select("experiment_id", F.inline("results"))
    top = F.map_filter(F.create_map(*(x for n in ("snr_db", "rmse", "mse") for x in (F.lit(n), F.col(n)))), lambda _, v: v.isNotNull())
    nested = F.map_filter(F.coalesce("metrics", F.create_map().cast("map<string,double>")), lambda k, v: ~F.map_contains_key(top, k) & v.isNotNull())
    return m.select("experiment_id", "condition_index", "sample_id", F.col("condition_params").alias("params"), F.explode(F.map_concat(nested, top)).alias("metric", "value"))


def metric_columns(df: DataFrame) -> list[str]:
    """Numeric columns that aren't keys."""
    keys = {"condition_index", "sample_index", "sample_id", "seed", "duration_seconds", "margin_db", "utt_id", "spk", "condition_id"}
    return [c for c, t in df.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]


def clean(v):
    """A value for JSON: what isn't finite is null, sets are sorted lists."""
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, dict):
        return {str(k): clean(x) for k, x in v.items()}
    if isinstance(v, (set, frozenset)):
        return sorted(map(clean, v))
    if isinstance(v, (list, tuple)):
        return [clean(x) for x in v]
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


def fixed(v, digits: int = 3) -> str:
    return "—" if v is None or (isinstance(v, float) and not math.isfinite(v)) else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def _small(df: DataFrame, most: int = 10_000) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("exports are for small tables")
    return rows


def markdown(df: DataFrame, digits: int = 3) -> str:
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(fixed(v, digits) for v in r) + " |" for r in _small(df)])


def latex(df: DataFrame, digits: int = 3) -> str:
    def safe(s: str) -> str:
        for c in "&%#_":
            s = s.replace(c, "\\" + c)
        return s

    body = [" & ".join(safe(fixed(v, digits)) for v in r) + r" \\" for r in _small(df)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", " & ".join(map(safe, df.columns)) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])


def json_text(df: DataFrame) -> str:
    return json.dumps([clean(r.asDict(recursive=True)) for r in _small(df)], indent=1, sort_keys=True)


def write_responses(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("append").json(path)
