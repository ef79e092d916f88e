"""Stateful streams: a sliding rate limit by client, and fact rows that append as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limited(requests: DataFrame, client: str, ts: str, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """A stream of (client, ts, accepted): at most ``limit`` accepted requests in any such span.

    A client's state is its accepted times of the last span, ``limit`` at most; it goes when the watermark has
    passed the span.  Requests later than ``late`` behind the newest are not answered.
    """
    if limit <= 0:
        return requests.select(F.col(client).cast("string").alias("client"), F.col(ts).alias("ts"), F.lit(True).alias("accepted"))

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        for part in parts:
            out = []
            for t in sorted(part["ts"]):
                now = t.value // 1000 if t.unit == "ns" else int(t.timestamp() * 1_000_000)
                kept = [k for k in kept if k > now - seconds * 1_000_000]
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(now)
            yield pd.DataFrame({"client": key[0], "ts": sorted(part["ts"]), "accepted": out})
        state.update((kept,))
        state.setTimeoutTimestamp(max([k // 1000 for k in kept] + [state.getCurrentWatermarkMs()]) + seconds * 1000)

    rows = requests.select(F.col(client).cast("string").alias("client"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("client").applyInPandasWithState(run, "client string, ts timestamp, accepted boolean", "kept array<long>", "append", "EventTimeTimeout")


def append_facts(rows: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """A query that appends streamed rows to a Parquet fact table, each key once."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            seen = spark.read.parquet(path).select(*keys)
            fresh = fresh.join(seen, keys, "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch makes the table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by hour and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
