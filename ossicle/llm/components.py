"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace


def _toward(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over (u, v): link neighbours of u to the least of u and its neighbours.

    ``larger`` links the neighbours above u; otherwise edges run from the larger end
    u to the smaller v, and u and all its neighbours are linked.
    """
    if larger:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = edges.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        out = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where("u > v").distinct()


def components(edges: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """(u, v): each linked node u with the smallest node v of its component, which has no row itself.

    edges: two long columns u and v, without nulls; their direction and repeats don't
    matter.  Alternating large-star and small-star steps (Kiveris et al., 2014), each
    round one written table.  Nothing is collected but a count and a checksum.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = work.write(edges, "edges0")
    seen = None
    for i in range(1, most_rounds + 1):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now
        seen = state
        now = work.write(_toward(_toward(now, True), False), f"edges{i}")
        work.drop(f"edges{i - 1}")
    raise RuntimeError("components did not settle")
