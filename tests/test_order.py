"""Results don't hang on the order in which sums were added up."""

import random

import numpy as np
from pyspark.sql import functions as F

from ossicle import queries
from ossicle.operators import summary


def added(xs):
    total = 0.0
    for x in xs:
        total += x
    return total


def test_halves_are_settled_alike_in_any_order(spark):
    rng, cases = random.Random(1), []
    while len(cases) < 20:  # means that end in a half of the last digit and fall on both sides of it by order
        xs = [rng.randrange(60, 100) / 100 for _ in range(640)]
        if sum(round(x * 100) for x in xs) % 8 != 4:
            continue
        orders = [rng.sample(xs, len(xs)) for _ in range(6)]
        means = {added(o) / 640 for o in orders}
        if len(means) > 1:
            cases.append(sorted(means))
    rows = [(i, m) for i, means in enumerate(cases) for m in means]
    df = spark.createDataFrame(rows, "i int, m double")
    assert df.groupBy("i").agg(F.countDistinct(F.round("m", 6)).alias("n")).where("n > 1").count() > 0
    assert df.groupBy("i").agg(F.countDistinct(summary.settled("m")).alias("n")).where("n > 1").count() == 0
    assert [r.v for r in df.select(summary.settled("m").alias("v")).collect()] == [int(np.floor(m * 1e6 + 0.5 + 1e-6)) / 1e6 for _, m in rows]


def _conditions(spark, path, order):
    """Two suppliers of 640 equal rows each, in an order of their own, and the original."""
    rows = [(k, s, q, p, d / 100, t / 100) for s in (1, 2, 4) for k, (q, p, d, t) in enumerate(order[s])]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").coalesce(1).write.mode("overwrite").parquet(f"{path}/lineitem.parquet")


def test_equal_conditions_share_their_ranks(spark, tmp_path):
    rng = random.Random(4)
    for _ in range(1000):
        rows = [(2.0, 50000.0, rng.randrange(11), rng.randrange(9)) for _ in range(640)]
        other = rng.sample(rows, 640)
        half = lambda r: round(sum(100 - 3 * d - t for _, _, d, t in r)) % 8 == 4
        means = [round(added(1.0 - 3 * (d / 100) - t / 100 for _, _, d, t in r) / 640, 6) for r in (rows, other)]
        if half(rows) and means[0] != means[1]:
            break
    _conditions(spark, tmp_path, {1: rows[:5], 2: rows, 4: other})
    ranks = {r.condition_id: r for r in queries.QUERIES["four_ranks"](spark, str(tmp_path)).collect()}
    assert [ranks["c2"][r] for r in queries.RANKS] == [ranks["c4"][r] for r in queries.RANKS]
    over = {r.condition_id: r.dominated_by for r in queries.QUERIES["dominance_rank"](spark, str(tmp_path)).collect()}
    assert over["c2"] == over["c4"]


def test_a_value_at_the_mean_is_not_above_it(spark, tmp_path):
    rng, rows, want = random.Random(2), [], {}
    while len(want) < 30:
        xs = [rng.randrange(10000) for _ in range(66)]
        mean = sum(xs) // 66
        xs.append(mean * 67 - sum(xs))  # between 0 and some way above the mean
        xs += [mean] if mean * 67 == sum(xs) else []
        u = len(want)
        want[u] = (len(xs), sum(x * len(xs) > sum(xs) for x in xs))
        rows += [(len(rows) + i, u, x / 100) for i, x in enumerate(xs)]
    assert any(sum(x > added(v for _, w, v in rows if w == u) / want[u][0] for _, w, x in rows if w == u) != want[u][1] for u in want)
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: (r.n, r.above) for r in queries.QUERIES["paired_join"](spark, str(tmp_path)).collect()} == want
    odd = spark.createDataFrame([(1, 0.5), (1, None), (2, None), (3, float("inf")), (3, 1.0), (4, float("nan")), (5, 1e300), (5, 3e300), (6, 1e-300)], "k int, v double")
    got = {r.k: r.m for r in odd.groupBy("k").agg(summary.mean(F.col("v")).alias("m")).collect()}
    assert got[1] == 0.5 and got[2] is None and got[3] == float("inf") and np.isnan(got[4]) and np.isclose(got[5], 2e300) and np.isclose(got[6], 1e-300)
