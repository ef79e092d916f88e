"""Queries look at all of their rows and texts: against brute force."""

import hashlib
import math
import random

import numpy as np

from ossicle import queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_wer_token_map_compares_whole_turns(spark, tmp_path):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("one two three four five six".split()) for _ in range(n))
    turns = [(c, t, say(rng.randrange(120)), "x") for c in range(6) for t in range(5)] + [(9, 0, "a " * 40 + "b", "x"), (9, 1, "a " * 40 + "c  d", "x"), (9, 2, None, "x"), (10, 0, "", "x"), (10, 1, "a", "x")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = {(c, t): x for c, t, x, _ in turns}
    want = {}
    for (c, t), x in text.items():
        a, y = (x or "").split(), text.get((c, t + 1))
        if a and y is not None:
            want[c, t] = round(distance(a, y.split()) / len(a), 6)
    got = {(r.conv_id, r.turn): r.wer for r in queries.QUERIES["wer_token_map"](spark, str(tmp_path)).collect()}
    assert got == want


def test_bootstrap_draws_from_all_events(spark, tmp_path):
    rng = random.Random(5)
    events = [(i, 20 + i % 300, "ab"[i % 2], None if i % 50 == 0 else rng.gauss(10 * (i % 2), 3)) for i in range(600)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    chances, below = [], 0.0
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        chances.append(below)
    got = {r.event_type: (r.low, r.high) for r in queries.QUERIES["bootstrap_ci_hash"](spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"}
    for kind, (low, high) in got.items():
        values = [(i, v) for i, _, t, v in events if t == kind and v is not None]
        means = []
        for b in range(100):
            u = [int(hashlib.md5(f"42|{b}|{i}".encode()).hexdigest()[:8], 16) / 2**32 for i, _ in values]
            w = [sum(x >= c for c in chances) for x in u]
            means.append(sum(n * v for n, (_, v) in zip(w, values)) / sum(w))
        assert np.allclose([low, high], np.quantile(means, [0.025, 0.975]), atol=2e-5)


def test_mock_error_rates_keeps_all_scripts(spark, tmp_path):
    texts = ["one two three four", "été à côté", "слово за словом", "数 据 操作", "straße 1 2", "", None, "!?"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.wer, r.cer) for r in queries.QUERIES["mock_error_rates"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts[:5]):
        ws = t.split()
        hs = [w if k % 2 == 0 else "mumble" for k, w in enumerate(ws)]
        want[i] = (round(distance(ws, hs) / len(ws), 6), round(distance(t, " ".join(hs)) / len(t), 6))
    assert got == want
