import hashlib

import numpy as np
from pyspark.sql import functions as F

from ossicle.functions import hashes
from ossicle.operators import stats


def test_digits_are_those_of_md5():
    rng = np.random.default_rng(1)
    for head in (b"", b"42|7", b"42|99|", b"a" * 40):
        for size in (0, 1, 3, 4, 8, 15, 20):
            tails = rng.integers(33, 120, (70, size)).astype(np.uint8)
            assert hashes.first_digits(head, tails).tolist() == [int(hashlib.md5(head + t.tobytes()).hexdigest()[:8], 16) for t in tails]


def test_draws_of_text_and_missing_units_and_groups(spark):
    rows = [(("a", "b", None)[i % 3], i % 2, None if i % 50 == 0 else f"u{i * 37 % 1000}é", float(i % 11)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, g int, u string, v float")
    out = stats.poisson_bootstrap(df, ["k", "g"], "u", "v", 20)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # a row for each row and draw before
    got = {(r.k, r.g): (r.low, r.high) for r in out.collect()}
    chances = np.cumsum([float(np.exp(-1)) / f for f in np.cumprod([1, *range(1, 12)])])
    for key in {(k, g) for k, g, _, _ in rows}:
        own, means = [(u, v) for k, g, u, v in rows if (k, g) == key], []
        for b in range(20):
            w = [sum(int(hashlib.md5("|".join(["42", str(b), *([u] if u else [])]).encode()).hexdigest()[:8], 16) / 2**32 >= c for c in chances) for u, _ in own]
            means.append(sum(n * v for n, (_, v) in zip(w, own)) / sum(w))
        assert np.allclose(got[key], np.quantile(means, [0.025, 0.975]), atol=1e-9)
