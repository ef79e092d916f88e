from collections import Counter

import pytest

from ossicle.llm import mixing


def test_period_deviates_by_less_than_one_block():
    for weights in ([1.0], [1, 1, 1], [0.5, 0.3, 0.2], [10, 1, 1, 1, 1, 1, 1, 1], [0.9] + [0.001] * 40):
        shares = mixing.whole_shares(weights, 509)
        assert sum(shares) == 509 and min(shares) >= 1
        seen = [0] * len(shares)
        for t, i in enumerate(mixing.period_schedule(shares), 1):
            seen[i] += 1
            assert all(abs(n - s * t / 509) < 1 for n, s in zip(seen, shares))


@pytest.mark.parametrize("bad", [[], [1, 0], [1, -1], [1] * 600])
def test_bad_weights(bad):
    with pytest.raises(ValueError):
        mixing.whole_shares(bad, 509)


def test_mix_keeps_all_rows_and_follows_weights(spark):
    data = [(i, "a", 1) for i in range(400)] + [(1000 + i, "it's b\\", 2) for i in range(90)] + [(2000 + i, None, 3) for i in range(33)]
    data += [(5, "a", 1), (5, "a", 1), (None, "c", None)]
    df = spark.createDataFrame(data, "doc_id long, source string, slot int")
    rows = mixing.mix(df, {"a": 2.0, "it's b\\": 1.0}, block_size=4, period=101, rows_a_task=50).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(data)))
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((d, s) for d, s, _ in data)
    assert all((a.slot, a.place) < (b.slot, b.place) for a, b in zip(rows, rows[1:]))
    slots = sorted({(r.slot, r.source) for r in rows}, key=lambda x: x[0])
    assert [s for s, _ in slots] == list(range(len(slots)))
    for source in ("a", None):
        blocks = [r.block for r in rows if r.source == source]
        assert blocks == sorted(blocks) and set(Counter(blocks).values()) <= {4, len(blocks) % 4 or 4}
    plan = mixing.phases({"x": 30, "y": 10, "z": 1}, {"x": 1.0, "y": 1.0, "z": 1.0}, 30)
    assert sum(p["length"] for p in plan) == 41


def test_default_weights_and_empty_table(spark):
    df = spark.createDataFrame([(i, "s%d" % (i % 3 % 2), "t") for i in range(100)], "doc_id long, source string, text string")
    assert sorted(r.position for r in mixing.mix(df, block_size=7).collect()) == list(range(100))
    assert mixing.mix(df.limit(0)).collect() == []
