import hashlib
from collections import Counter

import pytest

from ossicle.llm import sharding


def test_table_is_even_and_stable():
    for n in (1, 3, 64):
        names = [f"s{i}" for i in range(n)]
        table = sharding.lookup_table(names, 1009)
        share = Counter(table)
        assert set(share) == set(range(n)) and max(share.values()) - min(share.values()) <= 1
    more = sharding.lookup_table([*names, "new"], 1009)
    moved = sum(a != b for a, b in zip(table, more) if b != n)
    assert moved < 0.1 * 1009


@pytest.mark.parametrize("bad", [(["a"], 10), (["a", "a"], 11), ([], 11), (["a", "b", "c"], 2)])
def test_bad_tables(bad):
    with pytest.raises(ValueError):
        sharding.lookup_table(*bad)


def test_assignment(spark, tmp_path):
    keys = [1, 2, 2, None, -5, 10**18]
    df = spark.createDataFrame([(k, "old", None) for k in keys], "doc_id long, shard string, slot int")
    rows = sharding.assign(df, shards=7, size=101).collect()
    table = sharding.lookup_table([f"shard-{i}" for i in range(7)], 101)
    for r in rows:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 101 and r.shard == table[r.slot]
    assert sharding.assign(df.limit(0)).count() == 0
    sharding.write(sharding.assign(df, shards=7, size=101), str(tmp_path / "x"), files=2)
    assert spark.read.parquet(str(tmp_path / "x")).count() == len(keys)
