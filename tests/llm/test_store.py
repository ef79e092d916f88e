import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ossicle.llm import store

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "text string, doc_id long, n_tokens string, start int"


def test_crc_of_joined():
    rng = random.Random(3)
    parts = [[rng.randbytes(rng.randrange(0, 99)) for _ in range(rng.randrange(1, 6))] for _ in range(40)]
    docs = np.concatenate([[i] * len(p) for i, p in enumerate(parts)])
    crcs = np.array([zlib.crc32(x) for p in parts for x in p])
    after = np.array([sum(map(len, p[i + 1 :])) for p in parts for i in range(len(p))])
    assert store.crc_of_joined(crcs, after, docs, 40).tolist() == [zlib.crc32(b"".join(p)) for p in parts]


def test_cuts_follow_content_and_bounds():
    ids = np.random.default_rng(0).integers(0, 50000, 60000).astype("<u4")
    marks = store.breaks(ids)
    ends = store.cuts(len(ids), marks.tolist())
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= store.MOST and (sizes[:-1] >= store.LEAST).all()
    moved = store.cuts(len(ids) + 7, store.breaks(np.concatenate((ids[:7], ids))).tolist())
    assert len({x - 7 for x in moved} & set(ends)) > 0.9 * len(ends)
    assert store.cuts(1, []) == [1] and store.cuts(10000, [])[-1] == 10000


def test_round_trip(spark, tmp_path):
    base = " ".join(f"word{i * i % 997}" for i in range(4000))
    rows = [(base, 5), (base[:9000], 3), ("x " + base, 4), (None, 9), ("", 8), (None, None), (base, 5), ("longer " * 20000, 2), ("<|endoftext|> é", 1)]
    docs = spark.createDataFrame([(t, d, "clash", 1) for t, d in rows], SCHEMA)
    path = str(tmp_path / "store")
    got = sorted(map(tuple, store.stored_documents(docs, PATH, 2, path).collect()), key=lambda r: r[1])
    lib, start, want = Tokenizer.from_file(PATH), 0, []
    for text, doc in sorted(rows, key=lambda r: (r[1] is not None, r[1])):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    back = store.read_ids(spark, path).orderBy("shard", "pos").collect()
    assert [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in back] == [w[3] for w in want]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert sum(len(store.unpack(r.payload)) for r in chunks.collect()) < 0.7 * start
    assert store.root(spark, path) == store.root(spark, path)


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([("some text", 1, "", 1), ("other text", 2, "", 1)], SCHEMA)
    path = str(tmp_path / "store")
    store.write(docs, path, PATH, 2)
    bad = [(bytes(r.digest), bytes(r.payload)[:-1] + b"\7") for r in spark.read.parquet(f"{path}/chunks").collect()]
    spark.createDataFrame(bad, "digest binary, payload binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        store.digests(spark, path).collect()


def test_empty_table(spark):
    assert store.stored_documents(spark.createDataFrame([], SCHEMA), PATH, 2).collect() == []
