import hashlib
import random

import numpy as np

from ossicle.llm import repeats, suffix

SCHEMA = "doc_id long, text string, tag string, data int"


def brute(rows, length=50):
    owner = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                owner[w] = min(owner.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if owner[b[i : i + length]] < d:
                    gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "été", "zwölf"] + ["w%d" % i for i in range(25)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [say(rng.randrange(8, 40)) for _ in range(8)]
    rows = []
    for _ in range(n):
        parts = [say(rng.randrange(1, 30)) if rng.random() < 0.5 else rng.choice(shared)[rng.randrange(9) :] for _ in range(rng.randrange(1, 8))]
        rows.append((rng.randrange(1000), " ".join(parts)))
    return rows


def test_sort_agrees_with_python():
    rng = np.random.default_rng(1)
    for alphabet, depth, shallow in ((2, 50, 24), (2, 50, 8), (1, 50, 24), (3, 29, 24), (256, 50, 16)):
        text = rng.integers(0, alphabet, 900).astype(np.uint8)
        text[300:600] = text[:300]
        places = np.arange(900 - depth + 1)
        order, lcp = suffix.sort(text, places, depth, shallow)
        raw = [text[p : p + depth].tobytes() for p in places]
        assert [raw[i] for i in order] == sorted(raw) and sorted(order) == list(range(len(places)))
        for i in range(1, len(order)):
            a, b = raw[order[i - 1]], raw[order[i]]
            assert lcp[i] == next((j for j in range(depth) if a[j] != b[j]), depth)


def test_removes_what_brute_force_removes(spark):
    for seed in (1, 2):
        rows = make(seed)
        rows += [(2000, None), (2001, ""), (2002, "x" * 49), (2003, "x" * 400), (2004, "x" * 60), (None, rows[0][1]), (None, None)]
        rows += [rows[3], rows[3], (rows[3][0], rows[4][1]), (5000, rows[0][1]), (-3, rows[1][1]), (2005, "ab" * 300), (2006, "ba" * 40)]
        df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
        assert sorted(map(tuple, suffix.removed_digests(df).collect()), key=str) == brute(rows)
    assert suffix.removed_digests(df.limit(0)).collect() == []


def test_long_texts_cross_slabs(spark, monkeypatch):
    long = " ".join(f"n{i * 7919 % 100003}" for i in range(150000))
    rows = [(1, long), (2, long[200000:900000]), (3, "head " + long[500000:500100] + " tail")]
    got = {r.doc_id: r for r in suffix.removed_digests(spark.createDataFrame([(d, t, "", 1) for d, t in rows], SCHEMA)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_spans) == (0, 700000, 1, 1) and 100 <= got[3].n_removed <= 102


def test_deduplicated_texts(spark):
    shared = "a shared passage of more than fifty bytes, été, that both documents hold"
    df = spark.createDataFrame([(1, f"one {shared} end", "p", 4), (2, f"two {shared} fin", "q", None), (3, None, None, 5), (None, shared, "r", 6)], SCHEMA)
    got = {r.doc_id: r for r in suffix.deduplicated(df).collect()}
    assert got[1].text == f"one {shared} end" and got[2].text == "twofin" and got[3].text is None and got[None].text == shared
    assert (got[2].tag, got[3].data) == ("q", 5) and suffix.deduplicated(df).columns == df.columns


def test_mask_and_merge():
    spans = {"doc": np.array([1, 1, 2]), "tag": np.array([0, 0, 0]), "start": np.array([0, 2, 1], "<u4"), "count": np.array([2, 1, 1], "<u4")}
    got = repeats.merged(spans)
    assert got["start"].tolist() == [0, 1] and got["count"].tolist() == [3, 1]
    assert repeats.mask(got["start"][:1].tobytes(), got["count"][:1].tobytes(), 9, 4).tolist() == [True] * 6 + [False] * 3
