import hashlib
import random
import re
from collections import Counter

import numpy as np

from ossicle.llm import fmindex

SCHEMA = "doc_id long, text string, tag string, start int"


def brute(rows, length=35):
    split = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    often = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - length + 1):
            if often[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "été"] + ["w%d" % i for i in range(40)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [say(rng.randrange(36, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += say(rng.randrange(1, 60)) if rng.random() < 0.5 else rng.choice(shared)[rng.randrange(12) :]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_removes_what_brute_force_removes(spark):
    for seed in (1, 2):
        rows = make(seed)
        rows += [(100, None), (101, ""), (102, "a " * 34), (103, "a " * 35), (104, "b " * 36), (105, "c d " * 40), (None, rows[0][1]), (None, None), rows[5], rows[5], (6, rows[7][1])]
        rows += [(200, " ".join(f"u{i}" for i in range(300))), (201, " ".join(f"u{i}" for i in range(100, 135)) + " x"), (202, " ".join(f"u{i}" for i in range(200, 234)))]
        df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
        assert sorted(map(tuple, fmindex.removed_digests(df).collect()), key=str) == brute(rows)
    assert fmindex.removed_digests(df.limit(0)).collect() == []


def test_long_text(spark):
    words = [f"n{i * 7919 % 600011}" for i in range(560000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[524270:524330]))]
    got = {r.doc_id: r.n_removed for r in fmindex.removed_digests(spark.createDataFrame([(d, t, "", 1) for d, t in rows], SCHEMA)).collect()}
    assert got == {1: 60, 2: 60}


def test_wavelet_tree_and_backward_search():
    rng = np.random.default_rng(0)
    for sigma in (2, 3, 17, 300):
        x = rng.integers(0, sigma, 500)
        tree = fmindex.WaveletTree(x, sigma)
        c, i = rng.integers(0, sigma, 200), rng.integers(0, 501, 200)
        assert tree.rank(c, i).tolist() == [int((x[:b] == a).sum()) for a, b in zip(c, i)]
    x = np.append(rng.integers(1, 3, 300), 0)
    index = fmindex.FMIndex(x, 3, 12)
    ends = np.arange(12, 301)
    reach, _ = index.statistics(x, ends, 12)
    text = "".join(map(str, x))
    for e, r in zip(ends, reach):
        want = 0
        while want < 12 and len(re.findall(f"(?={text[e - want - 1 : e]})", text)) >= 2:
            want += 1
        assert r == want
