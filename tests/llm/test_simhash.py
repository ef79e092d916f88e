import random
import re
from itertools import combinations

import numpy as np
import xxhash

from ossicle.llm import overlap, simhash, work

SCHEMA = "doc_id long, text string, lang string, fp string, v long"


def brute(rows, words=3, radius=2):
    prints = []
    for doc, text in rows:
        found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        size = min(words, len(found))
        hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + size]), 42) for i in range(len(found) - size + 1)] if found else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted(((d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, group)), key=str)


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows, similarity=0.8):
    """The groups of rows by places, all pairs compared."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if group[i] != group[j] and jaccard(sets[i], sets[j]) >= similarity:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    return {frozenset(i for i in range(len(rows)) if group[i] == g) for g in group}


def run(spark, rows, **more):
    frame = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in simhash.near_duplicates(frame, **more).collect()), key=str)


def test_matches_brute_force_with_odd_rows(spark):
    base = [f"w{i % 17} x{i % 5}" for i in range(60)]
    rows = [(i, " ".join(base[: 40 + i % 7])) for i in range(30)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "One TWO"), (105, "one two"), (None, "one two"), (None, None), (103, "one"), (103, "one")]
    rows += [(200, "é É à\x0bb c"), (201, "É é à b c"), (202, "long " * 30000 + "tail")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, words=5) == brute(rows, 5)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_ball_links_chains(spark):
    prints = [0, 3, 15, 63, 1 << 63, (1 << 63) | 1, 1 << 40]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    parent = {p[0]: p[0] for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in found:
        parent[root(u)] = root(v)
    assert len({root(p[0]) for p in signed}) == 1  # 63-15-3-0, and 0 - 1<<63 - 1<<40 by two flips


def test_all_alike_candidates_of_large_groups_are_linked(spark):
    rng = random.Random(7)
    rows = []
    for g in range(2):  # variants near their base and not each other; the base is not the first
        base = [f"w{rng.randrange(3000)}" for _ in range(400)]
        for c in range(150):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randrange(6, 9) if c != 75 else 0):
                words[at] = f"changed{rng.randrange(9999)}"
            rows.append((1000 * g + c, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: r.root for r in simhash.alike(frame).collect()}
    sets = [shingles(t) for _, t in rows]
    met = 0
    for i, j in combinations(range(len(rows)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            met += 1
            assert root[rows[i][0]] == root[rows[j][0]]
    assert met > 50


def found_groups(spark, rows, **more):
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    by = {}
    for r in simhash.alike(frame, **more).collect():
        by.setdefault(r.root, set()).add(r.doc_id)
    return {frozenset(x) for x in by.values()}


def test_groups_match_brute_force_on_edits_of_all_kinds(spark):
    rng = random.Random(21)
    common = [f"c{i}" for i in range(90)]  # a passage that most texts share
    rows = []
    for g in range(40):
        base = [f"v{rng.randrange(900)}" for _ in range(rng.randrange(5, 220))]
        if g % 3:
            base[len(base) // 2 : len(base) // 2] = common
        rows.append((0, " ".join(base)))
        n = len(base)
        for share in (0.05, 0.1, 0.15, 0.2):  # cut, moved, replaced and doubled parts around the bound
            k = max(1, int(share * n))
            at = rng.randrange(n - k + 1)
            rows += [(0, " ".join(base[k:])), (0, " ".join(base[:at] + base[at + k :])), (0, " ".join(base[k:] + base[:k])), (0, " ".join(base + base[:k]))]
            words = list(base)
            for p in rng.sample(range(n), max(1, k // 5)):
                words[p] = f"new{rng.randrange(9999)}"
            rows.append((0, " ".join(words).upper()))
    rows += [(0, t) for t in (None, "", " \n", "a", "A", "a b c d", "a b c d e", "a b c d e f", "b c d e f")]
    assert found_groups(spark, rows, slots=1 << 16) == groups(rows)


def test_no_link_of_the_table_is_lost(spark):
    """All pairs at 0.8 or more of sf0.01 are linked; candidates for brute force are pairs that share any shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root = {r.doc_id: r.root for r in simhash.alike(docs).collect()}
    sets, holders = [shingles(t) for _, t in rows], {}
    for i, x in enumerate(sets):
        for w in x:
            holders.setdefault(w, []).append(i)
    pairs = {p for x in holders.values() for p in combinations(x, 2)}
    alike = [(i, j) for i, j in pairs if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(alike) > 20 and all(root[rows[i][0]] == root[rows[j][0]] for i, j in alike)
    linked = {}
    for i, j in alike:
        linked.setdefault(rows[i][0], set()).add(rows[j][0])
        linked.setdefault(rows[j][0], set()).add(rows[i][0])
    by = {}
    for d, r in root.items():
        by.setdefault(r, []).append(d)
    assert all(d in linked for x in by.values() if len(x) > 1 for d in x if sets[[k for k, _ in rows].index(d)])


def test_marks_differ_in_no_more_bits_than_sets_in_members():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (10, 12), (300, 340), (300, 900), (5000, 4200), (4097, 4096)):
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        for common in (0, min(n, m) // 2, min(n, m)):
            a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[:common], pool[n : n + m - common])))
            differ = len(np.setxor1d(a, b))
            bits = overlap.differing(overlap.marks(a), overlap.marks(b))
            assert bits <= differ and (common or bits > 0.2 * min(n, m))


def test_shared_passages_alone_make_no_candidates(spark, monkeypatch):
    """Texts that share a passage and are mostly their own don't meet, however few hold the passage; near copies still do."""
    rng = random.Random(5)
    rows = []
    for g in range(6):
        passage = [f"p{g}x{i}" for i in range(30)]
        for _ in range(8):
            rows.append((0, " ".join([f"u{rng.randrange(10**9)}" for _ in range(60)] + passage)))
    rows.append((0, rows[0][1] + " tail"))
    asked, possible = [], overlap.possible

    def counted(pairs, marked, similarity):
        asked.append(pairs.count())
        return possible(pairs, marked, similarity)

    monkeypatch.setattr(overlap, "possible", counted)
    assert found_groups(spark, rows) == groups(rows)
    assert sum(asked) <= 3


def shuffled(spark, start):
    """Bytes of shuffle that stages from start on wrote, and the next stage's number."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    found = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteBytes() for x in found if x.stageId() >= start), max((x.stageId() for x in found), default=-1) + 1


def test_texts_without_copies_stay_where_they_are(spark):
    """Only texts that may be copies move, even if no table is small enough to be broadcast by its size."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(200, 400)))) for i in range(800)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(10)] + [(2000 + i, rows[20 + i][1].upper()) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    work_rows = work.Workspace(spark, "moved-test").write(frame, "rows")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, start = shuffled(spark, 0)
        kept = {r.doc_id for r in simhash.deduplicated(work_rows).collect()}
        moved, _ = shuffled(spark, start)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept == set(range(800))
    assert moved < 1.5 * sum(len(t) for _, t in rows)


def test_copies_are_found_whatever_the_bitmap_holds(spark, monkeypatch):
    """With one word in the bitmap nearly all rows may be among the keys; groups and kept rows are the same."""
    monkeypatch.setattr(work, "WORDS", 1)
    rng = random.Random(9)
    rows = []
    for i in range(90):
        base = [f"v{rng.randrange(500)}" for _ in range(rng.randrange(5, 90))]
        rows += [(i, " ".join(base)), (100 + i, " ".join(base).upper()), (200 + i, " ".join([*base, "tail"]))]
    rows += [(None, rows[0][1]), (None, None), (7, rows[9][1]), (7, rows[9][1]), (300, ""), (300, "")]
    assert found_groups(spark, rows) == groups(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(frame).collect()), key=str)
    monkeypatch.setattr(work, "WORDS", 1 << 18)
    assert got == sorted(((r.doc_id, r.text) for r in simhash.deduplicated(frame).collect()), key=str)
    assert len(got) == len(groups(rows))
    keys = spark.createDataFrame([(1, 0), (5, 0)], "doc long, tag long")
    some, none = work.likely(spark.range(50).selectExpr("id as doc", "0L as tag"), keys, ["doc", "tag"])
    assert {r.doc for r in some.collect()} >= {1, 5} and some.count() + none.count() == 50
