import random

from pyspark.sql import functions as F

import corpus_pipeline
from ossicle.llm import simhash
from ossicle.llm.work import Workspace

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for g in range(40):
        base = say(rng.randrange(60, 400))
        for c in range(4):
            words = list(base)
            for _ in range(max(1, len(words) // 100) * (c > 0)):
                words[rng.randrange(len(words))] = "changed%d" % rng.randrange(9999)
            rows.append((100 * g + c, " ".join(words)))
    rows += [(9000, None), (9001, ""), (None, "one two three"), (9002, "One two  THREE"), (None, None), (50, rows[7][1]), (50, rows[7][1]), (9003, "x " * 20000)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, tag string, root string, n long")
    got = simhash.deduplicated(df).collect()
    texts = [r.text for r in got]
    close = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if jaccard(a, b) >= 0.8]
    assert close == []
    for d, t in rows:
        assert any(jaccard(t, u) >= 0.5 for u in texts)
    alone = [r for i, r in enumerate(rows) if all(jaccard(r[1], s[1]) < 0.8 for j, s in enumerate(rows) if j != i)]
    assert {d for d, _ in alone} <= {r.doc_id for r in got}
    assert [r.doc_id for r in got if r.text and r.text.lower().split() == ["one", "two", "three"]] == [9002]


def test_stages_on_a_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packed sequences":
            assert out.columns == columns and out.dtypes == docs.dtypes
            kept = out.count()
            assert 0.5 * n < kept <= docs.count()
            docs = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.run(spark, SF)
    assert final.select(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_sequences_follow_the_mixed_order(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(250, 700))), "small" if i >= 640 else "large") for i in range(680)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    work = Workspace(spark, "mixed-test")
    mixed = work.write(corpus_pipeline.mixed_sources(spark, frame, SF), "mixed")
    rows = corpus_pipeline.packed_sequences(spark, mixed, SF).collect()
    assert {r.doc_id for r in rows} == set(range(680))
    tokens = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    total, at, small = sum(r.length for r in rows), 0, [0, 0]
    for r in tokens:  # weights of 4 to 1 until the small source ends, after 200 of 680 documents
        small[at > 0.4 * total] += r.length * (r.doc_id >= 640)
        at += r.length
    assert small[0] > 0.55 * sum(small)  # shorter pieces fill gaps anywhere in their range
    places = {r.doc_id: i for i, r in enumerate(mixed.selectExpr("doc_id", "_metadata.file_name as f", "_metadata.row_index as n").orderBy("f", "n").collect())}
    lead = {}
    for r in tokens:
        lead[r.sequence_id] = max(lead.get(r.sequence_id, (0, 0)), (r.length, -places[r.doc_id]))
    order = [-lead[s][1] for s in sorted(lead)]
    assert order == sorted(order)
    ids = {i: d for d, i in places.items()}
    leads = [ids[i] >= 640 for i in order]
    assert sum(leads[: len(leads) * 4 // 10]) == sum(leads) > 5
    assert sum(leads[: len(leads) // 4]) > 0.13 * (len(leads) // 4)  # 0.2 by the weights, 0.06 without
