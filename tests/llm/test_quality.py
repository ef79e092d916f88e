import re
from collections import Counter

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ossicle.llm import quality


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [None, "", " \n\n\t", "é ü 中文 ###", "a b c a b c a", "x\ny\nx\n \n \nx ", "a\x0bb\x0cc\rd \x1cz\x85q", "a a a a", "one two three " * 40, " ".join(f"w{i}" for i in range(60)), "long " * 50000]


def test_base_statistics_match_brute_force(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (3, TEXTS[3], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r[:7]) for r in got), key=key) == sorted(((d, *brute(t)) for d, t, _ in rows), key=key)
    assert all(r.kept != r.base_failed for r in got)  # no labels: the forest keeps everything
    assert quality.judge(docs.limit(0), labels).collect() == []


def test_large_vocabulary_windows():
    words = [str(i).encode() for i in range(10)] * 2
    assert quality.repeated_words(words) == 20 and quality.repeated_words(words[:10]) == 0


def test_forest_rejects_held_out_bad_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where("doc_id % 2 = 0")
    rows = quality.judge(docs, known).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    good, kept = rows.quality.to_numpy() > 0, rows.kept.to_numpy()
    assert kept[good].mean() > 0.97 and kept[~good].mean() < 0.3


def test_calibration():
    assert quality.calibrate(np.array([]), np.array([], bool)) == np.inf
    assert 0.5 < quality.calibrate(np.array([0.9, 0.5, 0.4]), np.array([False, True, True])) < 0.9


def test_all_labelled_rows_count(spark):
    """Bad rows past the first 20,000 in the order of their ids' hashes are learnt too."""
    good, odd = (" ".join(f"w{k:02}" + "x" * more for k in range(55)) for more in (0, 30))
    order = Window.orderBy(F.xxhash64("id"))
    rows = spark.range(20_500).select(F.col("id").alias("doc_id"), (F.row_number().over(order) <= 20_000).cast("int").alias("quality"))
    frame = rows.withColumn("text", F.when(F.col("quality") > 0, good).otherwise(odd))
    got = quality.judge(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    assert got.join(rows, "doc_id").where(F.col("kept") != (F.col("quality") > 0)).isEmpty() and got.count() == 20_500


def test_ranges_and_threshold_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3_000):
        good = rng.random() < 0.7
        words = ["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(2, 9 if good else 12, 55)]
        rows.append((i, " ".join(words), int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.judge(frame.select("doc_id", "text"), frame.select("doc_id", "quality")).toPandas().sort_values("doc_id")
    assert not got.base_failed.any()
    good = np.array([g > 0 for _, _, g in rows])
    limit = quality.calibrate(got.score.to_numpy(), good)
    assert (got.kept.to_numpy() == ~(got.score.to_numpy() > limit)).all() and not got.kept.all()
    values = quality.features(np.array([quality.statistics(t.encode()) for _, t, _ in rows]))
    low, high = (np.quantile(values[good], q, axis=0) for q in (0.001, 0.999))
    inside = ((values >= low) & (values <= high)).all(axis=1)
    assert got.score.to_numpy()[inside].max() == got.score.min()  # no excess, none more ordinary
