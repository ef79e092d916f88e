"""Steps whose work or memory grew faster than the input: against brute force, and what they do by their plans."""

import random

import pytest
from pyspark.sql import functions as F

from ossicle import queries
from ossicle.operators import stats, summary, text


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def average_ranks(values):
    ordered = sorted(values)
    return {v: ordered.index(v) + (ordered.count(v) + 1) / 2 for v in set(values)}


def test_signed_ranks_order_values_and_not_rows(spark):
    rng = random.Random(1)
    rows = [("ab"[i % 2], float(rng.randrange(12)), float(rng.randrange(12))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    out = stats.wilcoxon(df, ["k"], "x", "y")
    for r in out.collect():
        d = [x - y for k, x, y in rows if k == r.k and x != y]
        rank = average_ranks([abs(v) for v in d])
        assert (r.n, r.w_plus, r.w_minus) == (len(d), sum(rank[abs(v)] for v in d if v > 0), sum(rank[abs(v)] for v in d if v < 0))
    p = plan(out)
    assert "Aggregate" in p.split("Window", 1)[1]  # the window is over sums, not over rows


def test_pairs_give_the_correlations_of_rows(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, rng.randrange(30)) for i in range(300)]
    labels = [(i, rng.randrange(3)) for i in range(0, 300, 2)]
    spark.createDataFrame(docs, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["rating_correlation"](spark, str(tmp_path)).first()
    q, n = zip(*[(v, docs[i][1]) for i, v in labels])
    rq, rn = average_ranks(q), average_ranks(n)

    def corr(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        return sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5

    assert got.n == 150 and got.pearson == pytest.approx(corr(q, n), abs=1e-6) and got.spearman == pytest.approx(corr([rq[v] for v in q], [rn[v] for v in n]), abs=1e-6)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert summary.spearman(flat, "a", "b").first().rho is None


def test_words_of_a_pair_are_split_once(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "a"), (None, "a"), ("a  b", None)], "r string, h string")
    rates = df.select(text.word_error_rate(F.col("r"), F.col("h")).alias("w"))
    assert [r.w for r in rates.collect()] == [pytest.approx(2 / 3), None, None, None]
    assert plan(rates).count("split(") == 2  # seven before, most of them for each word


def test_confusions_come_as_counts(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("a b", "a x"), (None, "z"), ("z", None)] * 50, "r string, h string")
    out = text.confusions(df, "r", "h")
    assert {(r.ref_word, r.hyp_word): r.n for r in out.collect()} == {("b", "x"): 100, (None, "d"): 50, (None, "z"): 50, ("z", None): 50}
    assert "sum(n" in plan(out)  # not a row for each word


def test_conversations_are_dealt_by_number(spark, tmp_path):
    rows = [(i, t, "one two", "x") for i in range(40) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("wer_token_map", "word_confusion"):
        assert "RepartitionByExpression" in plan(queries.QUERIES[name](spark, str(tmp_path)))


def test_letters_and_digits_of_any_script(spark):
    rows = ["", " ", "abc 12", "été — ñ٣४", "слово 5½ 数据𝒜", "..,", "a\n1\tb2", None]
    import unicodedata

    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(text.phonemes(F.col("t")).alias("n")).collect()]
    for t, n in zip(rows[:-1], got):
        kinds = [unicodedata.category(c)[0] for c in t]
        want = round(0.96 * kinds.count("L") + 1.5 * kinds.count("N"))
        assert n == (want or int(bool(t.strip(" "))))


def test_a_unit_is_drawn_once_for_all_its_rows(spark):
    rng = random.Random(5)
    rows = [("ab"[i % 2], i % 40, i % 3, (39.0, 74.0, 244.0)[i % 3], rng.random() + 0.1) for i in range(3000)]
    ladder = spark.createDataFrame(rows, "condition string, utt_id long, model long, params_m double, wer double")
    p = plan(stats.fit_intervals(ladder, 0.01))
    assert "Aggregate" in p.split("Generate", 1)[1]  # rows are summed before they are drawn
