"""Quality rules: rule statistics of whole texts and an isolation forest over them.

Isolation forest (Liu, Ting and Zhou, 2008): random trees split statistics at random
values; rows that a few splits set apart have short paths and are anomalous.  Usual ranges and the
threshold are exact over all labelled rows.  Each tree grows from a few rows, as the method has it, drawn from all
labelled ones.  All rows are scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace, lean, shuffle_partitions, texts

_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_distinct", "n_upper", "n_letters", "n_digits", "n_punct", "n_lines", "n_long"]
_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + EXTRA)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_PUNCT = b"!\"'(),-./:;?@[\\]^_`{}~+="


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = len(number)
    if size < 2_000_000:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # pairs are numbered anew so that the product fits
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= often
    covered[1:-1] |= often
    covered[2:] |= often
    return int(covered.sum())


def statistics(data: bytes) -> tuple[int, ...]:
    """The values of BASE and EXTRA for a UTF-8 text."""
    words = data.split()
    solid = data.translate(None, _SPACE)
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    count = lambda chars: len(solid) - len(solid.translate(None, chars))
    code_points = len(solid) - len(re.findall(rb"[\x80-\xbf]", solid)) if not solid.isascii() else len(solid)
    return (
        len(words), code_points, count(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(set(words)), count(_UPPER), count(_LETTERS), count(_DIGITS), count(_PUNCT), len(lines), sum(len(w) > 20 for w in words),
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(BASE + EXTRA))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *BASE, *EXTRA])

    return texts(docs, id_col, text_col).mapInArrow(run, _STATS)


def features(stats: np.ndarray) -> np.ndarray:
    """The ratios that the forest splits, all finite, from rows of BASE and EXTRA."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_distinct, n_upper, n_letters, n_digits, n_punct, n_lines, n_long = stats.T.astype(float)
    words, chars, lines = (np.maximum(x, 1) for x in (n_words, word_chars, n_lines))
    return np.column_stack(
        [
            word_chars / words, n_symbols / chars, n_dup_lines / lines, n_repeat / words, n_distinct / np.sqrt(words),
            n_upper / np.maximum(n_letters, 1), n_digits / chars, n_punct / words, np.log1p(n_words / lines), n_long / words,
        ]
    )


def _mean_path(n: int) -> float:
    """The mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Ranges:
    """How far a value lies outside the range of good rows, a margin wider: in units of that range.

    Within the range every row looks alike, so the forest isolates by rule excesses, not by
    how a language or a length spreads the ordinary values.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, margin: float = 0.25):
        self.low, self.high = low, high
        self.unit = np.where(self.high > self.low, self.high - self.low, 1.0)
        self.low, self.high = (x + side * margin * (self.high - self.low) for x, side in ((self.low, -1), (self.high, 1)))

    def excess(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(self.low - rows, rows - self.high), 0.0) / self.unit


class Forest:
    """Isolation trees as flat arrays: feature (-1 for a leaf), split value, first child or path length."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.trees = [self._grow(rows[rng.permutation(len(rows))[: self.sample]], rng) for _ in range(trees)] if len(rows) else []

    def _grow(self, rows: np.ndarray, rng: np.random.Generator):
        most = math.ceil(math.log2(max(2, len(rows))))
        feature, value, child = [-1], [0.0], [0]
        todo = [(0, rows, 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            varied = np.flatnonzero(high > low)
            if depth >= most or len(part) < 2 or not len(varied):
                value[at] = depth + _mean_path(len(part))
                continue
            f = int(rng.choice(varied))
            cut = rng.uniform(low[f], high[f])
            left = part[:, f] <= cut
            feature[at], value[at], child[at] = f, cut, len(feature)
            for side, rest in ((left, 0), (~left, 1)):
                todo.append((len(feature), part[side], depth + 1))
                feature.append(-1)
                value.append(0.0)
                child.append(0)
        return np.array(feature), np.array(value), np.array(child)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, 0.5 and less for the ordinary."""
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for feature, value, child in self.trees:
            at = np.zeros(len(rows), np.int64)
            inner = index
            while len(inner := inner[feature[at[inner]] >= 0]):
                node = at[inner]
                at[inner] = child[node] + (rows[inner, feature[node]] > value[node])
            total += value[at]
        return 2.0 ** (-total / len(self.trees) / max(_mean_path(self.sample), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, most_lost: float = 0.005) -> float:
    """The threshold with the most bad rows above it less the share of good ones, of which it loses most_lost at most."""
    if not len(scores) or good.all() or not good.any():
        return math.inf
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    lost, caught = np.cumsum(g) / g.sum(), np.cumsum(~g) / (~g).sum()
    last = np.append(s[1:] < s[:-1], True)
    gain = np.where(last & (lost <= most_lost), caught - lost, -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return math.inf
    return float(s[best] if best + 1 == len(s) else (s[best] + s[best + 1]) / 2)


class Judge:
    """A forest over the excesses of drawn rows, with its threshold; low and high: quantiles of good rows."""

    def __init__(self, drawn: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, sample: int):
        self.ranges = Ranges(low, high)
        self.forest = Forest(self.ranges.excess(features(drawn)), trees, sample)
        self.limit = math.inf

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.forest.score(self.ranges.excess(features(stats)))


def base_failed(stats: np.ndarray, min_words: int, repeat_percent: int) -> np.ndarray:
    words, repeat = stats[:, BASE.index("n_words")], stats[:, BASE.index("n_repeat_words")]
    return (words < min_words) | (100 * repeat > repeat_percent * words)


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in BASE + EXTRA]).astype(float)


def _in_order(x: np.ndarray) -> np.ndarray:
    """Numbers as uint64 of the same order."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _quantiles(good: DataFrame, n: int, shares: tuple[float, ...]) -> np.ndarray:
    """Exact quantiles of each feature (a row a share) of n rows, interpolated as numpy does.

    Ranks are found 16 bits at a time, so that no more than counts of 2^16 bins a rank reach the driver.
    """
    width = features(np.zeros((1, len(BASE + EXTRA)))).shape[1]
    places = [q * (n - 1) for q in shares]
    ranks = sorted({int(r) for p in places for r in (math.floor(p), math.ceil(p))})
    found = {(f, r): (0, r) for f in range(width) for r in ranks}  # leading bits and the rank among what has them
    for shift in (48, 32, 16, 0):
        wanted = sorted({(f, head) for (f, _), (head, _) in found.items()})

        def run(batches: Iterator[pa.RecordBatch], shift=shift, wanted=wanted) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], int] = {}
            for batch in batches:
                keys = _in_order(features(_matrix(batch)))
                for i, (f, head) in enumerate(wanted):
                    key = keys[:, f] if shift == 48 else keys[keys[:, f] >> np.uint64(shift + 16) == np.uint64(head), f]
                    for x, count in zip(*map(np.ndarray.tolist, np.unique(key >> np.uint64(shift) & np.uint64(0xFFFF), return_counts=True))):
                        total[i, x] = total.get((i, x), 0) + count
            columns = ([i for i, _ in total], [x for _, x in total], list(total.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "bin", "count"])

        counts = good.select(*BASE, *EXTRA).mapInArrow(run, "i long, bin long, count long").groupBy("i", "bin").agg(F.sum("count").alias("count")).toPandas().sort_values(["i", "bin"])
        bins = {wanted[i]: (part["bin"].to_numpy(), np.cumsum(part["count"].to_numpy())) for i, part in counts.groupby("i")}
        for (f, r), (head, rank) in found.items():
            values, ends = bins[f, head]
            at = int(np.searchsorted(ends, rank, side="right"))
            found[f, r] = (head << 16 | int(values[at]), rank - (int(ends[at - 1]) if at else 0))
    keys = np.array([[found[f, r][0] for f in range(width)] for r in ranks], np.uint64)
    values = dict(zip(ranks, np.where(keys >> np.uint64(63) == 1, keys & np.uint64((1 << 63) - 1), ~keys).view(float)))
    return np.array([values[math.floor(p)] + (values[math.ceil(p)] - values[math.floor(p)]) * (p - math.floor(p)) for p in places])


def _threshold(scored: DataFrame, n_good: int, n_bad: int, most_lost: float, work: Workspace) -> float:
    """What :func:`calibrate` gives for all rows (score, good) of scored."""
    if not n_good or not n_bad:
        return math.inf
    by = scored.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("many"))
    ordered = by.repartitionByRange(shuffle_partitions(by.sparkSession), F.col("score").desc()).withColumn("part", F.spark_partition_id())
    ordered = work.write(ordered, "scores")
    parts = ordered.groupBy("part").agg(F.sum("good").alias("good"), F.sum("many").alias("many"), F.max("score").alias("top")).toPandas().sort_values("part")
    good, many = (dict(zip(parts["part"], parts[c].cumsum() - parts[c])) for c in ("good", "many"))
    following = dict(zip(parts["part"], parts["top"].shift(-1)))

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        table = table.sort_by([("score", "descending")])
        s, g, m = (table.column(c).to_numpy() for c in ("score", "good", "many"))
        lost = (int(good[part]) + np.cumsum(g)) / n_good
        caught = (int(many[part]) - int(good[part]) + np.cumsum(m - g)) / n_bad
        gain = np.where(lost <= most_lost, caught - lost, -1.0)
        best = int(np.argmax(gain))
        after = s[best + 1] if best + 1 < len(s) else following[part]
        return pa.table({"gain": [float(gain[best])], "score": [float(s[best])], "after": [float(s[best] if np.isnan(after) else after)]})

    best = ordered.groupBy("part").applyInArrow(run, "gain double, score double, after double").toPandas().sort_values(["gain", "score"], ascending=False).iloc[0]
    return float((best["score"] + best["after"]) / 2) if best["gain"] > 0 else math.inf


def _fitted(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, min_words: int, repeat_percent: int, work: Workspace, trees: int = 100, sample: int = 128, most_lost: float = 0.005, tail: float = 0.001) -> Judge:
    """A judge from all rows of stats that have labels and pass the base rules."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col).cast("int") > 0).alias("good")).dropna()
    passed = (F.col("n_words") >= min_words) & (100 * F.col("n_repeat_words") <= repeat_percent * F.col("n_words"))
    known = work.write(stats.where(passed).join(marks, "doc_id").select("doc_id", "good", *BASE, *EXTRA), "known")
    n, n_good = known.agg(F.count("*"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    rows = ["doc_id", "good", *BASE, *EXTRA]
    drawn = known.orderBy(F.xxhash64(*rows), *rows).limit(trees * sample).toPandas().sort_values(rows)[BASE + EXTRA].to_numpy(float).reshape(-1, len(BASE + EXTRA))
    width = features(np.zeros((1, len(BASE + EXTRA)))).shape[1]
    low, high = _quantiles(known.where("good"), n_good, (tail, 1 - tail)) if n_good else np.zeros((2, width))
    fitted = Judge(drawn, low, high, trees, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(fitted.score(_matrix(batch))), batch.column("good")], ["score", "good"])

    fitted.limit = _threshold(known.mapInArrow(run, "score double, good boolean"), n_good, n - n_good, most_lost, work)
    return fitted


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    min_words: int = 50, repeat_percent: int = 50, **more,
) -> DataFrame:
    """(doc_id, the statistics of BASE, base_failed, kept, score) for every row of docs.

    labels: (id, label 1 good or 0 bad).  All labelled rows that pass the base rules give the usual ranges
    (the good ones) and the threshold; trees grow from rows drawn from all of them; without
    labels of both kinds the forest keeps everything.  A null text has no words and fails.  Rows with a null id
    are judged, never used as labelled rows.  Repeated rows are judged each; labels that contradict count twice.
    """
    work = Workspace(docs.sparkSession, "quality")
    stats = work.write(document_statistics(docs, id_col, text_col), "stats")
    fitted = _fitted(stats, labels, id_col, label_col, min_words, repeat_percent, work, **more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in BASE + EXTRA])
            failed, score = base_failed(x, min_words, repeat_percent), fitted.score(x)
            columns = [*(batch.column(c) for c in ["doc_id", *BASE]), *map(pa.array, (failed, ~failed & ~(score > fitted.limit), score))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return stats.mapInArrow(run, schema)


def kept(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    min_words: int = 50, repeat_percent: int = 50, **more,
) -> DataFrame:
    """The rows of docs that :func:`judge` keeps, with all their columns; texts are not shuffled."""
    work = Workspace(docs.sparkSession, "quality")
    stats = document_statistics(docs, id_col, text_col)
    fitted = _fitted(stats, labels, id_col, label_col, min_words, repeat_percent, work, **more)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(place).cast(pa.large_binary())
                x = np.array([statistics(t.as_py() or b"") for t in texts])
                keep = ~base_failed(x, min_words, repeat_percent)
                keep[keep] = ~(fitted.score(x[keep]) > fitted.limit)
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
