"""Transcripts: normalising, error rates, alignments and the mock recogniser."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.kernels import edit_counts


def normalize(t: Column) -> Column:
    """Lower case, letters and digits of any script, single spaces; null is empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def words(t: Column) -> Column:
    return F.filter(F.split(t, " "), lambda w: w != "")


def cer(ref: Column, hyp: Column) -> Column:
    return F.when(F.length(ref) > 0, F.levenshtein(ref, hyp) / F.length(ref))


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """By the built-in edit distance: each different word of the pair becomes a character.

    For pairs with up to 50,000 different words; null for an empty reference.
    """
    # each is bound once: within the lambdas they would be split and compared anew for each word
    def rate(r: Column, h: Column) -> Column:
        code = lambda seen: lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(seen, w) + 256), 4, "0")), "UTF-16BE")), "")
        return let(F.array_distinct(F.concat(r, h)), lambda seen: F.levenshtein(code(seen)(r), code(seen)(h)) / F.size(r))

    both = F.struct(words(ref).alias("r"), words(hyp).alias("h"))
    return let(both, lambda b: F.when(F.size(b["r"]) > 0, rate(b["r"], b["h"])))


def phonemes(t: Column) -> Column:
    """An estimate from letters and digits; at least one if there is any text."""
    # letters go in runs; digits are then looked for among what is left, a fifth of a text
    rest = F.regexp_replace(t, r"\p{L}+", "")
    letters, digits = F.length(t) - F.length(rest), F.length(F.regexp_replace(rest, r"[^\p{N}]+", ""))
    n = F.bround(0.96 * letters + 1.5 * digits).cast("long")
    return F.when(n > 0, n).when(F.length(F.trim(t)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")


def phone_rate(t: Column, seconds: Column) -> Column:
    """Null where the reference has infinity: no duration."""
    return F.when(seconds > 0, phonemes(t) / seconds)


def mock_transcript(ref: Column, masker_db: Column, jitter_ms: Column) -> Column:
    """The deterministic recogniser: every second word is lost under a strong distortion."""
    bad = (masker_db > 15) | (jitter_ms > 5)
    return F.array_join(F.transform(words(ref), lambda w, i: F.when(bad & (i % 2 == 1), "mumble").otherwise(w)), " ")


def ctc_cleanup(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\|", " "), r"\s+", " "))


def detailed(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """df with wer, hits, substitutions, deletions and insertions, each a share of the reference's words."""
    names = ["wer", "hit_rate", "sub_rate", "del_rate", "ins_rate"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def rates(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for r, h in parts:
            rows = []
            for a, b in zip(r, h):
                a = (a or "").split()
                hits, s, d, i = edit_counts(a, (b or "").split())
                n = max(1, len(a))
                rows.append(((s + d + i) / n, hits / n, s / n, d / n, i / n))
            yield pd.DataFrame(rows, columns=names)

    return df.withColumn("_d", rates(ref, hyp)).select("*", "_d.*").drop("_d")


def confusions(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """(ref_word, hyp_word, n) of aligned words that differ; null for a word without a partner."""
    import difflib
    import re

    def words_of(t: str | None) -> list[str]:
        return re.findall("[a-z']+", (t or "").lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()  # of whole tasks, given out whenever it has grown

        def out() -> pa.RecordBatch:
            r, h = zip(*seen) if seen else ((), ())
            batch = pa.record_batch([pa.array(r, pa.string()), pa.array(h, pa.string()), pa.array(seen.values(), pa.int64())], ["ref_word", "hyp_word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    a, b = words_of(a), words_of(b)
                    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, False).get_opcodes():
                        if op != "equal":
                            both = min(j - i, m - k)
                            seen.update(zip(a[i : i + both], b[k : k + both]))
                            seen.update((w, None) for w in a[i + both : j])
                            seen.update((None, w) for w in b[k + both : m])
                if len(seen) > 50_000:
                    yield out()
        yield out()

    return df.select(ref, hyp).mapInArrow(run, "ref_word string, hyp_word string, n long").groupBy("ref_word", "hyp_word").agg(F.sum("n").alias("n"))
