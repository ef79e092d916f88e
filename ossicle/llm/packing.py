"""Best-fit packing with a swap-based local search."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import encoded
from .work import Workspace, as_bytes, lean, texts

#: Pieces that one task packs at once.
GROUP = 40_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of places in lengths."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                mask &= ~(1 << gap)
            bins[b].append(i)
        else:
            b, gap = len(bins), capacity
            bins.append([i])
        if gap > n:
            by_gap[gap - n].append(b)
            mask |= 1 << (gap - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, effort: int = 4_000_000) -> list[list[int]]:
    """Local search over the underfull bins, which raises the sum of squared fills until bins empty.

    The emptiest bin gives: a document moves to a bin with room, or is exchanged for a
    shorter one, or two are exchanged for one or one for two, so that the receiving bin, which
    is the fuller, gains.  Each step raises the sum of squares, so the search ends; effort
    bounds the comparisons, never what is packed.
    """
    done = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    held = sorted(([sum(lengths[i] for i in b), b] for b in bins if sum(lengths[i] for i in b) < capacity), key=lambda x: x[0])
    stuck: list[list] = []
    while len(held) > 1 and effort > 0:
        giver = held.pop(0)
        moved = True
        while moved and giver[1] and effort > 0:
            moved = False
            for taker in sorted(held, key=lambda x: -x[0]):
                gap = capacity - taker[0]
                effort -= len(giver[1]) * (1 + len(taker[1]))
                swap = _exchange(giver[1], taker[1], lengths, gap) if taker[0] >= giver[0] else None
                if swap is None:
                    continue
                out, back = swap
                gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                for i in out:
                    giver[1].remove(i)
                for i in back:
                    taker[1].remove(i)
                giver[1].extend(back)
                taker[1].extend(out)
                giver[0] -= gain
                taker[0] += gain
                if taker[0] == capacity:
                    held.remove(taker)
                    done.append(taker[1])
                moved = True
                break
        if giver[1]:
            stuck.append(giver)
    return done + [b for _, b in [*held, *stuck]]


def _exchange(giver: list[int], taker: list[int], lengths: list[int], gap: int):
    """(places that go, places that come back) with the largest gain of at most gap, or None."""
    best, found = 0, None
    for i in giver:
        n = lengths[i]
        if best < n <= gap:
            best, found = n, ((i,), ())
    if best == gap:
        return found
    ours = sorted({lengths[i]: i for i in giver}.items())
    theirs = sorted({lengths[i]: i for i in taker}.items())
    for a, j in theirs:
        for n, i in ours:
            if best < n - a <= gap:
                best, found = n - a, ((i,), (j,))
                if best == gap:
                    return found
    if len(giver) * len(taker) > 4096:  # many documents: single exchanges find enough
        return found
    for x, (n, i) in enumerate(ours):
        for m, k in ours[x + 1 :]:
            for a, j in theirs:
                if best < n + m - a <= gap:
                    best, found = n + m - a, ((i, k), (j,))
    for x, (a, j) in enumerate(theirs):
        for b, k in theirs[x + 1 :]:
            for n, i in ours:
                if best < n - a - b <= gap:
                    best, found = n - a - b, ((i,), (j, k))
    return found


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def written_order(docs: DataFrame) -> Column | None:
    """A number that rises along the rows of a table as its Parquet files were written, or None for other tables."""
    name, number = F.col("_metadata.file_name"), lambda p: F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), p, 1).try_cast("long"), F.lit(0))
    at = F.shiftleft(number(r"^part-(\d+)"), 40) + F.shiftleft(number(r"-c(\d+)\."), 32) + F.col("_metadata.row_index")
    try:
        docs.select(name, at)
    except AnalysisException:
        return None
    return at


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
    """Each text's ids with end_id last, cut where it exceeds the capacity: the first piece takes the odd rest.

    A text's number by ``order`` comes with its pieces as the column place.
    """
    ordered = order is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows, whose = batch.column(0).to_pylist(), [], []
            for i, ids in encoded(batch.column(1), tokenizer):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at, stop = 0, len(ids) % capacity or min(len(ids), capacity)
                piece = 0
                while at < len(ids):
                    rows.append((docs[i], piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
                    whose.append(i)
                    piece, at, stop = piece + 1, stop, stop + capacity
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            if ordered:
                columns, names = [*columns, batch.column(2).take(pa.array(whose, pa.int64()))], [*names, "place"]
            yield pa.RecordBatch.from_arrays(columns, names)

    if not ordered:
        return texts(docs, id_col, text_col).mapInArrow(lean(run, keep_encoder=True), _PIECES)
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("data"), order.alias("place"))
    return placed.mapInArrow(lean(run, keep_encoder=True), f"{_PIECES}, place long")


def _packed(frame: DataFrame, groups: int, level: int, capacity: int, schema: str, ordered: bool) -> DataFrame:
    """One task packs the rows of one group; level numbers the sequences apart.

    If ordered, a group is a range of rows, and a sequence has the number of its longest piece's row.
    """

    def run(key, table):
        rows, lengths = table.column("row").to_numpy(), table.column("length").to_pylist()
        order = np.argsort(rows, kind="stable")
        bins = pack([lengths[i] for i in order], capacity)
        sequence, offset, fill = (np.zeros(len(rows), np.int64) for _ in range(3))
        base = (level << 56) | (key[0].as_py() << 28) if key else 0
        for b, places in enumerate(bins):
            at = 0
            for p in places:
                i = order[p]
                sequence[i], offset[i] = base | b, at
                at += lengths[i]
            fill[order[places]] = at
            if ordered:
                sequence[order[places]] = rows[min((order[p] for p in places), key=lambda i: (-lengths[i], rows[i]))]
        out = table.drop_columns([*(["g"] if key else []), "sequence_id", "offset", "fill"])
        for name, column in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(column))
        return out

    def run_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(batches):
            yield from run((), pa.Table.from_batches(found)).to_batches()

    if ordered:
        return frame.repartitionByRange(groups, "row").mapInArrow(lean(run_range, keep_encoder=True), schema)
    grouped = frame.withColumn("g", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("long"))
    return grouped.groupBy("g").applyInArrow(run, schema)


def packed(cut: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces, a table with a column length of 1 to capacity.

    Full pieces are sequences of their own.  The others are dealt out at random to groups of
    about ``group`` pieces, one task each; the sequences of a group that stay underfull
    are taken apart and packed again with those of other groups, until one group holds all
    of them or no fewer are left.  Sequence numbers have gaps.

    If the pieces have a place, groups are ranges of consecutive places instead, and the
    numbers of the sequences rise with the places of their longest pieces.
    """
    work = Workspace(cut.sparkSession, "packing")
    ordered = "place" in cut.columns
    if ordered:  # written before, as ranges are drawn from a sample of it
        cut = work.write(cut, "cut").repartitionByRange("place", "piece").sortWithinPartitions("place", "piece").drop("place")
    base = cut.withColumn("row", F.monotonically_increasing_id())
    rows = work.write(base, "rows")
    blank = {"sequence_id": F.lit(None).cast("long"), "offset": F.lit(0).cast("long"), "fill": F.lit(0).cast("long")}
    whole = rows.where(F.col("length") == capacity).withColumns(blank | {"sequence_id": F.col("row") if ordered else -F.col("row") - 1})
    left = rows.where(F.col("length") < capacity).withColumns(blank)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    parts, count, level = [whole], left.count(), 1
    while count:
        groups = max(1, -(-count // group))
        done = work.write(_packed(left, groups, level, capacity, schema, ordered), f"level{level}")
        open_ = done.where(F.col("fill") < capacity)
        still = open_.count() if groups > 1 else 0
        if not still or still > 0.7 * count:
            parts.append(done)
            break
        parts.append(done.where(F.col("fill") == capacity))
        left, count, level = open_, still, level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("row", "fill")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ordered: bool = False) -> DataFrame:
    """Where each piece of each text stands in sequences of at most ``capacity`` ids.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty
    text is the end id alone.  Rows with a null doc_id and repeated rows are packed like
    any other.  Other columns are ignored.  If ordered, the sequences follow the written order of docs.
    """
    order = written_order(docs) if ordered else None
    return packed(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, order), capacity)
