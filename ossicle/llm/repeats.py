"""Windows of symbols that repeat across a corpus, found exactly and without large groups.

1. Every text's runs (see :mod:`anchors`) are dealt to buckets by their anchor, as packed arrays.
   What repeats within a task's flush is settled there, so a common passage sends one entry a flush.
2. A bucket compares runs with one anchor.  Equal contents are settled; an anchor with
   several contents asks for the texts of one run of each.
3. The asked runs are fetched and dealt to shards by a longer stretch around the anchor, which
   every window of theirs holds, and a shard looks for equal windows in its runs: a
   suffix sort or an FM-index, see :mod:`suffix` and :mod:`fmindex`.
4. All spans found meet with their documents.

Contents are equal if their 104-bit fingerprints are; at 10**13 runs a false match
has a chance of about 10**-5.  Mode ``earlier``: a window counts if it also starts in a
document with a smaller id.  Mode ``anywhere``: if it also starts anywhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .work import Workspace, as_bytes, lean, lean_group, shuffle_partitions, sweep

FLUSH = 1_000_000
_TABLES = np.random.default_rng(4).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_FIELDS = ["doc", "tag", "start", "count", "lead", "many", "low", "high", "content"]
_TYPES = {"doc": "<i8", "tag": "<i8", "start": "<u4", "count": "<u2", "lead": "<u2", "many": "u1", "low": "<u4", "high": "u1", "content": "<u8"}
_ENTRIES = "key int, kind int, " + ", ".join(f"{f} binary" for f in _FIELDS)
_ASKED = ["doc", "tag", "start", "count", "lead", "many"]
_SPANS = ["doc", "tag", "start", "count"]


@dataclass(frozen=True)
class Search:
    """What is looked for: windows of ``length`` symbols; words are symbols, or else bytes."""

    length: int
    k: int
    words: bool
    earlier: bool

    @property
    def stretch(self) -> int:
        """Symbols around an anchor that every window on one side of it holds."""
        return self.k + (self.length - self.k) // 2


def symbols(data: bytes, words: bool) -> np.ndarray:
    """A text's symbols as numbers: bytes, or 64-bit hashes of words."""
    if not words:
        return np.frombuffer(data, np.uint8)
    found = data.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def hashed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if values.dtype == np.uint8:
        return _TABLES[0][values], _TABLES[1][values]
    return values, anchors.mix(values ^ np.uint64(0x5851F42D4C957F2D))


def slabs(texts: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, their first symbols' places, symbols) of slabs; long texts are cut, overlapping by a window less one."""
    rows, offsets, parts, size = [], [], [], 0
    for i, x in enumerate(texts):
        for at in range(0, max(len(x) - length + 1, 0), anchors.SLAB - length):
            part = x[at : at + anchors.SLAB - 1]
            if size + len(part) > anchors.SLAB:
                yield np.array(rows), np.array(offsets), parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if rows:
        yield np.array(rows), np.array(offsets), parts


def entries(texts: list[np.ndarray], docs: np.ndarray, tags: np.ndarray, search: Search) -> dict[str, np.ndarray]:
    found = {f: [] for f in _FIELDS}
    for rows, offsets, parts in slabs(texts, search.length):
        first, second = hashed(np.concatenate(parts))
        ends = np.cumsum([len(p) for p in parts])
        text, start, count, anchor, content, lead = anchors.runs(first, second, ends, search.length, search.k)
        begins = np.concatenate(([0], ends[:-1]))
        own = rows[text]
        for name, x in (
            ("doc", docs[own]), ("tag", tags[own]), ("start", start - begins[text] + offsets[text]), ("count", count), ("lead", lead),
            ("many", np.zeros(len(own))), ("low", anchor & np.uint64(0xFFFFFFFF)), ("high", anchor >> np.uint64(32) & np.uint64(0xFF)), ("content", content),
        ):
            found[name].append(x.astype(_TYPES[name]))
    return {f: np.concatenate(x) if x else np.empty(0, _TYPES[f]) for f, x in found.items()}


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _take(e: dict[str, np.ndarray], which, fields: list[str] = _FIELDS) -> dict[str, np.ndarray]:
    return {f: e[f][which] for f in fields}


def settle(e: dict[str, np.ndarray], earlier: bool, last: bool):
    """(spans, what stays, asked) of sorted entries: equal anchor and content settles entries.

    Before the last step, what stays are the entries that other tasks may need: of equal ones those of the
    smallest document, or one that stands for many.  In the last step, asked are the runs
    whose anchor has other contents, too.
    """
    order = np.lexsort((e["start"], e["doc"], e["content"], e["low"], e["high"]))
    e = _take(e, order)
    n = len(order)
    at = _firsts(e["high"], e["low"], e["content"])
    sizes = np.diff(np.append(at, n))
    if earlier:
        smallest = np.repeat(e["doc"][at], sizes)
        removed = e["doc"] > smallest
        stays = ~removed
    else:
        total = np.add.reduceat(1 + e["many"].astype(np.int64), at) if n else np.empty(0, np.int64)
        removed = np.repeat(total >= 2, sizes)
        stays = np.zeros(n, bool)
        stays[at] = True
        e["many"][at] |= (total >= 2).astype(np.uint8)
    spans = merged(_take(e, removed, _SPANS))
    if not last:
        return spans, _take(e, stays), None
    group = _firsts(e["high"], e["low"])
    width = np.diff(np.append(group, n))
    contents = np.zeros(n, np.int64)
    contents[at] = 1
    several = np.add.reduceat(contents, group) >= 2 if n else np.empty(0, bool)
    if earlier and n:
        several &= np.maximum.reduceat(e["doc"], group) > np.minimum.reduceat(e["doc"], group)
    return spans, None, _take(e, np.repeat(several, width) & stays, _ASKED)


def merged(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of windows with those that touch or overlap joined; counts may grow beyond 16 bits."""
    order = np.lexsort((s["start"], s["tag"], s["doc"]))
    doc, tag, start = (s[f][order] for f in ("doc", "tag", "start"))
    if not len(order):
        return {"doc": doc, "tag": tag, "start": start, "count": s["count"].astype("<u4")}
    stop = start.astype(np.int64) + s["count"][order]
    text = _firsts(doc, tag)
    number = np.repeat(np.arange(len(text)), np.diff(np.append(text, len(doc))))
    room = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + number * room) - number * room
    new = np.ones(len(doc), bool)
    new[1:] = (number[1:] != number[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return {"doc": doc[at], "tag": tag[at], "start": start[at], "count": (reach[last] - start[at]).astype("<u4")}


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: high bytes compress well then."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _numbers(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _dealt(e: dict[str, np.ndarray], keys: np.ndarray, kind: int) -> pa.RecordBatch:
    """A row of packed arrays for each key, by document and place."""
    order = np.lexsort((e["start"], e["tag"], e["doc"], keys))
    keys = keys[order]
    at = _firsts(keys)
    stops = np.append(at[1:], len(keys))
    columns = []
    for f in _FIELDS:
        if f in e:
            x = np.ascontiguousarray(e[f][order])
            columns.append(pa.array([_planes(x[a:b]) for a, b in zip(at, stops)], pa.binary()))
        else:
            columns.append(pa.nulls(len(at), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(keys[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), *columns], ["key", "kind", *_FIELDS])


def _unpacked(table: pa.Table, fields: list[str], count: str = "<u2") -> dict[str, np.ndarray]:
    kinds = _TYPES | {"count": count}
    return {f: np.concatenate([np.empty(0, kinds[f]), *(_numbers(x, kinds[f]) for x in table.column(f).to_pylist())]) for f in fields}


def _document_key(e: dict[str, np.ndarray], n: int) -> np.ndarray:
    return (anchors.mix(e["doc"].view("<u8") ^ e["tag"].view("<u8")) % np.uint64(n)).astype(np.int32)


def _widen(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return e | {"count": e["count"].astype("<u4")}


def _first_pass(search: Search, buckets: int):
    def flush(texts, docs, tags) -> Iterator[pa.RecordBatch]:
        e = entries(texts, np.array(docs, np.int64), np.array(tags, np.int64), search)
        spans, e, _ = settle(e, search.earlier, False)
        key = (anchors.mix(e["low"].astype(np.uint64) | e["high"].astype(np.uint64) << np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        yield _dealt(e, key, 0)
        if len(spans["doc"]):
            yield _dealt(spans, _document_key(spans, buckets), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, docs, tags, size = [], [], [], 0
        for batch in batches:
            for doc, tag, data in zip(*(batch.column(i) for i in range(3))):
                texts.append(symbols(data.as_py(), search.words))
                docs.append(doc.as_py())
                tags.append(tag.as_py())
                size += len(texts[-1])
                if size >= FLUSH * (8 if not search.words else 6):
                    yield from flush(texts, docs, tags)
                    texts, docs, tags, size = [], [], [], 0
        if texts:
            yield from flush(texts, docs, tags)

    return run


def _bucket(search: Search, buckets: int):
    def run(key, table):
        spans = table.filter(pa.compute.equal(table.column("kind"), 1))
        packed = table.filter(pa.compute.equal(table.column("kind"), 0))
        out = [_dealt(x, _document_key(x, buckets), 1) for x in [merged(_unpacked(spans, _SPANS, "<u4"))] if len(x["doc"])]
        if packed.num_rows:
            found, _, asked = settle(_unpacked(packed, _FIELDS), search.earlier, True)
            out += [_dealt(x, _document_key(x, buckets), kind) for x, kind in ((found, 1), (_widen(asked), 2)) if len(x["doc"])]
        return pa.Table.from_batches(out, schema=_schema(["key", "kind"], _FIELDS))

    return run


def _schema(ints: list[str], binaries: list[str]) -> pa.Schema:
    return pa.schema([*(pa.field(n, pa.int32()) for n in ints), *(pa.field(n, pa.binary()) for n in binaries)])


def _by_document(fields: list[str]):
    """A row for each document from the packed arrays of a bucket of documents."""

    def run(key, table):
        e = _unpacked(table, fields, "<u4")
        if fields == _SPANS:
            e = merged(e)
        else:
            e = _take(e, np.lexsort((e["start"], e["tag"], e["doc"])), fields)
        at = _firsts(e["doc"], e["tag"])
        stops = np.append(at[1:], len(e["doc"]))
        columns = [pa.array(e["doc"][at]), pa.array(e["tag"][at])]
        columns += [pa.array([e[f][a:b].tobytes() for a, b in zip(at, stops)], pa.binary()) for f in fields[2:]]
        return pa.table(columns, names=["doc", "tag", *fields[2:]])

    return run


def _fetch(search: Search, shards: int):
    """Asked runs with their symbols, dealt to shards by the stretch on one side of the anchor."""
    width, half = np.dtype(np.uint64 if search.words else np.uint8).itemsize, search.stretch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {f: [] for f in ("shard", "doc", "tag", "start", "count", "text")}
            for doc, tag, data, *packed in zip(*(batch.column(i).to_pylist() for i in range(7))):
                x = np.ascontiguousarray(symbols(data, search.words))
                raw = x.tobytes()
                start, count, lead, _ = (np.frombuffer(p, t).astype(np.int64) for p, t in zip(packed, ("<u4", "<u4", "<u2", "u1")))
                for s, n, p in zip(start.tolist(), count.tolist(), (start + lead).tolist()):
                    split = min(max(p - (search.length - half), s), s + n)  # windows from here on hold the stretch after the anchor
                    for a, b, u in ((split, s + n, p), (s, split, p + search.k - half)):
                        if a < b:
                            key = xxhash.xxh64_intdigest(raw[u * width : (u + half) * width])
                            for f, v in zip(rows, (key, doc, tag, a, b - a, raw[a * width : (b - 1 + search.length) * width])):
                                rows[f].append(v)
            if rows["doc"]:
                shard = np.array(rows["shard"], np.uint64)
                where = (shard % np.uint64(shards)).astype(np.int32)
                order = np.lexsort((shard, where))
                at = _firsts(where[order])
                out = []
                for a, b in zip(at, np.append(at[1:], len(order))):
                    some = order[a:b]
                    lists = [np.array([rows[f][i] for i in some]) for f in _SPANS]
                    out.append((int(where[some[0]]), shard[some].tobytes(), *(x.astype("<i8").tobytes() for x in lists), b"".join(rows["text"][i] for i in some)))
                names = ["shard", "keys", *_SPANS, "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out))], names)

    return run


_RUNS = "shard int, keys binary, doc binary, tag binary, start binary, count binary, text binary"


def _shard(search: Search, buckets: int, resolve: Callable):
    """resolve(text, begin, count, length) -> a number for each window of the runs: equal windows have equal numbers."""
    length, dtype = search.length, np.dtype(np.uint64 if search.words else np.uint8)

    def run(key, table):
        whole = {f: np.frombuffer(b"".join(table.column(f).to_pylist()), "<i8" if f != "keys" else "<u8") for f in ("keys", *_SPANS)}
        text = np.frombuffer(b"".join(table.column("text").to_pylist()), dtype)
        lens = whole["count"] + length - 1
        begin = np.cumsum(lens) - lens
        order = np.argsort(whole["keys"], kind="stable")
        at = _firsts(whole["keys"][order])
        sizes = np.diff(np.append(at, len(order)))
        alone = sizes < 2
        if search.earlier:
            doc = whole["doc"][order]
            alone |= np.minimum.reduceat(doc, at) == np.maximum.reduceat(doc, at)
        used = order[np.repeat(~alone, sizes)]
        empty = pa.Table.from_batches([], schema=_schema(["key", "kind"], _FIELDS))
        if not len(used):
            return empty
        n = whole["count"][used]
        row = np.repeat(np.arange(len(used)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = resolve(text, begin[used], n, length)
        doc = whole["doc"][used][row]
        if search.earlier:
            smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, group, doc)
            removed = doc > smallest[group]
        else:
            removed = np.bincount(group)[group] >= 2
        found = {"doc": doc[removed], "tag": whole["tag"][used][row][removed], "start": (whole["start"][used][row] + inner)[removed].astype("<u4"), "count": np.ones(removed.sum(), "<u2")}
        found = merged(found)
        if not len(found["doc"]):
            return empty
        return pa.Table.from_batches([_dealt(found, _document_key(found, buckets), 1)], schema=_schema(["key", "kind"], _FIELDS))

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str, more: list[str] = []) -> DataFrame:  # noqa: B006
    """(doc_id, doc, tag, data): doc and tag tell rows apart, but for rows with equal id and text.

    The tag is a hash of the text, or zero if no id comes twice, as is usual: it costs much room.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("data"), *more)
    none = F.col("doc_id").isNull()
    twice = docs.groupBy(F.col(id_col).cast("long")).count().where("count > 1").limit(1).count()
    tag = F.xxhash64(none, "data") if twice else none.cast("long")
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), tag.alias("tag"), "data", *more)


def _settled(rows: DataFrame, search: Search, buckets: int, work: Workspace) -> DataFrame:
    usable = rows.where("doc_id is not null") if search.earlier else rows
    usable = usable.where(F.octet_length("data") >= (2 * search.length - 1 if search.words else search.length))
    first = usable.select("doc", "tag", "data").mapInArrow(lean(_first_pass(search, buckets)), _ENTRIES)
    return work.write(first.groupBy("kind", "key").applyInArrow(lean_group(_bucket(search, buckets)), _ENTRIES), "settled")


def _shards(rows: DataFrame, settled: DataFrame, search: Search, buckets: int, resolve: Callable, work: Workspace) -> DataFrame:
    asked = settled.where("kind = 2").groupBy("key").applyInArrow(lean_group(_by_document(_ASKED)), "doc long, tag long, start binary, count binary, lead binary, many binary")
    # a merge join at any size, in whose partitions nothing grows with the input
    fetched = rows.select("doc", "tag", "data").join(asked.hint("merge"), ["doc", "tag"]).select("doc", "tag", "data", "start", "count", "lead", "many")
    runs = fetched.mapInArrow(lean(_fetch(search, buckets)), _RUNS)
    return work.write(runs.groupBy("shard").applyInArrow(lean_group(_shard(search, buckets, resolve)), _ENTRIES), "shards")


def spans(rows: DataFrame, search: Search, resolve: Callable, work: Workspace, part_bytes: int = 1 << 24) -> DataFrame:
    """(doc, tag, start, count): packed arrays of the windows of each text of rows that count."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(spark), -(-size // part_bytes))
    settled = _settled(rows, search, buckets, work)
    sweep(spark)  # the plans that made a table are gone by now, so their shuffle files can go
    shards = _shards(rows, settled, search, buckets, resolve, work)
    sweep(spark)
    both = settled.where("kind = 1").unionByName(shards).select("key", *_SPANS)
    found = both.groupBy("key").applyInArrow(lean_group(_by_document(_SPANS)), "doc long, tag long, start binary, count binary")
    return work.write(found, "spans")


def mask(start: bytes | None, count: bytes | None, n: int, length: int) -> np.ndarray:
    """Which of n symbols the windows of packed spans cover."""
    change = np.zeros(n + 1, np.int64)
    if start:
        a = np.frombuffer(start, "<u4").astype(np.int64)
        np.add.at(change, a, 1)
        np.add.at(change, a + np.frombuffer(count, "<u4") + length - 1, -1)
    return np.cumsum(change[:-1]) > 0
