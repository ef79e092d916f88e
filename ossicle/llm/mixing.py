"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996), in DataFrame operations only.

Each source's documents form blocks.  With weight w, block k is released at slot floor(k / w) and due
by slot ceil((k + 1) / w); in every slot the released block with the earliest deadline runs.
Weights are whole numbers of slots of a period, so the schedule repeats: the driver computes one
period, a table of ``period`` slots whatever the input, and a block's slot follows from its
number by arithmetic.  When a source has run out, the rest go on under weights scaled up
to fill the slots, from a new period: at most one phase a source.  Within a phase
every source has at all times less than one block more or less than its weight asks for.
"""

from __future__ import annotations

import heapq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a period: weights are kept to a thousandth or so.
PERIOD = 1009


def whole_shares(weights: list[float], period: int = PERIOD) -> list[int]:
    """Slots of a period for each source, by largest remainders, at least one each."""
    total = sum(weights)
    if not weights or min(weights) <= 0 or len(weights) > period:
        raise ValueError("weights must be positive, and no more of them than slots")
    exact = [w / total * (period - len(weights)) for w in weights]
    shares = [int(x) for x in exact]
    for i in sorted(range(len(exact)), key=lambda i: shares[i] - exact[i])[: period - len(weights) - sum(shares)]:
        shares[i] += 1
    return [s + 1 for s in shares]


def period_schedule(shares: list[int]) -> list[int]:
    """The source of each slot of one period: earliest deadline first among the released blocks."""
    period = sum(shares)
    out, ready = [], []
    waiting = [(0, -(-period // s), i, 0) for i, s in enumerate(shares)]
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, due, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, k))
        due, i, k = heapq.heappop(ready)  # never empty: the weights sum to one
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append(i)
        k += 1
        if k < shares[i]:
            heapq.heappush(waiting, (max(slot + 1, k * period // shares[i]), -(-(k + 1) * period // shares[i]), i, k))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[dict]:
    """The phases of a mix: sources, slots in a period of each, its length and the blocks done before.

    blocks: how many each source has, weights: its target.  A phase ends with the slot in
    which a first source runs out; sources that run out with it leave too.
    """
    done, out, start = dict.fromkeys(blocks, 0), [], 0
    while active := sorted(s for s in blocks if done[s] < blocks[s]):
        shares = whole_shares([weights[s] for s in active], period)
        table = period_schedule(shares)
        places = [[i for i, x in enumerate(table) if x == a] for a in range(len(active))]
        ends = []
        for s, share, at in zip(active, shares, places):
            whole, rest = divmod(blocks[s] - done[s] - 1, share)
            ends.append(whole * period + at[rest] + 1)
        length = min(ends)
        whole, rest = divmod(length, period)
        out.append({"start": start, "length": length, "sources": {s: {"first": done[s], "share": sh, "at": p} for s, sh, p in zip(active, shares, places)}})
        for s, share, at in zip(active, shares, places):
            done[s] += whole * share + sum(x < rest for x in at)
        start += length
    return out


def _block_numbers(docs: DataFrame, counts: dict[str, int], order: list[str], spread: list[str], size: int, rows_a_task: int) -> DataFrame:
    """docs, which has a column _key, with the columns block and place in the block.

    A source's rows are spread over parts by a hash; a row's number is its number in its part
    after the rows of the parts before, so a large source is no single task.
    """
    pairs = ",".join(f"{_text(k)}, {-(-n // rows_a_task)}L" for k, n in counts.items())
    parts = F.element_at(F.expr(f"map({pairs})"), F.col("_key"))
    hashed = docs.withColumn("_h", F.xxhash64(*spread)).withColumn("_part", F.pmod(F.col("_h"), parts))
    before = hashed.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_h", *order)))
    number = F.col("_before") + F.col("_r") - 1
    numbered = ranked.join(before, ["_key", "_part"]).withColumn("block", F.floor(number / size).cast("long"))
    return numbered.withColumn("place", (number % size).cast("int")).drop("_part", "_h", "_r", "_before")


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id",
    block_size: int = 16, temperature: float = 0.5, period: int = PERIOD, rows_a_task: int = 2_000,
) -> DataFrame:
    """docs with the columns block, place, slot and position (bigint from 0), all rows kept.

    Ordered by slot and place, the rows interleave the sources' blocks by their weights.  Without
    weights, a source weighs its number of rows to the power ``temperature``; a source that
    weights doesn't name, or a null one, goes by the same rule and shares what the smallest
    named weight has.  position numbers all rows without gaps.  Rows of a source are shuffled
    by a hash of the id and the numbers; equal rows are in no order among themselves.  There may be
    ``period`` sources at most, which bounds what the driver holds; columns of
    docs with the names of the new ones are replaced.
    """
    docs = docs.drop("block", "place", "slot", "position")
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source_col).cast("string")).count().orderBy(F.desc("count"), source_col).limit(period + 1).collect()}
    if len(counts) > period:
        raise ValueError(f"more than {period} sources")
    if not counts:
        blank = {"block": "long", "place": "int", "slot": "long", "position": "long"}
        return docs.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()})
    named = dict(weights or {})
    least = min(named.values(), default=1.0)
    other = [s for s in counts if s not in named]
    top = max((counts[s] for s in other), default=1)
    named |= {s: least * (counts[s] / top) ** temperature if weights else counts[s] ** temperature for s in other}
    key = {s: f"={s}" if s is not None else "null" for s in counts}
    plan = phases({key[s]: -(-n // block_size) for s, n in counts.items()}, {key[s]: named[s] for s in counts}, period)
    spread = [c for c, t in docs.dtypes if t in ("bigint", "int", "double") or c == id_col]
    order = [c for c, t in docs.dtypes if t in ("string", "bigint", "int", "double")]
    mark = F.when(F.col(source_col).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = _block_numbers(docs.withColumn("_key", mark), {key[s]: n for s, n in counts.items()}, order, spread, block_size, rows_a_task)
    spans = _spans(docs, plan, counts, key, block_size, period)
    joined = rows.join(F.broadcast(spans), (F.col("_key") == F.col("_k")) & (F.col("block") >= F.col("_first")) & (F.col("block") < F.col("_next")))
    turn = F.col("block") - F.col("_first")
    slot = F.col("_start") + F.floor(turn / F.col("_share")) * period + F.element_at("_at", (turn % F.col("_share")).cast("int") + 1)
    # all slots before are full blocks but for the last ones of the sources that ended in earlier phases
    position = slot * block_size - F.col("_short") + F.col("place")
    return joined.withColumn("slot", slot.cast("long")).withColumn("position", position.cast("long")).select(*docs.columns, "block", "place", "slot", "position")


def _spans(docs: DataFrame, plan: list[dict], counts: dict, key: dict, size: int, period: int) -> DataFrame:
    """A row for each source and phase, from literals; as many as sources times phases at most."""
    short = {key[s]: -n % size for s, n in counts.items()}
    last = {s: i for i, p in enumerate(plan) for s in p["sources"]}
    rows = []
    for i, p in enumerate(plan):
        lacking = sum(short[s] for s, j in last.items() if j < i)
        for s, x in p["sources"].items():
            whole, rest = divmod(p["length"], period)
            n = whole * x["share"] + sum(a < rest for a in x["at"])
            if n:
                at = "array(" + ",".join(f"{a}L" for a in x["at"]) + ")"
                rows.append(f"({_text(s)}, {x['first']}L, {x['first'] + n}L, {p['start']}L, {x['share']}L, {lacking}L, {at})")
    return docs.sparkSession.sql(f"select * from values {', '.join(rows)} as t(_k, _first, _next, _start, _share, _short, _at)")
