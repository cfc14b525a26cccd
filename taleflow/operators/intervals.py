"""Continuous periods and gaps of time intervals per entity.

The aggregate's state is a sorted list of disjoint intervals. States are built
per input partition (map side), merged linearly in a reduction tree, and read
off as periods and gaps:

1. every task folds its rows into one state per (entity, block), where a block
   is a fixed stretch of start times. Repeats and nested intervals vanish here,
   before anything is shuffled;
2. the states of one (entity, block) meet and are merged pairwise in a tree of
   linear merges. A state of a block is bounded by the block's length in
   milliseconds, never by the number of rows, so an entity with a third of all
   rows neither collects in one task nor grows a list without bound;
3. the blocks of an entity are chained through their summaries (one small row
   of numbers per block, never its lists): the running maximum of the ends
   before a block tells which of its intervals continue an earlier period, and
   the last interval left open tells where that period began. So the windows
   over an entity sort as many rows as it has hours, whatever its intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise

BLOCK_MS = 3_600_000
_STATE = "entity string, block long, starts array<long>, ends array<long>"


def fold(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals per group; intervals that touch are joined."""
    if not len(start):
        return group, start, end
    order = np.lexsort((end, start, group))
    g, s, e = group[order], start[order], end[order]
    first = np.r_[True, g[1:] != g[:-1]]
    # the running maximum restarts with each group: groups are lifted above one another by rank
    ranks, rank_of = np.unique(e, return_inverse=True)
    lift = (np.cumsum(first) - 1) * (len(ranks) + 1)
    reach = ranks[(np.maximum.accumulate(rank_of + lift) - lift)]
    opens = first.copy()
    opens[1:] |= s[1:] > reach[:-1]
    at = np.flatnonzero(opens)
    last = np.r_[at[1:] - 1, len(s) - 1]
    return g[at], s[at], reach[last]


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge two states; both lists are sorted already, so placing one in the other is linear."""
    at = np.searchsorted(a[0], b[0], side="right") + np.arange(len(b[0]))
    n = len(a[0]) + len(b[0])
    s, e, from_a = np.empty(n, np.int64), np.empty(n, np.int64), np.ones(n, bool)
    from_a[at] = False
    s[at], e[at] = b
    s[from_a], e[from_a] = a
    reach = np.maximum.accumulate(e)
    opens = np.r_[True, s[1:] > reach[:-1]]
    first = np.flatnonzero(opens)
    return s[first], reach[np.r_[first[1:] - 1, n - 1]]


def merge_tree(states: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Reduction tree of :func:`merge`."""
    while len(states) > 1:
        states = [merge(states[i], states[i + 1]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return states[0]


def _lists(entity: list, block: list, states: list) -> pa.RecordBatch:
    offsets = np.r_[0, np.cumsum([len(s) for s, _ in states])].astype(np.int32)
    flat = [np.concatenate([x[i] for x in states]) if states else np.zeros(0, np.int64) for i in (0, 1)]
    cols = [pa.array(entity, pa.string()), pa.array(block, pa.int64()), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(f)) for f in flat)]
    return pa.RecordBatch.from_arrays(cols, names=["entity", "block", "starts", "ends"])


def _partial(block_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("entity").dictionary_encode()
            start, end = (batch.column(c).to_numpy() for c in ("start_ms", "end_ms"))
            block = start // block_ms
            code = names.indices.to_numpy().astype(np.int64)
            blocks, block_code = np.unique(block, return_inverse=True)
            g, s, e = fold(code * len(blocks) + block_code, start, end)
            cuts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
            heads = g[cuts[:-1]]
            entity = names.dictionary.take(pa.array(heads // len(blocks))).to_pylist()
            yield _lists(entity, blocks[heads % len(blocks)].tolist(), [(s[a:b], e[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])

    return run


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (entity, block); states of one key are merged as they pass."""
    key, held = None, []
    for batch in batches:
        entities, blocks = batch.column("entity").to_pylist(), batch.column("block").to_pylist()
        starts, ends = batch.column("starts"), batch.column("ends")
        so, sv, ev = starts.offsets.to_numpy(), starts.values.to_numpy(), ends.values.to_numpy()
        out_e, out_b, out_s = [], [], []
        for i, k in enumerate(zip(entities, blocks)):
            if k != key:
                if held:
                    out_e.append(key[0]), out_b.append(key[1]), out_s.append(merge_tree(held))
                key, held = k, []
            held.append((sv[so[i] : so[i + 1]], ev[so[i] : so[i + 1]]))
            if len(held) == 64:
                held = [merge_tree(held)]
        if out_e:
            yield _lists(out_e, out_b, out_s)
    if held:
        yield _lists([key[0]], [key[1]], [merge_tree(held)])


def interval_states(df: DataFrame, entity: str, start_ms: str, end_ms: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """Sorted disjoint intervals per (entity, block of start times).

    Rows with a null entity, start or end, or an end not after the start, do
    not count. Columns: entity, block, starts, ends.
    """
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(start_ms).cast("long").alias("start_ms"), F.col(end_ms).cast("long").alias("end_ms"))
    rows = rows.filter("entity is not null and start_ms is not null and end_ms is not null and end_ms > start_ms")
    partial = rows.mapInArrow(_partial(block_ms), _STATE)
    return partial.repartition("entity", "block").sortWithinPartitions("entity", "block").mapInArrow(_reduce, _STATE)


def periods_and_gaps(df: DataFrame, entity: str, start_ms: str, end_ms: str, block_ms: int = BLOCK_MS) -> DataFrame:
    """One row per continuous period and per gap between two successive periods.

    Columns: entity string, kind ('period' or 'gap'), start_ms long, end_ms
    long. Intervals that touch belong to one period. Null, empty and reversed
    intervals do not count; repeats change nothing; an entity without any
    valid interval has no row; an empty input gives an empty result. Other
    columns of ``df``, whatever their names, are not read.
    """
    states = materialise(interval_states(df, entity, start_ms, end_ms, block_ms), "intervals")
    by_block = Window.partitionBy("entity").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    ends = states.select("entity", "block", F.element_at("ends", -1).alias("last_end")).withColumn("reach", F.max("last_end").over(before)).select("entity", "block", "reach")
    # an interval opens a period unless the reach of earlier blocks touches it
    n_in = F.when(F.col("reach").isNull(), 0).otherwise(F.size(F.filter("starts", lambda s: s <= F.col("reach"))))
    opens = states.join(ends, ["entity", "block"]).withColumn("n_in", n_in)
    n, at = F.size("starts") - F.col("n_in"), F.col("n_in") + 1
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_ms"), b.alias("end_ms"))
    # what lies between the intervals of one block that open periods
    inside = opens.filter(n > 1).select("entity", F.slice("starts", at, n).alias("s"), F.slice("ends", at, n).alias("e"))
    inside = inside.select("entity", F.posexplode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("s"), F.slice("e", 1, F.size("e") - 1).alias("e"), F.slice("s", 2, F.size("s")).alias("next"))).alias("i", "x"))
    inside = inside.select("entity", F.explode(F.array(row("period", F.col("x.s"), F.col("x.e")), row("gap", F.col("x.e"), F.col("x.next")))).alias("r"))
    # one row of numbers per block: where its first and last period opens, where all before its first ends, and its reach
    ends_before = F.when(F.col("n_in") > 0, F.greatest("reach", F.element_at("ends", F.greatest(F.col("n_in"), F.lit(1))))).otherwise(F.col("reach"))
    chain = opens.select(
        "entity", "block", F.when(n > 0, F.element_at("starts", F.least(at, F.size("starts")))).alias("first"), F.when(n > 0, F.element_at("starts", -1)).alias("last"),
        ends_before.alias("closed"), F.greatest("reach", F.element_at("ends", -1)).alias("end_after"),
    )
    chain = chain.withColumns({"open_before": F.last("last", ignorenulls=True).over(before), "is_last": F.lead("block").over(by_block).isNull()})
    # the period left open by an earlier block and the gap after it; what is open after the last block
    left_open = F.array(row("period", F.col("open_before"), F.col("closed")), row("gap", F.col("closed"), F.col("first")))
    at_end = F.array(row("period", F.coalesce("last", "open_before"), F.col("end_after")))
    nothing = F.array().cast("array<struct<kind: string, start_ms: bigint, end_ms: bigint>>")
    between = chain.select("entity", F.explode(F.concat(F.when(F.col("first").isNotNull() & F.col("open_before").isNotNull(), left_open).otherwise(nothing), F.when(F.col("is_last"), at_end).otherwise(nothing))).alias("r"))
    return inside.union(between).select("entity", "r.kind", "r.start_ms", "r.end_ms")
