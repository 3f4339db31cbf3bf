"""Problem 1: continuous periods and gaps of overlapping intervals, by dyadic blocks.

Each half-open interval of whole days is cut into its canonical dyadic blocks (aligned blocks of 2**k days). Blocks are a
closed, small vocabulary: however many intervals a key has, its *distinct* blocks are limited by the calendar, so the
map-side set aggregation shrinks a hot key before anything is shuffled. Blocks up to 2**10 days are gathered by (key,
chunk of that size) and reduced there: blocks with an ancestor present are dropped, complete sibling pairs become
their parent, level by level. Full chunks and longer blocks form one upper tree per key, reduced the same way; chunks
under one of its blocks are dropped. What is left is the canonical form of the union: no block lies in another and no
two are siblings. Touching blocks are then joined. Array batches are reduced by numpy, many keys at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days are counted from 0001-01-01; 2**22 days reach past the year 9999 and stand for "open".
DOMAIN_LEVEL = 22
#: Blocks up to 2**10 days are merged within their chunk of that size, longer ones in the key's upper tree.
CHUNK_LEVEL = 10
OPEN_DAY = 1 << DOMAIN_LEVEL
# A block's code in a key's row: its chunk times _CHUNK_CODE and its node; the upper tree counts as chunk _UPPER.
_CHUNK_CODE = 1 << (DOMAIN_LEVEL - CHUNK_LEVEL + 1)
_UPPER = 1 << (DOMAIN_LEVEL - CHUNK_LEVEL)
_ORIGIN = "0001-01-01"


def day_number(day: Column) -> Column:
    """Days since 0001-01-01 of a DATE."""
    return F.datediff(day, F.lit(_ORIGIN).cast("date"))


def number_day(number: Column) -> Column:
    """The DATE of a day number, the inverse of :func:`day_number`."""
    return F.date_add(F.lit(_ORIGIN).cast("date"), number.cast("int"))


def dyadic_blocks(start: Column, end: Column, levels: int = DOMAIN_LEVEL) -> Column:
    """array<struct<level,idx>>: the canonical dyadic decomposition of the integers [start, end), in blocks up to 2**levels.

    At level k the interval spans the whole blocks ceil(start/2**k) .. floor(end/2**k); the leftmost belongs to the
    decomposition if its index is odd, the rightmost if the index after it is odd. At most two blocks per level.
    """

    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), level)
        left = F.floor((start + width - 1) / width).cast("int")
        right = F.floor(end / width).cast("int")
        inner = left + left % 2
        return F.concat(
            F.when((left % 2 == 1) & (left < right), F.array(F.struct(level.alias("level"), left.alias("idx")))).otherwise(
                _no_blocks()
            ),
            F.when((right % 2 == 1) & (inner < right), F.array(F.struct(level.alias("level"), (right - 1).alias("idx")))).otherwise(
                _no_blocks()
            ),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def _no_blocks() -> Column:
    return F.array().cast("array<struct<level:int,idx:int>>")


def _reduced(group: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, node, start, size) of the reduced trees of a batch, in order of group and start.

    Nodes are heap-numbered (root 1, children 2n and 2n+1, leaves at ``depth``). A node with an ancestor in its group is
    dropped, then complete sibling pairs become their parent, level by level from the leaves to the root.
    """
    level = np.frexp(node.astype(np.float64))[1] - 1
    start = (node - (1 << level)) << (depth - level)
    size = np.left_shift(1, depth - level)
    # Blocks are nested or apart: of those that begin together the longest first, one is covered if an earlier one ends no sooner.
    order = np.lexsort((-size, start, group))
    group, node, level = group[order], node[order], level[order]
    end = group * (2 << depth) + (start + size)[order]
    reach = np.maximum.accumulate(np.concatenate([[-1], end[:-1]]))
    keep = end > reach
    group, node, level = group[keep], node[keep], level[keep]
    for at in range(depth, 0, -1):
        here = level == at
        left = np.flatnonzero(here[:-1] & here[1:] & (node[:-1] % 2 == 0) & (node[1:] == node[:-1] + 1) & (group[:-1] == group[1:]))
        if len(left):
            node[left] >>= 1
            level[left] -= 1
            group, node, level = (np.delete(x, left + 1) for x in (group, node, level))
    return group, node, (node - (1 << level)) << (depth - level), np.left_shift(1, depth - level)


def _flat(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row number, value) of every element of a column of integer arrays."""
    lengths = np.fromiter(map(len, arrays), np.int64, len(arrays))
    values = np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64)
    return np.repeat(np.arange(len(arrays)), lengths), values


def _parted(group: np.ndarray, groups: int, *columns: np.ndarray) -> list[list[np.ndarray]]:
    """Columns in order of group as one array per group."""
    borders = np.searchsorted(group, np.arange(1, groups))
    return [np.split(c.astype(np.int32), borders) for c in columns]


def _reduce_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tree of each (key, chunk) reduced; long blocks pass on to the upper tree."""
    for batch in batches:
        long = batch["chunk"] < 0
        group, node = _flat(batch.loc[~long, "nodes"])
        group, node, _, _ = _reduced(group, node, CHUNK_LEVEL)
        code = batch.loc[~long, "chunk"].to_numpy(np.int64)[group] * _CHUNK_CODE + node
        low = batch.loc[~long, ["k"]].assign(codes=_parted(group, int((~long).sum()), code)[0] if (~long).any() else [])
        yield pd.concat([low, batch.loc[long, ["k"]].assign(codes=[x + _UPPER * _CHUNK_CODE for x in batch.loc[long, "nodes"]])])


def _reduce_keys(coalesced: bool):
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The upper tree of each key reduced, with its full chunks as leaves, and the chunks that it does not cover."""
        for batch in batches:
            group, code = _flat(batch["codes"])
            chunk, node = code // _CHUNK_CODE, code % _CHUNK_CODE
            depth, full = DOMAIN_LEVEL - CHUNK_LEVEL, (chunk < _UPPER) & (node == 1)
            high = full | (chunk == _UPPER)
            ug, _, us, uz = _reduced(group[high], np.where(full, (1 << depth) + chunk, node)[high], depth)
            place = lambda g, c: g * (2 << depth) + c
            lg, lc, ln = group[~high], chunk[~high], node[~high]
            if len(ug):
                at = np.searchsorted(place(ug, us), place(lg, lc), "right") - 1
                open_ = (at < 0) | (place(ug, us + uz)[np.maximum(at, 0)] <= place(lg, lc))
                lg, lc, ln = lg[open_], lc[open_], ln[open_]
            level = np.frexp(ln.astype(np.float64))[1] - 1
            begin = np.concatenate([us << CHUNK_LEVEL, (lc << CHUNK_LEVEL) + ((ln - (1 << level)) << (CHUNK_LEVEL - level))])
            end = begin + np.concatenate([uz << CHUNK_LEVEL, np.left_shift(1, CHUNK_LEVEL - level)])
            group = np.concatenate([ug, lg])
            order = np.lexsort((begin, group))
            group, begin, end = group[order], begin[order], end[order]
            if coalesced and len(group):
                fresh = np.concatenate([[True], (begin[1:] != end[:-1]) | (group[1:] != group[:-1])])
                group, begin, end = group[fresh], begin[fresh], end[np.concatenate([fresh[1:], [True]])]
            starts, ends = _parted(group, len(batch), begin, end) if len(batch) else ([], [])
            yield pd.DataFrame({"k": batch["k"], "starts": starts, "ends": ends})

    return reduce


def _merged(spans: DataFrame, key: str, start: str, end: str, coalesced: bool) -> DataFrame:
    """(k, starts, ends), one row per key: its merged blocks in order, or the periods of touching blocks.

    A key's row has at most one entry per two days of the calendar.
    """
    chunk, low = CHUNK_LEVEL, F.col("b.level") <= CHUNK_LEVEL
    usable = (
        spans.select(F.col(key).alias("k"), F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("e"))
        .where(F.col("k").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("s") < F.col("e")))
    )
    nodes = usable.select("k", F.explode(dyadic_blocks(F.col("s"), F.col("e"))).alias("b")).select(
        "k",
        F.when(low, F.expr(f"shiftright(b.idx, {chunk} - b.level)")).otherwise(-1).alias("chunk"),
        F.when(low, F.expr(f"shiftleft(1, {chunk} - b.level) + (b.idx & (shiftleft(1, {chunk} - b.level) - 1))"))
        .otherwise(F.expr(f"shiftleft(1, {DOMAIN_LEVEL} - b.level) + b.idx"))
        .alias("node"),
    )
    kind = usable.schema["k"].dataType.simpleString()
    gathered = nodes.groupBy("k", "chunk").agg(F.collect_set("node").alias("nodes"))
    chunks = gathered.mapInPandas(_reduce_chunks, f"k {kind}, codes array<int>")
    keys = chunks.groupBy("k").agg(F.flatten(F.collect_list("codes")).alias("codes"))
    return keys.mapInPandas(_reduce_keys(coalesced), f"k {kind}, starts array<int>, ends array<int>")


def interval_blocks(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end) of disjoint merged dyadic blocks for integer spans [start, end) of each key.

    No block has an ancestor or its sibling in the result, at any level. Spans with a null bound, a null key or no
    day are ignored; repeated spans change nothing; spans lie in [0, 2**22].
    """
    return _merged(spans, key, start, end, False).select(F.col("k").alias(key), F.inline(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e"))).alias(start, end))


def periods_and_gaps(intervals: DataFrame, key: str, from_day: str, to_day: str) -> DataFrame:
    """(key, kind, from_day, to_day): continuous periods and the gaps between them, as day strings.

    ``intervals`` holds half-open DATE ranges. A null or 9999-12-31 end is open and gives ``to_day`` ''. Rows without
    start, without key or with end <= start do not count. An empty table gives an empty result; extra columns are ignored.
    """
    end = F.when(F.col(to_day).isNull() | (F.col(to_day) >= F.lit("9999-12-31").cast("date")), OPEN_DAY).otherwise(
        day_number(F.col(to_day))
    )
    spans = intervals.select(F.col(key).alias("k"), day_number(F.col(from_day)).alias("s"), end.alias("e"))
    text = lambda c: F.when(c >= OPEN_DAY, F.lit("")).otherwise(number_day(c).cast("string"))
    # A key's periods are one row, so each gap is read between two neighbours of it.
    following = _merged(spans, "k", "s", "e", True).select("k", "starts", F.posexplode("ends").alias("i", "e"))
    placed = following.select("k", F.get("starts", F.col("i")).alias("s"), "e", F.get("starts", F.col("i") + 1).alias("n"))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("f"), F.col("e").alias("t")),
        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("f"), F.col("n").alias("t")),
    )
    return (
        placed.select("k", F.inline(rows))
        .where(F.col("t").isNotNull())
        .select(F.col("k").alias(key), "kind", text(F.col("f")).alias("from_day"), text(F.col("t")).alias("to_day"))
    )
