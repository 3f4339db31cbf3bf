"""Problem 9: filling containers of fixed capacity, by bulk-synchronous best-fit.

Each round range-sorts the open gaps and the waiting items together, from large to small. A sweep down this order is a
stack: a gap is pushed, an item takes the gap on top, which is the smallest gap not yet taken that holds it. The depth of
the stack is a prefix sum, so the sweep runs in parallel: every partition's runs of equal sizes are counted, the few counts
(sizes are at most the capacity) give each run the depth it starts at, and an item is matched with the last gap pushed at its
depth. All takers of one gap thus differ in rank, and each round is a conflict-free matching. Gaps shrink and the
round repeats with the items left; what no gap holds opens as few new containers as its total size needs. Once only small
items wait, and many for each gap, a round lays all of them along all gaps and a gap takes every item that falls inside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.relational import dense_ordinal
from palimpsest.session import cut_lineage, local_rows

CAPACITY = 2048
_GAP, _ITEM = 0, 1
#: If more items than this wait for each gap and none is above a sixteenth of the capacity, gaps take runs of items.
_RUN_ITEMS, _SMALL = 4, 16
#: The placements of this many steps are gathered into one table, so that the plan stays small over many rounds.
_COMPACT = 16
#: A sweep takes one task for so many gaps and items.
_ROWS_PER_TASK = 100_000
_SPREAD = 1 << 33  # monotonically_increasing_id numbers a partition's rows from its number times this


def divide(items: DataFrame, capacity: int) -> DataFrame:
    """(item, part, start, size): items in pieces of at most ``capacity``; only items above it are divided.

    All pieces of a divided item but the last fill a container of their own.
    """
    n = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    return (
        items.where(F.col("size") > 0)
        .select("item", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
        .select("item", "part", (F.col("part").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("part").cast("bigint") * capacity).cast("bigint").alias("size"))
    )


def _runs(ordered: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """(partition, size, kind, first place, number) of the runs of a range-sorted state, in sweep order.

    Bounded whatever the corpus: at most two runs per size from 1 to the capacity, and two more per partition.
    """
    rows = (
        ordered.groupBy(F.floor(F.col("at") / _SPREAD).alias("p"), "size", "kind")
        .agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .collect()
    )
    return sorted(((r["p"], r["size"], r["kind"], r["first"], r["n"]) for r in rows), key=lambda r: r[3])


def _ordered(state: DataFrame, partitions: int) -> DataFrame:
    """The state range-sorted from large to small, gaps first, with the place ``at``."""
    # What one task sorts needs neither samples nor an exchange.
    ranged = state.repartitionByRange(partitions, F.desc("size"), "kind", "id") if partitions > 1 else state.coalesce(1)
    return cut_lineage(ranged.sortWithinPartitions(F.desc("size"), "kind", "id").withColumn("at", F.monotonically_increasing_id()))


def match_round(state: DataFrame, partitions: int) -> DataFrame:
    """One sweep over (kind, id, size): adds ``bin`` and ``left``, the container and remaining gap of each matched item.

    Gaps keep their id as ``bin`` and get ``left`` null if they are taken, their size if not.
    """
    ordered = _ordered(state, partitions)
    depth, starts = 0, []
    for p, size, kind, first, n in _runs(ordered):
        starts.append((p, size, kind, first, depth))
        depth = depth + n if kind == _GAP else max(0, depth - n)
    runs = local_rows(state.sparkSession, starts, ["p", "size", "kind", "first", "depth"]).withColumn("kind", F.col("kind").cast("int"))
    placed = ordered.withColumn("p", F.floor(F.col("at") / _SPREAD)).join(F.broadcast(runs), ["p", "size", "kind"])
    step = F.col("at") - F.col("first")
    level = F.when(F.col("kind") == _GAP, F.col("depth") + step + 1).otherwise(F.col("depth") - step)
    leveled = placed.select("kind", "id", "size", "at", level.alias("level"))
    # Per level gaps and items alternate, at most one of each per size.
    at_level = Window.partitionBy("level").orderBy("at")
    swept = (
        leveled.where(F.col("level") > 0)
        .withColumn("before", F.lag(F.struct("kind", "id", "size")).over(at_level))
        .withColumn("after", F.lead("kind").over(at_level))
    )
    is_item, hit = F.col("kind") == _ITEM, F.col("before.kind") == _GAP
    matched = swept.select(
        "kind", "id", "size",
        F.when(~is_item, F.col("id")).when(hit, F.col("before.id")).alias("bin"),
        F.when(is_item & hit, F.col("before.size") - F.col("size")).when(~is_item & ~F.coalesce(F.col("after") == _ITEM, F.lit(False)), F.col("size")).alias("left"),
    )
    unplaced = leveled.where(F.col("level") <= 0).select("kind", "id", "size", F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("bigint").alias("left"))
    return matched.unionByName(unplaced)


def _segments(gaps: dict[int, int], items: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(item size, gap size, first, end, base): the items of a size, by number, that begin in the gaps of a size when both lie
    end to end from large to small; item j begins at base + j * size of those gaps. At most one segment per item and gap size."""
    wide, result, w, room, offset = sorted(gaps, reverse=True), [], 0, 0, 0
    for size in sorted(items, reverse=True):
        end = offset + size * items[size]
        while w < len(wide):
            begin, over = room, room + wide[w] * gaps[wide[w]]
            first, last = max(0, -(-(begin - offset) // size)), min(items[size], -(-(over - offset) // size))
            if first < last:
                result.append((size, wide[w], first, last, offset - begin))
            if over > end:
                break
            room, w = over, w + 1
        offset = end
    return result


def fill_round(state: DataFrame, partitions: int) -> DataFrame:
    """Like ``match_round``, but a gap takes a run of items: each item that lies inside one gap when both are laid end to end.

    Prefix sums over the sizes give every item its gap. Only an item across a border of two gaps waits; gaps keep ``left``.
    """
    ordered = _ordered(state, partitions)
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})
    starts = []
    for p, size, kind, first, n in _runs(ordered):
        starts.append((p, size, kind, first, counts[kind].get(size, 0)))
        counts[kind][size] = counts[kind].get(size, 0) + n
    spark = state.sparkSession
    runs = local_rows(spark, starts, ["p", "size", "kind", "first", "before"]).withColumn("kind", F.col("kind").cast("int"))
    numbered = ordered.withColumn("p", F.floor(F.col("at") / _SPREAD)).join(F.broadcast(runs), ["p", "size", "kind"]).select("kind", "id", "size", (F.col("before") + F.col("at") - F.col("first")).alias("j"))
    segments = local_rows(spark, _segments(*counts), ["size", "gap", "from", "to", "base"])
    gaps = numbered.where(F.col("kind") == _GAP).select(F.col("id").alias("bin"), F.col("size").alias("gap"), F.col("j").alias("nth"))
    begin = F.col("base") + F.col("j") * F.col("size")
    laid = (
        numbered.where(F.col("kind") == _ITEM)
        .join(F.broadcast(segments), "size")
        .where((F.col("j") >= F.col("from")) & (F.col("j") < F.col("to")))
        .withColumn("nth", F.expr("(base + j * size) div gap"))
        .where(begin + F.col("size") <= (F.col("nth") + 1) * F.col("gap"))
    )
    placed = cut_lineage(laid.join(gaps, ["gap", "nth"]).select("id", "size", "bin"))
    taken = placed.groupBy("bin").agg(F.sum("size").alias("taken"))
    null = F.lit(None).cast("bigint")
    kept = gaps.join(taken, "bin", "left").select(F.lit(_GAP).alias("kind"), F.col("bin").alias("id"), F.col("gap").alias("size"), "bin", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("left"))
    waits = numbered.where(F.col("kind") == _ITEM).join(placed, "id", "left_anti").select("kind", "id", "size", null.alias("bin"), null.alias("left"))
    return kept.unionByName(placed.select(F.lit(_ITEM).alias("kind"), "id", "size", "bin", null.alias("left"))).unionByName(waits)


def _histogram(state: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Numbers of gaps and of items by size; bounded by the capacity, whatever the corpus."""
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in state.groupBy("kind", "size").agg(F.count("*").alias("n")).collect():
        counts[r["kind"]][r["size"]] = r["n"]
    return counts


def _largest(waiting: DataFrame, items: dict[int, int], n: int) -> tuple[DataFrame, DataFrame]:
    """(the ``n`` largest items, the others); of equal ones at the boundary those with the least ids, numbered by a range sort."""
    for size in sorted(items, reverse=True):
        if n <= items[size]:
            break
        n -= items[size]
    if n == items[size]:
        return waiting.where(F.col("size") >= size), waiting.where(F.col("size") < size)
    tied = dense_ordinal(waiting.where(F.col("size") == size), ["id"], "nth")
    pick = lambda wide, drawn: waiting.where(wide).unionByName(tied.where(drawn).drop("nth"))
    return pick(F.col("size") > size, F.col("nth") < n), pick(F.col("size") < size, F.col("nth") >= n)


def _to_open(gaps: dict[int, int], items: dict[int, int], capacity: int) -> int:
    """How many containers to open now: the most that, over all sizes s, the items of at least s lack beside the gaps of at least s."""
    need = volume = room = 0
    wide = sorted(gaps, reverse=True)
    for size in sorted(items, reverse=True):
        volume += size * items[size]
        while wide and wide[0] >= size:
            room += wide[0] * gaps[wide.pop(0)]
        need = max(need, -(-(volume - room) // capacity))
    return min(sum(items.values()), need)


def _takes_runs(gaps: dict[int, int], items: dict[int, int], opened: int, capacity: int) -> bool:
    """Whether all items left after the ``opened`` largest are small and so many that one a gap would take many rounds."""
    waiting = sum(items.values()) - opened
    largest, above = 0, opened
    for largest in sorted(items, reverse=True):
        if above < items[largest]:
            break
        above -= items[largest]
    usable = opened + sum(n for s, n in gaps.items() if s >= min(items))
    return largest <= capacity // _SMALL and waiting > _RUN_ITEMS * usable


def best_fit(items: DataFrame, capacity: int, partitions: int) -> DataFrame:
    """(id, bin): a container for every (id, size) with 0 < size <= capacity, never above the capacity of any.

    A container is named by the first item it holds. Each round opens the containers that the waiting volume lacks, by the
    largest items, then matches the other items in one sweep, or fills gaps with runs. Rounds end when no item waits; every
    round places at least its largest item, and a round's driver work is bounded by the capacity.
    """
    placed: list[DataFrame] = []
    gaps = items.limit(0).select("id", "size")
    waiting = items.select("id", "size")
    tagged = lambda g, w: g.select(F.lit(_GAP).alias("kind"), "id", "size").unionByName(w.select(F.lit(_ITEM).alias("kind"), "id", "size"))
    while True:
        gap_counts, item_counts = _histogram(tagged(gaps, waiting))
        if not item_counts:
            break
        n = _to_open(gap_counts, item_counts, capacity)
        if n:
            opened, waiting = _largest(waiting, item_counts, n)
            placed.append(opened.select("id", F.col("id").alias("bin")))
            gaps = gaps.unionByName(opened.select("id", (F.lit(capacity) - F.col("size")).cast("bigint").alias("size")))
        usable = gaps.where(F.col("size") >= min(item_counts))
        one_round = fill_round if _takes_runs(gap_counts, item_counts, n, capacity) else match_round
        tasks = min(partitions, 1 + (sum(gap_counts.values()) + sum(item_counts.values())) // _ROWS_PER_TASK)
        result = cut_lineage(one_round(tagged(usable, waiting), tasks).coalesce(tasks))
        item, unplaced = F.col("kind") == _ITEM, F.col("bin").isNull()
        placed.append(result.where(item & ~unplaced).select("id", "bin"))
        gaps = result.where(F.col("left").isNotNull()).select(F.col("bin").alias("id"), F.col("left").alias("size"))
        waiting = result.where(item & unplaced).select("id", "size")
        if len(placed) >= _COMPACT:
            placed = [cut_lineage(reduce(DataFrame.unionByName, placed).coalesce(partitions))]
    return reduce(DataFrame.unionByName, placed, items.limit(0).select("id", F.col("id").alias("bin")))


def pack(items: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """(item, part, start, size, container): every (item bigint unique, size bigint) in containers of ``capacity``.

    An item is divided only if it alone exceeds the capacity, into parts that start at ``start``. Items of size 0
    or null need no space: one row with container null. Repeated rows of an item count once; an empty table gives an empty result.
    """
    partitions = partitions or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = cut_lineage(items.select(F.col("item").cast("bigint").alias("item"), F.col("size").cast("bigint").alias("size")).groupBy("item").agg(F.max("size").alias("size")))
    parts = divide(once, capacity)
    full = parts.where(F.col("size") == capacity).withColumn("container", F.concat_ws("-", "item", "part"))
    # An item has one part below the capacity at most, so its number names the part.
    open_parts = parts.where(F.col("size") < capacity)
    bins = best_fit(open_parts.select(F.col("item").alias("id"), "size"), capacity, partitions)
    filled = open_parts.join(bins, open_parts["item"] == bins["id"]).select("item", "part", "start", "size", F.concat(F.lit("c"), F.col("bin").cast("string")).alias("container"))
    nothing = once.where(F.coalesce("size", F.lit(0)) <= 0).select(
        "item", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("container")
    )
    return full.unionByName(filled).unionByName(nothing)
