"""Problem 3: attributes as known at event time, from as-known snapshots plus change logs.

Knowledge time is cut into periods. Two tables are materialised: for each period the snapshot of the assertions known as it
begins, and the log of what its knowledge opens and closes. An event takes the snapshot that precedes it and replays the
log from there to its own instant; later changes are never read. Both tables also carry a block of valid time, the
canonical dyadic blocks of an assertion's validity in cells, and an event probes the blocks above its own cell: so a key
with very many assertions, however long they are valid, does not bring all of them to each of its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.intervals import dyadic_blocks
from palimpsest.session import cut_lineage

#: Length of a knowledge period (seconds) and of a cell of valid time (days).
PERIOD_SECONDS = 182 * 86400
CELL_DAYS = 512


def _seconds(instant: Column) -> Column:
    """Whole seconds of a TIMESTAMP_NTZ since 1970, by day arithmetic (no session zone involved)."""
    day = F.datediff(instant.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return day * 86400 + F.hour(instant) * 3600 + F.minute(instant) * 60 + F.second(instant)


def _period(instant: Column) -> Column:
    return F.floor(_seconds(instant) / PERIOD_SECONDS).cast("int")


def _cell(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / CELL_DAYS).cast("int")


_ASSERTION = ["key", "assertion", "effective_from", "effective_to", "knowledge_from", "knowledge_to"]


def snapshots_and_log(assertions: DataFrame, periods: list[int], cells: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The snapshots (key, period, level, block, assertion, effective_from, effective_to) of the given periods, and their log.

    ``assertions``: key, assertion, effective_from, effective_to, knowledge_from, knowledge_to; null ends are open, rows
    without key or start and rows that end before they begin are ignored. The log has besides ``at`` and ``change``, +1
    where knowledge of an assertion begins and -1 where it ends. ``cells`` is the range of valid time that is asked for.
    """
    low, high = cells
    opened, closed = F.col("knowledge_from"), F.col("knowledge_to")
    usable = F.col("key").isNotNull() & F.col("effective_from").isNotNull() & opened.isNotNull() & F.coalesce(closed > opened, F.lit(True))
    from_cell = F.greatest(_cell(F.col("effective_from")) - low, F.lit(0))
    to_cell = F.least(F.coalesce(_cell(F.date_sub("effective_to", 1)), F.lit(high)), F.lit(high)) - low + 1
    known = (
        assertions.where(usable & F.coalesce(F.col("effective_to") > F.col("effective_from"), F.lit(True)))
        .dropDuplicates(_ASSERTION)
        .withColumn("b", F.explode(dyadic_blocks(from_cell, to_cell, (high - low).bit_length())))
        .select(*_ASSERTION, F.col("b.level").alias("level"), F.col("b.idx").alias("block"))
    )
    # Members of a period's snapshot opened in an earlier period and do not close before it.
    inside = lambda p: (p > _period(opened)) & F.coalesce(p <= _period(closed), F.lit(True))
    columns = ["key", "period", "level", "block", "assertion", "effective_from", "effective_to"]
    snapshots = known.withColumn("period", F.explode(F.filter(F.array(*map(F.lit, periods)).cast("array<int>"), inside))).select(*columns)
    entries = F.array(F.struct(opened.alias("at"), F.lit(1).alias("change")), F.struct(closed.alias("at"), F.lit(-1).alias("change")))
    log = known.select("*", F.inline(entries)).withColumn("period", _period(F.col("at"))).where(F.col("period").isin(periods)).select(*columns, "at", "change")
    return snapshots, log


def as_known(events: DataFrame, assertions: DataFrame) -> DataFrame:
    """(event, assertion): the assertions that cover each event's effective day and were known at its recording.

    ``events``: event, key, effective_date, recorded_at; rows with a null in any of them have no result. Half-open on both
    axes. Deliveries of the same row count once; empty tables give an empty result.
    """
    columns = ["event", "key", "effective_date", "recorded_at"]
    complete = events.select(*columns).dropna(subset=columns[1:])
    # To the driver come the half-years that events were recorded in, as many as the calendar has at most, and the range of their cells.
    # Only these get a snapshot, so that a stray date costs one and not all those between.
    period, cell = _period(F.col("recorded_at")), _cell(F.col("effective_date"))
    met = complete.groupBy(period.alias("period")).agg(F.min(cell).alias("low"), F.max(cell).alias("high")).collect()
    if not met:
        return complete.limit(0).select("event", F.lit(None).cast(assertions.schema["assertion"].dataType).alias("assertion"))
    low, high = min(r["low"] for r in met), max(r["high"] for r in met)
    snapshots, log = map(cut_lineage, snapshots_and_log(assertions, sorted(r["period"] for r in met), (low, high)))
    blocks = F.transform(F.sequence(F.lit(0), F.lit((high - low).bit_length())), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", cell - low, k).alias("block")))
    probes = complete.select(*columns, period.alias("period"), F.inline(blocks))
    replayed = snapshots.withColumn("at", F.lit(None).cast("timestamp_ntz")).withColumn("change", F.lit(1)).unionByName(log)
    covering = probes.join(replayed, ["key", "period", "level", "block"]).where(
        (F.col("effective_from") <= F.col("effective_date"))
        & F.coalesce(F.col("effective_date") < F.col("effective_to"), F.lit(True))
        & F.coalesce(F.col("at") <= F.col("recorded_at"), F.lit(True))
    )
    return covering.groupBy("event", "assertion").agg(F.sum("change").alias("open")).where("open > 0").select("event", "assertion")
