"""Bitemporal tables: point lookup, slices, overlap checks, epochs, assertion merge, change listings.

An assertion is valid on [effective_from, effective_to) and known during [knowledge_from, knowledge_to); null ends are open.
Every lookup carries an equality on the key, so range conditions are residual filters of a hash or merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.ident import typed_id
from palimpsest.operators.relational import spread_join


def known_at(instant: Column, start: str = "knowledge_from", end: str = "knowledge_to") -> Column:
    """Whether a row was known at ``instant``; a null start is visible always."""
    return F.coalesce(F.col(start) <= instant, F.lit(True)) & F.coalesce(instant < F.col(end), F.lit(True))


def valid_on(day: Column, start: str = "effective_from", end: str = "effective_to", ceiling: str | None = None) -> Column:
    """Whether a row covers ``day``; with ``ceiling`` an open row covers days up to that verified day only (inclusive)."""
    open_end = F.lit(True) if ceiling is None else F.coalesce(day <= F.col(ceiling), F.lit(False))
    return F.coalesce(F.col(start) <= day, F.lit(False)) & F.when(F.col(end).isNull(), open_end).otherwise(day < F.col(end))


def history_slice(assertions: DataFrame, instant: Column) -> DataFrame:
    """The assertions visible at one instant of knowledge."""
    return assertions.where(known_at(instant))


def point_lookup(assertions: DataFrame, key: str, day: Column, instant: Column, ceiling: str | None = None) -> DataFrame:
    """Rows that cover (day, instant), with ``matches`` per key; 1 is an answer, more an ambiguity, no row not found."""
    hits = history_slice(assertions, instant).where(valid_on(day, ceiling=ceiling))
    return hits.withColumn("matches", F.count("*").over(Window.partitionBy(key)))


def overlaps(assertions: DataFrame, key: str, months: int = 1) -> DataFrame:
    """Assertions that overlap an earlier-starting one of their key, at each knowledge checkpoint (month starts).

    A sweep per (key, checkpoint) instead of pairs: a row overlaps if it starts before the greatest end so far.
    """
    last = F.coalesce(F.trunc("knowledge_to", "month"), F.trunc("knowledge_from", "month"))
    first = F.add_months(F.trunc("knowledge_from", "month"), 1)
    points = F.when(first <= last, F.sequence(first, last, F.expr(f"interval {months} month")))
    at = Window.partitionBy(key, "checkpoint").orderBy("effective_from", "effective_end", "assertion_id")
    seen = F.max("effective_end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    return (
        assertions.withColumn("checkpoint", F.explode(points))
        .where(known_at(F.col("checkpoint").cast("timestamp_ntz")))
        .withColumn("effective_end", F.coalesce("effective_to", F.lit("9999-12-31").cast("date")))
        .withColumn("overlaps", F.coalesce(F.col("effective_from") < seen, F.lit(False)))
        .where("overlaps")
    )


def overlaps_known(assertions: DataFrame, key: str) -> DataFrame:
    """Assertions that overlap an earlier-starting one of their key, at every instant at which the key's knowledge changes.

    Between those instants nothing changes, so no overlap is missed, open assertions included. Rows are swept per
    (key, checkpoint) as in ``overlaps``. A key without any instant has one checkpoint, null, at which all is known.
    """
    instants = assertions.select(key, F.explode(F.array("knowledge_from", "knowledge_to")).alias("checkpoint")).groupBy(key, "checkpoint").agg(F.count("*").alias("_n"))
    dated = instants.where(F.col("checkpoint").isNotNull())
    undated = instants.groupBy(key).agg(F.max("checkpoint").alias("checkpoint")).where(F.col("checkpoint").isNull())
    points = dated.select(key, "checkpoint").unionByName(undated.select(key, "checkpoint"))
    at = Window.partitionBy(key, "checkpoint").orderBy("effective_from", "effective_end", "assertion_id")
    seen = F.max("effective_end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spread_join(points, assertions, key)
        .where(known_at(F.col("checkpoint")))
        .withColumn("effective_end", F.coalesce("effective_to", F.lit("9999-12-31").cast("date")))
        .where(F.col("effective_from") < F.col("effective_end"))
        .withColumn("overlaps", F.coalesce(F.col("effective_from") < seen, F.lit(False)))
        .where("overlaps")
    )


def segments(observations: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Islands of adjacent equal values along ``at``: (key, segment, value, first_at, last_at, observations).

    Sequences run within (key, month); one summary row per (key, month) carries the last value and the number of
    islands so far into the months after it, so that no task orders the whole history of a hot key. ``at`` is a date,
    a timestamp or ISO text, unique per key; null values are values of their own.
    """
    month = F.substring(F.col(at).cast("string"), 1, 7)
    row = observations.select(F.col(key).alias("key"), F.col(at).alias("at"), F.struct(F.col(value).alias("value")).alias("state"), month.alias("month"))
    along = Window.partitionBy("key").orderBy("month")
    last = row.groupBy("key", "month").agg(F.max(F.struct("at", "state")).alias("last"))
    entering = last.select("key", "month", F.lag("last").over(along).alias("last")).where(F.col("last").isNotNull()).select("key", "month", F.lit(0).alias("rank"), F.col("last.at").alias("at"), F.col("last.state").alias("state"))
    within = Window.partitionBy("key", "month").orderBy("rank", "at")
    marked = (
        row.withColumn("rank", F.lit(1))
        .unionByName(entering)
        .withColumn("fresh", (~F.col("state").eqNullSafe(F.lag("state").over(within))).cast("int"))
        .where("rank = 1")
        .withColumn("within", F.sum("fresh").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    )
    so_far = marked.groupBy("key", "month").agg(F.sum("fresh").alias("n")).select(
        "key", "month", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    return (
        marked.join(so_far, ["key", "month"])
        .groupBy(F.col("key").alias(key), (F.col("base") + F.col("within")).cast("bigint").alias("segment"), F.col("state.value").alias(value))
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("observations"))
    )


def transitions(observations: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, old_value, new_value, last_old_at, first_new_at) between adjacent segments; the last repeat is the lower bound."""
    along = Window.partitionBy(key).orderBy("segment")
    return (
        segments(observations, key, at, value)
        .withColumn("old_value", F.lag(value).over(along))
        .withColumn("last_old_at", F.lag("last_at").over(along))
        .where(F.col("segment") > 1)
        .select(key, "old_value", F.col(value).alias("new_value"), "last_old_at", F.col("first_at").alias("first_new_at"))
    )


def epochs(observations: DataFrame, reviews: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Versions of each segment's facts by knowledge day: (key, slot_start, value, effective_from, ceiling, knowledge_from, knowledge_to).

    Facts of a segment are its verified ceiling (its last observation so far) and the effective date that a review of its
    value states once the review is seen. ``reviews``: key, value, effective_at, seen_at, one per (key, value). A day on
    which no fact changes opens no version.
    """
    rows = segments(observations, key, at, value)
    spans = observations.join(rows.select(key, value, "segment", "first_at", "last_at"), [key, value]).where(F.col(at).between(F.col("first_at"), F.col("last_at")))
    seen = spans.select(key, "segment", value, "first_at", F.col(at).alias("day"), F.col(at).alias("ceiling"), F.lit(None).cast("date").alias("effective_from"))
    # A review counts from the later of its own day and the segment's first.
    reviewed = rows.join(reviews, [key, value]).select(
        key, "segment", value, "first_at", F.greatest("seen_at", "first_at").alias("day"), F.lit(None).cast("date").alias("ceiling"), F.col("effective_at").alias("effective_from")
    )
    points = seen.unionByName(reviewed).groupBy(key, "segment", value, "first_at", "day").agg(F.max("ceiling").alias("ceiling"), F.max("effective_from").alias("effective_from"))
    so_far = Window.partitionBy(key, "segment").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(key, "segment").orderBy("day")
    facts = points.withColumn("ceiling", F.last("ceiling", True).over(so_far)).withColumn("effective_from", F.last("effective_from", True).over(so_far))
    signature = F.struct("ceiling", "effective_from")
    changed = facts.withColumn("before", F.lag(signature).over(along)).where(~signature.eqNullSafe(F.col("before")))
    return changed.select(
        key, F.col("first_at").alias("slot_start"), value, "effective_from", "ceiling", F.col("day").alias("knowledge_from"), F.lead("day").over(along).alias("knowledge_to")
    )


def with_assertion_id(rows: DataFrame, prefix: str, stable: list[str]) -> DataFrame:
    """Rows with ``assertion_key``, the typed digest of their stable columns."""
    return rows.withColumn("assertion_key", typed_id(prefix, *(F.col(c) for c in stable)))


def merge_assertions(previous: DataFrame, current: DataFrame, built_at: Column, key: str = "assertion_key") -> DataFrame:
    """Append-only merge of a build into the table: (key, knowledge_from, knowledge_to, outcome).

    Open rows that are still asserted stay as they are ('kept'), open rows no longer asserted close at ``built_at``
    ('closed'), new ones open then ('opened'), closed rows are copied ('past'). A row asserted again after it was closed is
    reported as 'reactivated' and not opened: a closed assertion never returns under its id.
    """
    old = previous.groupBy(key).agg(F.max(F.struct(F.col("knowledge_to").isNull().alias("is_open"), "knowledge_from", "knowledge_to")).alias("o"))
    joined = old.join(current.select(key).distinct().withColumn("asserted", F.lit(True)), key, "full_outer")
    asserted = F.coalesce("asserted", F.lit(False))
    outcome = (
        F.when(F.col("o").isNull(), "opened")
        .when(F.col("o.is_open") & asserted, "kept")
        .when(F.col("o.is_open"), "closed")
        .when(asserted, "reactivated")
        .otherwise("past")
    )
    return joined.withColumn("outcome", outcome).select(
        key,
        F.when(F.col("outcome") == "opened", built_at).otherwise(F.col("o.knowledge_from")).alias("knowledge_from"),
        F.when(F.col("outcome") == "closed", built_at).otherwise(F.col("o.knowledge_to")).alias("knowledge_to"),
        "outcome",
    )


def unreviewed_gaps(segment_rows: DataFrame, reviews: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first_at, reason): segments without an accepted review; the first is an unknown start, others an unreviewed change."""
    missing = segment_rows.join(reviews.select(key, value).distinct(), [key, value], "left_anti")
    return missing.select(key, "first_at", F.when(F.col("segment") == 1, "unknown_effective_start").otherwise("unreviewed_state_transition").alias("reason"))


def monotonic_violations(rows: DataFrame, key: str, order: str, day: str) -> DataFrame:
    """Rows whose ``day`` does not exceed the one before in ``order``."""
    return rows.withColumn("before", F.lag(day).over(Window.partitionBy(key).orderBy(order))).where(F.col(day) <= F.col("before"))


def adjacent_with_ends(rows: DataFrame, key: str, start: str) -> DataFrame:
    """``rows`` with ``end_at``, the start of the key's next row."""
    return rows.withColumn("end_at", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def accept_reviews(reviews: DataFrame, boundaries: DataFrame, key: str) -> DataFrame:
    """Reviews with ``verdict``: 'accepted' or the first rule they break; ``retroactive`` is a flag, no rejection.

    ``reviews``: key, review_id, old_value, new_value, published_at, effective_at, observed_at. ``boundaries``: transitions.
    Rules: dates complete, published before observed, values distinct, a boundary with both values exists, one
    review per boundary, unique id.
    """
    sides = boundaries.select(key, F.col("old_value"), F.col("new_value"), F.lit(True).alias("adjacent")).distinct()
    per_boundary = Window.partitionBy(key, "old_value", "new_value")
    checked = (
        reviews.withColumn("same_boundary", F.count("*").over(per_boundary))
        .withColumn("same_id", F.count("*").over(Window.partitionBy("review_id")))
        .join(sides, [key, "old_value", "new_value"], "left")
    )
    verdict = (
        F.when(F.col("published_at").isNull() | F.col("effective_at").isNull() | F.col("observed_at").isNull(), "incomplete_dates")
        .when(F.col("published_at") > F.col("observed_at"), "published_after_observation")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "same_state")
        .when(F.col("adjacent").isNull(), "no_such_boundary")
        .when(F.col("same_boundary") > 1, "boundary_reviewed_twice")
        .when(F.col("same_id") > 1, "duplicate_id")
        .otherwise("accepted")
    )
    return checked.withColumn("verdict", verdict).withColumn("retroactive", F.coalesce(F.col("effective_at") < F.col("published_at"), F.lit(False))).drop("same_boundary", "same_id", "adjacent")
