"""Change-only ledgers of watched records (T1-T7) as window expressions; the streaming form is in palimpsest.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.ident import typed_id


def event_kind(first: Column, missing: Column, was_missing: Column, turned_terminal: Column, state_differs: Column, evidence_differs: Column) -> Column:
    """The kind of a change by precedence; null where nothing changed."""
    return (
        F.when(first, "first_seen")
        .when(missing & ~was_missing, "source_missing")
        .when(missing, None)
        .when(was_missing, "source_restored")
        .when(turned_terminal, "terminal")
        .when(state_differs, "status_changed")
        .when(evidence_differs, "evidence_changed")
    )


def watch_ledger(rows: DataFrame, key: str, at: str, tie: str, status: str, stage: str, terminal: str, evidence: str) -> DataFrame:
    """(key, at, kind, from_status, to_status, event_id): one row per change of each key, none for unchanged rows.

    A row without status means that the source lacked the record; comparison is with the last row that had one. A key is
    frozen with its first terminal row: later rows count no more. ``at`` is a timestamp or ISO text. ``event_id`` depends on the content only, so a
    repeated run appends nothing (see :func:`append_events`).
    """
    row = rows.select(
        F.col(key).alias("key"), F.col(at).alias("at"), F.col(tie).alias("tie"), F.substring(F.col(at).cast("string"), 1, 7).alias("period"), F.col(status).isNull().alias("missing"),
        F.struct(F.col(status).alias("status"), F.col(stage).alias("stage"), F.coalesce(terminal, F.lit(False)).alias("terminal"), F.col(evidence).alias("evidence")).alias("now"),
    )
    place, real = F.struct("at", "tie"), F.when(~F.col("missing"), F.struct("at", "tie", "now"))
    # One row per (key, month) carries what the months after it need; a key's whole history never meets in one task.
    months = row.groupBy("key", "period").agg(F.max(F.struct("at", "tie", "missing")).alias("last_row"), F.max(real).alias("last_real"), F.min(F.when(F.col("now.terminal") & ~F.col("missing"), place)).alias("ended"))
    earlier = Window.partitionBy("key").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(
        "key", "period", F.last("last_row").over(earlier).alias("last_row"), F.last("last_real", True).over(earlier).alias("last_real"), F.min("ended").over(earlier).alias("ended_before")
    )
    entering = carried.where(F.col("last_row").isNotNull()).select(
        "key", "period", F.lit(0).alias("rank"), F.col("last_row.at").alias("at"), F.col("last_row.tie").alias("tie"), F.col("last_row.missing").alias("missing"), F.col("last_real.now").alias("seen"), F.lit(None).cast(row.schema["now"].dataType).alias("now"),
        F.col("ended_before").isNotNull().alias("ends"),
    )
    own = row.select("key", "period", F.lit(1).alias("rank"), "at", "tie", "missing", F.when(~F.col("missing"), F.col("now")).alias("seen"), "now", (F.col("now.terminal") & ~F.col("missing")).alias("ends"))
    within = Window.partitionBy("key", "period").orderBy("rank", "at", "tie")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    state = (
        own.unionByName(entering)
        .withColumn("last", F.last("seen", True).over(before))
        .withColumn("was_missing", F.lag("missing").over(within))
        .withColumn("frozen", F.coalesce(F.bool_or("ends").over(before), F.lit(False)))
        .where((F.col("rank") == 1) & ~F.col("frozen"))
    )
    differs = lambda c: ~F.col(f"now.{c}").eqNullSafe(F.col(f"last.{c}"))
    first, missing = F.col("was_missing").isNull(), F.col("missing")
    kind = event_kind(first, missing, F.coalesce("was_missing", F.lit(False)), F.col("now.terminal"), differs("status") | differs("stage"), differs("evidence"))
    events = state.withColumn("kind", kind).where(F.col("kind").isNotNull())
    shown = lambda c: F.when(~missing, F.col(f"now.{c}"))
    identity = typed_id("watch-", F.col("key"), F.col("at").cast("string"), F.col("last.status"), F.col("last.stage"), shown("status"), shown("stage"))
    return events.select(F.col("key").alias(key), F.col("at").alias(at), "kind", F.col("last.status").alias("from_status"), F.col("now.status").alias("to_status"), identity.alias("event_id"))


def append_events(history: DataFrame, events: DataFrame) -> DataFrame:
    """The history with the events whose ids it lacks; idempotent."""
    return history.unionByName(events.dropDuplicates(["event_id"]).join(history.select("event_id"), "event_id", "left_anti"))


def with_stale(configured: DataFrame, current: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The current row of each configured key, else its previous row flagged ``source_stale``; no change is inferred from it."""
    now = current.select(key, F.struct(*columns).alias("now"))
    old = previous.select(key, F.struct(*columns).alias("old"))
    joined = configured.select(key).join(now, key, "left").join(old, key, "left").withColumn("row", F.coalesce("now", "old"))
    return joined.select(key, *(F.col(f"row.{c}").alias(c) for c in columns), (F.col("now").isNull() & F.col("old").isNotNull()).alias("source_stale"))


#: Capture states from weak to strong (T4).
CAPTURE_STATES = ["pending", "failed", "metadata", "captured"]


def capture_merge(ledger: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """T4: upgrade-only merge of capture attempts: a state never falls, attempts add up."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, CAPTURE_STATES)), c)
    rows = ledger.select(key, "state", "attempts").unionByName(attempts.select(key, "state", "attempts"))
    return rows.groupBy(key).agg(F.max_by("state", rank(F.col("state"))).alias("state"), F.sum("attempts").alias("attempts"))


def capture_plan(candidates: DataFrame, ledger: DataFrame, key: str, downloads: int, size: int) -> DataFrame:
    """(key, place, bytes): what one run may fetch: unattempted first, then the fewest attempts, within both budgets.

    ``candidates``: key, mapped, bytes; ``ledger``: key, state, attempts. What is captured is left out, so a run that stopped
    resumes. Only ``downloads`` rows are ever numbered; the budget of bytes ends the list at the first row that exceeds it.
    """
    tried = F.coalesce("attempts", F.lit(0))
    queue = candidates.join(ledger.select(key, "state", "attempts"), key, "left").where(~F.coalesce(F.col("state") == CAPTURE_STATES[-1], F.lit(False)))
    order = [F.desc("mapped"), tried.asc(), F.col(key).asc()]
    along = Window.orderBy(*order)
    first = queue.orderBy(*order).limit(downloads).withColumn("place", F.row_number().over(along)).withColumn("total", F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return first.where(F.col("total") <= size).select(key, "place", "bytes")


def merge_evidence(events: Column, fresh: Column) -> Column:
    """T5: events with those of the fresh one's source replaced by it, newest first."""
    kept = F.filter(events, lambda e: e["source"] != fresh["source"])
    return F.reverse(F.array_sort(F.concat(kept, F.array(fresh))))


def final_review(published: Column, reviewed: Column, matches: Column) -> Column:
    """Terminal only if published, reviewed and matching; unknown is no."""
    return F.coalesce(published, F.lit(False)) & F.coalesce(reviewed, F.lit(False)) & F.coalesce(matches, F.lit(False))


def due_jobs(jobs: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(job, due, overdue_hours): the jobs whose last good run is longer ago than they should wait, those never run first.

    ``jobs``: job, every_hours; ``runs``: job, finished_at, ok. A failed run counts as none, so a job that failed is due again
    at its next check, and what needs it waits.
    """
    last = runs.where(F.coalesce("ok", F.lit(False))).groupBy("job").agg(F.max("finished_at").alias("last"))
    waited = (F.unix_seconds(now) - F.unix_seconds(F.col("last").cast("timestamp"))) / 3600
    return jobs.join(last, "job", "left").select("job", (F.col("last").isNull() | (waited >= F.col("every_hours"))).alias("due"), F.floor(waited - F.col("every_hours")).alias("overdue_hours"))


def active_set(configured: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Configured keys that are not frozen; keys without state are active."""
    return configured.join(state.where("NOT active").select(key), key, "left_anti")
