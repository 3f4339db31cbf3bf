"""The queries of the general data problems on the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import asknown, instants, intervals, nested, snapshots, versions
from palimpsest.session import table


def act_key(column: str = "act_id"):
    """act_id trimmed of all white space and in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous reviewed periods of each act and the gaps between them."""
    reviews = table(spark, sf_dir, "verified_reconstruction_reviews").select(
        act_key().alias("act_id"), F.col("interval_span.effective_from").alias("effective_from"), F.col("interval_span.effective_to").alias("effective_to")
    )
    return intervals.periods_and_gaps(reviews, "act_id", "effective_from", "effective_to")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows of the nested records of three tables, linked to their parents."""
    state = nested.keyed_children(table(spark, sf_dir, "procedure_watch_state"), "state_id", "procedures", "procedures", "positions", "id")
    fates = nested.list_children(table(spark, sf_dir, "amendment_fates"), "id", "document_chain", "document_chain", "role")
    effects = nested.struct_children(table(spark, sf_dir, "decisions"), "id", "effects", "act_id", "paras")
    parts = [("procedure_watch_state", state), ("amendment_fates", fates), ("decisions", effects)]
    named = [part.select(F.lit(name).alias("parent_table"), "parent_id", "child_path", "child_pos", "child_value") for name, part in parts]
    return named[0].unionByName(named[1]).unionByName(named[2]).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of the archive with the assertion of its act that was in force and known."""
    events = table(spark, sf_dir, "act_archive").select(F.col("change_id").alias("event"), act_key().alias("key"), "effective_date", "recorded_at")
    assertions = table(spark, sf_dir, "retrospective_store").select(
        act_key().alias("key"), F.col("assertion_id").alias("assertion"), "effective_from", "effective_to", "knowledge_from", "knowledge_to"
    )
    return asknown.as_known(events, assertions).select(F.col("event").alias("change_id"), F.col("assertion").alias("assertion_id"))


def decision_day() -> Column:
    """The day of a decision in any usable spelling, in Berlin where it has a time; null for other values."""
    p = instants.parsed(F.col("decision_date"), F.lit("Europe/Berlin"))
    days = F.transform(F.array(p), lambda x: F.coalesce(x["day"], F.floor(instants.utc_to_local(x["utc"], "Europe/Berlin") / 86400)))
    return F.date_add(F.lit("1970-01-01").cast("date"), F.get(days, F.lit(0)).cast("int"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unambiguous instant or day for each usable spelling in three tables."""
    zones = table(spark, sf_dir, "watch_sources").select("source", "zone_name")
    berlin = F.lit("Europe/Berlin")
    berlin_day = F.floor(instants.utc_to_local(F.col("p.utc"), "Europe/Berlin") / 86400)
    state = table(spark, sf_dir, "procedure_watch_state").select("state_id", "source", F.col("checked_at").alias("value"))
    checked = (
        # watch_sources is a fixed dimension of a few rows.
        state.join(F.broadcast(zones), "source", "left")
        .select(F.col("state_id").cast("string").alias("record_id"), instants.parsed(F.col("value"), F.col("zone_name")).alias("p"))
        .select(F.lit("checked_at").alias("field"), "record_id", instants.instant_text(F.col("p.utc")).alias("normal"))
    )
    decided = (
        table(spark, sf_dir, "decisions")
        .select(F.col("id").alias("record_id"), instants.parsed(F.col("decision_date"), berlin).alias("p"))
        .select(F.lit("decision_date").alias("field"), "record_id", instants.day_text(F.coalesce("p.day", berlin_day)).alias("normal"))
    )
    built = (
        table(spark, sf_dir, "verified_reconstruction_reviews")
        .select(F.col("id").alias("record_id"), instants.parsed(F.col("anchor.builddate"), berlin).alias("p"))
        .select(F.lit("builddate").alias("field"), "record_id", F.coalesce(instants.day_text(F.col("p.day")), instants.instant_text(F.col("p.utc"))).alias("normal"))
    )
    return checked.unionByName(decided).unionByName(built).where(F.col("normal").isNotNull() & F.col("record_id").isNotNull()).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts added, removed or changed from each snapshot to the next."""
    deliveries = table(spark, sf_dir, "state_observations").select(
        act_key().alias("act_id"), "observed_at", "received_at", snapshots.normal_digest(F.col("state_sha256")).alias("digest")
    )
    # A bucket is sorted by one task, so their number grows with the rows.
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), deliveries.count() // 50_000)
    changes = snapshots.snapshot_changes(deliveries, "act_id", "observed_at", "received_at", "digest", buckets)
    return changes.select("act_id", F.col("observed_at").cast("string").alias("observed_at"), "change_kind")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of each procedure's status and stage with their periods."""
    history = table(spark, sf_dir, "procedure_watch_history")
    columns = ["id", "observed_at", "to_status", "stage"]
    events = versions.latest_events(history.select("event_id", "received_at", *columns), "event_id", "received_at", columns).where(F.col("to_status").isNotNull())
    clean = events.select("event_id", "id", "observed_at", versions.trimmed_nfc(F.col("to_status")).alias("to_status"), versions.trimmed_nfc(F.col("stage")).alias("stage"))
    found = versions.versions(clean, "id", "observed_at", ["to_status", "stage"], "event_id")
    return found.select(
        "id", "to_status", "stage", versions.micros_text(F.col("valid_from")).alias("valid_from"), F.coalesce(versions.micros_text(F.col("valid_to")), F.lit("")).alias("valid_to")
    )


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p5_found, p6_found, p7_found)}
