"""Listings, lookups and small joins of the query surface that the other modules do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import bitemporal, diffs, extract, relational
from palimpsest.plans.found import act_key
from palimpsest.plans.ledgers import changes
from palimpsest.plans.registry import Register
from palimpsest.plans.temporal import assertions
from palimpsest.session import table

register = Register()
query = register.query


@query(
    """WITH s AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, assertion_id, effective_from, effective_to FROM retrospective_store WHERE knowledge_to IS NULL), n AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, para, change_id FROM act_archive WHERE para IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY act_id, para ORDER BY change_id) - 1 AS occurrence FROM n)
SELECT 'ni-' || substr(sha256(s.assertion_id || '|' || o.para || '|' || occurrence), 1, 24) AS id, s.act_id, o.para, occurrence, CAST(effective_from AS VARCHAR) AS effective_from, CAST(effective_to AS VARCHAR) AS effective_to FROM s JOIN o USING (act_id)"""
)
def norm_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the sections of each act: its current intervals times its (label, occurrence) rows.

    The labels of a hot act are spread.
    """
    from palimpsest.functions.ident import typed_id

    current = assertions(spark, sf_dir).where(F.col("knowledge_to").isNull()).select("act_id", "assertion_id", "effective_from", "effective_to").distinct()
    labels = table(spark, sf_dir, "act_archive").where(F.col("para").isNotNull()).select(act_key().alias("act_id"), "para", "change_id").distinct()
    numbered = diffs.occurrence(labels, ["act_id", "para"], ["change_id"])
    return relational.spread_join(numbered, current, "act_id").select(
        typed_id("ni-", F.col("assertion_id"), F.col("para"), F.col("occurrence")).alias("id"), "act_id", "para", F.col("occurrence").cast("bigint").alias("occurrence"), F.col("effective_from").cast("string").alias("effective_from"), F.col("effective_to").cast("string").alias("effective_to")
    )


@query(
    """WITH c AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, coalesce(effective_date, CAST(recorded_at AS DATE)) AS day, effective_date IS NULL AS inferred, para FROM act_archive)
SELECT act_id, CAST(day AS VARCHAR) AS day, bool_or(inferred) AS inferred, count(*) AS changes, string_agg(CAST(change_id AS VARCHAR), ',' ORDER BY change_id) AS change_ids FROM c GROUP BY act_id, day"""
)
def diff_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Act -> day -> changes, days without an effective date taken from the record and marked as such."""
    rows = table(spark, sf_dir, "act_archive").select("change_id", act_key().alias("act_id"), F.coalesce("effective_date", F.col("recorded_at").cast("date")).alias("day"), F.col("effective_date").isNull().alias("inferred"), "para").distinct()
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("change_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("act_id", "day").agg(F.bool_or("inferred").alias("inferred"), F.count("*").alias("changes"), ids.alias("change_ids")).withColumn("day", F.col("day").cast("string"))


@query(
    """WITH k AS (SELECT DISTINCT id, c.act_id AS act_id, c.norm AS norm FROM (SELECT id, unnest(current_law_checks) AS c FROM amendment_fates) WHERE c IS NOT NULL),
t AS (SELECT DISTINCT id, lower(trim(act_id)) AS act_id, unnest(regexp_extract_all(norm, '[0-9]+[a-z]?')) AS number FROM k WHERE norm IS NOT NULL AND act_id IS NOT NULL),
n AS (SELECT lower(trim(act_id)) AS act_id, regexp_extract(para, '([0-9]+[a-z]?)', 1) AS number, count(DISTINCT change_id) AS changes FROM act_archive WHERE para IS NOT NULL GROUP BY 1, 2)
SELECT id, act_id, number, changes FROM t JOIN n USING (act_id, number)"""
)
def token_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers listed in the checks of each fate, joined one by one with the changed sections of their act; changes are counted first."""
    checks = table(spark, sf_dir, "amendment_fates").select("id", F.explode("current_law_checks").alias("c")).where(F.col("c.act_id").isNotNull())
    listed = checks.select("id", F.lower(F.trim("c.act_id")).alias("act_id"), F.explode(F.regexp_extract_all("c.norm", F.lit(r"\d+[a-z]?"), F.lit(0))).alias("number")).distinct()
    rows = table(spark, sf_dir, "act_archive").where(F.col("para").isNotNull())
    changed = rows.groupBy(act_key().alias("act_id"), F.regexp_extract("para", r"(\d+[a-z]?)", 1).alias("number")).agg(F.count_distinct("change_id").alias("changes"))
    return listed.join(changed, ["act_id", "number"]).select("id", "act_id", "number", "changes")


@query(
    """WITH n(needle, target) AS (VALUES ('steuer', 'taxation'), ('miet', 'housing'), ('umsatzsteuer', 'turnover')), d AS (SELECT DISTINCT id, title FROM decisions WHERE title IS NOT NULL)
SELECT id, arg_max(target, length(needle)) AS target FROM d JOIN n ON contains(lower(title), needle) GROUP BY id"""
)
def title_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that contain a curated needle, the longest winning; the needles are literals, so nothing is joined."""
    needles = [("steuer", "taxation"), ("miet", "housing"), ("umsatzsteuer", "turnover")]
    rows = table(spark, sf_dir, "decisions").where(F.col("title").isNotNull()).select("id", "title").distinct()
    return rows.select("id", extract.longest_needle(F.col("title"), needles).alias("target")).where(F.col("target").isNotNull()).groupBy("id").agg(F.max("target").alias("target"))


@query(
    """WITH d AS (SELECT DISTINCT id, effects FROM decisions) SELECT id FROM d WHERE len([e FOR e IN effects IF e IS NOT NULL AND len([p FOR p IN coalesce(e.paras, []) IF p IS NOT NULL AND regexp_extract(p, '([0-9]+[a-z]?)', 1) = '12']) > 0]) > 0"""
)
def norm_target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: rows whose nested labels name a section, whatever its kind."""
    names = lambda p: p.isNotNull() & (F.regexp_extract(p, r"(\d+[a-z]?)", 1) == "12")
    touches = F.exists("effects", lambda e: F.coalesce(F.exists(e["paras"], names), F.lit(False)))
    return table(spark, sf_dir, "decisions").select("id", "effects").distinct().where(touches).select("id")


@query(
    """SELECT kind || ' [' || source || ']' AS fact, count(*) AS n, count(*) FILTER (WHERE published_at >= DATE '2020-01-01') AS recent, CAST(max(published_at) AS VARCHAR) AS newest FROM documents GROUP BY 1"""
)
def digest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts by kind and source against a pinned day."""
    recent = F.col("published_at") >= F.lit("2020-01-01").cast("date")
    return table(spark, sf_dir, "documents").groupBy(F.concat(F.col("kind"), F.lit(" ["), F.col("source"), F.lit("]")).alias("fact")).agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"), F.max("published_at").cast("string").alias("newest"))


@query(
    """WITH c AS (SELECT DISTINCT change_id, source, lower(trim(act_id)) AS act_id, effective_date FROM act_archive)
SELECT source, count(DISTINCT act_id) AS acts, count(*) FILTER (WHERE effective_date IS NOT NULL) AS resolved, count(*) FILTER (WHERE effective_date IS NULL) AS unresolved FROM c GROUP BY 1"""
)
def backfill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered acts and resolved dates by source."""
    rows = table(spark, sf_dir, "act_archive").select("change_id", "source", act_key().alias("act_id"), "effective_date").distinct()
    return rows.groupBy("source").agg(F.count_distinct("act_id").alias("acts"), F.count("effective_date").alias("resolved"), F.count_if(F.col("effective_date").isNull()).alias("unresolved"))


@query(
    """SELECT id, CASE WHEN i IS NOT NULL AND o IS NOT NULL THEN 'both_reviewed' WHEN i IS NOT NULL THEN 'start_reviewed' WHEN o IS NOT NULL THEN 'end_reviewed' ELSE 'unreviewed' END AS date_status, coalesce(i < p, false) AS retroactive FROM (SELECT DISTINCT id, incoming.effective_at AS i, outgoing.effective_at AS o, incoming.publication_date AS p FROM verified_reconstruction_reviews)"""
)
def date_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ends of an interval a review dates."""
    rows = table(spark, sf_dir, "verified_reconstruction_reviews").select("id", F.col("incoming.effective_at").alias("i"), F.col("outgoing.effective_at").alias("o"), F.col("incoming.publication_date").alias("p")).distinct()
    status = F.when(F.col("i").isNotNull() & F.col("o").isNotNull(), "both_reviewed").when(F.col("i").isNotNull(), "start_reviewed").when(F.col("o").isNotNull(), "end_reviewed").otherwise("unreviewed")
    return rows.select("id", status.alias("date_status"), F.coalesce(F.col("i") < F.col("p"), F.lit(False)).alias("retroactive"))


@query(
    """SELECT doc_id, regexp_matches(lower(text), '(steuer|abgabe|zoll)') AS relevant, CASE kind WHEN 'norm' THEN 'published' WHEN 'amendment' THEN 'adopted' ELSE 'proposed' END AS ladder FROM documents WHERE text IS NOT NULL"""
)
def relevance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relevance flag by pattern and a mapped status with its default."""
    ladder = F.create_map(*map(F.lit, ["norm", "published", "amendment", "adopted"]))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.lower("text").rlike("(steuer|abgabe|zoll)").alias("relevant"), F.coalesce(F.element_at(ladder, F.col("kind")), F.lit("proposed")).alias("ladder"))


@query(
    """WITH s AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, effective_from FROM retrospective_store WHERE knowledge_to IS NULL)
SELECT act_id, CAST(effective_from AS VARCHAR) AS effective_from, CAST(lead(effective_from) OVER (PARTITION BY act_id ORDER BY effective_from) AS VARCHAR) AS end_at FROM s"""
)
def next_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each interval ends where the act's next begins."""
    rows = assertions(spark, sf_dir).where(F.col("knowledge_to").isNull()).select("act_id", "effective_from").distinct()
    return bitemporal.adjacent_with_ends(rows, "act_id", "effective_from").select("act_id", F.col("effective_from").cast("string").alias("effective_from"), F.col("end_at").cast("string").alias("end_at"))


@query(
    """WITH c AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, para AS label, effective_date AS day FROM act_archive), r AS (SELECT *, row_number() OVER (PARTITION BY act_id, label ORDER BY day DESC NULLS LAST, change_id DESC) AS back FROM c)
SELECT act_id, label, change_id, CAST(back AS BIGINT) AS back FROM r WHERE back <= 3"""
)
def section_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three changes of each section."""
    from palimpsest.operators import archive

    rows = changes(spark, sf_dir).select("change_id", "act_id", "label", "day").distinct()
    return archive.log(rows, ["act_id", "label"], "day").where("back <= 3").select("act_id", "label", "change_id", F.col("back").cast("bigint").alias("back"))


@query(
    """WITH p AS (SELECT DISTINCT procedure_id AS id FROM amendment_fates WHERE procedure_id IS NOT NULL), h AS (SELECT id, arg_max(to_status, (observed_at, event_id, received_at, to_status)) AS status, CAST(CAST(max(observed_at) AS DATE) AS VARCHAR) AS day FROM procedure_watch_history WHERE to_status IS NOT NULL GROUP BY id)
SELECT p.id, coalesce(trim(h.status), 'unwatched') AS status, h.day FROM p LEFT JOIN h USING (id)"""
)
def watched_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured procedures with their last observed status."""
    history = table(spark, sf_dir, "procedure_watch_history").where(F.col("to_status").isNotNull())
    newest = relational.latest_per_key(history, ["id"], ["observed_at", "event_id", "received_at", "to_status"], ["observed_at", "to_status"])
    configured = table(spark, sf_dir, "amendment_fates").where(F.col("procedure_id").isNotNull()).select(F.col("procedure_id").alias("id")).distinct()
    return configured.join(newest, "id", "left").select("id", F.coalesce(F.trim("to_status"), F.lit("unwatched")).alias("status"), F.col("observed_at").cast("date").cast("string").alias("day"))
