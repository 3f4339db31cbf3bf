"""Bitemporal, state and diff queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import ident
from palimpsest.operators import bitemporal, diffs, relational, snapshots
from palimpsest.plans.found import act_key, decision_day
from palimpsest.plans.found_sql import DECIDED
from palimpsest.plans.registry import Register
from palimpsest.session import table

register = Register()
query = register.query

_DAY, _INSTANT = "2020-06-01", "2024-06-01 00:00:00"


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrospective store with clean keys, repeated deliveries dropped."""
    return (
        table(spark, sf_dir, "retrospective_store")
        .select("assertion_id", act_key().alias("act_id"), "effective_from", "effective_to", "knowledge_from", "knowledge_to", "published_at", "observed_at", "state_sha256", "previous_state_sha256", "text_status", "date_status", "date_basis")
        .distinct()
    )


_A = """a AS (SELECT DISTINCT assertion_id, lower(trim(act_id)) AS act_id, effective_from, effective_to, knowledge_from, knowledge_to, published_at, observed_at,
  state_sha256, previous_state_sha256, text_status, date_status, date_basis FROM retrospective_store)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(act_id, observed_at, digest): the last received row per act and day, digests in one spelling, '-' for none."""
    rows = table(spark, sf_dir, "state_observations").select(
        act_key().alias("act_id"), "observed_at", "received_at", F.coalesce(snapshots.normal_digest(F.col("state_sha256")), F.lit("-")).alias("digest")
    )
    return snapshots.latest_rows(rows, ["act_id", "observed_at"], "received_at", ["digest"])


_O = """o AS (SELECT act_id, observed_at, digest FROM (
  SELECT *, row_number() OVER (PARTITION BY act_id, observed_at ORDER BY received_at DESC, digest DESC) AS pick FROM (
    SELECT lower(trim(act_id)) AS act_id, observed_at, received_at, coalesce(lower(nullif(regexp_extract(state_sha256, '[0-9A-Fa-f]{64}'), '')), '-') AS digest FROM state_observations))
  WHERE pick = 1)"""

_SEGMENTS = (
    _O
    + """, f AS (SELECT *, CASE WHEN digest IS NOT DISTINCT FROM lag(digest) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY act_id ORDER BY observed_at)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY act_id ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS segment FROM f),
s AS (SELECT act_id, CAST(segment AS BIGINT) AS segment, digest, min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS observations FROM n GROUP BY ALL)"""
)


@query(
    f"""WITH {_A}, hits AS (SELECT *, count(*) OVER (PARTITION BY act_id) AS matches FROM a
  WHERE knowledge_from <= TIMESTAMP '{_INSTANT}' AND (knowledge_to IS NULL OR TIMESTAMP '{_INSTANT}' < knowledge_to)
    AND effective_from <= DATE '{_DAY}' AND (effective_to IS NULL OR DATE '{_DAY}' < effective_to))
SELECT act_id, assertion_id, matches, CASE WHEN matches = 1 THEN 'found' ELSE 'ambiguous' END AS answer FROM hits"""
)
def bitemporal_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was valid on one day as known at one instant, per act."""
    hits = bitemporal.point_lookup(assertions(spark, sf_dir), "act_id", F.lit(_DAY).cast("date"), F.lit(_INSTANT).cast("timestamp_ntz"))
    return hits.select("act_id", "assertion_id", "matches", F.when(F.col("matches") == 1, "found").otherwise("ambiguous").alias("answer"))


@query(
    f"""WITH {_A} SELECT assertion_id, act_id, state_sha256, text_status FROM a
WHERE knowledge_from <= TIMESTAMP '{_INSTANT}' AND (knowledge_to IS NULL OR TIMESTAMP '{_INSTANT}' < knowledge_to)"""
)
def bitemporal_history_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as known at one instant."""
    return bitemporal.history_slice(assertions(spark, sf_dir), F.lit(_INSTANT).cast("timestamp_ntz")).select("assertion_id", "act_id", "state_sha256", "text_status")


@query(
    f"""WITH {_A} SELECT act_id, assertion_id FROM a
WHERE knowledge_from <= TIMESTAMP '{_INSTANT}' AND (knowledge_to IS NULL OR TIMESTAMP '{_INSTANT}' < knowledge_to) AND effective_from <= DATE '2024-01-15'
  AND CASE WHEN effective_to IS NULL THEN coalesce(DATE '2024-01-15' <= observed_at, false) ELSE DATE '2024-01-15' < effective_to END"""
)
def bitemporal_open_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open intervals answer only up to the day through which they were verified."""
    hits = bitemporal.point_lookup(assertions(spark, sf_dir), "act_id", F.lit("2024-01-15").cast("date"), F.lit(_INSTANT).cast("timestamp_ntz"), ceiling="observed_at")
    return hits.select("act_id", "assertion_id")


@query(
    f"""WITH {_A}, b AS (SELECT *, coalesce(effective_to, DATE '9999-12-31') AS e FROM a), c AS (SELECT act_id, knowledge_from AS checkpoint FROM a UNION SELECT act_id, knowledge_to FROM a),
k AS (SELECT b.*, c.checkpoint FROM b JOIN c USING (act_id) WHERE c.checkpoint IS NOT NULL AND coalesce(knowledge_from <= c.checkpoint, true) AND coalesce(c.checkpoint < knowledge_to, true) AND effective_from < e),
w AS (SELECT *, max(e) OVER (PARTITION BY act_id, checkpoint ORDER BY effective_from, e, assertion_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM k)
SELECT act_id, CAST(checkpoint AS VARCHAR) AS checkpoint, assertion_id FROM w WHERE effective_from < seen"""
)
def bitemporal_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions that overlap another of their act while both were known, at each change of knowledge."""
    return bitemporal.overlaps_known(assertions(spark, sf_dir), "act_id").select("act_id", F.col("checkpoint").cast("string").alias("checkpoint"), "assertion_id")


@query(f"WITH {_SEGMENTS} SELECT act_id, segment, digest, CAST(first_at AS VARCHAR) AS first_at, CAST(last_at AS VARCHAR) AS last_at, observations FROM s")
def state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of equal digests of each act."""
    rows = bitemporal.segments(observations(spark, sf_dir), "act_id", "observed_at", "digest")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("first_at", "last_at")})


@query(
    f"""WITH {_SEGMENTS}, t AS (SELECT act_id, segment, lag(digest) OVER w AS old_value, digest AS new_value, lag(last_at) OVER w AS last_old_at, first_at AS first_new_at FROM s WINDOW w AS (PARTITION BY act_id ORDER BY segment))
SELECT act_id, old_value, new_value, CAST(last_old_at AS VARCHAR) AS last_old_at, CAST(first_new_at AS VARCHAR) AS first_new_at FROM t WHERE segment > 1"""
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between adjacent states, bounded by the last sight of the old and the first of the new."""
    rows = bitemporal.transitions(observations(spark, sf_dir), "act_id", "observed_at", "digest")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("last_old_at", "first_new_at")})


def review_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(act_id, digest, effective_at, seen_at): the earliest dated review of each act's anchored state."""
    reviews = table(spark, sf_dir, "verified_reconstruction_reviews").select(
        act_key().alias("act_id"), F.lower("anchor.state_sha256").alias("digest"), F.col("incoming.effective_at").alias("effective_at"), F.col("anchor.observed_at").alias("seen_at")
    )
    return reviews.where(F.col("effective_at").isNotNull() & F.col("seen_at").isNotNull() & F.col("digest").isNotNull()).groupBy("act_id", "digest").agg(
        F.min("effective_at").alias("effective_at"), F.min("seen_at").alias("seen_at")
    )


_R = """r AS (SELECT lower(trim(act_id)) AS act_id, lower(anchor.state_sha256) AS digest, min(incoming.effective_at) AS effective_at, min(anchor.observed_at) AS seen_at
  FROM verified_reconstruction_reviews WHERE incoming.effective_at IS NOT NULL AND anchor.observed_at IS NOT NULL AND anchor.state_sha256 IS NOT NULL GROUP BY 1, 2)"""


@query(
    f"""WITH {_SEGMENTS}, {_R},
points AS (SELECT s.act_id, s.segment, s.digest, s.first_at, o.observed_at AS day, o.observed_at AS ceiling, NULL::DATE AS effective_from FROM s JOIN o ON s.act_id = o.act_id AND s.digest = o.digest AND o.observed_at BETWEEN s.first_at AND s.last_at
  UNION ALL SELECT s.act_id, s.segment, s.digest, s.first_at, greatest(r.seen_at, s.first_at), NULL, r.effective_at FROM s JOIN r ON s.act_id = r.act_id AND s.digest = r.digest),
g AS (SELECT act_id, segment, digest, first_at, day, max(ceiling) AS ceiling, max(effective_from) AS effective_from FROM points GROUP BY ALL),
fx AS (SELECT act_id, segment, digest, first_at, day, last_value(ceiling IGNORE NULLS) OVER w AS ceiling, last_value(effective_from IGNORE NULLS) OVER w AS effective_from FROM g WINDOW w AS (PARTITION BY act_id, segment ORDER BY day ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, row_number() OVER w AS k, lag(ceiling) OVER w AS pc, lag(effective_from) OVER w AS pe FROM fx WINDOW w AS (PARTITION BY act_id, segment ORDER BY day)),
v AS (SELECT * FROM c WHERE k = 1 OR ceiling IS DISTINCT FROM pc OR effective_from IS DISTINCT FROM pe)
SELECT act_id, CAST(first_at AS VARCHAR) AS slot_start, digest, CAST(effective_from AS VARCHAR) AS effective_from, CAST(ceiling AS VARCHAR) AS ceiling, CAST(day AS VARCHAR) AS knowledge_from,
  CAST(lead(day) OVER (PARTITION BY act_id, segment ORDER BY day) AS VARCHAR) AS knowledge_to FROM v"""
)
def knowledge_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each state's dates as knowledge of them grew."""
    rows = bitemporal.epochs(observations(spark, sf_dir), review_facts(spark, sf_dir), "act_id", "observed_at", "digest")
    return rows.select("act_id", "digest", *(F.col(c).cast("string").alias(c) for c in ("slot_start", "effective_from", "ceiling", "knowledge_from", "knowledge_to")))


@query(
    f"""WITH {_A}, i AS (SELECT *, 'ra-' || substr(sha256(act_id || '|' || CAST(effective_from AS VARCHAR) || '|' || coalesce(CAST(effective_to AS VARCHAR), '') || '|' || coalesce(state_sha256, '')), 1, 24) AS assertion_key FROM a),
old AS (SELECT assertion_key, max(CASE WHEN knowledge_to IS NULL OR knowledge_to > TIMESTAMP '2024-01-01' THEN 1 ELSE 0 END) AS is_open FROM i WHERE knowledge_from <= TIMESTAMP '2024-01-01' GROUP BY 1),
cur AS (SELECT DISTINCT assertion_key FROM i WHERE knowledge_from <= TIMESTAMP '2024-07-01' AND (knowledge_to IS NULL OR knowledge_to > TIMESTAMP '2024-07-01'))
SELECT CASE WHEN old.assertion_key IS NULL THEN 'opened' WHEN is_open = 1 AND cur.assertion_key IS NOT NULL THEN 'kept' WHEN is_open = 1 THEN 'closed' WHEN cur.assertion_key IS NOT NULL THEN 'reactivated' ELSE 'past' END AS outcome,
  coalesce(old.assertion_key, cur.assertion_key) AS assertion_key FROM old FULL OUTER JOIN cur ON old.assertion_key = cur.assertion_key"""
)
def assertion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build as of July 2024 does to the table as of January 2024."""
    rows = bitemporal.with_assertion_id(assertions(spark, sf_dir), "ra-", ["act_id", "effective_from", "effective_to", "state_sha256"])
    before, now = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-07-01").cast("timestamp_ntz")
    previous = rows.where(F.col("knowledge_from") <= before).withColumn("knowledge_to", F.when(F.col("knowledge_to") <= before, F.col("knowledge_to")))
    current = rows.where(bitemporal.known_at(now))
    return bitemporal.merge_assertions(previous, current, now).select("assertion_key", "outcome")


@query(
    f"""WITH {_SEGMENTS}, {_R}, m AS (SELECT s.* FROM s ANTI JOIN r ON s.act_id = r.act_id AND s.digest = r.digest)
SELECT act_id, CAST(first_at AS VARCHAR) AS first_at, CASE WHEN segment = 1 THEN 'unknown_effective_start' ELSE 'unreviewed_state_transition' END AS reason FROM m"""
)
def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit gaps where no review dates a state."""
    rows = bitemporal.segments(observations(spark, sf_dir), "act_id", "observed_at", "digest")
    return bitemporal.unreviewed_gaps(rows, review_facts(spark, sf_dir), "act_id", "digest").withColumn("first_at", F.col("first_at").cast("string"))


@query(
    f"""WITH {_A}, {_SEGMENTS}, b AS (SELECT DISTINCT act_id, old_value, new_value FROM (SELECT act_id, segment, lag(digest) OVER (PARTITION BY act_id ORDER BY segment) AS old_value, digest AS new_value FROM s) WHERE segment > 1),
v AS (SELECT a.*, count(*) OVER (PARTITION BY act_id, previous_state_sha256, state_sha256) AS nb, count(*) OVER (PARTITION BY assertion_id) AS ni FROM a)
SELECT assertion_id, CASE WHEN published_at IS NULL OR effective_from IS NULL OR observed_at IS NULL THEN 'incomplete_dates' WHEN published_at > observed_at THEN 'published_after_observation'
  WHEN previous_state_sha256 IS NOT DISTINCT FROM state_sha256 THEN 'same_state' WHEN b.act_id IS NULL THEN 'no_such_boundary' WHEN nb > 1 THEN 'boundary_reviewed_twice' WHEN ni > 1 THEN 'duplicate_id' ELSE 'accepted' END AS verdict,
  coalesce(effective_from < published_at, false) AS retroactive
FROM v LEFT JOIN b ON v.act_id = b.act_id AND v.previous_state_sha256 = b.old_value AND v.state_sha256 = b.new_value"""
)
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which assertions pass as reviews of an observed state boundary, and the first rule the others break."""
    reviews = assertions(spark, sf_dir).select(
        "act_id", F.col("assertion_id").alias("review_id"), F.col("previous_state_sha256").alias("old_value"), F.col("state_sha256").alias("new_value"), "published_at", F.col("effective_from").alias("effective_at"), "observed_at"
    )
    boundaries = bitemporal.transitions(observations(spark, sf_dir), "act_id", "observed_at", "digest")
    return bitemporal.accept_reviews(reviews, boundaries, "act_id").select(F.col("review_id").alias("assertion_id"), "verdict", "retroactive")


@query(
    f"""WITH {_A}, w AS (SELECT act_id, assertion_id, effective_from, lag(effective_from) OVER (PARTITION BY act_id ORDER BY knowledge_from, effective_from, assertion_id) AS before FROM a)
SELECT act_id, count(*) AS violations FROM w WHERE effective_from <= before GROUP BY act_id"""
)
def monotonic_effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions whose effective date does not move forward in order of knowledge, per act."""
    rows = assertions(spark, sf_dir).withColumn("order", F.struct("knowledge_from", "effective_from", "assertion_id"))
    return bitemporal.monotonic_violations(rows, "act_id", "order", "effective_from").groupBy("act_id").agg(F.count("*").alias("violations"))


@query(
    """WITH l AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, '{"id":' || o_orderkey || ',"lines":[' || array_to_string([('{"n":' || x.n || ',"p":' || x.p || ',"s":' || x.s || '}') FOR x IN lines], ',') || '],"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS body FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, sha256(body) AS state_sha256, CAST(length(body) AS BIGINT) AS canonical_chars FROM j"""
)
def state_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete states (an order and its ordered lines) as canonical JSON and its digest."""
    line = ident.ordered_struct(n=F.col("l_linenumber"), p=F.col("l_partkey"), s=F.col("l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    states = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    body = ident.canonical_json(id=F.col("o_orderkey"), lines=F.col("lines"), priority=F.col("o_orderpriority"), status=F.col("o_orderstatus"))
    return states.select("o_orderkey", body.alias("body")).select("o_orderkey", ident.digest(F.col("body")).alias("state_sha256"), F.length("body").cast("bigint").alias("canonical_chars"))


@query("SELECT sha256(text) AS digest, count(*) AS observations, min(doc_id) AS first_doc, CAST(max(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def cas_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed bodies: one object per digest and how often it was observed."""
    bodies = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", ident.digest(F.col("text")).alias("digest"), F.length("text").cast("bigint").alias("chars"))
    return bodies.groupBy("digest").agg(F.count("*").alias("observations"), F.min("doc_id").alias("first_doc"), F.max("chars").alias("chars"))


_LINES = "SELECT l_partkey AS part, l_linenumber AS label, l_orderkey AS place, l_returnflag || l_linestatus AS body FROM lineitem WHERE year(l_shipdate) = "


def _year_lines(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == year)
    return rows.select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("label"), F.col("l_orderkey").alias("place"), F.concat("l_returnflag", "l_linestatus").alias("body"))


@query(
    f"""WITH both_sides AS (SELECT *, 'old' AS side, row_number() OVER (PARTITION BY part, label, body ORDER BY place) AS copy FROM ({_LINES} 1996)
  UNION ALL SELECT *, 'new', row_number() OVER (PARTITION BY part, label, body ORDER BY place) FROM ({_LINES} 1997)),
rest AS (SELECT * FROM (SELECT *, count(DISTINCT side) OVER (PARTITION BY part, label, body, copy) AS sides FROM both_sides) WHERE sides = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY part, label, side ORDER BY place, body) AS k FROM rest),
x AS (SELECT * FROM placed WHERE side = 'old'), y AS (SELECT * FROM placed WHERE side = 'new')
SELECT coalesce(x.part, y.part) AS part, coalesce(x.label, y.label) AS label, coalesce(x.k, y.k) AS k, x.body AS old_body, y.body AS new_body,
  CASE WHEN x.part IS NULL THEN 'add' WHEN y.part IS NULL THEN 'delete' ELSE 'replace' END AS operation
FROM x FULL OUTER JOIN y ON x.part = y.part AND x.label = y.label AND x.k = y.k"""
)
def diff_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8 (i): multiset diff of repeated labels (line numbers of a part, 1996 against 1997)."""
    rows = diffs.multiset_diff(_year_lines(spark, sf_dir, 1996), _year_lines(spark, sf_dir, 1997), ["part", "label"], ["body"], ["place"])
    return rows.withColumnRenamed("place", "k")


_OCC = "SELECT part, label, body, row_number() OVER (PARTITION BY part, label ORDER BY place, body) - 1 AS occurrence FROM"


@query(
    f"""WITH x AS ({_OCC} ({_LINES} 1996)), y AS ({_OCC} ({_LINES} 1997)), d AS (
SELECT coalesce(x.part, y.part) AS part, coalesce(x.label, y.label) AS label, coalesce(x.occurrence, y.occurrence) AS occurrence,
  CASE WHEN x.part IS NULL THEN 'add' WHEN y.part IS NULL THEN 'delete' WHEN x.body <> y.body THEN 'replace' END AS operation
FROM x FULL OUTER JOIN y ON x.part = y.part AND x.label = y.label AND x.occurrence = y.occurrence)
SELECT * FROM d WHERE operation IS NOT NULL"""
)
def diff_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8 (ii), W4: diff by label and its occurrence."""
    sides = [diffs.occurrence(_year_lines(spark, sf_dir, y), ["part", "label"], ["place", "body"]) for y in (1996, 1997)]
    return diffs.keyed_diff(*sides, ["part", "label", "occurrence"], ["body"]).drop("metadata_changed")


@query(
    """WITH t AS (SELECT l_suppkey AS supplier, l_partkey AS token, min(CASE WHEN year(l_shipdate) = 1996 THEN l_returnflag END) AS a, min(CASE WHEN year(l_shipdate) = 1997 THEN l_returnflag END) AS b FROM lineitem GROUP BY 1, 2),
d AS (SELECT supplier, token, CASE WHEN a IS NULL AND b IS NOT NULL THEN 'add' WHEN b IS NULL AND a IS NOT NULL THEN 'remove' WHEN a <> b THEN 'replace' END AS operation FROM t)
SELECT * FROM d WHERE operation IS NOT NULL"""
)
def bitemporal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8 (iii): diff by unique token between two states; a token that goes is 'remove'."""
    lines = table(spark, sf_dir, "lineitem")

    def state(year: int) -> DataFrame:
        return lines.where(F.year("l_shipdate") == year).groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("token")).agg(F.min("l_returnflag").alias("flag"))

    return diffs.keyed_diff(state(1996), state(1997), ["supplier", "token"], ["flag"], removed_word="remove").drop("metadata_changed")


@query(
    f"""WITH {_O}, days AS (SELECT observed_at, row_number() OVER (ORDER BY observed_at DESC) AS k FROM (SELECT DISTINCT observed_at FROM o)),
x AS (SELECT act_id, digest FROM o JOIN days USING (observed_at) WHERE k = 2), y AS (SELECT act_id, digest FROM o JOIN days USING (observed_at) WHERE k = 1)
SELECT act_id, 'replace' AS operation FROM x JOIN y USING (act_id) WHERE x.digest <> y.digest"""
)
def snapshot_day_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between the two newest snapshots, shared acts only."""
    rows = observations(spark, sf_dir)
    newest = [r[0] for r in rows.select("observed_at").distinct().orderBy(F.desc("observed_at")).limit(2).collect()]
    old, new = (rows.where(F.col("observed_at") == F.lit(day)) for day in reversed(newest))
    return diffs.shared_day_diff(old, new, "act_id", ["act_id"], ["digest"]).drop("metadata_changed")


@query("SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def same_day_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, V3: keys with several states on one day."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return diffs.duplicate_keys(rows, ["o_custkey", "day"])


@query(
    f"""WITH {_A}, d AS (SELECT *, coalesce(effective_to, DATE '9999-12-31') AS e FROM a WHERE knowledge_to IS NULL)
SELECT act_id, assertion_id, CAST(effective_from AS VARCHAR) AS effective_from, CAST(effective_to AS VARCHAR) AS effective_to, published_at < effective_from AS announced
FROM d WHERE (date_status = 'official_verified' AND coalesce(effective_from, published_at) BETWEEN DATE '2015-01-01' AND DATE '2019-12-31') AND coalesce(effective_from > DATE '2016-01-01', false)
  AND (contains(act_id, 'burg') OR contains(lower(coalesce(text_status, '')), 'exact'))"""
)
def changes_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current changes by date range, future flag against a pinned day and substring."""
    day, pinned = F.coalesce("effective_from", "published_at"), F.lit("2016-01-01").cast("date")
    return (
        assertions(spark, sf_dir)
        .where(F.col("knowledge_to").isNull() & (F.col("date_status") == "official_verified") & day.between(F.lit("2015-01-01").cast("date"), F.lit("2019-12-31").cast("date")))
        .where(F.coalesce(F.col("effective_from") > pinned, F.lit(False)))
        .where(F.col("act_id").contains("burg") | F.lower(F.coalesce("text_status", F.lit(""))).contains("exact"))
        .select("act_id", "assertion_id", F.col("effective_from").cast("string").alias("effective_from"), F.col("effective_to").cast("string").alias("effective_to"), (F.col("published_at") < F.col("effective_from")).alias("announced"))
    )


@query(
    """WITH c AS (SELECT source, para, lower(trim(act_id)) AS act_id, operation, effective_date, change_id FROM act_archive),
u AS (SELECT DISTINCT * FROM c)
SELECT source, act_id, count(*) AS events, count(operation) AS commands, array_to_string(list_sort(list_distinct(list(para))), ',') AS paras,
  CASE WHEN count(DISTINCT effective_date) = 1 THEN CAST(min(effective_date) AS VARCHAR) END AS effective_date FROM u GROUP BY source, act_id"""
)
def amending_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one source grouped by act: counts, sorted sections, the date if there is only one."""
    rows = table(spark, sf_dir, "act_archive").select("source", "para", act_key().alias("act_id"), "operation", "effective_date", "change_id").distinct()
    return rows.groupBy("source", "act_id").agg(
        F.count("*").alias("events"),
        F.count("operation").alias("commands"),
        F.array_join(relational.distinct_sorted(F.col("para")), ",").alias("paras"),
        relational.single_or_null(relational.distinct_sorted(F.col("effective_date").cast("string"))).alias("effective_date"),
    )


@query(
    f"""WITH {_SEGMENTS}, t AS (SELECT act_id, lag(last_at) OVER w AS lo, first_at AS hi, segment FROM s WINDOW w AS (PARTITION BY act_id ORDER BY segment)),
c AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, effective_date FROM act_archive WHERE effective_date IS NOT NULL),
p AS (SELECT c.change_id, t.act_id, t.segment, count(*) OVER (PARTITION BY t.act_id, t.segment) AS n FROM c JOIN t ON c.act_id = t.act_id AND c.effective_date > t.lo AND c.effective_date <= t.hi WHERE t.segment > 1)
SELECT change_id, act_id, segment FROM p WHERE n = 1"""
)
def asof_unique_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change is assigned to the state transition whose window holds it, if it is the only one there."""
    windows = bitemporal.segments(observations(spark, sf_dir), "act_id", "observed_at", "digest").withColumn("lo", F.lag("last_at").over(Window.partitionBy("act_id").orderBy("segment")))
    changes = table(spark, sf_dir, "act_archive").select("change_id", act_key().alias("act_id"), "effective_date").where(F.col("effective_date").isNotNull()).distinct()
    placed = relational.as_of_unique(changes, windows.where("segment > 1").select("act_id", "segment", "lo", F.col("first_at").alias("hi")), "act_id", "effective_date", "lo", "hi")
    return relational.drop_collisions(placed.select("change_id", "act_id", "segment"), ["act_id", "segment"])


@query(
    f"""WITH {DECIDED}, c AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, effective_date FROM act_archive WHERE effective_date IS NOT NULL),
d AS (SELECT id, day, lower(trim(e.act_id)) AS act_id FROM (SELECT id, day, unnest(effects) AS e FROM dd) WHERE e IS NOT NULL),
k AS (SELECT DISTINCT id, act_id, day FROM d WHERE day IS NOT NULL AND act_id IS NOT NULL),
m AS (SELECT c.change_id, k.id FROM c JOIN k ON c.act_id = k.act_id AND k.day BETWEEN c.effective_date AND c.effective_date + 365)
SELECT change_id, min(id) AS id FROM m GROUP BY change_id HAVING count(*) = 1"""
)
def gate_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change is linked to a decision only if exactly one decision on its act falls into its year.

    Decisions are counted per (act, day) first, and the days gathered in blocks of 366, of which a year meets two at most, so
    that a hot act needs no pairs.
    """
    changes = table(spark, sf_dir, "act_archive").select("change_id", act_key().alias("act_id"), "effective_date").where(F.col("effective_date").isNotNull()).distinct()
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / 366)
    per_day = (
        table(spark, sf_dir, "decisions")
        .select("id", "decision_date", F.explode("effects").alias("e"))
        .select("id", F.lower(F.trim("e.act_id")).alias("act_id"), decision_day().alias("day"))
        .where(F.col("day").isNotNull() & F.col("act_id").isNotNull())
        .distinct()
        .groupBy("act_id", "day")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"))
    )
    blocks = per_day.groupBy("act_id", number(F.col("day")).alias("block")).agg(F.collect_list(F.struct("day", "n", "id")).alias("days"))
    last = F.date_add("effective_date", 365)
    met = changes.withColumn("block", F.explode(F.sequence(number(F.col("effective_date")), number(last)))).join(blocks, ["act_id", "block"])
    within = F.filter("days", lambda d: d["day"].between(F.col("effective_date"), last))
    found = met.select("change_id", within.alias("days")).select("change_id", F.aggregate("days", F.lit(0).cast("bigint"), lambda n, d: n + d["n"]).alias("n"), F.array_min(F.transform("days", lambda d: d["id"])).alias("id"))
    return found.groupBy("change_id").agg(F.sum("n").alias("n"), F.min("id").alias("id")).where("n = 1").select("change_id", "id")
