"""Feeds, pages, merges, rollups and joins of the query surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import ident
from palimpsest.operators import relational
from palimpsest.plans.found import act_key, decision_day
from palimpsest.plans.found_sql import DECIDED
from palimpsest.plans.registry import Register
from palimpsest.session import table

register = Register()
query = register.query

_TODAY = "1998-06-01"


def _day(column: str):
    return F.col(column).cast("date")


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, user events and shipments in one schema (day, source, kind, title, key, ordinal)."""
    orders = table(spark, sf_dir, "orders").select(_day("o_orderdate").alias("day"), F.lit("orders").alias("source"), F.lower("o_orderstatus").alias("kind"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderkey").alias("key"), F.lit(1).alias("ordinal"))
    events = table(spark, sf_dir, "events").select(_day("ts").alias("day"), F.lit("events").alias("source"), F.col("event_type").alias("kind"), F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"), F.col("event_id").alias("key"), F.lit(2).alias("ordinal"))
    decisions = table(spark, sf_dir, "decisions").select(decision_day().alias("day"), F.lit("decisions").alias("source"), F.lit("decision").alias("kind"), F.substring("title", 1, 160).alias("title"), F.conv(F.substring(F.sha2("id", 256), 1, 12), 16, 10).cast("bigint").alias("key"), F.lit(0).alias("ordinal")).distinct()
    return orders.unionByName(events).unionByName(decisions).where(F.col("day").isNotNull())


_FEED = """f AS (SELECT CAST(o_orderdate AS DATE) AS day, 'orders' AS source, lower(o_orderstatus) AS kind, 'Order ' || o_orderkey AS title, o_orderkey AS key, 1 AS ordinal FROM orders
UNION ALL SELECT CAST(ts AS DATE), 'events', event_type, 'Event ' || event_id, event_id, 2 FROM events
UNION ALL SELECT DISTINCT day, 'decisions', 'decision', substr(title, 1, 160), CAST('0x' || substr(sha256(id), 1, 12) AS BIGINT), 0 FROM dd JOIN decisions USING (id) WHERE day IS NOT NULL)"""


@query(
    f"""WITH {DECIDED}, {_FEED}, r AS (SELECT * FROM f WHERE kind = 'signup' AND day >= DATE '2024-01-25'), n AS (SELECT count(*) AS n FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY day DESC, ordinal, key) AS k FROM f WHERE NOT (kind = 'signup' AND day >= DATE '2024-01-25'))
SELECT CAST(day AS VARCHAR) AS day, source, kind, title FROM r UNION ALL SELECT CAST(day AS VARCHAR), source, kind, title FROM o, n WHERE k <= greatest(0, 600 - n)"""
)
def feed_reserved_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reserved rows, filled to 600 with the newest others."""
    rows = feed_events(spark, sf_dir)
    reserved = (F.col("kind") == "signup") & (F.col("day") >= F.lit("2024-01-25").cast("date"))
    return relational.reserved_top(rows, reserved, [F.desc("day"), F.col("ordinal"), F.col("key")], 600).select(F.col("day").cast("string").alias("day"), "source", "kind", "title")


@query("SELECT o_orderkey, o_custkey, count(*) OVER () AS matched FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page and the uncapped number of matches."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    return relational.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 100).drop("o_orderdate")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(trim(c_mktsegment)) = 'building' OR lower(trim(c_name)) = 'customer#000000007'")
def exact_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-folded exact match on either of two keys."""
    same = lambda c, v: F.lower(F.trim(c)) == v
    return table(spark, sf_dir, "customer").where(same("c_mktsegment", "building") | same("c_name", "customer#000000007")).select("c_custkey", "c_name")


@query(
    """WITH d AS (SELECT DISTINCT id, title, court, az, map_values(summary) AS texts FROM decisions)
SELECT id FROM d WHERE contains(lower(coalesce(title, '')), 'steuer') OR contains(lower(coalesce(court, '')), 'steuer') OR contains(lower(coalesce(az, '')), 'steuer') OR len([x FOR x IN texts IF contains(lower(x), 'steuer')]) > 0"""
)
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring over nullable fields and map values."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("steuer")), F.lit(False))
    rows = table(spark, sf_dir, "decisions")
    return rows.where(has(F.col("title")) | has(F.col("court")) | has(F.col("az")) | F.coalesce(F.exists(F.map_values("summary"), has), F.lit(False))).select("id").distinct()


@query(
    """WITH d AS (SELECT DISTINCT id, e.act_id AS act_id, e.paras AS paras FROM (SELECT id, unnest(effects) AS e FROM decisions) WHERE e IS NOT NULL AND e.act_id = 'fed_rahmeng')
SELECT id, count(*) AS effects, CAST(sum(len(coalesce(paras, []))) AS BIGINT) AS paras FROM d GROUP BY id"""
)
def nested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the nested elements that touch one act, with their sizes."""
    hits = F.filter("effects", lambda e: e["act_id"] == "fed_rahmeng")
    rows = table(spark, sf_dir, "decisions").select("id", F.explode(hits).alias("e")).select("id", "e.act_id", "e.paras").distinct()
    return rows.groupBy("id").agg(F.count("*").alias("effects"), F.sum(F.coalesce(F.size("paras"), F.lit(0)).cast("bigint") * F.col("paras").isNotNull().cast("int")).alias("paras"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: counts by status."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


#: A2: name of a count -> (table, condition in SQL that both engines read, '' for all rows).
_COUNTS = {
    "regions": ("region", ""), "nations": ("nation", ""), "customers": ("customer", ""), "suppliers": ("supplier", ""), "parts": ("part", ""), "orders": ("orders", ""), "finished": ("orders", "o_orderstatus = 'F'"), "open_orders": ("orders", "o_orderstatus = 'O'"),
    "lines": ("lineitem", ""), "returned": ("lineitem", "l_returnflag = 'R'"), "events": ("events", ""), "errors": ("events", "event_type = 'error'"), "documents": ("documents", ""), "bare_texts": ("documents", "coalesce(text, '') = ''"), "undated_texts": ("documents", "published_at IS NULL"),
    "embeddings": ("embeddings", ""), "changes": ("act_archive", ""), "metadata_only": ("act_archive", "old_text IS NULL AND new_text IS NULL"), "undated_changes": ("act_archive", "effective_date IS NULL"), "repeals": ("act_archive", "operation = 'repeal'"),
    "assertions": ("retrospective_store", ""), "known_now": ("retrospective_store", "knowledge_to IS NULL"), "open_ended": ("retrospective_store", "effective_to IS NULL"), "observations": ("state_observations", ""), "without_digest": ("state_observations", "state_sha256 IS NULL"),
    "reviews": ("verified_reconstruction_reviews", ""), "watch_states": ("procedure_watch_state", ""), "watch_events": ("procedure_watch_history", ""), "outages": ("procedure_watch_history", "to_status IS NULL"), "terminal_events": ("procedure_watch_history", "terminal"),
    "decisions": ("decisions", ""), "fates": ("amendment_fates", ""), "fates_with_result": ("amendment_fates", "result IS NOT NULL"), "labels": ("subject_labels", ""), "areas": ("subject_areas", ""), "sources": ("watch_sources", ""),
}


@query(
    "SELECT (SELECT count(DISTINCT lower(trim(act_id))) FROM act_archive) AS acts, " + ", ".join(f"(SELECT count(*) FROM {t}{' WHERE ' + c if c else ''}) AS {n}" for n, (t, c) in _COUNTS.items())
)
def summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts over all tables in one row, one aggregate per table."""
    by_table: dict[str, list] = {}
    for name, (source, condition) in _COUNTS.items():
        by_table.setdefault(source, []).append((F.count_if(F.expr(condition)) if condition else F.count("*")).alias(name))
    by_table["act_archive"].append(F.count_distinct(act_key()).alias("acts"))
    one = [table(spark, sf_dir, t).agg(*counts).withColumn("_one", F.lit(1)) for t, counts in by_table.items()]
    result = one[0]
    for p in one[1:]:
        result = result.join(p, "_one")
    return result.drop("_one")


@query(
    f"""SELECT o_custkey, CAST(CAST(max(o_orderdate) FILTER (WHERE o_orderdate <= TIMESTAMP '{_TODAY}' AND o_orderstatus <> 'P') AS DATE) AS VARCHAR) AS last_change, CAST(CAST(min(o_orderdate) FILTER (WHERE o_orderstatus <> 'P') AS DATE) AS VARCHAR) AS first_change,
CAST(CAST(min(o_orderdate) FILTER (WHERE o_orderdate > TIMESTAMP '{_TODAY}' AND o_orderstatus <> 'P') AS DATE) AS VARCHAR) AS next_change, count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus <> 'P') AS change_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1"""
)
def act_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last, first and next change, distinct change days and pending rows per key, against a pinned day; unverified rows excluded."""
    day, verified, today = _day("o_orderdate"), F.col("o_orderstatus") != "P", F.lit(_TODAY).cast("date")
    pick = lambda f, c: f(F.when(c, day)).cast("string")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        pick(F.max, verified & (day <= today)).alias("last_change"), pick(F.min, verified).alias("first_change"), pick(F.min, verified & (day > today)).alias("next_change"),
        F.count_distinct(F.when(verified, day)).alias("change_count"), F.count_if(~verified).alias("pending"),
    )


@query(
    """SELECT lower(trim(act_id)) AS act_id, source, count(DISTINCT change_id) AS changes, array_to_string([x.p FOR x IN list_sort(list_distinct(list({'n': length(para), 'p': para}) FILTER (WHERE para IS NOT NULL)))], ',') AS paras,
CASE WHEN bool_or(effective_date IS NULL) THEN 'open' WHEN bool_and(operation = 'repeal') THEN 'closed' WHEN count(DISTINCT operation) > 1 THEN 'merge' ELSE 'commit' END AS kind FROM act_archive GROUP BY 1, 2"""
)
def commit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes rolled up to commits with their sections sorted by length and value, and a type."""
    kind = (
        F.when(F.bool_or(F.col("effective_date").isNull()), "open")
        .when(F.bool_and(F.col("operation") == "repeal"), "closed")
        .when(F.count_distinct("operation") > 1, "merge")
        .otherwise("commit")
    )
    paras = F.array_sort(F.collect_set(F.when(F.col("para").isNotNull(), F.struct(F.length("para").alias("n"), F.col("para").alias("p")))))
    return table(spark, sf_dir, "act_archive").groupBy(act_key().alias("act_id"), "source").agg(
        F.count_distinct("change_id").alias("changes"), F.array_join(F.transform(paras, lambda x: x["p"]), ",").alias("paras"), kind.alias("kind")
    )


@query("WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_partkey, max(n) AS n FROM c GROUP BY 1")
def max_of_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the largest per-source count of each key."""
    return relational.max_of_counts(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag")


@query("SELECT source, doc_id, n FROM (SELECT source, doc_id, CAST(length(text) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id DESC) AS k FROM documents WHERE text IS NOT NULL) WHERE k = 1")
def best_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text of each source, ties by id."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("source", "doc_id", F.length("text").cast("bigint").alias("n"))
    return relational.latest_per_key(rows, ["source"], ["n", "doc_id"], ["doc_id", "n"])


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM c) SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS event_type FROM t WHERE r = 1 GROUP BY 1")
def majority_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predominant type of each user, null on a tie."""
    return relational.majority(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(
    """WITH m AS (SELECT DISTINCT doc_id, lower(trim(area)) AS tag FROM subject_labels WHERE labelled_by <> 'import'), i AS (SELECT DISTINCT doc_id, lower(trim(area)) AS tag FROM subject_labels WHERE labelled_by = 'import')
SELECT doc_id, tag, 'manual' AS origin FROM m UNION ALL SELECT doc_id, tag, 'import' FROM i WHERE doc_id NOT IN (SELECT doc_id FROM m)"""
)
def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made rows win over imported ones of the same key."""
    labels = table(spark, sf_dir, "subject_labels").select("doc_id", F.lower(F.trim("area")).alias("tag"), "labelled_by")
    manual = labels.where("labelled_by <> 'import'").select("doc_id", "tag").distinct().withColumn("origin", F.lit("manual"))
    imported = labels.where("labelled_by = 'import'").select("doc_id", "tag").distinct().withColumn("origin", F.lit("import"))
    return relational.precedence_merge(manual, imported, ["doc_id"])


@query(
    """WITH a AS (SELECT user_id, count(*) AS n, 'old' AS build FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id, count(*) AS n, 'new' AS build FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'purchase' AND value > 90 GROUP BY 1)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE user_id NOT IN (SELECT user_id FROM b)"""
)
def cumulative_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: refreshed rows win, unseen rows stay."""
    events, cut = table(spark, sf_dir, "events"), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old = events.where(F.col("ts") < cut).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("build", F.lit("old"))
    new = events.where((F.col("ts") >= cut) & (F.col("event_type") == "purchase") & (F.col("value") > 90)).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("build", F.lit("new"))
    return relational.upsert(old, new, ["user_id"])


@query(
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS a, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber FROM c WHERE a = 1 AND b = 1"""
)
def collision_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are alone under both of two keys."""
    return relational.drop_collisions(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) ON c_custkey = o_custkey AND k = 1")
def latest_wins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the newest order, if any."""
    newest = relational.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return table(spark, sf_dir, "customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query(
    """WITH f AS (SELECT DISTINCT id, unnest(list_distinct([c.act_id FOR c IN current_law_checks IF c IS NOT NULL AND c.act_id IS NOT NULL])) AS t FROM amendment_fates), d AS (SELECT DISTINCT id, e.act_id AS t FROM (SELECT id, unnest(effects) AS e FROM decisions) WHERE e IS NOT NULL AND e.act_id IS NOT NULL)
SELECT f.id AS fate_id, d.id AS decision_id, count(*) AS shared FROM f JOIN d USING (t) GROUP BY 1, 2"""
)
def set_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fates and decisions that name a common act, hot acts spread."""
    fates = table(spark, sf_dir, "amendment_fates").select(F.col("id").alias("fate_id"), F.filter(F.col("current_law_checks.act_id"), lambda x: x.isNotNull()).alias("a")).distinct()
    named = F.filter(F.col("effects.act_id"), lambda x: x.isNotNull())
    decisions = table(spark, sf_dir, "decisions").select(F.col("id").alias("decision_id"), named.alias("b")).distinct()
    decisions = decisions.select("decision_id", F.explode("b").alias("x")).groupBy("decision_id").agg(F.collect_set("x").alias("b"))
    fates = fates.select("fate_id", F.explode("a").alias("x")).groupBy("fate_id").agg(F.collect_set("x").alias("a"))
    return relational.token_overlap(fates, decisions, "fate_id", "decision_id", "a", "b")


@query(
    """WITH c AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, new_text FROM act_archive WHERE length(new_text) >= 40), d AS (SELECT doc_id, lower(trim(act_id)) AS act_id, text FROM documents WHERE text IS NOT NULL AND act_id IS NOT NULL)
SELECT change_id, doc_id FROM c JOIN d USING (act_id) WHERE (length(text) - length(replace(text, new_text, ''))) = length(new_text)"""
)
def substring_count_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change's new wording of at least 40 characters that occurs exactly once in a text of its act."""
    changes = table(spark, sf_dir, "act_archive").where(F.length("new_text") >= 40).select("change_id", act_key().alias("act_id"), "new_text")
    texts = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", act_key().alias("act_id"), "text")
    return relational.found_once(changes, texts, "act_id", "new_text", "text").select("change_id", "doc_id")


@query(
    """WITH t AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS tick, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS m FROM orders GROUP BY 1)
SELECT tick, CAST(sum(n) OVER w AS BIGINT) AS known, round(CAST(sum(m) OVER w AS DOUBLE) / sum(n) OVER w, 3) AS share FROM t WINDOW w AS (ORDER BY tick ROWS UNBOUNDED PRECEDING)"""
)
def month_state_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running share of undecided rows by month."""
    rows = table(spark, sf_dir, "orders").withColumn("tick", relational.month_number(F.col("o_orderdate")).cast("bigint"))
    return relational.running_share(rows, "tick", F.col("o_orderstatus") == "O")


@query(
    """SELECT r_name, round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / greatest(1, count(o_orderkey)), 3) AS stability FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def world_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of finished rows per region, guarded against empty regions; orders are aggregated before the joins."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("m"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_nation = per.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    regions = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return regions.join(per_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name").agg(
        F.round(F.coalesce(F.sum("m"), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0))), 3).alias("stability")
    )


@query(
    """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1)
SELECT p_partkey, coalesce(n, 0) AS returned, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM part LEFT JOIN c ON p_partkey = l_partkey"""
)
def counts_joined_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts joined back with default 0, and an exact partition into three classes."""
    counts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("n"))
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return table(spark, sf_dir, "part").join(counts, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("returned"), size.alias("class"))


@query(
    """WITH v AS (SELECT act_id, x.para AS label, coalesce(try_cast(nullif(regexp_extract(x.para, '^[0-9]+'), '') AS BIGINT), 999999999) AS n FROM (SELECT DISTINCT lower(trim(act_id)) AS act_id, regexp_extract(para, '[0-9]+[a-z]?') AS para FROM act_archive WHERE para IS NOT NULL) x)
SELECT act_id, label, CAST(row_number() OVER (PARTITION BY act_id ORDER BY n, regexp_replace(label, '^[0-9]+', '')) AS BIGINT) AS place FROM v WHERE label <> ''"""
)
def natural_label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section labels of each act in natural order, numbered."""
    from pyspark.sql import Window

    labels = table(spark, sf_dir, "act_archive").select(act_key().alias("act_id"), F.regexp_extract("para", "[0-9]+[a-z]?", 0).alias("label")).where("label <> ''").distinct()
    number = F.nullif(F.regexp_extract("label", "^[0-9]+", 0), F.lit("")).try_cast("bigint")
    order = Window.partitionBy("act_id").orderBy(number.asc_nulls_last(), F.regexp_replace("label", "^[0-9]+", ""))
    return labels.withColumn("place", F.row_number().over(order).cast("bigint"))


@query(
    """WITH q AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, CAST(k AS BIGINT) AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS k FROM q) WHERE k <= 64"""
)
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 64 of a work queue by a composite order."""
    from pyspark.sql import Window

    urgent, stage = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    first = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").orderBy(urgent, stage, "o_orderdate", "o_orderkey").limit(64)
    # 64 rows are left to number.
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(urgent, stage, "o_orderdate", "o_orderkey")).cast("bigint").alias("place"))


@query(
    """WITH a AS (SELECT lower(trim(act_id)) AS k, count(DISTINCT jurabk) AS n, min(jurabk) AS jurabk FROM retrospective_store GROUP BY 1), d AS (SELECT DISTINCT lower(trim(act_id)) AS k FROM documents WHERE act_id IS NOT NULL)
SELECT d.k AS act_id, a.jurabk FROM d LEFT JOIN a ON d.k = a.k AND a.n = 1"""
)
def unambiguous_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of acts from a dimension whose ambiguous keys take no part."""
    names = table(spark, sf_dir, "retrospective_store").groupBy(act_key().alias("act_id")).agg(F.count_distinct("jurabk").alias("n"), F.min("jurabk").alias("jurabk")).where("n = 1").drop("n")
    return table(spark, sf_dir, "documents").where(F.col("act_id").isNotNull()).select(act_key().alias("act_id")).distinct().join(names, "act_id", "left")


@query(
    """SELECT count(*) AS orphans, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS without_lines FROM (SELECT DISTINCT l_orderkey FROM lineitem) l ANTI JOIN orders ON l_orderkey = o_orderkey"""
)
def completeness_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans on both sides of a parent-child pair."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    orphans = relational.unexpected(lines, orders, ["o_orderkey"]).agg(F.count("*").alias("orphans")).withColumn("_one", F.lit(1))
    bare = relational.unexpected(orders, lines, ["o_orderkey"]).agg(F.count("*").alias("without_lines")).withColumn("_one", F.lit(1))
    return orphans.join(bare, "_one").drop("_one")


@query(
    """WITH d AS (SELECT id, related, effects FROM decisions) SELECT id, coalesce(len(effects) > 0 AND len([e FOR e IN effects IF e IS NOT NULL AND e.act_id IS NOT NULL]) = len(effects), false) AS all_named,
coalesce(len([e FOR e IN effects IF e IS NOT NULL AND e.kind = 'interprets']) > 0, false) AS any_interprets FROM (SELECT DISTINCT * FROM d)"""
)
def all_any_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all/any over nested checks; an empty list passes none."""
    named, interprets = (lambda e: e.isNotNull() & e["act_id"].isNotNull()), (lambda e: e.isNotNull() & F.coalesce(e["kind"] == "interprets", F.lit(False)))
    rows = table(spark, sf_dir, "decisions").select("id", "related", "effects").distinct()
    return rows.select(
        "id", F.coalesce((F.size("effects") > 0) & F.forall("effects", named), F.lit(False)).alias("all_named"), F.coalesce(F.exists("effects", interprets), F.lit(False)).alias("any_interprets")
    )


@query(
    """WITH w AS (SELECT id, event_id, observed_at, to_status, stage FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at DESC) AS k FROM procedure_watch_history) WHERE k = 1)
SELECT id, count(*) AS events, CAST(date_diff('day', CAST(max(observed_at) AS DATE), DATE '2026-01-01') AS INT) AS days_since, CAST(CAST(max(observed_at) FILTER (WHERE to_status IS NULL) AS DATE) AS VARCHAR) AS last_outage FROM w GROUP BY id"""
)
def since_last_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of a kind and days since the latest, against a pinned day."""
    history = table(spark, sf_dir, "procedure_watch_history")
    rows = relational.latest_per_key(history, ["event_id"], ["received_at"], ["received_at", "id", "observed_at", "to_status"])
    return rows.groupBy("id").agg(
        F.count("*").alias("events"),
        F.datediff(F.lit("2026-01-01").cast("date"), F.max("observed_at").cast("date")).alias("days_since"),
        F.max(F.when(F.col("to_status").isNull(), F.col("observed_at"))).cast("date").cast("string").alias("last_outage"),
    )


@query(
    """WITH s AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS last_signup, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_error FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, last_signup, coalesce(after_error, 0) = 1 AS after_error FROM s"""
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carry the last heading forward, and a flag over the rows before."""
    from pyspark.sql import Window

    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    heading = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    flag = F.max((F.col("event_type") == "error").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf_dir, "events").select("event_id", heading.alias("last_signup"), (F.coalesce(flag, F.lit(0)) == 1).alias("after_error"))


@query()
def commit_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 identities of changes (no counterpart in the SQL engine)."""
    rows = table(spark, sf_dir, "act_archive").select("change_id", act_key().alias("act_id"), "para").distinct()
    return rows.select("change_id", ident.short_hash(F.concat_ws("|", F.col("change_id").cast("string"), "act_id", "para")).alias("hash"))
