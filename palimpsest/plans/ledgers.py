"""Ledger, graph, archive and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.ident import typed_id
from palimpsest.operators import archive, graph, ledger, relational, snapshots, validate
from palimpsest.plans.found import act_key, decision_day
from palimpsest.plans.found_sql import DECIDED
from palimpsest.plans.registry import Register
from palimpsest.session import cut_lineage, shared_folder, table

register = Register()
query = register.query


def watch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivered event, times as text."""
    history = table(spark, sf_dir, "procedure_watch_history")
    columns = ["id", "observed_at", "to_status", "stage", "terminal", "url"]
    rows = relational.latest_per_key(history, ["event_id"], ["received_at"], ["received_at", *columns])
    return rows.select("event_id", "id", F.col("observed_at").cast("string").alias("observed_at"), "to_status", "stage", "terminal", "url")


_WATCH = """WITH l AS (SELECT event_id, id, strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') AS seen, CAST(observed_at AS VARCHAR) AS stamp, to_status AS status, stage, terminal, url FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at DESC, id DESC, observed_at DESC, to_status DESC NULLS LAST, stage DESC NULLS LAST, terminal DESC, url DESC) AS k FROM procedure_watch_history) WHERE k = 1),
f AS (SELECT *, coalesce(max(CASE WHEN terminal AND status IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seen, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frozen FROM l),
v AS (SELECT *, row_number() OVER w AS n, lag(status) OVER w AS prev, last_value(CASE WHEN status IS NOT NULL THEN {'s': status, 'g': stage, 'u': url} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seen, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f WHERE frozen = 0 WINDOW w AS (PARTITION BY id ORDER BY seen, event_id)),
k AS (SELECT *, CASE WHEN n = 1 THEN 'first_seen' WHEN status IS NULL AND prev IS NOT NULL THEN 'source_missing' WHEN status IS NULL THEN NULL WHEN prev IS NULL THEN 'source_restored' WHEN terminal THEN 'terminal'
  WHEN status IS DISTINCT FROM last.s OR stage IS DISTINCT FROM last.g THEN 'status_changed' WHEN url IS DISTINCT FROM last.u THEN 'evidence_changed' END AS kind FROM v)
SELECT id, stamp AS observed_at, kind, last.s AS from_status, status AS to_status, 'watch-' || substr(sha256(id || '|' || stamp || '|' || coalesce(last.s, '') || '|' || coalesce(last.g, '') || '|' || coalesce(status, '') || '|' || CASE WHEN status IS NULL THEN '' ELSE coalesce(stage, '') END), 1, 24) AS event_id FROM k WHERE kind IS NOT NULL"""


def _shown(events: DataFrame) -> DataFrame:
    return events.select("id", "observed_at", "kind", "from_status", "to_status", "event_id")


@query(_WATCH)
def watch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-only events of each procedure, frozen after its first terminal row."""
    return _shown(ledger.watch_ledger(watch_rows(spark, sf_dir), "id", "observed_at", "event_id", "to_status", "stage", "terminal", "url"))


@query(_WATCH)
def watch_ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger from a stateful stream over the written rows."""
    from palimpsest.streaming import watch

    source = shared_folder(spark, "rows")
    rows = watch_rows(spark, sf_dir)
    rows.write.parquet(source)
    watch.closing_row(spark, rows.schema).write.mode("append").parquet(source)
    stream = watch.ledger_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(source), "36500 days")
    return _shown(watch.replay(spark, stream, shared_folder(spark, "watch")))


@query(
    """WITH l AS (SELECT id, to_status, stage, max(observed_at) FILTER (WHERE to_status IS NOT NULL) AS at FROM procedure_watch_history GROUP BY ALL), c AS (SELECT DISTINCT procedure_id AS id FROM amendment_fates WHERE procedure_id IS NOT NULL),
n AS (SELECT id, max(observed_at) AS at FROM procedure_watch_history WHERE to_status IS NOT NULL AND observed_at >= TIMESTAMP '2024-06-01' GROUP BY 1), o AS (SELECT id, max(observed_at) AS at FROM procedure_watch_history WHERE to_status IS NOT NULL AND observed_at < TIMESTAMP '2024-06-01' GROUP BY 1)
SELECT c.id, CAST(CAST(coalesce(n.at, o.at) AS DATE) AS VARCHAR) AS day, n.at IS NULL AND o.at IS NOT NULL AS source_stale FROM c LEFT JOIN n ON c.id = n.id LEFT JOIN o ON c.id = o.id"""
)
def stale_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configured procedure with its current row, else its old one flagged stale."""
    history = table(spark, sf_dir, "procedure_watch_history").where(F.col("to_status").isNotNull()).select("id", "observed_at")
    cut = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    newest = lambda rows: rows.groupBy("id").agg(F.max("observed_at").alias("at"))
    configured = table(spark, sf_dir, "amendment_fates").where(F.col("procedure_id").isNotNull()).select(F.col("procedure_id").alias("id")).distinct()
    rows = ledger.with_stale(configured, newest(history.where(F.col("observed_at") >= cut)), newest(history.where(F.col("observed_at") < cut)), "id", ["at"])
    return rows.select("id", F.col("at").cast("date").cast("string").alias("day"), "source_stale")


@query(
    """WITH r AS (SELECT event_type, user_id, CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 ELSE 1 END AS s FROM events)
SELECT user_id, CASE max(s) WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' WHEN 3 THEN 'metadata' ELSE 'captured' END AS state, count(*) AS attempts FROM r GROUP BY 1"""
)
def capture_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upgrade-only merge of two halves of capture attempts."""
    kinds = {"error": "failed", "view": "metadata", "purchase": "captured"}
    state = F.lit("pending")
    for k, v in kinds.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"), F.lit(1).cast("bigint").alias("attempts"))
    return ledger.capture_merge(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 <> 0"), "user_id")


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices of eleven kinds (acts, decisions, fates, procedures, texts, sources, courts, areas, states, gazette papers, watch sources) and their edges."""
    rows = lambda name: table(spark, sf_dir, name)
    effects = rows("decisions").select("id", F.explode("effects").alias("e")).select("id", F.lower(F.trim("e.act_id")).alias("act"))
    fates, texts = rows("amendment_fates"), rows("documents")
    checks = fates.select("id", F.explode("current_law_checks").alias("c")).select("id", F.lower(F.trim("c.act_id")).alias("act"))
    states = rows("state_observations").select(act_key(), snapshots.normal_digest(F.col("state_sha256")).alias("digest"))
    papers = rows("verified_reconstruction_reviews").select(act_key(), F.col("incoming.document_id").alias("paper"))
    labels = rows("subject_labels").select("doc_id", F.lower(F.trim("area")).alias("area"))
    watched, courts = rows("procedure_watch_history").select("id", "source"), rows("decisions").select("id", "court")
    parts = [
        ("act", rows("retrospective_store").select(act_key())), ("act", effects.select("act")), ("act", checks.select("act")), ("decision", courts.select("id")), ("fate", fates.select("id")), ("procedure", fates.select("procedure_id")), ("procedure", watched.select("id")),
        ("text", texts.select("doc_id")), ("source", texts.select("source")), ("court", courts.select("court")), ("area", labels.select("area")), ("state", states.select("digest")), ("paper", papers.select("paper")), ("watch", watched.select("source")),
        ("act", states.select(states.columns[0])), ("act", papers.select(papers.columns[0])), ("act", texts.select(act_key())), ("text", labels.select("doc_id")),
    ]
    links = [
        ("cites", "decision", "act", effects), ("affects", "fate", "act", checks), ("of", "fate", "procedure", fates.select("id", "procedure_id")), ("from", "text", "source", texts.select("doc_id", "source")), ("about", "text", "act", texts.select("doc_id", act_key())),
        ("by", "decision", "court", courts), ("deals_with", "text", "area", labels), ("has_state", "act", "state", states), ("amended_by", "act", "paper", papers), ("watched_at", "procedure", "watch", watched),
    ]
    return graph.vertices(parts), graph.edges(links)


_ACT, _EFFECT, _CHECK = "lower(trim(act_id))", "(SELECT id, unnest(effects) AS e FROM decisions)", "(SELECT id, unnest(current_law_checks) AS c FROM amendment_fates)"
_DIGEST = "lower(nullif(regexp_extract(state_sha256, '[0-9A-Fa-f]{64}'), ''))"
_NODES = [
    ("act", f"{_ACT} AS key FROM retrospective_store"), ("act", f"lower(trim(e.act_id)) AS key FROM {_EFFECT}"), ("act", f"lower(trim(c.act_id)) AS key FROM {_CHECK}"), ("decision", "id AS key FROM decisions"), ("fate", "id AS key FROM amendment_fates"), ("procedure", "procedure_id AS key FROM amendment_fates"),
    ("procedure", "id AS key FROM procedure_watch_history"), ("text", "doc_id AS key FROM documents"), ("source", "source AS key FROM documents"), ("court", "court AS key FROM decisions"), ("area", "lower(trim(area)) AS key FROM subject_labels"), ("state", f"{_DIGEST} AS key FROM state_observations"),
    ("paper", "incoming.document_id AS key FROM verified_reconstruction_reviews"), ("watch", "source AS key FROM procedure_watch_history"), ("act", f"{_ACT} AS key FROM state_observations"), ("act", f"{_ACT} AS key FROM verified_reconstruction_reviews"), ("act", f"{_ACT} AS key FROM documents"), ("text", "doc_id AS key FROM subject_labels"),
]
_LINKS = [
    ("cites", "decision", "act", f"id AS a, lower(trim(e.act_id)) AS b FROM {_EFFECT}"), ("affects", "fate", "act", f"id AS a, lower(trim(c.act_id)) AS b FROM {_CHECK}"), ("of", "fate", "procedure", "id AS a, procedure_id AS b FROM amendment_fates"), ("from", "text", "source", "doc_id AS a, source AS b FROM documents"),
    ("about", "text", "act", f"doc_id AS a, {_ACT} AS b FROM documents"), ("by", "decision", "court", "id AS a, court AS b FROM decisions"), ("deals_with", "text", "area", "doc_id AS a, lower(trim(area)) AS b FROM subject_labels"), ("has_state", "act", "state", f"{_ACT} AS a, {_DIGEST} AS b FROM state_observations"),
    ("amended_by", "act", "paper", f"{_ACT} AS a, incoming.document_id AS b FROM verified_reconstruction_reviews"), ("watched_at", "procedure", "watch", "id AS a, source AS b FROM procedure_watch_history"),
]
_V = (
    "v AS (SELECT DISTINCT kind, key FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(key AS VARCHAR) AS key FROM (SELECT {q})" for k, q in _NODES) + ") WHERE key IS NOT NULL), e AS (SELECT a, b, kind, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{x}|' || a AS a, '{y}|' || b AS b, '{k}' AS kind FROM (SELECT {q}) WHERE a IS NOT NULL AND b IS NOT NULL" for k, x, y, q in _LINKS) + ") GROUP BY 1, 2, 3)"
)


@query(
    f"""WITH m AS (SELECT id, 'court' AS role, 'court|' || court AS member FROM decisions WHERE court IS NOT NULL UNION SELECT id, 'act', 'act|' || lower(trim(e.act_id)) FROM {_EFFECT} WHERE e.act_id IS NOT NULL UNION SELECT id, 'decision', 'decision|' || id FROM decisions)
SELECT 'h-' || substr(sha256('decision|' || id), 1, 16) AS id, role, 'v-' || substr(sha256(member), 1, 16) AS member FROM m"""
)
def graph_hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hyperedge per decision: itself, its court and all acts it affects, each in its role."""
    decisions = table(spark, sf_dir, "decisions")
    named = lambda d, role, kind: d.dropna().select("id", F.lit(role).alias("role"), typed_id("v-", F.lit(kind), F.col(d.columns[1]), length=16).alias("member"))
    acts = decisions.select("id", F.explode("effects").alias("e")).select("id", F.lower(F.trim("e.act_id")).alias("act"))
    members = named(decisions.select("id", "court"), "court", "court").unionByName(named(acts, "act", "act")).unionByName(named(decisions.select("id", F.col("id").alias("own")), "decision", "decision"))
    return members.select(typed_id("h-", F.lit("decision"), F.col("id"), length=16).alias("id"), "role", "member").distinct()


@query(f"WITH {_V} SELECT 'v-' || substr(sha256(kind || '|' || key), 1, 16) AS id, kind, key FROM v")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic vertices of eleven kinds."""
    return graph_tables(spark, sf_dir)[0]


@query(
    f"""WITH {_V} SELECT 'v-' || substr(sha256(a), 1, 16) AS src, 'v-' || substr(sha256(b), 1, 16) AS dst, kind, n, round(least(1.0, CASE kind WHEN 'cites' THEN 0.7 + CAST(n AS DOUBLE) / 100 WHEN 'affects' THEN 0.5 + CAST(n AS DOUBLE) / 40 ELSE CAST(n AS DOUBLE) / 20 END), 3) AS weight FROM e"""
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted edges with their weights."""
    return graph_tables(spark, sf_dir)[1]


@query(
    f"""WITH {_V}, x AS (SELECT kind || '|' || key AS id, row_number() OVER (ORDER BY kind, key) - 1 AS i FROM v) SELECT CAST(s.i AS BIGINT) AS a, CAST(t.i AS BIGINT) AS b, e.kind FROM e JOIN x s ON s.id = e.a JOIN x t ON t.id = e.b"""
)
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between dense indices, numbered per kind with offsets."""
    return graph.remap(*graph_tables(spark, sf_dir))[1].select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "kind")


_ROUND = "SELECT r.id, coalesce(r.tick, min(o.tick)) AS tick FROM {0} r LEFT JOIN n2 ON n2.b = r.id LEFT JOIN {0} o ON o.id = n2.a AND o.tick IS NOT NULL GROUP BY r.id, r.tick"


@query(
    f"""WITH {DECIDED}, {_V}, n2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), d AS (SELECT 'decision|' || id AS id, CAST(min(year(day)) AS INT) AS tick FROM dd WHERE day IS NOT NULL GROUP BY 1),
r0 AS (SELECT v.kind || '|' || v.key AS id, d.tick FROM v LEFT JOIN d ON d.id = v.kind || '|' || v.key), r1 AS ({_ROUND.format("r0")}), r2 AS ({_ROUND.format("r1")}), r3 AS ({_ROUND.format("r2")})
SELECT 'v-' || substr(sha256(id), 1, 16) AS id, tick FROM r3"""
)
def birth_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest years relaxed over the graph for three synchronous rounds."""
    nodes, links = graph_tables(spark, sf_dir)
    dated = table(spark, sf_dir, "decisions").select(F.col("id").alias("key"), F.year(decision_day()).alias("tick")).where(F.col("tick").isNotNull()).groupBy("key").agg(F.min("tick").alias("tick"))
    births = nodes.join(dated.withColumn("kind", F.lit("decision")), ["kind", "key"], "left").select("id", "tick")
    return graph.propagate_birth(births, cut_lineage(links))


@query(
    """WITH c AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS t, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END) AS f, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) AS b FROM orders GROUP BY 1)
SELECT o_custkey, round(greatest(t, f), 3) AS confidence, round(b, 3) AS contradiction, round(least(1.0, 0 + b / 2), 3) AS uncertainty FROM c"""
)
def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived fields of belief masses."""
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("double"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(graph.belief(share("F"), share("O"), share("P"), F.lit(0.0)).alias("b"))
    return rows.select("o_custkey", "b.confidence", "b.contradiction", "b.uncertainty")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of sections with clean keys, repeated deliveries dropped."""
    return table(spark, sf_dir, "act_archive").select("change_id", act_key().alias("act_id"), F.col("para").alias("label"), F.col("effective_date").alias("day"), "old_text", "new_text").distinct()


@query(
    """WITH s AS (SELECT lower(trim(act_id)) AS act_id, effective_from AS day, 1 AS r, 'version' AS source FROM retrospective_store UNION ALL SELECT lower(trim(act_id)), effective_date, 2, 'change' FROM act_archive UNION ALL SELECT lower(trim(act_id)), observed_at, 3, 'observation' FROM state_observations
  UNION ALL SELECT lower(trim(act_id)), max(observed_at), 4, 'head' FROM state_observations GROUP BY 1)
SELECT act_id, CAST(day AS VARCHAR) AS day, arg_max(source, r) AS source FROM s WHERE day IS NOT NULL GROUP BY act_id, day"""
)
def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectable days of each act, by precedence of their sources."""
    day = lambda name, column: table(spark, sf_dir, name).select(act_key().alias("act_id"), F.col(column).alias("day"))
    rows = archive.archive_index({"version": day("retrospective_store", "effective_from"), "change": day("act_archive", "effective_date"), "observation": day("state_observations", "observed_at")}, "act_id")
    return rows.withColumn("day", F.col("day").cast("string"))


def _heads(rows: DataFrame) -> DataFrame:
    dated = rows.where(F.col("day").isNotNull() & F.col("new_text").isNotNull())
    return dated.groupBy("act_id", "label").agg(F.max_by("new_text", F.struct("day", "change_id")).alias("body"))


@query()
def reverse_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section as it stood in 2015, undone change by change, with the gaps named (a fold; tested against brute force)."""
    rows = changes(spark, sf_dir).where(F.col("day").isNotNull())
    found = archive.reverse_reconstruction(rows, _heads(rows), F.lit("2015-01-01").cast("date"), longest=1200, captured=F.col("act_id").startswith("fed_"))
    return found.select("act_id", "label", F.sha2("body", 256).alias("body_sha256"), "applied", "gaps")


@query(
    """WITH a AS (SELECT DISTINCT change_id, new_text AS t FROM act_archive WHERE new_text IS NOT NULL), u AS (SELECT *, replace(t, 'soll', 'kann') AS b, (length(t) - length(replace(t, 'soll', ''))) // 4 AS n FROM a),
v AS (SELECT *, (length(b) - length(replace(b, 'kann', ''))) // 4 AS m FROM u)
SELECT change_id, CASE WHEN n <> 1 THEN 'not_unique' WHEN m <> 1 THEN 'old_not_unique' WHEN sha256(replace(b, 'kann', 'soll')) <> sha256(t) THEN 'digest_mismatch' ELSE 'verified' END AS verdict, CASE WHEN n = 1 AND m = 1 AND replace(b, 'kann', 'soll') = t THEN sha256(b) END AS before_sha256 FROM v"""
)
def verified_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo one replacement; accepted only if replaying it reproduces the anchored digest."""
    rows = table(spark, sf_dir, "act_archive").where(F.col("new_text").isNotNull()).select("change_id", F.col("new_text").alias("t"), F.sha2("new_text", 256).alias("digest"), F.lit("kann").alias("old"), F.lit("soll").alias("new")).distinct()
    return archive.verified_replay(rows, "t", "old", "new", "digest").select("change_id", "verdict", F.sha2("before", 256).alias("before_sha256"))


@query(
    """WITH c AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, para AS label, effective_date AS day FROM act_archive WHERE effective_date <= DATE '2018-01-01')
SELECT act_id, label, arg_max(change_id, (epoch(day::TIMESTAMP)::BIGINT * 10000000 + change_id)) AS change_id, CAST(max(day) AS VARCHAR) AS since FROM c GROUP BY 1, 2"""
)
def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change that wrote each section as of a day."""
    rows = changes(spark, sf_dir).select("change_id", "act_id", "label", "day").distinct()
    return archive.blame(rows, ["act_id", "label"], "day", F.lit("2018-01-01").cast("date")).withColumn("since", F.col("since").cast("string"))


@query(
    """WITH c AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, para AS label, effective_date AS day, new_text FROM act_archive WHERE para IS NOT NULL AND new_text IS NOT NULL AND effective_date IS NOT NULL), h AS (SELECT act_id, label, arg_max(new_text, CAST(day AS VARCHAR) || new_text) AS body FROM c GROUP BY 1, 2)
SELECT act_id, count(*) AS sections, sha256('---\nact: ' || act_id || '\nsections: ' || count(*) || '\n---\n\n' || string_agg('## ' || label || '\n\n' || body, '\n\n' ORDER BY label)) AS markdown_sha256 FROM h GROUP BY 1"""
)
def markdown_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest text of every act as Markdown, by digest."""
    rows = changes(spark, sf_dir).where(F.col("label").isNotNull() & F.col("new_text").isNotNull() & F.col("day").isNotNull())
    heads = rows.groupBy("act_id", "label").agg(F.max_by("new_text", F.concat(F.col("day").cast("string"), F.col("new_text"))).alias("body"))
    pages = archive.markdown(heads, "act_id", "label", "label", "body")
    return pages.join(heads.groupBy("act_id").agg(F.count("*").alias("sections")), "act_id").select("act_id", "sections", F.sha2("markdown", 256).alias("markdown_sha256"))


@query(
    """WITH c AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, para, effective_date FROM act_archive WHERE effective_date IS NOT NULL AND para IS NOT NULL)
SELECT change_id, '<entry><id>change-' || change_id || '</id><title>' || replace(replace(replace(act_id || ' ' || para, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><updated>' || effective_date || 'T00:00:00Z</updated></entry>' AS entry FROM c ORDER BY effective_date DESC, change_id LIMIT 100"""
)
def atom_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 newest changes as Atom entries."""
    rows = changes(spark, sf_dir).where(F.col("day").isNotNull() & F.col("label").isNotNull()).select("change_id", "act_id", "label", "day").distinct().orderBy(F.desc("day"), "change_id").limit(100)
    named = rows.select("change_id", F.concat(F.lit("change-"), F.col("change_id").cast("string")).alias("ident"), F.concat_ws(" ", "act_id", "label").alias("title"), F.concat(F.col("day").cast("string"), F.lit("T00:00:00Z")).alias("updated"))
    return archive.atom_entries(named, "ident", "title", "updated").select("change_id", "entry")


@query(
    """WITH s AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, regexp_extract(para, '([0-9]+[a-z]?)', 1) AS norm FROM act_archive WHERE para IS NOT NULL), k AS (SELECT DISTINCT id, c.check_type AS check_type, lower(trim(c.act_id)) AS act_id, regexp_extract(coalesce(c.norm, ''), '([0-9]+[a-z]?)', 1) AS norm FROM (SELECT id, unnest(current_law_checks) AS c FROM amendment_fates) WHERE c IS NOT NULL)
SELECT k.id, check_type, k.act_id, k.norm, CASE WHEN check_type IS NULL OR k.act_id IS NULL OR k.norm = '' THEN 'failed' WHEN check_type = 'norm_absent' THEN CASE WHEN s.norm IS NULL THEN 'passed' ELSE 'failed' END WHEN s.norm IS NULL THEN 'failed' ELSE 'passed' END AS outcome FROM k LEFT JOIN s ON s.act_id = k.act_id AND s.norm = k.norm"""
)
def current_law_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions about the current sections; an incomplete one fails."""
    number = lambda c: F.regexp_extract(c, r"(\d+[a-z]?)", 1)
    norms = table(spark, sf_dir, "act_archive").where(F.col("para").isNotNull()).select(act_key().alias("act_id"), number(F.col("para")).alias("norm")).distinct().withColumn("present", F.lit(True))
    checks = table(spark, sf_dir, "amendment_fates").select("id", F.explode("current_law_checks").alias("c")).where(F.col("c").isNotNull())
    checks = checks.select("id", "c.check_type", F.lower(F.trim("c.act_id")).alias("act_id"), number(F.coalesce("c.norm", F.lit(""))).alias("norm")).distinct()
    present = F.col("present").isNotNull()
    outcome = F.when(F.col("check_type").isNull() | F.col("act_id").isNull() | (F.col("norm") == ""), "failed").when((F.col("check_type") == "norm_absent") != present, "passed").otherwise("failed")
    return checks.join(norms, ["act_id", "norm"], "left").select("id", "check_type", "act_id", "norm", outcome.alias("outcome"))


@query(
    """WITH c AS (SELECT id, CAST(CAST(observed_at AS DATE) AS VARCHAR) AS day, to_status AS label, 'status' AS kind FROM procedure_watch_history WHERE to_status IS NOT NULL UNION SELECT id, CAST(CAST(observed_at AS DATE) AS VARCHAR), stage, 'stage' FROM procedure_watch_history WHERE stage IS NOT NULL
  UNION SELECT procedure_id, NULL, result, 'result' FROM amendment_fates WHERE procedure_id IS NOT NULL AND result IS NOT NULL) SELECT id, day, label, kind FROM c"""
)
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chronology of each procedure from several sources, without repeats."""
    history = table(spark, sf_dir, "procedure_watch_history")
    day = F.col("observed_at").cast("date").cast("string")
    part = lambda column, kind: history.where(F.col(column).isNotNull()).select("id", day.alias("day"), F.col(column).alias("label"), F.lit(kind).alias("kind"))
    results = table(spark, sf_dir, "amendment_fates").where(F.col("procedure_id").isNotNull() & F.col("result").isNotNull()).select(F.col("procedure_id").alias("id"), F.lit(None).cast("string").alias("day"), F.col("result").alias("label"), F.lit("result").alias("kind"))
    return part("to_status", "status").unionByName(part("stage", "stage")).unionByName(results).distinct()


@query(
    """SELECT 'assertion_id repeated' AS rule, count(*) AS broken FROM (SELECT assertion_id FROM (SELECT DISTINCT * FROM retrospective_store) GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'valid range reversed', count(*) FROM retrospective_store WHERE effective_to <= effective_from
UNION ALL SELECT 'knowledge range reversed', count(*) FROM retrospective_store WHERE knowledge_to <= knowledge_from
UNION ALL SELECT 'text status unknown', count(*) FROM retrospective_store WHERE text_status NOT IN ('official_exact', 'derived_verified', 'partial')
UNION ALL SELECT 'evidence not official', count(*) FROM state_observations WHERE NOT coalesce(starts_with(source_url, 'https://statutes.example/'), false)
UNION ALL SELECT 'declared length differs', count(*) FROM documents WHERE n_chars IS DISTINCT FROM length(text)
UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'several states a day', count(*) FROM (SELECT lower(trim(act_id)) AS a, observed_at FROM state_observations GROUP BY 1, 2 HAVING count(DISTINCT lower(nullif(regexp_extract(state_sha256, '[0-9A-Fa-f]{64}'), ''))) > 1)"""
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each rule of the publication gate."""
    from palimpsest.operators.snapshots import normal_digest

    store, observed = table(spark, sf_dir, "retrospective_store"), table(spark, sf_dir, "state_observations")
    documents, orders = table(spark, sf_dir, "documents"), table(spark, sf_dir, "orders")
    states = observed.groupBy(act_key().alias("a"), "observed_at").agg(F.count_distinct(normal_digest(F.col("state_sha256"))).alias("n"))
    return validate.report(
        {
            "assertion_id repeated": validate.repeated(store.distinct(), ["assertion_id"]),
            "valid range reversed": store.where(validate.reversed_range("effective_from", "effective_to")),
            "knowledge range reversed": store.where(validate.reversed_range("knowledge_from", "knowledge_to")),
            "text status unknown": store.where(validate.not_in("text_status", ["official_exact", "derived_verified", "partial"])),
            "evidence not official": observed.where(validate.bad_evidence("source_url", ["statutes.example"])),
            "declared length differs": documents.where(~F.col("n_chars").eqNullSafe(F.length("text"))),
            "order without customer": relational.unexpected(orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]),
            "several states a day": states.where("n > 1"),
        }
    )
