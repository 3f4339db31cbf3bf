"""Functions, small operators and endpoints that no other query shows, each on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import api
from palimpsest.functions import text as T
from palimpsest.operators import diffs, extract, graph, ledger, relational, validate
from palimpsest.plans.found import act_key, decision_day
from palimpsest.plans.found_sql import DECIDED
from palimpsest.plans.ledgers import _V, changes, graph_tables
from palimpsest.plans.registry import Register
from palimpsest.plans.temporal import _A, _O, _SEGMENTS, assertions, observations
from palimpsest.plans.texts import _WHITE, texts
from palimpsest.session import table

register = Register()
query = register.query

_C = "c AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, para AS label, effective_date AS day, old_text, new_text FROM act_archive)"


# -- predicates, ledgers and sets


@query(f"WITH {_C} SELECT DISTINCT change_id FROM c WHERE contains(regexp_replace(lower(concat_ws(' ', act_id, label, old_text, new_text)), '{_WHITE}', ' ', 'g'), 'prüft')")
def haystack_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring of a change's joined fields, white space collapsed."""
    rows = changes(spark, sf_dir)
    haystack = F.regexp_replace(F.lower(F.concat_ws(" ", "act_id", "label", "old_text", "new_text")), r"(?U)\s+", " ")
    return rows.where(haystack.contains("prüft")).select("change_id").distinct()


@query(f"WITH {_C} SELECT act_id, label, CAST(day AS VARCHAR) AS day FROM c WHERE act_id IS NOT NULL AND day IS NOT NULL AND label IS NOT NULL GROUP BY ALL")
def append_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day ledger to which all changes are appended twice; only new (act, day, section) rows enter, and only once."""
    rows = changes(spark, sf_dir).select("act_id", "label", F.col("day").cast("string").alias("day"), "change_id").dropna()
    keys = ["act_id", "label", "day"]
    half = rows.where("change_id % 2 = 0").select(*keys).distinct()
    once = diffs.append_new(half, rows.select(*keys), keys)
    return diffs.append_new(once, rows.select(*keys), keys)


@query(
    """WITH r AS (SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, effective_date, para, source FROM act_archive WHERE effective_date IS NOT NULL AND para IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY act_id, effective_date, para ORDER BY CASE source WHEN 'gii' THEN 0 WHEN 'bgbl_pdf' THEN 1 ELSE 2 END, change_id) AS k FROM r) SELECT change_id, source FROM k WHERE k = 1"""
)
def preferred_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the changes of a section on one day the one of the preferred source; a least-struct aggregate, so hot keys are reduced map-side."""
    rank = F.when(F.col("source") == "gii", 0).when(F.col("source") == "bgbl_pdf", 1).otherwise(2)
    rows = table(spark, sf_dir, "act_archive").where(F.col("effective_date").isNotNull() & F.col("para").isNotNull())
    best = rows.groupBy(act_key().alias("act_id"), "effective_date", "para").agg(F.min(F.struct(rank.alias("rank"), "change_id", "source")).alias("r"))
    return best.select("r.change_id", "r.source")


@query(
    f"""WITH {_C}, h AS (SELECT act_id, label, max(day) AS last FROM c WHERE label IS NOT NULL GROUP BY 1, 2), n AS (SELECT DISTINCT act_id, label FROM c JOIN h USING (act_id, label) WHERE c.day = h.last AND new_text IS NOT NULL AND new_text <> '')
SELECT act_id, label FROM h EXCEPT SELECT act_id, label FROM n"""
)
def lost_designators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that an act once had and that its newest wording lacks."""
    rows = changes(spark, sf_dir).where(F.col("label").isNotNull())
    ever = rows.groupBy("act_id", "label").agg(F.max("day").alias("last"))
    now = rows.where(F.length("new_text") > 0).join(ever, ["act_id", "label"]).where(F.col("day") == F.col("last")).select("act_id", "label").distinct()
    return ever.join(now, ["act_id", "label"], "left_anti").select("act_id", "label")


@query(
    """WITH d AS (SELECT lower(trim(act_id)) AS act_id, published_at, kind, doc_id FROM documents WHERE act_id IS NOT NULL AND published_at IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY act_id, published_at ORDER BY CASE kind WHEN 'norm' THEN 0 WHEN 'amendment' THEN 1 ELSE 2 END, doc_id) AS k FROM d) SELECT doc_id, kind FROM k WHERE k = 1"""
)
def type_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: of the texts of an act on one day the one of the strongest kind."""
    rank = F.when(F.col("kind") == "norm", 0).when(F.col("kind") == "amendment", 1).otherwise(2)
    rows = table(spark, sf_dir, "documents").where(F.col("act_id").isNotNull() & F.col("published_at").isNotNull())
    best = rows.groupBy(act_key().alias("act_id"), "published_at").agg(F.min(F.struct(rank.alias("rank"), "doc_id", "kind")).alias("r"))
    return best.select("r.doc_id", "r.kind")


_ISSUE = "bgbl-([12])-([0-9]{4})-([0-9]+)"


@query(
    f"""WITH r AS (SELECT DISTINCT id, unnest([incoming, outgoing]) AS c FROM verified_reconstruction_reviews), f AS (SELECT id, c.document_id AS document_id, c.publication_date AS day FROM r WHERE c IS NOT NULL)
SELECT DISTINCT id, document_id FROM f WHERE regexp_full_match(document_id, '{_ISSUE}') AND regexp_extract(document_id, '{_ISSUE}', 1) = '1' AND day BETWEEN DATE '2010-01-01' AND DATE '2022-12-31'"""
)
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the first part with a valid issue, published in a range; read from the array of both sides."""
    rows = table(spark, sf_dir, "verified_reconstruction_reviews").select("id", F.explode(F.array("incoming", "outgoing")).alias("c"))
    first = F.regexp_extract("c.document_id", f"^{_ISSUE}$", 1) == "1"
    return rows.where(first & F.col("c.publication_date").between(F.lit("2010-01-01").cast("date"), F.lit("2022-12-31").cast("date"))).select("id", "c.document_id").distinct()


# -- text functions


@query(
    """WITH t AS (SELECT DISTINCT title AS name FROM decisions WHERE title IS NOT NULL), f AS (SELECT name, unnest([name] || CASE WHEN regexp_matches(name, '(gesetz|recht|buch)$') THEN [name || 'es', name || 's'] WHEN regexp_matches(name, '(ordnung|verfassung|verordnung|satzung)$') THEN [name] ELSE [name || 's'] END
  || CASE WHEN regexp_matches(name, '(?i)^\\p{Lu}[0-9A-Za-z_]+(es|er)[ \\t\\n\\r\\f]') THEN [regexp_replace(name, '^([0-9A-Za-z_]+?)(es|er)([ \\t\\n\\r\\f])', '\\1en\\3')] ELSE [] END) AS form FROM t)
SELECT DISTINCT name, form FROM f"""
)
def act_name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the bounded inflected forms of names."""
    names = table(spark, sf_dir, "decisions").where(F.col("title").isNotNull()).select(F.col("title").alias("name")).distinct()
    return names.select("name", F.explode(T.name_forms(F.col("name"))).alias("form"))


@query(
    """WITH l AS (SELECT DISTINCT lower(trim(act_id)) AS key FROM retrospective_store), r AS (SELECT lower(trim(act_id)) AS key, count(DISTINCT change_id) AS changes FROM act_archive WHERE act_id IS NOT NULL GROUP BY 1)
SELECT 'bund/' || replace(key, '_', '-') AS eli, changes FROM l JOIN r USING (key)"""
)
def eli_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that write the same identifier in different spellings, joined on its canonical key."""
    left = table(spark, sf_dir, "retrospective_store").select(T.eli_key(F.concat(F.lit("https://laws.example/ELI/bund/"), F.upper(act_key()), F.lit("/"))).alias("eli")).distinct()
    counted = table(spark, sf_dir, "act_archive").groupBy(act_key().alias("act_id")).agg(F.count_distinct("change_id").alias("changes"))
    right = counted.select(T.eli_key(F.concat(F.lit("http://data.example/eli/bund/"), F.replace("act_id", F.lit("_"), F.lit("-")))).alias("eli"), "changes")
    return left.join(right, "eli").select("eli", "changes")


@query("SELECT p_partkey, '3' || (1990 + p_size % 30) || CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END || lpad(CAST(p_partkey % 9999 + 1 AS VARCHAR), 4, '0') AS celex FROM part")
def celex_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """references in three styles to CELEX numbers; the references are written from the parts' numbers."""
    year, n = F.col("p_size") % 30 + 1990, (F.col("p_partkey") % 9999 + 1).cast("string")
    kind = F.when(F.col("p_partkey") % 2 == 0, "Richtlinie ").otherwise("Verordnung ")
    new = F.concat(kind, F.lit("(EU) "), year.cast("string"), F.lit("/"), n)
    middle = F.concat(kind, F.lit("Nr. "), n, F.lit("/"), year.cast("string"))
    old = F.concat(kind, F.substring(year.cast("string"), 3, 2), F.lit("/"), n, F.lit("/EG"))
    written = F.when(F.col("p_partkey") % 3 == 0, new).when(F.col("p_partkey") % 3 == 1, middle).otherwise(old)
    return table(spark, sf_dir, "part").select("p_partkey", T.celex(written).alias("celex"))


@query(f"WITH {DECIDED} SELECT id, CAST(day AS VARCHAR) AS day FROM dd WHERE day IS NOT NULL")
def decision_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """days of every spelling."""
    return table(spark, sf_dir, "decisions").select("id", decision_day().cast("string").alias("day")).where(F.col("day").isNotNull()).distinct()


@query(
    """WITH t AS (SELECT doc_id, text, instr(text, '§') - 1 AS s FROM documents WHERE contains(text, '§')), p AS (SELECT *, greatest(0, s - 100) AS a FROM t), q AS (SELECT *, least(length(text), s + 1 + 180, a + 360) AS b FROM p)
SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, b - a) || CASE WHEN b < length(text) THEN '…' ELSE '' END AS excerpt FROM q"""
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the surroundings of the first section sign."""
    at = F.instr(F.col("text"), "§") - 1
    return texts(spark, sf_dir).where(F.col("text").contains("§")).select("doc_id", T.excerpt(F.col("text"), at, at + 1).alias("excerpt"))


@query(
    f"""SELECT DISTINCT id, substr(regexp_replace(trim(regexp_replace('Entwurf eines ' || claim, '{_WHITE}', ' ', 'g')), '^(?i:(entwurf eines |erstes |zweites |drittes )?gesetz(es)? (zur|zum|über|für) (die |den |das )?)', ''), 1, 160) AS title FROM amendment_fates WHERE claim IS NOT NULL"""
)
def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles without their boilerplate beginnings, cut to 160 characters."""
    rows = table(spark, sf_dir, "amendment_fates").where(F.col("claim").isNotNull())
    return rows.select("id", T.short_title(F.concat(F.lit("Entwurf eines "), F.col("claim"))).alias("title")).distinct()


@query("SELECT DISTINCT id, regexp_extract(rtrim(url), '([^/]*)$', 1) AS tail FROM procedure_watch_history WHERE url IS NOT NULL")
def uri_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last path segment of addresses, scalars taken as lists."""
    rows = table(spark, sf_dir, "procedure_watch_history").where(F.col("url").isNotNull())
    return rows.select("id", T.uri_tail(T.as_list(F.col("url"))).alias("tail")).distinct()


# -- extraction


@query(
    """WITH d AS (SELECT doc_id, lower(trim(act_id)) AS act_id, regexp_extract(text, '^([^\n]*)', 1) AS heading, regexp_extract(text, '(?s)^(.*?)(wird wie folgt geändert|wird aufgehoben|wird durch|$)', 1) AS preamble FROM documents WHERE kind = 'amendment' AND text IS NOT NULL AND act_id IS NOT NULL),
n AS (SELECT lower(trim(act_id)) AS act_id, min(split_part(jurabk, ' ', 1)) AS name FROM retrospective_store GROUP BY 1) SELECT doc_id, contains(heading, name) OR contains(preamble, name) OR contains(heading, name || 's') AS named FROM d JOIN n USING (act_id)"""
)
def named_in_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an amending text names its act in the heading or before the first operative verb."""
    names = table(spark, sf_dir, "retrospective_store").groupBy(act_key().alias("act_id")).agg(F.min(F.split_part("jurabk", F.lit(" "), F.lit(1))).alias("name"))
    rows = texts(spark, sf_dir).where((F.col("kind") == "amendment") & F.col("act_id").isNotNull()).select("doc_id", act_key().alias("act_id"), "text")
    heading = F.regexp_extract("text", r"^([^\n]*)", 1)
    return rows.join(names, "act_id").select("doc_id", extract.name_in_heading(heading, F.col("text"), T.name_forms(F.col("name"))).alias("named"))


@query(
    """WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS line, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) AS part FROM documents WHERE kind = 'amendment' AND text IS NOT NULL),
n AS (SELECT area AS act_id, unnest(regexp_split_to_array(title_de, ' ')) AS name FROM subject_areas), w AS (SELECT DISTINCT doc_id, part, unnest(regexp_split_to_array(line, '[^\\p{L}0-9]+')) AS name FROM p),
h AS (SELECT doc_id, act_id, count(DISTINCT part) AS hits FROM w JOIN n USING (name) GROUP BY 1, 2), k AS (SELECT doc_id, count(*) AS parts FROM p GROUP BY 1)
SELECT doc_id, act_id, CASE WHEN parts = 1 THEN 'whole_article' WHEN hits = 1 THEN 'collective_subsection' ELSE 'ambiguous_subsections' END AS scope FROM h JOIN k USING (doc_id)"""
)
def collective_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a collective text name a thing: the whole text, one line, or several."""
    parts = texts(spark, sf_dir).where("kind = 'amendment'").select("doc_id", F.posexplode(F.split("text", "\n+")).alias("part", "text"))
    names = table(spark, sf_dir, "subject_areas").select(F.col("area").alias("act_id"), F.explode(F.split("title_de", " ")).alias("name"))
    return extract.subsection_scope(parts, "doc_id", "text", names)


@query(
    """WITH r AS (SELECT DISTINCT change_id, para, operation FROM act_archive WHERE para IS NOT NULL AND operation IS NOT NULL) SELECT change_id, unnest(regexp_extract_all(para, '[0-9]+[a-z]?')) AS norm, CASE operation WHEN 'repeal' THEN 'repeal' WHEN 'add' THEN 'insert' WHEN 'replace' THEN 'replace' ELSE 'modify' END AS operation FROM r"""
)
def amendment_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors such as 'geänd. (§ 3)' to sections and operations."""
    rows = table(spark, sf_dir, "act_archive").where(F.col("para").isNotNull() & F.col("operation").isNotNull()).select("change_id", "para", "operation").distinct()
    verb = F.when(F.col("operation") == "repeal", "aufgeh.").when(F.col("operation") == "add", "eingef.").when(F.col("operation") == "replace", "neu gef.").otherwise("geänd.")
    found = extract.amendment_descriptor(F.concat(verb, F.lit(" ("), F.col("para"), F.lit(")")))
    return rows.select("change_id", F.inline(found["operations"]))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract(text, '§§? ?([0-9 a-z,.]+((und|oder|sowie) [0-9 a-z.]+)*)', 1) AS body FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, list_distinct(regexp_extract_all(regexp_replace(body, '\bff?\.', '', 'g'), '\b([0-9]+[a-z]?)\b', 1)) AS norms FROM t)
SELECT doc_id, unnest(norms) AS norm FROM b"""
)
def norm_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section numbers of each text's first list."""
    return texts(spark, sf_dir).select("doc_id", F.explode(extract.norm_list(F.col("text"))).alias("norm"))


@query(
    r"""SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(\((EU|EG)\) (Nr\. )?[0-9]{1,4}/[0-9]{2,4}|\b[0-9]{2,4}/[0-9]{1,4}/(EG|EWG|EU)|\bdocument [0-9]{1,3}/[0-9]{1,5})', 1))) AS reference FROM documents WHERE text IS NOT NULL"""
)
def eu_reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to European acts and papers in all texts."""
    return texts(spark, sf_dir).select("doc_id", F.explode(extract.eu_references(F.col("text"))).alias("reference"))


# -- states and their proof


@query(
    """WITH c AS (SELECT DISTINCT change_id, old_text, new_text FROM act_archive), e AS (SELECT change_id, side, body FROM (SELECT change_id, 'old' AS side, old_text AS body FROM c UNION ALL SELECT change_id, 'new', new_text FROM c) WHERE body IS NOT NULL)
SELECT change_id, side, sha256(body) AS digest, true AS verified FROM e"""
)
def verified_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both endpoints of each change looked up by digest, their bodies hashed again."""
    rows = table(spark, sf_dir, "act_archive").select("change_id", F.inline(F.array(F.struct(F.lit("old").alias("side"), F.col("old_text").alias("body")), F.struct(F.lit("new").alias("side"), F.col("new_text").alias("body"))))).where(F.col("body").isNotNull())
    stored = rows.select(F.sha2("body", 256).alias("digest"), "body").dropDuplicates(["digest"])
    ends = rows.select("change_id", "side", F.sha2("body", 256).alias("digest")).distinct()
    return ends.join(stored, "digest").select("change_id", "side", "digest", (~validate.bad_digest("digest", "body")).alias("verified"))


@query("SELECT doc_id, sha256(text) AS digest, CAST(len(regexp_extract_all(text, '(^|\n)(\\([0-9]+[a-z]?\\))')) AS INT) AS sections FROM documents WHERE text IS NOT NULL")
def sections_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct body is cut into its numbered paragraphs once and looked up by its digest."""
    rows = texts(spark, sf_dir).select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    parsed = rows.dropDuplicates(["digest"]).select("digest", F.size(F.regexp_extract_all("text", F.lit(r"(?:^|\n)(\(\d+[a-z]?\))"), F.lit(1))).alias("sections"))
    return rows.select("doc_id", "digest").join(parsed, "digest")


@query(
    """WITH o AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, observed_at, received_at, source_url, state_sha256, norm_count FROM state_observations),
r AS (SELECT *, CASE WHEN NOT coalesce(starts_with(source_url, 'https://statutes.example/'), false) THEN 'host' WHEN NOT coalesce(regexp_matches(state_sha256, '[0-9A-Fa-f]{64}'), false) THEN 'digest' WHEN NOT coalesce(norm_count > 0, false) THEN 'empty' ELSE 'valid' END AS outcome FROM o)
SELECT outcome, count(*) AS n FROM r GROUP BY 1"""
)
def capture_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures by the first check they fail: official host, readable digest, content."""
    rows = table(spark, sf_dir, "state_observations").select(act_key().alias("act_id"), "observed_at", "received_at", "source_url", "state_sha256", "norm_count").distinct()
    outcome = (
        F.when(validate.bad_evidence("source_url", ["statutes.example"]), "host")
        .when(~F.coalesce(F.col("state_sha256").rlike("[0-9A-Fa-f]{64}"), F.lit(False)), "digest")
        .when(~F.coalesce(F.col("norm_count") > 0, F.lit(False)), "empty")
        .otherwise("valid")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_O}, d AS (SELECT observed_at, row_number() OVER (ORDER BY observed_at) AS n FROM (SELECT DISTINCT observed_at FROM o)), p AS (SELECT * FROM o JOIN d USING (observed_at))
SELECT b.act_id, CAST(a.observed_at AS VARCHAR) AS old_day, CAST(b.observed_at AS VARCHAR) AS new_day FROM p a JOIN p b ON a.act_id = b.act_id AND b.n = a.n + 1 WHERE a.digest <> b.digest AND a.digest <> '-' AND b.digest <> '-'"""
)
def adjacent_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between every two adjacent snapshots, acts complete on both sides only."""
    rows = observations(spark, sf_dir)
    # One row per snapshot day.
    days = rows.select("observed_at").distinct().withColumn("n", F.row_number().over(Window.orderBy("observed_at")))
    along = Window.partitionBy("act_id").orderBy("n")
    before = lambda c: F.lag(c).over(along)
    placed = rows.join(F.broadcast(days), "observed_at").select("act_id", "observed_at", "digest", "n", before("n").alias("m"), before("digest").alias("old"), before("observed_at").alias("old_day"))
    return placed.where((F.col("m") == F.col("n") - 1) & (F.col("old") != F.col("digest")) & (F.col("old") != "-") & (F.col("digest") != "-")).select(
        "act_id", F.col("old_day").cast("string").alias("old_day"), F.col("observed_at").cast("string").alias("new_day")
    )


_REVIEWED = "v AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, incoming.effective_at AS day, incoming.document_id AS document_id FROM verified_reconstruction_reviews WHERE incoming.effective_at IS NOT NULL)"


@query(
    f"""WITH {_C}, {_REVIEWED}, w AS (SELECT act_id, day, min(document_id) AS document_id FROM v GROUP BY 1, 2), e AS (SELECT DISTINCT change_id, act_id, day FROM c WHERE day IS NOT NULL)
SELECT change_id, CASE WHEN w.act_id IS NOT NULL THEN 'exact' ELSE 'correspondence' END AS tier, w.document_id FROM e LEFT JOIN w USING (act_id, day)"""
)
def public_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated changes in two tiers: exact if a review confirms the act's day, else a correspondence without document."""
    reviewed = table(spark, sf_dir, "verified_reconstruction_reviews").where(F.col("incoming.effective_at").isNotNull())
    confirmed = reviewed.groupBy(act_key().alias("act_id"), F.col("incoming.effective_at").alias("day")).agg(F.min("incoming.document_id").alias("document_id"), F.lit(True).alias("exact"))
    events = changes(spark, sf_dir).where(F.col("day").isNotNull()).select("change_id", "act_id", "day").distinct()
    joined = events.join(confirmed, ["act_id", "day"], "left")
    return joined.select("change_id", F.when(F.col("exact"), "exact").otherwise("correspondence").alias("tier"), "document_id")


@query(
    f"""WITH {_SEGMENTS}, {_A}, {_C}, i AS (SELECT act_id, count(*) AS intervals, min(effective_from) AS history_start FROM a WHERE knowledge_to IS NULL GROUP BY 1), g AS (SELECT act_id, count(*) AS states FROM s GROUP BY 1), e AS (SELECT act_id, count(DISTINCT change_id) AS events FROM c GROUP BY 1)
SELECT act_id, coalesce(intervals, 0) AS intervals, CAST(history_start AS VARCHAR) AS history_start, coalesce(states, 0) AS states, coalesce(events, 0) AS events FROM i FULL OUTER JOIN g USING (act_id) FULL OUTER JOIN e USING (act_id)"""
)
def public_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per act: its current intervals, first day, states and events, each counted from its own relation."""
    from palimpsest.operators import bitemporal

    intervals = assertions(spark, sf_dir).where(F.col("knowledge_to").isNull()).groupBy("act_id").agg(F.count("*").alias("intervals"), F.min("effective_from").cast("string").alias("history_start"))
    states = bitemporal.segments(observations(spark, sf_dir), "act_id", "observed_at", "digest").groupBy("act_id").agg(F.count("*").alias("states"))
    events = changes(spark, sf_dir).groupBy("act_id").agg(F.count_distinct("change_id").alias("events"))
    joined = intervals.join(states, "act_id", "full_outer").join(events, "act_id", "full_outer")
    return joined.fillna(0, ["intervals", "states", "events"]).where(F.col("act_id").isNotNull()).select("act_id", "intervals", "history_start", "states", "events")


@query(
    """WITH f AS (SELECT DISTINCT id, title, procedure_id, lower(trim(c.act_id)) AS act_id FROM (SELECT id, title, procedure_id, unnest(current_law_checks) AS c FROM amendment_fates) WHERE c IS NOT NULL AND title IS NOT NULL),
d AS (SELECT doc_id, lower(trim(act_id)) AS act_id, text FROM documents WHERE text IS NOT NULL AND act_id IS NOT NULL) SELECT id, doc_id, act_id FROM f JOIN d USING (act_id) WHERE contains(lower(text), lower(title))"""
)
def confirmed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the acts that a fate checks, confirmed by its title standing in the text; hot acts are spread."""
    fates = table(spark, sf_dir, "amendment_fates").where(F.col("title").isNotNull()).select("id", "title", F.explode("current_law_checks").alias("c"))
    fates = fates.select("id", "title", F.lower(F.trim("c.act_id")).alias("act_id")).where(F.col("act_id").isNotNull()).distinct()
    documents = texts(spark, sf_dir).where(F.col("act_id").isNotNull()).select("doc_id", act_key().alias("act_id"), "text")
    joined = relational.spread_join(documents, fates, "act_id")
    return joined.where(F.contains(F.lower("text"), F.lower("title"))).select("id", "doc_id", "act_id")


# -- watched records


@query(
    """WITH h AS (SELECT id, source, observed_at, stage, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at DESC, id DESC, source DESC, observed_at DESC, stage DESC NULLS LAST) AS k FROM procedure_watch_history) WHERE k = 1 AND stage IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY observed_at DESC, event_id DESC) AS k FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY observed_at DESC, event_id DESC) AS j FROM l WHERE k = 1)
SELECT id, max(stage) FILTER (WHERE j = 1) AS newest_stage, count(*) AS sources FROM n GROUP BY id"""
)
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the evidence of each procedure, one entry per source, with the newest put in its place; the newest stage leads."""
    history = table(spark, sf_dir, "procedure_watch_history")
    latest = relational.latest_per_key(history, ["event_id"], ["received_at", "id", "source", "observed_at", "stage"], ["received_at", "id", "source", "observed_at", "stage"])
    # At most one entry per source is left before anything is gathered.
    per_source = latest.where(F.col("stage").isNotNull()).groupBy("id", "source").agg(F.max(F.struct("observed_at", "event_id", "stage")).alias("m"))
    entry = F.struct(F.col("m.observed_at").alias("observed_at"), F.col("m.event_id").alias("event_id"), F.col("m.stage").alias("stage"), F.col("source"))
    gathered = per_source.groupBy("id").agg(F.collect_list(entry).alias("events"), F.max(entry).alias("fresh"))
    merged = gathered.select("id", ledger.merge_evidence(F.col("events"), F.col("fresh")).alias("events"))
    return merged.select("id", F.get("events", F.lit(0))["stage"].alias("newest_stage"), F.size("events").cast("bigint").alias("sources"))


@query(
    """WITH f AS (SELECT procedure_id AS id, bool_or(coalesce(result = 'taken_up', false)) AS matches FROM amendment_fates WHERE procedure_id IS NOT NULL GROUP BY 1), h AS (SELECT id, bool_or(terminal) AS published, bool_or(event = 'checked') AS reviewed FROM procedure_watch_history GROUP BY 1)
SELECT id, coalesce(published, false) AND coalesce(reviewed, false) AND coalesce(matches, false) AS is_final FROM h LEFT JOIN f USING (id)"""
)
def final_review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure is final only if it is published, was reviewed and its result matches; unknown is no."""
    fates = table(spark, sf_dir, "amendment_fates").where(F.col("procedure_id").isNotNull()).groupBy(F.col("procedure_id").alias("id")).agg(F.bool_or(F.coalesce(F.col("result") == "taken_up", F.lit(False))).alias("matches"))
    history = table(spark, sf_dir, "procedure_watch_history").groupBy("id").agg(F.bool_or("terminal").alias("published"), F.bool_or(F.col("event") == "checked").alias("reviewed"))
    return history.join(fates, "id", "left").select("id", ledger.final_review(F.col("published"), F.col("reviewed"), F.col("matches")).alias("is_final"))


@query(
    """WITH h AS (SELECT DISTINCT id, stage, terminal FROM procedure_watch_history WHERE starts_with(id, 'eu-')) SELECT id, coalesce(array_to_string(list_sort(list_distinct(list(stage) FILTER (WHERE terminal AND stage IS NOT NULL))), ','), '') AS adopted, count(DISTINCT stage) AS stages FROM h GROUP BY id"""
)
def adopted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each European procedure the sorted distinct stages of its final events only."""
    rows = table(spark, sf_dir, "procedure_watch_history").where(F.col("id").startswith("eu-")).select("id", "stage", "terminal").distinct()
    final = F.collect_set(F.when(F.col("terminal"), F.col("stage")))
    return rows.groupBy("id").agg(F.coalesce(F.array_join(F.array_sort(final), ","), F.lit("")).alias("adopted"), F.count_distinct("stage").alias("stages"))


# Belief masses (true, false, both, none) of a procedure by its status.
STATUS_MASSES = {
    "Verkündet": (0.95, 0.0, 0.0, 0.05), "Abgeschlossen - Ergebnis siehe Vorgangsablauf": (0.6, 0.2, 0.1, 0.1), "Verabschiedet": (0.8, 0.02, 0.05, 0.13), "Beschlussempfehlung liegt vor": (0.55, 0.05, 0.1, 0.3),
    "Überwiesen": (0.3, 0.05, 0.05, 0.6), "Dem Bundestag zugeleitet - Noch nicht beraten": (0.15, 0.05, 0.0, 0.8), "Dem Bundesrat zugeleitet - Noch nicht beraten": (0.15, 0.05, 0.0, 0.8), "Noch nicht beraten": (0.1, 0.05, 0.0, 0.85),
    "1. Durchgang im Bundesrat abgeschlossen": (0.35, 0.05, 0.05, 0.55), "Abgelehnt": (0.02, 0.95, 0.0, 0.03), "Für erledigt erklärt": (0.02, 0.9, 0.0, 0.08), "Zurückgezogen": (0.02, 0.9, 0.0, 0.08),
}
DEFAULT_MASSES = (0.2, 0.1, 0.05, 0.65)
_MASS_ROWS = ", ".join(f"('{s}', {t}::DOUBLE, {f}::DOUBLE, {b}::DOUBLE, {n}::DOUBLE)" for s, (t, f, b, n) in STATUS_MASSES.items())


@query(
    f"""WITH m(status, t, f, b, n) AS (VALUES {_MASS_ROWS}), h AS (SELECT id, arg_max(trim(to_status), strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') || event_id || to_status) AS status FROM (SELECT DISTINCT id, observed_at, event_id, to_status FROM procedure_watch_history WHERE to_status IS NOT NULL) GROUP BY id)
SELECT id, round(greatest(coalesce(t, 0.2), coalesce(f, 0.1)), 3) AS confidence, round(coalesce(b, 0.05), 3) AS contradiction, round(least(1.0, coalesce(n, 0.65) + coalesce(b, 0.05) / 2), 3) AS uncertainty FROM h LEFT JOIN m USING (status)"""
)
def status_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each procedure to belief masses by a closed table, with a default, and their derived fields."""
    rows = table(spark, sf_dir, "procedure_watch_history").where(F.col("to_status").isNotNull())
    last = rows.groupBy("id").agg(F.max(F.struct("observed_at", "event_id", "to_status")).alias("r")).select("id", F.trim("r.to_status").alias("status"))
    masses = spark.createDataFrame([(s, *m) for s, m in STATUS_MASSES.items()], "status string, t double, f double, b double, n double")
    # The table of statuses is fixed.
    joined = last.join(F.broadcast(masses), "status", "left")
    filled = [F.coalesce(c, F.lit(d)) for c, d in zip("tfbn", DEFAULT_MASSES)]
    return joined.select("id", graph.belief(*filled).alias("k")).select("id", "k.confidence", "k.contradiction", "k.uncertainty")


@query(
    f"""WITH {_O}, d AS (SELECT DISTINCT observed_at FROM o ORDER BY 1 DESC LIMIT 6), l AS (SELECT act_id, max(digest <> '-' AND observed_at = (SELECT max(observed_at) FROM d)) AS captured, count(*) AS attempts FROM o WHERE observed_at IN (SELECT observed_at FROM d) GROUP BY 1),
n AS (SELECT lower(trim(act_id)) AS act_id, count(DISTINCT change_id) AS changes FROM act_archive WHERE act_id IS NOT NULL GROUP BY 1), q AS (SELECT n.act_id AS key, starts_with(n.act_id, 'fed_') AS mapped, coalesce(attempts, 0) AS tried, changes * 1000 AS bytes FROM n LEFT JOIN l USING (act_id) WHERE NOT coalesce(captured, false)),
k AS (SELECT *, row_number() OVER (ORDER BY mapped DESC, tried, key) AS place FROM q), t AS (SELECT *, sum(bytes) OVER (ORDER BY place) AS total FROM k WHERE place <= 64) SELECT key, CAST(place AS INT) AS place, bytes FROM t WHERE total <= 1000000"""
)
def capture_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which acts the next run fetches within its budgets of 64 downloads and a million bytes.

    The last six snapshots are the attempts; an act with a digest in the newest one is captured.
    """
    seen = observations(spark, sf_dir)
    days = [r[0] for r in seen.select("observed_at").distinct().orderBy(F.desc("observed_at")).limit(6).collect()]
    state = F.when((F.col("digest") != "-") & (F.col("observed_at") == F.lit(days[0] if days else None)), "captured").otherwise("failed")
    tried = seen.where(F.col("observed_at").isin(days)).select(F.col("act_id").alias("key"), state.alias("state"), F.lit(1).cast("bigint").alias("attempts"))
    held = ledger.capture_merge(tried, tried.limit(0), "key")
    acts = table(spark, sf_dir, "act_archive").where(F.col("act_id").isNotNull()).groupBy(act_key().alias("key")).agg((F.count_distinct("change_id") * 1000).alias("bytes"))
    return ledger.capture_plan(acts.withColumn("mapped", F.col("key").startswith("fed_")), held, "key", 64, 1_000_000)


@query(
    """WITH h AS (SELECT id, event_id, observed_at, stage FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at DESC, id DESC, observed_at DESC, stage DESC NULLS LAST) AS k FROM procedure_watch_history) WHERE k = 1)
SELECT event_id, coalesce(max(CASE WHEN contains(lower(stage), 'lesung') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY observed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_reading FROM h"""
)
def reading_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reading came before each event of its procedure; the first reading of each procedure is an aggregate, so no long window is needed."""
    history = table(spark, sf_dir, "procedure_watch_history")
    rows = relational.latest_per_key(history, ["event_id"], ["received_at", "id", "observed_at", "stage"], ["received_at", "id", "observed_at", "stage"])
    place = F.struct("observed_at", "event_id")
    first = rows.where(F.lower("stage").contains("lesung")).groupBy("id").agg(F.min(place).alias("first"))
    return rows.join(first, "id", "left").select("event_id", F.coalesce(place > F.col("first"), F.lit(False)).alias("after_reading"))


@query(
    """WITH h AS (SELECT id, bool_or(coalesce(terminal, false)) AS ended, arg_max(trim(to_status), strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') || event_id || to_status) AS status FROM (SELECT DISTINCT id, observed_at, event_id, to_status, terminal FROM procedure_watch_history WHERE to_status IS NOT NULL) GROUP BY id),
f AS (SELECT procedure_id AS id, bool_or(jurisdiction = 'EU') AS eu, bool_or(result = 'taken_up') AS taken FROM amendment_fates WHERE procedure_id IS NOT NULL GROUP BY 1)
SELECT id, status, CASE WHEN NOT ended THEN 'open' WHEN coalesce(taken, false) THEN CASE WHEN coalesce(eu, false) THEN 'merge' ELSE 'commit' END ELSE 'closed' END AS type FROM h JOIN f USING (id)"""
)
def commit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a procedure's commit: open while it runs, commit if taken up (merge if it carries European law), else closed."""
    rows = table(spark, sf_dir, "procedure_watch_history").where(F.col("to_status").isNotNull())
    last = rows.groupBy("id").agg(F.bool_or(F.coalesce("terminal", F.lit(False))).alias("ended"), F.max(F.struct("observed_at", "event_id", "to_status")).alias("r"))
    fates = table(spark, sf_dir, "amendment_fates").where(F.col("procedure_id").isNotNull()).groupBy(F.col("procedure_id").alias("id")).agg(F.bool_or(F.col("jurisdiction") == "EU").alias("eu"), F.bool_or(F.col("result") == "taken_up").alias("taken"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(~F.col("ended"), "open").when(no("taken") & no("eu"), "merge").when(no("taken"), "commit").otherwise("closed")
    return last.join(fates, "id").select("id", F.trim("r.to_status").alias("status"), kind.alias("type"))


@query(
    """WITH e AS (SELECT id, place, e.act_id AS cited, lower(e.jurabk) AS alias, CASE WHEN starts_with(e.act_id, 'by_') THEN 'art' ELSE 'para' END AS kind, [p FOR p IN coalesce(e.paras, []) IF p IS NOT NULL] AS paras FROM (SELECT id, unnest(effects) AS e, generate_subscripts(effects, 1) - 1 AS place FROM (SELECT DISTINCT id, effects FROM decisions)) WHERE e IS NOT NULL AND e.jurabk IS NOT NULL AND e.act_id IS NOT NULL),
m AS (SELECT id, place, alias, kind, unnest(paras) AS low, generate_subscripts(paras, 1) - 1 AS item FROM e), g AS (SELECT lower(jurabk) AS alias, count(DISTINCT lower(trim(act_id))) AS acts, min(lower(trim(act_id))) AS act_id FROM retrospective_store GROUP BY 1)
SELECT CASE WHEN g.acts = 1 THEN g.act_id END AS act_id, kind, low, count(*) AS occurrence_count, array_to_string(list_sort(list_distinct(list(m.alias))), ',') AS aliases, min(id || '|' || place || '|' || item) AS first_place FROM m LEFT JOIN g USING (alias) GROUP BY 1, 2, 3"""
)
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of one section counted, with the names it is cited under and the place of the first."""
    effects = table(spark, sf_dir, "decisions").select("id", "effects").distinct().select("id", F.posexplode("effects").alias("effect", "e"))
    effects = effects.where(F.col("e.jurabk").isNotNull() & F.col("e.act_id").isNotNull()).select("id", "effect", "e.act_id", "e.jurabk", F.array_compact("e.paras").alias("p")).where(F.size("p") > 0)
    marker = F.when(F.col("act_id").startswith("by_"), "Art. ").otherwise("§§ ")
    sentence = F.concat(marker, F.array_join("p", ", "), F.lit(" des "), F.col("jurabk"), F.lit("."))
    members = extract.citation_members(effects.select(F.concat_ws("|", "id", "effect").alias("key"), sentence.alias("text")), "key", "text")
    named = members.withColumn("alias", extract.attached_name(F.col("tail"))["two"]).withColumn("at", F.concat_ws("|", "key", "item"))
    registry = table(spark, sf_dir, "retrospective_store").groupBy(F.lower("jurabk").alias("alias")).agg(F.count_distinct(act_key()).alias("acts"), F.min(act_key()).alias("found"))
    edges = named.join(registry, "alias", "left").withColumn("act_id", F.when(F.col("acts") == 1, F.col("found")))
    rolled = extract.citation_rollup(edges, ["act_id", "kind", "low"], "alias", "at", "at")
    return rolled.select("act_id", "kind", "low", "occurrence_count", F.array_join("aliases", ",").alias("aliases"), F.col("excerpt").alias("first_place"))


@query(
    """WITH d AS (SELECT doc_id, kind || ' [' || source || ']' AS fact, published_at FROM documents WHERE published_at IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY published_at DESC, doc_id) AS k FROM d)
SELECT fact, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS newest FROM k WHERE k <= 3 AND fact IS NOT NULL GROUP BY 1"""
)
def digest_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest texts of each kind and source."""
    fact = F.concat(F.col("kind"), F.lit(" ["), F.col("source"), F.lit("]"))
    rows = table(spark, sf_dir, "documents").where(F.col("published_at").isNotNull()).select("doc_id", fact.alias("fact"), F.datediff(F.lit("9999-12-31").cast("date"), "published_at").alias("age")).where(F.col("fact").isNotNull())
    # Three rows of each part first, so that a kind with most of the texts is not sorted in one task.
    top = lambda d, *keys: d.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("age", "doc_id"))).where("k <= 3")
    few = top(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))), "fact", "part").drop("part", "k")
    return few.groupBy("fact").agg(F.slice(F.array_sort(F.collect_list(F.struct("age", "doc_id"))), 1, 3).alias("n")).select("fact", F.array_join(F.transform("n", lambda x: x["doc_id"].cast("string")), ",").alias("newest"))


# -- graph and classes


@query(
    f"""WITH {_V}, o AS (SELECT a AS key, count(*) AS n FROM e GROUP BY 1), i AS (SELECT b AS key, count(*) AS n FROM e GROUP BY 1)
SELECT 'v-' || substr(sha256(key), 1, 16) AS id, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM o FULL OUTER JOIN i USING (key)"""
)
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges out of and into each vertex."""
    return graph.degree(graph_tables(spark, sf_dir)[1])


@query(
    f"""WITH {_V}, c AS (SELECT DISTINCT b FROM e WHERE kind = 'cites'), f AS (SELECT DISTINCT b FROM e WHERE kind = 'affects')
SELECT 'v-' || substr(sha256(kind || '|' || key), 1, 16) AS id, CASE WHEN kind <> 'act' THEN kind WHEN starts_with(key, 'by_') THEN 'land-act' WHEN kind || '|' || key IN (SELECT b FROM f) THEN 'affected-act' WHEN kind || '|' || key IN (SELECT b FROM c) THEN 'cited-act' ELSE 'act' END AS node_kind FROM v"""
)
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a vertex by its key's prefix and by the role it has in edges (two semi-joins)."""
    nodes, links = graph_tables(spark, sf_dir)
    target = lambda kind, name: links.where(F.col("kind") == kind).select(F.col("dst").alias("id")).distinct().withColumn(name, F.lit(True))
    joined = nodes.join(target("affects", "affected"), "id", "left").join(target("cites", "cited"), "id", "left")
    kind = F.when(F.col("kind") != "act", F.col("kind")).when(F.col("key").startswith("by_"), "land-act").when(F.col("affected"), "affected-act").when(F.col("cited"), "cited-act").otherwise("act")
    return joined.select("id", kind.alias("node_kind"))


@query(
    """WITH a AS (SELECT lower(trim(act_id)) AS act_id, min(jurabk) AS jurabk FROM retrospective_store GROUP BY 1)
SELECT act_id, CASE WHEN lower(jurabk) IN ('gg', 'bayverf', 'bv') OR act_id IN ('fed_gg', 'by_bayverf', 'by_bv') THEN 'constitution' WHEN regexp_matches(jurabk, '(V|VO|Verordnung)( |$)') THEN 'ordinance' ELSE 'statute' END AS class FROM a"""
)
def act_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: constitution, ordinance or statute by an act's id and abbreviation."""
    acts = table(spark, sf_dir, "retrospective_store").groupBy(act_key().alias("act_id")).agg(F.min("jurabk").alias("jurabk"))
    # The ids and abbreviations of the constitutional texts.
    constitution = F.lower("jurabk").isin("gg", "bayverf", "bv") | F.col("act_id").isin("fed_gg", "by_bayverf", "by_bv")
    return acts.select("act_id", F.when(constitution, "constitution").when(F.col("jurabk").rlike(r"(?:V|VO|Verordnung)(?: |$)"), "ordinance").otherwise("statute").alias("class"))


# -- endpoints


@query(
    f"""WITH {_A} SELECT assertion_id, CAST(effective_from AS VARCHAR) AS effective_from FROM a WHERE act_id = 'fed_rahmeng' AND knowledge_from <= TIMESTAMP '2024-06-01 00:00:00' AND (knowledge_to IS NULL OR TIMESTAMP '2024-06-01 00:00:00' < knowledge_to)"""
)
def act_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assertions of one act as known at an instant."""
    return api.history(spark, sf_dir, "RahmenG", "2024-06-01T00:00:00+00:00").select("assertion_id", F.col("effective_from").cast("string").alias("effective_from"))


@query(
    f"""WITH {_A}, k AS (SELECT act_id, count(*) AS n FROM a WHERE knowledge_from <= TIMESTAMP '2024-06-01 00:00:00' AND (knowledge_to IS NULL OR TIMESTAMP '2024-06-01 00:00:00' < knowledge_to) AND effective_from <= DATE '2020-06-01' AND (effective_to IS NULL OR DATE '2020-06-01' < effective_to) GROUP BY 1)
SELECT act_id, CASE WHEN n IS NULL THEN 'NotFoundError' WHEN n > 1 THEN 'AmbiguityError' ELSE 'found' END AS answer FROM (SELECT DISTINCT act_id FROM a) LEFT JOIN k USING (act_id)"""
)
def answer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: the answer or error that a point question has for every act."""
    from palimpsest.operators import bitemporal

    known = assertions(spark, sf_dir)
    hits = bitemporal.history_slice(known, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).where(bitemporal.valid_on(F.lit("2020-06-01").cast("date")))
    counted = hits.groupBy("act_id").agg(F.count("*").alias("n"))
    error = F.when(F.col("n").isNull(), validate.NotFoundError.__name__).when(F.col("n") > 1, validate.AmbiguityError.__name__).otherwise("found")
    return known.select("act_id").distinct().join(counted, "act_id", "left").select("act_id", error.alias("answer"))


@query(
    """WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> ''] AS words FROM t), p AS (SELECT doc_id, len(words) AS length, len([x FOR x IN words IF starts_with(x, 'behörde')]) AS a, len([x FOR x IN words IF starts_with(x, 'antrag')]) AS b FROM w),
s AS (SELECT count(*) AS n, avg(length) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM p), r AS (SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / av)) AS score FROM p, s WHERE a > 0 AND b > 0)
SELECT doc_id, round(score, 4) AS score FROM r ORDER BY round(score, 6) DESC, doc_id LIMIT 25"""
)
def find_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 25 texts of a search as the endpoint gives them."""
    return api.find(spark, sf_dir, "Behörde Antrag", 25).select("doc_id", "score")


@query(
    """WITH w AS (SELECT source AS job, CASE WHEN zone_name = 'Europe/Berlin' THEN 24 ELSE 12 END AS every_hours FROM watch_sources), r AS (SELECT source AS job, max(received_at) AS last FROM procedure_watch_history WHERE to_status IS NOT NULL GROUP BY 1),
x AS (SELECT job, every_hours, (epoch(TIMESTAMP '2026-01-01 00:00:00') - floor(epoch(last))) / 3600 AS waited FROM w LEFT JOIN r USING (job)) SELECT job, waited IS NULL OR waited >= every_hours AS due, CAST(floor(waited - every_hours) AS BIGINT) AS overdue_hours FROM x"""
)
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources are to be fetched now, by their daily or twice-daily rhythm and their last good delivery (outages count as failed)."""
    jobs = table(spark, sf_dir, "watch_sources").select(F.col("source").alias("job"), F.when(F.col("zone_name") == "Europe/Berlin", 24).otherwise(12).alias("every_hours"))
    runs = table(spark, sf_dir, "procedure_watch_history").select(F.col("source").alias("job"), F.col("received_at").alias("finished_at"), F.col("to_status").isNotNull().alias("ok"))
    return ledger.due_jobs(jobs, runs, F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query(
    """WITH d AS (SELECT lower(trim(act_id)) AS act_id, arg_max(norm_count, strftime(observed_at, '%Y-%m-%d') || strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') || lpad(CAST(coalesce(norm_count, 0) AS VARCHAR), 9, '0')) AS n FROM state_observations WHERE norm_count IS NOT NULL GROUP BY 1), c AS (SELECT lower(trim(act_id)) AS act_id, count(DISTINCT para) AS n FROM act_archive GROUP BY 1)
SELECT act_id, d.n AS declared, c.n AS counted FROM d FULL OUTER JOIN c USING (act_id) WHERE d.n IS DISTINCT FROM c.n"""
)
def declared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, A3: acts whose declared number of sections (last observation) is not the number that the archive knows."""
    seen = table(spark, sf_dir, "state_observations").where(F.col("norm_count").isNotNull())
    declared = seen.groupBy(act_key().alias("act_id")).agg(F.max(F.struct("observed_at", "received_at", "norm_count")).alias("r")).select("act_id", F.col("r.norm_count").alias("n"))
    counted = table(spark, sf_dir, "act_archive").groupBy(act_key().alias("act_id")).agg(F.count_distinct("para").alias("n"))
    return validate.differing_counts(declared, counted, "act_id")


# The ladder of a command by the status of its procedure; any other status is 'proposed'.
LADDER = {"Verkündet": "published", "Verabschiedet": "adopted", "Abgelehnt": "rejected", "Für erledigt erklärt": "not_merged", "Zurückgezogen": "not_merged"}


@query(
    "SELECT id, CASE trim(to_status) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LADDER.items()) + " ELSE 'proposed' END AS step, count(*) AS n FROM procedure_watch_history GROUP BY 1, 2"
)
def patch_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of each procedure's events on the ladder of commands, unknown and missing states as proposed."""
    steps = F.create_map(*[F.lit(x) for pair in LADDER.items() for x in pair])
    step = F.coalesce(F.element_at(steps, F.trim("to_status")), F.lit("proposed"))
    return table(spark, sf_dir, "procedure_watch_history").groupBy("id", step.alias("step")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_C}, h AS (SELECT act_id, label, arg_max(new_text, CAST(day AS VARCHAR) || new_text) AS body FROM c WHERE label IS NOT NULL AND new_text IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2), o AS (SELECT act_id, label, arg_min(old_text, CAST(day AS VARCHAR) || old_text) AS body FROM c WHERE label IS NOT NULL AND old_text IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2)
SELECT act_id, label, sha256(coalesce(h.body, o.body)) AS sha256, CASE WHEN h.body IS NOT NULL THEN 'head' ELSE 'reconstruction' END AS source, h.body IS NOT NULL AS exact FROM h FULL OUTER JOIN o USING (act_id, label)"""
)
def rendered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of each section by precedence of its sources, what is only reconstructed flagged as not exact."""
    from palimpsest.operators import archive

    rows = changes(spark, sf_dir).where(F.col("label").isNotNull() & F.col("day").isNotNull())
    pick = lambda f, c: rows.where(F.col(c).isNotNull()).groupBy("act_id", "label").agg(f(c, F.concat(F.col("day").cast("string"), F.col(c))).alias("body"))
    shown = archive.render({"head": pick(F.max_by, "new_text"), "reconstruction": pick(F.min_by, "old_text")}, ["act_id", "label"])
    return shown.select("act_id", "label", F.sha2("body", 256).alias("sha256"), "source", "exact")


@query(
    f"""WITH {_C}, {_REVIEWED}, w AS (SELECT act_id, day, min(document_id) AS document_id FROM v GROUP BY 1, 2), e AS (SELECT DISTINCT change_id, act_id, day FROM c WHERE day IS NOT NULL), x AS (SELECT change_id, e.act_id, e.day, w.document_id FROM e JOIN w USING (act_id, day))
SELECT change_id, CAST(day AS VARCHAR) AS day, count(*) OVER () AS matched FROM x ORDER BY day DESC, change_id LIMIT 50"""
)
def federal_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the exact events."""
    return api.federal_history(spark, sf_dir, None, "exact", 50).select("change_id", F.col("day").cast("string").alias("day"), "matched")


@query(
    """WITH r AS (SELECT DISTINCT id, interval_span.effective_from AS f, incoming.document_id AS document_id, jurabk, lower(trim(act_id)) AS act_id FROM verified_reconstruction_reviews) SELECT id, CAST(f AS VARCHAR) AS effective_from, count(*) OVER () AS matched FROM r ORDER BY f DESC NULLS LAST, id LIMIT 100 OFFSET 50"""
)
def reviews_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of all reviewed transitions."""
    return api.reviews(spark, sf_dir, limit=100, offset=50).select("id", F.col("effective_from").cast("string").alias("effective_from"), "matched")


@query()
def service_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoints of the query surface and their parameters (a list of the program's own functions; tested)."""
    rows = [(e["endpoint"], ",".join(f"{k}={v}" if v else k for k, v in e["parameters"].items()), e["about"]) for e in api.index()]
    return spark.createDataFrame(rows, "endpoint string, parameters string, about string")
