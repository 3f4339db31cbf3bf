"""Sources and sinks on the test tables: each writes a table in an outer format to the shared folder, or builds it, and reads it back."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from palimpsest.functions import arena
from palimpsest.operators import extract
from palimpsest.plans.found import act_key, decision_day
from palimpsest.plans.found_sql import DECIDED
from palimpsest.plans.ledgers import _V, graph_tables
from palimpsest.plans.registry import Register
from palimpsest.plans.temporal import _A, _O, assertions, observations
from palimpsest.plans.texts import texts
from palimpsest.session import shared_folder, table
from palimpsest.sources import documents, sinks, snapshots

register = Register()
query = register.query

_STATE = StructType([StructField(c, StringType()) for c in ("act_id", "digest")])


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _spread(key: Column, digits: int = 2) -> Column:
    """A bucket that divides the items of an outer document that would otherwise hold the whole table."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, digits)


def _family(spark: SparkSession, sf_dir: str) -> str:
    """The observations as a dated family of JSON lines, a folder per day."""
    root = shared_folder(spark, "snapshots")
    rows = observations(spark, sf_dir)
    rows.select(F.lit("gii").alias("source"), F.col("observed_at").cast("string").alias("day"), "act_id", "digest").write.partitionBy("source", "day").json(root)
    return root


@query(f"WITH {_O} SELECT act_id, digest FROM o WHERE observed_at = (SELECT max(observed_at) FROM o)")
def dated_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day of a dated family."""
    return snapshots.latest(spark, _family(spark, sf_dir), "gii", _STATE)


@query(f"WITH {_O} SELECT act_id, count(*) AS snapshots FROM o GROUP BY 1")
def strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: every line of a family, read by the strict reader that fails on a broken one."""
    rows = snapshots.read_jsonl_strict(spark, f"{_family(spark, sf_dir)}/source=gii", _STATE)
    return rows.groupBy("act_id").agg(F.count("*").alias("snapshots"))


@query(
    f"""WITH {_O}, d AS (SELECT DISTINCT CAST(observed_at AS VARCHAR) AS day FROM o), x AS (SELECT count(*) AS n, max(day) AS newest, min(day) AS oldest FROM d)
SELECT 'complete' AS fact, CAST(n AS VARCHAR) AS value FROM x UNION ALL SELECT 'newest', newest FROM x UNION ALL SELECT 'quarantined', '0' UNION ALL SELECT 'pruned', oldest FROM x UNION ALL SELECT 'left', CAST(n - 1 AS VARCHAR) FROM x"""
)
def snapshot_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete days, the newest file, a quarantined family (secondary sources stay behind that gate), and pruning after proof that all is archived."""
    root = _family(spark, sf_dir)
    days = snapshots.complete_days(spark, root, "gii", ["*.json"])
    newest = snapshots.newest_file(spark, root, "gii", "*.json")
    hidden = snapshots.latest(spark, root, "secondary_versions", _STATE).count()
    oldest = snapshots.read_jsonl(spark, f"{root}/source=gii/day={days[0]}", _STATE)
    pruned = snapshots.prune(spark, root, "gii", {days[0]: oldest}, observations(spark, sf_dir), "digest")
    facts = [("complete", str(len(days))), ("newest", newest.split("day=")[1].split("/")[0]), ("quarantined", str(hidden)), ("pruned", ",".join(pruned)), ("left", str(len(snapshots.days(spark, root, "gii"))))]
    return spark.createDataFrame(facts, "fact string, value string")


@query(
    """WITH l AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, para FROM act_archive WHERE para IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY act_id ORDER BY para) - 1 AS i FROM l)
SELECT act_id, CAST(i AS INT) AS norm_index, para AS enbez, act_id AS jurabk, 'Abschnitt ' || (i // 10 + 1) || ' Teil & mehr' AS gliederung FROM r"""
)
def statute_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute XML parsed to sections; the heading stands at every tenth one only and is carried on."""
    labels = table(spark, sf_dir, "act_archive").where(F.col("para").isNotNull()).groupBy(act_key().alias("act_id")).agg(F.array_sort(F.collect_set("para")).alias("labels"))

    def norm(label: Column, i: Column) -> Column:
        head = F.concat(F.lit("<gliederungseinheit><gliederungsbez>Abschnitt "), (F.floor(i / 10) + 1).cast("string"), F.lit("</gliederungsbez><gliederungstitel>Teil &amp; mehr</gliederungstitel></gliederungseinheit>"))
        first = F.concat(F.lit("<jurabk>"), _escaped(F.col("act_id")), F.lit("</jurabk>"))
        meta = F.concat(F.when(i == 0, first).otherwise(""), F.when(i % 10 == 0, head).otherwise(""), F.lit("<enbez>"), _escaped(label), F.lit("</enbez>"))
        return F.concat(F.lit("<norm><metadaten>"), meta, F.lit("</metadaten><textdaten><text><Content>Satz &lt;1&gt;.</Content></text></textdaten></norm>"))

    xml = labels.select("act_id", F.concat(F.lit('<dokumente builddate="20240101">'), F.array_join(F.transform("labels", norm), ""), F.lit("</dokumente>")).alias("xml"))
    return documents.parse_law(xml, "act_id", "xml")[1].select("act_id", F.col("norm_index").cast("int").alias("norm_index"), "enbez", "jurabk", "gliederung")


@query("SELECT lower(trim(act_id)) AS slug, min(jurabk) AS title, 'https://statutes.example/' || lower(trim(act_id)) || '/xml.zip' AS link FROM retrospective_store GROUP BY lower(trim(act_id))")
def contents_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents in XML to catalogue rows."""
    acts = table(spark, sf_dir, "retrospective_store").groupBy(act_key().alias("act_id")).agg(F.min("jurabk").alias("title"))
    item = F.concat(F.lit("<item><title>"), _escaped(F.col("title")), F.lit("</title><link>https://statutes.example/"), F.col("act_id"), F.lit("/xml.zip</link></item>"))
    pages = acts.groupBy(_spread(F.col("act_id")).alias("page")).agg(F.concat(F.lit("<items>"), F.array_join(F.collect_list(item), ""), F.lit("</items>")).alias("xml"))
    return documents.parse_toc(pages, "page", "xml").select("slug", "title", "link")


@query(f"WITH {DECIDED} SELECT id AS item_id, CAST(day AS VARCHAR) AS day, 'item' AS outcome FROM dd WHERE day IS NOT NULL UNION ALL SELECT NULL, NULL, 'rejected' FROM dd WHERE day IS NULL")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS items with a readable id and day, and those without, which are counted as rejected."""
    rows = table(spark, sf_dir, "decisions").select("id", decision_day().alias("day")).distinct()
    names = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    date = F.concat(F.lit("Mon, "), F.dayofmonth("day").cast("string"), F.lit(" "), F.element_at(names, F.month("day")), F.lit(" "), F.year("day").cast("string"), F.lit(" 08:00:00 GMT"))
    link = F.when(F.col("day").isNotNull(), F.concat(F.lit("https://courts.example/d/"), F.col("id"))).otherwise("https://courts.example/")
    item = F.concat(F.lit("<item><title>t</title><guid>"), link, F.lit("</guid><pubDate>"), F.coalesce(date, F.lit("")), F.lit("</pubDate></item>"))
    feeds = rows.groupBy(_spread(F.col("id"), 3).alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    good, bad = documents.parse_feed(feeds, "feed", "xml", r"/d/(.+)$")
    shown = lambda d, outcome: d.select("item_id", F.col("day").cast("string").alias("day"), F.lit(outcome).alias("outcome"))
    return shown(good, "item").unionByName(shown(bad, "rejected"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of HTML pages to cells."""
    cell = lambda c: F.concat(F.lit("<td class='x'> <b>"), F.col(c).cast("string"), F.lit("</b>\n</td>"))
    row = F.concat(F.lit("<tr>"), cell("event_id"), cell("event_type"), cell("user_id"), F.lit("</tr>"))
    pages = table(spark, sf_dir, "events").groupBy(_spread(F.col("event_id"), 3).alias("page")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    cells = pages.select(F.explode(documents.html_rows(F.col("html"))).alias("c"))
    return cells.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("event_id", "event_type", "user_id"))))


@query("SELECT change_id, CAST(pos AS INT) AS place, trim(part) AS value FROM (SELECT change_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT DISTINCT change_id, [para, operation, source] AS parts FROM act_archive WHERE para IS NOT NULL AND operation IS NOT NULL))")
def mixed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of XML elements with mixed content, tails included."""
    rows = table(spark, sf_dir, "act_archive").where(F.col("para").isNotNull() & F.col("operation").isNotNull()).select("change_id", "para", "operation", "source").distinct()
    element = lambda c: F.concat(F.lit("<p n='1'><i>"), _escaped(F.col(c)), F.lit("</i> </p>\n"))
    xml = F.concat(F.lit("<doc>"), element("para"), element("operation"), element("source"), F.lit("</doc>"))
    return rows.select("change_id", F.posexplode(documents.mixed_text(xml, "p")).alias("place", "value"))


@query("SELECT n_nationkey // 5 AS page, n_name AS name FROM nation")
def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged interface followed by its cursor; the pages hold the nations, a fixed table of 25 rows."""
    folder = shared_folder(spark, "pages")
    nations = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    for i in range(0, len(nations), 5):
        page = {"documents": [{"name": n} for n in nations[i : i + 5]], "cursor": f"c{min(i + 5, len(nations) - 5)}"}
        documents.write_file(f"{folder}/{'start' if i == 0 else f'c{i}'}.json", json.dumps(page).encode())
    spark.dataSource.register(documents.PagedSource)
    return spark.read.format("paged").option("path", folder).load().select("page", F.get_json_object("row", "$.name").alias("name"))


@F.pandas_udf(BinaryType())
def _zipped(names: pd.Series, bodies: pd.Series) -> pd.Series:
    def one(name: str, body: str) -> bytes:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{name}.xml", body)
            z.writestr("readme.txt", "no member")
        return held.getvalue()

    return pd.Series([one(n, b) for n, b in zip(names, bodies)])


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE kind = 'decision' AND text IS NOT NULL UNION ALL SELECT -1, NULL")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The XML members of ZIP files; a file that is none has no member."""
    rows = texts(spark, sf_dir).where("kind = 'decision'").select(F.col("doc_id").cast("string").alias("path"), _zipped(F.col("doc_id").cast("string"), F.col("text")).alias("content"))
    broken = spark.createDataFrame([("-1", b"no zip")], rows.schema)
    return documents.unzip_texts(rows.unionByName(broken)).select(F.col("path").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("sha256"))


@query(f"WITH {_O} SELECT act_id AS work, CASE WHEN digest = '-' THEN 'deleted' ELSE 'changed' END AS kind, count(*) AS n FROM o GROUP BY 1, 2")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed and the deleted works of change logs."""
    logs = observations(spark, sf_dir).groupBy("observed_at", _spread(F.col("act_id")).alias("page")).agg(
        F.collect_list(F.when(F.col("digest") != "-", F.col("act_id"))).alias("changed"), F.collect_list(F.when(F.col("digest") == "-", F.col("act_id"))).alias("deleted")
    )
    return documents.changelog_events(logs, "changed", "deleted").groupBy("work", "kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 OR starts_with(o_orderpriority, '1')")
def listings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of the same things, each thing once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return documents.union_of_orders(orders.where("o_totalprice > 100000"), orders.where(F.col("o_orderpriority").startswith("1")), "o_orderkey").select("o_orderkey")


@query(
    "SELECT lower(trim(act_id)) AS act_id, max(regexp_matches(text, '(^|\n)(Artikel|§) [0-9]')) AS has_sections, CAST(arg_max(length(text), (CASE WHEN regexp_matches(text, '(^|\n)(Artikel|§) [0-9]') THEN 1000000000 ELSE 0 END) + length(text)) AS INT) AS length FROM documents WHERE act_id IS NOT NULL AND text IS NOT NULL GROUP BY 1"
)
def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the texts of an act the one with sections, then the longest."""
    best = documents.best_variant(texts(spark, sf_dir).where(F.col("act_id").isNotNull()).select(act_key().alias("act_id"), "text"), "act_id", "text")
    return best.select("act_id", F.col("text").rlike(r"(?m)^(?:Artikel|§) \d").alias("has_sections"), F.length("text").alias("length"))


@query(
    f"""WITH {_A} SELECT act_id, CAST(arg_min(published_at, assertion_id) FILTER (WHERE published_at >= DATE '1900-01-01') AS VARCHAR) AS published_at, arg_min(previous_state_sha256, assertion_id) FILTER (WHERE previous_state_sha256 IS NOT NULL) AS previous_state_sha256 FROM a GROUP BY 1"""
)
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each column that is not null, placeholder days left out."""
    rows = documents.first_value(assertions(spark, sf_dir), "act_id", "assertion_id", ["published_at", "previous_state_sha256"], "published_at")
    return rows.withColumn("published_at", F.col("published_at").cast("string"))


@query("SELECT id, CAST(place AS INT) AS place, CAST(len(paras) AS INT) AS n, array_to_string(paras, '|') AS listed FROM (SELECT id, e.paras AS paras, place FROM (SELECT id, unnest(effects) AS e, generate_subscripts(effects, 1) - 1 AS place FROM (SELECT DISTINCT id, effects FROM decisions)) WHERE e IS NOT NULL) WHERE len(paras) > 0 AND len([p FOR p IN paras IF p IS NULL]) = 0")
def listed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values that are one thing or a list of things, as lists."""
    whole = lambda p: (F.size(p) > 0) & ~F.exists(p, lambda x: x.isNull())
    rows = table(spark, sf_dir, "decisions").select("id", "effects").distinct().select("id", F.posexplode("effects").alias("place", "e")).select("id", "place", F.col("e.paras").alias("paras")).where(whole(F.col("paras")))
    # A list of one is written as the one thing.
    written = F.when(F.size("paras") == 1, F.substring(F.to_json("paras"), F.lit(2), F.length(F.to_json("paras")) - 2)).otherwise(F.to_json("paras"))
    return rows.select("id", "place", documents.listed(written).alias("l")).select("id", "place", F.size("l").alias("n"), F.array_join("l", "|").alias("listed"))


@query(
    f"""WITH {_O}, {_A} SELECT 'acts' AS name, count(*) AS n FROM (SELECT act_id FROM o UNION SELECT act_id FROM a) UNION ALL SELECT 'state_observations', count(*) FROM o UNION ALL SELECT 'state_objects', count(DISTINCT digest) FROM o UNION ALL SELECT 'legal_intervals', count(*) FROM (SELECT DISTINCT act_id, assertion_id, effective_from, effective_to, knowledge_from, knowledge_to FROM a)"""
)
def relational_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bitemporal tables as keyed Parquet with checked references, read back and counted."""
    seen = observations(spark, sf_dir)
    known = assertions(spark, sf_dir).select("act_id", "assertion_id", "effective_from", "effective_to", "knowledge_from", "knowledge_to").distinct()
    known = known.withColumn("interval_id", F.sha2(F.to_json(F.struct(*known.columns)), 256))
    tables = {
        "acts": seen.select("act_id").unionByName(known.select("act_id")).distinct(), "state_objects": seen.select("digest").distinct(), "state_observations": seen, "legal_intervals": known,
    }
    keys = {"acts": ["act_id"], "state_objects": ["digest"], "state_observations": ["act_id", "observed_at"], "legal_intervals": ["interval_id"]}
    references = [("state_observations", "act_id", "acts", "act_id"), ("legal_intervals", "act_id", "acts", "act_id"), ("state_observations", "digest", "state_objects", "digest")]
    path = shared_folder(spark, "export")
    sinks.write_relational(tables, path, keys, references)
    counts = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in tables]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_CITE = extract.CITATION.replace("'", "''")


@query(
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CITE}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_CITE}'), 1) - 1 AS place FROM documents WHERE text IS NOT NULL)
SELECT row_number() OVER (ORDER BY doc_id, place) - 1 AS ordinal, doc_id, CAST(place AS INT) AS place, raw FROM c"""
)
def ordinal_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations with a dense ordinal, written once and read back."""
    path = shared_folder(spark, "citations")
    sinks.write_ordinal(extract.citations(texts(spark, sf_dir), "doc_id", "text").select("doc_id", "place", "raw"), path, ["doc_id", "place"])
    return spark.read.parquet(path).select(F.col("ordinal").cast("bigint").alias("ordinal"), "doc_id", "place", "raw")


@query("SELECT DISTINCT change_id, lower(trim(act_id)) AS act_id, sha256(new_text) AS sha256 FROM act_archive WHERE para IS NOT NULL")
def dataset_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows as JSON lines, read back; rows without a section are not exported, and unreviewed ones stop the export."""
    rows = table(spark, sf_dir, "act_archive").select("change_id", act_key().alias("act_id"), "para", "new_text").distinct()
    reviewed, path = rows.where(F.col("para").isNotNull()), shared_folder(spark, "dataset")
    sinks.export_dataset({"history": reviewed.select("change_id", "act_id", "new_text")}, path, public=True, reviewed={"history": reviewed.where(F.col("para").isNull())})
    back = snapshots.read_jsonl_strict(spark, f"{path}/history", StructType.fromDDL("change_id bigint, act_id string, new_text string"))
    return back.select("change_id", "act_id", F.sha2("new_text", 256).alias("sha256")).distinct()


@query("SELECT DISTINCT change_id, para AS title, CAST(effective_date AS VARCHAR) AS published, md5(new_text) AS md5, true AS verified FROM act_archive WHERE para IS NOT NULL AND effective_date IS NOT NULL AND new_text IS NOT NULL")
def official_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that advertise a title, a day and the MD5 of their file, which is checked against the file."""
    rows = table(spark, sf_dir, "act_archive").select("change_id", "para", "effective_date", "new_text").dropna().distinct()
    head = F.concat(F.lit('<html><meta name="title" content="'), _escaped(F.col("para")), F.lit('"><meta name="date" content="'), F.col("effective_date").cast("string"), F.lit('">'))
    page = F.concat(head, F.lit("<p>File (PDF), MD5: "), F.upper(F.md5("new_text")), F.lit("</p></html>"))
    said = rows.select("change_id", "new_text", documents.official_page(page).alias("p"))
    return said.select("change_id", "p.title", F.col("p.published").cast("string").alias("published"), "p.md5", (F.col("p.md5") == F.md5("new_text")).alias("verified"))


@query("SELECT DISTINCT id, coalesce(regexp_replace(trim(stage), '[ \t\n\r]+', ' ', 'g'), '') AS stage, source FROM procedure_watch_history WHERE regexp_full_match(coalesce(stage, ''), '[ -~äöüÄÖÜß]*') AND NOT regexp_matches(coalesce(stage, ''), '[<>&]')")
def register_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register pages of terms and descriptions to evidence rows."""
    rows = table(spark, sf_dir, "procedure_watch_history").select("id", F.coalesce("stage", F.lit("")).alias("stage"), "source").where(F.col("stage").rlike(r"^[ -~äöüÄÖÜß]*$") & ~F.col("stage").rlike("[<>&]"))
    item = lambda name, c: F.concat(F.lit(f"<dt>{name}</dt>\n<dd class='v'> <b>"), F.col(c), F.lit("</b> </dd>"))
    page = F.concat(F.lit("<dl><dt>Stage</dt><dd>old</dd>"), item("Number", "id"), item("Stage", "stage"), item("Source", "source"), F.lit("</dl>"))
    entries = rows.select(documents.register_entries(page).alias("e"))
    return entries.select(F.col("e")["Number"].alias("id"), F.col("e")["Stage"].alias("stage"), F.col("e")["Source"].alias("source")).distinct()


@query(f"WITH {_V} SELECT 'v-' || substr(sha256(a), 1, 16) AS src, 'v-' || substr(sha256(b), 1, 16) AS dst, kind, n FROM e")
def arena_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges as blobs of aligned binary records, written, read back and unpacked."""
    path = shared_folder(spark, "arena")
    arena.blobs(graph_tables(spark, sf_dir)[1]).write.parquet(path)
    return arena.edges_of(spark.read.parquet(path)).select("src", "dst", "kind", "n")
