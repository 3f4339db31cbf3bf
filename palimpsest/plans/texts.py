"""Text functions, extraction and citation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import extract
from palimpsest.plans.found import act_key
from palimpsest.plans.registry import Register
from palimpsest.session import table

register = Register()
query = register.query

# White space as Java's (?U)\s has it.
_WHITE = r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CITE = extract.CITATION.replace("'", "''")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull())


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, trim(regexp_replace(p_type, '[ \\t]+', ' ', 'g')) AS kind FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slugs and squeezed labels."""
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.squeeze(F.col("p_type")).alias("kind"))


@query(
    """WITH p AS (SELECT DISTINCT para FROM act_archive WHERE para IS NOT NULL),
n AS (SELECT para, CASE WHEN regexp_matches(para, '^\\s*§') THEN 'para' WHEN regexp_matches(para, '(?i)^\\s*art(ikel|icle)?\\b') THEN 'art' END AS kind, lower(regexp_replace(regexp_extract(para, '([0-9]+\\s*[A-Za-z]?)([^A-Za-z]|$)', 1), '\\s', '', 'g')) AS number FROM p)
SELECT para, kind, number FROM n WHERE number <> ''"""
)
def norm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind and number of section labels."""
    rows = table(spark, sf_dir, "act_archive").select("para").where(F.col("para").isNotNull()).distinct()
    return rows.withColumn("n", T.norm_label(F.col("para"))).where(F.col("n").isNotNull()).select("para", "n.kind", "n.number")


@query(
    f"""WITH b AS (SELECT DISTINCT jurabk, trim(regexp_replace(lower(jurabk), '\\s+', ' ', 'g')) AS w FROM retrospective_store), c AS (SELECT jurabk, w, regexp_replace(w, '(.) ((1[89]|2[01])[0-9]{{2}}|2200)$', '\\1') AS bare FROM b),
r AS (SELECT [{", ".join(f"'{T.roman(n)}'" for n in range(1, 51))}] AS numerals), x AS (SELECT jurabk, numerals, unnest(list_distinct([w, bare])) AS t FROM c, r), y AS (SELECT jurabk, numerals, t, string_split(t, ' ') AS words FROM x),
z AS (SELECT jurabk, unnest([t] || [array_to_string([CASE WHEN j = i THEN numerals[CAST(words[j] AS INT)] ELSE words[j] END FOR j IN generate_series(1, len(words))], ' ') FOR i IN generate_series(1, len(words)) IF regexp_full_match(words[i], '[1-9]|[1-4][0-9]|50')]) AS alias FROM y)
SELECT jurabk, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM z GROUP BY 1"""
)
def book_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed alias expansion of abbreviations."""
    rows = table(spark, sf_dir, "retrospective_store").select("jurabk").distinct()
    return rows.select("jurabk", F.array_join(F.array_sort(T.book_aliases(F.col("jurabk"))), ",").alias("aliases"))


@query()
def norm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folded texts by digest (Unicode normalisation has no SQL counterpart; tested against unicodedata)."""
    rows = texts(spark, sf_dir).select("doc_id", "text")
    return rows.select("doc_id", F.sha2(T.search_fold(F.col("text")), 256).alias("search"), F.sha2(T.legal_name(F.col("text")), 256).alias("legal"), F.sha2(T.match_text(F.col("text")), 256).alias("match"))


@query(
    """SELECT o_orderkey, day(o_orderdate) || '. ' || ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'][month(o_orderdate)] || ' ' || year(o_orderdate) AS day, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS tick FROM orders"""
)
def german_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """localised days and month numbers."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.german_date(day).alias("day"), (F.year(day) * 12 + F.month(day) - 1).cast("bigint").alias("tick"))


@query(
    """WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)<br\\s*/?>|</p>', '\n', 'g'), '<[^<>]*>', '', 'g') AS t FROM documents WHERE text LIKE '%<%'),
e AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&sect;', '§'), '&auml;', 'ä'), '&ouml;', 'ö'), '&uuml;', 'ü'), '&Auml;', 'Ä'), '&Ouml;', 'Ö'), '&Uuml;', 'Ü'), '&szlig;', 'ß'), '&amp;', '&') AS t FROM h)
SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS body FROM e"""
)
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text of HTML fragments, by digest."""
    return texts(spark, sf_dir).where(F.col("text").contains("<")).select("doc_id", F.sha2(T.html_text(F.col("text")), 256).alias("body"))


@query(
    f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{_WHITE}', ' ', 'g')) AS v FROM documents WHERE text IS NOT NULL), p AS (SELECT *, instr(lower(v), 'behörde') AS i FROM t), e AS (SELECT *, least(length(v), greatest(0, i - 1 + 3 - 130) + 260) AS z FROM p),
s AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE greatest(0, z - 260) END AS a FROM e)
SELECT doc_id, CASE WHEN a > 0 THEN '… ' ELSE '' END || trim(substr(v, a + 1, 260)) || CASE WHEN least(length(v), a + 260) < length(v) THEN ' …' ELSE '' END AS snippet FROM s"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """windows around a term."""
    return texts(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), ["behörde"]).alias("snippet"))


@query()
def paragraph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numbered paragraphs of each text with their places and sentences."""
    rows = texts(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("place", "p"))
    return rows.select("doc_id", "place", "p.number", "p.start", "p.end", "p.sentences")


@query(
    """WITH c AS (SELECT DISTINCT change_id, new_text AS t FROM act_archive WHERE new_text IS NOT NULL), x AS (SELECT change_id, unnest(regexp_extract_all(t, 'Absätze [0-9]+ bis [0-9]+')) AS raw, generate_subscripts(regexp_extract_all(t, 'Absätze [0-9]+ bis [0-9]+'), 1) - 1 AS place FROM c),
n AS (SELECT change_id, place, CAST(regexp_extract(raw, 'Absätze ([0-9]+) bis ([0-9]+)', 1) AS INT) AS low, CAST(regexp_extract(raw, 'Absätze ([0-9]+) bis ([0-9]+)', 2) AS INT) AS high FROM x)
SELECT change_id, CAST(place AS INT) AS place, low, high, CASE WHEN low > high THEN 'range_order_invalid' WHEN high - low + 1 > 50 THEN 'range_too_broad' END AS reason, CASE WHEN low > high OR high - low + 1 > 50 THEN 0 ELSE high - low + 1 END AS members FROM n"""
)
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of paragraphs with their cap and failure reasons."""
    rows = table(spark, sf_dir, "act_archive").where(F.col("new_text").isNotNull()).select("change_id", "new_text").distinct()
    return extract.ranges(rows, "change_id", "new_text", "Absätze", 50).select("change_id", "place", "low", "high", "reason", F.size("targets").alias("members"))


@query(
    """WITH d AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS line FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, unnest(regexp_extract_all(line, 'In § [0-9]+[a-z]? Absatz [0-9]+ wird das Wort „[^“]+“ durch das Wort „[^“]+“ ersetzt\\.')) AS raw FROM d)
SELECT doc_id, regexp_extract(raw, '§ ([0-9]+[a-z]?)', 1) AS para, regexp_extract(raw, 'Absatz ([0-9]+)', 1) AS absatz, regexp_extract(raw, '„([^“]+)“ durch', 1) AS old_text, regexp_extract(raw, 'durch das Wort „([^“]+)“', 1) AS new_text, count(*) AS n FROM q GROUP BY ALL"""
)
def replace_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word replacements with their address and wording."""
    rows = texts(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"In § \d+[a-z]? Absatz \d+ wird das Wort „[^“\n]+“ durch das Wort „[^“\n]+“ ersetzt\."), F.lit(0))).alias("raw"))
    parts = rows.select("doc_id", extract.leaf_command(F.col("raw")).alias("c")).where(F.col("c").isNotNull())
    return parts.select("doc_id", "c.para", "c.absatz", F.col("c.old").alias("old_text"), F.col("c.new").alias("new_text")).groupBy("doc_id", "para", "absatz", "old_text", "new_text").agg(F.count("*").alias("n"))


@query()
def amendment_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commands of the amending texts with operation and address."""
    rows = extract.commands(texts(spark, sf_dir).where("kind = 'amendment'"), "doc_id", "text")
    return rows.select("doc_id", "place", "raw_sha256", "operation", "address.para", "address.absatz", "address.satz", "address.nummer", "old_text", "new_text")


@query(
    """SELECT operation, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, '(wird|werden) wie folgt (geändert|gefasst)|erhält folgende Fassung') THEN 'modify' WHEN regexp_matches(t, '(wird|werden) .{0,200}durch .{0,200}ersetzt') THEN 'replace' WHEN regexp_matches(t, '(wird|werden) aufgehoben|treten? außer Kraft|entfällt') THEN 'repeal'
WHEN regexp_matches(t, '(wird|werden) .{0,120}gestrichen') THEN 'delete' WHEN regexp_matches(t, '(wird|werden) .{0,200}(eingefügt|angefügt|vorangestellt)') THEN 'insert' WHEN regexp_matches(t, 'bisherige[nr]? .{1,80} (wird|werden) ') THEN 'renumber' ELSE 'other' END AS operation FROM (SELECT DISTINCT change_id, new_text AS t FROM act_archive WHERE new_text IS NOT NULL)) GROUP BY 1"""
)
def operation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by the operation that their wording states first."""
    rows = table(spark, sf_dir, "act_archive").where(F.col("new_text").isNotNull()).select("change_id", "new_text").distinct()
    return rows.groupBy(extract.operation(F.col("new_text")).alias("operation")).agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT doc_id, kind, regexp_extract(text, '^(Artikel|Article) ([0-9]+[a-z]?)\n', 2) AS article, text FROM documents WHERE kind = 'amendment' AND text IS NOT NULL)
SELECT doc_id, article, regexp_matches(text, 'gilt ab dem Tag, der auf seine Bekanntgabe folgt|applies from the day after it is made public|(tritt|treten) am Tag nach der Verkündung in Kraft') AS after_promulgation FROM a WHERE article <> ''"""
)
def articles_and_commencement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading article and commencement of amending texts."""
    rows = extract.articles(texts(spark, sf_dir).where("kind = 'amendment'"), "doc_id", "text").where("place = 0 OR article IS NOT NULL")
    first = rows.where(F.col("article").isNotNull()).groupBy("doc_id").agg(F.min_by("article", "place").alias("article"), F.bool_or(extract.commencement(F.col("body"))["kind"] == "after_promulgation").alias("after_promulgation"))
    return first


@query(
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CITE}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_CITE}'), 1) - 1 AS place FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(place AS INT) AS place, nullif(regexp_extract(raw, '{_CITE}', 1), '') AS norm, nullif(regexp_extract(raw, '{_CITE}', 2), '') AS absatz, nullif(regexp_extract(raw, '{_CITE}', 3), '') AS satz, nullif(regexp_extract(raw, '{_CITE}', 4), '') AS nummer FROM c"""
)
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation of a section with its pinpoint."""
    return extract.citations(texts(spark, sf_dir), "doc_id", "text").drop("raw")


@query(
    f"""WITH c AS (SELECT doc_id, act_id, unnest(regexp_extract_all(text, '{_CITE}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_CITE}'), 1) - 1 AS place FROM documents WHERE text IS NOT NULL AND act_id IS NOT NULL),
e AS (SELECT *, lower(trim(act_id)) AS act, regexp_extract(raw, '{_CITE}', 1) AS norm, doc_id * 1000000 + place AS ordinal FROM c)
SELECT act AS act_id, norm, count(*) AS occurrence_count, count(DISTINCT doc_id) AS texts, arg_min(raw, ordinal) AS excerpt FROM e GROUP BY 1, 2"""
)
def citation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations per target with counts and the first excerpt."""
    rows = texts(spark, sf_dir).where(F.col("act_id").isNotNull())
    acts = rows.select("doc_id", act_key().alias("act_id"))
    edges = extract.citations(rows, "doc_id", "text").join(acts, "doc_id").withColumn("ordinal", F.col("doc_id") * 1000000 + F.col("place"))
    rolled = edges.groupBy("act_id", "norm").agg(F.count("*").alias("occurrence_count"), F.count_distinct("doc_id").alias("texts"), F.min_by("raw", "ordinal").alias("excerpt"))
    return rolled


@query(
    f"""WITH n AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, regexp_extract(para, '([0-9]+[a-z]?)', 1) AS norm FROM act_archive WHERE para IS NOT NULL), c AS (SELECT doc_id, lower(trim(act_id)) AS act_id, unnest(regexp_extract_all(text, '{_CITE}')) AS raw FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT doc_id, act_id, regexp_extract(raw, '{_CITE}', 1) AS norm FROM c)
SELECT CASE WHEN e.act_id IS NULL THEN 'target_act_unnamed' WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.act_id = e.act_id) THEN 'target_act_not_in_current_corpus' WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.act_id = e.act_id AND n.norm = e.norm) THEN 'target_norm_not_in_current_corpus' ELSE 'resolved' END AS reason, count(*) AS n FROM e GROUP BY 1"""
)
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by whether and why their targets resolve."""
    norms = table(spark, sf_dir, "act_archive").where(F.col("para").isNotNull()).select(act_key().alias("act_id"), F.regexp_extract("para", r"(\d+[a-z]?)", 1).alias("norm")).distinct()
    acts = texts(spark, sf_dir).select("doc_id", act_key().alias("act_id"))
    edges = extract.citations(texts(spark, sf_dir), "doc_id", "text").select("doc_id", "norm").distinct().join(acts, "doc_id")
    return extract.resolve_targets(edges, norms, "act_id", "norm").groupBy(F.coalesce("reason", F.lit("resolved")).alias("reason")).agg(F.count("*").alias("n"))


def _norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(act_id, kind, norm) of the sections that the archive knows."""
    label = T.norm_label(F.col("para"))
    rows = table(spark, sf_dir, "act_archive").where(F.col("para").isNotNull()).select(act_key().alias("act_id"), label.alias("n"))
    return rows.select("act_id", "n.kind", F.col("n.number").alias("norm")).where(F.col("norm").isNotNull() & F.col("kind").isNotNull()).distinct()


@query(
    r"""WITH n AS (SELECT DISTINCT lower(trim(act_id)) AS act_id, CASE WHEN para LIKE '§%' THEN 'para' ELSE 'art' END AS kind, lower(regexp_extract(para, '([0-9]+[a-z]?)', 1)) AS norm FROM act_archive WHERE para IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY act_id, kind ORDER BY CAST(regexp_extract(norm, '^([0-9]+)', 1) AS INT), regexp_replace(norm, '^[0-9]+', '')) AS p FROM n), g AS (SELECT lower(jurabk) AS alias, count(DISTINCT lower(trim(act_id))) AS acts, min(lower(trim(act_id))) AS act_id FROM retrospective_store GROUP BY 1),
e AS (SELECT id, place, e.act_id AS cited, lower(e.jurabk) AS alias, CASE WHEN starts_with(e.act_id, 'by_') THEN 'art' ELSE 'para' END AS kind, [p FOR p IN coalesce(e.paras, []) IF p IS NOT NULL] AS paras FROM (SELECT id, unnest(effects) AS e, generate_subscripts(effects, 1) - 1 AS place FROM (SELECT DISTINCT id, effects FROM decisions)) WHERE e IS NOT NULL AND e.jurabk IS NOT NULL AND e.act_id IS NOT NULL),
m AS (SELECT id, place, alias, kind, unnest(paras) AS low, generate_subscripts(paras, 1) - 1 AS item, NULL AS high FROM e WHERE len(paras) > 0 UNION ALL SELECT id, place, alias, kind, paras[1], 0, paras[-1] FROM e WHERE len(paras) > 2),
r AS (SELECT m.*, g.act_id, CASE WHEN g.acts IS NULL THEN 'target_act_not_in_current_corpus' WHEN g.acts > 1 THEN 'ambiguous_explicit_alias' WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.act_id = g.act_id AND n.kind = m.kind) THEN 'unqualified_foreign_marker' WHEN m.high IS NULL AND a.p IS NULL THEN 'target_norm_not_in_current_corpus'
  WHEN m.high IS NOT NULL AND (a.p IS NULL OR z.p IS NULL) THEN 'range_endpoint_not_in_current_corpus' WHEN m.high IS NOT NULL AND a.p > z.p THEN 'range_order_invalid' WHEN m.high IS NOT NULL AND z.p - a.p >= 200 THEN 'range_too_broad' END AS reason, CASE WHEN m.high IS NULL THEN 1 ELSE z.p - a.p + 1 END AS n
  FROM m LEFT JOIN g ON g.alias = m.alias LEFT JOIN q a ON a.act_id = g.act_id AND a.kind = m.kind AND a.norm = m.low LEFT JOIN q z ON z.act_id = g.act_id AND z.kind = m.kind AND z.norm = m.high)
SELECT id, CAST(place AS INT) AS effect, CAST(item AS INT) AS item, low, high, CASE WHEN reason IS NULL OR reason NOT IN ('target_act_not_in_current_corpus', 'ambiguous_explicit_alias') THEN act_id END AS act_id, reason, CASE WHEN reason IS NULL THEN CAST(n AS INT) END AS targets FROM r"""
)
def citation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with shared markers, lists and ranges and the attached name of their act, resolved to sections.

    The sentences are written from the decisions' effects: '§§ 3, 5a und 7 des BirkenG 000K', and first and last of three or more as a range.
    """
    effects = table(spark, sf_dir, "decisions").select("id", "effects").distinct().select("id", F.posexplode("effects").alias("effect", "e"))
    effects = effects.where(F.col("e.jurabk").isNotNull() & F.col("e.act_id").isNotNull()).select("id", "effect", "e.act_id", "e.jurabk", F.array_compact("e.paras").alias("p")).where(F.size("p") > 0)
    marker = F.when(F.col("act_id").startswith("by_"), "Art. ").otherwise("§§ ")
    listed = F.when(F.size("p") > 1, F.concat(F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), ", "), F.lit(" und "), F.element_at("p", -1))).otherwise(F.element_at("p", 1))
    ranged = F.when(F.size("p") > 2, F.concat(F.lit(" Unberührt bleiben "), marker, F.element_at("p", 1), F.lit(" bis "), F.element_at("p", -1), F.lit(" ("), F.col("jurabk"), F.lit(").")))
    sentence = F.concat(F.lit("Nach "), marker, listed, F.lit(" des "), F.col("jurabk"), F.lit(" gilt dies."), F.coalesce(ranged, F.lit("")))
    members = extract.citation_members(effects.select(F.concat_ws("|", "id", "effect").alias("key"), sentence.alias("text")), "key", "text")
    registry = table(spark, sf_dir, "retrospective_store").select(F.lower("jurabk").alias("alias"), act_key().alias("act_id")).distinct()
    found = extract.resolve_members(members, registry, _norms(spark, sf_dir), "key")
    return found.select(F.substring_index("key", "|", 1).alias("id"), F.substring_index("key", "|", -1).cast("int").alias("effect"), "item", "low", "high", "act_id", "reason", F.size("targets").alias("targets")).withColumn("targets", F.when(F.col("reason").isNull(), F.col("targets")))


@query()
def citation_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citations of all texts; without an attached name they mean the text's own act, if it has such sections (tested on cases)."""
    rows = texts(spark, sf_dir).select("doc_id", "text")
    own = texts(spark, sf_dir).select("doc_id", act_key().alias("own"))
    members = extract.citation_members(rows, "doc_id", "text").join(own, "doc_id")
    registry = table(spark, sf_dir, "retrospective_store").select(F.lower("jurabk").alias("alias"), act_key().alias("act_id")).distinct()
    found = extract.resolve_members(members, registry, _norms(spark, sf_dir), "doc_id", own="own")
    return found.groupBy("act_id", "kind", F.coalesce("reason", F.lit("resolved")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("texts"))


@query(
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CITE}')) AS raw FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS n FROM c WHERE regexp_extract(raw, '{_CITE}', 1) = '12' GROUP BY 1"""
)
def link_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that cite one section."""
    return extract.citations(texts(spark, sf_dir), "doc_id", "text").where("norm = '12'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(Drs\\.|Drucksache) ([0-9]{1,3}/[0-9]{1,5})', 2))), ',') AS papers FROM documents WHERE regexp_matches(text, '(Drs\\.|Drucksache) [0-9]')"""
)
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed papers named in a text."""
    return texts(spark, sf_dir).where(F.col("text").rlike(r"(?:Drs\.|Drucksache) \d")).select("doc_id", F.array_join(F.array_sort(extract.document_numbers(F.col("text"))), ",").alias("papers"))


@query()
def inserted_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long phrases that only the new wording of a change has (Ratcliff-Obershelp, no SQL counterpart)."""
    rows = table(spark, sf_dir, "act_archive").where(F.col("new_text").isNotNull()).select("change_id", "old_text", "new_text").distinct()
    found = rows.select("change_id", extract.inserted_phrases(F.col("old_text"), F.col("new_text")).alias("phrases"))
    return found.where(F.size("phrases") > 0).select("change_id", F.size("phrases").alias("n"), F.array_join("phrases", " | ").alias("phrases"))


@query(
    """WITH c AS (SELECT l_orderkey AS document, CASE WHEN l_linenumber = 1 THEN 'A1' ELSE 'A2' END AS scope, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity > 40 THEN 'narrowed' WHEN l_linenumber = 1 THEN 'whole' WHEN l_returnflag = 'N' THEN 'default' ELSE 'remainder' END AS mode, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem),
g AS (SELECT document, bool_or(scope = 'A1' AND mode = 'narrowed') AS narrowed, count(DISTINCT CASE WHEN scope = 'A1' AND mode = 'whole' THEN day END) AS s, min(CASE WHEN scope = 'A1' AND mode = 'whole' THEN day END) AS sd, count(DISTINCT CASE WHEN mode IN ('default', 'remainder') THEN day END) AS g, min(CASE WHEN mode IN ('default', 'remainder') THEN day END) AS gd, bool_or(mode = 'default') AS d FROM c GROUP BY 1)
SELECT document, CASE WHEN narrowed THEN 'unresolved_sub_article_scope' WHEN s = 1 THEN 'resolved_explicit_article_clause' WHEN s > 1 THEN 'unresolved_conflicting_article_clauses' WHEN g = 1 AND d THEN 'resolved_default_clause' WHEN g = 1 THEN 'resolved_remainder_clause' WHEN g > 1 THEN 'unresolved_conflicting_default_clauses' ELSE 'unresolved_no_article_wide_clause' END AS status,
CASE WHEN narrowed THEN NULL WHEN s = 1 THEN sd WHEN s = 0 AND g = 1 THEN gd END AS effective_at FROM g"""
)
def effective_date_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of one article from scoped, narrowed, default and remainder clauses."""
    first = F.col("l_linenumber") == 1
    mode = F.when((F.col("l_returnflag") == "R") & first & (F.col("l_quantity") > 40), "narrowed").when(first, "whole").when(F.col("l_returnflag") == "N", "default").otherwise("remainder")
    clauses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.when(first, "A1").otherwise("A2").alias("scope"), mode.alias("mode"), F.col("l_shipdate").cast("date").cast("string").alias("day"))
    return extract.resolve_effective_date(clauses, "A1")


_CLAUSES = ["", "im Übrigen", "Artikel 1 und 2", "Artikel 2, 3 und 1 Nr. 4", "Artikel 5 bis 7, 1 Nr. 2"]


@query(
    """WITH c AS (SELECT DISTINCT lower(trim(act_id)) AS document, CAST(regexp_extract(assertion_id, '([0-9]+)$', 1) AS INT) % 5 AS k, CAST(effective_from AS VARCHAR) AS day FROM retrospective_store WHERE effective_from IS NOT NULL),
g AS (SELECT document, bool_or(k >= 3) AS narrowed, count(DISTINCT CASE WHEN k = 2 THEN day END) AS s, min(CASE WHEN k = 2 THEN day END) AS sd, count(DISTINCT CASE WHEN k < 2 THEN day END) AS g, min(CASE WHEN k < 2 THEN day END) AS gd, bool_or(k = 0) AS d FROM c GROUP BY 1)
SELECT document, CASE WHEN narrowed THEN 'unresolved_sub_article_scope' WHEN s = 1 THEN 'resolved_explicit_article_clause' WHEN s > 1 THEN 'unresolved_conflicting_article_clauses' WHEN g = 1 AND d THEN 'resolved_default_clause' WHEN g = 1 THEN 'resolved_remainder_clause' WHEN g > 1 THEN 'unresolved_conflicting_default_clauses' ELSE 'unresolved_no_article_wide_clause' END AS status,
CASE WHEN narrowed THEN NULL WHEN s = 1 THEN sd WHEN s = 0 AND g = 1 THEN gd END AS effective_at FROM g"""
)
def commencement_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of article 1 from the wording of clauses; the clauses are written beside the store's days, one of five a row."""
    number = F.regexp_extract("assertion_id", r"(\d+)$", 1).cast("int") % 5
    wording = F.element_at(F.array(*map(F.lit, _CLAUSES)), number + 1)
    rows = table(spark, sf_dir, "retrospective_store").where(F.col("effective_from").isNotNull())
    clauses = rows.select(act_key().alias("document"), F.col("effective_from").cast("string").alias("day"), wording.alias("explanation")).distinct()
    return extract.resolve_effective_date(extract.clause_modes(clauses, "document", "day", "explanation", "1"), "1")


@query(
    """WITH l AS (SELECT o_orderkey, list(l_linenumber ORDER BY l_partkey, l_suppkey, l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CAST(list_reduce(list_prepend(0, [CAST(x AS INT) FOR x IN n]), lambda a, x: CASE WHEN x = a + 1 THEN x ELSE a END) AS INT) AS accepted FROM l"""
)
def sequence_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List markers that continue their sequence, the rest ignored."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))).alias("x"))
    numbers = F.transform("x", lambda s: s["l_linenumber"].cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey").select("o_orderkey", F.size(extract.in_sequence(numbers)).alias("accepted"))
