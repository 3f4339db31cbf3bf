"""Search queries (R family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.plans.found import act_key
from palimpsest.plans.registry import Register
from palimpsest.session import table

register = Register()
query = register.query

_WORDS = "[w FOR w IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF w <> '']"
_POST = f"p AS (SELECT doc, token, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_WORDS}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2)"


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the documents."""
    texts = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    return search.postings(texts, "doc_id", ["text"]), texts.select(F.col("doc_id").alias("doc"), F.size(search.words(F.col("text"))).alias("length"))


@query(f"WITH {_POST} SELECT token, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY 1")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the index: document and collection frequencies."""
    return index(spark, sf_dir)[0].groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


_BM25 = f"""WITH {_POST}, l AS (SELECT doc_id AS doc, len({_WORDS}) AS length FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(length) AS av FROM l),
h AS (SELECT doc, CASE WHEN starts_with(token, 'behörde') THEN 'behörde' WHEN starts_with(token, 'antrag') THEN 'antrag' END AS q, tf FROM p WHERE starts_with(token, 'behörde') OR starts_with(token, 'antrag')),
g AS (SELECT doc, q, sum(tf) AS tf FROM h GROUP BY 1, 2), d AS (SELECT q, count(*) AS df FROM g GROUP BY 1),
r AS (SELECT g.doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / av))) AS score, count(*) AS found FROM g JOIN d USING (q) JOIN l USING (doc), s GROUP BY 1)"""


@query(_BM25 + " SELECT doc AS doc_id, round(score, 4) AS score FROM r WHERE found = 2 ORDER BY round(score, 6) DESC, doc LIMIT 100")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best texts for two prefixes by BM25."""
    postings, lengths = index(spark, sf_dir)
    n, average = lengths.agg(F.count("*"), F.avg("length")).first()
    scores = search.bm25(postings, search.compile_query("Behörde Antrag"), n, average or 1.0, lengths)
    return search.top(scores, 100).select(F.col("doc").alias("doc_id"), F.round("score", 4).alias("score"))


@query(
    _BM25
    + """, c AS (SELECT doc, score FROM r WHERE found = 2 ORDER BY round(score, 6) DESC, doc LIMIT 500), f AS (SELECT doc_id, round(score, 4) AS score, lower(coalesce(kind, '')) AS kind, lower(coalesce(act_id, '')) AS act, lower(coalesce(text, '')) AS body FROM c JOIN documents ON doc_id = doc)
SELECT doc_id, score, CAST(CASE WHEN contains(body, 'behörde') OR contains(body, 'antrag') THEN 20 ELSE 0 END + CASE WHEN contains(body, 'behörde antrag') THEN 40 ELSE 0 END AS DOUBLE) AS relevance FROM f"""
)
def search_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate window, re-ranked by the fields that match."""
    postings, lengths = index(spark, sf_dir)
    n, average = lengths.agg(F.count("*"), F.avg("length")).first()
    compiled = search.compile_query("Behörde Antrag")
    window = search.top(search.bm25(postings, compiled, n, average or 1.0, lengths), search.candidate_window(25))
    rows = window.join(table(spark, sf_dir, "documents"), F.col("doc") == F.col("doc_id"))
    ranked = search.rerank(rows, compiled, "Behörde Antrag", {"text": 20.0, "kind": 5.0, "act_id": 24.0})
    return ranked.select("doc_id", F.round("score", 4).alias("score"), "relevance")


@query(
    """WITH s AS (SELECT p_partkey, lower(p_type) AS o, lower(p_brand) AS a, lower(p_name) AS t, p_size < 5 AS cur, regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+') AS bag FROM part),
r AS (SELECT *, CASE WHEN a = 'blue bo' THEN 1100 WHEN o = 'blue bo' THEN 1050 WHEN t = 'blue bo' THEN 1000 WHEN starts_with(a, 'blue bo') OR starts_with(o, 'blue bo') THEN 900 WHEN starts_with(t, 'blue bo') THEN 850 WHEN contains(t, 'blue bo') THEN 760
  WHEN (list_contains(bag, 'blue') OR len([w FOR w IN bag IF starts_with(w, 'blue')]) > 0) AND list_contains(bag, 'bo') THEN 600 + 20 * (CASE WHEN list_contains(bag, 'blue') THEN 1 ELSE 0 END + CASE WHEN list_contains(bag, 'bo') THEN 1 ELSE 0 END) END + CASE WHEN cur THEN 15 ELSE 0 END AS score FROM s)
SELECT p_partkey, score FROM r WHERE score IS NOT NULL ORDER BY score DESC, length(t), t, p_partkey LIMIT 200"""
)
def catalog_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows by the score ladder, ties by title length, title and id."""
    rows = table(spark, sf_dir, "part").withColumn("score", search.catalogue_score(F.col("p_brand"), F.col("p_name"), "blue bo", F.col("p_size") < 5, F.array("p_type"))).where(F.col("score").isNotNull())
    return rows.orderBy(F.desc("score"), F.length("p_name"), F.lower("p_name"), "p_partkey").limit(200).select("p_partkey", "score")


@query(
    """WITH n AS (SELECT DISTINCT lower(trim(jurabk)) AS t, lower(trim(act_id)) AS act_id FROM retrospective_store) SELECT act_id FROM n WHERE contains(t, 'burgg') """
)
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with all trigrams of a phrase, checked against the phrase."""
    names = table(spark, sf_dir, "retrospective_store").select(F.lower(F.trim("jurabk")).alias("t"), act_key().alias("act_id")).distinct()
    grams = names.select("act_id", F.explode(search.trigrams(F.col("t"))).alias("gram"))
    return names.join(search.trigram_candidates(grams, "burgg", "act_id"), "act_id", "left_semi").where(F.col("t").contains("burgg")).select("act_id")


@query(
    """WITH d AS (SELECT DISTINCT id, title, court, az, kind, CAST(summary AS VARCHAR) AS s, [x FOR x IN map_values(summary) IF x IS NOT NULL] AS texts FROM decisions),
w AS (SELECT id, contains(lower(coalesce(az, '')), 'steuer') AS i, contains(lower(coalesce(title, '')), 'steuer') AS t, contains(lower(coalesce(court, '')), 'steuer') AS c, len([x FOR x IN coalesce(texts, []) IF contains(lower(x), 'steuer')]) > 0 AS s, kind = 'urteil' AS watched FROM d)
SELECT id, (CASE WHEN i THEN 780 ELSE 0 END + CASE WHEN t THEN 680 ELSE 0 END + CASE WHEN c THEN 520 ELSE 0 END + CASE WHEN s THEN 280 ELSE 0 END) + CASE WHEN coalesce(watched, false) THEN 75 ELSE 0 END AS score FROM w WHERE i OR t OR c OR s"""
)
def procedure_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fields with phrase bonus and the bonus of watched rows."""
    rows = table(spark, sf_dir, "decisions").select("id", "title", "court", "az", "kind", F.map_values("summary").alias("texts"), F.to_json("summary").alias("s")).distinct()
    fields = {"identifier": F.array("az"), "title": F.array("title"), "scope": F.array("court"), "summary": F.col("texts")}
    scored = rows.select("id", search.procedure_score(fields, "steuer", F.coalesce(F.col("kind") == "urteil", F.lit(False))).alias("score"))
    return scored.where(F.col("score").isNotNull())


@query(
    _BM25
    + """, k AS (SELECT doc AS doc_id FROM r WHERE found = 2), e AS (SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'steuer'))
SELECT 'texts' AS branch, count(*) AS n FROM k UNION ALL SELECT 'plain', count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM k) UNION ALL SELECT 'decisions', count(DISTINCT id) FROM decisions WHERE contains(lower(coalesce(title, '')), 'steuer')
UNION ALL SELECT 'changes', count(DISTINCT change_id) FROM act_archive WHERE contains(lower(coalesce(new_text, '')), 'steuer')"""
)
def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all branches of a search, without duplicates between ranked and plain hits."""
    postings, lengths = index(spark, sf_dir)
    n, average = lengths.agg(F.count("*"), F.avg("length")).first()
    ranked = search.bm25(postings, search.compile_query("Behörde Antrag"), n, average or 1.0, lengths).withColumnRenamed("doc", "doc_id")
    plain = table(spark, sf_dir, "documents").where(F.lower("text").contains("steuer")).select("doc_id")
    merged = search.merge_without_duplicates(ranked, plain, "doc_id")
    kinds = merged.groupBy(F.when(F.col("score") > 0, "texts").otherwise("plain").alias("branch")).agg(F.count("*").alias("n"))
    decisions = table(spark, sf_dir, "decisions").where(F.lower("title").contains("steuer")).agg(F.count_distinct("id").alias("n")).select(F.lit("decisions").alias("branch"), "n")
    changes = table(spark, sf_dir, "act_archive").where(F.lower("new_text").contains("steuer")).agg(F.count_distinct("change_id").alias("n")).select(F.lit("changes").alias("branch"), "n")
    return kinds.unionByName(decisions).unionByName(changes)


@query(
    """WITH n AS (SELECT lower(jurabk) AS alias, count(DISTINCT lower(trim(act_id))) AS acts, min(lower(trim(act_id))) AS act_id FROM retrospective_store GROUP BY 1) SELECT alias, act_id FROM n WHERE acts = 1"""
)
def act_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations that name exactly one act."""
    names = table(spark, sf_dir, "retrospective_store").groupBy(F.lower("jurabk").alias("alias")).agg(F.count_distinct(act_key()).alias("acts"), F.min(act_key()).alias("act_id"))
    return names.where("acts = 1").select("alias", "act_id")


_TAXES = search.Concept("taxation", frozenset({"abgaben", "fiskus"}), ("steuer",))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated targets: the hand labels, weighed by how often they were given."""
    labels = table(spark, sf_dir, "subject_labels").select("doc_id", F.lower(F.trim("area")).alias("name")).dropna()
    return labels.groupBy("name", F.col("doc_id").alias("doc")).agg(F.count("*").alias("weight"))


@query(
    f"""WITH {_POST}, h AS (SELECT doc, count(DISTINCT CASE WHEN starts_with(token, 'steuer') THEN 1 WHEN starts_with(token, 'verfahren') THEN 2 END) AS found FROM p WHERE starts_with(token, 'steuer') OR starts_with(token, 'verfahren') GROUP BY 1),
t AS (SELECT doc_id AS doc, least(5, count(*)) AS w FROM subject_labels WHERE lower(trim(area)) = 'taxation' AND doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT doc_id, coalesce(t.w, 0) AS w, lower(coalesce(text, '')) AS body FROM documents LEFT JOIN t ON t.doc = doc_id LEFT JOIN h ON h.doc = doc_id WHERE text IS NOT NULL AND (h.found = 2 OR t.w IS NOT NULL)),
r AS (SELECT doc_id, CAST(CASE WHEN contains(body, 'steuer') OR contains(body, 'verfahren') THEN 20 ELSE 0 END + CASE WHEN contains(body, 'steuer verfahren') THEN 40 ELSE 0 END + CASE WHEN w > 0 THEN 10000 + 1000 * (w - 1) + CASE WHEN contains(body, 'steuer') OR contains(body, 'verfahren') THEN 1500 ELSE 0 END ELSE 0 END AS DOUBLE) AS relevance FROM m)
SELECT doc_id, relevance FROM r ORDER BY relevance DESC, doc_id LIMIT 200"""
)
def search_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with all words of a query or with the concept that one of them stands for, the concept's targets first."""
    postings, lengths = index(spark, sf_dir)
    rows = table(spark, sf_dir, "documents")
    targets = _labelled(spark, sf_dir)
    everything = postings.unionByName(search.concept_postings(targets, rows, "doc_id"))
    compiled = search.compile_query("Steuer Verfahren", (_TAXES,))
    n, average = lengths.agg(F.count("*"), F.avg("length")).first()
    found = search.bm25(everything, compiled, n, average or 1.0, lengths)
    weights = targets.where(F.col("name").isin(compiled.concepts)).groupBy("doc").agg(F.least(F.max("weight"), F.lit(5)).alias("w"))
    joined = found.join(weights, "doc", "left").join(rows.select("doc_id", "text"), F.col("doc") == F.col("doc_id"))
    ranked = search.rerank(joined, compiled, "Steuer Verfahren", {"text": 20.0}, F.coalesce("w", F.lit(0)))
    return ranked.orderBy(F.desc("relevance"), "doc_id").limit(200).select("doc_id", F.col("relevance").cast("double").alias("relevance"))


@query(
    """WITH c AS (SELECT doc_id, lower(trim(act_id)) AS act_id FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(^|[^0-9§])§§? ?8([^0-9a-z]|$)')) SELECT doc_id, act_id FROM c WHERE act_id = 'fed_rahmeng'"""
)
def constrained_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section asked for together with an act's abbreviation: only that act's texts, if the abbreviation names exactly one."""
    names = act_aliases(spark, sf_dir)
    compiled = search.compile_query("§ 8 RahmenG")
    acts = search.act_constraint(names, compiled)
    texts = table(spark, sf_dir, "documents").where(F.col("text").rlike(rf"(?:^|[^0-9§])§§? ?{compiled.norm}(?:[^0-9a-z]|$)")).select("doc_id", act_key().alias("act_id"))
    # The constraint is one act at most.
    return texts.join(F.broadcast(acts), "act_id", "left_semi").select("doc_id", "act_id")


@query(
    _BM25
    + """, k AS (SELECT 'texts' AS branch, CAST(doc AS VARCHAR) AS key, round(score, 4) AS score FROM r WHERE found = 2 ORDER BY round(score, 6) DESC, doc LIMIT 25),
e AS (SELECT 'acts' AS branch, act_id AS key, 0.0 AS score FROM (SELECT DISTINCT lower(trim(act_id)) AS act_id FROM retrospective_store WHERE contains(lower(jurabk), 'burg')) ORDER BY act_id LIMIT 25),
c AS (SELECT 'changes' AS branch, CAST(change_id AS VARCHAR) AS key, 0.0 AS score FROM (SELECT DISTINCT change_id FROM act_archive WHERE contains(lower(new_text), 'behörde')) ORDER BY change_id LIMIT 25), dz AS (SELECT 'decisions' AS branch, id AS key, 0.0 AS score FROM (SELECT DISTINCT id FROM decisions WHERE contains(lower(title), 'akten')) ORDER BY id LIMIT 25)
SELECT branch, key, CAST(score AS DOUBLE) AS score FROM k UNION ALL SELECT branch, key, CAST(score AS DOUBLE) FROM e UNION ALL SELECT branch, key, CAST(score AS DOUBLE) FROM c UNION ALL SELECT branch, key, CAST(score AS DOUBLE) FROM dz"""
)
def envelope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of every branch of a search in one envelope."""
    postings, lengths = index(spark, sf_dir)
    n, average = lengths.agg(F.count("*"), F.avg("length")).first()
    ranked = search.top(search.bm25(postings, search.compile_query("Behörde Antrag"), n, average or 1.0, lengths), 25)
    row = lambda d, branch, key, score: d.select(F.lit(branch).alias("branch"), F.col(key).cast("string").alias("key"), score.alias("score"))
    plain = lambda name, key, hit: table(spark, sf_dir, name).where(hit).select(key.alias("key")).distinct().orderBy("key").limit(25)
    branches = [
        ("acts", plain("retrospective_store", act_key(), F.lower("jurabk").contains("burg"))), ("changes", plain("act_archive", F.col("change_id"), F.lower("new_text").contains("behörde"))),
        ("decisions", plain("decisions", F.col("id"), F.lower("title").contains("akten"))),
    ]
    result = row(ranked, "texts", "doc", F.round("score", 4))
    for branch, rows in branches:
        result = result.unionByName(row(rows, branch, "key", F.lit(0.0)))
    return result
