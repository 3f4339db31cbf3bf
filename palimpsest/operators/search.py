"""Ranked retrieval over postings tables.

The index is plain tables: postings (token, field, doc, tf), document lengths and corpus statistics. A query is compiled
on the driver to a handful of tokens; everything that touches documents is joins and aggregations on postings, so a query
reads only the postings of its tokens (they are sorted by token and pruned by the file statistics).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.validate import require

K1, B = 1.2, 0.75
#: Column weights of the ranking function.
FIELD_WEIGHTS = {"abbr": 14.0, "title": 9.0, "label": 12.0, "heading": 6.0, "text": 1.0, "concept": 30.0}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(documents: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """(token, field, doc, tf), aggregated per document before the shuffle; null and empty fields have none."""
    stacked = documents.select(F.col(doc).alias("doc"), F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields)))).alias("field", "value"))
    return stacked.select("doc", "field", F.explode(words(F.col("value"))).alias("token")).groupBy("token", "field", "doc").agg(F.count("*").alias("tf"))


@dataclass
class Query:
    """A compiled query: tokens that must all occur, those that count as prefixes, an exact section number, and the concepts it matches."""

    tokens: list[str]
    prefixes: set[str] = field(default_factory=set)
    norm: str | None = None
    concepts: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Concept:
    """A group of synonyms: whole terms and prefixes, in lower case."""

    name: str
    terms: frozenset[str]
    prefixes: tuple[str, ...] = ()


def concept_token(name: str) -> str:
    """The token of a concept in the postings; no word contains its colon."""
    return f"concept:{name}"


def concept_postings(targets: DataFrame, documents: DataFrame, doc: str) -> DataFrame:
    """Postings of curated targets (name, doc, weight 1 to 5): a concept's token repeated ``weight`` times.

    A target that is no document any more is an error, never silently dropped.
    """
    require({"stale curated target": targets.join(documents.select(F.col(doc).alias("doc")), "doc", "left_anti")})
    return targets.select(F.concat(F.lit("concept:"), F.col("name")).alias("token"), F.lit("concept").alias("field"), "doc", F.least(F.greatest("weight", F.lit(1)), F.lit(5)).cast("bigint").alias("tf"))


def compile_query(text: str, concepts: tuple[Concept, ...] = ()) -> Query:
    """R2: AND of tokens; words are prefixes, numbers are exact; '§ n' or 'Art. n' asks for that section only.

    A concept whose term is the whole query overrides those of its tokens, which match by a term or a prefix; a query for a
    section has no concepts.
    """
    import re

    reference = re.search(r"(?:§|\bart(?:ikel|icle)?\.?)\s*(\d+[a-z]?)", text.lower())
    rest = text.lower().replace(reference.group(0), " ") if reference else text.lower()
    tokens = list(dict.fromkeys(re.findall(r"[^\W_]+", rest)))
    whole = [c.name for c in concepts if " ".join(tokens) in c.terms]
    some = [c.name for c in concepts if any(t in c.terms or t.startswith(c.prefixes) for t in tokens)] if not whole else whole
    return Query(tokens, {t for t in tokens if not t.isdigit()}, reference.group(1) if reference else None, [] if reference else some)


def matching(index: DataFrame, query: Query) -> DataFrame:
    """(query_token, token, field, doc, tf) of the postings that match a token of the query."""
    hit = F.when(F.lit(False), F.lit(None).cast("string"))
    wanted = F.lit(False)
    for t in query.tokens:
        found = F.col("token").startswith(t) if t in query.prefixes else F.col("token") == t
        wanted = wanted | found
        hit = hit.when(found, F.lit(t))
    for token in map(concept_token, query.concepts):
        found = F.col("token") == token
        wanted, hit = wanted | found, hit.when(found, F.lit(token))
    return index.where(wanted).select(hit.alias("query_token"), "token", "field", "doc", "tf")


def bm25(index: DataFrame, query: Query, documents: int, average_length: float, lengths: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, score) of the documents with all tokens of the query, or with one of its concepts; ``lengths``: (doc, length)."""
    weights = weights or FIELD_WEIGHTS
    factor = F.lit(1.0)
    for name, w in weights.items():
        factor = F.when(F.col("field") == name, F.lit(w)).otherwise(factor)
    hits = matching(index, query)
    per = hits.groupBy("doc", "query_token").agg(F.sum(F.col("tf") * factor).alias("tf"))
    df = per.groupBy("query_token").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(float(documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(average_length))
    # One row per token of the query.
    scored = per.join(F.broadcast(df), "query_token").join(lengths, "doc").withColumn("s", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    words_found = F.count_if(~F.col("query_token").startswith("concept:"))
    totals = scored.groupBy("doc").agg(F.sum("s").alias("score"), words_found.alias("found"), F.count("*").alias("all"))
    return totals.where((F.col("found") == len(query.tokens)) | (F.col("all") > F.col("found"))).select("doc", "score")


def top(scores: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of (doc, score), ties by doc: a distributed top-k."""
    return scores.orderBy(F.desc(F.round("score", 6)), "doc").limit(limit)


def candidate_window(limit: int) -> int:
    """How many candidates are fetched before re-ranking."""
    return min(3000, max(500, 10 * limit))


def rerank(candidates: DataFrame, query: Query, full: str, fields: dict[str, float], concept: Column | None = None) -> DataFrame:
    """(…, relevance): a field's weight if any token is contained in it, three times it if equal to the query, two times if it contains it.

    ``concept``: the number of repetitions of a matched concept (0 for none): 10,000 and 1,000 for each beyond the first, and
    1,500 more if the query has several tokens and another field holds one.
    """
    score, context = F.lit(0.0), F.lit(False)
    full = full.lower()
    for name, w in fields.items():
        value = F.lower(F.coalesce(F.col(name), F.lit("")))
        some = F.lit(False)
        for t in query.tokens:
            some = some | value.contains(t)
        context = context | some
        score = score + F.when(some, w).otherwise(0.0) + F.when(value == full, 3 * w).when(value.contains(full), 2 * w).otherwise(0.0)
    if concept is not None:
        further = F.when(context, 1500).otherwise(0) if len(query.tokens) > 1 else F.lit(0)
        score = score + F.when(concept > 0, 10000 + 1000 * (concept - 1) + further).otherwise(0)
    return candidates.withColumn("relevance", score)


def act_constraint(aliases: DataFrame, query: Query) -> DataFrame:
    """The act of the longest alias among the query's tokens; none without a section number or if several acts share it."""
    if query.norm is None:
        return aliases.limit(0).select("act_id")
    hits = aliases.where(F.col("alias").isin(query.tokens) | F.col("alias").isin(" ".join(query.tokens)))
    longest = hits.agg(F.max(F.length("alias")).alias("n"))
    best = hits.withColumn("n", F.length("alias")).join(F.broadcast(longest), "n").select("act_id").distinct()
    return best.groupBy().agg(F.when(F.count("*") == 1, F.min("act_id")).alias("act_id")).where(F.col("act_id").isNotNull())


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of a folded text."""
    low = F.lower(text)
    n = F.length(low)
    return F.array_distinct(F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.when(n >= 3, n - 2).otherwise(1)), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array(low)))


def trigram_candidates(postings_table: DataFrame, phrase: str, key: str) -> DataFrame:
    """Keys whose title has all trigrams of the phrase; ``postings_table``: (gram, key)."""
    grams = list(dict.fromkeys(phrase.lower()[i : i + 3] for i in range(max(1, len(phrase) - 2))))
    return postings_table.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(key)


def _starts(token: str):
    return lambda word: word.startswith(token)


def _holds(token: str):
    return lambda value: value.contains(token)


def catalogue_score(abbreviation: Column, title: Column, phrase: str, curated: Column, aliases: Column | None = None) -> Column:
    """The score ladder of catalogue rows; null where nothing matches. ``aliases``: an array of further abbreviations."""
    phrase = " ".join(phrase.lower().split())
    tokens = phrase.split()
    abbr, low = F.lower(abbreviation), F.lower(title)
    others = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower) if aliases is not None else F.array().cast("array<string>")
    bag = F.split(low, r"[^\p{L}\p{N}]+")
    exact, every = F.lit(0), F.lit(True)
    for t in tokens:
        exact = exact + F.array_contains(bag, t).cast("int")
        every = every & (F.array_contains(bag, t) | (F.exists(bag, _starts(t)) if len(t) >= 4 else F.lit(False)))
    score = F.when(abbr == phrase, 1100).when(F.exists(others, lambda a: a == phrase), 1050).when(low == phrase, 1000)
    if len(phrase) >= 2:
        score = score.when(abbr.startswith(phrase) | F.exists(others, lambda a: a.startswith(phrase)), 900)
    if len(phrase) >= 3:
        score = score.when(low.startswith(phrase), 850)
    score = score.when(low.contains(phrase) if len(phrase) >= 4 or " " in phrase else F.array_contains(bag, phrase), 760)
    score = score.when(every, 600 + 20 * exact)
    return score + F.when(curated, 15).otherwise(0)


#: Weights of the fields of procedures.
PROCEDURE_WEIGHTS = {"identifier": 700, "title": 600, "descriptor": 520, "watch": 500, "scope": 440, "topic": 360, "initiator": 280, "summary": 200}


def procedure_score(fields: dict[str, Column], phrase: str, watched: Column) -> Column:
    """Weighted fields: a field (array of values) counts if one value holds the phrase or each token is in some value."""
    phrase = phrase.lower()
    total, any_hit = F.lit(0), F.lit(False)
    for name, values in fields.items():
        low = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.coalesce(v, F.lit(""))))
        whole = F.exists(low, lambda v: v.contains(phrase))
        every = F.lit(True)
        for t in phrase.split():
            every = every & F.exists(low, _holds(t))
        total = total + F.when(whole | every, PROCEDURE_WEIGHTS[name]).otherwise(0) + F.when(whole, 80).otherwise(0)
        any_hit = any_hit | whole | every
    return F.when(any_hit, total + F.when(watched, 75).otherwise(0))


def merge_without_duplicates(ranked: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Ranked rows, then rows that only the plain search found, with score 0."""
    extra = legacy.join(ranked.select(key).distinct(), key, "left_anti").withColumn("score", F.lit(0.0))
    return ranked.select(key, "score").unionByName(extra.select(key, "score"))
