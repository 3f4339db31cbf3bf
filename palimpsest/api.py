"""The query surface (E1-E11): one function per endpoint or command, each (session, directory, parameters) -> DataFrame.

Parameters are checked as the reference's are: limits are bounded, instants carry a zone, ranges are not reversed; a bad
parameter raises :class:`RequestError`. A question that must have one answer raises Not-found or Ambiguity.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import norm_label
from palimpsest.operators import archive, bitemporal, diffs, extract, relational, search
from palimpsest.operators.validate import AmbiguityError, NotFoundError, RequestError
from palimpsest.plans import ledgers, listings, projections, retrieval, temporal, texts
from palimpsest.plans.found import act_key
from palimpsest.session import table


def _limit(value: int, highest: int, lowest: int = 1) -> int:
    if not lowest <= value <= highest:
        raise RequestError(f"limit must be between {lowest} and {highest}")
    return value


def _offset(value: int) -> int:
    if value < 0:
        raise RequestError("offset must not be negative")
    return value


def _instant(value: str | dt.datetime | None) -> Column | None:
    """An instant as UTC; one without a zone is an error."""
    if value is None:
        return None
    try:
        moment = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    except ValueError as error:
        raise RequestError(f"not an instant: {value}") from error
    if moment.tzinfo is None:
        raise RequestError("an instant needs a time zone")
    return F.lit(moment.astimezone(dt.timezone.utc).replace(tzinfo=None))


def _day(value: str | dt.date) -> Column:
    try:
        return F.lit(dt.date.fromisoformat(value) if isinstance(value, str) else value)
    except ValueError as error:
        raise RequestError(f"not a day: {value}") from error


def _act(rows: DataFrame, act: str | None) -> DataFrame:
    """Rows of one act by id or abbreviation, case-folded."""
    if act is None:
        return rows
    wanted = act.strip().lower()
    hit = F.col("act_id") == wanted
    return rows.where(hit | (F.lower(F.trim("jurabk")) == wanted) if "jurabk" in rows.columns else hit)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all tables."""
    return projections.register.queries["summary_row"](spark, sf_dir)


def official_states(spark: SparkSession, sf_dir: str, act: str | None = None, limit: int = 250, offset: int = 0) -> DataFrame:
    """Observed states, newest first, one page with ``matched``."""
    rows = _act(temporal.observations(spark, sf_dir), act)
    return relational.page(rows, [F.desc("observed_at"), F.col("act_id")], _limit(limit, 1000), _offset(offset))


def federal_history(spark: SparkSession, sf_dir: str, act: str | None = None, tier: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Public events by act and tier ('exact' or 'correspondence'), newest first, one page with ``matched``."""
    if tier not in (None, "exact", "correspondence"):
        raise RequestError("tier is 'exact' or 'correspondence'")
    from palimpsest.plans import surface

    events = surface.register.queries["public_events"](spark, sf_dir)
    rows = _act(ledgers.changes(spark, sf_dir).select("change_id", "act_id", "day").distinct().join(events, "change_id"), act)
    rows = rows.where(F.col("tier") == tier) if tier else rows
    return relational.page(rows, [F.desc("day"), F.col("change_id")], _limit(limit, 1000), _offset(offset))


def reviews(spark: SparkSession, sf_dir: str, act: str | None = None, document: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Reviewed transitions by act and amending document, one page with ``matched``."""
    columns = ["id", act_key().alias("act_id"), "jurabk", F.col("interval_span.effective_from").alias("effective_from"), F.col("incoming.document_id").alias("document_id")]
    rows = _act(table(spark, sf_dir, "verified_reconstruction_reviews").select(*columns).distinct(), act)
    rows = rows.where(F.col("document_id") == document) if document else rows
    return relational.page(rows, [F.desc_nulls_last("effective_from"), F.col("id")], _limit(limit, 1000), _offset(offset))


def reconstructions(spark: SparkSession, sf_dir: str, act: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Verified reconstructions, never those of another verdict, one page with ``matched``."""
    done = ledgers.register.queries["verified_replay"](spark, sf_dir).where("verdict = 'verified'")
    rows = _act(ledgers.changes(spark, sf_dir).select("change_id", "act_id", "day").distinct().join(done, "change_id"), act)
    return relational.page(rows, [F.desc_nulls_last("day"), F.col("change_id")], _limit(limit, 1000), _offset(offset))


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of acts: id, abbreviation, current intervals, states and events."""
    from palimpsest.plans import surface

    names = table(spark, sf_dir, "retrospective_store").groupBy(act_key().alias("act_id")).agg(F.min("jurabk").alias("jurabk"))
    return surface.register.queries["public_manifest"](spark, sf_dir).join(names, "act_id", "left").orderBy("act_id")


def git(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """The newest commits: each act's changes of one source on one day."""
    rows = ledgers.changes(spark, sf_dir).where(F.col("day").isNotNull()).groupBy("act_id", "day").agg(F.count_distinct("change_id").alias("changes"), F.slice(F.array_sort(F.collect_set("label")), 1, 8).alias("paras"))
    return rows.orderBy(F.desc("day"), "act_id").limit(_limit(limit, 1000))


def feed(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """The newest events of all sources."""
    rows = projections.feed_events(spark, sf_dir)
    return rows.orderBy(F.desc("day"), "ordinal", "key").limit(_limit(limit, 600)).select("day", "source", "kind", "title")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges."""
    return ledgers.graph_tables(spark, sf_dir)


def history(spark: SparkSession, sf_dir: str, act: str, as_of: str | None = None) -> DataFrame:
    """The assertions of an act as known at an instant (default: now known)."""
    named = _act(table(spark, sf_dir, "retrospective_store").select(act_key().alias("act_id"), "jurabk"), act).select("act_id").distinct()
    rows = temporal.assertions(spark, sf_dir).join(named, "act_id", "left_semi")
    moment = _instant(as_of)
    return (rows.where(F.col("knowledge_to").isNull()) if moment is None else bitemporal.history_slice(rows, moment)).orderBy("effective_from", "assertion_id")


def checkout(spark: SparkSession, sf_dir: str, act: str, at: str, as_of: str | None = None) -> dict:
    """The one assertion of an act valid on a day as known at an instant."""
    rows = history(spark, sf_dir, act, as_of).where(bitemporal.valid_on(_day(at))).limit(2).collect()
    if not rows:
        raise NotFoundError(f"{act} on {at}")
    if len(rows) > 1:
        raise AmbiguityError(f"{act} on {at}")
    return rows[0].asDict(recursive=True)


def _sections(spark: SparkSession, sf_dir: str, act: str, at: str) -> DataFrame:
    rows = ledgers.changes(spark, sf_dir).where((F.col("act_id") == act.strip().lower()) & F.col("label").isNotNull() & (F.col("day") <= _day(at)) & F.col("new_text").isNotNull())
    return rows.groupBy("act_id", "label").agg(F.max_by("new_text", F.struct("day", "change_id")).alias("body"))


def diff(spark: SparkSession, sf_dir: str, act: str, start: str, end: str) -> DataFrame:
    """E4, B8 (iii): sections that differ between two days."""
    if dt.date.fromisoformat(start) > dt.date.fromisoformat(end):
        raise RequestError("the range is reversed")
    return diffs.keyed_diff(_sections(spark, sf_dir, act, start), _sections(spark, sf_dir, act, end), ["label"], ["body"], removed_word="remove").drop("metadata_changed")


def markdown(spark: SparkSession, sf_dir: str, act: str, at: str) -> DataFrame:
    """The sections of an act on a day as one Markdown page."""
    return archive.markdown(_sections(spark, sf_dir, act, at), "act_id", "label", "label", "body")


def archive_days(spark: SparkSession, sf_dir: str, act: str) -> DataFrame:
    """The selectable days of an act."""
    return ledgers.register.queries["archive_index"](spark, sf_dir).where(F.col("act_id") == act.strip().lower()).orderBy(F.desc("day"))


def changes(
    spark: SparkSession, sf_dir: str, q: str | None = None, act: str | None = None, norm: str | None = None, start: str | None = None, end: str | None = None, future: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """Changes by text, act, section, day range; ``future``: only those after this pinned day. One page with ``matched``."""
    rows = _act(ledgers.changes(spark, sf_dir), act)
    if start and end and dt.date.fromisoformat(start) > dt.date.fromisoformat(end):
        raise RequestError("the range is reversed")
    if start:
        rows = rows.where(F.col("day") >= _day(start))
    if end:
        rows = rows.where(F.col("day") <= _day(end))
    if future:
        rows = rows.where(F.coalesce(F.col("day") > _day(future), F.lit(False)))
    if norm:
        rows = rows.where(norm_label(F.col("label"))["number"] == norm.lower().replace(" ", ""))
    if q:
        haystack = F.regexp_replace(F.lower(F.concat_ws(" ", "act_id", "label", "old_text", "new_text")), r"(?U)\s+", " ")
        rows = rows.where(haystack.contains(" ".join(q.lower().split())))
    return relational.page(rows, [F.desc_nulls_last("day"), F.col("change_id")], _limit(limit, 1000), _offset(offset))


def changes_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest changes as Atom entries."""
    return ledgers.register.queries["atom_feed"](spark, sf_dir)


def amending_source(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The changes that one source brought, by act."""
    return temporal.register.queries["amending_rollup"](spark, sf_dir).where(F.col("source") == source)


def citations(spark: SparkSession, sf_dir: str, act: str, norm: str | None = None, direction: str = "out", limit: int = 100, offset: int = 0) -> DataFrame:
    """Citations from an act's texts ('out') or to one of its sections ('in')."""
    if direction not in ("out", "in"):
        raise RequestError("direction is 'out' or 'in'")
    rows = _act(texts.texts(spark, sf_dir).withColumn("act_id", act_key()), act)
    edges = extract.citations(rows, "doc_id", "text")
    if norm:
        edges = edges.where(F.col("norm") == norm.lower())
    elif direction == "in":
        raise RequestError("incoming citations need a section")
    return relational.page(edges, [F.col("doc_id"), F.col("place")], _limit(limit, 1000), _offset(offset))


def decisions(spark: SparkSession, sf_dir: str, q: str | None = None, act: str | None = None, limit: int = 50) -> DataFrame:
    """Decisions by text and by cited act, with only the effects on that act."""
    rows = table(spark, sf_dir, "decisions").dropDuplicates(["id"])
    if q:
        holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
        rows = rows.where(holds(F.col("title")) | holds(F.col("court")) | holds(F.col("az")) | F.coalesce(F.exists(F.map_values("summary"), holds), F.lit(False)))
    if act:
        wanted = act.strip().lower()
        rows = rows.withColumn("effects", F.filter("effects", lambda e: F.lower(F.trim(e["act_id"])) == wanted)).where(F.size("effects") > 0)
    return rows.orderBy(F.desc("decision_date"), "id").limit(_limit(limit, 200))


def decision(spark: SparkSession, sf_dir: str, ident: str) -> dict:
    """One decision by id."""
    rows = table(spark, sf_dir, "decisions").where(F.col("id") == ident).limit(1).collect()
    if not rows:
        raise NotFoundError(ident)
    return rows[0].asDict(recursive=True)


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured procedures with their last status."""
    return listings.register.queries["watched_procedures"](spark, sf_dir)


def find(spark: SparkSession, sf_dir: str, q: str, limit: int = 25) -> DataFrame:
    """Ranked texts for a query, with score and snippet."""
    from palimpsest.functions.text import snippet

    compiled = search.compile_query(q)
    if not compiled.tokens:
        raise RequestError("the query has no words")
    postings, lengths = retrieval.index(spark, sf_dir)
    n, average = lengths.agg(F.count("*"), F.avg("length")).first()
    best = search.top(search.bm25(postings, compiled, n, average or 1.0, lengths), _limit(limit, 200))
    rows = table(spark, sf_dir, "documents").join(F.broadcast(best), F.col("doc_id") == F.col("doc"))  # at most 200 rows
    return rows.select("doc_id", F.round("score", 4).alias("score"), "lang", "source", snippet(F.col("text"), compiled.tokens).alias("snippet")).orderBy(F.desc("score"), "doc_id")


def blame(spark: SparkSession, sf_dir: str, act: str, at: str) -> DataFrame:
    """The change behind each section of an act on a day."""
    rows = ledgers.changes(spark, sf_dir).where(F.col("act_id") == act.strip().lower())
    return archive.blame(rows, ["act_id", "label"], "day", _day(at))


def index() -> list[dict]:
    """The service index: every endpoint with its parameters, their defaults and its first line of description."""
    import inspect

    functions = [f for n, f in sorted(globals().items()) if inspect.isfunction(f) and f.__module__ == __name__ and not n.startswith("_") and n != "index"]
    shown = lambda p: "" if p.default is inspect.Parameter.empty else repr(p.default)
    return [{"endpoint": f.__name__, "parameters": {n: shown(p) for n, p in inspect.signature(f).parameters.items() if n not in ("spark", "sf_dir")}, "about": (f.__doc__ or "").splitlines()[0]} for f in functions]
