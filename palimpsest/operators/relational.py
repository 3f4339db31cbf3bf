"""Projections, merges, rankings and rollups that the query surface is made of (P, J, A, O, U families)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fingerprints
from palimpsest.session import cut_lineage, local_rows


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in stable order with the uncapped ``matched``.

    The count is an aggregate of its own, joined as one row; a window over all rows would bring them into one task.
    """
    total = rows.agg(F.count("*").alias("matched"))
    # One row; the page itself is a distributed top-k (offset + limit rows).
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The greatest row per key by ``order``; an aggregate, so a hot key is reduced map-side."""
    others = [c for c in columns if c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in columns))


def reserved_top(rows: DataFrame, reserved: Column, order: list[Column], seats: int) -> DataFrame:
    """O2: all reserved rows, filled up with the first others to ``seats`` in total."""
    kept = rows.where(reserved)
    free = max(0, seats - kept.count())
    return kept.unionByName(rows.where(~F.coalesce(reserved, F.lit(False))).orderBy(*order).limit(free))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """U4: refreshed rows win, unseen old rows stay. Keys are unique on either side."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def drop_collisions(rows: DataFrame, *key_sets: list[str]) -> DataFrame:
    """Only rows that are alone among all rows under each of the key sets; every member of any collision goes."""
    kept = rows
    for keys in key_sets:
        alone = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == 1).drop("_n")
        kept = kept.join(alone, keys, "left_semi")
    return kept.select(*rows.columns)


def precedence_merge(preferred: DataFrame, other: DataFrame, *key_sets: list[str]) -> DataFrame:
    """``preferred`` and the rows of ``other`` that match it under none of the key sets (an OR of anti-joins)."""
    rest = other
    for keys in key_sets:
        rest = rest.join(preferred.select(*keys).distinct(), keys, "left_anti")
    return preferred.unionByName(rest)


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value, null on a tie."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.max("n").alias("n"))
    return counts.join(top, [key, "n"]).groupBy(key).agg(F.when(F.count("*") == 1, F.min(value)).alias(value))


def single_or_null(values: Column) -> Column:
    """The element of a one-element array, else null."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def distinct_sorted(value: Column) -> Column:
    """Sorted distinct values of a group, nulls left out."""
    return F.array_sort(F.collect_set(value))


def max_of_counts(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """A10: per key the largest of its per-source counts."""
    return rows.groupBy(*keys, source).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("n"))


def unique_unambiguous(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on keys that are unique on both sides; ambiguous keys take part on neither."""
    alone = lambda d: d.join(d.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key), key, "left_semi")
    return alone(left).join(alone(right), key)


def exactly_one(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates of keys that have exactly one."""
    return candidates.join(candidates.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n"), keys, "left_semi")


#: A key with more rows than _HOT may be joined in parts, at most _SALTS of them; so many of the largest keys are.
_HOT, _SALTS, _HOT_KEYS = 500, 1024, 10_000


def spread_join(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """An equi-join on ``key`` whose hot keys are spread: their rows in ``many`` are salted, those in ``few`` repeated for each salt.

    Only the _HOT_KEYS largest keys are salted, so the table of salts is bounded; any other key holds less than one in
    _HOT_KEYS of the rows.
    """
    largest = many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > _HOT).orderBy(F.desc("_n"), key).limit(_HOT_KEYS)
    hot = F.broadcast(largest.select(key, F.least(F.ceil(F.col("_n") / _HOT), F.lit(_SALTS)).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = many.withColumn("_row", F.xxhash64(*many.columns)).join(hot, key, "left").withColumn("_salt", F.pmod("_row", salts).cast("int")).drop("_row", "_salts")
    repeated = few.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(repeated, [key, "_salt"]).drop("_salt")


def found_once(rows: DataFrame, texts: DataFrame, key: str, wording: str, text: str) -> DataFrame:
    """The distinct ``rows`` with the ``texts`` of the same ``key`` in which their ``wording`` occurs exactly once.

    A wording has at least :data:`fingerprints.SHORTEST` bytes. Where a key has few rows, all its pairs are compared. Of the largest
    keys with more than _HOT rows only those pairs are that share a fingerprint; these include every pair in which the wording occurs.
    """
    largest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > _HOT).orderBy(F.desc("_n"), key).limit(_HOT_KEYS)
    hot = F.broadcast(largest.select(key, F.lit(True).alias("_hot")))
    split = lambda d, c: d.join(hot, key, "left").where(c).drop("_hot")
    few, many = F.col("_hot").isNull(), F.col("_hot").isNotNull()
    # Rows with the same wording are compared once; in a struct nulls are kept.
    wordings = rows.groupBy(key, wording).agg(F.collect_set(F.struct(*(c for c in rows.columns if c not in (key, wording)))).alias("_rows"))
    # Most pairs do not contain the wording; only the others are counted.
    once = F.contains(text, wording) & (F.length(text) - F.length(F.replace(F.col(text), F.col(wording), F.lit(""))) == F.length(wording))
    plain = spread_join(split(texts, few), split(wordings, few), key).where(once)

    marked = fingerprints.with_fingerprint(split(wordings, many).withColumn("_seed", F.xxhash64(key)), wording).drop("_seed")
    # Texts of one hash are told apart when they are compared.
    known = split(texts, many).withColumn("_text", F.xxhash64(*texts.columns))
    marks = fingerprints.text_fingerprints(known.withColumn("_seed", F.xxhash64(key)), "_text", text)
    candidates = marked.join(marks, "_mark").drop("_mark").repartition(key, "_text").distinct()
    compared = candidates.join(known, [key, "_text"]).where(once)
    found = plain.unionByName(compared.select(*plain.columns))
    return found.select(key, wording, F.inline("_rows"), *(c for c in texts.columns if c != key))


def token_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_tokens: str, right_tokens: str) -> DataFrame:
    """(left_key, right_key, shared) of rows that share a token: both sides exploded, one equi-join, hot tokens spread."""
    a = left.select(left_key, F.explode(F.array_distinct(left_tokens)).alias("token"))
    b = right.select(right_key, F.explode(F.array_distinct(right_tokens)).alias("token"))
    return spread_join(b, a, "token").groupBy(left_key, right_key).agg(F.count("*").alias("shared"))


def dense_ordinal(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """``rows`` numbered from 0 in the given order, without bringing them into one task.

    They are range-sorted and written once with their partition and place; the partitions' offsets, one number each, complete
    the ordinal.
    """
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    total, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    # One row per partition.
    offset = local_rows(rows.sparkSession, offsets, ["_p", "_offset"])
    numbered = placed.withColumn("_p", part).join(F.broadcast(offset), "_p")
    return numbered.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_offset", "_at")


def natural_order(label: Column) -> list[Column]:
    """O3: number first, then suffix; labels without a number last."""
    number = F.expr("1") * F.nullif(F.regexp_extract(label, r"^(\d+)", 1), F.lit("")).try_cast("bigint")
    return [number.asc_nulls_last(), F.regexp_replace(label, r"^\d+", "").asc()]


def month_number(day: Column) -> Column:
    """months since year 0."""
    return F.year(day) * 12 + F.month(day) - 1


def running_share(rows: DataFrame, tick: str, part: Column) -> DataFrame:
    """(tick, known, share): the share of ``part`` among all rows up to each tick.

    Rows are counted per tick first; the running window sees one row per tick.
    """
    per = rows.groupBy(tick).agg(F.count("*").alias("n"), F.sum(part.cast("int")).alias("m"))
    upto = Window.orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(tick, F.sum("n").over(upto).alias("known"), F.round(F.sum("m").over(upto) / F.sum("n").over(upto), 3).alias("share"))


def as_of_unique(events: DataFrame, windows: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """Events in (low, high] of exactly one window of their key, with the window's columns.

    An event in several windows has no row. Keys with many events are spread over their windows.
    """
    placed = spread_join(events, windows, key).where((F.col(at) > F.col(low)) & (F.col(at) <= F.col(high)))
    return exactly_one(placed, events.columns)


def unexpected(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner in ``keys`` (the anti-join behind completeness guards)."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")
