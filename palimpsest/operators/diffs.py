"""State diffs in three contracts (B8, B21, J11, W4, U11). They differ in pairing and in their words; keep them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrence(rows: DataFrame, group: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Number repeated labels from 0 in source order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def multiset_diff(old: DataFrame, new: DataFrame, keys: list[str], content: list[str], order: list[str]) -> DataFrame:
    """B8 (i): per label first cancel rows of equal content, then pair what is left in order; the rest is added or deleted.

    Gives keys, ``place``, the content of both sides as old_*/new_* and ``operation`` in add/delete/replace.
    """
    cancelled = []
    for side, name in ((old, "old"), (new, "new")):
        copies = occurrence(side, keys + content, order, "copy")
        cancelled.append(copies.select(*keys, *content, *order, "copy").withColumn("side", F.lit(name)))
    match = [*keys, *content, "copy"]
    both = Window.partitionBy(*match)
    rest = (
        cancelled[0]
        .unionByName(cancelled[1])
        .withColumn("sides", F.size(F.collect_set("side").over(both)))
        .where(F.col("sides") == 1)
    )
    placed = rest.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(*order, *content)))
    left = placed.where(F.col("side") == "old").select(*keys, "place", F.lit(True).alias("in_old"), *(F.col(c).alias(f"old_{c}") for c in content))
    right = placed.where(F.col("side") == "new").select(*keys, "place", F.lit(True).alias("in_new"), *(F.col(c).alias(f"new_{c}") for c in content))
    operation = F.when(F.col("in_old").isNull(), "add").when(F.col("in_new").isNull(), "delete").otherwise("replace")
    return left.join(right, [*keys, "place"], "full_outer").withColumn("operation", operation).drop("in_old", "in_new")


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], content: list[str], removed_word: str = "delete", metadata: list[str] | None = None) -> DataFrame:
    """B8 (ii) and (iii): full outer join on unique keys; keeps changed keys only.

    ``removed_word`` is 'delete' for (label, occurrence) keys and 'remove' for token keys. ``metadata`` columns do not
    make a replacement on their own; they give ``metadata_changed``.
    """
    metadata = metadata or []
    body = F.struct(*content)
    left = old.select(*keys, body.alias("a"), *([F.struct(*metadata).alias("ma")] if metadata else []))
    right = new.select(*keys, body.alias("b"), *([F.struct(*metadata).alias("mb")] if metadata else []))
    joined = left.join(right, keys, "full_outer")
    joined = joined.withColumn("metadata_changed", ~F.col("ma").eqNullSafe(F.col("mb")) if metadata else F.lit(False))
    operation = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), removed_word).when(F.col("a") != F.col("b"), "replace")
    return joined.withColumn("operation", operation).where(F.col("operation").isNotNull() | F.col("metadata_changed")).select(*keys, "operation", "metadata_changed")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """V3: keys that occur more than once, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def shared_day_diff(old: DataFrame, new: DataFrame, owner: str, keys: list[str], content: list[str]) -> DataFrame:
    """Keyed diff restricted to owners present on both sides; an owner that comes or goes is no change of its rows."""
    both = old.select(owner).distinct().join(new.select(owner).distinct(), owner, "left_semi")
    return keyed_diff(old.join(both, owner, "left_semi"), new.join(both, owner, "left_semi"), keys, content)


def append_new(ledger: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose keys the ledger does not hold; repeating the call changes nothing."""
    return ledger.unionByName(rows.dropDuplicates(keys).join(ledger.select(*keys).distinct(), keys, "left_anti"))
