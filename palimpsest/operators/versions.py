"""Problem 7: the history of changing attributes, by Merkle comparison of key buckets.

Time is cut into periods. For each period two snapshots are compared: the states with which its active keys enter it, and
the states they take in it (by their least and greatest hash, so that a change that is taken back within the period
still shows). Keys are hashed to leaf buckets, leaves to branches, branches to one root per period; a node's digest is the
fold of its keys' digests. Only differing nodes are descended, and only the events of differing leaves are read for
new versions. All sequences run within (key, period) or over one summary row per (key, period), so a key with a very
large share of all events is spread over its periods.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.session import cut_lineage

PERIOD_DAYS = 7
#: Leaves per branch of the Merkle tree, and keys per leaf that its width aims at.
FANOUT = 64
KEYS_PER_LEAF = 4


def leaves_for(keys: int) -> int:
    """The width of the tree for so many keys: a power of two that grows with them."""
    return 1 << max(8, (keys // KEYS_PER_LEAF).bit_length())


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; each distinct value of a batch is normalised once (Spark has no built-in for it)."""
    codes, values = pd.factorize(text, use_na_sentinel=True)
    done = pd.Series([unicodedata.normalize("NFC", v) for v in values] + [None], dtype=object)
    return pd.Series(done.to_numpy()[codes], index=text.index, dtype=object)


def trimmed_nfc(text: Column) -> Column:
    """Trimmed of white space of any kind and in NFC."""
    return nfc(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def latest_events(events: DataFrame, event: str, received: str, columns: list[str]) -> DataFrame:
    """One row per ``event``, the one received last (ties: the greatest values)."""
    return events.groupBy(event).agg(F.max(F.struct(received, *columns)).alias("r")).select(event, *(F.col(f"r.{c}").alias(c) for c in columns))


def _fold(column: str) -> Column:
    return F.bit_xor(column)


def _differs(a: str, b: str, c: str) -> Column:
    return (F.col(a) != F.col(b)) | (F.col(a) != F.col(c))


def changed_leaves(summaries: DataFrame) -> DataFrame:
    """(period, leaf) of the leaves that differ, by descending from differing roots over differing branches.

    ``summaries`` has per (key, period) the digests ``entering``, ``least`` and ``greatest``.
    """
    folds = [_fold(c).alias(c) for c in ("entering", "least", "greatest")]
    leaves = summaries.groupBy("period", "leaf").agg(*folds)
    branches = leaves.groupBy("period", F.floor(F.col("leaf") / FANOUT).cast("int").alias("branch")).agg(*folds)
    roots = branches.groupBy("period").agg(*folds)
    differ = _differs("entering", "least", "greatest")
    open_roots = roots.where(differ).select("period")
    open_branches = branches.where(differ).join(open_roots, "period", "left_semi").select("period", "branch")
    return (
        leaves.where(differ)
        .withColumn("branch", F.floor(F.col("leaf") / FANOUT).cast("int"))
        .join(open_branches, ["period", "branch"], "left_semi")
        .select("period", "leaf")
    )


def versions(events: DataFrame, key: str, at: str, state: list[str], tie: str) -> DataFrame:
    """(key, *state, valid_from, valid_to): the longest runs of equal state of each key along ``at``.

    ``valid_to`` is the next run's start, null for the last. Rows without key or time are ignored, null state values are
    values of their own, ``tie`` orders events of one instant. Rows without a change open no version.
    """
    days = F.datediff(F.col(at).cast("date"), F.lit("1970-01-01").cast("date"))
    digest = F.xxhash64(F.col(key), *(F.coalesce(F.col(c), F.lit("\u0000")) for c in state))
    # The events are read for the summaries and, of differing leaves, for their versions.
    base = cut_lineage(
        events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
            F.col(key).alias("key"), F.col(at).alias("at"), F.col(tie).alias("tie"), F.struct(*state).alias("state"), digest.alias("digest"), F.floor(days / PERIOD_DAYS).cast("int").alias("period")
        )
    )
    along = Window.partitionBy("key").orderBy("period")
    last = (
        base.groupBy("key", "period")
        .agg(F.max(F.struct("at", "tie", "state", "digest")).alias("last"), F.min("digest").alias("least"), F.max("digest").alias("greatest"))
        .withColumn("before", F.lag("last").over(along))
        # A key's first period has nothing to enter with: the digest of an absent key equals no state's.
        .withColumn("entering", F.coalesce(F.col("before.digest"), F.xxhash64(F.lit("absent"), F.col("key"))))
        .drop("last")
    )
    last = cut_lineage(last)
    leaf = F.pmod(F.xxhash64("key"), F.lit(leaves_for(last.agg(F.approx_count_distinct("key")).first()[0]))).cast("int").alias("leaf")
    open_leaves = changed_leaves(last.select("key", "period", leaf, "entering", "least", "greatest"))
    in_open = base.select("*", leaf).join(open_leaves, ["period", "leaf"], "left_semi").select("key", "period", "at", "tie", "state", F.lit(1).alias("real"))
    entering = (
        last.where(F.col("before").isNotNull())
        .select("*", leaf)
        .join(open_leaves, ["period", "leaf"], "left_semi")
        .select("key", "period", F.col("before.at").alias("at"), F.col("before.tie").alias("tie"), F.col("before.state").alias("state"), F.lit(0).alias("real"))
    )
    within = Window.partitionBy("key", "period").orderBy("real", "at", "tie")
    # The new versions of each period; their first is also the end of the last one before.
    starts = cut_lineage(
        in_open.unionByName(entering)
        .withColumn("previous", F.lag("state").over(within))
        .where((F.col("real") == 1) & ~F.col("state").eqNullSafe(F.col("previous")))
        .withColumn("following", F.lead("at").over(within))
        .select("key", "period", "at", "tie", "state", "following")
    )
    next_first = starts.groupBy("key", "period").agg(F.min("at").alias("first")).select("key", "period", F.lead("first").over(along).alias("next_first"))
    ends_here = starts.where(F.col("following").isNotNull()).withColumn("valid_to", F.col("following"))
    ends_later = starts.where(F.col("following").isNull()).join(next_first, ["key", "period"]).withColumn("valid_to", F.col("next_first")).drop("next_first")
    return ends_here.unionByName(ends_later).select(F.col("key").alias(key), *(F.col(f"state.{c}").alias(c) for c in state), F.col("at").alias("valid_from"), "valid_to")


def micros_text(instant: Column) -> Column:
    """'YYYY-MM-DDTHH:MM:SS.ffffffZ' of a TIMESTAMP_NTZ that holds UTC, whatever the session's zone."""
    s = instant.cast("string")
    return F.concat(F.substring(s, 1, 10), F.lit("T"), F.substring(s, 12, 8), F.lit("."), F.rpad(F.substring(s, 21, 6), 6, "0"), F.lit("Z"))
