"""Problem 6: what changed between full snapshots, by content-defined chunks of key-sorted snapshots.

All snapshots share one split of the key space: keys are hashed to buckets, sorted within a bucket, and a key whose hash
has CHUNK_BITS trailing zero bits begins a new chunk. The boundaries depend on the keys alone, so an added or removed key moves
no other boundary. A chunk's digest folds the digests of its rows; where two consecutive snapshots agree on it, the whole
chunk is discarded, and only rows of the other chunks are joined to classify their changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage

#: A chunk holds 2**CHUNK_BITS keys on average.
CHUNK_BITS = 4


def normal_digest(raw: Column) -> Column:
    """The 64 hexadecimal digits of a digest in lower case, whatever surrounds them; null without them."""
    return F.lower(F.nullif(F.regexp_extract(raw, r"([0-9A-Fa-f]{64})", 1), F.lit("")))


def latest_rows(rows: DataFrame, keys: list[str], received: str, values: list[str]) -> DataFrame:
    """One row per ``keys``: the one received last; of rows received at once the greatest values."""
    best = F.max(F.struct(received, *values)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"best.{v}").alias(v) for v in values))


def snapshot_rows(deliveries: DataFrame, key: str, snapshot: str, received: str, digest: str, buckets: int) -> DataFrame:
    """(bucket, key, number, digest): one row per key and snapshot, numbered in time; null digests carried on.

    A present key with a null digest keeps the digest of the snapshot just before, if it was present there. All further
    steps group by ``bucket`` first, so this is the only exchange of the rows.
    """
    slim = deliveries.select(F.col(key).alias("key"), F.col(snapshot).alias("snapshot"), F.col(received).alias("received"), F.col(digest).alias("digest")).where(
        F.col("key").isNotNull() & F.col("snapshot").isNotNull()
    )
    # One row per delivery day of the whole table; its size is the number of snapshots.
    numbers = slim.select("snapshot").distinct().withColumn("number", F.row_number().over(Window.orderBy("snapshot")))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    one = latest_rows(slim.withColumn("bucket", bucket).repartition(F.col("bucket")), ["bucket", "key", "snapshot"], "received", ["digest"])
    placed = one.join(F.broadcast(numbers), "snapshot")
    by_key = Window.partitionBy("bucket", "key").orderBy("number")
    island = Window.partitionBy("bucket", "key", "island").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("island", F.col("number") - F.row_number().over(by_key)).select(
        "bucket", "key", "snapshot", "number", F.last("digest", ignorenulls=True).over(island).alias("digest")
    )


def chunk_of(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chunk``: the key that begins the content-defined chunk ('' before the first boundary)."""
    begins = F.when(F.shiftright(F.xxhash64("key", F.lit(1)), 0).bitwiseAND((1 << CHUNK_BITS) - 1) == 0, F.col("key"))
    running = Window.partitionBy("bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("chunk", F.coalesce(F.max(begins).over(running), F.lit("")))


def unmatched_chunks(rows: DataFrame) -> DataFrame:
    """(bucket, chunk, number): the chunks whose digest differs from the snapshot just before ``number``.

    A chunk digest is the number of rows and two independent 64-bit folds of (key, digest); a chunk missing in one of
    the two snapshots differs.
    """
    fold = lambda seed: F.bit_xor(F.xxhash64("key", F.coalesce("digest", F.lit("-")), F.lit(seed)))
    digests = rows.groupBy("bucket", "chunk", "number").agg(F.struct(F.count("*").alias("n"), fold(1).alias("a"), fold(2).alias("b")).alias("d"))
    # Each digest appears as "this" at its own snapshot and as "before" at the next.
    sides = digests.select(
        "bucket", "chunk",
        F.explode(F.array(F.struct(F.col("number"), F.col("d").alias("this"), F.lit(None).cast(digests.schema["d"].dataType).alias("before")),
                          F.struct((F.col("number") + 1).alias("number"), F.lit(None).cast(digests.schema["d"].dataType).alias("this"), F.col("d").alias("before")))).alias("s"),
    )
    pairs = sides.groupBy("bucket", "chunk", F.col("s.number").alias("number")).agg(F.max("s.this").alias("this"), F.max("s.before").alias("before"))
    return pairs.where(~F.col("this").eqNullSafe(F.col("before"))).select("bucket", "chunk", "number")


def open_rows(rows: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(bucket, key, number, digest, now): the rows of the unmatched chunks, for their own number (``now``) or as those before it.

    Rows of matching chunks meet nothing and are discarded by the join; only the others are doubled.
    """
    needed = (
        unmatched.select("bucket", "chunk", F.inline(F.array(F.struct(F.col("number").alias("at"), F.lit(True).alias("now")), F.struct((F.col("number") - 1).alias("at"), F.lit(False).alias("now")))))
        .groupBy("bucket", "chunk", "at")
        .agg(F.collect_set("now").alias("roles"))
    )
    return rows.join(needed.withColumnRenamed("at", "number"), ["bucket", "chunk", "number"]).select(
        "bucket", "key", "digest", "number", F.explode("roles").alias("now")
    ).withColumn("number", F.when(F.col("now"), F.col("number")).otherwise(F.col("number") + 1))


def snapshot_changes(deliveries: DataFrame, key: str, snapshot: str, received: str, digest: str, buckets: int = 64) -> DataFrame:
    """(key, snapshot, change_kind) with 'added', 'removed' or 'changed' between consecutive full snapshots.

    Of several deliveries of a key in a snapshot the last received counts. Nothing is reported for the first snapshot.
    A key whose digest becomes known after null is 'changed'. Rows without key or snapshot are ignored; ``buckets`` should
    grow with the number of keys (a bucket is sorted by one task).
    """
    # The keyed rows of all snapshots, read twice: for the digests and for the rows of unmatched chunks.
    rows = cut_lineage(chunk_of(snapshot_rows(deliveries, key, snapshot, received, digest, buckets)))
    numbers = rows.groupBy("number").agg(F.first("snapshot").alias("snapshot"))
    changed = (
        open_rows(rows, unmatched_chunks(rows))
        .groupBy("bucket", "key", "number")
        .agg(
            F.bool_or("now").alias("is_in"),
            F.bool_or(~F.col("now")).alias("was_in"),
            F.max(F.when(F.col("now"), F.col("digest"))).alias("this"),
            F.max(F.when(~F.col("now"), F.col("digest"))).alias("before"),
        )
        .withColumn(
            "change_kind",
            F.when(~F.col("was_in"), "added").when(~F.col("is_in"), "removed").when(~F.col("this").eqNullSafe(F.col("before")), "changed"),
        )
    )
    # Number 1 has no predecessor; the number after the last snapshot is no snapshot and finds no day.
    return (
        changed.where(F.col("change_kind").isNotNull() & (F.col("number") > 1))
        .join(F.broadcast(numbers), "number")
        .select(F.col("key").alias(key), F.col("snapshot").alias(snapshot), "change_kind")
    )
