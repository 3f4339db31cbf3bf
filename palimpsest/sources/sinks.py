"""Sinks: swapped tables, content-addressed objects, relational and dataset exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.relational import dense_ordinal
from palimpsest.operators.validate import require


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = b.getFileSystem(conf)
    old = jvm.org.apache.hadoop.fs.Path(f"{target}.old-{uuid.uuid4().hex}")
    fs.mkdirs(b.getParent())
    had = fs.exists(b) and fs.rename(b, old)
    if not fs.rename(a, b):
        if had:
            fs.rename(old, b)
        raise OSError(f"cannot put {source} in place of {target}")
    if had:
        fs.delete(old, True)


def write_atomic(frame: DataFrame, path: str, partition_by: list[str] | None = None, gates: dict[str, DataFrame] | None = None) -> None:
    """Write a table aside, check its gates, then swap it in; a failure leaves the table in place untouched.

    A reader sees the old table or the new one, or, for the moment between the two renames, none; never a part.
    """
    aside = f"{path}.new-{uuid.uuid4().hex}"
    writer = frame.write.partitionBy(*partition_by) if partition_by else frame.write
    writer.parquet(aside)
    if gates:
        require(gates)
    _rename(frame.sparkSession, aside, path)


def store_objects(objects: DataFrame, path: str, digest: str = "state_sha256", body: str = "canonical_json") -> int:
    """Append the objects whose digest is not stored yet; returns their number.

    A body that does not hash to its digest, or two bodies under one digest, raise before anything is written. The
    stored side is read by its digest column only.
    """
    spark = objects.sparkSession
    fresh = objects.select(digest, body).distinct()
    require({"digest differs": fresh.where(F.sha2(body, 256) != F.col(digest)), "digest with two bodies": fresh.groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")})
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        fresh = fresh.join(spark.read.parquet(path).select(digest), digest, "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
    finally:
        fresh.unpersist()
    return n


def write_relational(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]], references: list[tuple[str, str, str, str]]) -> None:
    """Tables as sorted Parquet folders after their primary keys and references are checked.

    ``references``: (table, column, other table, its column). Files are range-partitioned and sorted by the key, so that
    point reads are pruned by the file statistics.
    """
    gates = {f"key of {t}": tables[t].groupBy(*k).agg(F.count("*").alias("n")).where("n > 1") for t, k in keys.items()}
    for t, c, other, oc in references:
        known = tables[other].select(F.col(oc).alias(c)).distinct()
        gates[f"{t}.{c} without {other}"] = tables[t].where(F.col(c).isNotNull()).join(known, c, "left_anti")
    require(gates)
    for name, frame in tables.items():
        order = keys.get(name, frame.columns[:1])
        write_atomic(frame.repartitionByRange(*order).sortWithinPartitions(*order), f"{path}/{name}")


def write_ordinal(frame: DataFrame, path: str, order: list[str]) -> None:
    """A table with a dense ``ordinal`` in the given order, without bringing it into one task."""
    write_atomic(dense_ordinal(frame, order).sortWithinPartitions("ordinal"), path)


def export_dataset(tables: dict[str, DataFrame], path: str, public: bool, reviewed: dict[str, DataFrame] | None = None) -> None:
    """JSON lines per table; a build that is not public, or rows that are not reviewed, export nothing."""
    if not public:
        raise PermissionError("only public builds are exported")
    if reviewed:
        require({f"unreviewed rows of {t}": rows for t, rows in reviewed.items()})
    for name, frame in tables.items():
        aside = f"{path}/{name}.new-{uuid.uuid4().hex}"
        frame.write.json(aside, ignoreNullFields=False)
        _rename(frame.sparkSession, aside, f"{path}/{name}")
