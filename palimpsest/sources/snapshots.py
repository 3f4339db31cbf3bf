"""Dated snapshot families of JSON lines.

Layout: ``<root>/source=<name>/day=<YYYY-MM-DD>/*.jsonl``. Listing goes through the file system of the path (HDFS, object
stores, local), on the driver and by directory only: its cost is the number of days, not of files or rows.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Families that are read only on request.
QUARANTINED = frozenset({"secondary_versions", "secondary_synopsis"})
ALLOW = "PALIMPSEST_INCLUDE_QUARANTINED"
_CORRUPT = "_corrupt"


def _files(spark: SparkSession, folder: str) -> list[tuple[str, bool, bool, int]]:
    """(name, is a directory, is a link, bytes) of what lies in a folder; nothing for a missing one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.isSymlink(), s.getLen()) for s in fs.listStatus(path))


def days(spark: SparkSession, root: str, source: str) -> list[str]:
    """The days of a source, oldest first; names that are no real date are ignored."""
    found = []
    for name, is_dir, is_link, _ in _files(spark, f"{root}/source={source}"):
        match = re.fullmatch(r"day=(\d{4}-\d{2}-\d{2})", name)
        if is_dir and not is_link and match:
            try:
                found.append(dt.date.fromisoformat(match.group(1)).isoformat())
            except ValueError:
                continue
    return sorted(found)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped, broken lines give rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_jsonl_strict(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """S3: as :func:`read_jsonl`, but a line that is no JSON object fails the job, naming its file."""
    rows = spark.read.schema(StructType([*schema.fields]).add(_CORRUPT, StringType())).option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    checked = F.when(F.col(_CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit("not a JSON object in "), F.input_file_name(), F.lit(": "), F.substring(_CORRUPT, 1, 200))))
    # The check is part of a column that is kept; an unused assertion would be pruned.
    first = schema.fields[0].name
    return rows.withColumn(first, F.when(F.col(_CORRUPT).isNotNull(), checked.cast(schema.fields[0].dataType)).otherwise(F.col(first))).select(*[f.name for f in schema.fields])


def latest(spark: SparkSession, root: str, source: str, schema: StructType, file: str | None = None) -> DataFrame:
    """The newest day of a source; a missing source, file or a quarantined family gives no rows.

    The day is resolved first, so that the scan is pruned to one directory.
    """
    if source in QUARANTINED and os.environ.get(ALLOW) != "1":
        return spark.createDataFrame([], schema)
    found = days(spark, root, source)
    if not found:
        return spark.createDataFrame([], schema)
    folder = f"{root}/source={source}/day={found[-1]}"
    if file and file not in {name for name, *_ in _files(spark, folder)}:
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, f"{folder}/{file}" if file else folder, schema)


def newest_file(spark: SparkSession, root: str, source: str, file: str) -> str | None:
    """The newest non-empty file of that name (or pattern) over all days, or None."""
    for day in reversed(days(spark, root, source)):
        for name, is_dir, _, size in _files(spark, f"{root}/source={source}/day={day}"):
            if fnmatch.fnmatch(name, file) and not is_dir and size > 0:
                return f"{root}/source={source}/day={day}/{name}"
    return None


def complete_days(spark: SparkSession, root: str, source: str, files: list[str]) -> list[str]:
    """The days that hold every one of ``files`` (names or patterns), none of them a link."""
    result = []
    for day in days(spark, root, source):
        there = {name for name, is_dir, is_link, _ in _files(spark, f"{root}/source={source}/day={day}") if not is_dir and not is_link}
        if all(fnmatch.filter(there, f) for f in files):
            result.append(day)
    return result


def prune(spark: SparkSession, root: str, source: str, candidates: dict[str, DataFrame], archived: DataFrame, digest: str) -> list[str]:
    """Delete the raw folders of candidate days, but only after every one's rows are proved archived.

    ``candidates``: day -> its rows' digests. Two phases: all proofs run first; one missing digest keeps everything and raises.
    """
    from palimpsest.operators.validate import require

    known = archived.select(digest).distinct()
    require({f"not archived on {day}": rows.select(digest).join(known, digest, "left_anti") for day, rows in candidates.items()})
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for day in candidates:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/source={source}/day={day}")
        path.getFileSystem(conf).delete(path, True)
    return sorted(candidates)
