"""Validation gates (V1-V12, A3, S9): rules give the rows that break them; a gate raises before anything is published.

An assertion column that nothing reads is pruned by the optimizer and never fires, so gates run as actions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class IntegrityError(Exception):
    """Stored data contradict themselves."""


class AmbiguityError(Exception):
    """A question has several answers."""


class NotFoundError(Exception):
    """A question has no answer."""


class RequestError(ValueError):
    """A question is not well formed."""


def report(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, broken): the number of rows that break each rule; V9's suite of checks as one table."""
    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken") for name, d in rules.items()))


def require(rules: dict[str, DataFrame], error: type[Exception] = IntegrityError) -> None:
    """Raise if any rule is broken, naming the rules and their counts."""
    broken = {r["rule"]: r["broken"] for r in report(rules).collect() if r["broken"]}
    if broken:
        raise error(", ".join(f"{k}: {v} rows" for k, v in sorted(broken.items())))


def schema_differences(frame: DataFrame, expected: StructType) -> list[str]:
    """V1: differences from a closed schema: missing, unknown and differently typed columns."""
    have, want = {f.name: f.dataType for f in frame.schema}, {f.name: f.dataType for f in expected}
    return (
        [f"missing {c}" for c in want if c not in have] + [f"unknown {c}" for c in have if c not in want] + [f"type of {c}" for c in want if c in have and have[c] != want[c]]
    )


def not_in(column: str, values: list[str]) -> Column:
    """V1: enum violation; null is none."""
    return F.col(column).isNotNull() & ~F.col(column).isin(values)


def bad_day(column: str) -> Column:
    """V1: a text that is no real calendar day in the form YYYY-MM-DD."""
    return F.col(column).isNotNull() & (~F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col(column).try_cast("date").isNull())


def bad_evidence(url: str, hosts: list[str]) -> Column:
    """V2: an address that is not https or not on the list of hosts."""
    address = F.col(url)
    return address.isNull() | ~address.startswith("https://") | ~F.coalesce(F.try_parse_url(address, F.lit("HOST")).isin(hosts), F.lit(False))


def bad_digest(digest: str, body: str) -> Column:
    """A stored digest that is not the body's."""
    return ~F.col(digest).eqNullSafe(F.sha2(F.col(body), 256))


def repeated(frame: DataFrame, keys: list[str]) -> DataFrame:
    """V3: keys that occur more than once."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reversed_range(start: str, end: str) -> Column:
    """V5: an end that does not follow its start."""
    return F.coalesce(F.col(end) <= F.col(start), F.lit(False))


def differing_counts(declared: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """A3: keys whose declared count (``n``) is not the counted one (``n``)."""
    joined = declared.select(key, F.col("n").alias("declared")).join(counted.select(key, F.col("n").alias("counted")), key, "full_outer")
    return joined.where(~F.col("declared").eqNullSafe(F.col("counted")))


def one(frame: DataFrame) -> dict:
    """The only row of a result; several raise :class:`AmbiguityError`, none :class:`NotFoundError` (V6)."""
    rows = frame.limit(2).collect()
    if not rows:
        raise NotFoundError("no row")
    if len(rows) > 1:
        raise AmbiguityError("more than one row")
    return rows[0].asDict(recursive=True)
