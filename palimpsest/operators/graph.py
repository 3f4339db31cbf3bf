"""Graph tables: vertices, edges, beliefs, ticks, propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ident import typed_id
from palimpsest.operators.relational import dense_ordinal


def vertex_id(kind: str, key: Column) -> Column:
    """Deterministic id of a vertex: equal in every run and independent of order."""
    return typed_id(f"{kind}-", key, length=16)


def vertices(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, kind, key): one vertex per distinct key of each (kind, one-column frame)."""
    named = [d.select(F.lit(k).alias("kind"), F.col(d.columns[0]).cast("string").alias("key")).where(F.col("key").isNotNull()) for k, d in parts]
    every = reduce(DataFrame.unionByName, named).distinct()
    return every.select(typed_id("v-", F.col("kind"), F.col("key"), length=16).alias("id"), "kind", "key")


def edge_weight(kind: Column, n: Column) -> Column:
    """Weight of an edge from its number of mentions, by kind, at most 1."""
    return F.round(F.least(F.lit(1.0), F.when(kind == "cites", 0.7 + n / 100).when(kind == "affects", 0.5 + n / 40).otherwise(n / 20)), 3)


def edges(parts: list[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """G1: (src, dst, kind, n, weight) from (edge kind, source kind, target kind, frame of source and target keys)."""
    named = [
        d.select(typed_id("v-", F.lit(a), F.col(d.columns[0]), length=16).alias("src"), typed_id("v-", F.lit(b), F.col(d.columns[1]), length=16).alias("dst"), F.lit(k).alias("kind"))
        for k, a, b, d in ((k, a, b, d.na.drop(subset=d.columns[:2])) for k, a, b, d in parts)
    ]
    counted = reduce(DataFrame.unionByName, named).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
    return counted.withColumn("weight", edge_weight(F.col("kind"), F.col("n")))


def remap(vertex_rows: DataFrame, edge_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with a dense ``index`` in the order of kind and key, and edges between indices.

    Vertices are numbered by a range sort, so that no task sees all vertices of a kind.
    """
    numbered = dense_ordinal(vertex_rows, ["kind", "key"], "index")
    ids = numbered.select("id", "index")
    mapped = edge_rows.join(ids.select(F.col("id").alias("src"), F.col("index").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("index").alias("b")), "dst")
    return numbered, mapped.select("a", "b", "kind", "weight")


def propagate_birth(births: DataFrame, edge_rows: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, tick): the earliest known tick, relaxed over edges in both directions for ``rounds`` synchronous rounds.

    In each round a vertex without a tick takes the least tick of its neighbours as of the round before; vertices never
    reached keep null (the caller sets its default). Each round is one join and one aggregation.
    """
    both = edge_rows.select("src", "dst").unionByName(edge_rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    current = births
    for _ in range(rounds):
        offered = both.join(current.where(F.col("tick").isNotNull()).select(F.col("id").alias("src"), "tick"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("tick").alias("offer"))
        current = current.join(offered, "id", "left").select("id", F.coalesce("tick", "offer").alias("tick"))
    return current


def belief(p_true: Column, p_false: Column, p_both: Column, p_none: Column) -> Column:
    """struct<confidence, contradiction, uncertainty> of four masses; a null mass counts 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(
        F.round(F.greatest(z(p_true), z(p_false)), 3).alias("confidence"), F.round(z(p_both), 3).alias("contradiction"), F.round(F.least(F.lit(1.0), z(p_none) + z(p_both) / 2), 3).alias("uncertainty")
    )


def degree(edge_rows: DataFrame) -> DataFrame:
    """(id, n_out, n_in)."""
    outgoing = edge_rows.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    incoming = edge_rows.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    return outgoing.join(incoming, "id", "full_outer").select("id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))
