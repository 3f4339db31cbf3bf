"""Fixtures for cuts that once hid rows."""

import datetime as dt
import os

import pytest

from palimpsest.plans import catalog

FOLDER = os.environ.get("PALIMPSEST_TABLES", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return connection


def test_overlap_counts_the_framework_act(spark, tmp_path):
    spark.createDataFrame([("f", [("fed_rahmeng",), ("fed_a",)]), ("g", [("fed_rahmeng",)])], "id string, current_law_checks array<struct<act_id string>>").write.parquet(str(tmp_path / "amendment_fates.parquet"))
    spark.createDataFrame([("d", [("fed_rahmeng",), ("fed_a",), None]), ("e", [("fed_b",)])], "id string, effects array<struct<act_id string>>").write.parquet(str(tmp_path / "decisions.parquet"))
    got = catalog.QUERIES["set_overlap_join"](spark, str(tmp_path)).collect()
    assert sorted((r.fate_id, r.decision_id, r.shared) for r in got) == [("f", "d", 2), ("g", "d", 1)]


def test_a_long_wording_of_the_framework_act_is_found(spark, tmp_path):
    long = "Die zuständige Behörde prüft den Antrag und gibt ihn weiter. " * 6
    spark.createDataFrame([(1, "fed_rahmeng", long), (2, "fed_a", long), (3, "fed_a", "kurz")], "change_id bigint, act_id string, new_text string").write.parquet(str(tmp_path / "act_archive.parquet"))
    spark.createDataFrame([(7, "FED_RAHMENG ", f"§ 1 {long}"), (8, "fed_a", f"§ 1 {long} kurz"), (9, "fed_a", long + long)], "doc_id bigint, act_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["substring_count_join"](spark, str(tmp_path)).collect()
    assert sorted((r.change_id, r.doc_id) for r in got) == [(1, 7), (2, 8)]


def test_spread_join_is_the_join(spark):
    from palimpsest.operators import relational

    many = spark.createDataFrame([("hot", i) for i in range(1200)] + [("a", 1), ("a", 1), (None, 2), ("c", 3)], "k string, x int")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("b", 4), (None, 5)], "k string, y int")
    order = lambda frame: sorted(map(tuple, frame.select("k", "x", "y").collect()))
    assert order(relational.spread_join(many, few, "k")) == order(many.join(few, "k"))


def test_only_sides_of_exactly_the_cap_are_truncated(spark):
    from pyspark.sql import functions as F

    from palimpsest.operators import archive

    old, new = "a" * 1300, "b" * 1250
    changes = [(act, label, dt.date(2020, 1, 1), o, n) for act in ("fed_a", "by_a") for label, o, n in (("long", old, new), ("cap", old[:1200], new))]
    frame = spark.createDataFrame(changes, "act_id string, label string, day date, old_text string, new_text string")
    heads = frame.select("act_id", "label", F.col("new_text").alias("body"))
    got = archive.reverse_reconstruction(frame, heads, F.lit("2015-01-01").cast("date"), longest=1200, captured=F.col("act_id").startswith("fed_")).collect()
    assert {(g.act_id, g.label): (g.body, g.applied, g.gaps) for g in got} == {
        ("fed_a", "long"): (old, 1, ""), ("by_a", "long"): (old, 1, ""), ("by_a", "cap"): (old[:1200], 1, ""), ("fed_a", "cap"): (new, 0, "truncated_side")
    }


@needs_tables
def test_gate_counts_every_decision(spark, duck):
    """Against pairs, with the days of p5_found: all spellings, all acts."""
    days = {r.record_id: dt.date.fromisoformat(r.normal) for r in catalog.QUERIES["p5_found"](spark, FOLDER).where("field = 'decision_date' AND normal IS NOT NULL").collect()}
    decisions = duck.execute("SELECT DISTINCT id, lower(trim(e.act_id)) FROM (SELECT id, unnest(effects) AS e FROM decisions) WHERE e.act_id IS NOT NULL").fetchall()
    changes = duck.execute("SELECT DISTINCT change_id, lower(trim(act_id)), effective_date FROM act_archive WHERE effective_date IS NOT NULL").fetchall()
    met = {}
    for change, act, start in changes:
        met.setdefault(change, []).extend(i for i, a in decisions if a == act and i in days and start <= days[i] <= start + dt.timedelta(365))
    expected = sorted((c, ids[0]) for c, ids in met.items() if len(ids) == 1)
    assert sorted(map(tuple, catalog.QUERIES["gate_exactly_one"](spark, FOLDER).select("change_id", "id").collect())) == expected


def test_gate_sees_other_spellings_and_the_framework_act(spark, tmp_path):
    changes = [(1, "fed_a", dt.date(2020, 1, 1)), (2, "fed_rahmeng", dt.date(2020, 1, 1)), (3, "fed_b", dt.date(2019, 6, 1))]
    spark.createDataFrame(changes, "change_id bigint, act_id string, effective_date date").write.parquet(str(tmp_path / "act_archive.parquet"))
    decisions = [("x", "2020-03-01", [("fed_a",)]), ("y", "05.04.2020", [("fed_a",)]), ("z", "2020-12-31", [("fed_rahmeng",)]), ("v", "31.05.2020", [("fed_b",)]), ("w", "unbekannt", [("fed_b",)]), ("u", "01.06.2020", [("fed_b",)])]
    spark.createDataFrame(decisions, "id string, decision_date string, effects array<struct<act_id string>>").write.parquet(str(tmp_path / "decisions.parquet"))
    got = catalog.QUERIES["gate_exactly_one"](spark, str(tmp_path)).collect()
    # 2020-05-31 is the last day of the 365 after 2019-06-01.
    assert sorted(map(tuple, got)) == [(2, "z"), (3, "v")]


def test_open_and_short_lived_overlaps_are_seen(spark):
    from palimpsest.operators import bitemporal

    day, known = dt.date, dt.datetime
    rows = [
        ("a", "A", day(2020, 1, 1), None, known(2024, 1, 5), None), ("a", "B", day(2021, 1, 1), None, known(2024, 2, 7), None),
        ("b", "A", day(2020, 1, 1), day(2022, 1, 1), known(2024, 1, 5), known(2024, 1, 20)), ("b", "B", day(2021, 1, 1), None, known(2024, 1, 10), known(2024, 1, 25)),
        ("c", "A", day(2020, 1, 1), day(2021, 1, 1), known(2024, 1, 5), known(2024, 2, 1)), ("c", "B", day(2020, 6, 1), None, known(2024, 2, 1), None),
        ("d", "A", day(2020, 1, 1), None, None, None), ("d", "B", day(2020, 6, 1), None, None, None),
    ]
    frame = spark.createDataFrame(rows, "act_id string, assertion_id string, effective_from date, effective_to date, knowledge_from timestamp_ntz, knowledge_to timestamp_ntz")
    got = {(r.act_id, r.assertion_id, r.checkpoint) for r in bitemporal.overlaps_known(frame, "act_id").collect()}
    assert got == {("a", "B", known(2024, 2, 7)), ("b", "B", known(2024, 1, 10)), ("d", "B", None)}
