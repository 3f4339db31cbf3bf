"""Sources and sinks on small files."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from palimpsest.operators.validate import IntegrityError
from palimpsest.sources import documents, sinks, snapshots

SCHEMA = StructType([StructField("slug", StringType()), StructField("n", LongType())])


def put(root, source, day, name, text):
    folder = os.path.join(root, f"source={source}", f"day={day}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_latest_snapshot(spark, tmp_path, rows, monkeypatch):
    root = str(tmp_path)
    put(root, "gii", "2025-01-01", "acts.jsonl", '{"slug": "old", "n": 1}\n')
    put(root, "gii", "2025-02-01", "acts.jsonl", '{"slug": "a", "n": 1}\n\n{"slug": "b", "n": null}\n')
    put(root, "gii", "2025-13-01", "acts.jsonl", '{"slug": "no day", "n": 1}\n')
    assert snapshots.days(spark, root, "gii") == ["2025-01-01", "2025-02-01"]
    assert rows(snapshots.latest(spark, root, "gii", SCHEMA, "acts.jsonl")) == [("a", 1), ("b", None)]
    assert rows(snapshots.latest(spark, root, "gii", SCHEMA, "missing.jsonl")) == []
    assert rows(snapshots.latest(spark, root, "unknown", SCHEMA)) == []
    put(root, "secondary_versions", "2025-02-01", "x.jsonl", '{"slug": "q", "n": 1}\n')
    assert rows(snapshots.latest(spark, root, "secondary_versions", SCHEMA)) == []
    monkeypatch.setenv(snapshots.ALLOW, "1")
    assert rows(snapshots.latest(spark, root, "secondary_versions", SCHEMA)) == [("q", 1)]


def test_strict_lines(spark, tmp_path, rows):
    good, bad = str(tmp_path / "good.jsonl"), str(tmp_path / "bad.jsonl")
    open(good, "w").write('{"slug": "a", "n": 1}\n\n')
    open(bad, "w").write('{"slug": "a", "n": 1}\n{"slug": \n')
    assert rows(snapshots.read_jsonl_strict(spark, good, SCHEMA)) == [("a", 1)]
    with pytest.raises(Exception, match="not a JSON object in .*bad.jsonl"):
        snapshots.read_jsonl_strict(spark, bad, SCHEMA).collect()


def test_newest_file_and_complete_days(spark, tmp_path):
    root = str(tmp_path)
    put(root, "rii", "2025-01-01", "d.jsonl", "{}\n")
    put(root, "rii", "2025-02-01", "d.jsonl", "")
    put(root, "rii", "2025-01-01", "e.jsonl", "{}\n")
    assert snapshots.newest_file(spark, root, "rii", "d.jsonl").endswith("day=2025-01-01/d.jsonl")
    assert snapshots.newest_file(spark, root, "rii", "x.jsonl") is None
    assert snapshots.complete_days(spark, root, "rii", ["d.jsonl", "e.jsonl"]) == ["2025-01-01"]


def test_prune_needs_every_proof(spark, tmp_path):
    root = str(tmp_path)
    for day in ("2025-01-01", "2025-01-02"):
        put(root, "gii", day, "acts.jsonl", "{}\n")
    frame = lambda *d: spark.createDataFrame([(x,) for x in d], "digest string")
    with pytest.raises(IntegrityError, match="2025-01-02: 1 rows"):
        snapshots.prune(spark, root, "gii", {"2025-01-01": frame("a"), "2025-01-02": frame("b")}, frame("a"), "digest")
    assert snapshots.days(spark, root, "gii") == ["2025-01-01", "2025-01-02"]
    assert snapshots.prune(spark, root, "gii", {"2025-01-01": frame("a")}, frame("a"), "digest") == ["2025-01-01"]
    assert snapshots.days(spark, root, "gii") == ["2025-01-02"]


LAW = """<dokumente builddate="20240101" doknr="BJ1"><norm doknr="BJ1N1"><metadaten><jurabk>AG</jurabk><langue>Altes Gesetz</langue><standangabe><standtyp>Stand</standtyp><standkommentar>neu</standkommentar></standangabe></metadaten></norm>
<norm doknr="N2"><metadaten><jurabk>AG</jurabk><gliederungseinheit><gliederungsbez>Teil 1</gliederungsbez><gliederungstitel>Anfang</gliederungstitel></gliederungseinheit></metadaten></norm>
<norm doknr="N3"><metadaten><jurabk>AG</jurabk><enbez>§ 1</enbez><titel>Zweck</titel></metadaten><textdaten><text><Content><P>Der <B>Zweck</B> &amp; das Ziel.</P><P>(2) Mehr.</P></Content></text></textdaten></norm>
<norm doknr="N4"><metadaten><enbez>§ 1</enbez></metadaten></norm></dokumente>"""


def test_parse_law(spark, rows):
    acts, norms = documents.parse_law(spark.createDataFrame([("ag", LAW), ("bad", "<dokumente><norm>"), ("none", None)], "slug string, xml string"), "slug", "xml")
    got = {r.slug: r for r in acts.collect()}
    assert (got["ag"].jurabk, got["ag"].long_title, got["ag"].stand, got["ag"].builddate, got["ag"].doknr, got["ag"].norm_count) == ("AG", "Altes Gesetz", "Stand: neu", "20240101", "BJ1", 2)
    assert got["none"].norm_count == 0 and got["bad"].norm_count == 0
    assert rows(norms) == [("ag", 2, "AG", "§ 1", "Zweck", "Teil 1 Anfang", "Der Zweck & das Ziel. (2) Mehr.", "N3"), ("ag", 3, "AG", "§ 1", "", "Teil 1 Anfang", "", "N4")]


def test_parse_toc_and_feed(spark, rows):
    toc = "<items><item><title>Altes  Gesetz</title><link>http://x.example/AG/xml.zip</link></item><item><title>Zweites</title><link>http://x.example/ag/xml.zip?v=1</link></item><item><title/><link>http://x.example/b/xml.zip</link></item></items>"
    assert rows(documents.parse_toc(spark.createDataFrame([(1, toc)], "k int, xml string"), "k", "xml")) == [("ag", "Altes Gesetz", "http://x.example/AG/xml.zip")]
    rss = "<rss><channel><item><title> T </title><link>http://x.example/e/12</link><pubDate>Mon, 5 Feb 2024 10:00:00 GMT</pubDate></item><item><title>U</title><link>http://x.example/none</link></item></channel></rss>"
    good, bad = documents.parse_feed(spark.createDataFrame([(1, rss)], "k int, xml string"), "k", "xml", r"/e/(\d+)$")
    assert [(r.item_id, r.title, str(r.day)) for r in good.collect()] == [("12", "T", "2024-02-05")] and bad.count() == 1


def test_html_rows_and_lists(spark):
    page = "<table><TR class='x'><td>A <b>b</b></td><th> c\n</th></TR><tr></tr></table>"
    assert spark.createDataFrame([(page,)], "p string").select(documents.html_rows(F.col("p"))).first()[0] == [["A b", "c"], []]
    values = [('"one"', ["one"]), ('["a", "b"]', ["a", "b"]), ("null", []), (None, []), ("7", ["7"])]
    got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(values)], "i int, v string").orderBy("i").select(documents.listed(F.col("v"))).collect()
    assert [r[0] for r in got] == [e for _, e in values]


def test_paged_source(spark, tmp_path):
    pages = {"start": {"documents": [{"id": 1}, {"id": 2}], "cursor": "b"}, "b": {"documents": [{"id": 3}], "cursor": "b"}}
    for name, page in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(page))
    spark.dataSource.register(documents.PagedSource)
    got = spark.read.format("paged").option("path", str(tmp_path)).load()
    assert sorted(json.loads(r.row)["id"] for r in got.collect()) == [1, 2, 3]


def test_archives_and_variants(spark, tmp_path, rows):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.xml", "<d>ä</d>")
        z.writestr("b.txt", "no")
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    (tmp_path / "y.zip").write_bytes(b"broken")
    got = documents.unzip_texts(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((os.path.basename(r.path), r.member, r.text) for r in got) == [("x.zip", "a.xml", "<d>ä</d>"), ("y.zip", None, None)]
    variants = spark.createDataFrame([("k", "long " * 50), ("k", "Artikel 1\n§ 1")], "k string, t string")
    assert documents.best_variant(variants, "k", "t").first().t.startswith("Artikel")
    log = spark.createDataFrame([(["w1", " "], ["w2"])], "c array<string>, d array<string>")
    assert rows(documents.changelog_events(log, "c", "d")) == [("w1", "changed"), ("w2", "deleted")]
    assert spark.createDataFrame([("<p>a<i>b</i>c</p><p>&auml;</p>",)], "x string").select(documents.mixed_text(F.col("x"), "p")).first()[0] == ["a b c", "ä"]
    first = spark.createDataFrame([("k", 1, None, "1800-01-01"), ("k", 2, "t", "2000-01-01")], "k string, o int, t string, d string").withColumn("d", F.col("d").cast("date"))
    assert [(r.t, str(r.d)) for r in documents.first_value(first, "k", "o", ["t", "d"], "d").collect()] == [("t", "2000-01-01")]


def test_atomic_and_objects(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.write_atomic(frame, path)
    with pytest.raises(IntegrityError):
        sinks.write_atomic(frame.limit(0), path, gates={"some rule": frame})
    assert rows(spark.read.parquet(path)) == [(1, "a")]
    sinks.write_atomic(frame.withColumn("v", F.lit("b")), path)
    assert rows(spark.read.parquet(path)) == [(1, "b")]

    store = str(tmp_path / "objects")
    bodies = spark.createDataFrame([("x",), ("y",), ("x",)], "canonical_json string").withColumn("state_sha256", F.sha2("canonical_json", 256))
    assert sinks.store_objects(bodies, store) == 2 and sinks.store_objects(bodies, store) == 0
    with pytest.raises(IntegrityError):
        sinks.store_objects(bodies.withColumn("state_sha256", F.lit("00")), store)
    assert spark.read.parquet(store).count() == 2


def test_relational_and_ordinal(spark, tmp_path, rows):
    acts, obs = spark.createDataFrame([("a",), ("b",)], "act_id string"), spark.createDataFrame([("a", 1), ("b", 2)], "act_id string, day int")
    sinks.write_relational({"acts": acts, "observations": obs}, str(tmp_path / "db"), {"acts": ["act_id"], "observations": ["act_id", "day"]}, [("observations", "act_id", "acts", "act_id")])
    assert spark.read.parquet(str(tmp_path / "db/observations")).count() == 2
    with pytest.raises(IntegrityError, match="observations.act_id without acts"):
        sinks.write_relational({"acts": acts.limit(0), "observations": obs}, str(tmp_path / "db2"), {}, [("observations", "act_id", "acts", "act_id")])
    sinks.write_ordinal(spark.range(1000).select((F.lit(2000) - F.col("id")).alias("x")), str(tmp_path / "o"), ["x"])
    got = spark.read.parquet(str(tmp_path / "o")).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(1000)) and [r.x for r in got] == sorted(r.x for r in got)


def test_export_refuses(spark, tmp_path):
    frame = spark.createDataFrame([(1, None)], "k int, v string")
    with pytest.raises(PermissionError):
        sinks.export_dataset({"t": frame}, str(tmp_path / "e"), public=False)
    with pytest.raises(IntegrityError):
        sinks.export_dataset({"t": frame}, str(tmp_path / "e"), public=True, reviewed={"t": frame})
    sinks.export_dataset({"t": frame}, str(tmp_path / "e"), public=True)
    assert spark.read.text(str(tmp_path / "e/t")).first()[0] == '{"k":1,"v":null}'


def test_arena_blobs():
    from palimpsest.functions import arena

    edges = [("v-1", "v-2", "cites", 3, 0.73), ("v-é", "", "", 0, -1.5)]
    blob = arena.pack(edges)
    assert arena.unpack(blob) == edges and len(blob) == 3 * arena.ALIGNMENT and arena.unpack(arena.pack([])) == []
    for bad in (b"", blob[:-1], blob + b"\0", b"XXXX" + blob[4:]):
        with pytest.raises(ValueError):
            arena.unpack(bad)
    with pytest.raises(ValueError):
        arena.pack([("x" * 19, "", "", 0, 0.0)])


def test_pages_and_registers(spark):
    from palimpsest.sources import documents

    page = '<meta name="title" content="A &amp; B"><meta name="date" content="2024-02-30"> MD5-Hash: ' + "AB" * 16
    register = "<dl><dt>A</dt><dd>1</dd><dt> B <i>c</i></dt>\n<dd>x <b>y</b></dd><dt>A</dt><dd>2</dd></dl>"
    got = spark.createDataFrame([(page, register), ("", "<p>none</p>"), (None, None)], "p string, r string").select(documents.official_page(F.col("p")).alias("p"), documents.register_entries(F.col("r")).alias("r")).collect()
    assert tuple(got[0].p) == ("A &amp; B", None, "ab" * 16) and got[0].r == {"A": "2", "B c": "x y"}
    assert tuple(got[1].p) == (None, None, None) and got[1].r == {} and got[2].r is None


def test_the_index_names_every_endpoint():
    from palimpsest import api

    found = {e["endpoint"]: e["parameters"] for e in api.index()}
    assert found["find"] == {"q": "", "limit": "25"} and "index" not in found and {"changes", "diff", "history", "markdown", "citations", "decisions", "blame", "stats"} <= set(found)
