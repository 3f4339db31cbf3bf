"""The general data problems against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
import json
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import asknown, instants, intervals, nested, snapshots, versions

D = dt.date


# -- 1 intervals

_SPANS = "act_id string, f date, t date, k string, s int, chunk int, node int"


def brute_periods(data):
    result = set()
    for act in {r[0] for r in data if r[0] is not None}:
        days, opened = set(), None
        for a, f, t in data:
            if a != act or f is None:
                continue
            if t is None or t >= D(9999, 12, 31):
                opened = f if opened is None else min(opened, f)
            else:
                days |= {f + dt.timedelta(i) for i in range(max(0, (t - f).days))}
        if opened is not None:
            days = {d for d in days if d < opened} | {opened}
        ordered, periods = sorted(days), []
        for d in ordered:
            if periods and periods[-1][1] == d:
                periods[-1][1] = d + dt.timedelta(1)
            else:
                periods.append([d, d + dt.timedelta(1)])
        for i, (a, b) in enumerate(periods):
            last = i == len(periods) - 1
            result.add((act, "period", str(a), "" if last and opened is not None else str(b)))
            if not last:
                result.add((act, "gap", str(b), str(periods[i + 1][0])))
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_periods_and_gaps(spark, seed):
    r = random.Random(seed)
    data = []
    for act in ["a"] * 3 + ["hot"] * 40 + ["b"]:
        f = D(2019, 1, 1) + dt.timedelta(r.randint(0, 2500))
        t = r.choice([f + dt.timedelta(r.choice([-5, 0, 1, 3, 30, 31, 400, 1500])), None if r.random() < 0.1 else f + dt.timedelta(7), D(9999, 12, 31) if r.random() < 0.05 else f])
        data += [(act, f, t)] * r.choice([1, 1, 2])
    data += [("a", None, D(2020, 1, 1)), (None, D(2020, 1, 1), None), ("c", D(2021, 5, 1), D(2021, 4, 1))]
    frame = spark.createDataFrame([(*x, "clash", 1, 2, 3) for x in data], _SPANS)
    got = intervals.periods_and_gaps(frame, "act_id", "f", "t").collect()
    assert len(got) == len(set(got))
    assert {tuple(x) for x in got} == brute_periods(data)


def test_periods_at_the_ends_of_the_calendar(spark):
    data = [("d", D(1, 1, 1), D(1, 1, 2)), ("d", D(9999, 12, 30), D(9999, 12, 31))]
    got = intervals.periods_and_gaps(spark.createDataFrame(data, "act_id string, f date, t date"), "act_id", "f", "t").collect()
    assert {tuple(x)[1:] for x in got} == {("period", "0001-01-01", "0001-01-02"), ("gap", "0001-01-02", "9999-12-30"), ("period", "9999-12-30", "")}


def test_periods_of_nothing(spark):
    assert intervals.periods_and_gaps(spark.createDataFrame([], _SPANS), "act_id", "f", "t").collect() == []


@pytest.mark.parametrize("spans", [[(0, 2048), (5, 6)], [(0, 1024), (1024, 2048)], [(0, 1023), (1023, 5000), (3, 9)], [(1 << 21, 1 << 22), (7, 1 << 21)], [(3, 4000), (4000, 4096), (0, 3)]])
def test_no_block_lies_in_another_or_beside_its_sibling(spark, spans):
    """Also across chunks: the blocks are the canonical decomposition of the union."""
    frame = spark.createDataFrame([("k", a, b) for a, b in spans], "k string, s int, e int")
    got = sorted((r.s, r.e) for r in intervals.interval_blocks(frame, "k", "s", "e").collect())
    union = []
    for a, b in sorted(spans):
        if union and a <= union[-1][1]:
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b])
    expected = []
    for a, b in union:
        while a < b:
            size = min(a & -a or 1 << 22, 1 << ((b - a).bit_length() - 1))
            expected.append((a, a + size))
            a += size
    assert got == expected


def test_dyadic_blocks_are_canonical(spark):
    got = spark.range(1).select(intervals.dyadic_blocks(F.lit(3), F.lit(17)).alias("b")).first().b
    assert [(b.level, b.idx) for b in got] == [(0, 3), (0, 16), (2, 1), (3, 1)]
    assert spark.range(1).select(F.size(intervals.dyadic_blocks(F.lit(5), F.lit(5)))).first()[0] == 0


# -- 2 nested records

_JSON = [
    (1, '{"p1": {"positions": [{"id": "a"}, null, {"id": 7}, {"no": 1}]}, "p2": {"positions": {"id": "lone"}}, "p3": {}}'),
    (2, json.dumps(json.dumps({"x\\\"y": {"positions": json.dumps([{"id": "in \"text\" {[,:]}"}])}}))),
    (3, '{"p": {"positions": {"items": ["{\\"id\\": \\"e\\"}", {"id": null}, {"id": "f"}]}}}'),
    (4, '{"p": {"positions": [{"id": "a"}'),
    (5, ""),
    (6, None),
    (7, "null"),
    (8, '{"p": {"positions": "no json"}, "q": null, "r": []}'),
    (9, ' { "ä" : { "positions" : [ ] , "other" : [ { "id" : "no" } ] } } '),
    (10, "[]"),
    (11, '{"p": {"positions": [{"id": "first", "id": "last"}]}}'),
]


def test_keyed_children(spark, rows):
    frame = spark.createDataFrame(_JSON, "state_id bigint, procedures string").withColumn("parent", F.lit("clash")).withColumn("body", F.lit("clash"))
    got = rows(nested.keyed_children(frame, "state_id", "procedures", "procedures", "positions", "id"))
    assert got == sorted(
        [
            ("1", "procedures", 0, "p1"), ("1", "procedures", 0, "p2"), ("1", "procedures", 0, "p3"),
            ("1/p1", "procedures.positions", 0, "a"), ("1/p1", "procedures.positions", 2, "7"), ("1/p2", "procedures.positions", 0, "lone"),
            ("2", "procedures", 0, 'x\\"y'), ('2/x\\"y', "procedures.positions", 0, 'in "text" {[,:]}'),
            ("3", "procedures", 0, "p"), ("3/p", "procedures.positions", 0, "e"), ("3/p", "procedures.positions", 2, "f"),
            ("8", "procedures", 0, "p"), ("8", "procedures", 0, "q"), ("8", "procedures", 0, "r"), ("9", "procedures", 0, "ä"),
            ("11", "procedures", 0, "p"), ("11/p", "procedures.positions", 0, "last"),
        ],
        key=repr,
    )


def test_list_children(spark, rows):
    data = [("f1", '[{"role": "draft"}, null, "{\\"role\\": \\"vote\\"}", {"role": null}]'), ("f2", '{"items": {"role": "only"}}'), ("f3", json.dumps('[{"role": "x"}]')), ("f4", '{"role": "lone"}'), ("f5", "{"), (None, None)]
    got = rows(nested.list_children(spark.createDataFrame(data, "id string, c string"), "id", "c", "chain", "role"))
    assert got == [("f1", "chain", 0, "draft"), ("f1", "chain", 2, "vote"), ("f2", "chain", 0, "only"), ("f3", "chain", 0, "x"), ("f4", "chain", 0, "lone")]
    assert nested.list_children(spark.createDataFrame([], "id string, c string"), "id", "c", "chain", "role").collect() == []


def test_structural_index_of_random_json():
    r = random.Random(3)

    def value(depth):
        kind = r.randint(0, 6 if depth else 3)
        if kind < 4:
            return [None, r.randint(-9, 9), r.choice(['"', "\\", "{", "],", "ä\n", "a\\\"b", ""]), True][kind]
        return [value(depth - 1) for _ in range(r.randint(0, 4))] if kind < 6 else {r.choice("abc\\\"{"): value(depth - 1) for _ in range(r.randint(0, 3))}

    docs = [value(4) for _ in range(200)]
    texts = [json.dumps(d, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for d in docs]
    index = nested.StructuralIndex(texts + ["[1", '{"a"', "", None, "]["])
    assert index.well_formed[:200].all() and not index.well_formed[200:].any()
    for doc, (d, v0, v1) in zip(docs, index.roots()[["doc", "v0", "v1"]].itertuples(index=False)):
        assert json.loads(index.buffer[v0:v1]) == doc
        if isinstance(doc, (list, dict)):
            inner = index.members[index.members.box == v0]
            parsed = [json.loads(index.buffer[a:b]) for a, b in zip(inner.v0, inner.v1)]
            assert parsed == (doc if isinstance(doc, list) else list(doc.values()))


def _strict(text):
    def reject(word):
        raise ValueError(word)

    try:
        json.loads(text, parse_constant=reject)
    except ValueError:
        return False
    return True


@pytest.mark.parametrize("seed", range(3))
def test_the_grammar_is_that_of_a_json_reader(seed):
    """Texts with random changes, indexed in one batch: valid are those that a strict reader takes."""
    r = random.Random(seed)
    bases = ['{"a": [1, -2.5e3, {"b": "x\\"y\\u00e9"}, null, true], "c": {}, "d": []}', '["", "\\\\", {"k": [[[]]]}]', ' 12 ', '"lone"', "{}", '[{"a":"b"},{"a":"ü,:{"}]']
    texts = []
    for _ in range(4000):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            at = r.randrange(len(t) + 1)
            t[at : at + r.choice([0, 1])] = r.choice(list('{}[],:"\\ \t\n01-.eEtu/ä') + ["", "null", "NaN", "\x01", "[]", ',"']) if r.random() < 0.8 else ""
        texts.append("".join(t))
    index = nested.StructuralIndex(texts)
    wrong = [(t, ok) for t, ok in zip(texts, index.well_formed) if ok != _strict(t)]
    assert not wrong, wrong[:5]
    assert 500 < index.well_formed.sum() < 3500 and set(index.members["doc"]) <= set(index.well_formed.nonzero()[0])


def test_any_number_of_encodings_and_any_depth(spark, rows):
    text = json.dumps([{"role": "x"}])
    for _ in range(10):
        text = json.dumps(text)
    deep = "[" * 20_000 + "bad bad" + "]" * 20_000
    got = rows(nested.list_children(spark.createDataFrame([("e", text), ("d", f'[{{"role": "y", "z": {deep}}}]'), ("s", '[{"role": "\\ud800 \\ud83d\\ude00"}]')], "id string, c string"), "id", "c", "chain", "role"))
    assert got == [("e", "chain", 0, "x"), ("s", "chain", 0, "\ufffd \U0001f600")]


def test_very_deep_and_very_long_json(spark, rows):
    deep, long_text = "[" * 5000 + "]" * 5000, json.dumps([{"role": "x" * 3_000_000}, {"role": "y"}])
    got = rows(nested.list_children(spark.createDataFrame([("d", deep), ("l", long_text)], "id string, c string"), "id", "c", "chain", "role"))
    assert [(r[0], r[2], len(r[3])) for r in got] == [("l", 0, 3_000_000), ("l", 1, 1)]


def test_struct_children(spark, rows):
    data = [("d1", [("A ", ["1", None, "2"]), None, (None, None), ("b", [])]), ("d2", None), ("d3", [])]
    frame = spark.createDataFrame(data, "id string, effects array<struct<act_id string, paras array<string>>>")
    assert rows(nested.struct_children(frame, "id", "effects", "act_id", "paras")) == [
        ("d1", "effects", 0, "a"), ("d1", "effects", 3, "b"), ("d1/0", "effects.paras", 0, "1"), ("d1/0", "effects.paras", 2, "2")
    ]


# -- 3 as known


def test_as_known(spark, rows):
    r = random.Random(4)
    day = lambda: D(2015, 1, 1) + dt.timedelta(r.randint(0, 4000))
    at = lambda: dt.datetime(2022, 1, 1) + dt.timedelta(hours=r.randint(0, 30000))
    known = []
    for i in range(120):
        f, k = day(), at()
        known.append((r.choice("ab"), f"x{i}", f, r.choice([None, f + dt.timedelta(r.randint(-3, 3000))]), k, r.choice([None, k + dt.timedelta(days=r.randint(-2, 700))])))
    known += [("a", "null", None, None, at(), None), (None, "key", day(), None, at(), None)] + known[:5]
    events = [(i, r.choice("abc"), r.choice([None] + [day()] * 9), at()) for i in range(300)] + [(999, None, day(), at()), (998, "a", day(), None), (0, "a", D(2020, 1, 1), at()), (997, "a", day(), dt.datetime(9998, 1, 1)), (996, "b", D(1, 1, 2), at()), (995, "b", D(9999, 12, 30), dt.datetime(1600, 1, 1))]
    e = spark.createDataFrame([(*x, 1, "c") for x in events], "event bigint, key string, effective_date date, recorded_at timestamp_ntz, period int, cell string")
    a = spark.createDataFrame([(*x, 2) for x in known], "key string, assertion string, effective_from date, effective_to date, knowledge_from timestamp_ntz, knowledge_to timestamp_ntz, period int")
    expected = {
        (ev, n)
        for ev, k, d, t in events
        for k2, n, f, to, kf, kt in known
        if None not in (k, d, t, f, k2) and k == k2 and f <= d and (to is None or d < to) and kf <= t and (kt is None or t < kt)
    }
    got = rows(asknown.as_known(e, a))
    assert len(got) == len(expected) and set(got) == expected
    snapshots, log = asknown.snapshots_and_log(a, list(range(100, 111)), (30, 45))
    assert {r.change for r in log.collect()} == {1, -1} and snapshots.where("period < 100 OR period > 110").count() == 0
    assert asknown.as_known(e.limit(0), a).collect() == [] and asknown.as_known(e, a.limit(0)).collect() == []


# -- 5 instants

_CASES = [
    ("2023-06-09T08:36:37+00:00", None, "2023-06-09T08:36:37Z"), ("01.09.2023 10:13:51", "Europe/Berlin", "2023-09-01T08:13:51Z"),
    ("2024-10-27 02:30:00", "Europe/Berlin", "2024-10-27T00:30:00Z"), ("2024-03-31 02:30:00", "Europe/Berlin", None),
    ("2019-09-28T09:02:16.160Z", None, "2019-09-28T09:02:16Z"), ("2021-11-19T17:40", "Europe/Helsinki", "2021-11-19T15:40:00Z"),
    ("1695710682", None, "2023-09-26T06:44:42Z"), ("1667908365082", None, "2022-11-08T11:52:45Z"), ("20190110T094010+0200", None, "2019-01-10T07:40:10Z"),
    ("31/8/2019 08.57", "Europe/Dublin", "2019-08-31T07:57:00Z"), ("09.08.2016, 01:19 Uhr CEST", None, "2016-08-08T23:19:00Z"),
    ("17. Juli 2024, 04:10 Uhr", "Europe/Berlin", "2024-07-17T02:10:00Z"), ("2023-02-18 08:44:36 Europe/Berlin", None, "2023-02-18T07:44:36Z"),
    ("2021-03-12T04:56:02+02:00[Europe/Helsinki]", None, "2021-03-12T02:56:02Z"), ("Mon, 25 Apr 2016 22:21:26 GMT", None, "2016-04-25T22:21:26Z"),
    ("20231345101500", "Europe/Berlin", None), ("2023-02-30T10:15:00Z", None, None), ("2023-02-18 08:44:36 Mars/Base", "Europe/Berlin", None),
    ("2024-02-29T24:00:00Z", None, None), ("2024-02-29T23:60:00Z", None, None), ("2021-03-03 07:55:09", None, None), ("unbekannt", "Europe/Berlin", None), ("", "Europe/Berlin", None), (None, "Europe/Berlin", None),
    ("x" * 100_000, "Europe/Berlin", None),
    ("2001-03-09", "Europe/Berlin", "day 2001-03-09"), ("05.11.2001", "Europe/Berlin", "day 2001-11-05"), ("20030902", None, "day 2003-09-02"), ("1/10/2018", None, "day 2018-10-01"),
    ("٢٠٢٣-٠٦-٠٩", None, None), ("29. Februar 2023", None, None), ("29 février 2024", None, "day 2024-02-29"), ("1er août 2012", None, "day 2012-08-01"), ("14 June 2022", None, "day 2022-06-14"), ("June 14, 2022", None, "day 2022-06-14"), ("2018", None, None), ("August 2012", None, None),
]


def test_instants(spark):
    frame = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(_CASES)], "i int, v string, z string").select("i", instants.parsed(F.col("v"), F.col("z")).alias("p"))
    text = F.coalesce(F.concat(F.lit("day "), instants.day_text(F.col("p.day"))), instants.instant_text(F.col("p.utc")))
    got = {r.i: r.t for r in frame.select("i", text.alias("t")).collect()}
    assert {i: got[i] for i in got} == {i: c[2] for i, c in enumerate(_CASES)}


def test_local_times_of_a_year(spark):
    """Every half hour around both changes of clocks, against the standard library."""
    zone = ZoneInfo("Europe/Berlin")
    walls = [dt.datetime(2025, m, d, h, n) for m, d in ((3, 30), (10, 26)) for h in range(24) for n in (0, 30)]
    expected = []
    for w in walls:
        u = w.replace(tzinfo=zone, fold=0).astimezone(dt.timezone.utc)
        expected.append(int(u.timestamp()) if u.astimezone(zone).replace(tzinfo=None) == w else None)
    seconds = [(i, int(w.replace(tzinfo=dt.timezone.utc).timestamp())) for i, w in enumerate(walls)]
    got = spark.createDataFrame(seconds, "i int, s bigint").select("i", instants.local_to_utc(F.col("s"), F.lit("Europe/Berlin"))).orderBy("i").collect()
    assert [r[1] for r in got] == expected


# -- 6 snapshots


@pytest.mark.parametrize("seed", [5, 6])
def test_snapshot_changes(spark, seed):
    r = random.Random(seed)
    days, acts = [D(2025, 1, 1) + dt.timedelta(7 * i) for i in range(6)], [f"act{i}" for i in range(60)]
    data, state = [], {}
    for day in days:
        for act in acts:
            if r.random() < 0.1:
                state.pop(act, None)
            elif r.random() < 0.2:
                state[act] = r.choice("pqr")
            if act in state:
                data.append((act, day, dt.datetime(2025, 1, 1, 5), None if r.random() < 0.1 else state[act]))
                if r.random() < 0.1:
                    data.append((act, day, dt.datetime(2025, 1, 1, r.choice([3, 8])), r.choice("pqr")))
    data += data[:10] + [(None, days[0], None, "p"), ("z", None, None, "p")]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in data], "act_id string, observed_at date, received_at timestamp_ntz, digest string, key string, number int")
    best = {}
    for a, d, t, g in data:
        if a and d and (a, d) not in best or a and d and (t, g is not None, g or "") > best[a, d]:
            best[a, d] = (t, g is not None, g or "")
    before, expected = {}, set()
    for i, day in enumerate(days):
        now = {a: best[a, day][2] or before.get(a) for a in acts if (a, day) in best}
        if i:
            expected |= {(a, day, "added") for a in now.keys() - before.keys()} | {(a, day, "removed") for a in before.keys() - now.keys()} | {(a, day, "changed") for a in now.keys() & before.keys() if now[a] != before[a]}
        before = now
    got = [tuple(x) for x in snapshots.snapshot_changes(frame, "act_id", "observed_at", "received_at", "digest", buckets=3).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_snapshot_digests(spark):
    h = "AB" * 32
    cases = [(h, h.lower()), ("sha256:" + h.lower(), h.lower()), (h + " ", h.lower()), ("none", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, d string").orderBy("i").select(snapshots.normal_digest(F.col("d"))).collect()]
    assert got == [c[1] for c in cases]


# -- 7 versions


@pytest.mark.parametrize("seed", [7, 8])
def test_versions(spark, seed):
    r = random.Random(seed)
    data = []
    for i in range(400):
        data.append((r.choice(["hot"] * 5 + ["a", "b", "c"]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randint(0, 90000)), r.choice("xy"), r.choice(["s", None]), f"e{i}"))
    data += [(None, dt.datetime(2024, 1, 1), "x", "s", "n1"), ("a", None, "x", "s", "n2")]
    frame = spark.createDataFrame([(*x, 1, "c") for x in data], "id string, at timestamp_ntz, status string, stage string, event string, period int, key string")
    expected = []
    for key in ["hot", "a", "b", "c"]:
        runs = []
        for _, at, s, g, _e in sorted((x for x in data if x[0] == key and x[1]), key=lambda x: (x[1], x[4])):
            if not runs or runs[-1][:2] != (s, g):
                runs.append((s, g, at))
        expected += [(key, s, g, at, runs[i + 1][2] if i + 1 < len(runs) else None) for i, (s, g, at) in enumerate(runs)]
    got = [tuple(x) for x in versions.versions(frame, "id", "at", ["status", "stage"], "event").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert versions.versions(frame.limit(0), "id", "at", ["status", "stage"], "event").collect() == []


def test_nfc_and_micros(spark):
    got = spark.createDataFrame([(" Länder ", dt.datetime(2024, 1, 2, 3, 4, 5, 60)), (None, dt.datetime(2024, 1, 2))], "t string, a timestamp_ntz").select(versions.trimmed_nfc(F.col("t")), versions.micros_text(F.col("a"))).collect()
    assert [tuple(x) for x in got] == [("L\u00e4nder", "2024-01-02T03:04:05.000060Z"), (None, "2024-01-02T00:00:00.000000Z")]


def test_only_differing_leaves_are_read(spark):
    """A period whose events change nothing has no open leaf."""
    data = [("k", dt.datetime(2024, 1, 1 + 7 * i), "x", "s", str(i)) for i in range(4)]
    frame = spark.createDataFrame(data, "id string, at timestamp_ntz, status string, stage string, event string")
    assert versions.versions(frame, "id", "at", ["status", "stage"], "event").count() == 1
    summaries = spark.createDataFrame([("k", 1, 5, 10, 10, 10), ("k", 2, 5, 10, 10, 11), ("m", 2, 9, 3, 3, 3)], "key string, period int, leaf int, entering bigint, least bigint, greatest bigint")
    assert [tuple(x) for x in versions.changed_leaves(summaries).collect()] == [(2, 5)]
