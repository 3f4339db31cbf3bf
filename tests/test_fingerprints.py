"""Wordings found in texts by fingerprints: nothing contained is missed, and a hot key is not compared pair by pair."""

import random

import pyarrow as pa
import pytest

from palimpsest.functions import fingerprints
from palimpsest.operators import relational
from palimpsest.plans import catalog

WORDS = "Behörde Antrag Frist § 12 Absatz prüft gewährt „Bescheid“ naïve 漢字 🙂 der die das und".split()


def _text(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(words))


def _missed(wordings: list[str], texts: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Number of pairs in which the wording occurs, and those of them without a common fingerprint."""
    marks = fingerprints.of_wordings(pa.array(wordings)).tolist()
    known = [set() for _ in texts]
    for rows, values in fingerprints.of_texts(pa.array(texts)):
        for row, value in zip(rows.tolist(), values.tolist()):
            known[row].add(value)
    inside = [(i, k) for i, w in enumerate(wordings) for k, t in enumerate(texts) if w in t]
    return len(inside), [(i, k) for i, k in inside if marks[i] not in known[k]]


def test_a_contained_wording_shares_a_fingerprint():
    rng = random.Random(1)
    texts = ["", "kurz", "x" * 39, "x" * 40, *(_text(rng, n) for n in (3, 10, 40, 200, 900) for _ in range(12))]
    wordings = ["x" * 40]
    for text in texts:
        for span in (40, 41, 55, 56, 79, 80, 111, 112, 300, 1000):
            at = rng.randrange(max(1, len(text) - span + 1))
            # Anywhere, at the start and at the end.
            wordings += [w for w in (text[at : at + span], text[:span], text[-span:]) if len(w) >= 40]
    pairs, missed = _missed(wordings, texts)
    assert pairs >= len(wordings) and not missed


def test_texts_longer_than_a_block_are_covered():
    rng = random.Random(2)
    text = "".join(chr(rng.randrange(97, 123)) for _ in range(2 * fingerprints._BLOCK + 5000))
    sizes = (40, 300, 28671, 28672, 28673, 200_000, fingerprints._BLOCK + 1)
    wordings = [text[at : at + n] for n in sizes for at in (0, 7, fingerprints._BLOCK - n // 2, len(text) - n) if at >= 0]
    pairs, missed = _missed([*wordings, text], ["vor", text, text[: fingerprints._BLOCK]])
    assert pairs > len(wordings) and not missed


def test_slices_and_short_wordings():
    texts = pa.array([None, "a" * 50, "b" * 50, "c" * 50])
    assert [r.tolist() for r, _ in fingerprints.of_texts(texts.slice(2))] == [[0, 1]]
    assert fingerprints.of_wordings(texts.slice(2)).tolist() == fingerprints.of_wordings(texts.slice(1)).tolist()[1:]
    assert list(fingerprints.of_texts(texts.slice(4))) == []
    with pytest.raises(ValueError, match="less than 40 bytes"):
        fingerprints.of_wordings(pa.array(["a" * 39]))


def test_a_hot_act_is_whole_and_not_compared_pair_by_pair(spark, tmp_path, monkeypatch):
    """Against SQL, with null and repeated ids, repeated wordings and texts; 900 changes meet 300 texts of one act."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    texts = [_text(rng, rng.choice((8, 30, 120))) for _ in range(300)]
    cut = lambda t: t[(at := rng.randrange(max(1, len(t) - 45))) : at + rng.choice((40, 60, 90, 400))]
    wordings = [cut(rng.choice(texts)) if rng.random() < 0.7 else _text(rng, 20) for _ in range(600)]
    wordings += [rng.choice(wordings) for _ in range(297)] + [None, "kurz", texts[0]]
    changes = [(i % 880 or None, rng.choice(("fed_hot", " FED_HOT")), w) for i, w in enumerate(wordings)]
    changes += [(2000 + i, act, texts[i]) for i, act in enumerate(("fed_a", "fed_b", None))]
    documents = [(i % 295 or None, "fed_hot", t) for i, t in enumerate(texts)] + [(500, "fed_hot", texts[0])] * 2 + [(501, "fed_hot", texts[0] + texts[0]), (502, "fed_a", texts[0] + "."), (503, None, texts[2]), (504, "fed_hot", None)]
    spark.createDataFrame(changes, "change_id bigint, act_id string, new_text string").write.parquet(str(tmp_path / "act_archive.parquet"))
    spark.createDataFrame(documents, "doc_id bigint, act_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    for name in ("act_archive", "documents"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    expected = connection.execute(catalog.SQL["substring_count_join"]).fetchall()

    compared, join = [], relational.spread_join

    def spy(many, few, key):
        compared.append(many.join(few, key).count())
        return join(many, few, key)

    monkeypatch.setattr(relational, "spread_join", spy)
    got = catalog.QUERIES["substring_count_join"](spark, str(tmp_path)).collect()
    assert len(expected) > 500 and sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    # Only the pair of fed_a.
    assert sum(compared) == 1
