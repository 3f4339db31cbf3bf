"""The query surface: envelopes, paging and error mapping."""

import os

import pytest

from palimpsest import api
from palimpsest.operators.validate import AmbiguityError, NotFoundError, RequestError

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


def test_pages(spark):
    first = api.changes(spark, FOLDER, q="behörde", limit=5).collect()
    assert len(first) == 5 and len({r.matched for r in first}) == 1 and first[0].matched > 5
    second = api.changes(spark, FOLDER, q="BEHÖRDE", limit=5, offset=5).collect()
    assert not {(r.change_id, r.label) for r in first} & {(r.change_id, r.label) for r in second}
    assert api.official_states(spark, FOLDER, limit=3).count() == 3 and api.feed(spark, FOLDER, 7).count() == 7
    assert api.stats(spark, FOLDER).count() == 1


def test_bad_requests(spark):
    for call in (
        lambda: api.changes(spark, FOLDER, limit=0),
        lambda: api.changes(spark, FOLDER, start="2024-01-01", end="2023-01-01"),
        lambda: api.history(spark, FOLDER, "fed_rahmeng", as_of="2024-06-01T00:00:00"),
        lambda: api.history(spark, FOLDER, "fed_rahmeng", as_of="gestern"),
        lambda: api.citations(spark, FOLDER, "fed_rahmeng", direction="in"),
        lambda: api.find(spark, FOLDER, "???"),
        lambda: api.feed(spark, FOLDER, 601),
    ):
        with pytest.raises(RequestError):
            call()
    with pytest.raises(NotFoundError):
        api.decision(spark, FOLDER, "../etc")


def test_checkout_and_diff(spark):
    row = api.history(spark, FOLDER, " FED_RAHMENG ").where("effective_to IS NOT NULL").first()
    at = str(row.effective_from)
    try:
        assert api.checkout(spark, FOLDER, "fed_rahmeng", at)["assertion_id"] == row.assertion_id
    except AmbiguityError:
        pytest.fail("the current assertions overlap")
    with pytest.raises(NotFoundError):
        api.checkout(spark, FOLDER, "fed_rahmeng", "1900-01-01")
    assert set(api.diff(spark, FOLDER, "fed_rahmeng", "2012-01-01", "2020-01-01").columns) == {"label", "operation"}
    assert api.diff(spark, FOLDER, "fed_rahmeng", "2020-01-01", "2020-01-01").count() == 0
    assert api.markdown(spark, FOLDER, "fed_rahmeng", "2030-01-01").first().markdown.startswith("---\nact: fed_rahmeng")
    assert api.blame(spark, FOLDER, "fed_rahmeng", "2030-01-01").count() > 0 and api.archive_days(spark, FOLDER, "fed_rahmeng").count() > 0


def test_lookups(spark):
    found = api.find(spark, FOLDER, "Behörde", limit=5).collect()
    assert len(found) == 5 and [r.score for r in found] == sorted((r.score for r in found), reverse=True) and "ehörde" in found[0].snippet
    cited = api.decisions(spark, FOLDER, act="fed_rahmeng").collect()
    assert cited and all(e.act_id == "fed_rahmeng" for r in cited for e in r.effects)
    assert api.decision(spark, FOLDER, cited[0].id)["id"] == cited[0].id
    assert api.citations(spark, FOLDER, "fed_rahmeng", limit=4).count() <= 4 and api.watched(spark, FOLDER).count() > 0
    assert api.amending_source(spark, FOLDER, "gii").count() > 0 and api.changes_atom(spark, FOLDER).count() <= 100
    nodes, links = api.graph(spark, FOLDER)
    assert nodes.count() and links.count()


def test_endpoints_of_history(spark):
    found = api.federal_history(spark, FOLDER, tier="exact", limit=1000).collect()
    assert all(r.tier == "exact" and r.document_id for r in found)
    assert api.reconstructions(spark, FOLDER, limit=5).where("verdict <> 'verified'").count() == 0
    assert api.reviews(spark, FOLDER, limit=3).count() == 3 and api.git(spark, FOLDER, 7).count() == 7 and api.acts(spark, FOLDER).count() > 0
    for bad in (lambda: api.federal_history(spark, FOLDER, tier="other"), lambda: api.reviews(spark, FOLDER, limit=0), lambda: api.git(spark, FOLDER, 1001), lambda: api.reconstructions(spark, FOLDER, offset=-1)):
        with pytest.raises(RequestError):
            bad()
