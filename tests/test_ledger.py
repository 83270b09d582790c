"""the ledger over several captures."""

from pyspark.sql import functions as F

from pagelode.operators import ledger as L

PAGES = "page_id long, url string, html string"


def taken(spark, pages):
    return L.snapshot(spark.createDataFrame([(i, f"https://a.example.com/{p}" if p else None, h) for i, (p, h) in enumerate(pages)], PAGES))


def statuses(compared):
    return {r.route.rsplit("/", 1)[1]: (r.status, r.peer and r.peer.rsplit("/", 1)[1]) for r in
            compared.filter("artifact = 'dom'").collect()}


FIRST = [("a", "<p>one</p>"), ("b", "<p>two</p>"), ("c", "<p>3 at 2024-01-01T00:00:00Z</p>"), ("d", "<p>four</p>"), (None, "x"), ("e", None)]
SECOND = [("a", "<p>one!</p>"), ("bb", "<p>two</p>"), ("c", "<p>3 at 2025-06-07T08:09:10Z</p>"), ("f", "<p>five</p>")]


def test_three_captures(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    first = statuses(L.advance(spark, folder, taken(spark, FIRST)))
    assert first == {k: ("new", None) for k in "abcd"}
    second = statuses(L.advance(spark, folder, taken(spark, SECOND)))
    assert second == {"a": ("changed", None), "bb": ("moved", "b"), "b": ("moved_away", "bb"), "c": ("unchanged", None),
                      "d": ("removed", None), "f": ("new", None)}
    third = statuses(L.advance(spark, folder, taken(spark, FIRST)))
    assert third == {"a": ("changed", None), "b": ("moved", "bb"), "bb": ("moved_away", "b"), "c": ("unchanged", None),
                     "d": ("new", None), "f": ("removed", None)}
    # Only what differs is written, and a state can be read at any version.
    written = L.read_ledger(spark, folder).groupBy("version").agg(F.count_if(F.col("status") == "unchanged").alias("same")).collect()
    assert {(r.version, r.same) for r in written} == {(1, 0), (2, 0), (3, 0)}
    ledger = L.read_ledger(spark, folder)
    for version, pages in ((1, FIRST), (2, SECOND), (3, FIRST)):
        known = statuses(L.compare(L.state(ledger, version), taken(spark, pages)))
        assert set(known.values()) == {("unchanged", None)}


def test_a_rerun_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    L.advance(spark, folder, taken(spark, FIRST))
    before = sorted(map(tuple, L.read_ledger(spark, folder).collect()))
    again = L.advance(spark, folder, taken(spark, FIRST))
    assert {s for s, _ in statuses(again).values()} == {"unchanged"}
    assert sorted(map(tuple, L.read_ledger(spark, folder).collect())) == before


def test_pages_of_one_digest_move_one_to_one(spark):
    n = 300
    before = taken(spark, [(f"old{i}", "<p>Gone</p>") for i in range(n)])
    after = taken(spark, [(f"new{i}", "<p>Gone</p>") for i in range(n + 40)])
    got = statuses(L.compare(before, after))
    moved = {k: peer for k, (s, peer) in got.items() if s == "moved"}
    assert len(moved) == n == len(set(moved.values()))
    assert all(got[peer] == ("moved_away", k) for k, peer in moved.items())
    assert sum(s == "new" for s, _ in got.values()) == 40


def test_empty_sides(spark):
    some, none = taken(spark, FIRST), taken(spark, [])
    assert L.compare(none, none).count() == 0
    assert {s for s, _ in statuses(L.compare(some, none)).values()} == {"removed"}
    assert {s for s, _ in statuses(L.compare(none, some)).values()} == {"new"}
