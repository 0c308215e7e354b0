"""Two downloads side by side, and their union."""

from emberfold.operators import grid_etl as G
from emberfold.plans.grid import BOOK

ROW = "dataset string, seq long, valid boolean, inside boolean, reason string, key string, power string, kv double, kvs array<double>, mismatch boolean, name string, ref string, operator string, osm_timestamp string, parts array<array<array<double>>>"
KNOWN = "dataset string, partial boolean, failed_requests long, failed_listed boolean, gap_tiles long, exceeded_tiles long"


def feature(dataset, seq, key, reason="accepted", mismatch=False):
    return (dataset, seq, True, reason != "outside-boundary", reason, key, "line", 154.0, [154.0], mismatch, "", "", "", "", [])


def test_every_two_downloads_and_their_union(spark):
    """Unions have gates of their own: what the existing set adds can spoil them, what the fresh one has as well can't."""
    rows = [feature("old", 1, "a"), feature("old", 2, "b"), feature("old", 3, "b"), feature("old", 4, "x", "outside-boundary")]
    rows += [feature("new", 5, "b"), feature("new", 6, "c")]
    rows += [feature("odd", 7, "c", mismatch=True), feature("odd", 8, "d", mismatch=True), feature("same", 9, "c", mismatch=True)]
    known = [(d, False, 0, True, 0, 0) for d in ("old", "new", "odd", "same", "none")]
    got = G.compare_downloads(spark.createDataFrame(rows, ROW), spark.createDataFrame(known, KNOWN)).collect()
    got = {(r["existing"], r["fresh"]): tuple(r)[2:] for r in got}
    assert len(got) == 25
    # copies of one key and what lies outside stay with the existing set
    assert got["old", "new"] == ("fresh", "validated-union", 1, 1, 1)
    assert got["odd", "new"] == ("fresh", "none", 1, 1, 1)
    assert got["same", "new"] == ("fresh", "validated-union", 1, 1, 0)
    assert got["new", "old"] == ("existing", "none", 1, 1, 1)
    assert got["none", "new"] == ("fresh", "validated-union", 0, 2, 0)
    assert got["old", "none"] == ("fresh", "validated-union", 0, 0, 2)
    assert got["old", "odd"] == ("none", "none", 0, 2, 2)


def test_the_query_says_whether_the_union_passes(spark):
    got = BOOK.queries["A28_choose"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["existing", "fresh", "selected", "as_union", "shared", "only_fresh", "only_existing"]
    assert "as_union" in BOOK.sql["A28_choose"]
