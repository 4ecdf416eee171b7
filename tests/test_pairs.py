"""Every pair of an event counts, however many people it has."""

from itertools import combinations

from tidemark.plans import log


def test_pairs_of_large_events(spark, tmp_path):
    who = [f"p{i:02}" for i in range(30)]
    rows = [(1, "b", "event", [*reversed(who), None, "p00"]), (1, "b", "event", [*reversed(who), None, "p00"]), (2, "b", "event", ["p29", "p28"]), (3, "b", "event", ["p01"]), (4, "b", "event", None)]
    spark.createDataFrame(rows, "rec_id long, book_id string, t string, who array<string>").write.parquet(f"{tmp_path}/kg_log.parquet")
    got = {(r.a, r.b): r.events for r in log.cooccurring(spark, str(tmp_path)).collect()}
    assert got == {pair: 1 + (pair == ("p28", "p29")) for pair in combinations(who, 2)}
