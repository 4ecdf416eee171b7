"""The shelf holds every matching book."""

from tidemark.plans import activity


def test_shelf_is_whole(spark, tmp_path):
    rows = [(f"b{i:03}", "The mill" if i % 2 else "Mill", " ", i // 4) for i in range(90)]
    spark.createDataFrame(rows, "book_id string, title string, author string, added_at long").write.parquet(f"{tmp_path}/books.parquet")
    got = [r.book_id for r in activity.shelf(spark, str(tmp_path)).collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[3], r[0])) if "e" in r[1].lower()]
    assert len(got) == 45
