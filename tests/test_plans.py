"""Plans on small tables of their own."""

from tidemark.plans import text


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_anchored_quotes(spark, tmp_path):
    lines = ["The keeper locked the mill.", "Nobody came.", "It rained all night on the quay.", "She sold the lantern, at last, to a stranger.", "The end came.", "A bell rang twice over the orchard.", "A bell rang twice over the orchard."]
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    blocks = [("b", i, o, "p", x) for i, (o, x) in enumerate(zip(starts, lines, strict=True))]
    segs = [("b", 0, 0, starts[6] - 1), ("b", 0, 0, starts[6] - 1), ("b", 1, starts[6], starts[6] + len(lines[6]))]
    quotes = ["Nobody came.", "Nobody came", "It rained all night in the hills", "sold the lantern at last", "A bell rang twice", "A bell rang twice for nobody", "twice never heard of", "A bell"]
    log = [(i, "b", "rel", 0, q) for i, q in enumerate(quotes)] + [(8, "b", "rel", starts[6], "The keeper locked"), (9, "b", "event", 0, "Nobody came."), (0, "b", "rel", 0, quotes[0])]
    folder = write(spark, tmp_path, blocks=(blocks, "book_id string, block_no long, o long, k string, t string"), segs=(segs, "book_id string, seg long, o0 long, o1 long"), kg_log=(log, "rec_id long, book_id string, t string, s long, quote string"))
    got = {r.rec_id: (r.stage, r.distance, r.block_no) for r in text.anchored_quotes(spark, folder).collect()}
    # Verbatim; by the first half two blocks on; without marks three blocks on; verbatim and by half five blocks on; nothing of another segment.
    assert got == {0: (1, 1, 1), 1: (1, 1, 1), 2: (3, 2, 2), 3: (2, 3, 3), 4: (1, 5, 5), 5: (3, 5, 5), 7: (1, 5, 5)}
