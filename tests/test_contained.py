"""Containment joins: nothing that grows with the texts or names is broadcast, and full filters lose nothing."""

from tidemark.operators.contained import contained_names, names_in_texts, whole_words
from tidemark.plans import naming, reading, rules


def nodes(df):
    """Every node of the plan that ran, each with those under it."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        found.append(node)
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += inner + [node.children().apply(i) for i in range(node.children().size())]
    return found


def exploded_broadcasts(df):
    """Broadcasts of rows that were exploded, whose size Spark cannot foresee."""
    df.collect()
    return [n for n in nodes(df) if n.nodeName() == "BroadcastExchange" and "Generate" in n.toString()]


def write_log(spark, folder, rows, columns):
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/kg_log.parquet")
    return str(folder)


def test_no_join_of_names_and_texts_is_broadcast(spark):
    texts = spark.createDataFrame([("b", "Ann met Bo in Wickham Market")], "book_id string, t string")
    names = spark.createDataFrame([("b", "Ann"), ("b", "Bo"), ("b", "Wickham Market"), ("c", "met")], "book_id string, name string")
    inside = names.withColumnRenamed("name", "to_name")
    for found, want in ((names_in_texts(texts, names, "book_id", "t", "name"), 3), (whole_words(texts, names, "book_id", "t", "name"), 3), (contained_names(names, inside), 4)):
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == want and "Broadcast" not in plan


def test_only_keys_of_names_are_shuffled(spark):
    texts = spark.createDataFrame([("b", f"{i:05} " + "the rain fell on the quay of the old town " * 5 + "Ann") for i in range(20)], "book_id string, t string")
    names = spark.createDataFrame([("b", "Ann"), ("b", "Wickham Market")], "book_id string, name string")
    found = names_in_texts(texts, names, "book_id", "t", "name")
    assert found.count() == 20
    found.collect()
    metrics = [n.metrics().apply("numOutputRows").value() for n in nodes(found) if n.nodeName() == "Generate"]
    # 20 texts of 200 characters have more than 10,000 parts.
    assert metrics and sum(metrics) < 200


def test_scopes_of_very_many_names(spark):
    names = [f"N{i * 7919 % 100_003:06}" for i in range(12_000)]
    texts = [f"met {names[i]} and {names[-i - 1]} and M{i:06}" for i in range(50)]
    frame = lambda values, name: spark.createDataFrame([("b", v) for v in values], f"book_id string, {name} string")
    want = {(t, n) for i, t in enumerate(texts) for n in (names[i], names[-i - 1])}
    for join in (names_in_texts, whole_words):
        assert {(r.t, r.name) for r in join(frame(texts, "t"), frame(names, "name"), "book_id", "t", "name").collect()} == want


LOG = "rec_id long, book_id string, t string, p long, ord long, ingested_at long, id string, name string, alias string, intro string, tagline string, bio string, imp int, gender string, who array<string>, a string, b string, from_id string, into_id string, text string, attr_value string, rel_desc string, c map<string,long>"


def record(rec_id, t, p, **values):
    given = {"rec_id": rec_id, "book_id": "b", "t": t, "p": p, "ord": rec_id, "ingested_at": rec_id} | values
    return tuple(given.get(x.split()[0]) for x in LOG.replace("map<string,long>", "map").split(", "))


def test_probes_broadcast_nothing_exploded(spark, tmp_path):
    rows = [record(1, "person", 1, id="P1", name="Ann", intro="The miller of Wickham"), record(2, "profile", 2, id="P1", bio="She is Lady Vale, and no miller."), record(3, "name", 90, id="P1", name="Lady Vale"), record(4, "person", 100, id="P2", name="Bo")]
    found = reading.spoiler_probes(spark, write_log(spark, tmp_path, rows, LOG))
    assert [(r.id, r.name) for r in found.collect()] == [("P1", "Lady Vale")] and not exploded_broadcasts(found)


def test_candidates_broadcast_nothing_exploded(spark, tmp_path):
    rows = [record(1, "person", 1, id="P1", name="Ann Vale"), record(2, "person", 2, id="P2", name="Vale"), record(3, "person", 3, id="P3", name="Mr Vale"), record(4, "event", 4, who=["P1", "P3"]), record(5, "person", 5, id="P4", name="Bo")]
    found = naming.same_candidates(spark, write_log(spark, tmp_path, rows, LOG))
    assert {(r.a, r.b) for r in found.collect()} == {("P1", "P2"), ("P2", "P3")} and not exploded_broadcasts(found)


def test_scrubbing_explodes_little_and_takes_deliveries_once(spark, tmp_path):
    filler = "the rain fell on the quay of the old town and nobody came to the mill that day, "
    rows = [record(1, "person", 1, id="P1", name="The Stranger"), record(2, "name", 90, id="P1", name="Lady Vale")]
    rows += [record(3 + i, "event", 10 + 2 * i, text=f"{filler * 3}{i} Lady Vale came.", who=["P1"]) for i in range(80)]
    rows.append(record(3, "event", 10, text=f"{filler * 3}0 Lady Vale came.", who=["P1"], ingested_at=999))
    found = rules.scrubbed(spark, write_log(spark, tmp_path, rows, LOG))
    got = found.collect()
    # Only records before the name is known, position 90.
    assert sorted((r.rec_id, r.safe) for r in got) == [(3 + i, f"{filler * 3}{i} The Stranger came.") for i in range(40)]
    # 80 texts of 250 characters have more than 50,000 parts.
    assert sum(n.metrics().apply("numOutputRows").value() for n in nodes(found) if n.nodeName() == "Generate") < 1000 and not exploded_broadcasts(found)
