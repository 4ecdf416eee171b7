"""The as-of fold on hand-written logs."""

from pyspark.sql import functions as F

from tidemark.operators import fold

LOG = "book_id string, rec_id long, t string, p long, ord long, id string, name string, alias string, from_id string, into_id string, intro string, imp int, tagline string, bio string, attr_key string, attr_value string, a string, b string, a_is string, b_is string, rel_desc string, status string, c map<string,bigint>, ingested_at long"
FIELDS = [f.split()[0] for f in LOG.split(", ")]


def log(spark, *rows):
    filled = [tuple({"book_id": "b", "rec_id": i, "ord": i, "ingested_at": 0, **r}.get(f) for f in FIELDS) for i, r in enumerate(rows)]
    return spark.createDataFrame(filled, LOG)


def at(spark, rows, pos):
    cut = spark.createDataFrame([("b", pos)], "book_id string, pos long")
    return fold.known(log(spark, *rows), cut)


REVEAL = [
    {"t": "person", "p": 10, "id": "P1", "name": "the shopkeeper", "imp": 1},
    {"t": "person", "p": 30, "id": "P2", "name": "Anna Vale", "imp": 2},
    {"t": "merge", "p": 35, "from_id": "P2", "into_id": "P1"},
    {"t": "cnt", "p": 36, "c": {"P1": 2, "P2": 3, "ghost": 9}},
]


def test_a_merge_is_unknown_before_its_position(spark):
    before = {r.id: r.name for r in fold.world(at(spark, REVEAL, 34)).collect()}
    assert before == {"P1": "the shopkeeper", "P2": "Anna Vale"}
    after = {r.id: (r.name, r.n) for r in fold.world(at(spark, REVEAL, 40)).collect()}
    assert after == {"P1": ("Anna Vale", 5)}  # a generic name gives way, counts add up


def test_early_records_are_held_and_early_counts_dropped(spark):
    rows = [
        {"t": "cnt", "p": 1, "c": {"P": 7}},
        {"t": "profile", "p": 2, "id": "P", "tagline": "keeper", "bio": ""},
        {"t": "person", "p": 5, "id": "P", "name": "Tom", "intro": "a boy"},
        {"t": "profile", "p": 6, "id": "P", "tagline": " ", "bio": "born at sea"},
        {"t": "name", "p": 7, "id": "nobody", "name": "lost"},
    ]
    card = fold.people(at(spark, rows, 99)).collect()
    assert [(r.id, r.tagline, r.bio, r.n, r.imp) for r in card] == [("P", "keeper", "born at sea", 0, 1)]


def test_chains_and_cycles_of_merges(spark):
    def ends(*pairs):
        rows = [{"t": "merge", "p": i, "from_id": a, "into_id": b} for i, (a, b) in enumerate(pairs)]
        return {r.id: r.canon for r in fold.canonical(fold.merge_map(at(spark, rows, 99))).collect()}

    assert ends(("a", "b"), ("b", "c"), ("c", "d")) == {"a": "d", "b": "d", "c": "d"}
    assert ends(("A", "B"), ("B", "A"), ("C", "A")) == {"A": "A", "B": "B", "C": "A"}
    assert ends(("x", "x")) == {"x": "x"}


def test_relations_swap_sides_and_carry_forward(spark):
    rows = [
        {"t": "rel", "p": 1, "a": "x", "b": "a", "a_is": "aunt", "b_is": "nephew", "status": "new"},
        {"t": "rel", "p": 2, "a": "a", "b": "x", "a_is": "", "b_is": None, "status": "ended", "rel_desc": "quarrel"},
        {"t": "rel", "p": 3, "a": "a", "b": "a", "a_is": "self"},
    ]
    rel = fold.relations(at(spark, rows, 99))
    assert [tuple(r) for r in fold.current_relations(rel).collect()] == [("b", "a", "x", "nephew", "aunt", "quarrel", "ended", 2)]
    assert [r.a_is for r in fold.relation_history(rel).orderBy("seq").collect()] == ["nephew", "nephew"]


def test_prefix_safety(spark):
    """What is known at a position does not depend on later records."""
    for pos in (9, 10, 33, 35, 40):
        whole = sorted(map(tuple, fold.world(at(spark, REVEAL, pos)).collect()))
        prefix = sorted(map(tuple, fold.world(at(spark, [r for r in REVEAL if r["p"] <= pos], pos)).collect()))
        assert whole == prefix


def test_quarantine_is_the_minimax_over_ways(spark):
    seeds = spark.createDataFrame([("A", 5)], "id string, taint long")
    merges = spark.createDataFrame([("A", "B", 10), ("B", "C", 3), ("A", "D", 50), ("C", "D", 8), (None, "A", 1)], "a string, b string, p long")
    assert {r.id: r.taint for r in fold.quarantine(seeds, merges).collect()} == {"A": 5, "B": 10, "C": 10, "D": 10}
    assert fold.quarantine(seeds.limit(0), merges).count() == 0


def test_empty_log(spark):
    empty = at(spark, REVEAL, 99).where(F.lit(False))
    assert fold.people(empty).count() == fold.world(empty).count() == fold.current_attributes(empty).count() == 0
