import random

from factweave.operators import factions
from tests.inline import inline


def test_without_a_cap_every_holder_counts(spark):
    """An identity of more holders than the cap: the definition leaves it out, ``pair_cap=None`` does not."""
    rows = [(i, f"a{i}", [f"own={i}", "kit=1", "kit=2"] if i < 1100 else [f"own={i}"]) for i in range(2300)]
    capped, whole = inline(spark, rows), inline(spark, rows)
    whole.pair_cap = None
    assert capped.faction_labels.count() == 0
    assert {tuple(r) for r in whole.faction_labels.collect()} == {(i, 0) for i in range(1100)}
    assert [tuple(r) for r in whole.faction_table.collect()] == [(0, 0, 1100, 1.0)]
    assert sorted(tuple(r) for r in whole.faction_signature.collect()) == [(0, 1, "kv", "kit=1", 1100), (0, 2, "kv", "kit=2", 1100)]
    assert sorted(r["canonical"] for r in whole.exclusive.collect()) == ["kit=1", "kit=2"]


def test_edges_between_classes_are_all_edges(spark):
    """Random sets, many equal or close: edges, labels and cohesion by classes equal those by all pairs."""
    rng = random.Random(4)
    base = [rng.sample(range(40), rng.randint(1, 9)) for _ in range(25)]
    sets = [sorted({x for x in rng.choice(base) if rng.random() > 0.2} | set(rng.sample(range(40), rng.randint(0, 2)))) for _ in range(220)]
    rare = spark.createDataFrame([(a, x) for a, s in enumerate(sets) for x in s], "artifact_id long, identity long").cache()
    groups, named = factions.classes(rare)
    by_class, by_pair = factions.class_edges(groups), factions.similarity_edges(rare)
    rep = {r["artifact_id"]: r["rep"] for r in named.collect()}
    want = {}
    for r in by_pair.collect():
        key = (*sorted((rep[r["a"]], rep[r["b"]])), round(r["similarity"], 9))
        want[key] = want.get(key, 0) + 1
    assert {(r["a"], r["b"], round(r["similarity"], 9)): r["pairs"] for r in by_class.collect()} == want
    labels = factions.faction_members(by_pair)
    assert sorted(map(tuple, factions.class_members(by_class, named).collect())) == sorted(map(tuple, labels.collect()))
    table = lambda edges: {(r["root"], r["size"], round(r["cohesion"], 9)) for r in factions.faction_cohesion(labels, edges).collect()}
    assert table(by_class) == table(by_pair)
