"""Posting lists, dictionary numbers and consensus kept up batch by batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import factions, postings
from factweave.operators.consensus import occurrences
from factweave.operators.dictionary import dictionary
from factweave.plans.corpus import Corpus
from factweave.sources.rows import text_facts
from factweave.streaming.incremental import IncrementalConsensus

FACTS = "artifact_id long, ord int, kind string, canonical string, line int"


def facts_of(spark, rng, artifacts=120):
    """One fact in every artifact many times, some in a few, ids far apart."""
    rows = []
    for a in range(artifacts):
        mine = ["everywhere=1"] * 7 + [f"some={a % 9}", f"own={a}"] + [f"k{rng.randrange(12)}=x"] * rng.randrange(3)
        rows += [((a * 2**40 if a % 5 == 0 else a), n, "line" if n == 8 else "kv", c, rng.choice([0, n, 70_000, 2**31 - 1])) for n, c in enumerate(mine)]
    return spark.createDataFrame(rows, FACTS).repartition(7)


def key(r):
    return (r["kind"], r["canonical"], r["artifact_id"], r["ord"], r["line"])


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_posting_blocks_hold_every_occurrence(spark, block):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        facts = facts_of(spark, random.Random(block))
        # small batches, so runs go on from one to the next; ranges cut the fact that all hold
        blocks = postings.posting_blocks(facts, block).cache()
        assert sorted(map(key, postings.posting_rows(blocks).collect())) == sorted(map(key, occurrences(facts).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert blocks.agg(F.max("n")).first()[0] <= block
    one = [(r["first_artifact"], r["first_ord"], r["last_artifact"], r["n"]) for r in blocks.where("canonical = 'everywhere=1'").orderBy("first_artifact", "first_ord").collect()]
    assert sum(n for *_, n in one) == 840 and all(a[2] <= b[0] for a, b in zip(one, one[1:]))
    assert postings.posting_rows(postings.posting_blocks(facts.limit(0))).count() == 0


def test_numbers_take_the_fewest_bytes():
    for top, width in ((0, 1), (255, 1), (256, 2), (65_536, 4), (2**40, 8)):
        body = postings.pack(np.array([0, top]))
        assert len(body) == 1 + 2 * width and postings.unpack(memoryview(body), 2)[0].tolist() == [0, top]


def test_merged_postings(spark):
    facts = facts_of(spark, random.Random(3)).cache()
    odd = F.col("ord") % 2 == 1
    left, right = (postings.posting_blocks(facts.where(c), 16).cache() for c in (odd, ~odd))
    whole = postings.merged_postings(left, right, 16)
    assert sorted(map(key, postings.posting_rows(whole).collect())) == sorted(map(key, facts.collect()))
    assert whole.count() < left.count() + right.count()
    late = postings.posting_blocks(facts.where("canonical = 'everywhere=1'").withColumn("artifact_id", F.col("artifact_id") + 2**60), 16)
    assert sorted(map(key, postings.posting_rows(postings.merged_postings(left, late, 16)).collect())) == sorted(map(key, postings.posting_rows(left.unionByName(late)).collect()))


def test_dictionary_is_dense_and_in_order(spark):
    names = [("line", "b"), ("kv", "b"), ("kv", "a=1"), ("heading", "é"), ("kv", ""), ("kv", "a=10")]
    got = {(r["kind"], r["canonical"]): r["identity"] for r in dictionary(spark.createDataFrame(names, "kind string, canonical string")).collect()}
    assert got == {(k, c): n for n, (c, k) in enumerate(sorted((c, k) for k, c in names))}


def test_pairs_shuffle_numbers_only(spark):
    """No exchange after the dictionary carries a text."""
    pairs = factions.similarity_edges(spark.createDataFrame([(1, 2), (2, 2)], "artifact_id long, identity long"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "canonical" not in plan


def summary(c):
    ids = {tuple(r) for r in c.identities.select("kind", "canonical", "k", "occurrences", "holder", "holder_ord", "bucket", "is_core", "is_unique").collect()}
    stats = {(r["artifact_id"], r["path"], r["total"], r["in_core"], r["n_unique"], round(r["drift"], 12), r["is_outlier"]) for r in c.stats.collect()}
    return ids, stats


def test_incremental_consensus_equals_recompute_after_every_batch(spark, tmp_path):
    """Artifacts that come again with old and new facts, one without facts, batches that are replayed, merged sums."""
    rng = random.Random(9)
    state = IncrementalConsensus(spark, str(tmp_path / "state"), compact=2)
    assert state.identities.count() == 0 and state.stats.count() == 0
    arts, facts = {}, []
    for b in range(5):
        here = sorted({*rng.sample(range(14), 5), 20 + b})
        arts |= {a: (a, f"p{a}", "kv", 1) for a in here}
        new = [(a, n, "kv", c, n) for a in here if a != 20 for n, c in enumerate([f"c{rng.randrange(4)}=1" for _ in range(3)] + [f"own{a}={rng.randrange(2)}"])]
        facts += new
        batch = (spark.createDataFrame([arts[a] for a in here] + [arts[here[0]]], "artifact_id long, path string, kind string, size long"), spark.createDataFrame(new, FACTS))
        state.update(b, *batch)
        if b in (1, 3):
            state.update(b, *batch)  # replayed after its folders were written, and merged
        want = Corpus(spark.createDataFrame(list(arts.values()), "artifact_id long, path string, kind string, size long"), spark.createDataFrame(facts, FACTS))
        assert summary(state) == summary(want)
    assert state._done("merged") and state.members.groupBy("artifact_id", "kind", "canonical").count().where("count > 1").isEmpty()


def test_unfinished_batch_is_not_seen(spark, tmp_path):
    state = IncrementalConsensus(spark, str(tmp_path / "state"))
    arts = spark.createDataFrame([(1, "p", "kv", 1)], "artifact_id long, path string, kind string, size long")
    facts = spark.createDataFrame([(1, 0, "kv", "a=1", 1)], FACTS)
    state.update(0, arts, facts)
    before = summary(state)
    for table, df in (("artifacts", arts.withColumn("artifact_id", F.lit(2).cast("long"))), ("members", facts.selectExpr("2L as artifact_id", "kind", "canonical", "1L as n", "ord", "true as fresh"))):
        df.write.parquet(f"{tmp_path}/state/{table}/batch=1")  # the batch ended here
    assert summary(state) == before
    state.update(1, arts.withColumn("artifact_id", F.lit(3).cast("long")), facts.withColumn("artifact_id", F.lit(3).cast("long")))
    assert {r["artifact_id"] for r in state.artifacts.collect()} == {1, 3}


def test_incremental_stream(spark, tmp_path):
    from factweave.sources.rows import text_facts

    rows = spark.createDataFrame([(i % 5, f"p{i % 5}", "text", 1, f"shared\nown {i}\nshared") for i in range(9)], "artifact_id long, path string, kind string, size long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = IncrementalConsensus(spark, str(tmp_path / "state"), compact=2)
    state.ingest(stream, lambda b: text_facts(b, "artifact_id", "text"), str(tmp_path / "ck")).awaitTermination()
    want = Corpus(rows.drop("text").dropDuplicates(["artifact_id"]), text_facts(rows, "artifact_id", "text"))
    assert summary(state) == summary(want)


def summed(c):
    return sorted(map(tuple, c.identities.select("kind", "canonical", "k", "occurrences", "holder", "bucket").collect()))


def test_facts_are_extracted_once_for_all_batches(spark, tmp_path):
    """Before, each batch extracted all facts again, twice."""
    from factweave.streaming import incremental

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    facts = facts_of(spark, random.Random(5), 40)
    artifacts = facts.select("artifact_id").distinct().selectExpr("artifact_id", "CAST(artifact_id AS STRING) AS path", "'text' AS kind", "0L AS size")
    n, whole = facts.count(), Corpus(artifacts, facts)
    state = incremental.in_batches(IncrementalConsensus(spark, str(tmp_path), compact=2), artifacts, facts.mapInArrow(counted, facts.schema), 4)
    assert read.value == n
    assert summed(state) == summed(whole)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_artifacts_that_come_again_however_many(spark, tmp_path, monkeypatch, few):
    from factweave.streaming import incremental

    monkeypatch.setattr(incremental, "FEW", few)
    facts = facts_of(spark, random.Random(6), 40)
    artifacts = facts.select("artifact_id").distinct().selectExpr("artifact_id", "CAST(artifact_id AS STRING) AS path", "'text' AS kind", "0L AS size")
    state = incremental.in_batches(IncrementalConsensus(spark, str(tmp_path)), artifacts, facts, 3)
    assert summed(state) == summed(Corpus(artifacts, facts))


@pytest.mark.parametrize("result", ["exclusive", "summary"])
def test_results_that_read_the_membership_often_write_it_first(spark, result):
    """the membership and identities behind them come from the shared folder, not from the facts again."""
    df = spark.createDataFrame([(i, f"all\npair {i // 2}\nown {i}") for i in range(12)], "id long, text string")
    c = Corpus.from_lines(df, "id", "text")
    found = getattr(c, result)
    assert found.count() == (6 if result == "exclusive" else 1)
    for table in (c.members, c.identities):
        assert table.inputFiles() and all("/factweave-" in f for f in table.inputFiles())


def test_lines_are_trimmed_at_their_true_end(spark):
    """A mark that Java takes for a line's end does not hide the blanks before it, nor is it one itself."""
    df = spark.createDataFrame([(1, "\t a b \r\n \u2028\nx \u2028\n \t\r")], "id long, text string")
    assert [r["canonical"] for r in text_facts(df, "id", "text").orderBy("line").collect()] == ["a b", "\u2028", "x \u2028"]


def test_blocks_of_artifacts_at_both_ends_of_a_long(spark):
    """Differences above 2^63 were packed in one byte; short and long runs alike."""
    low, high = -(2**63), 2**63 - 1
    rows = [(a, n, "kv", c, 300 * n) for c, times in (("few", 1), ("many", postings.SHORT)) for a in (low, -1, 0, high) for n in range(times)]
    facts = spark.createDataFrame([*rows, (5, 0, "kv", "zz", 0)], FACTS)
    for block in (3, postings.BLOCK):
        found = postings.posting_rows(postings.posting_blocks(facts, block)).collect()
        assert sorted(map(key, found)) == sorted(map(key, facts.collect()))
