"""Spelling variants, Merkle manifest and line dedup against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import common, decontaminate, line_dedup, manifest, mixing, ngram_join, substring_dedup, spelling
from tests.llm import brute
from tests.llm.test_operators import EDGES, SCHEMA, documents, empty, table

LONG = "\n".join(f"Line {k % 700} of a very long text" for k in range(60_000))


def variants(rng):
    """Texts of words with one edit, two edits, anagrams and chains of forms of falling counts."""
    bases = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(6, 10))) for _ in range(40)] + ["éèçñöüßàâ", "abcdef", "badcfe", "x" * 90, "x" * 91, "x" * 90 + "y", "fabcde", "abcdefabcdef" * 8]
    said = []
    for b in bases:
        said += [b] * rng.choice([5, 30, 200])
        for _ in range(12):
            w = list(b)
            for _ in range(rng.choice([1, 1, 1, 2])):
                k, what = rng.randrange(len(w)), rng.randrange(3)
                w[k : k + (what > 0)] = [] if what == 1 else [rng.choice("aeinrstzé")]
            said += ["".join(w)] * rng.choice([1, 4, 5, 6, 28])
    said += ["chained"] * 750 + ["chainedo"] * 140 + ["chainedoo"] * 25 + ["chainedooo"] * 5
    rng.shuffle(said)
    return [(i, " ".join(said[k : k + 60]).replace("abc", "ABC", 1), "s") for i, k in enumerate(range(0, len(said), 60))]


@pytest.fixture(scope="module")
def worded(spark):
    return variants(random.Random(11)) + EDGES + [(None, "ananas " * 7 + "anamas", None), (7, "ananas ananas ananaß×÷ananas", "s"), (7, "ananas ananas", "s"), (7, "ananas ananas", "s")]


def spelled(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


@pytest.mark.parametrize("seats", [spelling.SEATS, 60, 1])  # whole nodes; split nodes; leaves paired by deletions too
def test_spelling_variants(spark, worded, seats):
    got = spelled(spelling.spelling_variants(table(spark, worded), seats=seats))
    want = brute.spelling(worded)
    assert got == want
    assert len({w[2] for w in want}) < len(want) and any(w[1] and w[1] != w[2] for w in want)


def test_spelling_variants_of_documents(spark):
    rows = documents(spark)[:25]
    assert spelled(spelling.spelling_variants(table(spark, rows), seats=200)) == brute.spelling(rows)
    assert spelling.spelling_variants(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1, 8, 1 << 18])  # blocks of the search that are halved to one query, and whole ones
def test_trie_finds_all_within_budget(monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdqz") for _ in range(rng.randrange(1, 8))) for _ in range(400)} | {"a" * 40, "a" * 41, "a" * 15, "a" * 16})
    vec = spelling.vectors(words)
    order = np.argsort(vec, kind="stable")
    trie = spelling.Trie(vec[order], 0)
    zero, no = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    found = {(words[q], words[order[t]]) for qs, ts in trie.search(vec, zero, zero, no) for q, t in zip(qs, ts)}
    near = {(a, b) for a in words for b in words if brute.one_edit(a, b)}
    assert near <= found and len(found) < len(words) ** 2 / 4
    letters = spelling.Letters(words, 1)
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(len(words)) for b in range(len(words))]))
    assert {(words[i[k]], words[j[k]]) for k in letters.near(i, j)} == near


def wide(spark, rows):
    return spark.createDataFrame([(i, s, l, n, t, 1, "x", 2) for i, s, l, n, t in rows], "doc_id long, source string, lang string, n_chars long, text string, tree long, digest string, idx long")


@pytest.mark.parametrize("levels", [1, 2, 7])  # many rounds of exchange; few; none
def test_manifest(spark, levels):
    rng = random.Random(levels)
    rows = [(i, f"s{i % 3 if i % 2 else 0}", "en", i, f"text {i}\nmore") for i in range(310)]
    rows += [(1000 + k, f"one{k:02}", None, None, None) for k in range(31)] + [(None, None, None, None, None), (5, None, "", 0, ""), (2000, "é", "de", 1, LONG), (2001, "\U0001f600", "de", 1, "a"), (2002, "￿", "de", 1, "a")]
    rows += [(-(2**63), "s0", "a", 1, "x"), (2**63 - 1, "s0", "a", 1, "y\n"), (8, "s0", "en", 8, "other"), (8, "s0", "en", 8, "other")]
    rng.shuffle(rows)
    out = manifest.manifest(wide(spark, rows), F.lit("0" * 64), levels).withColumn("folded", manifest.fold(F.col("leaf"), F.col("proof"))).withColumn("bad", manifest.fold(F.col("carried"), F.col("proof"))).collect()
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in out]
    assert sorted(got, key=repr) == sorted(brute.manifest(rows), key=repr)
    assert all(r["folded"] == r["root"] != r["bad"] for r in out)


def test_manifest_of_few_rows(spark):
    assert manifest.manifest(wide(spark, [])).count() == 0
    (one,) = manifest.manifest(wide(spark, [(1, "s", "en", 1, "t")])).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == brute.leaf(1, "s", "en", 1, "t") and one["proof"] == []


def shared(spark, rng):
    rows = [(i, "\n".join([f"own {i}", "  Shared LINE\t", "", " ", f"by {i % 9}", rng.choice(["x", "tail\r"])]), "s") for i in range(40)]
    rows += [(100 + k, "only shared line", "s") for k in range(3)] + [(7, "nine times", "s")] * 12 + [(200 + k, "eight\nnine times", "s") for k in range(9)] + [(None, "shared line\nnull", None), (None, "x", None)]
    return rows + EDGES + [(300, LONG, "s"), (301, LONG.upper(), "s"), (302, "É\né", "s"), (303, "\n\n", "s")] + documents(spark)[:60]


@pytest.mark.parametrize("heavy", [line_dedup.HEAVY, 3, 1])  # all hashes broadcast; the hot ones apart and the rest shuffled
def test_line_dedup(spark, heavy):
    rows = shared(spark, random.Random(4))
    out = line_dedup.drop_shared_lines(table(spark, rows), heavy=heavy)
    got = [(r["row"]["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute.drop_shared_lines(rows), key=repr)
    assert out.schema["row"].dataType.names == [c.split()[0] for c in SCHEMA.split(", ")]


def test_line_dedup_threshold(spark):
    rows = [(i, "a\nb", "s") for i in range(10)] + [(1, "a\nc", "s")] * 3 + [(i, "c", "s") for i in range(20, 28)]
    got = sorted((r["row"]["doc_id"], r["text"]) for r in line_dedup.drop_shared_lines(table(spark, rows)).collect())
    assert got == sorted([(i, "") for i in range(10)] + [(1, "c")] * 3 + [(i, "c") for i in range(20, 28)])
    assert line_dedup.drop_shared_lines(empty(spark)).count() == 0


def test_crc32_sql():
    from factweave.llm.common import crc32_sql
    from tests.oracle import connection

    con = connection()
    for s in ("1:a", "-12:été", "99:" + "x" * 300):
        assert con.execute(f"SELECT {crc32_sql(repr(s))}").fetchone()[0] == zlib.crc32(s.encode())


CLASHING = "_id long, _hash string, _src long, _src_of_row long, _place_of_row long, _end0 long, _times long, _time long, _n long, _n0 long, _rs long, row long, id long, hash long, src long, at long, twin long, n long, times long, end0 long, worded long, doc_id long, text string, source string"


def clashing(spark, rows):
    names = CLASHING.count(",") - 2
    return spark.createDataFrame([(*("1" if k == 1 else k for k in range(names)), i, t, s) for i, t, s in rows], CLASHING)


def test_stages_take_any_column_names(spark):
    """Columns named like those of a plan, with rows that repeat."""
    rows = [(i, " ".join(f"w{i * k}" for k in range(30)), "ab"[i % 2]) for i in range(12)] + [(3, " ".join(f"w{3 * k}" for k in range(30)), "b")] * 2 + [(None, None, None)]
    docs = clashing(spark, rows)
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns and sorted(map(repr, one.collect())) == sorted(set(map(repr, docs.collect())))
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns and {tuple(r)[:-3] for r in mix.collect()} == {tuple(docs.first())[:-3]}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and ngram_join.keep_one(docs.limit(0)).count() == 0


def test_substring_dedup_takes_any_ids(spark):
    """Ids at both ends of a long, and one far from all others."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(-(2**63), base, "s"), (2**63 - 1, base + " tail", "s"), (0, "x " * 50, "s"), (5, base, "s"), (None, None, "s")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(table(spark, rows)).collect()}
    want = brute.remove_repeats([(i, t) for i, t, _ in rows if i is not None])
    assert {i: got[i] for i in want} == want


def test_running_sums_by_spans(spark, monkeypatch):
    monkeypatch.setattr(common, "SPAN", 3)
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 2).alias("k"), (F.col("id") / 500).alias("u"))
    got = common.running(rows, ["k"], "u", ["id"], F.col("id"), "sum", 40).collect()
    assert all(r["sum"] == sum(range(r["k"], r["id"] + 1, 2)) for r in got)


def test_source_targets_equal_plain_water_levels(spark):
    rng = random.Random(8)
    sizes = {f"s{k:02}": rng.choice([0, 1, 5, 40, 1000, 30_000]) for k in range(40)} | {None: 7}
    sized = spark.createDataFrame([("n" if s is None else "s" + s, v) for s, v in sizes.items()], "src string, size long")
    got = {r["src"]: r["target"] for r in mixing.source_targets(sized).collect()}
    want = brute.targets(sizes)
    assert got == pytest.approx({"n" if s is None else "s" + s: v for s, v in want.items()})
    assert mixing.source_targets(sized.limit(0)).count() == 0


def test_decontamination_plans_do_not_grow_with_blocks(spark):
    items = [f"alpha{k} beta{k} gamma{k} delta{k} epsilon{k}" for k in range(23)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, [(k, f"x {items[k]} y" if k < 23 else "nothing of the kind", "s") for k in range(30)])
    found, kept = decontaminate.find_leaks(docs, bench, 60), decontaminate.decontaminate(docs, bench, 60)
    for df in (found, kept):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= decontaminate.CHAIN
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k, k) for k in range(23)]
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(23, 30))
