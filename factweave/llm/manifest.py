"""Merkle dataset manifest by butterfly exchange.

Rows become leaves; each source is a tree of fanout three over its leaves by doc_id, and the sources' roots are the
leaves of one more tree. A tree is dealt to aligned blocks of ``3 ** BLOCK_LEVELS`` leaves. A task hashes a block up to
its one node; then the blocks exchange: in round r, the three blocks of a group that stand at the same offset inside
their nodes swap the nodes' digests, and each hashes the parent for itself. After the last round every block holds the
root and the sibling digests of its whole way up, so nothing is sent down again: each block is joined once with its own
row and its leaves get their proofs in place. Where the last node of a level is short, its blocks stand in, in turn,
for the offsets it lacks.

Ranks are dealt by sampled ranges of source and doc_id, so a source with a third of all rows is spread over many
ranges and blocks; an exchange meets three small rows a key. Texts are read once, by the map that hashes them.

Defined cases: a null in any column is hashed as ``-``; a null source is a source of its own and comes first; a null
doc_id comes first in its source; rows with one doc_id stand by their hash, equal rows are interchangeable; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import crc32_sql, materialize, release, table

FANOUT = 3
BLOCK_LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that ``digest`` and its ``proof`` lead to."""
    return F.aggregate(proof, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (written, with ``tree``) with ``idx``, the place in the tree from 0, and ``n``, the tree's leaves; and
    the table it rests on, to be released."""
    dealt = materialize(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("part", "tree").agg(F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("part", "tree", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"), F.sum("here").over(tree).alias("n"))
    inside = Window.partitionBy("part", "tree").orderBy(*order)
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(starts, ["part", "tree"])
    return ranked.withColumn("idx", F.col("start") + F.col("rank") - 1).drop("part", "rank", "start"), dealt


def _levels(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """Digests of a block, level by level: up to ``levels`` times while the tree of ``n`` leaves has several nodes."""
    out = [digests]
    for _ in range(levels):
        if n <= 1:
            break
        n = -(-n // FANOUT)
        low = out[-1]
        out.append([hashlib.sha256("".join(low[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(low), FANOUT)])
    return out


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by("idx")


def _block_root(levels: int):
    def run(block: pa.Table) -> pa.Table:
        block = _ordered(block.select(["tree", "block", "idx", "n", "digest"]))
        n = block["n"][0].as_py()
        top = _levels(block["digest"].to_pylist(), n, levels)[-1]
        return pa.table({"tree": block["tree"][:1], "block": block["block"][:1], "n": block["n"][:1], "root": pa.array([top[0]])})

    return run


def _block_proofs(levels: int, payload: list[str]):
    def run(block: pa.Table, way: pa.Table) -> pa.Table:
        block = _ordered(block)
        built = _levels(block["digest"].to_pylist(), block["n"][0].as_py(), levels)
        upper, lefts, rights = way["proof"][0].as_py(), [], []
        for i in range(len(block)):
            for level in built[:-1]:
                k = i % FANOUT
                lefts.append("".join(level[i - k : i]))
                rights.append("".join(level[i + 1 : i - k + FANOUT]))
                i //= FANOUT
            lefts += [s["left"] for s in upper]
            rights += [s["right"] for s in upper]
        each = len(built) - 1 + len(upper)
        steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], names=["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(range(0, each * len(block) + 1, each) if each else [0] * (len(block) + 1), pa.int32()), steps)
        same = {c: pa.concat_arrays([pa.repeat(way[c][0], len(block))]) for c in ("subroot", "root")}
        return pa.table({c: block[c] for c in ["tree", *payload, "digest"]} | same | {"proof": proof})

    return run


def _exchange(state: DataFrame, width: int) -> DataFrame:
    """One round: every block learns the siblings of its node of ``width`` blocks and hashes their parent."""
    at = state.withColumn("node", F.expr(f"block div {width}")).withColumn("spot", F.col("block") % width)
    at = at.withColumn("digit", F.col("node") % FANOUT).withColumn("run", F.expr(f"node div {FANOUT}"))
    alone = F.col("digit") == 0  # a short node that begins its run has no sibling, and stands in for nobody
    step = F.when(alone, F.lit(width)).otherwise(F.least(F.lit(width), F.col("blocks") - F.col("node") * width))
    sent = at.withColumn("place", F.explode(F.sequence(F.col("spot"), F.greatest(F.col("spot"), F.lit(width - 1).cast("long")), step)))
    mine = F.when(F.col("place") == F.col("spot"), F.struct("digit", "block", "n", "blocks", "proof"))
    met = sent.groupBy("tree", "run", "place").agg(F.array_sort(F.collect_list(F.struct("digit", "root"))).alias("nodes"), F.collect_list(mine).alias("own"))
    up = met.select("tree", F.sha2(F.concat_ws("", F.col("nodes.root")), 256).alias("root"), "nodes", F.explode("own").alias("o"))
    beside = lambda keep: F.concat_ws("", F.transform(F.filter("nodes", keep), lambda x: x["root"]))
    step = F.struct(beside(lambda x: x["digit"] < F.col("o.digit")).alias("left"), beside(lambda x: x["digit"] > F.col("o.digit")).alias("right"))
    return up.select("tree", "o.block", "o.n", "o.blocks", "root", F.concat("o.proof", F.array(step)).alias("proof"))


def climb(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``tree, block, n, blocks, root, proof`` of every block of ``leaves`` (``tree, idx, n, block, digest``): the tree's root
    and the block's way up. Each of about log3(blocks) rounds shuffles one row a block."""
    state = leaves.groupBy("tree", "block").applyInArrow(_block_root(levels), "tree string, block long, n long, root string")
    state = materialize(state.withColumn("blocks", F.ceil(F.col("n") / FANOUT**levels)).withColumn("proof", F.array().cast(PROOF)))
    most, width, turn = state.agg(F.max("blocks")).first()[0] or 0, 1, 0
    while width < most:
        todo, done = F.col("blocks") > width, F.col("blocks") <= width
        names = ["tree", "block", "n", "blocks", "root", "proof"]
        nxt = _exchange(state.where(todo), width).select(*names).union(state.where(done).select(*names))
        width, turn = width * FANOUT, turn + 1
        nxt = materialize(nxt)
        release(state)
        state = nxt
    return state


def _proven(leaves: DataFrame, ways: DataFrame, payload: str, levels: int) -> DataFrame:
    """``tree``, the payload columns, ``digest, subroot, root, proof`` of every leaf."""
    names = [c.split()[0] for c in payload.split(", ")] if payload else []
    schema = f"tree string, {payload + ', ' if payload else ''}digest string, subroot string, root string, proof {PROOF}"
    ours = leaves.select("tree", "block", "idx", "n", "digest", *names)
    return ours.groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(_block_proofs(levels, names), schema)


def _blocked(rows: DataFrame, levels: int) -> DataFrame:
    return rows.withColumn("block", F.expr(f"idx div {FANOUT**levels}"))


def manifest(docs: DataFrame, carry: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof`` for every row of ``docs`` (columns ``COLUMNS``), and ``carried``, the
    string column ``carry`` of the row. ``fold(leaf, proof)`` is the root; a proof step holds the digests left and right of one's own."""
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))  # null first
    slim = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(*(F.col(c) for c in COLUMNS)).alias("digest"), (F.lit(None) if carry is None else carry).cast("string").alias("carried"))
    slim = materialize(slim)
    ranked, dealt = _ranked(slim, ["doc_id", "digest", "carried"])
    leaves = materialize(_blocked(ranked, levels))
    release(slim, dealt)
    state = climb(leaves, levels)
    roots = materialize(state.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")))
    above, dealt = _ranked(roots, ["name"])
    tops = materialize(_blocked(above, levels))
    release(dealt)
    top_state = climb(tops, levels)
    ways = top_state.select("tree", "block", F.col("root").alias("subroot"), "root", "proof")
    over = _proven(tops, ways, "name string", levels).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("root").alias("top"), F.col("proof").alias("over"))
    ways = state.join(over, "tree").select("tree", "block", "subroot", F.col("top").alias("root"), F.concat("proof", "over").alias("proof"))
    out = _proven(leaves, ways, "doc_id long, carried string", levels)
    return out.select("doc_id", F.when(F.col("tree") != "n", F.expr("substring(tree, 2)")).alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "proof", "carried")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    tampered = leaf_hash(*(cut if c == "text" else F.col(c) for c in COLUMNS))
    out = manifest(docs, tampered)
    folded = out.withColumn("folded_root", fold(F.col("carried"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, leaves: str, rows: str, levels: int) -> str:
    """CTEs ``{name}{levels}`` (one root a tree) over ``leaves`` (tree, idx, h), and ``{name}p{levels}``: ``rows`` (rid, tree, idx,
    proof, f) with siblings appended to ``proof`` and ``f`` folded."""
    out = [f"{name}0 AS ({leaves})", f"{name}p0 AS ({rows})"]
    for k in range(levels):
        a, p = f"{name}{k}", f"{name}p{k}"
        out.append(f"{a}m AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {a})")
        out.append(f"{name}{k + 1} AS (SELECT tree, idx // 3 AS idx, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {a}m GROUP BY tree, idx // 3)")
        out.append(
            f"{name}p{k + 1} AS (SELECT p.rid, p.tree, p.idx // 3 AS idx, p.proof || coalesce(string_agg(a.h, '' ORDER BY a.idx) FILTER (WHERE a.idx <> p.idx), '') AS proof, "
            f"CASE WHEN any_value(a.m) = 1 THEN p.f ELSE sha256(string_agg(CASE WHEN a.idx = p.idx THEN p.f ELSE a.h END, '' ORDER BY a.idx)) END AS f "
            f"FROM {p} p JOIN {a}m a ON a.tree = p.tree AND a.idx // 3 = p.idx // 3 GROUP BY p.rid, p.tree, p.idx, p.proof, p.f)"
        )
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    part = lambda e: f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"


_SQL_LEVELS = 12
OP12_SQL = f"""
WITH d AS (SELECT *, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 AND doc_id IS NOT NULL AS cut FROM documents),
leaf AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS tree, {_leaf_sql("text")} AS h,
    {_leaf_sql("CASE WHEN cut THEN replace(text, chr(10), '') ELSE text END")} AS f FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM leaf),
{_tree_sql("a", "SELECT tree, idx, h FROM placed", "SELECT rid, tree, idx, '' AS proof, f FROM placed", _SQL_LEVELS)},
tops AS (SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, h FROM a{_SQL_LEVELS}),
up AS (SELECT p.rid, '' AS tree, t.idx, p.proof, p.f FROM ap{_SQL_LEVELS} p JOIN tops t ON t.name = p.tree),
{_tree_sql("b", "SELECT tree, idx, h FROM tops", "SELECT * FROM up", _SQL_LEVELS)}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = r.h AS verified
FROM placed l JOIN bp{_SQL_LEVELS} p ON p.rid = l.rid JOIN tops s ON s.name = l.tree CROSS JOIN b{_SQL_LEVELS} r
"""
