"""Mixing sources to target weights by weighted fair queueing.

Sources get weights 5, 2, 1, repeating in code-point order (null last); their targets share the total
size by weight, capped at three times the source's size, the excess being shared again by weight
(water-filling in closed form). Each source's documents are shuffled by a seeded hash; the virtual
finish time of a document in epoch e is ``(running tokens of its source + e * source size) / target``.
All (document, epoch) entries are ordered by finish time and taken until the total budget is spent.

Everything is DataFrame code. At finish time 1 every source has spent its target to within a document, so all
entries up to 1 are summed, and only the few that end just after it are put in one order. Running sums are cut
into ranges (``common.running``), so neither a hot source nor the global order meets in one task. The mix itself is
a map: each source is cut at one place of its shuffled order per epoch, and a document compares its own
place with these; texts are not shuffled.
Defined cases: null text has size 0 and is never taken; a null doc_id is a value like any other; a null source is a
source of its own; rows that repeat doc_id, text and source share what the mix takes of them, one row at a time; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import WORD, global_rank, global_sums, materialize, n_buckets, release, running, small, table, unit

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 2


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``src, source_size, target`` from rows with ``src`` (null encoded) and ``size``.

    In the order of cap by weight, the sources that fill up come first: one does if the level of what the sources before it
    leave, over the weights from it on, reaches its cap. Both sums are running sums over sampled ranges."""
    totals = materialize(sized.groupBy("src").agg(F.sum("size").alias("source_size")))
    per = global_rank(totals, [F.col("src") == "n", F.col("src")], "place")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.select("src", "source_size", w.cast("long").alias("w"), (F.col("source_size") * epochs).alias("cap"))
    per = materialize(global_sums(materialize(per), [F.col("cap") / F.col("w"), F.col("src")], {"caps": F.col("cap"), "ws": F.col("w")}))
    total, weight = per.agg(F.sum("source_size"), F.sum("w")).first()
    share = (F.lit(total or 0) - F.col("caps") + F.col("cap")) / (F.lit(weight or 1) - F.col("ws") + F.col("w"))
    per = per.withColumn("filled", F.col("cap") <= share * F.col("w"))
    caps, rest = per.agg(F.coalesce(F.sum(F.when(F.col("filled"), F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("filled"), F.col("w"))), F.lit(0))).first()
    level = ((total or 0) - caps) / rest if rest else 0.0
    return per.select("src", "source_size", F.when(F.col("filled"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def _source(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n"))


def _place(docs: DataFrame, seed: int) -> Column:
    """A row's place in the shuffled order of its source."""
    doc_id, text_hash = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return F.struct(unit(doc_id, text_hash, seed=seed).alias("u"), doc_id.alias("doc_id"), text_hash.alias("text_hash"))


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, src, u, size, source_size, target, epochs`` for every row of ``docs``; ``epochs`` is
    how often the mix takes the document (0 to ``epochs``)."""
    return _mix(docs, weights, epochs, seed)[0]


def _mix(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``fair_mix``, and the written table it reads."""
    words = F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(docs.select(_place(docs, seed).alias("p"), _source(docs).alias("src"), words.alias("size")).select("p.doc_id", "src", "size", "p.text_hash", "p.u"))
    targets = materialize(source_targets(sized, weights, epochs))
    queued = running(sized, ["src"], "u", ["doc_id", "text_hash"], F.col("size"), "sum", n_buckets(sized.count()))
    queued = materialize(queued.join(small(targets), "src"))
    budget, open_ = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("target") < epochs * F.col("source_size"), F.col("target"))), F.lit(0.0))).first()
    finish = lambda e: (F.col("sum") + e * F.col("source_size")) / F.col("target")
    entries = queued.where("size > 0").select("src", "size", "sum", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    entries = entries.select("src", "size", "sum", "epoch", finish(F.col("epoch")).alias("finish"))
    sure = entries.agg(F.coalesce(F.sum(F.when(F.col("finish") <= 1, F.col("size"))), F.lit(0))).first()[0]
    # what is left is at most one document a source, spent before the open sources have got that much more
    slack = (queued.groupBy("src").agg(F.max("size").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] + 1) / max(open_, 1.0)
    at = F.least(F.lit(0.999999), (F.col("finish") - 1) / slack)
    band = materialize(entries.where((F.col("finish") > 1) & (F.col("finish") <= 1 + slack)).withColumn("at", at).withColumn("all", F.lit(0)))
    spent = running(band, ["all"], "at", ["finish", "src", "epoch", "sum"], F.col("size"), "spent", n_buckets(band.count()))
    last = spent.where(F.col("spent") <= budget - sure).agg(F.max(F.struct("finish", "src", "epoch", "sum")).alias("last")).first()[0]
    taken = F.lit(0)
    for e in range(epochs):
        now = finish(F.lit(e)) <= 1
        if last is not None:
            cut = F.struct(F.lit(last["finish"]), F.lit(last["src"]), F.lit(last["epoch"]), F.lit(last["sum"]).cast("long"))
            now = now | (F.struct(finish(F.lit(e)), F.col("src"), F.lit(e), F.col("sum")) <= cut)
        taken = taken + now.cast("int")
    release(sized, band, targets)
    return queued.select("doc_id", "text_hash", "src", "u", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("int").alias("epochs")), queued


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, all columns kept, whatever their names. Rows
    without words are never taken; an empty table stays empty; the module's other cases hold."""
    mix, held = _mix(docs, weights, epochs, seed)
    place = F.struct("u", "doc_id", "text_hash")
    ends = [F.max(F.when(F.col("epochs") > e, place)).alias(f"end{e}") for e in range(epochs)]
    cuts = materialize(mix.groupBy(F.col("src").alias("cut_src")).agg(*ends))
    counts = [F.count_if(F.col("epochs") > e).alias(f"n{e}") for e in range(epochs)]
    repeated = materialize(mix.where("size > 0").groupBy(F.col("src").alias("twin_src"), place.alias("twin")).agg(F.count("*").alias("n"), *counts).where("n > 1"))
    release(held)
    # the columns of a row stay together in one struct, so their names clash with nothing
    own = docs.select(F.struct("*").alias("row"), _source(docs).alias("src"), _place(docs, seed).alias("at"), F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(WORD).alias("worded"))
    times = sum((F.coalesce(F.col("at") <= F.col(f"end{e}"), F.lit(False)).cast("int") for e in range(epochs)), F.lit(0))
    taken = own.join(small(cuts), F.col("src") == F.col("cut_src"), "left").select("row", "src", "at", F.when(F.col("worded"), times).otherwise(0).alias("times"))
    if not repeated.isEmpty():
        # equal rows may be taken a different number of times: as many of them as the mix says, in order of all columns
        same, marked = (F.col("src") == F.col("twin_src")) & (F.col("at") == F.col("twin")), small(repeated)
        rank = F.row_number().over(Window.partitionBy("src", "at").orderBy(F.xxhash64("row")))
        again = taken.join(marked, same).select("row", sum(((rank <= F.col(f"n{e}")).cast("int") for e in range(epochs)), F.lit(0)).alias("times"))
        taken = taken.join(marked, same, "left_anti").select("row", "times").union(again)
    return taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    mix = fair_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"))
