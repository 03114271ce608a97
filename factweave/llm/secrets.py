"""Secret scan with corpus-wide ownership frequency, DataFrame functions only.

Each whole text is scanned once per kind of credential (``KINDS``, leftmost non-overlapping matches) and
for other long mixed tokens (``generic``). Candidate values are hashed and aggregated over the corpus by
distinct owners (``source``) and distinct repositories (``doc_id``): a value that several owners hold, or that
one owner holds in many repositories for its size, is a copied example; others look live. Few repositories
are at most ``LIVE_REPOSITORIES`` plus the binary logarithm of the owner's repositories. Base spans always stay
and are told apart by ``n_live``; generic candidates become spans only when live and outside base spans.

Repositories are made distinct per (value, owner, repository), then counted per (value, owner) and per value with
map-side partial aggregation, so a value pasted into a third of all rows never meets in one task; the join back
spreads each value over ``SALTS`` keys. Only digests and lengths leave the scan; texts are never shuffled. Positions are
running sums of lengths in a window per row, so a text costs its matches once, however many it has.
Defined cases: null text is empty; a null source is an owner of its own; rows that repeat a doc_id are one
repository, rows without one are a repository per distinct text; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import materialize, table

#: Kind -> pattern, in the order of ties.
KINDS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
GENERIC = r"[A-Za-z0-9+_=-]{24,}"
#: A value held by at most so many owners looks live.
LIVE_OWNERS = 1
#: ... in at most so many repositories, more by one each time its owner's repositories double.
LIVE_REPOSITORIES = 2


#: Keys that each value is spread over where spans meet their verdicts.
SALTS = 16
ORDER = (*KINDS, "generic")


def _pieces(text: Column, pattern: str, rank: int, value_group: int, least: int, holds=lambda v: F.lit(True)) -> Column:
    """Array of ``(rank, at, gap, length, value)`` of all matches: the characters since the match before, its own,
    and the digest of its value, null where the value has under ``least`` characters or does not hold."""
    pat = F.lit(pattern)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    value = whole if value_group == 0 else F.regexp_extract_all(text, pat, F.lit(value_group))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("p"), whole.alias("m"), value.alias("v"))

    def piece(x: Column, i: Column) -> Column:
        digest = F.when((F.char_length(x["v"]) >= least) & holds(x["v"]), F.sha2(x["v"], 256))
        return F.struct(F.lit(rank).alias("rank"), i.cast("int").alias("at"), F.char_length(x["p"]).cast("long").alias("gap"), F.char_length(x["m"]).cast("long").alias("length"), digest.alias("value"))

    empty = F.array().cast("array<struct<rank:int,at:int,gap:bigint,length:bigint,value:string>>")
    return F.when(text.rlike(pattern), F.transform(zipped, piece)).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, owner, repository, pieces``; written out once, so ``row`` is stable."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("owner")
    repository = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("n"), F.xxhash64(text))).alias("repository")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner, repository, text.alias("t"))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    pieces = F.concat(
        _pieces(F.col("t"), KINDS["assign"], 0, 2, 6),
        _pieces(F.col("t"), KINDS["access"], 1, 0, 20),
        _pieces(F.col("t"), KINDS["hex"], 2, 0, 24),
        _pieces(F.col("t"), GENERIC, 3, 0, 24, mixed),
    )
    return materialize(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", pieces.alias("pieces")))


def candidates(found: DataFrame) -> DataFrame:
    """``row, owner, repository, start, rank, end, value`` of every base span, and of the generic ones outside them."""
    each = found.select("row", "owner", "repository", F.inline("pieces")).repartition("row")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    spans = each.withColumn("end", end).where("value is not null").select("row", "owner", "repository", (F.col("end") - F.col("length")).alias("start"), "rank", "end", "value")
    base = F.col("rank") < len(KINDS)
    behind = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.max(F.when(base, F.col("end"))).over(behind)).withColumn("after", F.min(F.when(base, F.col("start"))).over(ahead))
    clear = (F.coalesce("before", "start") <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))
    # a base span may start where the generic one does
    return materialize(spans.where(base | clear).drop("before", "after"))


def ownership(spans: DataFrame) -> DataFrame:
    """``value, owners, repositories, owner`` of every candidate value (a digest); ``owner`` is one of its owners."""
    held = spans.select("owner", "repository", "value").distinct()
    return held.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.min("owner").alias("owner"))


def live_values(found: DataFrame, spans: DataFrame) -> DataFrame:
    """``value`` of every candidate that one owner holds in few repositories for the owner's size."""
    sizes = found.select("owner", "repository").distinct().groupBy("owner").agg(F.count("*").alias("size"))
    few = F.col("repositories") <= LIVE_REPOSITORIES + F.log2("size")
    return ownership(spans).where(F.col("owners") <= LIVE_OWNERS).join(sizes, "owner").where(few).select("value")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added, n_live``: base spans, live generic spans, and how many base spans look live."""
    found = scan(docs)
    spans = candidates(found)
    live = live_values(found, spans).select("value", F.lit(True).alias("live"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = spans.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(live, ["value", "salt"], "left")
    span = F.struct("start", "rank", "end", F.element_at(F.array(*map(F.lit, ORDER)), F.col("rank") + 1).alias("kind"))
    base = F.col("rank") < len(KINDS)
    judged = judged.groupBy("row").agg(F.collect_list(F.when(base, span)).alias("base"), F.collect_list(F.when(~base & F.col("live"), span)).alias("added"), F.count_if(base & F.col("live")).alias("n_live"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return found.select("row", "doc_id").join(judged, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), "n_live")
