"""Line dedup: lines that many documents share are dropped wherever they stand.

Each text is cut at line feeds and exploded to normalised lines (blanks stripped at both ends, A-Z lower-cased),
which are hashed to 128 bits. Documents are counted per hash in two steps: first one row per hash and document,
dealt by both, then one count per hash with map-side sums, so a line that every document holds is one row a task.
Hashes of at least ``min_docs`` documents are looked up among the lines again, and the places they hold are
gathered per document and joined with it, and the lines left are put together by position. Texts are shuffled once and
not sorted.

The lookup never meets a hot key: the hashes that hold at least one in ``HEAVY`` of all shared places are at most
``HEAVY`` and are broadcast; the rest are broadcast too if they are few, and shuffled otherwise.

Defined cases: a null or empty text is one empty line, whose key has no code points and is never dropped; a
document is a doc_id (null is an id like any other), so rows that repeat an id count once, and each row keeps its own
text; lines of blanks only are kept; a text that loses all lines becomes empty; an empty table gives no rows;
other columns are kept by ``drop_shared_lines`` whatever their names and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import lower_ascii, materialize, release, table

MIN_DOCS = 10
#: Characters stripped from a key at both ends.
BLANKS = " \t\n\x0b\x0c\r"
#: At most so many hashes are broadcast.
HEAVY = 100_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(lower_ascii(line), F.lit(BLANKS))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(13), key).alias("h2"))


def _keyed(docs: DataFrame, payload: str = "text") -> DataFrame:
    """``id, body`` of every row: the document, and a hash that tells rows of one id apart."""
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("body"), payload)


def shared_hashes(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """``h, n``: hashes of the keys that ``min_docs`` documents or more hold."""
    keys = F.transform(lines(F.col("text")), line_key)
    mine = F.array_distinct(F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars), _hash))
    once = docs.select(F.col("doc_id").alias("id"), F.explode(mine).alias("h")).groupBy("h", "id").agg(F.lit(1).alias("one"))
    return once.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)


def _looked_up(placed: DataFrame, shared: DataFrame, heavy: int) -> DataFrame:
    """Rows of ``placed`` whose ``h`` is in ``shared``."""
    rows, places = shared.agg(F.count("*"), F.sum("n")).first()
    if rows <= heavy:
        return placed.join(F.broadcast(shared.select("h")), "h", "left_semi")
    hot = shared.withColumn("hot", F.col("n") * heavy >= places)
    marked = placed.join(F.broadcast(hot.where("hot").select("h", "hot")), "h", "left")
    rest = marked.where("hot is null").join(hot.where("not hot").select("h").hint("shuffle_hash"), "h", "left_semi")
    return marked.where("hot").union(rest).drop("hot")


def dropped_places(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, heavy: int = HEAVY) -> DataFrame:
    """``id, body, drop``: the places (from 0) of the lines that go, for rows that lose any."""
    shared = materialize(shared_hashes(docs, min_docs, min_chars))
    placed = _keyed(docs).select("id", "body", F.posexplode(lines(F.col("text"))).alias("place", "line"))
    keyed = placed.select("id", "body", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hit = _looked_up(keyed.select("id", "body", "place", _hash(F.col("key")).alias("h")), shared, heavy)
    out = materialize(hit.groupBy("id", "body").agg(F.collect_set("place").alias("drop")))
    release(shared)
    return out


def _left(text: Column, drop: Column) -> Column:
    """``text`` and the count of its lines, with the lines at ``drop`` (null: none) left out."""
    first = F.lit(0)

    def put(found: Column) -> Column:
        stay = F.array_except(F.sequence(first, F.size(found) - 1), drop)
        kept = F.when(drop.isNull(), text).when(F.size(stay) == 0, "").otherwise(F.array_join(F.transform(stay, lambda i: F.get(found, i)), "\n"))
        return F.struct(kept.alias("text"), F.size(found).cast("long").alias("n_lines"))

    return F.transform(F.array(lines(text)), put)[0]  # a text is split once


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, heavy: int = HEAVY) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``text`` without the lines that go, ``n_lines`` before and ``n_dropped``."""
    places = dropped_places(docs, min_docs, min_chars, heavy)
    theirs = places.select(F.col("id").alias("id2"), F.col("body").alias("body2"), "drop").hint("shuffle_hash")
    mine = _keyed(docs.select(F.struct("*").alias("row"), "doc_id", "text"), "row")
    met = mine.join(theirs, mine["id"].eqNullSafe(F.col("id2")) & (F.col("body") == F.col("body2")), "left")
    done = met.select("row", _left(F.col("row.text"), F.col("drop")).alias("out"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
    return done.select("row", "out.text", "out.n_lines", "n_dropped")


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
