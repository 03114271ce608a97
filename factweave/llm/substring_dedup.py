"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed against all text that comes before it (smaller doc_id, or an earlier start in
the same document). A window is ``WINDOW`` = 20 consecutive words, unchanged; each word covered by a
window that also starts earlier is removed. Windows are judged on the input.

1. *Reference index.* Each text is cut by content: the least hash among the ten 11-word grams of each
   window selects an anchor, so equal windows select the same anchor at the same place, and about one
   gram in six is kept. One partial aggregation per anchor hash gives its first place in the corpus.
2. *Greedy factors.* A run of anchors of one document whose first places lie in one reference text at a
   constant distance overlaps word by word (anchors are longer than their spacing), so the run is one
   factor of that text; windows inside a factor are duplicates.
3. *Factor boundaries.* A window whose anchor occurred earlier but that no factor holds whole is
   looked up by a 128-bit hash among the windows whose anchor is a first place. The earliest copy of any
   window is always among these, so the result is exact.

A place is one long, the document's id shifted over the word position; ids too large for that, negative,
null or repeated ids are first replaced by their rank. Anchors are found once and written as 16-byte rows; they are
counted with map-side aggregation, and only those that the corpus repeats are joined back, so a passage that a third of
all documents hold is one row per task in the count and is split where it is joined. Only windows that repeat across
documents travel in step 3, each once per document. Texts meet their anchors by document; each step's tables are
deleted when the next is written.
Defined cases: null text has no words; a null doc_id sorts first; rows that repeat a doc_id with
different texts are documents of their own, in order of text hash, and rows repeated exactly count as one
document; texts under 20 words are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import global_rank, materialize, release, table
from factweave.llm.wordkernel import Words, gram_hashes, lean, word_chunks

WINDOW = 20
ANCHOR = 11
_SPAN = WINDOW - ANCHOR + 1
_SECOND = 0xB10C5


def _minimizers(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(window start, start of its anchor, all 11-gram hashes)`` over the whole chunk; windows lie
    inside one row. The leftmost of equal least hashes is taken."""
    h = gram_hashes(w.hashes, ANCHOR)
    n = len(w.hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), h

    def least(a: np.ndarray, step: int) -> np.ndarray:
        left, right = a[:-step], a[step:]
        return np.where(h[left] <= h[right], left, right)

    one = np.arange(len(h))
    two = least(one, 1)
    eight = least(least(two, 2), 4)
    ten = np.where(h[eight[:n]] <= h[two[8 : 8 + n]], eight[:n], two[8 : 8 + n])
    row = w.row_of_word()
    starts = np.flatnonzero(row[:n] == row[WINDOW - 1 : WINDOW - 1 + n])
    return starts, ten[starts], h


def _anchors(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in word_chunks(batch.column(1)):
                _, at, h = _minimizers(w)
                at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
                row = np.searchsorted(w.bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array((ids[w.first + row] << shift) + at - w.bounds[row])], names=["h", "place"])

    return run


class _Parsed:
    """Factors of the rows of one chunk: which windows are known copies, ask, or only answer.

    ``known`` lists, per row, ``(place, first place)`` of each anchor that the corpus repeats."""

    def __init__(self, w: Words, shift: int, known: pa.ListArray):
        starts, at, _ = _minimizers(w)
        offs = known.offsets.to_numpy()[w.first : w.first + w.rows + 1]
        place, first = (known.values.field(k).to_numpy()[offs[0] : offs[-1]] for k in range(2))
        row = np.repeat(np.arange(w.rows), np.diff(offs))
        order = np.lexsort((place, row))
        place, first = place[order], first[order]
        spot = w.bounds[row] + (place & ((1 << shift) - 1))  # of the anchor in the chunk
        earlier = first < place
        # factors: runs of anchors with one source text at one distance
        joined = np.zeros(len(spot), dtype=bool)
        if len(spot):
            joined[1:] = (row[1:] == row[:-1]) & earlier[1:] & earlier[:-1] & (first[1:] - first[:-1] == place[1:] - place[:-1]) & (first[1:] >> shift == first[:-1] >> shift) & (place[1:] - place[:-1] <= ANCHOR)
        heads = np.flatnonzero(~joined)
        tails = np.r_[heads[1:], len(spot)] - 1 if len(heads) else heads
        inside = np.zeros(len(w.hashes) + 1, dtype=np.int32)
        last = spot[tails] + ANCHOR - WINDOW  # the last window start a factor holds
        long = earlier[heads] & (last >= spot[heads])
        np.add.at(inside, spot[heads][long], 1)
        np.add.at(inside, last[long] + 1, -1)
        state = np.zeros(len(w.hashes) + 1, dtype=np.int8)  # 1: anchor seen earlier, 2: first place
        state[spot] = np.where(earlier, 1, 2)
        self.starts = starts
        self.inside = (np.cumsum(inside) > 0)[starts]
        self.asks = (state[at] == 1) & ~self.inside
        self.answers = state[at] == 2
        self.factored = self.inside.copy()
        # a window that repeats within its document is a copy there; only the first one is looked up
        self.h1 = gram_hashes(w.hashes, WINDOW, _SECOND)
        open_ = np.flatnonzero(self.asks | self.answers)
        key = self.h1[starts[open_]]
        owner = np.searchsorted(w.bounds, starts[open_], side="right") - 1
        order = np.lexsort((open_, key, owner))
        again = np.zeros(len(open_), dtype=bool)
        again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        self.inside[open_[again]] = True
        self.asks[open_[again]] = False


def _boundaries(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in word_chunks(batch.column(1)):
                p = _Parsed(w, shift, batch.column(2))
                at = p.starts[p.asks | p.answers]
                if not len(at):
                    continue
                h2 = gram_hashes(w.hashes, WINDOW, _SECOND + 1)
                row = np.searchsorted(w.bounds, at, side="right") - 1
                cols = [p.h1[at].view(np.int64), h2[at].view(np.int64), (ids[w.first + row] << shift) + at - w.bounds[row], p.asks[p.asks | p.answers]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "place", "asks"])

    return run


def _covered(starts: np.ndarray, words: int) -> np.ndarray:
    """Which words lie in a window that starts at one of ``starts``."""
    steps = np.bincount(starts, minlength=words + WINDOW + 1) - np.bincount(starts + WINDOW, minlength=words + WINDOW + 1)
    return np.cumsum(steps)[:words] > 0


def _remove(shift: int, emit_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, more = batch.column(0), batch.column(3)
            for w in word_chunks(batch.column(1)):
                p = _Parsed(w, shift, batch.column(2))
                offs = more.offsets.to_numpy()[w.first : w.first + w.rows + 1]
                row = np.repeat(np.arange(w.rows), np.diff(offs))
                hit = w.bounds[row] + (more.values.to_numpy()[offs[0] : offs[-1]] & ((1 << shift) - 1))
                keep = ~_covered(np.r_[p.starts[p.inside], hit], len(w.hashes))
                factored = np.r_[0, np.cumsum(_covered(p.starts[p.factored], len(w.hashes)))]
                kept, removed = [], np.zeros(w.rows, dtype=np.int64)
                for i in range(w.rows):
                    words, flags = w.text(i).split(), keep[w.bounds[i] : w.bounds[i + 1]]
                    removed[i] = len(flags) - np.count_nonzero(flags)
                    kept.append(b" ".join(compress(words, flags.tolist()) if removed[i] else words))
                out = [ids.slice(w.first, w.rows), pa.array(w.counts.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(np.diff(factored[w.bounds]))]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factored"]
                if emit_text:
                    out.append(pa.array(kept, pa.binary()).cast(pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc, text, doc_id`` with ``doc`` ordered as doc_id, unique and small enough that it and a word
    position fit one long; and how many bits the position takes."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low, high, size, nulls = slim.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.count_if(F.col("doc_id").isNull())).first()
    shift = ((size or 0) // 2 + 2).bit_length()
    plain = not nulls and (low or 0) >= 0 and (high or 0).bit_length() + shift <= 62
    if plain and slim.groupBy("doc_id").count().where("count > 1").isEmpty():
        return slim.select(F.col("doc_id").alias("doc"), "text", "doc_id"), shift
    keyed = slim.withColumn("th", F.xxhash64("text")).withColumn("null_last", F.col("doc_id").isNotNull().cast("int"))
    ids = materialize(keyed.select("doc_id", "th", "null_last").distinct())
    ranked = global_rank(ids, [F.col("null_last"), F.col("doc_id"), F.col("th")], "doc").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "doc")
    ranked = materialize(ranked)
    release(ids)
    return keyed.join(ranked, keyed["doc_id"].eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc", "text", "doc_id"), shift


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, n_factored`` (and ``kept_text``) for every row of ``docs``;
    ``n_factored`` counts the removed words that factors alone cover."""
    slim, shift = _placed(docs)
    doc = F.coalesce(F.shiftright("place", shift), F.lit(0).cast("long")).alias("doc")
    anchors = materialize(slim.select("doc", "text").mapInArrow(lean(_anchors(shift)), "h long, place long"))
    first = materialize(anchors.groupBy("h").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"))
    known = materialize(anchors.join(first, "h").groupBy(doc).agg(F.collect_set(F.struct("place", "first")).alias("known")))
    release(anchors, first)
    none = F.array().cast("array<struct<place:bigint,first:bigint>>")
    met = slim.join(known, "doc", "left").select("doc", "text", F.coalesce("known", none).alias("known"), "doc_id")
    edges = materialize(met.mapInArrow(lean(_boundaries(shift)), "h1 long, h2 long, place long, asks boolean"))
    earliest = materialize(edges.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"))
    hits = materialize(edges.where("asks").join(earliest, ["h1", "h2"]).where("place > first").groupBy(doc).agg(F.collect_set("place").alias("more")))
    release(edges, earliest)
    full = met.join(hits, "doc", "left").select("doc_id", "text", "known", F.coalesce("more", F.array().cast("array<bigint>")).alias("more"))
    return full.mapInArrow(lean(_remove(shift, with_text)), "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factored long" + ", kept_text string" * with_text)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
