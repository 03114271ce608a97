"""Benchmark decontamination: n-gram seeds, then Smith-Waterman on words.

Test items are a stated query set. Every 3-gram of an item is a seed, rare or common, so a copy is looked for
wherever it keeps three words in a row, and leaked copies cannot make an item's seeds too common to be used.
Every text is scanned whole for seeds; around the seeds of one item the words of text and item are aligned
locally (match 2, mismatch -1, gap -1), and a document is contaminated when the score reaches ``THRESHOLD``
of a perfect copy. Common seeds are cheap: a stretch whose words cannot reach that score in any alignment
(``ceiling``, an upper bound) is not aligned.

The scan has no shuffle: a hot passage is only more alignments on the tasks that hold its documents.
Items are sent out in blocks whose bytes are measured first and bounded by ``BLOCK_BYTES``; a larger
benchmark means more scans, never a larger broadcast, and a plan holds ``CHAIN`` blocks at most.

Defined cases: null or empty texts and items match nothing; items of one or two words use their whole
sequence as seed and match verbatim; a null doc_id or item_id is returned as null; repeated rows repeat their
matches, equal items count once; of equally good alignments the one that ends first in the item, then in the text, is
returned; an empty table of texts or items gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import materialize, release, table
from factweave.llm.wordkernel import Words, gram_hashes, grams_by_row, lean, strings_to_words, word_chunks

SEED_WORDS = 3
THRESHOLD = 0.4
BLOCK_BYTES = 8 << 20
#: Blocks of one plan; after so many its result is written.
CHAIN = 4
MATCH, MISMATCH, GAP = 2, -1, 1

MATCHES = "doc_id long, item_id long, score double, doc_start long, doc_end long, matched long"


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """``(score, start, end, matched)`` of the best local alignment of ``b`` inside ``a``; start and end
    are positions in ``a``. Each row is vectorised; the gap along the row is a running maximum. Only two rows are
    held, each cell with the start and the matches of its alignment, so memory is linear in the texts."""
    m = len(a)
    at = np.arange(m + 1)
    score, start, matched = np.zeros(m + 1, np.int64), at.copy(), np.zeros(m + 1, np.int64)
    best = (0, 0, 0, 0)
    for word in b:
        same = a == word
        across, down = score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] - GAP
        row, begin, hits = np.zeros(m + 1, np.int64), at.copy(), np.zeros(m + 1, np.int64)
        use = across >= down
        row[1:] = np.where(use, across, down)
        begin[1:] = np.where(use, start[:-1], start[1:])
        hits[1:] = np.where(use, matched[:-1] + same, matched[1:])
        none = row <= 0
        row[none], begin[none], hits[none] = 0, at[none], 0
        lifted = row + at * GAP
        high = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == high, at, 0))  # the cell that a gap along the row comes from
        score, start, matched = high - at * GAP, begin[came], hits[came]
        end = int(score.argmax())
        if score[end] > best[0]:
            best = (int(score[end]), int(start[end]), end, int(matched[end]))
    return best


class Seeds:
    """Seed hash -> item, with a small bitmap in front of the binary search."""

    def __init__(self, n: int, hashes: np.ndarray, items: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.n, self.hashes, self.items = n, hashes[order], items[order]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index in h, index of seed)`` pairs."""
        maybe = np.flatnonzero(self.bits[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, h[maybe], side="left")
        hi = np.searchsorted(self.hashes, h[maybe], side="right")
        times = hi - lo
        at = np.repeat(maybe, times)
        first = np.repeat(lo - np.r_[0, np.cumsum(times)[:-1]], times) if len(times) else lo
        return at, first + np.arange(len(at))


def choose_seeds(items: Words) -> list[Seeds]:
    """All 3-grams of the items (or the whole of shorter ones) as seeds, by length."""
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i in range(items.rows):
        lo, hi = int(items.bounds[i]), int(items.bounds[i + 1])
        n = min(SEED_WORDS, hi - lo)
        if n:
            found.setdefault(n, []).append((np.unique(gram_hashes(items.hashes[lo:hi], n)), i))
    return [Seeds(n, np.concatenate([g for g, _ in v]), np.repeat([i for _, i in v], [len(g) for g, _ in v])) for n, v in sorted(found.items())]


def ceiling(text: np.ndarray, words: np.ndarray) -> int:
    """A bound on the score of any local alignment: every word of the text that the item (``words``, sorted)
    lacks costs a mismatch or a gap, every other one gains a match at most."""
    has = words[np.minimum(np.searchsorted(words, text), len(words) - 1)] == text
    run = np.r_[0, np.cumsum(np.where(has, MATCH, -min(-MISMATCH, GAP)))]
    return int((run - np.minimum.accumulate(run)).max())


def _regions(where: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Stretches of sorted seed positions that no gap over ``reach`` splits."""
    cuts = np.flatnonzero(np.diff(where) > reach) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(where, cuts)]


class Block:
    """One block of test items with its seeds."""

    def __init__(self, item_ids: list[int | None], items: Words):
        self.ids, self.seeds = item_ids, choose_seeds(items)
        self.words = [items.hashes[items.bounds[i] : items.bounds[i + 1]] for i in range(items.rows)]
        self.sorted = [np.unique(x) for x in self.words]

    def matches(self, w: Words) -> list[tuple[int, int, float, int, int, int]]:
        """``(row, item index, score, start, end, matched)`` of the chunk's contaminated rows."""
        rows, items_, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s in self.seeds:
            row, pos, h = grams_by_row(w, s.n)
            i, k = s.hits(h)
            rows.append(row[i])
            items_.append(s.items[k])
            at.append(pos[i])
        r, it, p = np.concatenate(rows), np.concatenate(items_), np.concatenate(at)
        order = np.lexsort((p, it, r))
        r, it, p = r[order], it[order], p[order]
        cuts = np.r_[0, np.flatnonzero((r[1:] != r[:-1]) | (it[1:] != it[:-1])) + 1, len(r)] if len(r) else []
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            row, item = int(r[lo]), int(it[lo])
            text = w.hashes[w.bounds[row] : w.bounds[row + 1]]
            length = len(self.words[item])
            best = (0, 0, 0, 0)
            for a, b in _regions(p[lo:hi], 2 * length):
                # a long stretch is aligned in overlapping pieces, so memory stays bounded
                for x in range(max(0, a - 2 * length), b + 1, 20 * length + 1):
                    y = min(len(text), x + 24 * length + 1, b + 2 * length + SEED_WORDS)
                    if ceiling(text[x:y], self.sorted[item]) < max(THRESHOLD * MATCH * length, best[0] + 1):
                        continue
                    score, s, e, m = smith_waterman(text[x:y], self.words[item])
                    if score > best[0]:
                        best = (score, x + s, x + e, m)
            if best[0] >= THRESHOLD * MATCH * length:
                out.append((row, item, best[0] / (MATCH * length), best[1], best[2], best[3]))
        return out


def _scan(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_chunks(batch.column(1), lower=True):
                out = block.matches(w)
                ids = batch.column(0).take(pa.array([w.first + o[0] for o in out], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([block.ids[o[1]] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64()), *(pa.array([o[k] for o in out], pa.int64()) for k in (3, 4, 5))],
                    names=["doc_id", "item_id", "score", "doc_start", "doc_end", "matched"],
                )

    return run


def _without(block: Block, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for w in word_chunks(batch.column(column).cast(pa.string()), lower=True):
                clean[[w.first + o[0] for o in block.matches(w)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of at most ``block_bytes`` and one item more, measured before any is fetched."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = F.octet_length("text")
    total, longest = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    blocks = max(1, -(-total // block_bytes))
    deal = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while blocks > 1 and items.groupBy(deal(blocks).alias("b")).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] > block_bytes + longest:
        blocks *= 2
    for b in range(blocks):
        part = items.where(deal(blocks) == b).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        w = strings_to_words(part["text"].to_pylist(), lower=True) if part.num_rows else None
        if w is not None and len(w.hashes):
            yield Block(part["item_id"].to_pylist(), w)


def _cut(df: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``df`` written, twice over; the table written ``before`` is deleted. So a plan, and what a task and the driver hold at
    once, is a few blocks, however many there are."""
    out = materialize(df)
    if before is not None:
        release(before)
    return out, out


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, score, doc_start, doc_end, matched``: one row per contaminated document and
    item, positions in words."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = held = None
    for k, block in enumerate(_blocks(benchmark, block_bytes), 1):
        hits = slim.mapInArrow(lean(_scan(block)), MATCHES)
        found = hits if found is None else found.union(hits)
        if k % CHAIN == 0:
            found, held = _cut(found, held)
    return found if found is not None else docs.sparkSession.createDataFrame([], MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept. Each row is judged by its own text where it lies, so
    rows that share a doc_id, or have none, are kept or go by themselves, and nothing is shuffled."""
    out, held = docs, None
    for k, block in enumerate(_blocks(benchmark, block_bytes), 1):
        out = out.mapInArrow(lean(_without(block, docs.columns.index("text"))), docs.schema)
        if k % CHAIN == 0:
            out, held = _cut(out, held)
    return out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
