"""N-gram Jaccard join over whole texts by count vectors in an R-tree.

A document is its set of distinct 5-word shingles (lower-cased A-Z). The shingle space is cut into
groups by leading hash bits; a set becomes the point of its counts per group, and the summed coordinate minima
of two points bound their overlap from above. Two documents link when ``9 * overlap >= 4 * (a + b)``
(Jaccard 0.8), so a pair whose bound fails that test is dropped unseen; survivors are verified on
their whole texts.

Plan, all exact:

1. one pass gives each document its set size, a 128-bit set digest, its point, and its *prefix*: the
   first ``n - ceil(0.8 n) + 1`` shingles in a fixed global order. Two linked sets share a prefix
   shingle. Frequent shingles (a bounded list, found on a sample) come last in that order; the list
   only steers speed, any list gives the same links.
2. equal sets collapse to one class, named by its smallest row number (never by doc_id, which may be null or
   repeat).
3. *Contraction.* Prefix shingles held by at least two classes tie each class to the smallest and the largest
   class of the shingle; these star edges are bounded, verified and contracted to components, so a family of
   copies costs a few edges each, not a square.
4. *Index.* Shingles of four classes or more are searched in full where they still hold several components: holders
   (of all such shingles with one smallest holder together) are dealt to windows of like set size, the points of a window are bulk-loaded into R-trees of bounded blocks, block
   against block, and searched across components. A tile answers with a spanning forest of the components that the
   bound ties, best bound first, never with all pairs; its edges are verified.
5. *Near misses.* Where an edge of a forest fails and its ends are still apart, its tile is searched again on
   whole shingle sets, which settles every pair of the tile; again only a spanning forest leaves it.
6. every link lies inside one component, so the links are counted there: all pairs of a component's classes, linked
   on the way or not, are compared on their whole shingle sets, in tiles of two bounded blocks of classes. A tile
   returns sums per class, never a row per pair.

Points have a group for one or two shingles and are deflated, about a hundred bytes a document, so that texts travel
only for pairs that link or nearly do. Tables behind a step are deleted as soon as no later step reads them.

Defined cases: null or empty text has 0 shingles and links with nothing; fewer than five words give
the whole sequence as one shingle; rows that repeat a doc_id keep their own size, and links of any of
them count for the id; rows without a doc_id link like all others; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import components, materialize, release, small, table
from factweave.llm.wordkernel import Words, gram_hashes, grams_by_row, lean, mix, word_chunks

SHINGLE = 5
#: A tree holds about so many classes and shingles; its leaves and nodes so many points and children.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19
LEAF, FAN = 32, 8
TILE = 96
#: Sizes of linked sets differ by a factor of at most 1.25; windows of sizes are a little wider.
WINDOW = 1.26
#: A block of classes whose links are counted holds about so many shingles and classes.
LINK_SHINGLES, LINK_CLASSES = 1 << 19, 4096
#: A shingle is frequent when this many documents of a 1/64 sample hold it; at most so many are listed.
SAMPLE, FREQUENT_DF, FREQUENT_MAX = 64, 6, 200_000
_KEY_BYTES = 6


def shingle_sets(w: Words) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct shingle hashes."""
    row, _, h = grams_by_row(w, SHINGLE)
    cuts = np.searchsorted(row, np.arange(w.rows + 1))
    counts = w.counts
    for i in range(w.rows):
        if counts[i] >= SHINGLE:
            s = np.sort(h[cuts[i] : cuts[i + 1]])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif counts[i]:
            yield gram_hashes(w.hashes[w.bounds[i] : w.bounds[i + 1]], int(counts[i]))
        else:
            yield np.empty(0, np.uint64)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - _KEY_BYTES :]).tobytes()


def _point(s: np.ndarray) -> bytes:
    """Counts per group, one group (of a power of two) for one or two shingles, so that unrelated sets of any size, and
    sets that share half of their shingles, stay apart; deflated. Header: log2 of the groups, bytes per count."""
    bits = max(4, int(max(len(s), 1) - 1).bit_length() - 1)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    width = 1 if len(s) == 0 or counts.max() < 256 else 4
    return bytes((bits, width)) + zlib.compress(counts.astype("<u1" if width == 1 else "<u4").tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[2:]), dtype="<u1" if blob[1] == 1 else "<u4")


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    """The same set's counts over fewer, coarser groups."""
    if len(point) == groups:
        return point.astype(np.int32)
    return point.reshape(groups, -1).sum(axis=1, dtype=np.int32)


SIGNATURE = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, point binary, prefix binary"


def _signatures(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_chunks(batch.column(1), lower=True):
                sizes, d1, d2, points, prefixes = [], [], [], [], []
                for s in shingle_sets(w):
                    sizes.append(len(s))
                    d1.append(np.add.reduce(mix(s)).astype(np.int64) if len(s) else 0)
                    d2.append(np.add.reduce(mix(s ^ np.uint64(0xA5A5F00D12345678))).astype(np.int64) if len(s) else 0)
                    points.append(_point(s))
                    p = prefix_length(len(s))
                    if len(frequent) and len(s):
                        common = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                        s = np.r_[s[~common][:p], s[common][:p]]
                    prefixes.append(_pack(s[:p]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.rows), batch.column(2).slice(w.first, w.rows), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(points, pa.binary()), pa.array(prefixes, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "point", "prefix"],
                )

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in word_chunks(batch.column(1), lower=True):
            sets = list(shingle_sets(w))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(sets) if sets else np.empty(0, np.uint64)).view(np.int64))], names=["h"])


def frequent_shingles(slim: DataFrame) -> np.ndarray:
    """Sorted hashes of at most ``FREQUENT_MAX`` shingles that a 1/``SAMPLE`` sample shows often."""
    sample = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    rows = sample.mapInArrow(lean(_sampled), "h long").groupBy("h").count().where(F.col("count") >= FREQUENT_DF).orderBy(F.desc("count"), "h").limit(FREQUENT_MAX)
    return np.sort(rows.select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(1).cast(pa.large_binary())
        for at in range(0, batch.num_rows, 512):
            part = blobs.slice(at, 512)
            ids = batch.column(0).slice(at, 512).to_numpy(zero_copy_only=False)
            lengths = [len(b) // _KEY_BYTES for b in part.to_pylist()]
            raw = np.frombuffer(b"".join(part.to_pylist()), dtype=np.uint8).reshape(-1, _KEY_BYTES)
            wide = np.zeros((len(raw), 8), dtype=np.uint8)
            wide[:, :_KEY_BYTES] = raw
            yield pa.RecordBatch.from_arrays([pa.array(wide.view("<i8").ravel()), pa.array(np.repeat(ids, lengths))], names=["key", "cls"])


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of points, row by row or broadcast."""
    return np.minimum(a, b).sum(axis=-1)


class PointTree:
    """R-tree over the points ``rows`` of a matrix, bulk-loaded by component (large ones apart), size and least
    occupied group. A node keeps its upper corner, its least and largest size and its component if it has one only;
    lower corners bound nothing here, as minima only fall with them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, rows: np.ndarray):
        self.points, self.sizes, self.comps = points, sizes, comps
        _, at, many = np.unique(comps[rows], return_inverse=True, return_counts=True)
        apart = np.where(many[at] >= LEAF, at, -1)
        by_size = rows[np.lexsort((sizes[rows], apart))]
        slab = np.arange(len(rows)) // (LEAF * FAN)
        order = by_size[np.lexsort(((points[by_size] > 0).argmax(axis=1), slab))]
        level = [self._node(order[k : k + LEAF], None) for k in range(0, len(order), LEAF)]
        while len(level) > FAN:
            level = [self._node(np.concatenate([n[0] for n in level[k : k + FAN]]), level[k : k + FAN]) for k in range(0, len(level), FAN)]
        self.top = level

    def _node(self, rows: np.ndarray, children: list | None) -> tuple:
        corner = self.points[rows].max(axis=0) if children is None else np.max([c[1] for c in children], axis=0)
        own = self.comps[rows]
        return rows, corner, self.sizes[rows].min(), self.sizes[rows].max(), own[0] if (own == own[0]).all() else None, children

    def search(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(asked row, found row, bound)`` of rows of different components whose bound reaches the threshold."""
        for at in range(0, len(asked), 256):
            for node in self.top:
                yield from self._visit(node, asked[at : at + 256])

    def _visit(self, node: tuple, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows, corner, least, most, comp, children = node
        fits = (5 * self.sizes[q] >= 4 * least) & (4 * self.sizes[q] <= 5 * most)
        if comp is not None:
            fits &= self.comps[q] != comp
        q = q[fits]
        if len(q):
            q = q[9 * overlap_bound(self.points[q], corner) >= 4 * (self.sizes[q] + least)]
        if not len(q):
            return
        if children is not None:
            for c in children:
                yield from self._visit(c, q)
            return
        body = self.points[rows]
        for i in q:
            bound = overlap_bound(body, self.points[i])
            near = (9 * bound >= 4 * (self.sizes[i] + self.sizes[rows])) & (self.comps[rows] != self.comps[i])
            if near.any():
                yield np.full(np.count_nonzero(near), i), rows[near], bound[near]


def same_groups(points: list[np.ndarray]) -> np.ndarray:
    """Points as one matrix, all folded to the coarsest."""
    groups = min(len(p) for p in points)
    folded = [fold(p, groups) for p in points]
    return np.stack(folded).astype(np.uint8 if max(int(p.max()) for p in folded) < 256 else np.int32)


def tree_pairs(points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``(left row, right row, bound)`` of different components whose bound reaches the threshold."""
    found = list(PointTree(points, sizes, comps, right).search(left))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


class _Forest:
    """Labels that are joined one edge at a time."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


#: Pairs of a tile that are held at once, beside its forest.
PAIRS = 1 << 17
TILE_ROWS = "key long, tile long, half int, cls long, comp long, n long"
EDGE = "a long, b long, key long, tile long"


def _edges(t: pa.Table, found: list[tuple[int, int]]) -> pa.RecordBatch:
    n = len(found)
    ends = [pa.array([f(p) for p in found], pa.int64()) for f in (min, max)]
    return pa.RecordBatch.from_arrays([*ends, *(pa.array([t[c][0].as_py()] * n, pa.int64()) for c in ("key", "tile"))], names=["a", "b", "key", "tile"])


def _bound_forest(t: pa.Table) -> pa.RecordBatch:
    """The tile's spanning forest of components that the bound ties, by falling bound. ``half`` 0 is joined with
    ``half`` 1, or with itself where the tile has only half 0."""
    cls, n, half, comp = (t[c].to_numpy() for c in ("cls", "n", "half", "comp"))
    points = same_groups([_unpack(x) for x in t["payload"].to_pylist()])
    one, two = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
    i, j, bound = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    held, size = [], 0
    for found in PointTree(points, n, comp, two if len(two) else one).search(one):
        held.append(found)
        size += len(found[0])
        if size >= PAIRS:
            i, j, bound = _best_forest([(i, j, bound), *held], n, comp, cls)
            held, size = [], 0
    i, j, _ = _best_forest([(i, j, bound), *held], n, comp, cls)
    return _edges(t, list(zip(cls[i].tolist(), cls[j].tolist())))


def _best_forest(parts: list[tuple], n: np.ndarray, comp: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs ``(i, j, bound)``, those of the spanning forest of components by falling bound. Pairs have one order, so
    the forest of a part and more pairs is the forest of all."""
    i, j, bound = (np.concatenate(x) for x in zip(*parts))
    share = bound / (n[i] + n[j])
    low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
    order = np.lexsort((cls[j], cls[i], -share, high, low))
    first = order[np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]] if len(order) else order
    forest = _Forest()
    first = first[np.lexsort((high[first], low[first], -share[first]))]
    kept = np.array([k for k in first if forest.join(int(low[k]), int(high[k]))], dtype=np.int64)
    return i[kept], j[kept], bound[kept]


def _exact_forest(t: pa.Table) -> pa.RecordBatch:
    """The tile's spanning forest of components that links tie, from whole shingle sets."""
    _, once = np.unique(t["cls"].to_numpy(), return_index=True)  # equal rows bring a class's text twice
    t = t.take(once)
    sets = [s for w in word_chunks(t["payload"], True) for s in shingle_sets(w)]
    cls, half, comp = (t[c].to_numpy() for c in ("cls", "half", "comp"))
    forest, found = _Forest(), []
    for i, partners in _partners(sets, half):
        found += [(int(cls[i]), int(cls[j])) for j in partners[comp[partners] != comp[i]] if forest.join(int(comp[i]), int(comp[j]))]
    return _edges(t, found)


def _partners(sets: list[np.ndarray], half: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(i, rows that i links with)``: rows of half 0 against half 1, or against the rows after them in half 0 where
    there is no other. One row is marked at a time, and all sets of like size count their marks at once."""
    n = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(n)[:-1])
    by_size = np.argsort(n, kind="stable")
    one, two = by_size[half[by_size] == 0], by_size[half[by_size] == 1]
    alone = not len(two)
    two = one if alone else two
    starts = np.r_[0, np.cumsum(n[two])]
    held, mark = np.concatenate([own[i] for i in two]), np.zeros(len(flat), dtype=np.uint8)
    for at, i in enumerate(one):
        lo = max(int(np.searchsorted(5 * n[two], 4 * n[i])), at + 1 if alone else 0)
        hi = int(np.searchsorted(4 * n[two], 5 * n[i], side="right"))
        if lo >= hi:
            continue
        mark[own[i]] = 1
        both = np.add.reduceat(mark[held[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mark[own[i]] = 0
        near = two[lo:hi][9 * both >= 4 * (n[i] + n[two[lo:hi]])]
        if len(near):
            yield int(i), near


def _by_tile(batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``solve`` of each run of rows that share a tile (the first two columns)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(2)], axis=1)
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            this = tuple(keys[lo])
            if this != last and held:
                yield solve(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = this
    if held:
        yield solve(pa.Table.from_batches(held))


def _tested(t: pa.Table, loaded: Iterator[np.ndarray], test: Callable[[np.ndarray, np.ndarray], bool]) -> pa.RecordBatch:
    """The tile's pairs that pass ``test`` on what ``loaded`` gives for each row; rows that repeat a document
    pass if any of them does."""
    docs, held = t["doc"].to_pylist(), {}
    for d, x in zip(docs, loaded):
        held.setdefault(d, []).append(x)
    found = [(d, q) for d, partners in zip(docs, t["partners"].to_pylist()) for q in partners if any(test(x, y) for x in held[d] for y in held.get(q, ()))]
    ends = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*ends, pa.array([t["grp"][0].as_py()] * len(found), pa.int64())], names=["a", "b", "grp"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _by_tile(batches, lambda t: _tested(t, (s for w in word_chunks(t["payload"], True) for s in shingle_sets(w)), linked))


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def may_link(x: np.ndarray, y: np.ndarray) -> bool:
        groups = min(len(x), len(y))
        bound = int(np.minimum(x, y).sum(dtype=np.int64) if len(x) == len(y) else np.minimum(fold(x, groups), fold(y, groups)).sum())
        return 9 * bound >= 4 * int(x.sum(dtype=np.int64) + y.sum(dtype=np.int64))

    return _by_tile(batches, lambda t: _tested(t, (_unpack(b.as_py()) for b in t["payload"]), may_link))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets reach the similarity, exactly."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or 9 * min(len(a), len(b)) < 4 * n:
        return False
    return 9 * np.intersect1d(a, b, assume_unique=True).size >= 4 * n


def tiled(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """Rows ``grp, tile, doc, partners, payload`` sorted by tile, from pairs ``a, b, grp`` and ``doc, payload``.

    The pairs of a group are cut into tiles of two blocks of ``TILE`` documents, and a payload travels once per
    tile, however many pairs it has there: families of close copies cost their documents, not their pairs. Tiles are
    told apart by one hash, so a large group is dealt out by its tiles."""
    ends = pairs.select("grp", F.col("a").alias("doc")).union(pairs.select("grp", F.col("b").alias("doc"))).distinct()
    blocks = ends.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(F.lit(5), c), F.col("blocks")).cast("int")
    cut = pairs.join(blocks, "grp").select("grp", F.xxhash64("grp", block(F.col("a")), block(F.col("b"))).alias("tile"), "a", "b")
    rows = cut.select("tile", "grp", F.col("a").alias("doc"), F.col("b").alias("partner")).union(cut.select("tile", "grp", F.col("b").alias("doc"), F.lit(None).cast("long").alias("partner")))
    rows = rows.groupBy("tile", "doc").agg(F.min("grp").alias("grp"), F.collect_set("partner").alias("partners"))
    return rows.join(payload, "doc").select(F.lit(0).cast("long").alias("one"), "tile", "grp", "doc", "partners", "payload").repartition("tile").sortWithinPartitions("tile")


def _texts(slim: DataFrame, sig: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, payload``: the texts of the class rows ``doc`` of ``ids``; and the table behind it. Up to a checked
    number they are sent to the texts, beyond it the texts are shuffled to them."""
    wanted = materialize(sig.join(ids.select(F.col("doc").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("doc"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    return slim.join(small(wanted), slim["doc_id"].eqNullSafe(F.col("_id")) & (slim["text_hash"] == F.col("_hash"))).select("doc", F.col("text").alias("payload")), wanted


def verify_pairs(pairs: DataFrame, slim: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of classes that link, from ``a, b, grp``: first by their points, then, for the few that
    are left, on whole texts."""
    points = sig.select(F.col("row").alias("doc"), F.col("point").alias("payload"))
    near = materialize(tiled(pairs, points).mapInArrow(lean(_refine), "a long, b long, grp long").groupBy("a", "b").agg(F.min("grp").alias("grp")))
    texts, wanted = _texts(slim, sig, near.select(F.col("a").alias("doc")).union(near.select(F.col("b").alias("doc"))))
    out = materialize(tiled(near, texts).mapInArrow(lean(_verify), "a long, b long, grp long").select("a", "b").distinct())
    release(near, wanted)
    return out


def _tree_tiles(wide: DataFrame) -> DataFrame:
    """``TILE_ROWS`` of the windows of a key and a size that hold several components, from ``key, cls, comp, n``.

    Only pairs across components matter, so the holders outside a window's largest component are joined with
    it, in blocks, and among themselves; the largest component is not joined with itself, windows with the
    same holders are searched once, and windows without holders of their own size not at all."""
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(WINDOW)))
    wide = wide.withColumn("window", F.explode(F.array(size, size + 1))).withColumn("own", F.col("window") == size).withColumn("key", F.xxhash64("key", "window")).drop("window")
    per = wide.groupBy("key", "comp").agg(F.max("own").alias("own"), F.count("*").alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("cls")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "cls")).alias("s2"))
    keys = per.groupBy("key").agg(F.max(F.struct("c", "comp", "w")).alias("top"), F.count("*").alias("parts"), F.sum("c").alias("m"), F.sum("w").alias("w"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.max("own").alias("own")).where("parts > 1 and own")
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    keys = keys.groupBy("m", "s1", "s2").agg(F.min(F.struct("key", "top", "w")).alias("k")).select(
        "m", "k.key", F.col("k.top.comp").alias("big"), blocks(F.col("k.top.c"), F.col("k.top.w")).alias("ng"), blocks(F.col("m") - F.col("k.top.c"), F.col("k.w") - F.col("k.top.w")).alias("no")
    )
    inside = F.col("comp") == F.col("big")
    block = F.pmod(F.xxhash64(F.lit(3), "cls"), F.when(inside, F.col("ng")).otherwise(F.col("no"))).cast("long")
    rows = wide.join(keys, "key").withColumn("b", block)
    cell = lambda tile, half: F.struct(tile.cast("long").alias("tile"), half.cast("int").alias("half"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_outside = F.transform(to("no"), lambda j: cell(j * F.col("ng") + F.col("b"), F.lit(1)))
    with_big = F.transform(to("ng"), lambda i: cell(F.col("b") * F.col("ng") + i, F.lit(0)))
    among = F.transform(to("no"), lambda k: cell(F.col("ng") * F.col("no") + F.least(F.col("b"), k) * F.col("no") + F.greatest(F.col("b"), k), F.col("b") > k))
    # a window of one block is one tile
    cells = F.explode(F.when((F.col("ng") == 1) & (F.col("no") == 1) & (F.col("m") <= BLOCK), F.array(cell(F.lit(0), F.lit(0)))).when(inside, with_outside).otherwise(F.concat(with_big, among)))
    return rows.withColumn("cell", cells).select("key", "cell.tile", "cell.half", "cls", "comp", F.col("n").cast("long").alias("n"))


def _in_tiles(tiles: DataFrame, payload: DataFrame, solve: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """``EDGE`` rows from ``solve`` on each tile with the payloads ``doc, payload`` of its classes."""
    rows = tiles.join(payload, F.col("cls") == F.col("doc")).select("key", "tile", "half", "cls", "comp", "n", "payload")
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(lean(lambda batches: _by_tile(batches, solve)), EDGE)


def _slim(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))


def _count_tile(t: pa.Table) -> pa.RecordBatch:
    """``cls, links`` of a tile: the rows behind the classes that each class links with, all pairs compared exactly."""
    _, once = np.unique(t["cls"].to_numpy(), return_index=True)  # equal rows bring a class's text twice
    t = t.take(once)
    sets = [s for w in word_chunks(t["payload"], True) for s in shingle_sets(w)]
    cls, rows, half = (t[c].to_numpy() for c in ("cls", "rows", "half"))
    links = np.zeros(len(sets), dtype=np.int64)
    for i, near in _partners(sets, half):
        links[i] += rows[near].sum()
        links[near] += rows[i]
    return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(links)], names=["cls", "links"])


def link_counts(classes: DataFrame, slim: DataFrame, sig: DataFrame) -> DataFrame:
    """``cls, links``: the rows of other classes that the rows of each class link with, from ``grp, cls, rows,
    n_shingles``; classes alone in their component are left out."""
    blocks = F.ceil(F.greatest(F.sum("n_shingles") / LINK_SHINGLES, F.count("*") / LINK_CLASSES)).cast("int")
    wide = classes.groupBy("grp").agg(F.count("*").alias("m"), blocks.alias("blocks")).where("m > 1").select("grp", "blocks")
    members = materialize(classes.join(wide, "grp").select("grp", "cls", "rows", "blocks", F.pmod(F.xxhash64(F.lit(9), "cls"), F.col("blocks")).cast("int").alias("b")))
    texts, wanted = _texts(slim, sig, members.select(F.col("cls").alias("doc")))
    cell = lambda k: F.struct(F.xxhash64("grp", F.least("b", k), F.greatest("b", k)).alias("tile"), (F.col("b") > k).cast("int").alias("half"))
    tiles = members.join(texts, F.col("cls") == F.col("doc")).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)))
    tiles = tiles.select("grp", "cell.tile", "cell.half", "cls", "rows", "payload").repartition("tile").sortWithinPartitions("grp", "tile")
    out = materialize(tiles.mapInArrow(lean(lambda batches: _by_tile(batches, _count_tile)), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links")))
    release(members, wanted)
    return out


def _components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """``cls, n, comp`` of every class."""
    comp = components(links)
    out = materialize(classes.join(comp, F.col("cls") == comp["id"], "left").select("cls", F.col("n_shingles").alias("n"), F.coalesce("component", "cls").alias("comp")))
    release(comp)
    return out


def linked_classes(sig: DataFrame, classes: DataFrame, slim: DataFrame) -> DataFrame:
    """``cls, n, comp`` of every class: the components of all links between classes."""
    same = ["d1", "d2", "n_shingles"]
    copies = materialize(sig.select("row", *same).join(classes.select("cls", *same), same).where("row <> cls").select("row"))
    keys = sig.select("row", "prefix").join(small(copies), "row", "left_anti").mapInArrow(lean(_keys), "key long, cls long")
    # counted first and joined back then, so that only one shuffle of the keys lies on disk at a time
    shared = materialize(keys.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("members")).where("low < high"))
    held = materialize(keys.join(shared, "key"))
    release(copies, shared)

    sizes = classes.select("cls", "n_shingles")
    first = held.select(F.col("low").alias("a"), F.col("cls").alias("b"), F.col("low").alias("grp")).union(held.select(F.col("cls").alias("a"), F.col("high").alias("b"), F.col("low").alias("grp")))
    first = first.where("a < b").groupBy("a", "b").agg(F.min("grp").alias("grp")).join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    first = materialize(first.where(9 * F.least("na", "nb") >= 4 * (F.col("na") + F.col("nb"))).select("a", "b", "grp"))
    links = verify_pairs(first, slim, sig)
    comp = _components(links, classes)
    # shingles with the same smallest holder are searched as one: a passage's shingles have much the same holders
    crowded = materialize(held.where("members > 3").select(F.col("low").alias("key"), "cls").distinct().join(comp, "cls"))
    release(held, first)

    tiles = materialize(_tree_tiles(crowded))
    points = sig.select(F.col("row").alias("doc"), F.col("point").alias("payload"))
    edges = materialize(_in_tiles(tiles, points, _bound_forest))
    release(crowded)
    if not edges.isEmpty():
        more = verify_pairs(edges.groupBy("a", "b").agg(F.min("a").alias("grp")), slim, sig)
        links, before, old = materialize(links.union(more)), links, comp
        comp = _components(links, classes)
        release(before, old)
        at = comp.select("cls", "comp")
        missed = edges.join(more, ["a", "b"], "left_anti").join(at.toDF("a", "ca"), "a").join(at.toDF("b", "cb"), "b").where("ca <> cb")
        missed = materialize(missed.select("key", "tile").distinct())
        if not missed.isEmpty():
            left = materialize(tiles.drop("comp").join(missed, ["key", "tile"]).join(at, "cls"))
            texts, wanted = _texts(slim, sig, left.select(F.col("cls").alias("doc")))
            rest = materialize(_in_tiles(left, texts, _exact_forest))
            old, comp = comp, _components(links.union(rest.select("a", "b")), classes)
            release(left, wanted, rest, old)
        release(more, missed)
    release(tiles, edges, links)
    return comp


def row_groups(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """``doc_id, text_hash, n_shingles, grp, component_id`` for every row of ``docs``: rows share ``grp`` when
    links join their texts, whatever their ids; ``component_id`` is the group's smallest doc_id. With
    ``count_links`` also ``n_links``, the number of other rows that each row links with."""
    slim = _slim(docs)
    sig = materialize(slim.mapInArrow(lean(_signatures(frequent_shingles(slim))), SIGNATURE).withColumn("row", F.monotonically_increasing_id()))
    classes = sig.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("row").alias("cls"), F.min("doc_id").alias("low_id"), F.count("*").alias("rows"))
    classes = materialize(classes)
    comp = linked_classes(sig, classes, slim)
    grouped = materialize(classes.join(comp.select("cls", F.col("comp").alias("grp")), "cls"))
    release(classes, comp)
    least = grouped.groupBy("grp").agg(F.min("low_id").alias("component_id"))
    named = grouped.join(least, "grp")
    wanted, tables = ["doc_id", "text_hash", "n_shingles", F.coalesce("grp", "row").alias("grp"), F.coalesce("component_id", "doc_id").alias("component_id")], [sig, grouped]
    if count_links:
        others = link_counts(grouped.select("grp", "cls", "rows", "n_shingles"), slim, sig)
        named = named.join(others.withColumnRenamed("cls", "_cls"), F.col("cls") == F.col("_cls"), "left").withColumn("n_links", F.col("rows") - 1 + F.coalesce("links", F.lit(0)))
        wanted.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        tables.append(others)
    rows = sig.select("row", "doc_id", "text_hash", "n_shingles", "d1", "d2").join(named.drop("cls", "low_id", "rows", "links", "_cls"), ["d1", "d2", "n_shingles"], "left")
    out = materialize(rows.select(*wanted))
    release(*tables)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, n_links, component_id`` for every row of ``docs`` (``doc_id``, ``text``);
    ``n_links`` counts the other rows whose text links with the row's."""
    return _one_component_per_id(row_groups(docs, count_links=True).select("doc_id", "n_shingles", "n_links", "component_id"))


def _one_component_per_id(named: DataFrame) -> DataFrame:
    """Components that hold rows of one doc_id become one."""
    apart = materialize(named.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("low < high"))
    if apart.isEmpty():
        return named
    edges = named.join(apart, "doc_id").select(F.col("component_id").alias("a"), F.col("low").alias("b")).distinct()
    joined = components(edges)
    out = named.join(joined, F.col("component_id") == joined["id"], "left").withColumn("component_id", F.coalesce("component", "component_id"))
    return out.drop("id", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked rows (its smallest doc_id, null last), all columns kept. Rows are told apart
    by doc_id and text: rows without an id, and rows of one id whose texts do not link, are judged like all
    others. Texts without words link with nothing and stay. Columns may have any names; an empty table stays empty."""
    named = row_groups(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")
    worded = named.where("n_shingles > 0")
    gone = worded.join(worded.groupBy("grp").agg(first), "grp").where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))))
    gone = materialize(gone.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash")).distinct())
    repeated = materialize(worded.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash")))
    release(named)
    # the columns of a row stay together in one struct, so their names clash with nothing
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("other_id")) & (F.col("hash") == F.col("other_hash"))
    out = rows.join(small(gone), same, "left_anti")
    if not repeated.isEmpty():
        # equal rows: the one with the least digest of all columns stays, so reruns agree
        repeated = small(repeated)
        once = out.join(repeated, same, "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.join(repeated, same, "left_anti").select("row").union(once.select("row"))
    return out.select("row.*")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
