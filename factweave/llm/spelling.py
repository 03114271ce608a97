"""Spelling variants by a frequency-vector trie.

A word is a vector of sixteen letter-group counts (of at most 15 each, so it is one 64-bit number and its leading
groups are a prefix of it). Arranged by successive counts, the words form a trie. One edit adds a letter to one group,
takes a letter from one, or does both, so a word's near words lie where a search that spends a budget of one surplus
and one deficit arrives; the words at a leaf are verified letter by letter.

The trie is dealt to tasks by its upper levels. Each word takes a seat in its own node and in every later node its budget
reaches, so each pair meets once, in the node of its later word. A node of more than ``SEATS`` seats is split
by further levels until none is left, and words that share all sixteen counts in such numbers are paired by an equi-join on
their one-letter deletions instead. Inside a node the search is depth first over blocks of at most ``BLOCK`` steps.

Counts are summed in tasks before they are shuffled, near words are reduced to a count and the best one in tasks and
again by word; chains of forms are followed by pointer doubling.

Defined cases: a null text has no runs; a null doc_id is written as nothing before the colon; repeated rows count
again; a run longer than any word is one word; ties of n go to the smaller word in code-point order; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import crc32_sql, materialize, release, small, table
from factweave.llm.wordkernel import lean

MIN_CHARS, MIN_COUNT, TYPO, FACTOR = 6, 5, 199, 5
GROUPS = 16
SEATS = 200_000
BLOCK = 1 << 18
_FLUSH = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Letters a-z and U+00C0 to U+00FF as UTF-8, once A-Z are lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Level of each group; a letter's group is its code point modulo 16. Common letters come first.
_LEVEL = np.argsort(np.array([5, 4, 1, 15, 9, 14, 3, 8, 2, 12, 13, 7, 6, 0, 11, 10]))
_STEPS = np.array([-1, 0, 1])
SEAT = "word string, n long, vec long, node long"
NEAR = "word string, n_near long, best_n long, best string"


def _without(run: bytes, h: int) -> bytes:
    s = run.decode()
    k = h % len(s)
    return (s[:k] + s[k + 1 :]).encode()


def _count(min_chars: int, typo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(_RUN.findall((text.as_py() or b"").translate(_LOWER))).items():
                    if len(word) < min_chars:
                        continue
                    h = zlib.crc32(word, start)
                    total[word if h % typo else _without(word, h)] += n
                if len(total) > _FLUSH:
                    yield _counts(total)
                    total.clear()
        if total:
            yield _counts(total)

    return run


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """``word, n`` of the words of ``docs`` (``doc_id``, ``text``), after the seeded deletions."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    said = rows.mapInArrow(lean(_count(min_chars, typo)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return said.where((F.char_length("word") >= min_chars) & (F.col("n") >= min_count))


def vectors(words: list[str]) -> np.ndarray:
    """Sixteen counts of four bits a word, first level highest."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * GROUPS + _LEVEL[letters % GROUPS], minlength=GROUPS * len(words)).reshape(-1, GROUPS)
    return (np.minimum(counts, 15).astype(np.uint64) << np.arange(60, -1, -4).astype(np.uint64)).sum(1, dtype=np.uint64)


def _nibble(vec: np.ndarray, level: int) -> np.ndarray:
    return ((vec >> np.uint64(60 - 4 * level)) & np.uint64(15)).astype(np.int64)


def _prefix(vec: np.ndarray, level: int) -> np.ndarray:
    """The first ``level`` counts, the rest zero."""
    return vec & np.uint64((1 << 64) - (1 << (64 - 4 * level))) if level else vec & np.uint64(0)


def _spent(vec: np.ndarray, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Surplus and deficit of ``node`` against the first ``level`` counts of ``vec``."""
    over, under = np.zeros(len(vec), np.int64), np.zeros(len(vec), np.int64)
    for k in range(level):
        d = _nibble(node, k) - _nibble(vec, k)
        over += np.maximum(d, 0)
        under += np.maximum(-d, 0)
    return over, under


def _descend(vec: np.ndarray, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes one level below ``node`` that the budget reaches, never before the word's own: index into ``vec``, node."""
    over, under = _spent(vec, node, level)
    own, q = _prefix(vec, level) == node, _nibble(vec, level)
    ats, nodes = [], []
    for step, ok in ((0, np.ones(len(vec), bool)), (1, (over == 0) & (q < 15)), (-1, (under == 0) & (q > 0) & ~own)):
        at = np.flatnonzero(ok)
        ats.append(at)
        nodes.append(node[at] | ((q[at] + step).astype(np.uint64) << np.uint64(60 - 4 * level)))
    return np.concatenate(ats), np.concatenate(nodes)


def _seat(start: int, depth: int):
    """Moves seats from nodes of level ``start`` to nodes of level ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            vec = batch["vec"].to_numpy().view(np.uint64) if start else vectors(batch["word"].to_pylist())
            node = batch["node"].to_numpy().view(np.uint64) if start else np.zeros(len(vec), np.uint64)
            at = np.arange(len(vec))
            for level in range(start, depth):
                k, node = _descend(vec[at], node, level)
                at = at[k]
            out = batch.select(["word", "n"]).take(pa.array(at))
            yield from pa.table([*out.columns, pa.array(vec[at].view(np.int64)), pa.array(node.view(np.int64))], names=["word", "n", "vec", "node"]).to_batches(max_chunksize=65536)

    return run


class Trie:
    """Words in the order of their vectors, with the nodes of each level from ``depth`` on."""

    def __init__(self, vec: np.ndarray, depth: int):
        self.depth, self.first, self.count, self.child = depth, {}, {}, {}
        for level in range(depth, GROUPS + 1):
            p = _prefix(vec, level)
            self.first[level] = np.r_[np.flatnonzero(np.r_[len(p) > 0, p[1:] != p[:-1]]), len(vec)]
            if level > depth:
                self.count[level] = _nibble(vec[self.first[level][:-1]], level - 1)
                self.child[level - 1] = np.searchsorted(self.first[level], self.first[level - 1])

    def search(self, vec: np.ndarray, over: np.ndarray, under: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, word)`` of every word within the budget left; where ``own``, of words not before the query's own leaf."""
        start = np.arange(len(vec))
        stack = [(self.depth, start, np.zeros(len(vec), np.int64), over, under, own)] if len(self.first[self.depth]) > 1 else []  # nobody at home
        while stack:
            level, q, node, over, under, own = stack.pop()
            spans = self.first[level] if level == GROUPS else self.child[level]
            low, n = spans[node], spans[node + 1] - spans[node]
            if n.sum() > BLOCK and len(q) > 1:
                half = len(q) // 2
                stack += [(level, *(x[part] for x in (q, node, over, under, own))) for part in (slice(half, None), slice(half))]
                continue
            at = np.repeat(np.arange(len(q)), n)
            to = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]
            if level == GROUPS:
                yield q[at], to
                continue
            d = self.count[level + 1][to] - _nibble(vec[q[at]], level)
            over, under, own = over[at] + np.maximum(d, 0), under[at] + np.maximum(-d, 0), own[at]
            k = np.flatnonzero((over <= 1) & (under <= 1) & ((d >= 0) | ~own))
            if len(k):
                stack.append((level + 1, q[at[k]], to[k], over[k], under[k], own[k] & (d[k] == 0)))


class Letters:
    """Verifies pairs of words: exactly one letter inserted, deleted or replaced."""

    def __init__(self, words: list[str], min_chars: int):
        self.words, self.size = words, np.array([len(w) for w in words])
        self.width = -(-max(min(int(self.size.max(initial=1)), 64), min_chars, 4) // 8) * 8
        raw = [w.encode("latin-1") for w in words]
        fits = [w if len(w) <= self.width else b"" for w in raw]
        self.left = np.frombuffer(b"".join(w.ljust(self.width, b"\0") for w in fits), np.uint8).reshape(-1, self.width)
        self.right = np.frombuffer(b"".join(w.rjust(self.width, b"\0") for w in fits), np.uint8).reshape(-1, self.width)
        h = min(min_chars // 2, 4)  # one edit leaves the first or the last letters alone
        self.head = np.frombuffer(b"".join(w[:h].ljust(4, b"\0") for w in raw), np.uint32)
        self.tail = np.frombuffer(b"".join(w[len(w) - h :].ljust(4, b"\0") for w in raw), np.uint32)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Indices of the pairs that hold."""
        k = np.flatnonzero(((self.head[i] == self.head[j]) | (self.tail[i] == self.tail[j])) & (np.abs(self.size[i] - self.size[j]) <= 1))
        i, j = i[k], j[k]
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        differ = self.left[i] != self.left[j]
        same = self.size[i] == self.size[j]
        before = np.argmax(differ, axis=1)
        after = np.argmax((self.right[i] != self.right[j])[:, ::-1], axis=1)
        ok = np.where(same, differ.sum(axis=1) == 1, before + after >= self.size[i])
        for x in np.flatnonzero(np.maximum(self.size[i], self.size[j]) > self.width):
            ok[x] = _one_edit(self.words[i[x]], self.words[j[x]])
        return k[ok]


def _one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def _best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """Per word of the pairs: how many near words, and the one of largest n (ties: the smallest)."""
    who, other = np.r_[i, j], np.r_[j, i]
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], who))
    ids, first, counts = np.unique(who[order], return_index=True, return_counts=True)
    best = other[order][first]
    pick = pa.array(words, pa.string()).take
    return pa.table([pick(pa.array(ids)), pa.array(counts.astype(np.int64)), pa.array(n[best]), pick(pa.array(best))], names=["word", "n_near", "best_n", "best"])


def _near_in_node(depth: int, min_chars: int):
    def run(seats: pa.Table) -> pa.Table:
        vec, node = seats["vec"].to_numpy().view(np.uint64), seats["node"].to_numpy().view(np.uint64)
        words, n = seats["word"].to_pylist(), seats["n"].to_numpy()
        home = _prefix(vec, depth) == node
        residents = np.flatnonzero(home)
        residents = residents[np.argsort(vec[residents], kind="stable")]
        trie, letters = Trie(vec[residents], depth), Letters(words, min_chars)
        place = np.full(len(vec), -1)
        place[residents] = np.arange(len(residents))
        pairs = [np.empty((2, 0), np.int64)]
        for q, to in trie.search(vec, *_spent(vec, node, depth), home):
            k = np.flatnonzero(place[q] < to)  # two residents of one leaf meet once
            q, to = q[k], residents[to[k]]
            pairs.append(np.stack([q, to])[:, letters.near(q, to)])
        return _best(words, n, *np.concatenate(pairs, axis=1))

    return run


def _near_by_deletion(seats: DataFrame) -> DataFrame:
    """Near words inside leaves of too many seats, by an equi-join: two words are near if one is a deletion of the other, or
    if both give the same deletion at the same place. A key meets at most as many words as there are letters, and their deletions."""
    home = F.col("vec") == F.col("node")
    cut = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda k: F.struct(k.alias("at"), F.concat(F.substring(F.col("word"), F.lit(1), k - 1), F.substring(F.col("word"), k + 1, F.char_length("word"))).alias("rest")))
    base = seats.select("node", "word", "n", home.alias("home"))
    cuts = seats.select("node", "word", "n", home.alias("home"), F.explode(cut).alias("c")).select("node", "word", "n", "home", "c.at", "c.rest")
    a, b = cuts.alias("a"), cuts.alias("b")
    pair = [F.least("a.word", "b.word").alias("x"), F.greatest("a.word", "b.word").alias("y")]
    ns = lambda l, r: [F.when(F.col(f"{l}.word") < F.col(f"{r}.word"), F.col(f"{p}.n")).otherwise(F.col(f"{q}.n")).alias(o) for p, q, o in ((l, r, "nx"), (r, l, "ny"))]  # noqa: E731, E741
    swapped = a.join(b, ["node", "at", "rest"]).where("a.word < b.word and (a.home or b.home)").select(*pair, *ns("a", "b"))
    b = base.alias("b")
    longer = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.rest") == F.col("b.word"))).where("a.home or b.home").select(*pair, *ns("a", "b"))
    both = swapped.union(longer).distinct()
    each = both.select(F.explode(F.array(*(F.struct(F.col(p).alias("word"), F.col(m).alias("best_n"), F.col(q).alias("best")) for p, q, m in (("x", "y", "ny"), ("y", "x", "nx"))))).alias("e"))
    return each.select("e.word", F.lit(1).cast("long").alias("n_near"), "e.best_n", "e.best")


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, seats: int = SEATS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word of ``words`` (``word``, ``n``; written) that has a near one."""
    vocabulary = words.count()
    start, depth, parts = 0, 4, []
    while depth < GROUPS and seats * 3 ** (depth - 4) < vocabulary * 20:  # an even trie has about three children a node
        depth += 1
    left = words
    while True:
        sat = materialize(left.mapInArrow(lean(_seat(start, depth)), SEAT))
        crowded = materialize(sat.groupBy("node").count().where(F.col("count") > seats).select("node"))
        more = not crowded.isEmpty()
        fine = sat.join(small(crowded), "node", "left_anti") if more else sat
        parts.append(fine.groupBy("node").applyInArrow(_near_in_node(depth, min_chars), NEAR))
        if not more:
            break
        left = sat.join(small(crowded), "node", "left_semi").select(*(c.split()[0] for c in SEAT.split(", ")))
        if depth == GROUPS:
            parts.append(_near_by_deletion(left))
            break
        start, depth = depth, min(depth + 2, GROUPS)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` by pointer doubling; a form has at least twice the count of its word, so chains are short and end."""
    cur = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = materialize(cur.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(cur)
        cur = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return cur


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR, seats: int = SEATS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``. ``factor`` (2 or more) is how many times a word's count its form has at least."""
    words = materialize(word_counts(docs, min_chars, min_count))
    near = near_words(words, min_chars, seats)
    holds = F.col("best_n") >= factor * F.col("n")
    formed = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best")).alias("form"), F.when(holds, F.col("best_n")).alias("form_n")))
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
held AS (SELECT doc_id, r, count(*) AS c, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM run GROUP BY doc_id, r),
said AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, c FROM held),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS i, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.i = 1),
chain AS (
  SELECT word, word AS root, form AS further FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.further)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.further IS NULL
"""
