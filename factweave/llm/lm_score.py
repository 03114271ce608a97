"""Language-model scores of whole documents: a gated recurrent network with a class-factored softmax.

Documents whose ``crc32(doc_id) mod 5`` is not 1 are training text. ``census`` counts every training word
in the corpus. The ``HEAD`` most frequent words are dealt to classes of ``CLASS_WORDS`` words, by topic of their ending
(k-means over a projected co-occurrence matrix summed over all training texts), then by rank; all other words go to
classes by topic and frequency. A gated recurrent unit predicts the class of the next word and, with a softmax of its
own per class, the word inside a head class:

    log P(word | history) = log P(class | history) + log P(word | class, history).

Inside the classes of rarer words, words keep their smoothed unigram shares, and each class of the rarest
holds one unknown word, so probabilities sum to one over the counted words and an unknown word of each topic.

Training is truncated backpropagation in numpy: training documents are dealt to groups by a hash of doc_id and text, each
group is sorted and runs windows of ``STEPS`` tokens over its documents, each document whole in one lane (but for the
few that are longer than a lane's share of all tokens) with the state carried across windows, and the groups' weights are averaged; each training document is seen once, in two
rounds. The number of groups follows the number of training tokens, and neither the partitions nor the order of the
input count, so scores agree, to single precision, however the table is stored. Scoring carries the state from a document's first word
to its end.

Only the ``TOP_WORDS`` most frequent words, a fixed number, travel with the tasks; every other word
meets its count in a join. Weights are averaged in sets of groups before they reach the driver.
Defined cases: null text is one end token; a null doc_id is treated as empty text for the split; rows that
repeat are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import materialize, release, table
from factweave.llm.wordkernel import LOWER, Words, lean, mix, mix_int, one_thread, word_chunks

TOP_WORDS = 131_072
HEAD, CLASS_WORDS, KNOWN_INPUTS, FREQUENT = 1024, 64, 512, 16_384
HEAD_CLASSES = HEAD // CLASS_WORDS
ENDINGS, PROJECTED, TOPICS = 1024, 16, 8
HIDDEN, LANES, STEPS, RATE = 16, 128, 32, 0.09
CHUNK_BYTES, SCORE_LANES, SCORE_BLOCK, SCORE_ROWS = 12 << 20, 256, 32, 10_000
#: Bytes of text that are laid out for training at a time, and training tokens of a group.
TRAIN_BYTES = 4 << 20
GROUP_TOKENS = 3_000_000
GROUPS = 32
END = mix_int(0xE0D0F7E87)
_TRIM = np.zeros(256, dtype=bool)
_TRIM[list(b".,!?;:\"')")] = True


def endings(w: Words) -> np.ndarray:
    """A bucket of each word by its last three bytes, one closing mark left out."""
    last = w.ends - 1
    last = last - (_TRIM[w.buf[last]] & (last > w.starts))
    key = np.zeros(len(last), dtype=np.uint64)
    for k in range(3):
        at = last - k
        key = key * np.uint64(256) + np.where(at >= w.starts, LOWER[w.buf[np.maximum(at, 0)]], 0).astype(np.uint64)
    return (mix(key) % np.uint64(ENDINGS)).astype(np.int64)


def _projection() -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1, 1], dtype=np.float32), (ENDINGS, PROJECTED))


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h", "ending", "c", "stat"]
    stat, random = np.zeros((ENDINGS, PROJECTED)), _projection()
    for batch in batches:
        hashes, counts, ends = [np.array([END], np.uint64)], [np.array([batch.num_rows])], [np.zeros(1, np.int64)]
        for w in word_chunks(batch.column(0), lower=True):
            e = endings(w)
            u, first, c = np.unique(w.hashes, return_index=True, return_counts=True)
            hashes.append(u)
            counts.append(c)
            ends.append(e[first])
            seen = np.bincount(w.row_of_word() * ENDINGS + e, minlength=w.rows * ENDINGS).reshape(w.rows, ENDINGS).astype(np.float32)
            seen /= np.maximum(w.counts, 1)[:, None]
            stat += seen.T @ (seen @ random)
        u, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        c = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.concatenate(ends)[first]), pa.array(c), pa.nulls(len(u), pa.binary())], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([-1]), pa.array([0]), pa.array([stat.astype("<f8").tobytes()], pa.binary())], names=names)


def _sum_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ENDINGS * PROJECTED)
    for batch in batches:
        for blob in batch.column(0):
            total += np.frombuffer(blob.as_py(), dtype="<f8")
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["stat"])


def topics(stat: np.ndarray) -> np.ndarray:
    """Topic of each ending by k-means over normalised co-occurrence rows; fixed seeds."""
    rows = stat / np.maximum(np.abs(stat).sum(axis=1, keepdims=True), 1e-12)
    rows = rows - rows.mean(axis=0)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    centres = [rows[int(np.abs(stat).sum(axis=1).argmax())]]
    while len(centres) < TOPICS:  # furthest first
        centres.append(rows[int(np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax())])
    mid = np.stack(centres)
    for _ in range(25):
        near = (rows @ mid.T).argmax(axis=1)
        mid = np.stack([rows[near == k].mean(axis=0) if (near == k).any() else mid[k] for k in range(TOPICS)])
        mid /= np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-12)
    return (rows @ mid.T).argmax(axis=1)


@dataclass
class Vocabulary:
    """What tasks need of the corpus counts; its size does not grow with the corpus."""

    hashes: np.ndarray  # sorted
    ranks: np.ndarray
    counts: np.ndarray
    topic_of_ending: np.ndarray
    class_log: np.ndarray  # natural log of each class's unigram mass
    slots: np.ndarray  # of each head word by rank, class by class
    word_log: np.ndarray  # natural log of each slot's share of its class; very low where the slot is empty
    tokens: int
    distinct: int

    @property
    def classes(self) -> int:
        return len(self.class_log)

    @property
    def norm(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each word (``TOP_WORDS`` if outside) and its index in ``counts`` (-1 if outside)."""
        if not len(self.hashes):
            return np.full(len(h), TOP_WORDS), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.ranks[at], TOP_WORDS), np.where(hit, at, -1)

    def class_of(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        rare = HEAD_CLASSES + self.topic_of_ending[ending] + np.where(rank < FREQUENT, 0, TOPICS)
        return np.where(rank < HEAD, self.slots[np.minimum(rank, HEAD - 1)] // CLASS_WORDS, rare)

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input ids, class ids, slots (-1 outside the head), indexes in ``counts`` and rows of all tokens, each row
        closed by an end."""
        rank, at = self.look_up(np.insert(w.hashes, w.bounds[1:], np.uint64(END)))
        cls = self.class_of(rank, np.insert(endings(w), w.bounds[1:], 0))
        slot = np.where(rank < HEAD, self.slots[np.minimum(rank, HEAD - 1)], -1)
        ids = np.where(rank < KNOWN_INPUTS, rank, KNOWN_INPUTS + cls)
        row = np.repeat(np.arange(w.rows), w.counts + 1)
        ids[np.flatnonzero(np.r_[row[1:] != row[:-1], True])] = KNOWN_INPUTS + self.classes
        return ids, cls, slot, at, row


def vocabulary(train: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training texts and the table ``h, c`` of all counts."""
    seen = materialize(train.select("text").mapInArrow(lean(_census, SCORE_ROWS), "h long, ending long, c long, stat binary"))
    counts = materialize(seen.where("stat is null").groupBy("h").agg(F.sum("c").alias("c"), F.min("ending").alias("ending")).where("c > 0"))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(TOP_WORDS).toArrow()
    h, c, e = (top[k].to_numpy().astype(np.int64) for k in ("h", "c", "ending"))
    blobs = seen.where("stat is not null").select("stat").repartition(GROUPS).mapInArrow(lean(_sum_stats), "stat binary").collect()
    stat = sum((np.frombuffer(b[0], dtype="<f8") for b in blobs), np.zeros(ENDINGS * PROJECTED)).reshape(ENDINGS, PROJECTED)
    order = np.argsort(h.view(np.uint64), kind="stable")
    v = Vocabulary(h.view(np.uint64)[order], order, c[order], topics(stat), np.zeros(HEAD_CLASSES + 2 * TOPICS), np.zeros(HEAD, np.int64), np.full(HEAD, -60.0), int(tokens), int(distinct))
    head = np.lexsort((np.arange(min(HEAD, len(h))), v.topic_of_ending[e[:HEAD]]))
    v.slots[head] = np.arange(len(head))
    mass = np.full(v.classes, 1e-9)
    cls = v.class_of(np.arange(len(h)), e)
    mass += np.bincount(cls, c + 0.5, minlength=v.classes)
    v.word_log[v.slots[head]] = np.log((c[head] + 0.5) / mass[cls[head]])
    by_ending = counts.groupBy("ending").agg(F.sum("c"), F.count("*")).collect()
    tail = np.zeros(ENDINGS)
    for ending, n, kinds in by_ending:
        tail[ending] += n + 0.5 * kinds
    tail -= np.bincount(e, c + 0.5, minlength=ENDINGS)
    mass += np.bincount(HEAD_CLASSES + TOPICS + v.topic_of_ending, np.maximum(tail, 0), minlength=v.classes)
    mass[HEAD_CLASSES + TOPICS :] += 0.5  # an unknown word of each topic
    v.class_log = np.log(mass / v.norm)
    return v, counts.select("h", "c")


class Network:
    """Weights: input table (ids x 3H), recurrent matrix (H x 3H), class matrix (H x C) and bias, and the words of each
    head class (classes x words x H) and their biases."""

    def __init__(self, classes: int, flat: np.ndarray | None = None, bias: np.ndarray | None = None, word_bias: np.ndarray | None = None):
        inputs = KNOWN_INPUTS + classes + 2  # and end, start
        self.start = inputs - 1
        self.shapes = [(inputs, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, classes), (classes,), (HEAD_CLASSES, CLASS_WORDS, HIDDEN), (HEAD_CLASSES, CLASS_WORDS)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            rng = np.random.default_rng(5)
            flat = np.concatenate([rng.normal(0, s, n) for s, n in zip((0.1, 0.15, 0.05, 0.0, 0.05, 0.0), sizes)]).astype(np.float32)
            self._split(flat)
            self.bias[:] = bias
            self.word_bias[:] = word_bias.reshape(self.word_bias.shape)
        else:
            self._split(flat)

    def _split(self, flat: np.ndarray) -> None:
        self.flat = flat
        sizes = [int(np.prod(s)) for s in self.shapes]
        self.table, self.rec, self.out, self.bias, self.words, self.word_bias = (p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), self.shapes))

    def step(self, x: np.ndarray, h: np.ndarray):
        """One step from input rows ``x`` (B x 3H) and state ``h``; returns the new state and what backward needs."""
        a = h @ self.rec
        gates = np.tanh(0.5 * (x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])) * np.float32(0.5) + np.float32(0.5)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        return n + z * (h - n), (z, r, n, a[:, 2 * HIDDEN :], h)

    def log_softmax(self, h: np.ndarray) -> np.ndarray:
        logits = h @ self.out + self.bias
        return logits - np.log(_exps(logits)[1])[:, None]

    def by_class(self, h: np.ndarray, slots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per head class its tokens: ``(class, their rows of h, their words in the class, logits of all its words)``."""
        rows = np.flatnonzero(slots >= 0)
        rows = rows[np.argsort(slots[rows] // CLASS_WORDS, kind="stable")]
        cls = slots[rows] // CLASS_WORDS
        cuts = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1))
        for c in range(HEAD_CLASSES):
            if cuts[c] < cuts[c + 1]:
                own = rows[cuts[c] : cuts[c + 1]]
                yield c, own, slots[own] % CLASS_WORDS, h[own] @ self.words[c].T + self.word_bias[c]

    def log_words(self, h: np.ndarray, cls: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """``ln P(class | h)``, plus ``ln P(word | class, h)`` for head words."""
        logits = h @ self.out + self.bias
        out = (logits[np.arange(len(h)), cls] - np.log(_exps(logits)[1])).astype(np.float64)
        for _, own, word, logits in self.by_class(h, slots):
            out[own] += logits[np.arange(len(own)), word] - np.log(_exps(logits)[1])
        return out

    def train_window(self, ids: np.ndarray, targets: np.ndarray, slots: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray, memory: np.ndarray) -> np.ndarray:
        """One Adagrad update on a window (steps x lanes); returns the state at its end."""
        steps, lanes = ids.shape
        states, tape = np.empty((steps, lanes, HIDDEN), self.flat.dtype), []
        for t in range(steps):
            h = h * ~fresh[t][:, None]
            h, saved = self.step(self.table[ids[t]], h)
            states[t] = h
            tape.append(saved)
        flat_h = states.reshape(-1, HIDDEN)
        share = self.flat.dtype.type(1 / max(1, real.sum()))
        weight = real.ravel() * share
        d, total = _exps(flat_h @ self.out + self.bias)
        d *= (weight / total)[:, None]
        d[np.arange(len(d)), targets.ravel()] -= weight
        grad = np.zeros_like(self.flat)
        g = Network.__new__(Network)
        g.shapes = self.shapes
        g._split(grad)
        g.out += flat_h.T @ d
        g.bias += d.sum(axis=0)
        into = d @ self.out.T
        for c, own, word, logits in self.by_class(flat_h, np.where(real.ravel() > 0, slots.ravel(), -1)):
            dw, total = _exps(logits)
            dw *= (share / total)[:, None]
            dw[np.arange(len(own)), word] -= share
            g.words[c] += dw.T @ flat_h[own]
            g.word_bias[c] += dw.sum(axis=0)
            into[own] += dw @ self.words[c]
        into = into.reshape(steps, lanes, HIDDEN)
        dx = np.empty((steps, lanes, 3 * HIDDEN), self.flat.dtype)
        da = np.empty_like(dx)  # dx with the candidate's part as the recurrent matrix sees it
        befores = np.empty_like(states)
        back, turned = np.zeros((lanes, HIDDEN), self.flat.dtype), np.ascontiguousarray(self.rec.T)
        for t in reversed(range(steps)):
            z, r, n, an, before = tape[t]
            dh = back + into[t]
            dn = dh * (1 - z)
            dn *= 1 - n * n
            one, two = dx[t], da[t]
            one[:, :HIDDEN] = dh * (before - n) * z * (1 - z)
            one[:, HIDDEN : 2 * HIDDEN] = dn * an * r * (1 - r)
            one[:, 2 * HIDDEN :] = dn
            two[:] = one
            two[:, 2 * HIDDEN :] *= r
            befores[t] = before
            back = (dh * z + two @ turned) * ~fresh[t][:, None]
        g.rec += befores.reshape(-1, HIDDEN).T @ da.reshape(-1, 3 * HIDDEN)
        flat_ids = ids.ravel()
        order = np.argsort(flat_ids, kind="stable")
        sorted_ids = flat_ids[order]
        heads = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        g.table[sorted_ids[heads]] += np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], heads, axis=0)
        memory += grad * grad
        grad /= np.sqrt(memory) + self.flat.dtype.type(1e-6)
        grad *= self.flat.dtype.type(RATE)
        self.flat -= grad
        return h


def _exps(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums per row. Hidden units lie in (-1, 1) and biases below 0, so logits stay far from the
    range of a float; the bound is only a guard."""
    e = np.exp(np.minimum(logits, 60))
    return e, e @ np.ones(e.shape[1], e.dtype)


def packed(fresh: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """``(token of each step and lane, lanes still running at each step)``: rows lie whole in lanes, longest first, each
    in the lane with the least load, and lanes are in order of falling load."""
    heads = np.flatnonzero(fresh)
    lengths = np.diff(np.r_[heads, len(fresh)])
    load = [(0, k) for k in range(min(lanes, len(heads)))]
    rows: list[list[int]] = [[] for _ in load]
    for i in np.argsort(-lengths, kind="stable"):
        total, k = heapq.heappop(load)
        rows[k].append(int(i))
        heapq.heappush(load, (total + int(lengths[i]), k))
    loads = np.array([sum(int(lengths[i]) for i in p) for p in rows])
    place = np.full((int(loads.max()), len(rows)), -1, dtype=np.int64)
    for lane, k in enumerate(np.argsort(-loads, kind="stable")):
        place[: loads[k], lane] = np.concatenate([np.arange(heads[i], heads[i] + lengths[i]) for i in rows[k]])
    return place, (place >= 0).sum(axis=1)


def _inputs(ids: np.ndarray, row: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's input is the token before it; ``start`` and a fresh state open a row."""
    fresh = np.r_[True, row[1:] != row[:-1]]
    before = np.r_[start, ids[:-1]]
    before[fresh] = start
    return before, fresh


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """``(group, texts)`` of consecutive rows ``text, g``: as many of one group as fill ``TRAIN_BYTES``, wherever batches end."""
    held: list[pa.Array] = []
    group, size = None, 0
    for batch in batches:
        texts, groups = batch.column(0).cast(pa.large_string()).fill_null(""), batch.column(1).to_numpy()
        ends = np.cumsum(np.asarray(pc.binary_length(texts)))
        row = 0
        while row < batch.num_rows:
            if groups[row] != group:
                if held:
                    yield group, pa.concat_arrays(held)
                held, group, size = [], groups[row], 0
            before = ends[row - 1] if row else 0
            same = int(np.searchsorted(groups, group, side="right"))  # groups are sorted
            end = min(int(np.searchsorted(ends, before + TRAIN_BYTES - size)) + 1, same)
            held.append(texts.slice(row, end - row))
            size += int(ends[end - 1] - before)
            row = end
            if size >= TRAIN_BYTES:
                yield group, pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield group, pa.concat_arrays(held)


def _train(v: Vocabulary, flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        group, net, memory, seen = None, None, None, 0
        for g, texts in _pieces(batches):
            if g != group:
                if seen:
                    yield _weights(group, seen, net)
                group, net, seen = g, Network(v.classes, flat.copy()), 0
                memory = np.full_like(net.flat, 1e-6)
            for w in word_chunks(texts, lower=True, chunk_bytes=1 << 62):
                ids, cls, slot, _, row = v.encode(w)
                before, fresh = _inputs(ids, row, net.start)
                # a document longer than a lane's fair load goes on in another lane, from a fresh state there
                heads = np.flatnonzero(fresh)
                inside = np.arange(len(ids)) - np.repeat(heads, np.diff(np.r_[heads, len(ids)]))
                fresh |= inside % max(STEPS, -(-len(ids) // LANES)) == 0
                place, live = packed(fresh, LANES)
                h = np.zeros((place.shape[1], HIDDEN), np.float32)
                for t in range(0, len(place), STEPS):
                    at = place[t : t + STEPS, : live[t]]
                    real = at >= 0
                    h = net.train_window(np.where(real, before[at], net.start), np.where(real, cls[at], 0), np.where(real, slot[at], -1), fresh[at] | ~real, real.astype(np.float32), h[: live[t]], memory)
                seen += len(ids)
        if seen:
            yield _weights(group, seen, net)

    return run


def _weights(group: int, seen: int, net: Network) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(group)]), pa.array([seen]), pa.array([net.flat.astype("<f4").tobytes()], pa.binary())], names=["grp", "n", "weights"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of weights per set ``s``, rows sorted by it."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for s, k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            part = np.frombuffer(blob.as_py(), dtype="<f4").astype(np.float64) * k
            n, total = sums.get(s, (0, np.zeros(len(part))))
            sums[s] = (n + k, total + part)
    for s, (n, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["s", "n", "weights"])


def train_network(train: DataFrame, v: Vocabulary) -> np.ndarray:
    """Weights after two rounds of local training and averaging; round one takes an eighth of the documents."""
    flat = Network(v.classes, bias=v.class_log, word_bias=v.word_log).flat
    groups = max(1, round(v.tokens / GROUP_TOKENS))
    key = F.xxhash64(F.lit(3), "doc_id", "text")
    turn = F.pmod(F.xxhash64(F.lit(4), key), F.lit(8)) == 0
    for part in (turn, ~turn):
        own = train.where(part).select("text", F.pmod(key, F.lit(groups)).cast("int").alias("g"), key.alias("k"), "doc_id")
        dealt = own.repartitionById(groups, "g").sortWithinPartitions("g", "k", "doc_id").select("text", "g")
        local = materialize(dealt.mapInArrow(lean(_train(v, flat)), "grp long, n long, weights binary"))
        sets = local.select("n", "weights", "grp", F.pmod("grp", F.lit(GROUPS)).cast("int").alias("s")).repartitionById(min(GROUPS, groups), "s").sortWithinPartitions("s", "grp")
        rows = sorted(sets.select("s", "n", "weights").mapInArrow(lean(_average), "s long, n long, weights binary").collect())
        release(local)
        if rows:
            total = sum(n for _, n, _ in rows)
            flat = sum(np.frombuffer(b, dtype="<f4").astype(np.float64) * (n / total) for _, n, b in rows).astype(np.float32)
    return flat


def score_rows(net: Network, v: Vocabulary, ids: np.ndarray, cls: np.ndarray, slot: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the sum over tokens of ``ln P(class, word | history) - ln P(class, word)``, the word only in head
    classes. Rows are packed into lanes, longest first; a row's state runs from its first token to its end."""
    before, fresh = _inputs(ids, row, net.start)
    place, live = packed(fresh, SCORE_LANES)
    gain = -v.class_log[cls] - np.where(slot >= 0, v.word_log[slot], 0)
    h = np.zeros((place.shape[1], HIDDEN), np.float32)
    for t in range(0, len(place), SCORE_BLOCK):
        states, tokens = [], []
        for s in range(t, min(t + SCORE_BLOCK, len(place))):
            at = place[s, : live[s]]
            h = h[: live[s]]
            h[fresh[at]] = 0
            h, _ = net.step(net.table[before[at]], h)
            states.append(h)
            tokens.append(at)
        at = np.concatenate(tokens)
        gain[at] += net.log_words(np.concatenate(states), cls[at], slot[at])
    return np.bincount(row, gain, minlength=rows)


SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, gain double, tail array<long>"


def _score(v: Vocabulary, flat: np.ndarray):
    logs = np.log10((v.counts + 0.5) / v.norm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        net = Network(v.classes, flat.copy())
        for batch in batches:
            for w in word_chunks(batch.column(2), lower=True, chunk_bytes=CHUNK_BYTES):
                ids, cls, slot, at, row = v.encode(w)
                known = at >= 0
                base = np.bincount(row[known], logs[at[known]], minlength=w.rows)
                gain = score_rows(net, v, ids, cls, slot, row, w.rows) / np.log(10)
                out_of = np.flatnonzero(~known)
                # words outside the list; an end token counts among them only if nothing was trained
                words = np.insert(w.hashes, w.bounds[1:], np.uint64(END))[out_of]
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[out_of], np.arange(w.rows + 1)).astype(np.int32)), pa.array(words.view(np.int64)))
                cols = [w.counts + 1, np.bincount(row[known], minlength=w.rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.rows), batch.column(1).slice(w.first, w.rows), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(base.astype(np.float64)), pa.array(gain), tail],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "gain", "tail"],
                )

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``."""
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 1
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    train = slim.where("not held_out").select("doc_id", "text")
    v, counts = vocabulary(train)
    flat = train_network(train, v)
    scored = materialize(slim.mapInArrow(lean(_score(v, flat), SCORE_ROWS), SCORED).withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode("tail").alias("h")).join(counts, "h", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / v.norm)).alias("more"), F.count("c").alias("found"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    known = F.col("known") + F.coalesce("found", F.lit(0).cast("long"))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score")
    )


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
