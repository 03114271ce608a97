"""Posting lists: the full index from an identity to its occurrences, in bounded blocks.

Facts are dealt to sampled ranges of identity, artifact and order, so a fact that every artifact holds is spread over
as many tasks as it needs. A task walks its sorted range once and closes a block whenever the identity changes
or ``block`` occurrences are full; a block stores artifact ids as differences, and orders and lines, each in the fewest
whole bytes that hold them. Blocks of one identity do not overlap within one index, so a look-up reads the identity's
blocks only, in order of ``first_artifact``, ``first_ord``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Occurrences of a block at most.
BLOCK = 4096
BLOCKS = "kind string, canonical string, first_artifact long, first_ord int, last_artifact long, n int, body binary"
OCCURRENCES = "kind string, canonical string, artifact_id long, ord int, line int"
_FEED = ["kind", "canonical", "artifact_id", "ord"]


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers (below 2^64) behind one byte that says how many bytes each takes."""
    values = values.astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(body: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    width = body[0]
    return np.frombuffer(body[1 : 1 + width * n], dtype=f"<u{width}").astype(np.int64), body[1 + width * n :]


def _block(artifacts: np.ndarray, ords: np.ndarray, lines: np.ndarray) -> bytes:
    return pack(np.diff(artifacts, prepend=artifacts[:1])) + pack(ords) + pack(lines)


#: Occurrences up to which a run is packed as plain integers: most identities have one.
SHORT = 32


def _pack_short(values: list[int]) -> bytes:
    """``pack`` of a few integers."""
    top = max(values)
    if top < 256:
        return b"\1" + bytes(values)
    width = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + b"".join(v.to_bytes(width, "little") for v in values)


def _short_block(artifacts: list[int], ords: list[int], lines: list[int]) -> bytes:
    return _pack_short([q - p for p, q in zip([artifacts[0], *artifacts], artifacts)]) + _pack_short(ords) + _pack_short(lines)


class _Blocks:
    """Blocks gathered to a batch."""

    def __init__(self, block: int):
        self.rows: list[tuple] = []
        self.block = block

    def add(self, name: tuple[str, str], run: list[np.ndarray]) -> None:
        a, o, x = run
        for k in range(0, len(a), self.block):
            s = slice(k, k + self.block)
            self.rows.append((*name, int(a[s][0]), int(o[s][0]), int(a[s][-1]), len(a[s]), _block(a[s], o[s], x[s])))

    def take(self) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        columns = zip(*self.rows) if self.rows else [()] * len(types)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in BLOCKS.split(", ")])
        self.rows = []
        return out


def _changes(batch: pa.RecordBatch) -> list[int]:
    """Rows at which another identity begins."""
    n = batch.num_rows
    if not n:
        return []
    new = [pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, n - 1)).to_numpy(zero_copy_only=False) for k in (0, 1)]
    return [0, *(np.flatnonzero(new[0] | new[1]) + 1).tolist()]


def _encode(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, held, size = _Blocks(block), None, [], 0
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4)]
            plain = [c.tolist() for c in columns]
            cuts = _changes(batch)
            names = zip(*(batch.column(c).take(pa.array(cuts, pa.int64())).to_pylist() for c in (0, 1)))
            for k, end, here in zip(cuts, [*cuts[1:], batch.num_rows], names):
                if here != name and end < batch.num_rows and end - k <= min(SHORT, block):  # whole and short
                    if held:
                        out.add(name, [np.concatenate(c) for c in zip(*held)])
                        held, size = [], 0
                    a, o, x = (c[k:end] for c in plain)
                    out.rows.append((*here, a[0], o[0], a[-1], end - k, _short_block(a, o, x)))
                    name = here
                    continue
                if here != name and held:
                    out.add(name, [np.concatenate(c) for c in zip(*held)])
                    held, size = [], 0
                name = here
                held.append([c[k:end] for c in columns])
                size += end - k
                if size >= block:
                    whole = [np.concatenate(c) for c in zip(*held)]
                    full = size // block * block
                    out.add(name, [c[:full] for c in whole])
                    held, size = [[c[full:] for c in whole]] if size > full else [], size - full
            if len(out.rows) >= 1024:
                yield out.take()
        if held:
            out.add(name, [np.concatenate(c) for c in zip(*held)])
        yield out.take()

    return run


#: Occurrences of a batch that leaves ``_decode``, about.
DECODED = 1 << 16


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OCCURRENCES.split(", ")]
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[row - 1] if row else 0) + DECODED)) + 1
            part = batch.slice(row, min(end, batch.num_rows) - row)
            row += part.num_rows
            n = part.column("n").to_numpy().astype(np.int64)
            columns: list[list[np.ndarray]] = [[], [], []]
            for size, body in zip(n.tolist(), part.column("body").to_pylist()):
                left = memoryview(body)
                for column in columns:
                    values, left = unpack(left, size)
                    column.append(values)
            deltas, ords, lines = (np.concatenate(c) for c in columns)
            # differences add up over all blocks; the first of a block is 0, so what came before it is taken off
            summed = np.cumsum(deltas)
            starts = np.cumsum(n) - n
            artifacts = summed + np.repeat(part.column("first_artifact").to_numpy() - summed[starts], n)
            at = pa.array(np.repeat(np.arange(part.num_rows), n))
            yield pa.RecordBatch.from_arrays([part.column("kind").take(at), part.column("canonical").take(at), pa.array(artifacts), pa.array(ords.astype(np.int32)), pa.array(lines.astype(np.int32))], names=names)


def posting_blocks(facts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks (``BLOCKS``) of all occurrences in ``facts``; lines and orders are not negative."""
    feed = facts.select("kind", "canonical", F.col("artifact_id").cast("long").alias("artifact_id"), F.col("ord").cast("int").alias("ord"), F.col("line").cast("int").alias("line"))
    dealt = feed.repartitionByRange(*_FEED).sortWithinPartitions(*_FEED)
    return dealt.mapInArrow(_encode(block), BLOCKS)


def posting_rows(blocks: DataFrame) -> DataFrame:
    """The occurrences that ``blocks`` hold, as rows ``OCCURRENCES``; a filter on the identity before this call reads its blocks only."""
    return blocks.select("kind", "canonical", "first_artifact", "n", "body").mapInArrow(_decode, OCCURRENCES)


def merged_postings(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """One index of two: blocks of identities that only one of them holds stay as they are; those of shared identities, if
    their ranges of artifacts overlap or leave blocks under half full, are dealt and packed anew."""
    span = lambda df: df.groupBy("kind", "canonical").agg(F.min("first_artifact").alias("low"), F.max("last_artifact").alias("high"), F.min("n").alias("least"))
    a, b = span(left), span(right).toDF("kind", "canonical", "low2", "high2", "least2")
    apart = ((F.col("high") < F.col("low2")) | (F.col("high2") < F.col("low"))) & (2 * F.least("least", "least2") >= block)
    anew = a.join(b, ["kind", "canonical"]).where(~apart).select("kind", "canonical")
    both = left.unionByName(right)
    return both.join(anew, ["kind", "canonical"], "left_anti").unionByName(posting_blocks(posting_rows(both.join(anew, ["kind", "canonical"], "left_semi")), block))
