"""Bytes to facts: one Arrow map over ``(artifact_id, kind, content)`` rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import formats
from factweave.sources.rows import FACTS

#: Text kinds whose bytes hold a NUL early are binaries (kind ``text``) or skipped (any other text kind).
SNIFF_BYTES, MAX_BYTES = 8192, 64 << 20
_BYTE_KINDS = ("pdf", "binary", "cbor")


def routed_kind(kind: str, content: bytes | None) -> str | None:
    """Kind to extract with, or None to skip the artifact."""
    if not content or len(content) > MAX_BYTES:
        return None
    if kind in _BYTE_KINDS or 0 not in content[:SNIFF_BYTES]:
        return kind
    return "binary" if kind == "text" else None


#: Facts leave a task in batches of about so many rows or bytes, or by the artifact where one has more.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 8 << 20
_NAMES = ["artifact_id", "ord", "kind", "canonical", "line"]
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]


class FactBatches:
    """Facts gathered to batches, so memory follows the largest artifact and a batch."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _NAMES]
        self.bytes = 0

    def add(self, artifact_id: int, found: list[formats.Fact], first: int = 0) -> None:
        if found:
            kinds, canonicals, lines = zip(*found)
            for column, more in zip(self.columns, ([artifact_id] * len(found), range(first, first + len(found)), kinds, canonicals, lines)):
                column.extend(more)
            self.bytes += sum(map(len, canonicals))

    def full(self) -> bool:
        return len(self.columns[0]) >= BATCH_ROWS or self.bytes >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, _TYPES)], names=_NAMES)
        self.__init__()
        return out


#: Artifacts are read in groups of so many, or by the artifact where their contents have more bytes, so that the digests of a
#: group are taken together.
GROUP_ROWS, GROUP_BYTES = 2048, 2 << 20


def _groups(files: Iterable[tuple[int, str, bytes]]) -> Iterator[list[tuple[int, str, bytes]]]:
    group, size = [], 0
    for id_, kind, body in files:
        if group and (len(group) >= GROUP_ROWS or size + len(body) > GROUP_BYTES):
            yield group
            group, size = [], 0
        group.append((id_, kind, body))
        size += len(body)
    if group:
        yield group


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
    for batch in batches:
        for id_, kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            yield id_, kind, content.as_py() or b""


def _routed_files(files: Iterable[tuple[int, str, bytes]]) -> Iterator[tuple[int, str, bytes]]:
    """Files with the kind they are extracted as, without those that are skipped."""
    for id_, kind, body in files:
        if (read_as := routed_kind(kind, body)) is not None:
            yield id_, read_as, body


def facts_of(files: Iterable[tuple[int, str, bytes]], read: Callable[[Iterable[tuple[str, bytes]]], Iterable[list[formats.Fact]]] = formats.extract_many) -> Iterator[pa.RecordBatch]:
    """Facts of files ``(artifact_id, kind, content)``, each read as its kind."""
    held = FactBatches()
    for group in _groups(files):
        for (id_, _, _), found in zip(group, read((kind, body) for _, kind, body in group)):
            held.add(id_, found)
            if held.full():
                yield held.take()
    yield held.take()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return facts_of(_files(batches))


def _routed_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return facts_of(_routed_files(_files(batches)))


def _form_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return facts_of(_routed_files(_files(batches)), lambda group: (formats.form_facts(kind, body) for kind, body in group))


#: Parts of ``dealt`` for each core.
DEALT = 4


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in a few parts for each core, by a hash of ``key`` (their id). A table of short rows is one file with one block of
    rows, hence one task, whatever is then composed, parsed or counted from each row; rows are dealt while they are short."""
    return rows.repartition(DEALT * rows.sparkSession.sparkContext.defaultParallelism, key)


def extract_rows(rows: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = _facts) -> DataFrame:
    """Facts of rows ``artifact_id, kind, content``."""
    return rows.select(F.col("artifact_id").cast("long").alias("artifact_id"), "kind", "content").mapInArrow(read, FACTS)


def _early_nul() -> Column:
    """Whether the first bytes hold a NUL: a search by bytes, as ``position`` counts characters."""
    return F.contains(F.substring("content", 1, SNIFF_BYTES), F.lit(b"\0"))


def routed(rows: DataFrame) -> DataFrame:
    """Rows with the kind they are extracted as; skipped rows have a null kind. Catalyst only."""
    size = F.octet_length("content")
    kind = F.when(F.coalesce(size, F.lit(0)) == 0, None).when(size > MAX_BYTES, None)
    kind = kind.when(F.col("kind").isin(*_BYTE_KINDS) | ~_early_nul(), F.col("kind")).when(F.col("kind") == "text", "binary")
    return rows.withColumn("kind", kind)


def from_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(artifacts, facts)`` of in-memory sources ``artifact_id, path, kind, content``; skipped rows are gone.

    The tasks that read a content route it too: a filter before them would go below the deal of ``dealt`` and compose every
    content there, in as many tasks as the table has blocks. For the artifacts a content is generated, so that it is composed once a
    row and conditions on it stay above the deal."""
    composed = rows.select("artifact_id", "path", "kind", F.explode(F.array("content")).alias("content"))
    artifacts = routed(composed).where("kind is not null").select(F.col("artifact_id").cast("long").alias("artifact_id"), "path", "kind", F.octet_length("content").cast("long").alias("size"))
    return artifacts, extract_rows(rows, _routed_facts)


def form_rows(rows: DataFrame) -> DataFrame:
    """Those facts of ``from_rows`` that tell of forms, read without the others; their ``ord`` keeps their order."""
    return extract_rows(rows, _form_facts)
