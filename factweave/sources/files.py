"""Files and directory trees as artifacts.

Trees are listed by tasks (``tree``), because Spark's own file listing hides dot and underscore names; bytes are read by
tasks too, and no list of paths passes the driver. ``spread`` reads through Hadoop's file systems for trees that only
Spark can open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.formats import extract
from factweave.functions.graph import materialize, release
from factweave.functions.order import global_rank
from factweave.sources.content import MAX_BYTES, FactBatches, extract_rows, routed, routed_kind
from factweave.sources.rows import FACTS
from factweave.sources.tree import KINDS, SKIPPED, store, tree

#: Files of about so many make a task; its batches of contents hold about so many bytes.
FILES_PER_TASK, READ_BYTES = 512, 32 << 20


def _content(path: bytes, size: int) -> bytes | None:
    if size > MAX_BYTES:
        return None
    try:
        fs, inner = store(path)
        with open(inner, "rb") if fs is None else fs.open_input_stream(inner) as f:
            return f.read(MAX_BYTES + 1)
    except OSError:
        return None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["path", "kind", "size", "content"], [pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        rows, held = [], 0
        for _, path, raw, kind, size in zip(*(c.to_pylist() for c in batch.columns)):
            content = _content(raw, size)
            kind = routed_kind(kind, content)
            rows.append((path, kind, size, content if kind else None))
            held += len(content or b"")
            if held >= READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts by listing key; before them one row ``ord = -1`` per file with the kind it was read as (null if
    skipped)."""
    held = FactBatches()
    for batch in batches:
        for key, _, raw, kind, size in zip(*(c.to_pylist() for c in batch.columns)):
            content = _content(raw, size)
            kind = routed_kind(kind, content)
            held.add(key, [(kind, "", 0)], -1)
            if kind:
                held.add(key, extract(kind, content))
            if held.full():
                yield held.take()
    yield held.take()


def _listed(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """The written listing ``key, path, raw, kind, size``, the same dealt out to reading tasks, and its length."""
    listed = materialize(tree(spark, paths).select(F.monotonically_increasing_id().alias("key"), "path", "raw", "kind", "size"))
    n = listed.count()
    return listed, listed.repartition(max(spark.sparkContext.defaultParallelism, min(n // FILES_PER_TASK + 1, 100_000))), n


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, kind, size, content`` of every file; skipped files have a null kind."""
    return _listed(spark, paths)[1].mapInArrow(_read, "path string, kind string, size long, content binary")


def from_paths(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """``(artifacts, facts, skipped)``. Ids are dense over kept files in byte order of their paths. A binary's stored kind is
    ``binary``; a sniffed text keeps the kind ``text``. Each file is read once, by a task, and its facts are written out
    before ids are given; facts meet their ids by one narrow join."""
    listed, dealt, n = _listed(spark, paths)
    read = materialize(dealt.mapInArrow(_extracted, FACTS))
    seen = read.where("ord = -1 and kind is not null").select(F.col("artifact_id").alias("key"), "kind")
    kept = listed.drop("kind").join(seen, "key")
    kept = materialize(global_rank(kept, [F.col("raw"), F.col("key")], "artifact_id"))
    release(listed)
    n_kept = kept.count()
    ids = kept.select("key", "artifact_id")
    ids = F.broadcast(ids) if n_kept <= 200_000 else ids
    facts = read.where("ord >= 0").withColumnRenamed("artifact_id", "key").join(ids, "key").select("artifact_id", "ord", "kind", "canonical", "line")
    return kept.select("artifact_id", "path", "kind", "size"), facts, n - n_kept


def spread(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(artifacts, facts, skipped)`` of a tree in any store Spark reads; ``skipped`` has one row ``n``. The folders and
    names that a walk leaves out are left out here; dot and underscore names stay hidden, as Spark's listing
    hides them, and empty files, which hold no facts, are not seen at all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = files.select("path").limit(0).sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    root = str(root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath())
    below = F.split(F.expr("substring(path, instr(path, '{0}') + {1})".format(root.replace("\\", "\\\\").replace("'", "\\'"), len(root) + 1)), "/")
    hidden = F.exists(below, lambda p: p.isin(*SKIPPED) | (p.startswith(".") & ~p.isin(".env", ".", "..", "")))
    files = files.where(~hidden)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    kind = F.lit("text")
    for exts, k in KINDS.items():
        kind = F.when(ext.isin(*exts.split()), k).otherwise(kind)
    kind = F.when(base == ".env", "config").otherwise(kind)
    fit = files.where(F.col("length") <= MAX_BYTES)
    rows = routed(fit.select(F.xxhash64("path").alias("artifact_id"), "path", kind.alias("kind"), F.col("length").alias("size"), "content"))
    skipped = files.agg(F.count_if(F.col("length") > MAX_BYTES).alias("n")).union(rows.agg(F.count_if(F.col("kind").isNull()))).agg(F.sum("n").alias("n"))
    kept = rows.where("kind is not null")
    return kept.select("artifact_id", "path", "kind", "size"), extract_rows(kept), skipped
