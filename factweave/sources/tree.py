"""Directory trees listed by tasks, and files written by tasks, as Python data sources.

``factweave_tree`` lists folders: the driver opens at most ``folders`` of them, to cut the trees into that many
partitions or so, and keeps folder names only; everything below is walked by the tasks, which hand out names, kinds and
sizes in batches. Folders and names that a corpus leaves out are never entered or returned, dot files that it keeps
are seen; kinds and sizes can be filtered while listing. Trees are those of the machine's own file systems, or of any
store that pyarrow opens by its address (``file://``, ``s3://``, ``gs://``, ``hdfs://``).

``factweave_files`` writes rows ``name, content`` as files: each task fills a folder of its own that no reader enters, and
only when all tasks are done are the folders renamed into place, one rename a task, with a manifest beside them.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Directories and names never entered, and kinds by extension.
SKIPPED = frozenset(".git .svn .hg zig-out .zig-cache zig-cache node_modules target .venv __pycache__".split())
KINDS = {
    "json": "json",
    "yaml yml": "yaml",
    "xml svg xsd xsl plist": "xml",
    "html htm": "html",
    "pdf": "pdf",
    "cbor": "cbor",
    "exe dll so dylib bin o a wasm elf": "binary",
    "md markdown": "markdown",
    "ini conf cfg toml properties env": "config",
}
_BY_EXTENSION = {e: k for es, k in KINDS.items() for e in es.split()}
LISTED = "path string, raw binary, kind string, size long"
_ARROW = pa.schema([("path", pa.string()), ("raw", pa.binary()), ("kind", pa.string()), ("size", pa.int64())])
FOLDERS, BATCH = 256, 4096


def should_skip(relative: str) -> bool:
    """Whether a path below a walked root is hidden or a build or cache folder; ``.env`` itself is kept."""
    return any(p in SKIPPED or (p.startswith(".") and p not in (".env", ".", "..")) for p in relative.split("/"))


def kind_of(path: str) -> str:
    base = path.rpartition("/")[2]
    if base == ".env":
        return "config"
    stem, dot, ext = base.rpartition(".")
    return _BY_EXTENSION.get(ext.lower(), "text") if dot and stem else "text"


def store(path: bytes) -> tuple[pafs.FileSystem | None, str | bytes]:
    """The store an address names and the path inside it; None for a plain path."""
    return pafs.FileSystem.from_uri(path.decode()) if b"://" in path else (None, path)


def size_of(path: bytes) -> int | None:
    """A file's size, or None for a folder; what does not exist is an error."""
    fs, inner = store(path)
    if fs is None:
        return None if os.path.isdir(inner) else os.stat(inner).st_size
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path.decode())
    return None if info.type == pafs.FileType.Directory else info.size


def entries(folder: bytes) -> Iterator[tuple[bytes, int | None]]:
    """``(path, size)`` of what a folder holds and a corpus keeps; size is None for folders. Links are left out, and so
    is all of a folder that cannot be opened."""
    fs, inner = store(folder)
    join = lambda name: folder + (b"" if folder.endswith(b"/") else b"/") + name
    try:
        if fs is not None:
            for info in fs.get_file_info(pafs.FileSelector(inner)):
                if not should_skip(info.base_name) and info.type in (pafs.FileType.File, pafs.FileType.Directory):
                    yield join(quote(info.base_name).encode()), info.size if info.type == pafs.FileType.File else None
            return
        with os.scandir(inner) as found:
            for e in found:
                if should_skip(os.fsdecode(e.name)):
                    continue
                if e.is_dir(follow_symlinks=False):
                    yield join(e.name), None
                elif e.is_file(follow_symlinks=False):
                    yield join(e.name), e.stat(follow_symlinks=False).st_size
    except OSError:
        return


def walk(folder: bytes, deep: bool) -> Iterator[tuple[bytes, int]]:
    """Files of a folder, and of all folders below it where ``deep``."""
    open_ = [folder]
    while open_:
        for path, size in entries(open_.pop()):
            if size is not None:
                yield path, size
            elif deep:
                open_.append(path)


@dataclass
class _Part(InputPartition):
    folder: bytes
    deep: bool
    size: int | None = None


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [p.encode("utf-8", "surrogateescape") for p in json.loads(options["paths"])]
        self.folders = int(options.get("folders", FOLDERS))
        self.kinds = set(options["kinds"].split(",")) if "kinds" in options else None
        self.low, self.high = 0, int(options["maxbytes"]) if "maxbytes" in options else None

    def partitions(self) -> list[_Part]:
        parts, queue = [], []
        for p in self.roots:
            size = size_of(p)
            if size is None:
                queue.append(p)
            else:
                parts.append(_Part(p, False, size))
        opened = 0
        while queue and opened < self.folders and len(queue) < self.folders:
            folder, opened = queue.pop(0), opened + 1
            parts.append(_Part(folder, False))
            queue += [p for p, size in entries(folder) if size is None]
        return parts + [_Part(f, True) for f in queue]

    def _fits(self, kind: str, size: int) -> bool:
        return (self.kinds is None or kind in self.kinds) and self.low <= size and (self.high is None or size <= self.high)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        found = iter([(part.folder, part.size)]) if part.size is not None else walk(part.folder, part.deep)
        rows: list[tuple] = []
        for raw, size in found:
            path = raw.decode("utf-8", "backslashreplace")
            kind = kind_of(path)
            if self._fits(kind, size):
                rows.append((path, raw, kind, size))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _FilteringReader(_TreeReader):
    """Takes filters on ``kind`` and ``size`` from the query's plan."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("kind",) and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = values if self.kinds is None else self.kinds & values
            elif column == ("size",) and isinstance(f, LessThan | LessThanOrEqual):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            elif column == ("size",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            else:
                yield f


class TreeSource(DataSource):
    """Options: ``paths`` (a JSON list), ``folders``, ``kinds`` (comma-separated), ``maxBytes``; ``pushdown`` (``true``, where
    the session allows filters to be pushed to Python sources) takes filters from the query."""

    @classmethod
    def name(cls) -> str:
        return "factweave_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        return (_FilteringReader if options.get("pushdown") == "true" else _TreeReader)(options)


def tree(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """``path, raw, kind, size`` of every file of ``paths``: folders are walked, other arguments are taken as they
    are, a path given twice is listed twice, addresses stay addresses (names below them are percent-encoded). ``raw`` is the path's own bytes; ``path`` shows bytes that are not UTF-8 with
    backslashes. A path that does not exist is an error here, before any task."""
    for p in paths:
        size_of(p.encode("utf-8", "surrogateescape"))
    spark.dataSource.register(TreeSource)
    asked = json.dumps(paths)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        options["pushdown"] = "true"
    return spark.read.format(TreeSource.name()).options(paths=asked, **options).load()


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int
    bytes: int


class _FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.job, self.overwrite = folder, uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        own = os.path.join(self.folder, f".writing-{self.job}-{uuid.uuid4().hex}")
        os.makedirs(own)
        files = total = 0
        with open(os.path.join(own, ".manifest"), "w", encoding="utf-8") as manifest:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    if not name or "/" in name or name in (".", "..", ".manifest"):
                        raise ValueError(f"not a file name: {name!r}")
                    body = content.as_py() or b""
                    with open(os.path.join(own, name), "xb") as f:
                        f.write(body)
                    manifest.write(json.dumps({"name": name, "bytes": len(body)}) + "\n")
                    files, total = files + 1, total + len(body)
        return _Written(own, files, total)

    def _remove(self) -> None:
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            if name.startswith(f".writing-{self.job}-"):
                shutil.rmtree(os.path.join(self.folder, name), ignore_errors=True)

    def commit(self, messages: list[_Written | None]) -> None:
        done = [m for m in messages if m]
        before = sorted(n for n in os.listdir(self.folder) if n.startswith("part-")) if os.path.isdir(self.folder) else []
        os.makedirs(self.folder, exist_ok=True)
        parts = []
        for k, m in enumerate(x for x in done if x.files):
            part = f"part-{self.job}-{k:05}"
            os.rename(m.folder, os.path.join(self.folder, part))
            parts.append({"part": part, "files": m.files, "bytes": m.bytes})
        kept = [] if self.overwrite else read_manifest(self.folder)["parts"]
        told = os.path.join(self.folder, f".manifest-{self.job}")
        with open(told, "w", encoding="utf-8") as f:
            json.dump({"files": sum(p["files"] for p in kept + parts), "bytes": sum(p["bytes"] for p in kept + parts), "parts": kept + parts}, f)
        os.replace(told, os.path.join(self.folder, ".manifest"))
        if self.overwrite:
            for name in before:
                shutil.rmtree(os.path.join(self.folder, name), ignore_errors=True)
        self._remove()  # attempts that lost against another one of their task

    def abort(self, messages: list[_Written | None]) -> None:
        self._remove()


class FilesSink(DataSource):
    """Option ``path``: a folder that the driver and all executors share. Modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "factweave_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FilesWriter(self.options["path"], overwrite)


def read_manifest(folder: str) -> dict:
    """Totals and parts of what ``write_files`` has committed to ``folder``; each part holds a ``.manifest`` of its own
    with a line a file."""
    try:
        with open(os.path.join(folder, ".manifest"), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {"files": 0, "bytes": 0, "parts": []}


def write_files(rows: DataFrame, folder: str, mode: str = "append") -> dict:
    """Write rows ``name, content`` as files below ``folder``, a part folder a task, and return the manifest. Nothing of a
    job that fails is seen; a name twice in one task, or one that is no plain file name, fails the job."""
    folder = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"not a folder that tasks can open: {folder}")
    rows.sparkSession.dataSource.register(FilesSink)
    rows.select("name", "content").write.format(FilesSink.name()).mode(mode).save(folder)
    return read_manifest(folder)
