"""Pages fetched over HTTP as artifacts, with a deadline per address, a rate per host and failures as rows.

Addresses are dealt out by host, so one task asks a host and keeps its rate. A task's pages are got by a process of its
own, which is killed when a page is not complete at its deadline, whatever the server does, and started anew for the next.
"""

from __future__ import annotations

import json
import os
import re
import selectors
import subprocess
import sys
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factweave.sources import fetcher

NAME_MAX = 96
FETCHED = "ord long, path string, kind string, content binary, error string"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
_NAMES = [c.split()[0] for c in FETCHED.split(", ")]
#: Rows leave a task when they hold so many bytes.
BATCH_BYTES = 16 << 20


def snapshot_name(url: str) -> str:
    """A file name for a fetched page."""
    bare = re.sub(r"^[a-z]+://", "", url)
    name = re.sub(r"[^A-Za-z0-9.-]+", "_", bare)[:NAME_MAX].rstrip("_.") or "page"
    return name if name.endswith((".html", ".htm")) else f"{name}.html"


def host_of(url: str) -> str:
    """The host that is asked, with its port; empty where the address is none of HTTP."""
    try:
        parts = urlsplit(url)
        return parts.netloc.rpartition("@")[2].lower() if parts.scheme.lower() in ("http", "https") else ""
    except ValueError:
        return ""


class Fetcher:
    """A page process and its deadline."""

    def __init__(self, seconds: float):
        self.seconds = seconds
        self.process: subprocess.Popen | None = None

    def _read(self, n: int | None, until: float) -> bytes:
        """``n`` bytes, or a line, of the process's answer; late or broken answers are errors."""
        out, pipe = bytearray(), self.process.stdout.fileno()
        with selectors.DefaultSelector() as ready:
            ready.register(pipe, selectors.EVENT_READ)
            while (len(out) < n) if n is not None else not out.endswith(b"\n"):
                if not ready.select(max(0.0, until - time.monotonic())):
                    raise TimeoutError("timeout")
                got = os.read(pipe, 1 if n is None else min(n - len(out), 1 << 16))
                if not got:
                    raise OSError("page process ended")
                out += got
        return bytes(out)

    def start(self) -> None:
        """Start the process, so that its start is not the first page's time."""
        if self.process is None:
            self.process = subprocess.Popen([sys.executable, fetcher.__file__], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
            self._ask("http://localhost:0/", time.monotonic() + 30)

    def get(self, url: str) -> tuple[bytes | None, str | None]:
        """``(body, error)``, within the deadline."""
        if not host_of(url):
            return None, "not an http address"
        self.start()
        until = time.monotonic() + self.seconds
        try:
            head, body = self._ask(url, until)
            return (None, head["error"]) if head["error"] else (body, None)
        except (OSError, ValueError) as e:
            self.close()
            return None, str(e) or type(e).__name__

    def _ask(self, url: str, until: float) -> tuple[dict, bytes]:
        self.process.stdin.write(json.dumps({"url": url, "seconds": self.seconds}).encode() + b"\n")
        self.process.stdin.flush()
        head = json.loads(self._read(None, until))
        return head, self._read(head["bytes"], until)

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process.stdin.close()
            self.process.stdout.close()
            self.process = None


def fetched(rows: Iterable[tuple[int, str]], seconds: float, per_second: float | None) -> Iterator[pa.RecordBatch]:
    """Rows ``FETCHED`` of ``(ord, url)``; hosts are asked at most ``per_second`` times a second each."""
    fetch, out, held, free = Fetcher(seconds), [], 0, {}
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
    try:
        for ord_, url in rows:
            host = host_of(url)
            if per_second and host:
                fetch.start()
                time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                free[host] = time.monotonic() + 1 / per_second
            body, error = fetch.get(url)
            out.append((ord_, url, "text", body, error))
            held += len(body or b"")
            if held >= BATCH_BYTES:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()
    finally:
        fetch.close()


@dataclass
class _Host(InputPartition):
    rows: list[tuple[int, str]]


class _UrlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = json.loads(options["urls"])
        self.seconds = float(options.get("seconds", "10"))
        self.rate = float(options["persecond"]) if "persecond" in options else None

    def partitions(self) -> list[_Host]:
        hosts: dict[str, list[tuple[int, str]]] = {}
        for n, url in enumerate(self.urls):
            hosts.setdefault(host_of(url), []).append((n, url))
        return [_Host(rows) for rows in hosts.values()]

    def read(self, part: _Host) -> Iterator[pa.RecordBatch]:
        yield from fetched(part.rows, self.seconds, self.rate)


class UrlSource(DataSource):
    """Options: ``urls`` (a JSON list), ``seconds`` (deadline of a page), ``perSecond`` (pages a second of one host)."""

    @classmethod
    def name(cls) -> str:
        return "factweave_urls"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _UrlReader({k.lower(): v for k, v in dict(self.options).items()})


def fetch_pages(spark: SparkSession, urls: list[str], seconds: float = 10.0, per_second: float | None = None) -> DataFrame:
    """``ord, path, kind, content, error`` per address of a list; whatever the server does, one row within the deadline."""
    spark.dataSource.register(UrlSource)
    options = {"urls": json.dumps(urls), "seconds": str(seconds)} | ({"perSecond": str(per_second)} if per_second else {})
    return spark.read.format(UrlSource.name()).options(**options).load()


def fetch_table(urls: DataFrame, seconds: float = 10.0, per_second: float | None = None) -> DataFrame:
    """The same for a table ``ord, path`` of addresses of any length: rows are dealt out by host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fetched(((o, u or "") for b in batches for o, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), seconds, per_second)

    host = F.lower(F.regexp_extract("path", r"^(?i:https?)://([^/?#]*)", 1))
    dealt = urls.select(F.col("ord").cast("long").alias("ord"), "path", host.alias("host")).repartition("host").sortWithinPartitions("host", "ord")
    return dealt.select("ord", "path").mapInArrow(run, FETCHED)


def save_snapshots(pages: DataFrame, folder: str) -> None:
    """Write each fetched page under its snapshot name; the folder must be one that all executors share."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, snapshot_name(r["path"])), "wb") as f:
                f.write(bytes(r["content"]))

    pages.where("content is not null").select("path", "content").foreachPartition(write)
