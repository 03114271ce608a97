"""Command line: analyse paths, or ``kit``, ``yara``, ``web``, ``ask``. Exit codes: 0 ok, 1 error, 2 usage, 3 gate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import gate
from factweave.plans import ask, report
from factweave.plans.corpus import Corpus
from factweave.sources import content, files, web

COMMANDS = ("kit", "yara", "web", "ask")


def _session() -> SparkSession:
    return SparkSession.builder.appName("factweave").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _load(spark: SparkSession, paths: list[str], keys_only: bool = False) -> tuple[Corpus, int]:
    artifacts, facts, skipped = files.from_paths(spark, paths)
    c = Corpus(artifacts, facts, reused=True)
    return (c.keys_only() if keys_only else c), skipped


def _contents(spark: SparkSession, paths: list[str], artifacts: DataFrame) -> DataFrame:
    return files.read_paths(spark, paths).where("kind is not null").join(artifacts.select("artifact_id", "path"), "path").select("artifact_id", "content")


def _section(a: argparse.Namespace) -> str:
    return next((s for s in report.SECTIONS[1:] if getattr(a, s)), "all")


def _analyse(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="factweave")
    p.add_argument("paths", nargs="+")
    p.add_argument("--json", action="store_true")
    for s in report.SECTIONS[1:]:
        p.add_argument(f"--{s}", action="store_true")
    p.add_argument("--evidence", action="store_true")
    p.add_argument("--keys-only", action="store_true")
    p.add_argument("--fail-on")
    p.add_argument("--write", help="write every section as Parquet under this folder")
    a = p.parse_args(argv)
    if a.fail_on is not None:
        gate.parse(a.fail_on)  # before any input is read
    spark = _session()
    c, skipped = _load(spark, a.paths, a.keys_only)
    if c.artifacts.isEmpty():
        print("no artifacts", file=sys.stderr)
        return gate.EXIT_ERROR
    rows = c.gate(a.fail_on).orderBy("position").collect() if a.fail_on is not None else None
    if a.write:
        report.write_sections(c, a.write)
    print(report.json_report(c, rows, a.evidence, skipped) if a.json else report.text_report(c, _section(a), rows, skipped))
    return gate.EXIT_GATE if rows and any(r["tripped"] for r in rows) else gate.EXIT_OK


def _web(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="factweave web")
    p.add_argument("urls", nargs="+")
    p.add_argument("--json", action="store_true")
    for s in report.SECTIONS[1:]:
        p.add_argument(f"--{s}", action="store_true")
    p.add_argument("--snapshot-dir")
    p.add_argument("--timeout", type=float, default=10.0)
    a = p.parse_args(argv)
    spark = _session()
    pages = web.fetch_pages(spark, a.urls, a.timeout).cache()
    for r in pages.where("error is not null").select("path", "error").collect():
        print(f"warning: {r['path']}: {r['error']}", file=sys.stderr)
    good = pages.where("error is null")
    if good.isEmpty():
        print("nothing fetched", file=sys.stderr)
        return gate.EXIT_ERROR
    if a.snapshot_dir:
        web.save_snapshots(good, a.snapshot_dir)
    c = Corpus.from_sources(content.from_rows(good.select(F.col("ord").alias("artifact_id"), "path", "kind", "content")))
    print(report.json_report(c) if a.json else report.text_report(c, _section(a)))
    return gate.EXIT_OK


def _signature(command: str, argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog=f"factweave {command}")
    p.add_argument("paths", nargs="+")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = _session()
    c, _ = _load(spark, a.paths)
    if command == "yara":
        print(report.yara(c, report.chunk_heads(c, _contents(spark, a.paths, c.artifacts))))
    else:
        print(report.kit_json(c) if a.json else report.kit_text(c))
    return gate.EXIT_OK


def _ask(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="factweave ask")
    p.add_argument("question")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--dry-run", action="store_true", help="print the prompt (sending it is not built in)")
    a = p.parse_args(argv)
    c, _ = _load(_session(), a.paths)
    print(ask.prompt(c, a.question))
    return gate.EXIT_OK


def run(argv: list[str]) -> int:
    try:
        if argv and argv[0] in COMMANDS:
            return {"web": _web, "ask": _ask}.get(argv[0], lambda x: _signature(argv[0], x))(argv[1:])
        return _analyse(argv)
    except gate.GateError as e:
        print(f"bad policy: {e}", file=sys.stderr)
        return gate.EXIT_USAGE
    except SystemExit as e:
        return int(e.code or 0)
    except OSError as e:
        print(e, file=sys.stderr)
        return gate.EXIT_ERROR


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
