"""Trees listed by tasks, files written by tasks, pages fetched by tasks."""

import json
import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from factweave.plans.corpus import Corpus
from factweave.sources import files, tree
from factweave.sources.generator import generated_corpus, rendered

TREE = {
    "a.json": b'{"x": 1}', ".env": b"x=1", ".hidden": b"x", "_c.yaml": b"x: 1", "n.json": b"a\0b", "empty.txt": b"", "bin.txt": b"\0\1\2", "sub/.env": b"y=2", "sub/deep/er/z.md": b"# t\n",
    ".git/k.json": b"{}", "sub/node_modules/q.json": b"{}", "sub/.config/r.json": b"{}", ".env.d/s.json": b"{}", "sub/é.conf": b"k=v",
}


def plant(folder):
    for name, body in TREE.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(body)
    with open(folder / "huge.yaml", "wb") as f:
        f.truncate(65 << 20)
    os.symlink(folder / "a.json", folder / "link.json")
    os.symlink(folder / "sub", folder / "linked")
    with open(os.fsencode(folder) + b"/sub/\xff.conf", "wb") as f:
        f.write(b"odd=name")


def walked(top):
    """A plain walk, for comparison."""
    out = []
    for folder, dirs, names in os.walk(os.fsencode(top)):
        dirs[:] = [d for d in dirs if not tree.should_skip(os.fsdecode(d))]
        out += [(os.path.join(folder, n), os.stat(os.path.join(folder, n)).st_size) for n in names if not tree.should_skip(os.fsdecode(n)) and not os.path.islink(os.path.join(folder, n))]
    return sorted(out)


@pytest.mark.parametrize("folders", ["1", "2", "256"])  # all below the root in one task; some; a task a folder
def test_tree_equals_a_walk(spark, tmp_path, folders):
    plant(tmp_path)
    rows = tree.tree(spark, [str(tmp_path)], folders=folders).collect()
    assert sorted((bytes(r["raw"]), r["size"]) for r in rows) == walked(tmp_path)
    kinds = {r["path"].rpartition("/")[2]: r["kind"] for r in rows}
    assert kinds[".env"] == "config" and kinds["huge.yaml"] == "yaml" and "\\xff.conf" in kinds
    twice = tree.tree(spark, [str(tmp_path / "a.json"), str(tmp_path / "a.json"), str(tmp_path / ".hidden")])
    assert sorted(r["path"].rpartition("/")[2] for r in twice.collect()) == [".hidden", "a.json", "a.json"]
    with pytest.raises(FileNotFoundError):
        tree.tree(spark, [str(tmp_path / "none")])


def test_tree_by_address(spark, tmp_path):
    """A store opened by its address; dot names are seen there too."""
    plant(tmp_path)
    os.remove(os.fsencode(tmp_path) + b"/sub/\xff.conf")
    os.remove(tmp_path / "link.json")
    os.remove(tmp_path / "linked")
    got = {unquote(r["path"]).removeprefix(f"file://{tmp_path}/"): r["size"] for r in tree.tree(spark, [f"file://{tmp_path}"]).collect()}
    assert got == {os.fsdecode(p).removeprefix(f"{tmp_path}/"): n for p, n in walked(tmp_path)}
    by_address, by_path = (files.from_paths(spark, [p]) for p in (f"file://{tmp_path}", str(tmp_path)))
    assert by_address[2] == by_path[2] == 3
    # ids follow the addresses, whose names are percent-encoded
    assert by_address[1].drop("artifact_id").exceptAll(by_path[1].drop("artifact_id")).isEmpty() and by_address[1].count() == by_path[1].count()


def test_tree_takes_filters(spark, tmp_path):
    plant(tmp_path)
    everything = tree.tree(spark, [str(tmp_path)]).collect()
    named = lambda rows: sorted(bytes(r["raw"]) for r in rows)
    want = named(r for r in everything if r["kind"] in ("json", "yaml") and r["size"] <= 64 << 20)
    assert named(tree.tree(spark, [str(tmp_path)], kinds="json,yaml", maxBytes=str(64 << 20)).collect()) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = tree.tree(spark, [str(tmp_path)]).where(F.col("kind").isin("json", "yaml") & (F.col("size") <= 64 << 20) & (F.col("size") > 0))
        assert named(some.collect()) == [x for x in want if not x.endswith(b"empty.txt")]
        assert named(tree.tree(spark, [str(tmp_path)]).where("kind = 'config' and size < 4 and size >= 3").collect()) == named(r for r in everything if r["kind"] == "config" and r["size"] == 3)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_corpus_of_a_tree(spark, tmp_path):
    plant(tmp_path)
    artifacts, facts, skipped = files.from_paths(spark, [str(tmp_path)])
    rows = artifacts.orderBy("artifact_id").collect()
    assert skipped == 3 and [r["artifact_id"] for r in rows] == list(range(len(rows)))
    kept = [os.fsdecode(p) for p, _ in walked(tmp_path) if os.path.basename(p) not in (b"n.json", b"empty.txt", b"huge.yaml")]
    assert [r["path"].replace("\\xff", "\udcff") for r in rows] == kept
    held = {(r["path"].rpartition("/")[2], r["canonical"]) for r in facts.join(artifacts.select("artifact_id", "path"), "artifact_id").collect()}
    assert {("a.json", "x=1"), (".env", "x=1"), (".env", "y=2"), ("\\xff.conf", "odd=name"), ("z.md", "h1:t"), ("é.conf", "k=v")} <= held
    assert files.read_paths(spark, [str(tmp_path)]).where("kind is null").count() == 3


def test_files_written_by_tasks_are_a_corpus_again(spark, tmp_path):
    out = str(tmp_path / "out")
    artifacts, facts = generated_corpus(spark, 300, 6)
    rows = rendered(facts).join(artifacts.select("artifact_id", F.col("path").alias("name")), "artifact_id").repartition(5)
    told = tree.write_files(rows, out)
    names = [json.loads(x)["name"] for p in told["parts"] for x in open(f"{out}/{p['part']}/.manifest")]
    assert told["files"] == 300 == len(names) and len(told["parts"]) == 5 and sorted(names) == sorted(r["name"] for r in rows.select("name").collect())
    c = Corpus(*files.from_paths(spark, [out])[:2])
    flagged = {r["path"].rpartition("/")[2] for r in c.stats.where("is_outlier").collect()}
    assert flagged == {n for n in names if n.startswith("rogue")} and len(flagged) == 6
    more = tree.write_files(rows.limit(3), out)
    assert more["files"] == 303 and tree.write_files(rows.limit(2), out, "overwrite")["files"] == 2 == tree.tree(spark, [out]).count()


def test_files_of_a_failed_job_are_not_seen(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([(f"f{k}", b"x") for k in range(8)], "name string, content binary")
    tree.write_files(good.repartition(4), out)
    before = sorted(os.listdir(out))
    for bad in ("a/b", "", "..", "f0"):
        rows = good.union(spark.createDataFrame([(bad, b"x")], good.schema)).coalesce(1)
        with pytest.raises(Exception, match="not a file name|File exists"):
            tree.write_files(rows, out)
        assert sorted(os.listdir(out)) == before and tree.read_manifest(out)["files"] == 8


@pytest.fixture()
def server():
    """Pages that answer, drip, redirect, loop, grow too large, end early or never start; asked times by path."""
    import http.server
    import threading
    import time

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, time.monotonic()))
            to = {"/moved": "/page", "/loop": "/loop", "/away": "file:///etc/hostname"}.get(self.path)
            if self.path == "/never":
                time.sleep(6)
            self.send_response(302 if to else 404 if self.path == "/none" else 200)
            if to:
                self.send_header("Location", to)
            if self.path == "/short":
                self.send_header("Content-Length", "999")
            self.end_headers()
            try:
                if self.path == "/drip":
                    for _ in range(60):
                        self.wfile.write(b"x")
                        self.wfile.flush()
                        time.sleep(0.1)
                elif self.path == "/large":
                    for _ in range(9):
                        self.wfile.write(b"y" * (1 << 20))
                elif not to and self.path != "/empty":
                    self.wfile.write(b"<title>T</title>" + self.path.encode())
            except OSError:
                pass

        def log_message(self, *a):
            pass

    it = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    it.daemon_threads = True
    threading.Thread(target=it.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{it.server_port}", asked
    it.shutdown()


def test_pages_within_their_deadline(spark, server):
    import time

    from factweave.sources import web

    host, _ = server
    at = [f"http://{host}{p}" for p in ("/page", "/drip", "/moved", "/loop", "/away", "/large", "/none", "/empty", "/short", "/never")] + ["ftp://x/y", "http://[bad", "http://127.0.0.1:1/", f"HTTP://{host}/last"]
    began = time.monotonic()
    rows = {r["path"]: r for r in web.fetch_pages(spark, at, 1.5).collect()}
    assert time.monotonic() - began < 25 and [rows[u]["ord"] for u in at] == list(range(len(at)))
    good = {u.rpartition("/")[2] for u in at if rows[u]["error"] is None}
    assert good == {"page", "moved", "last"} and bytes(rows[at[2]]["content"]) == b"<title>T</title>/page"
    why = {u.rpartition("/")[2]: rows[u]["error"] for u in at}
    assert why["drip"] == why["never"] == "timeout" and why["large"] == "body too large" and why["empty"] == "empty body" and "redirect" in why["away"].lower() and why["y"] == "not an http address"
    assert all(rows[u]["content"] is None for u in at if rows[u]["error"])
    table = spark.createDataFrame(list(enumerate(at)), "ord long, path string")
    assert {(r["path"], r["error"] is None) for r in web.fetch_table(table, 1.5).collect()} == {(u, rows[u]["error"] is None) for u in at}


def test_pages_of_a_host_keep_its_rate(spark, server):
    from factweave.sources import web

    host, asked = server
    urls = [f"http://{host}/{k}" for k in range(5)]
    for rows in (web.fetch_pages(spark, urls, 5, per_second=5), web.fetch_table(spark.createDataFrame(list(enumerate(urls)), "ord long, path string"), 5, per_second=5)):
        asked.clear()
        assert rows.where("error is null").count() == 5
        times = sorted(t for _, t in asked)
        assert times[-1] - times[0] > 0.7  # four pauses of a fifth of a second, whatever each answer took


def test_extractors_in_sql(spark):
    from pyspark.errors import AnalysisException

    from factweave.functions.blake3 import identity_of
    from factweave.functions.table_functions import register
    from factweave.sources.content import extract_rows

    register(spark)
    rows = [(0, "json", b'{"a": [1, {"b": null}]}'), (1, "yaml", b"a: 1\nb:\n  - x\n"), (2, "html", b"<title>t</title><form><input name=q></form>"), (3, "markdown", b"# h\n\ntext"), (4, "text", b"\0\1binary text"), (5, "json", b"\0"), (6, "xml", b"<a b='c'/>"), (7, "text", None), (8, "text", b"")]
    spark.createDataFrame(rows, "artifact_id long, kind string, content binary").createOrReplaceTempView("sql_files")
    got = spark.sql("SELECT f.artifact_id, x.* FROM sql_files f, LATERAL extract_facts(f.kind, f.content, identities => true) x").collect()
    kept = spark.createDataFrame([(i, "binary" if i == 4 else k, c) for i, k, c in rows if i not in (5, 7, 8)], "artifact_id long, kind string, content binary")
    want = {(r["artifact_id"], r["ord"], r["kind"], r["canonical"], r["line"]) for r in extract_rows(kept).collect()}
    assert {tuple(r)[:5] for r in got} == want and all(bytes(r["identity"]) == identity_of([r["kind"]], [r["canonical"]])[0] for r in got)
    assert [tuple(r) for r in spark.sql("SELECT * FROM extract_facts('config', 'k = v')").collect()] == [(0, "kv", "k=v", 1)]
    for bad in ("extract_facts(1, 'x')", "extract_facts('json', 2)", "extract_facts('json', 'x', identities => 'yes')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_files_in_sql_are_digested_by_batches(spark):
    from factweave.functions.table_functions import register

    register(spark)
    rows = [(i, k, c) for i, (k, c) in enumerate([("html", b"<p><b>%d</b><i></i></p>"), ("text", b"\0\1binary text %d"), ("json", b"\0"), ("text", None), (None, b'{"a": %d}'), ("html", b"<a></a><b></b><i>"), ("binary", b"")])]
    rows = [(i + 10 * n, k, c and c.replace(b"%d", b"%d" % n)) for n in range(40) for i, k, c in rows]
    spark.createDataFrame(rows, "artifact_id long, kind string, content binary").createOrReplaceTempView("sql_batches")
    by_row = spark.sql("SELECT f.artifact_id, x.* FROM sql_batches f, LATERAL extract_facts(f.kind, f.content) x")
    for content in ("content", "CAST(content AS STRING)"):
        by_batch = spark.sql(f"SELECT * FROM extract_files(TABLE(SELECT artifact_id, kind, {content} AS content FROM sql_batches))")
        assert by_batch.columns == by_row.columns and by_row.count() > 200
        assert sorted(map(tuple, by_batch.collect())) == sorted(map(tuple, by_row.collect()))
