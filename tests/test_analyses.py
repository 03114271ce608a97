import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.operators import consensus, gate
from factweave.plans import ask, report
from factweave.plans.corpus import Corpus
from factweave.sources import content, files, web
from factweave.sources.generator import generated_corpus, rendered


def corpus(spark, sets, reused=False):
    arts = spark.createDataFrame([(i, f"f{i}.yaml", "yaml", 1) for i in range(len(sets))], "artifact_id long, path string, kind string, size long")
    facts = spark.createDataFrame([(i, n, "kv", c, n) for i, s in enumerate(sets) for n, c in enumerate(s)], "artifact_id long, ord int, kind string, canonical string, line int")
    return Corpus(arts, facts, reused)


def test_random_memberships_match_counting(spark):
    rng = random.Random(7)
    for _ in range(3):
        n = rng.randrange(4, 14)
        sets = [[f"k{j}=v" for j in range(30) if rng.random() < (j + 1) / 31] for _ in range(n)]
        sets[0] = []
        sets[1] = sets[1] + sets[1][:2]
        c = corpus(spark, sets)
        k = Counter(x for s in sets for x in set(s))
        core = {x for x in k if 2 * k[x] > n}
        got = {r["artifact_id"]: r for r in c.stats.collect()}
        for i, s in enumerate(sets):
            s = set(s)
            union = len(s | core)
            assert got[i]["total"] == len(s) and got[i]["in_core"] == len(s & core)
            assert got[i]["n_unique"] == sum(k[x] == 1 for x in s)
            assert abs(got[i]["drift"] - (1 - len(s & core) / union if union else 0)) < 1e-12
        ids = {r["canonical"]: r for r in c.identities.collect()}
        assert {x: r["k"] for x, r in ids.items()} == dict(k)
        assert c.facts.count() == sum(r["occurrences"] for r in ids.values())


def test_bucket_boundaries(spark):
    rows = spark.createDataFrame([(5, 5), (4, 5), (3, 5), (2, 5), (1, 5), (1, 1)], "k long, n long")
    got = [r[0] for r in rows.select(consensus.bucket(F.col("k"), F.col("n"))).collect()]
    assert got == ["universal", "majority", "majority", "minority", "unique", "universal"]


def test_factions_and_missing_core(spark):
    base = [f"c{i}=1" for i in range(6)]
    sets = [base + [f"own{i}=1"] for i in range(6)]
    sets += [base[:2] + ["x=1", "y=1", f"own{i}=1"] for i in (6, 7)] + [base[:2] + ["p=1", "q=1", f"own{i}=1"] for i in (8, 9, 10)]
    c = corpus(spark, sets, reused=True)
    labels, table, signature = c.factions
    rows = table.orderBy("faction_id").collect()
    assert [(r["size"], r["root"], r["cohesion"]) for r in rows] == [(3, 8, 1.0), (2, 6, 1.0)]
    assert [r["canonical"] for r in signature.where("root = 8").orderBy("rank").collect()] == ["p=1", "q=1"]
    assert {(r["root"], r["canonical"]) for r in c.exclusive.collect()} == {(6, "x=1"), (6, "y=1"), (8, "p=1"), (8, "q=1")}
    missing = consensus.missing_core(8, c.members, c.identities).collect()
    assert [r["canonical"] for r in missing] == base[2:]
    text = report.text_report(c, gate_rows=c.gate("outliers").collect())
    assert "Factions" in text and "Gate" in text
    assert "missing: c2=1" in ask.prompt(c, "what about f8.yaml?")
    assert '"schema": "factweave.report.v1"' in report.json_report(c, full=True)


def test_conflicts_count_holders_of_both_values(spark):
    c = corpus(spark, [["port=1", "tags[]=a"], ["port=1", "port=2"], ["port=2", "id=3"], ["port=1", "id=4"]])
    rows = [r.asDict() for r in c.conflicts.collect()]
    assert rows == [{"key": "port", "n_values": 2, "plurality": "1", "holders": 4, "deviants": 2}]


def test_gate_grammar():
    assert gate.parse(" conflicts , drift>0.5") == [gate.Condition("conflicts", 0.0), gate.Condition("drift", 0.5)]
    for bad in ("", "drift", "nope", "outliers>-1", "outliers>nan", "outliers>x", "conflicts,,drift>1", "outliers>"):
        with pytest.raises(gate.GateError):
            gate.parse(bad)


def test_generated_rogues_are_the_outliers(spark):
    c = Corpus(*generated_corpus(spark, 400, 8))
    flagged = {r["path"] for r in c.stats.where("is_outlier").collect()}
    planted = {r["path"] for r in c.artifacts.where("path like 'rogue%'").collect()}
    assert flagged == planted and len(planted) == 8
    arts, facts = generated_corpus(spark, 30, 2)
    for kind, as_kind in (("yaml", "yaml"), ("json", "json"), ("conf", "config")):
        rows = rendered(facts, kind).join(arts.select("artifact_id", "path"), "artifact_id").withColumn("kind", F.lit(as_kind))
        _, again = content.from_rows(rows)
        assert sorted(map(tuple, again.select("artifact_id", "canonical").collect())) == sorted(map(tuple, facts.select("artifact_id", "canonical").collect()))


def test_directory_corpus(spark, tmp_path):
    from factweave import cli

    for name, data in {"a.json": b'{"x": 1}', "b.json": b'{ "x":1 }', "_c.yaml": b"x: 1", "n.json": b"a\0b", ".env": b"x=1", ".hidden": b"x", "empty.txt": b"", "bin.txt": b"\0\1\2"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "k.json").write_bytes(b"{}")
    arts, facts, skipped = files.from_paths(spark, [str(tmp_path)])
    kinds = {r["path"].rpartition("/")[2]: r["kind"] for r in arts.collect()}
    assert kinds == {"a.json": "json", "b.json": "json", "_c.yaml": "yaml", ".env": "config", "bin.txt": "binary"} and skipped == 2
    assert [r["artifact_id"] for r in arts.orderBy("path").collect()] == list(range(5))
    c = Corpus(arts, facts, reused=True)
    assert c.identities.where("canonical = 'x=1'").first()["k"] == 4
    assert cli.run([str(tmp_path), "--fail-on", "outliers>99"]) == 0
    assert cli.run([str(tmp_path), "--fail-on", "drift>0.1", "--consensus"]) == 3
    assert cli.run([str(tmp_path), "--fail-on", "nope"]) == 2
    assert cli.run([str(tmp_path / "missing.txt")]) == 1
    assert cli.run(["yara", str(tmp_path)]) == 0 and cli.run(["kit", "--json", str(tmp_path)]) == 0
    lines = c.keys_only().identities.collect()
    assert {r["canonical"] for r in lines if r["kind"] == "kv"} >= {"x"}


def test_web_source_with_local_server(spark, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                import time

                time.sleep(5)
            self.send_response(404 if self.path == "/none" else 200)
            self.end_headers()
            self.wfile.write(b"<html><title>T</title></html>")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    pages = web.fetch_pages(spark, [f"{at}/a", f"{at}/slow", f"{at}/none", "ftp://x"], 1.5).cache()
    errors = {r["path"]: r["error"] for r in pages.collect()}
    assert errors[f"{at}/a"] is None and all(errors[u] for u in (f"{at}/slow", f"{at}/none", "ftp://x"))
    web.save_snapshots(pages, str(tmp_path / "s"))
    assert [p.name for p in (tmp_path / "s").iterdir()] == [web.snapshot_name(f"{at}/a")]
    _, facts = content.from_rows(pages.where("error is null").selectExpr("ord as artifact_id", "path", "kind", "content"))
    assert "title[]=T" in {r["canonical"] for r in facts.collect()}
    server.shutdown()
    assert web.snapshot_name("https://a.b/c?d=1") == "a.b_c_d_1.html" and web.snapshot_name("http://") == "page.html"


def test_stream_equals_batch(spark, tmp_path):
    from factweave.sources.rows import text_facts
    from factweave.streaming.ingest import corpus_of, ingest

    rows = spark.createDataFrame([(i, f"p{i}", "text", 1, f"shared\nown {i}\nshared") for i in range(6)], "artifact_id long, path string, kind string, size long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, lambda b: text_facts(b, "artifact_id", "text"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    a = corpus_of(spark, str(tmp_path / "out"))
    b = Corpus(rows.drop("text"), text_facts(rows, "artifact_id", "text"))
    pick = lambda c: sorted(map(tuple, c.identities.select("canonical", "k", "occurrences", "bucket").collect()))
    assert pick(a) == pick(b)


def test_zero_fact_and_empty_corpora(spark):
    c = corpus(spark, [["a=1"], ["a=1"], []])
    assert {r["artifact_id"]: r["drift"] for r in c.stats.collect()} == {0: 0.0, 1: 0.0, 2: 1.0}
    empty = Corpus(c.artifacts.limit(0), c.facts.limit(0))
    assert empty.stats.count() == 0 and empty.summary.first()["core"] == 0


def test_global_rank(spark):
    from factweave.functions.order import global_rank

    rows = [(i * 7 % 101, f"k{i % 5}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(7)
    order = [F.desc("a"), F.col("b"), F.col("c")]
    want = {c: n for n, (_, _, c) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1], r[2])))}
    assert {r["c"]: r["place"] for r in global_rank(df, order, "place").collect()} == want
    assert global_rank(df.limit(0), order, "place").count() == 0


def test_bounded_lists(spark):
    from factweave.operators import conflicts, consensus

    facts = spark.createDataFrame([(i, n, "kv", f"k={'a' if i % 4 else 'b'}", n) for i in range(60) for n in range(2)], "artifact_id long, ord int, kind string, canonical string, line int")
    index = {r["canonical"]: r for r in consensus.occurrence_index(facts, 5).collect()}
    assert index["k=a"]["total"] == 90 and [(x["artifact_id"], x["line"]) for x in index["k=a"]["occurrences"]] == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    assert [r["artifact_id"] for r in consensus.occurrences(facts).where("canonical = 'k=b'").collect()] == [i for i in range(0, 60, 4) for _ in range(2)]
    few = {r["value"]: r for r in conflicts.first_holders(consensus.membership(facts), 3).collect()}
    assert (few["a"]["n"], few["a"]["rank"], few["a"]["artifacts"]) == (45, 1, [1, 2, 3]) and few["b"]["artifacts"] == [0, 4, 8]
    assert conflicts.value_holders(consensus.membership(facts)).count() == 60


def test_question_words():
    from factweave.plans.ask import question_words

    assert question_words("Why is configs/App.yaml different from Caf\u00c9.yaml?") == ["configs/app.yaml", "caf\u00c9.yaml"]
    assert question_words("which yaml is odd?") == ["odd"] and question_words("Compare the files: env, json...") == []


def test_page_host_ignores_case(spark):
    from factweave.operators.creds import page_host

    got = spark.createDataFrame([("HTTP://Bank/x",), ("https://a.b:80/",), ("ftp://x/",), ("c.html",)], "p string").select(page_host(F.col("p"))).collect()
    assert [r[0] for r in got] == ["bank", "a.b", None, None]


def test_tree_in_any_store(spark, tmp_path):
    from factweave.sources import files

    for name, body in {"a.json": b'{"k": 1}', "sub/b.env": b"x=1", "target/c.json": b'{"k": 2}', "node_modules/p/d.txt": b"no", "e.json": b"\0{}", "f.txt": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    artifacts, facts, skipped = files.spread(spark, str(tmp_path))
    assert sorted(r["path"].rpartition("/")[2] for r in artifacts.collect()) == ["a.json", "b.env"]
    assert sorted(r["canonical"] for r in facts.collect()) == ["k=1", "x=1"] and skipped.first()["n"] == 1


def test_reports_without_driver_loops(spark):
    from tests.inline import BINARIES, PAGES, inline

    c = inline(spark, PAGES)
    kits = report.kit_members(c).orderBy("rank").collect()
    assert [k["rank"] for k in kits] == list(range(len(kits))) and kits[0]["members"] == ["login", "login", "in"]
    assert report.kit_json(c).count('"members"') == len(kits) and "kit #0" in report.kit_text(c)
    text = report.yara(inline(spark, BINARIES))
    assert text.count("rule factweave_family_") == 2 and "members = 3" in text


def test_short_rows_are_dealt_before_they_are_composed_and_parsed(spark):
    """The tables are one file with one block of rows, which one task read and parsed."""
    from factweave.plans import catalogue, composed, format_queries
    from tests.oracle import DATA

    cores = spark.sparkContext.defaultParallelism
    rows = [format_queries._extracted(spark, DATA, "part", "p_partkey", "yaml", "p_name"), format_queries._by_sql(spark, DATA, "part", "p_partkey", "yaml", "p_name"), composed.pages(spark, DATA).facts, composed.binaries(spark, DATA).facts, catalogue.parts(spark, DATA).facts]
    for df in rows:
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > cores


def test_forms_alone_write_no_membership(spark):
    from tests.inline import PAGES, inline

    c, whole = inline(spark, PAGES), inline(spark, PAGES)
    c.reused = whole.reused = True
    whole.members
    forms = lambda x: sorted(x.credential_forms.collect(), key=lambda r: r["artifact_id"])
    assert forms(c) == forms(whole) and len(forms(c)) == 8 and not c.written


def test_contents_are_composed_after_the_deal(spark):
    """F3, F6, F8, F11: the filter on contents went below the deal, so one task a block composed every file several times."""
    from factweave.plans import composed
    from tests.oracle import DATA

    for c in (composed.pages(spark, DATA), composed.binaries(spark, DATA)):
        for df in (c.facts, c.artifacts, c.artifacts.groupBy().count()):
            above, below = df._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
            assert ("<html>" in above or "7F454C46" in above.upper()) and "<html>" not in below and "7F454C46" not in below.upper()
            assert above.count("<html>") + above.upper().count("7F454C46") == 1  # composed once a row


def test_routed_contents_are_the_artifacts(spark):
    from factweave.plans.corpus import Corpus

    bodies = [b"a", b"", None, b"a\0b", b"x" * 8192 + b"\0", b"x" * 8191 + b"\0", "\u00e9".encode() * 4096 + b"\0"]
    rows = [(i * 10 + k, f"p{i}", kind, b) for i, b in enumerate(bodies) for k, kind in enumerate(["text", "json", "binary", "html", None])]
    c = Corpus.from_rows(spark.createDataFrame(rows, "artifact_id long, path string, kind string, content binary"))
    from factweave.sources.content import routed_kind

    want = {(a, p, r, len(b)) for a, p, k, b in rows if (r := routed_kind(k, b)) is not None}
    assert {tuple(r) for r in c.artifacts.collect()} == want
    pages = {a for a, _, r, _ in want if r == "html"}  # without facts
    assert {r["artifact_id"] for r in c.facts.select("artifact_id").distinct().collect()} == {a for a, *_ in want} - pages


def test_forms_are_read_without_other_facts(spark):
    """F3, F8, F10: the whole page was read, digested and shuffled for the facts of its forms."""
    from factweave.functions import formats
    from factweave.plans import composed
    from tests.oracle import DATA

    c, whole = composed.pages(spark, DATA), composed.pages(spark, DATA)
    kinds = {r["p"] for r in c.forms.selectExpr("substring_index(canonical, '[]=', 1) AS p").distinct().collect()}
    assert kinds == {"field", "formhost"}
    whole.members
    forms = lambda x: sorted(x.credential_forms.collect(), key=lambda r: r["artifact_id"])
    assert forms(c) == forms(whole) and not c.written
    odd = [b"<form action=//h/x><input name=a><input name=A></form><input type=password><form><form><textarea></form></form><form/action='http://B' ><select id=x><!-- <form> -->", b"<script><form></script><input name=q>", b'{"field": ["pass"], "formhost": ["h"]}', b"\xff<form><input type=password name=", b"<form action=x><input name=n/>" * 5000]
    for kind in ("html", "text", "json", "binary"):
        for body in odd:
            want = [f for f in formats.extract(kind, body) if f[0] == "kv" and f[1].startswith(formats.FORM_FACTS)]
            assert formats.form_facts(kind, body) == want


def test_a_result_of_factions_is_computed_alone(spark):
    """labels, numbers and signatures were all written for whoever asked for one of them."""
    df = spark.createDataFrame([(i, f"all\npair {i // 2}\nown {i}") for i in range(12)], "id long, text string")
    for result, others in (("faction_labels", {"faction_table", "faction_signature"}), ("atoms", {"faction_signature"}), ("kits", {"faction_signature"}), ("faction_signature", {"faction_table"})):
        c = Corpus.from_lines(df, "id", "text")
        getattr(c, result).count()
        assert not others & c.__dict__.keys() and "faction_labels" in c.__dict__
    labels, table, signature = c.factions
    assert labels.count() == 12 and table.count() == 6 == signature.where("canonical like 'pair%'").count()
