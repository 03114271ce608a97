"""Registered queries over the driver's tables, each with its SQL for comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.graph import shared_dir
from factweave.functions.order import global_rank
from factweave.operators import conflicts, consensus, creds, factions, gate, postings, signatures
from factweave.operators.dictionary import dictionary, encoded
from factweave.plans import composed, format_queries, report
from factweave.plans.corpus import Corpus
from factweave.sources.content import dealt
from factweave.sources.rows import config_facts, markdown_facts, table_artifacts, table_facts, text_facts
from factweave.streaming.incremental import IncrementalConsensus, in_batches


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.from_lines(_read(spark, sf_dir, "documents"), "doc_id", "text")


def users(spark: SparkSession, sf_dir: str) -> Corpus:
    ev = _read(spark, sf_dir, "events")
    return Corpus(table_artifacts(ev, "user_id"), table_facts(ev, "user_id", {"event_type[]": "event_type", "props.k[]": F.get_json_object("props", "$.k")}))


def customers(spark: SparkSession, sf_dir: str) -> Corpus:
    o = _read(spark, sf_dir, "orders")
    return Corpus(table_artifacts(o, "o_custkey"), table_facts(o, "o_custkey", {"status[]": "o_orderstatus", "priority[]": "o_orderpriority"}))


def orders(spark: SparkSession, sf_dir: str) -> Corpus:
    li = _read(spark, sf_dir, "lineitem")
    return Corpus(table_artifacts(li, "l_orderkey"), table_facts(li, "l_orderkey", {"returnflag[]": "l_returnflag", "linestatus[]": "l_linestatus", "qty[]": F.col("l_quantity").cast("int")}))


def parts(spark: SparkSession, sf_dir: str) -> Corpus:
    p = dealt(_read(spark, sf_dir, "part"), "p_partkey")
    return Corpus(table_artifacts(p, "p_partkey"), table_facts(p, "p_partkey", {"brand": "p_brand", "type": "p_type", "size": "p_size"}))


def nations(spark: SparkSession, sf_dir: str) -> Corpus:
    c = _read(spark, sf_dir, "customer")
    return Corpus(table_artifacts(c, "c_nationkey"), table_facts(c, "c_nationkey", {"segment[]": "c_mktsegment", "balance": F.when(F.col("c_acctbal") < 0, "negative").otherwise("positive")}))


#: SQL of the same facts: ``f(a, kind, c)`` and ``arts(a)``.
_FACTS = {
    "documents": r"""arts AS (SELECT DISTINCT doc_id AS a FROM documents),
f AS (SELECT a, 'line' AS kind, t AS c, ln FROM (SELECT doc_id AS a, unnest(range(1, len(l) + 1)) AS ln, regexp_replace(unnest(l), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE t <> '')""",
    "users": """arts AS (SELECT DISTINCT user_id AS a FROM events),
f AS (SELECT user_id AS a, 'kv' AS kind, 'event_type[]=' || event_type AS c FROM events UNION ALL SELECT user_id, 'kv', 'props.k[]=' || json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)""",
    "customers": """arts AS (SELECT DISTINCT o_custkey AS a FROM orders),
f AS (SELECT o_custkey AS a, 'kv' AS kind, 'status[]=' || o_orderstatus AS c FROM orders UNION ALL SELECT o_custkey, 'kv', 'priority[]=' || o_orderpriority FROM orders)""",
    "orders": """arts AS (SELECT DISTINCT l_orderkey AS a FROM lineitem),
f AS (SELECT l_orderkey AS a, 'kv' AS kind, 'returnflag[]=' || l_returnflag AS c FROM lineitem UNION ALL SELECT l_orderkey, 'kv', 'linestatus[]=' || l_linestatus FROM lineitem UNION ALL SELECT l_orderkey, 'kv', 'qty[]=' || CAST(CAST(l_quantity AS INT) AS VARCHAR) FROM lineitem)""",
    "parts": """arts AS (SELECT DISTINCT p_partkey AS a FROM part),
f AS (SELECT p_partkey AS a, 'kv' AS kind, 'brand=' || p_brand AS c FROM part UNION ALL SELECT p_partkey, 'kv', 'type=' || p_type FROM part UNION ALL SELECT p_partkey, 'kv', 'size=' || CAST(p_size AS VARCHAR) FROM part)""",
    "nations": """arts AS (SELECT DISTINCT c_nationkey AS a FROM customer),
f AS (SELECT c_nationkey AS a, 'kv' AS kind, 'segment[]=' || c_mktsegment AS c FROM customer UNION ALL SELECT c_nationkey, 'kv', 'balance=' || CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END FROM customer)""",
}
_BASE = """,
nn AS (SELECT count(*) AS N FROM arts),
m AS (SELECT a, kind, c, count(*) AS nocc FROM f GROUP BY ALL),
ids AS (SELECT kind, c, count(*) AS k, sum(nocc) AS occurrences, min(a) AS holder,
  CASE WHEN count(*) = max(N) THEN 'universal' WHEN count(*) = 1 THEN 'unique' WHEN 2 * count(*) > max(N) THEN 'majority' ELSE 'minority' END AS bucket,
  2 * count(*) > max(N) AS is_core, count(*) = 1 AND max(N) > 1 AS is_unique FROM m, nn GROUP BY kind, c),
core AS (SELECT count(*) AS core FROM ids WHERE is_core),
st0 AS (SELECT m.a, count(*) AS total, count(*) FILTER (is_core) AS in_core, count(*) FILTER (is_unique) AS n_unique FROM m JOIN ids USING (kind, c) GROUP BY m.a),
st AS (SELECT arts.a AS artifact_id, coalesce(total, 0) AS total, coalesce(in_core, 0) AS in_core, coalesce(n_unique, 0) AS n_unique,
  CASE WHEN coalesce(total, 0) + core - coalesce(in_core, 0) = 0 THEN 0.0 ELSE 1 - CAST(coalesce(in_core, 0) AS DOUBLE) / (coalesce(total, 0) + core - coalesce(in_core, 0)) END AS drift
  FROM arts LEFT JOIN st0 ON st0.a = arts.a, core),
ag AS (SELECT count(*) AS n, avg(drift) AS mean, stddev_pop(drift) AS sd FROM st),
so AS (SELECT st.*, n >= 4 AND sd > 0.005 AND drift > mean + 1.5 * sd AS is_outlier FROM st, ag)"""
_PAIRS = """,
rare AS (SELECT m.a, m.kind, m.c FROM m JOIN ids USING (kind, c) WHERE bucket = 'minority' AND k <= 1024),
ms AS (SELECT a, count(*) AS m FROM rare GROUP BY a),
pr AS (SELECT x.a AS a, y.a AS b, count(*) AS shared FROM rare x JOIN rare y ON x.kind = y.kind AND x.c = y.c AND x.a < y.a GROUP BY x.a, y.a)"""
_EDGES = _PAIRS + """,
ed AS (SELECT pr.a, pr.b, CAST(shared AS DOUBLE) / (p.m + q.m - shared) AS sim FROM pr JOIN ms p ON p.a = pr.a JOIN ms q ON q.a = pr.b WHERE 2 * shared >= p.m + q.m - shared)"""
_LABELS = _EDGES + """,
un AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach(root, v) AS (SELECT a, a FROM un UNION SELECT reach.root, un.b FROM reach JOIN un ON un.a = reach.v),
lab AS (SELECT v AS a, min(root) AS root FROM reach GROUP BY v)"""
_CONFLICTS = """,
kv AS (SELECT DISTINCT a, substr(c, 1, instr(c, '=') - 1) AS key, substr(c, instr(c, '=') + 1) AS value FROM m WHERE kind = 'kv' AND instr(c, '=') > 0 AND NOT ends_with(substr(c, 1, instr(c, '=') - 1), '[]')),
vg0 AS (SELECT key, value, count(*) AS n FROM kv GROUP BY ALL),
dis AS (SELECT key FROM vg0 GROUP BY key HAVING count(*) >= 2 AND max(n) >= 2),
vg AS (SELECT key, value, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS rank FROM vg0 WHERE key IN (SELECT key FROM dis)),
cf AS (SELECT key, count(DISTINCT value) AS n_values, min(value) FILTER (rank = 1) AS plurality, count(DISTINCT a) AS holders, count(DISTINCT a) FILTER (rank > 1) AS deviants FROM kv JOIN vg USING (key, value) GROUP BY key)"""


def _sql(corpus: str, select: str, more: str = "", recursive: bool = False) -> str:
    """``select`` may open with further CTEs after a leading comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{_FACTS[corpus]}{_BASE}{more}{select if select.startswith(',') else chr(10) + select}"


#: Customers as artifacts: one key a nation, most with its usual segment.
_FACTS["pairs"] = """arts AS (SELECT DISTINCT c_custkey AS a FROM customer),
f AS (SELECT c_custkey AS a, 'kv' AS kind, 'n' || c_nationkey || '.segment=' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'USUAL' END AS c FROM customer)"""


def _lines_as_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    value = F.concat(F.lit("n"), "c_nationkey", F.lit(".segment="), F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'USUAL' END"))
    return c.select(F.col("c_custkey").alias("artifact_id"), F.lit("kv").alias("kind"), value.alias("canonical"))


_FACTS["pages"], _FACTS["binaries"] = composed.PAGES_SQL, composed.BINARIES_SQL
_SIGNATURES = _LABELS + """,
fs AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS faction_id FROM lab GROUP BY root),
ex AS (SELECT lab.root, m.kind, m.c, fs.faction_id, fs.size FROM m JOIN lab ON lab.a = m.a JOIN fs ON fs.root = lab.root JOIN ids ON ids.kind = m.kind AND ids.c = m.c GROUP BY lab.root, m.kind, m.c, fs.faction_id, fs.size, ids.k HAVING count(*) = fs.size AND ids.k = fs.size)"""
_CREDS = """,
fl AS (SELECT a, ord, CASE WHEN starts_with(c, 'field[]=') THEN substr(c, 9) END AS field, CASE WHEN starts_with(c, 'formhost[]=') THEN substr(c, 12) END AS host FROM f),
cl AS (SELECT *, CASE WHEN regexp_matches(field, 'PASSWORD_WORDS') THEN 'password' WHEN regexp_matches(field, 'SENSITIVE_WORDS') THEN 'sensitive' END AS class FROM fl),
cp AS (SELECT a, array_to_string(list_sort(list_distinct(list(field) FILTER (class IS NOT NULL))), ',') AS fields, arg_min(host, ord) FILTER (host IS NOT NULL) AS action_host FROM cl GROUP BY a
  HAVING count(DISTINCT field) FILTER (class = 'password') > 0 OR count(DISTINCT field) FILTER (class = 'sensitive') >= 2),
ff AS (SELECT a AS artifact_id, fields, action_host, action_host IS NOT NULL AND regexp_matches(path, '^(?i:https?)://[^/?#:]') AND lower(regexp_extract(path, '^(?i:https?)://([^/?#:]+)', 1)) <> lower(action_host) AS off_domain FROM cp JOIN arts USING (a))"""

for _name in ("PASSWORD_WORDS", "SENSITIVE_WORDS"):
    _CREDS = _CREDS.replace(_name, "|".join(getattr(creds, _name)))


def _stats(c: Corpus) -> DataFrame:
    return c.stats.select("artifact_id", "total", "in_core", "n_unique", F.round("drift", 9).alias("drift"), "is_outlier")


def _ids(c: Corpus) -> DataFrame:
    return c.identities.select("kind", "canonical", "k", "occurrences", "bucket", "is_core", "is_unique")


def _rare(c: Corpus) -> DataFrame:
    c.reused = True  # read for the dictionary and again with it
    return encoded(c.members, factions.distinctive(c.identities))


def _forms(c: Corpus) -> DataFrame:
    return c.credential_forms.select("artifact_id", F.array_join("fields", ",").alias("fields"), "action_host", "off_domain")


def _ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = composed.pages(spark, sf_dir)
    labels = c.faction_labels  # first, so that the forms are read from the membership that they write
    return creds.ungrouped_forms(_forms(c), labels)


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, p = users(spark, sf_dir), parts(spark, sf_dir)
    row = gate.metrics(p.conflicts, u.stats, composed.pages(spark, sf_dir).credential_forms)
    return gate.evaluate(row, gate.parse("conflicts, outliers>1000, drift>0.5, credential-forms>3")).withColumn("observed", F.round("observed", 9))


def _most_drifted(c: Corpus) -> int:
    return consensus.drift_ranking(c.stats, 1).first()["artifact_id"]


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = users(spark, sf_dir)
    return consensus.missing_core(_most_drifted(c), c.members, c.identities, None)


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_lines(spark, sf_dir)
    return consensus.unique_evidence(c.stats.drop("is_outlier"), c.identities).select("artifact_id", "rank", "kind", "canonical")


def _focus(spark: SparkSession, sf_dir: str, question: str = "what about the example.net pages in de?") -> DataFrame:
    from factweave.plans.ask import focus_by_words

    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("artifact_id"), F.col("url").alias("path"))
    return focus_by_words(pages, question).select("artifact_id", "path")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_lines(spark, sf_dir)
    return consensus.occurrence_index(c.facts, 16).select("kind", "canonical", "total", F.array_join(F.transform("occurrences", lambda x: F.concat_ws(":", x["artifact_id"], x["line"])), ",").alias("occurrences"))


def _json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.sources.content import extract_rows

    ev = _read(spark, sf_dir, "events").select(F.col("event_id").alias("artifact_id"), F.lit("json").alias("kind"), F.encode("props", "UTF-8").alias("content"))
    return extract_rows(ev).select("artifact_id", "kind", "canonical")


def _page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.sources.content import extract_rows

    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("artifact_id"), F.lit("html").alias("kind"), F.encode("html", "UTF-8").alias("content"))
    return extract_rows(pages).where("canonical like 'title[]=%'").select("artifact_id", "canonical")


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"concat('# c\n[', n_name, ']\nport = ', n_nationkey, '\nhost: \'h', n_regionkey, '\'\nexport X=1\nplain\n\n[[t]]\nk=\n=v\n;x\n k2 : \"v=1\" \r\n')"
    rows = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.expr(text).alias("text"))
    return config_facts(rows, "id", "text").select("artifact_id", "kind", "canonical", "line")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_facts(_read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("## "), F.array_join(F.array_sort(F.collect_list("text")), "\n#")).alias("t")), "conv_id", "t").select("artifact_id", "kind", "canonical", "line")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.sources.generator import generated_corpus

    c = Corpus(*generated_corpus(spark, 2000, 40))
    return c.summary.select("artifacts", "observations", "identities", "core").crossJoin(F.broadcast(c.stats.agg(F.count_if("is_outlier").alias("outliers"), F.count_if(F.col("is_outlier") & F.col("path").contains("rogue")).alias("planted"))))


def _text(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Lines of a report with their places."""
    return spark.createDataFrame(list(enumerate(lines)), "position int, line string")


def _drift_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = report.text_report(users(spark, sf_dir), "drift", skipped=3).split("\n")
    return _text(spark, lines[: lines.index("", 2)] if "" in lines[2:] else lines)


def _lines(rows: DataFrame, *order: str) -> DataFrame:
    """Lines that tasks rendered, with their places in a global order."""
    return global_rank(rows, [F.col(o) for o in order], "position").select(F.col("position").cast("int").alias("position"), "line")


def _gate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = report.text_report(nations(spark, sf_dir), "consensus", gate_rows=_gate(spark, sf_dir).orderBy("position").collect()).split("\n")
    return _text(spark, lines[2:])


def _json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON report of the nations holds: sizes of its lists, and its numbers."""
    c = nations(spark, sf_dir)
    rows = report.json_figures(c, skipped=2).select(F.concat_ws(".", "part", "name").alias("entry"), F.round("value", 9).alias("value"))
    for name, df in report.json_sections(c).items():
        rows = rows.union(df.agg(F.lit(name), F.count("*").cast("double")))
    return rows


def _notes(spark: SparkSession, sf_dir: str) -> Corpus:
    """Customers as artifacts: one key a nation, a third of them with a value too long to show whole."""
    c = _read(spark, sf_dir, "customer")
    value = F.expr("concat('n', c_nationkey, '.note=', CASE WHEN c_custkey % 3 = 0 THEN concat(c_mktsegment, repeat('é', 30)) ELSE 'USUAL' END)")
    facts = c.select(F.col("c_custkey").alias("artifact_id"), F.lit(0).alias("ord"), F.lit("kv").alias("kind"), value.alias("canonical"), F.lit(0).alias("line"))
    return Corpus(table_artifacts(c, "c_custkey"), facts)


_FACTS["notes"] = """arts AS (SELECT DISTINCT c_custkey AS a FROM customer),
f AS (SELECT c_custkey AS a, 'kv' AS kind, 'n' || c_nationkey || '.note=' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || repeat('é', 30) ELSE 'USUAL' END AS c FROM customer)"""


def _ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for a question that names no artifact, without its factions."""
    from factweave.plans.ask import evidence

    lines = evidence(document_lines(spark, sf_dir), "Why are these different?").split("\n")
    return _text(spark, [x for x in lines if x and not x.startswith(("Faction ", "  shares "))])


def _planted(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files written by tasks from suppliers: three formats, hidden names, texts with a NUL, binaries."""
    from factweave.sources.tree import write_files

    kinds = [("'a', {k}, '.json'", "concat('{{\"k\": ', {k}, '}}')"), ("'b', {k}, '.yaml'", "concat('k: ', {k})"), ("'c', {k}, '.conf'", "concat('[s]\\nk=', {k})"), ("'.d', {k}, '.json'", "'1'"), ("'e', {k}, '.json'", "concat('a', chr(0), {k})"), ("'f', {k}, '.bin'", "concat('n', {k})")]
    case = lambda n: "CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN {('concat(' + x[0] + ')') if n == 0 else x[1]}" for i, x in enumerate(kinds)).format(k="s_suppkey") + " END"
    rows = _read(spark, sf_dir, "supplier").select(F.expr(case(0)).alias("name"), F.expr(case(1)).cast("binary").alias("content"))
    folder = f"{shared_dir(spark)}/factweave-files-{uuid.uuid4().hex}"
    write_files(rows.repartition(4), folder)
    return folder.removeprefix("file://")


def _tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.sources.tree import tree

    return tree(spark, [_planted(spark, sf_dir)]).select(F.substring_index("path", "/", -1).alias("name"), "kind", "size")


def _tree_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the planted files; ids are dense, so the largest is one less than the files kept."""
    from factweave.sources.files import from_paths

    artifacts, facts, skipped = from_paths(spark, [_planted(spark, sf_dir)])
    named = facts.where("canonical not like 'binary.%' and kind = 'kv'").join(artifacts.select("artifact_id", F.substring_index("path", "/", -1).alias("name"), F.col("kind").alias("file_kind")), "artifact_id")
    ids = artifacts.agg((F.max("artifact_id") + 1).alias("kept"))
    return named.crossJoin(F.broadcast(ids)).select("name", "file_kind", "canonical", "line", "kept", F.lit(skipped).cast("long").alias("skipped"))


def _incremental(spark: SparkSession, sf_dir: str) -> IncrementalConsensus:
    """Documents fed in four batches that share most of their artifacts."""
    c = document_lines(spark, sf_dir)
    return in_batches(IncrementalConsensus(spark, f"{shared_dir(spark)}/factweave-state-{uuid.uuid4().hex}", compact=2), c.artifacts, c.facts, 4)


QUERIES = {
    "line_primitives": lambda s, d: text_facts(_read(s, d, "documents"), "doc_id", "text").select("artifact_id", "kind", "canonical", "line"),
    "markdown_primitives": _markdown,
    "config_primitives": _config,
    "identity_stats": lambda s, d: _ids(document_lines(s, d)),
    "identity_stats_nations": lambda s, d: _ids(nations(s, d)),
    "bucket_counts": lambda s, d: consensus.bucket_counts(users(s, d).identities),
    "consensus_core": lambda s, d: customers(s, d).identities.where("is_core").select("kind", "canonical", "k"),
    "artifact_drift": lambda s, d: _stats(users(s, d)),
    "artifact_drift_nations": lambda s, d: _stats(nations(s, d)),
    "corpus_summary": lambda s, d: (lambda t: t.select("artifacts", "observations", "identities", "core", F.round("mean_drift", 9).alias("mean_drift"), F.round("sd_drift", 9).alias("sd_drift")))(users(s, d).summary),
    "outliers": lambda s, d: orders(s, d).stats.where("is_outlier").select("artifact_id", F.round("drift", 9).alias("drift")),
    "outliers_customers": lambda s, d: customers(s, d).stats.where("is_outlier").select("artifact_id", F.round("drift", 9).alias("drift")),
    "drift_ranking": lambda s, d: consensus.drift_ranking(users(s, d).stats, 30).select("artifact_id", F.round("drift", 9).alias("drift")),
    "unique_evidence": _unique,
    "occurrence_index": _occurrences,
    "occurrences": lambda s, d: consensus.occurrences(document_lines(s, d).facts).select("kind", "canonical", "artifact_id", "line"),
    "posting_occurrences": lambda s, d: postings.posting_rows(postings.posting_blocks(document_lines(s, d).facts)).select("kind", "canonical", "artifact_id", "line"),
    "posting_totals": lambda s, d: postings.posting_blocks(users(s, d).facts).groupBy("kind", "canonical").agg(F.sum("n").alias("total"), F.min("first_artifact").alias("first"), F.max("last_artifact").alias("last")),
    "dictionary": lambda s, d: dictionary(document_lines(s, d).identities),
    "incremental_identities": lambda s, d: _incremental(s, d).identities.select("kind", "canonical", "k", "occurrences", "bucket", "is_core", "is_unique"),
    "incremental_drift": lambda s, d: _incremental(s, d).stats.select("artifact_id", "total", "in_core", "n_unique", F.round("drift", 9).alias("drift"), "is_outlier"),
    "bucket_rollup": lambda s, d: consensus.bucket_rollup(users(s, d).identities.unionByName(document_lines(s, d).identities)),
    "conflicts": lambda s, d: conflicts.conflicts(parts(s, d).members),
    "conflict_values": lambda s, d: conflicts.value_groups(parts(s, d).members),
    "conflict_holders": lambda s, d: conflicts.value_holders(parts(s, d).members),
    "conflict_first_holders": lambda s, d: conflicts.first_holders(parts(s, d).members, 8).select("key", "value", "rank", "n", F.array_join(F.col("artifacts").cast("array<string>"), ",").alias("artifacts")),
    "conflicts_nations": lambda s, d: conflicts.by_clarity(conflicts.conflicts(nations(s, d).members)),
    "conflicts_reading_order": lambda s, d: global_rank(conflicts.conflicts(_lines_as_pairs(s, d)), [F.col("deviants"), F.desc("holders"), F.col("key")], "position"),
    "conflicts_key_order": lambda s, d: global_rank(conflicts.conflicts(_lines_as_pairs(s, d)), [F.col("key")], "position"),
    "drift_positions": lambda s, d: global_rank(users(s, d).stats.select("artifact_id", F.round("drift", 9).alias("drift")), [F.desc("drift"), F.col("artifact_id")], "position"),
    "keys_only_stats": lambda s, d: _ids(parts(s, d).keys_only()),
    "minority_pairs": lambda s, d: factions.minority_pairs(_rare(document_lines(s, d))),
    "similarity_edges": lambda s, d: factions.similarity_edges(_rare(document_lines(s, d))).select("a", "b", F.round("similarity", 9).alias("similarity")),
    "similarity_edges_orders": lambda s, d: factions.similarity_edges(_rare(orders(s, d))).select("a", "b", F.round("similarity", 9).alias("similarity")),
    "faction_members": lambda s, d: document_lines(s, d).faction_labels,
    "faction_signature": lambda s, d: document_lines(s, d).faction_signature,
    "faction_cohesion": lambda s, d: document_lines(s, d).faction_table.select("faction_id", "root", "size", F.round("cohesion", 9).alias("cohesion")),
    "family_core": lambda s, d: document_lines(s, d).exclusive,
    "kit_signatures": lambda s, d: (lambda k: k.select("faction_id", "size", "functional", "shape_count", "rank", *[(F.size(c).cast("long") if c == "field_sets" else F.array_join(c, ",")).alias(c) for c in dict.fromkeys(signatures.KIT_LISTS.values())]))(composed.pages(s, d).kits),
    "yara_atoms": lambda s, d: composed.binaries(s, d).atoms.where("atom <> 'chunk'"),
    "credential_forms": lambda s, d: _forms(composed.pages(s, d)),
    "ungrouped_forms": _ungrouped,
    "gate_eval": _gate,
    "missing_core": _missing,
    "report_drift_text": _drift_text,
    "report_conflicts_text": lambda s, d: _lines(report.conflict_lines(parts(s, d)), "place", "at"),
    "report_factions_text": lambda s, d: _text(s, report.text_report(document_lines(s, d), "factions").split("\n")[3:]),
    "report_gate_text": _gate_text,
    "report_conflicts_long": lambda s, d: _lines(report.conflict_lines(_notes(s, d)), "place", "at"),
    "report_forms_text": lambda s, d: _lines(report.form_lines(composed.pages(s, d)), "artifact_id"),
    "ask_evidence": _ask,
    "tree_listing": _tree_listing,
    "tree_facts": _tree_facts,
    "report_json_counts": _json_counts,
    "report_yara_text": lambda s, d: report.yara_rules(composed.binaries(s, d)).select(F.col("place").cast("int").alias("position"), F.col("rule").alias("line")),
    "report_kit_text": lambda s, d: _lines(report.kit_lines(composed.pages(s, d)).where("at = 0"), "part", "place"),
    "ask_focus": _focus,
    "ask_focus_path": lambda s, d: _focus(s, d, "Why does EXAMPLE.NET/de/8 differ from the other yaml files?"),
    "ask_focus_none": lambda s, d: _focus(s, d, "Which yaml file is different? is it md, or json..."),
    "json_props": _json_props,
    "page_titles": _page_titles,
    "generated_corpus": _generated,
} | format_queries.QUERIES

_IDS = "SELECT kind, c AS canonical, k, CAST(occurrences AS BIGINT) AS occurrences, bucket, is_core, is_unique FROM ids"
_STATS = "SELECT artifact_id, total, in_core, n_unique, round(drift, 9) AS drift, is_outlier FROM so"
ORACLE_SQL = {
    "line_primitives": _sql("documents", "SELECT a AS artifact_id, kind, c AS canonical, CAST(ln AS INT) AS line FROM f"),
    "markdown_primitives": r"""WITH t AS (SELECT conv_id, '## ' || array_to_string(list_sort(list(text)), chr(10) || '#') AS t FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line, regexp_replace(unnest(string_split(t, chr(10))), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS x FROM t),
h AS (SELECT *, regexp_extract(x, '(?s)^(#{1,6})([^#].*)$', 1) AS hashes, regexp_replace(regexp_extract(x, '(?s)^(#{1,6})([^#].*)$', 2), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS rest FROM l WHERE x <> '')
SELECT conv_id AS artifact_id, CASE WHEN rest <> '' THEN 'heading' ELSE 'line' END AS kind, CASE WHEN rest <> '' THEN 'h' || length(hashes) || ':' || rest ELSE x END AS canonical, CAST(line AS INT) AS line FROM h""",
    "config_primitives": """SELECT n_nationkey AS artifact_id, unnest(['kv', 'kv', 'kv', 'line', 'kv', 'kv']) AS kind,
  unnest([n_name || '.port=' || n_nationkey, n_name || '.host=h' || n_regionkey, n_name || '.X=1', 'plain', '[t].k=', '[t].k2=v=1']) AS canonical, CAST(unnest([3, 4, 5, 6, 9, 12]) AS INT) AS line FROM nation""",
    "identity_stats": _sql("documents", _IDS),
    "identity_stats_nations": _sql("nations", _IDS),
    "bucket_counts": _sql("users", "SELECT b.bucket, count(ids.k) AS n FROM (VALUES ('universal'), ('majority'), ('minority'), ('unique')) b(bucket) LEFT JOIN ids ON ids.bucket = b.bucket GROUP BY b.bucket"),
    "consensus_core": _sql("customers", "SELECT kind, c AS canonical, k FROM ids WHERE is_core"),
    "artifact_drift": _sql("users", _STATS),
    "artifact_drift_nations": _sql("nations", _STATS),
    "corpus_summary": _sql("users", "SELECT nn.N AS artifacts, (SELECT count(*) FROM f) AS observations, (SELECT count(*) FROM ids) AS identities, core, round(mean, 9) AS mean_drift, round(sd, 9) AS sd_drift FROM nn, core, ag"),
    "outliers": _sql("orders", "SELECT artifact_id, round(drift, 9) AS drift FROM so WHERE is_outlier"),
    "outliers_customers": _sql("customers", "SELECT artifact_id, round(drift, 9) AS drift FROM so WHERE is_outlier"),
    "drift_ranking": _sql("users", "SELECT artifact_id, round(drift, 9) AS drift FROM st ORDER BY st.drift DESC, artifact_id LIMIT 30"),
    "unique_evidence": _sql("documents", """, tp AS (SELECT * FROM so WHERE n_unique > 0 AND (is_outlier OR NOT (SELECT max(is_outlier) FROM so)) ORDER BY drift DESC, artifact_id LIMIT 3)
SELECT artifact_id, rank, kind, canonical FROM (SELECT tp.artifact_id, row_number() OVER (PARTITION BY tp.artifact_id ORDER BY c, kind) AS rank, kind, c AS canonical FROM ids JOIN tp ON tp.artifact_id = ids.holder WHERE is_unique) WHERE rank <= 5"""),
    "occurrence_index": _sql("documents", """SELECT kind, c AS canonical, count(*) AS total, string_agg(a || ':' || ln, ',' ORDER BY a, ln) FILTER (nth <= 16) AS occurrences
FROM (SELECT *, row_number() OVER (PARTITION BY kind, c ORDER BY a, ln) AS nth FROM f) GROUP BY kind, c"""),
    "occurrences": _sql("documents", "SELECT kind, c AS canonical, a AS artifact_id, CAST(ln AS INT) AS line FROM f"),
    "posting_occurrences": _sql("documents", "SELECT kind, c AS canonical, a AS artifact_id, CAST(ln AS INT) AS line FROM f"),
    "posting_totals": _sql("users", "SELECT kind, c AS canonical, count(*) AS total, min(a) AS first, max(a) AS last FROM f GROUP BY kind, c"),
    "dictionary": _sql("documents", "SELECT kind, c AS canonical, row_number() OVER (ORDER BY c, kind) - 1 AS identity FROM ids"),
    "incremental_identities": _sql("documents", _IDS),
    "incremental_drift": _sql("documents", _STATS),
    "bucket_rollup": f"""WITH x AS ({_sql("users", _IDS)} UNION ALL SELECT * FROM ({_sql("documents", _IDS)}))
SELECT kind, bucket, count(*) AS identities, CAST(sum(k) AS BIGINT) AS holders, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM x GROUP BY GROUPING SETS ((kind, bucket), (kind), (bucket), ())""",
    "conflicts": _sql("parts", "SELECT * FROM cf", _CONFLICTS),
    "conflict_values": _sql("parts", "SELECT * FROM vg", _CONFLICTS),
    "conflict_holders": _sql("parts", "SELECT key, value, rank, n, a AS artifact_id FROM kv JOIN vg USING (key, value)", _CONFLICTS),
    "conflict_first_holders": _sql("parts", """SELECT key, value, rank, n, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS artifacts FROM (
  SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY a) AS nth FROM kv JOIN vg USING (key, value)) WHERE nth <= 8 GROUP BY ALL""", _CONFLICTS),
    "conflicts_nations": _sql("nations", "SELECT * FROM cf", _CONFLICTS),
    "conflicts_reading_order": _sql("pairs", "SELECT *, row_number() OVER (ORDER BY deviants, holders DESC, key) - 1 AS position FROM cf", _CONFLICTS),
    "conflicts_key_order": _sql("pairs", "SELECT *, row_number() OVER (ORDER BY key) - 1 AS position FROM cf", _CONFLICTS),
    "drift_positions": _sql("users", "SELECT artifact_id, round(drift, 9) AS drift, row_number() OVER (ORDER BY round(drift, 9) DESC, artifact_id) - 1 AS position FROM st"),
    "keys_only_stats": _sql("parts", _IDS).replace("f AS (SELECT p_partkey", "f0 AS (SELECT p_partkey", 1).replace(",\nnn AS", ",\nf AS (SELECT a, kind, split_part(c, '=', 1) AS c FROM f0),\nnn AS", 1),
    "minority_pairs": _sql("documents", "SELECT a, b, shared FROM pr", _PAIRS),
    "similarity_edges": _sql("documents", "SELECT a, b, round(sim, 9) AS similarity FROM ed", _EDGES),
    "similarity_edges_orders": _sql("orders", "SELECT a, b, round(sim, 9) AS similarity FROM ed", _EDGES),
    "faction_members": _sql("documents", "SELECT a AS artifact_id, root FROM lab", _LABELS, True),
    "faction_signature": _sql("documents", """, pc AS (SELECT root, kind, c, count(*) AS present FROM rare JOIN lab ON lab.a = rare.a GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM (SELECT root, row_number() OVER (PARTITION BY root ORDER BY present DESC, c, kind) AS rank, kind, c AS canonical, present FROM pc) WHERE rank <= 8""", _LABELS, True),
    "faction_cohesion": _sql("documents", "SELECT row_number() OVER (ORDER BY size DESC, root) - 1 AS faction_id, root, size, cohesion FROM (SELECT lab.root, count(DISTINCT lab.a) AS size, round(coalesce(max(co), 0), 9) AS cohesion FROM lab LEFT JOIN (SELECT root, avg(sim) AS co FROM ed JOIN lab ON lab.a = ed.a GROUP BY root) e ON e.root = lab.root GROUP BY lab.root)", _LABELS, True),
    "family_core": _sql("documents", "SELECT root, kind, c AS canonical FROM ex", _SIGNATURES, True),
    "kit_signatures": _sql("pages", """, kr AS (SELECT root, faction_id, size, split_part(c, '[]=', 1) AS p, substr(c, instr(c, '[]=') + 3) AS v FROM ex),
kk AS (SELECT faction_id, size, count(*) FILTER (p IN ('field', 'formfields', 'formaction', 'resource')) > 0 AS functional, count(*) FILTER (p = 'shape') AS shape_count,
  coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (p = 'field'), '') AS fields, count(DISTINCT v) FILTER (p = 'formfields') AS field_sets,
  coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (p = 'formaction'), '') AS actions, coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (p = 'resource'), '') AS resources,
  coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (p = 'path'), '') AS paths, coalesce(string_agg(DISTINCT v, ',' ORDER BY v) FILTER (p IN ('title', 'heading', 'meta')), '') AS brand FROM kr GROUP BY faction_id, size)
SELECT *, row_number() OVER (ORDER BY functional DESC, size DESC, faction_id) - 1 AS rank FROM kk""", _SIGNATURES, True),
    "yara_atoms": _sql("binaries", """, ar AS (SELECT faction_id, list_position(['imports', 'needs', 'exports', 'strings', 'sections'], split_part(c, '[]=', 1)) AS w, substr(c, instr(c, '[]=') + 3) AS text FROM ex WHERE instr(c, '[]=') > 0)
SELECT * FROM (SELECT faction_id, row_number() OVER (PARTITION BY faction_id ORDER BY w, text) AS rank, ['import', 'needs', 'export', 'string', 'section'][w] AS atom, text FROM ar WHERE w IS NOT NULL AND w > 0) WHERE rank <= 24""", _SIGNATURES, True),
    "credential_forms": _sql("pages", "SELECT * FROM ff", _CREDS),
    "ungrouped_forms": _sql("pages", "SELECT * FROM ff WHERE artifact_id NOT IN (SELECT a FROM lab)", _LABELS + _CREDS, True),
    "gate_eval": _sql("users", f""", o1 AS (SELECT count(*) FILTER (is_outlier) AS outliers, max(drift) AS drift FROM so),
o2 AS (SELECT count(*) AS n FROM (WITH {_FACTS['parts']}, m AS (SELECT DISTINCT a, kind, c FROM f){_CONFLICTS} SELECT * FROM cf)),
o3 AS (SELECT count(*) AS n FROM (WITH {_FACTS['pages']}{_CREDS} SELECT * FROM ff))
SELECT position, metric, threshold, round(observed, 9) AS observed, observed > threshold AS tripped FROM (
  SELECT 0 AS position, 'conflicts' AS metric, CAST(0 AS DOUBLE) AS threshold, CAST(n AS DOUBLE) AS observed FROM o2 UNION ALL SELECT 1, 'outliers', 1000, outliers FROM o1
  UNION ALL SELECT 2, 'drift', 0.5, drift FROM o1 UNION ALL SELECT 3, 'credential-forms', 3, n FROM o3)"""),
    "missing_core": _sql("users", ", top AS (SELECT artifact_id FROM st ORDER BY drift DESC, artifact_id LIMIT 1)\nSELECT kind, c AS canonical, k FROM ids WHERE is_core AND NOT EXISTS (SELECT 1 FROM m, top WHERE m.a = top.artifact_id AND m.kind = ids.kind AND m.c = ids.c)"),
    "report_drift_text": _sql("users", """, dr AS (SELECT row_number() OVER (ORDER BY so.drift DESC, artifact_id) AS i, * FROM so)
SELECT CAST(p AS INT) AS position, line FROM (
  SELECT 0 AS p, N || ' artifacts, ' || (SELECT count(*) FROM f) || ' observations, ' || (SELECT count(*) FROM ids) || ' distinct facts, 3 skipped' AS line FROM nn UNION ALL SELECT 1, ''
  UNION ALL SELECT 2, 'Drift  mean ' || format('{:.4f}', mean) || '  deviation ' || format('{:.4f}', sd) FROM ag
  UNION ALL SELECT 2 + i, '  ' || format('{:.4f}', drift) || '  ' || artifact_id || CASE WHEN is_outlier THEN '  OUTLIER' ELSE '' END FROM dr WHERE i <= 30)"""),
    "report_conflicts_text": _sql("parts", """, hd AS (SELECT key, value, rank, n, a, row_number() OVER (PARTITION BY key, value ORDER BY a) AS nth FROM kv JOIN vg USING (key, value)),
sh AS (SELECT key, value, rank, n, string_agg(CAST(a AS VARCHAR), ', ' ORDER BY a) AS names FROM hd WHERE nth <= 8 AND rank <= 6 GROUP BY ALL),
od AS (SELECT *, row_number() OVER (ORDER BY deviants, holders DESC, key) AS o FROM cf)
SELECT CAST(row_number() OVER (ORDER BY o, r) - 1 AS INT) AS position, line FROM (
  SELECT o, 0 AS r, '  ' || key || '  ' || n_values || ' values, ' || holders || ' holders, ' || deviants || ' deviants' AS line FROM od
  UNION ALL SELECT o, rank, '    ' || format('{:>6}', n) || '  ' || value || CASE WHEN rank = 1 THEN '' ELSE '  ' || names END FROM sh JOIN od USING (key))""", _CONFLICTS),
    "report_factions_text": _sql("documents", """, fs AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS id FROM lab GROUP BY root),
co AS (SELECT root, avg(sim) AS co FROM ed JOIN lab ON lab.a = ed.a GROUP BY root),
nm AS (SELECT root, string_agg(CAST(a AS VARCHAR), ', ' ORDER BY a) AS names FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY a) AS nth FROM lab) WHERE nth <= 8 GROUP BY root),
pc AS (SELECT root, kind, c, count(*) AS present FROM rare JOIN lab ON lab.a = rare.a GROUP BY ALL HAVING count(*) >= 2),
sg AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY present DESC, c, kind) AS rank FROM pc)
SELECT CAST(row_number() OVER (ORDER BY id, r) - 1 AS INT) AS position, line FROM (
  SELECT id, 0 AS r, '  #' || id || '  ' || size || ' members  cohesion ' || format('{:.3f}', co) || '  ' || names AS line FROM fs JOIN co USING (root) JOIN nm USING (root) WHERE id < 10
  UNION ALL SELECT id, rank, '    ' || format('{:>4}', present) || '  ' || c FROM sg JOIN fs USING (root) WHERE id < 10 AND rank <= 5)""", _LABELS, True),
    "report_gate_text": "GATE_TEXT",
    "report_conflicts_long": _sql("notes", """, hd AS (SELECT key, value, rank, n, a, row_number() OVER (PARTITION BY key, value ORDER BY a) AS nth FROM kv JOIN vg USING (key, value)),
sh AS (SELECT key, value, rank, n, string_agg(CAST(a AS VARCHAR), ', ' ORDER BY a) AS names FROM hd WHERE nth <= 8 AND rank <= 6 GROUP BY ALL),
od AS (SELECT *, row_number() OVER (ORDER BY deviants, holders DESC, key) AS o FROM cf)
SELECT CAST(row_number() OVER (ORDER BY o, r) - 1 AS INT) AS position, line FROM (
  SELECT o, 0 AS r, '  ' || key || '  ' || n_values || ' values, ' || holders || ' holders, ' || deviants || ' deviants' AS line FROM od
  UNION ALL SELECT o, rank, '    ' || format('{:>6}', n) || '  ' || CASE WHEN value = 'USUAL' THEN value ELSE left(value, length(value) - 30 + (48 - (length(value) - 30)) // 2) END || CASE WHEN rank = 1 THEN '' ELSE '  ' || names END FROM sh JOIN od USING (key))""", _CONFLICTS),
    "report_forms_text": _sql("pages", """, ln AS (SELECT artifact_id, '  ' || path || '  ' || replace(fields, ',', ', ') || ' -> ' || coalesce(action_host, '-') || CASE WHEN off_domain THEN '  OFF-DOMAIN' ELSE '' END AS line FROM ff JOIN arts ON arts.a = artifact_id ORDER BY artifact_id LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY artifact_id) - 1 AS INT) AS position, line FROM ln""", _CREDS),
    "ask_evidence": _sql("documents", """, dr AS (SELECT *, row_number() OVER (ORDER BY drift DESC, artifact_id) AS i FROM so),
ch AS (SELECT * FROM dr WHERE CASE WHEN (SELECT max(is_outlier) FROM so) THEN is_outlier ELSE i = 1 END ORDER BY i LIMIT 4),
ow AS (SELECT ch.i, c, row_number() OVER (PARTITION BY ch.i ORDER BY first) AS r FROM ch JOIN (SELECT a, c, min(ln) AS first FROM f GROUP BY a, c) x ON x.a = ch.artifact_id JOIN ids USING (c) WHERE ids.is_unique),
mi AS (SELECT ch.i, ids.c, ids.k, row_number() OVER (PARTITION BY ch.i ORDER BY ids.c, ids.kind) AS r FROM ch, ids WHERE is_core AND NOT EXISTS (SELECT 1 FROM m WHERE m.a = ch.artifact_id AND m.c = ids.c)),
al AS (SELECT 0 AS p, 0 AS i, 0 AS r, 'Corpus: ' || N || ' artifacts, ' || (SELECT count(*) FROM f) || ' observations, ' || (SELECT count(*) FROM ids) || ' identities, ' || core || ' in the consensus core.' AS line FROM nn, core
  UNION ALL SELECT 1, 0, 0, 'Artifacts by drift:'
  UNION ALL SELECT 2, i, 0, '  ' || artifact_id || '  drift ' || format('{:.4f}', drift) || '  facts ' || total || '  unique ' || n_unique || CASE WHEN is_outlier THEN '  OUTLIER' ELSE '' END FROM dr WHERE i <= 30
  UNION ALL SELECT 3, i, 0, 'Focus: ' || artifact_id FROM ch UNION ALL SELECT 3, i, r, '  only here: ' || c FROM ow WHERE r <= 25 UNION ALL SELECT 3, i, 100 + r, '  missing: ' || c || ' (held by ' || k || ')' FROM mi WHERE r <= 25)
SELECT CAST(row_number() OVER (ORDER BY p, i, r) - 1 AS INT) AS position, line FROM al"""),
    "tree_listing": """SELECT ['a', 'b', 'c', 'd', 'e', 'f'][s_suppkey % 6 + 1] || s_suppkey || ['.json', '.yaml', '.conf', '', '.json', '.bin'][s_suppkey % 6 + 1] AS name, ['json', 'yaml', 'config', '', 'json', 'binary'][s_suppkey % 6 + 1] AS kind,
  length(CAST(s_suppkey AS VARCHAR)) + [7, 3, 6, 0, 2, 1][s_suppkey % 6 + 1] AS size FROM supplier WHERE s_suppkey % 6 <> 3""",
    "tree_facts": """WITH n AS (SELECT count(*) FILTER (s_suppkey % 6 NOT IN (3, 4)) AS kept, count(*) FILTER (s_suppkey % 6 = 4) AS skipped FROM supplier)
SELECT ['a', 'b', 'c'][s_suppkey % 6 + 1] || s_suppkey || ['.json', '.yaml', '.conf'][s_suppkey % 6 + 1] AS name, ['json', 'yaml', 'config'][s_suppkey % 6 + 1] AS file_kind, CASE WHEN s_suppkey % 6 = 2 THEN 's.' ELSE '' END || 'k=' || s_suppkey AS canonical,
  CAST([0, 1, 2][s_suppkey % 6 + 1] AS INT) AS line, kept, skipped FROM supplier, n WHERE s_suppkey % 6 < 3
UNION ALL SELECT 'f' || s_suppkey || '.bin', 'binary', 'strings[]=n' || s_suppkey, 0, kept, skipped FROM supplier, n WHERE s_suppkey % 6 = 5 AND s_suppkey >= 1000""",
    "report_json_counts": _sql("nations", """, lb AS (SELECT DISTINCT root FROM lab)
SELECT entry, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'artifacts' AS entry, N AS value FROM nn UNION ALL SELECT 'evidence', count(*) FROM ids UNION ALL SELECT 'conflicts', count(*) FROM cf UNION ALL SELECT 'factions', count(*) FROM lb UNION ALL SELECT 'credential_forms', 0
  UNION ALL SELECT 'corpus.artifacts', N FROM nn UNION ALL SELECT 'corpus.observations', count(*) FROM f UNION ALL SELECT 'corpus.identities', count(*) FROM ids UNION ALL SELECT 'corpus.skipped', 2
  UNION ALL SELECT 'consensus.core', core FROM core UNION ALL SELECT 'consensus.' || b.b, count(ids.k) FROM (VALUES ('universal'), ('majority'), ('minority'), ('unique')) b(b) LEFT JOIN ids ON ids.bucket = b.b GROUP BY b.b
  UNION ALL SELECT 'drift.mean', round(mean, 9) FROM ag UNION ALL SELECT 'drift.stddev', round(sd, 9) FROM ag)""", _LABELS + _CONFLICTS, True),
    "report_yara_text": _sql("binaries", """, ar AS (SELECT faction_id, size, list_position(['imports', 'needs', 'exports', 'strings', 'sections'], split_part(c, '[]=', 1)) AS w, substr(c, instr(c, '[]=') + 3) AS text FROM ex WHERE instr(c, '[]=') > 0),
av AS (SELECT faction_id, size, row_number() OVER (PARTITION BY faction_id ORDER BY w, text) - 1 AS n, ['imp', 'lib', 'exp', 'str', 'sec'][w] AS p, text FROM ar WHERE w > 0)
SELECT CAST(row_number() OVER (ORDER BY faction_id) - 1 AS INT) AS position, 'rule factweave_family_' || (row_number() OVER (ORDER BY faction_id) - 1) || chr(10) || '{' || chr(10) || '    meta:' || chr(10) || '        members = ' || size || chr(10) || '    strings:' || chr(10)
  || string_agg('        $' || p || n || ' = "' || text || '" ascii wide', chr(10) ORDER BY n) || chr(10) || '    condition:' || chr(10) || '        ' || CASE WHEN count(*) <= 6 THEN 'all of them' ELSE '6 of them' END || chr(10) || '}' AS line
FROM av WHERE n < 24 GROUP BY faction_id, size""", _SIGNATURES, True),
    "report_kit_text": _sql("pages", """, kr AS (SELECT root, faction_id, size, split_part(c, '[]=', 1) AS p FROM ex),
kk AS (SELECT root, faction_id, size, count(*) FILTER (p IN ('field', 'formfields', 'formaction', 'resource')) > 0 AS functional FROM kr GROUP BY ALL),
nm AS (SELECT root, string_agg(name, ', ' ORDER BY a) AS names FROM (SELECT lab.root, lab.a, regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) AS name, row_number() OVER (PARTITION BY lab.root ORDER BY lab.a) AS nth FROM lab JOIN arts ON arts.a = lab.a) WHERE nth <= 8 GROUP BY root),
ks AS (SELECT 0 AS part, row_number() OVER (ORDER BY functional DESC, size DESC, faction_id) - 1 AS i, size, functional, names FROM kk JOIN nm USING (root))
SELECT CAST(row_number() OVER (ORDER BY part, i) - 1 AS INT) AS position, line FROM (
  SELECT part, i, 'kit #' || i || '  ' || size || ' pages  ' || CASE WHEN functional THEN 'functional' ELSE 'visual only' END || '  ' || names AS line FROM ks
  UNION ALL SELECT 1, artifact_id, 'ungrouped form: ' || path || '  ' || replace(fields, ',', ', ') FROM ff JOIN arts ON arts.a = artifact_id WHERE artifact_id NOT IN (SELECT a FROM lab))""", _SIGNATURES + _CREDS, True),
    "ask_focus": "SELECT page_id AS artifact_id, url AS path FROM pages WHERE contains(lower(url), 'example.net') ORDER BY page_id LIMIT 4",
    "ask_focus_path": "SELECT page_id AS artifact_id, url AS path FROM pages WHERE contains(lower(url), 'example.net/de/8') ORDER BY page_id LIMIT 4",
    "ask_focus_none": "SELECT page_id AS artifact_id, url AS path FROM pages WHERE false",
    "json_props": "SELECT event_id AS artifact_id, 'kv' AS kind, 'k=' || json_extract_string(props, '$.k') AS canonical FROM events",
    "page_titles": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title', 1), '[ \t\n\r\f]+', ' ', 'g')) AS t FROM pages)
SELECT page_id AS artifact_id, 'title[]=' || t AS canonical FROM t WHERE t <> ''""",
    "generated_corpus": "SELECT CAST(2000 AS BIGINT) AS artifacts, CAST(42 * 1960 + 33 * 40 AS BIGINT) AS observations, CAST(40 + 2 * 1960 + 30 * 40 AS BIGINT) AS identities, CAST(40 AS BIGINT) AS core, CAST(40 AS BIGINT) AS outliers, CAST(40 AS BIGINT) AS planted",
} | format_queries.ORACLE_SQL
ORACLE_SQL["report_gate_text"] = f"""WITH g AS ({ORACLE_SQL["gate_eval"]}),
b AS ({ORACLE_SQL["identity_stats_nations"]}),
c AS (SELECT list_position(['universal', 'majority', 'minority', 'unique'], x.x) AS i, '  ' || format('{{:<10}}', x.x) || ' ' || count(b.k) AS line FROM (VALUES ('universal'), ('majority'), ('minority'), ('unique')) x(x) LEFT JOIN b ON b.bucket = x.x GROUP BY x.x)
SELECT CAST(i AS INT) AS position, line FROM (SELECT 0 AS i, 'Consensus' AS line UNION ALL SELECT * FROM c UNION ALL SELECT 5, '  core       ' || count(*) FILTER (is_core) FROM b UNION ALL SELECT 6, '' UNION ALL SELECT 7, 'Gate'
  UNION ALL SELECT 8 + position, '  ' || CASE WHEN tripped THEN 'FAIL' ELSE 'ok  ' END || '  ' || metric || ' > ' || format('{{:g}}', threshold) || ': ' || format('{{:g}}', observed) FROM g)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as artifacts, lines as facts, ranked by drift."""
    return consensus.drift_ranking(document_lines(spark, sf_dir).stats)
