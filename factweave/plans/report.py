"""Reports: text with capped sections, JSON with everything, kit and YARA renderings. Tasks render the lines (``*_lines``,
``yara_rules``, ``kit_records``); the functions that return one text join them on the driver, a partition at a time, the JSON document
up to a stated number of rows. ``write_sections`` writes the sections of a large corpus as datasets, nothing through the driver."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.blake3 import identity
from factweave.functions.graph import materialize
from factweave.functions.order import global_rank
from factweave.operators import conflicts as conflict_ops
from factweave.operators import consensus, creds
from factweave.plans.corpus import Corpus

SECTIONS = ("all", "consensus", "drift", "conflicts", "factions")
KEYS, VALUES, FILES, VALUE_BYTES, MEMBERS, SIGNATURE, FIELDS, LIST = 10, 6, 8, 48, 8, 5, 12, 10
OCCURRENCES = 16
#: Rows that a JSON document may hold.
JSON_ROWS = 1_000_000
#: Bytes of a chunk that a rule shows.
CHUNK_SHOWN = 48


def truncate(text: str, budget: int) -> str:
    """At most ``budget`` UTF-8 bytes, no code point split."""
    return text.encode()[:budget].decode("utf-8", "ignore")


def _truncated(text: Column, budget: int) -> Column:
    """``truncate`` as a column."""
    cut = [F.substring(F.encode(text, "UTF-8"), 1, budget - k).cast("string") for k in range(4)]
    return F.coalesce(*(F.when(F.is_valid_utf8(x), x) for x in cut))


def _names(paths: Column, shown: int | None = None) -> Column:
    return F.array_join(paths if shown is None else F.slice(paths, 1, shown), ", ")


def conflict_lines(c: Corpus, keys: int | None = None) -> DataFrame:
    """``place, at, line``: the conflicts as lines of text, clearest first (the first ``keys``), with the first values of
    each and the first files of each deviating value. Everything is rendered by tasks."""
    found = global_rank(materialize(c.conflicts), [F.col("deviants"), F.desc("holders"), F.col("key")], "place")
    found = found if keys is None else found.where(F.col("place") < keys)
    first = conflict_ops.first_holders(c.members, FILES).where(F.col("rank") <= VALUES)
    named = first.select("key", "value", "rank", "n", F.posexplode("artifacts").alias("nth", "artifact_id")).join(c.artifacts.select("artifact_id", "path"), "artifact_id")
    values = named.groupBy("key", "value", "rank", "n").agg(F.array_sort(F.collect_list(F.struct("nth", "path"))).alias("paths"))
    files = F.when(F.col("rank") == 1, "").otherwise(F.concat(F.lit("  "), _names(F.col("paths.path"))))
    shown = values.select("key", F.col("rank").alias("at"), F.concat(F.format_string("    %6d  ", "n"), _truncated(F.col("value"), VALUE_BYTES), files).alias("line"))
    head = F.concat("key", F.format_string("  %d values, %d holders, %d deviants", "n_values", "holders", "deviants"))
    heads = found.select("place", F.lit(0).alias("at"), F.concat(F.lit("  "), head).alias("line"))
    return heads.unionByName(shown.join(found.select("key", "place"), "key").select("place", "at", "line"))


def faction_rows(c: Corpus, factions: int = LIST) -> DataFrame:
    """``faction_id, at, n, cohesion, text``: the first factions with their size and first members (``at`` 0) and their
    signatures with the holders of each; one join for the members of all of them and one for the signatures."""
    labels, table, signature = c.factions
    top = F.broadcast(table.orderBy("faction_id").limit(factions))
    nth = F.row_number().over(Window.partitionBy("root").orderBy("artifact_id"))
    first = labels.join(top.select("root"), "root").withColumn("nth", nth).where(F.col("nth") <= MEMBERS).join(c.artifacts.select("artifact_id", "path"), "artifact_id")
    names = first.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("nth", "path"))).alias("paths"))
    heads = top.join(names, "root").select("faction_id", F.lit(0).alias("at"), F.col("size").alias("n"), "cohesion", _names(F.col("paths.path")).alias("text"))
    marks = signature.where(F.col("rank") <= SIGNATURE).join(top.select("root", "faction_id"), "root")
    return heads.union(marks.select("faction_id", "rank", "present", F.lit(0.0), "canonical"))


def form_lines(c: Corpus, forms: int = LIST) -> DataFrame:
    """``artifact_id, line``: the first credential forms as lines of text."""
    first = c.credential_forms.orderBy("artifact_id").limit(forms)
    off = F.when(F.col("off_domain"), "  OFF-DOMAIN").otherwise("")
    return first.select("artifact_id", F.concat(F.lit("  "), "path", F.lit("  "), _names(F.col("fields"), FIELDS), F.lit(" -> "), F.coalesce("action_host", F.lit("-")), off).alias("line"))


def text_report(c: Corpus, section: str = "all", gate_rows: list | None = None, skipped: int = 0) -> str:
    show = lambda name: section in ("all", name)
    s = c.summary.first()
    out = [f"{s['artifacts']} artifacts, {s['observations']} observations, {s['identities']} distinct facts, {skipped} skipped"]
    if show("consensus"):
        counts = {r["bucket"]: r["n"] for r in consensus.bucket_counts(c.identities).collect()}
        out += ["", "Consensus", *[f"  {b:<10} {counts[b]}" for b in consensus.BUCKETS], f"  core       {s['core']}"]
    if show("drift"):
        out += ["", f"Drift  mean {s['mean_drift']:.4f}  deviation {s['sd_drift']:.4f}"]
        out += [f"  {r['drift']:.4f}  {r['path']}{'  OUTLIER' if r['is_outlier'] else ''}" for r in c.stats.orderBy(F.desc("drift"), "artifact_id").limit(30).collect()]
    if show("conflicts"):
        lines = conflict_lines(c, None if section == "conflicts" else KEYS)
        out += ["", "Conflicts", *[r["line"] for r in lines.orderBy("place", "at").toLocalIterator()]]
    if show("factions"):
        out += ["", "Factions"]
        for r in faction_rows(c).orderBy("faction_id", "at").collect():
            out.append(f"    {r['n']:>4}  {r['text']}" if r["at"] else f"  #{r['faction_id']}  {r['n']} members  cohesion {r['cohesion']:.3f}  {r['text']}")
    if show("drift"):
        rows = consensus.unique_evidence(c.stats.drop("is_outlier"), c.identities).join(c.artifacts.select("artifact_id", "path"), "artifact_id").orderBy(F.desc("drift"), "artifact_id", "rank").collect()
        if rows:
            out += ["", "Unique evidence", *[f"  {r['path']}: {r['canonical']}" for r in rows]]
    if section == "all":
        forms = [r["line"] for r in form_lines(c).orderBy("artifact_id").collect()]
        out += ["", "Credential forms", *forms] if forms else []
    if gate_rows:
        out += ["", "Gate", *[f"  {'FAIL' if r['tripped'] else 'ok  '}  {r['metric']} > {r['threshold']:g}: {r['observed']:g}" for r in gate_rows]]
    return "\n".join(out)


def evidence_table(c: Corpus, full: bool = False) -> DataFrame:
    """``identity, kind, canonical, k, bucket, occurrences`` in identity order; occurrences capped unless ``full``."""
    index = consensus.occurrence_index(c.facts, (1 << 31) - 1 if full else OCCURRENCES)
    ids = c.identities.select("kind", "canonical", "k", "bucket").withColumn("identity", identity("kind", "canonical"))
    return ids.join(index.select("kind", "canonical", "occurrences"), ["kind", "canonical"]).orderBy("identity").withColumn("identity", F.lower(F.hex("identity")))


def json_sections(c: Corpus, full: bool = False) -> dict[str, DataFrame]:
    """The lists of the JSON report as ordered DataFrames."""
    labels, table, signature = c.factions
    members = labels.groupBy("root").agg(F.sort_array(F.collect_list("artifact_id")).alias("members"))
    marks = signature.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "canonical", "present"))), lambda x: F.struct(x["kind"].alias("kind"), x["canonical"].alias("canonical"), x["present"].alias("present"))).alias("signature"))
    return {
        "credential_forms": c.credential_forms.orderBy("artifact_id").select(F.col("path").alias("page"), F.col("fields").alias("harvests"), F.col("action_host").alias("posts_to"), "off_domain"),
        "conflicts": c.conflicts.orderBy("key"),
        "factions": table.join(members, "root").join(marks, "root", "left").orderBy("faction_id"),
        "artifacts": c.artifacts.join(c.stats.drop("path"), "artifact_id").orderBy("artifact_id"),
        "evidence": evidence_table(c, full),
    }


def json_figures(c: Corpus, skipped: int = 0) -> DataFrame:
    """``part, name, value``: the numbers of the JSON report, in order."""
    named = {"corpus": ("artifacts", "observations", "identities"), "consensus": ("core",), "drift": ("mean_drift", "sd_drift")}
    short = {"mean_drift": "mean", "sd_drift": "stddev"}
    entries = [F.struct(F.lit(p).alias("part"), F.lit(short.get(n, n)).alias("name"), F.col(n).cast("double").alias("value")) for p, ns in named.items() for n in ns]
    entries.append(F.struct(F.lit("corpus").alias("part"), F.lit("skipped").alias("name"), F.lit(float(skipped)).alias("value")))
    one = c.summary.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return one.union(consensus.bucket_counts(c.identities).select(F.lit("consensus"), "bucket", F.col("n").cast("double")))


def json_report(c: Corpus, gate_rows: list | None = None, full: bool = False, skipped: int = 0) -> str:
    """One JSON document, assembled on the driver: refused beyond ``JSON_ROWS`` rows (``write_sections`` has no limit)."""
    figures = {(r["part"], r["name"]): r["value"] for r in json_figures(c, skipped).collect()}
    rows = figures["corpus", "artifacts"] + figures["corpus", "observations" if full else "identities"]
    if rows > JSON_ROWS:
        raise ValueError(f"{rows:.0f} rows are too many for one JSON document ({JSON_ROWS}): write the sections instead")
    doc: dict = {"schema": "factweave.report.v1"}
    for (part, name), value in figures.items():
        doc.setdefault(part, {})[name] = value if part == "drift" else int(value)
    for name, df in json_sections(c, full).items():
        doc[name] = [json.loads(x) for x in df.toJSON().toLocalIterator()]
    if gate_rows is not None:
        doc["gate"] = {"failed": any(r["tripped"] for r in gate_rows), "conditions": [r.asDict() for r in gate_rows]}
    return json.dumps(doc, ensure_ascii=False)


def write_sections(c: Corpus, folder: str) -> None:
    """The report of a large corpus: one Parquet dataset per section, nothing through the driver."""
    labels, table, signature = c.factions
    sections = {"summary": c.summary, "identities": c.identities, "artifacts": c.stats, "conflicts": c.conflicts, "conflict_values": conflict_ops.value_groups(c.members), "conflict_holders": conflict_ops.value_holders(c.members), "faction_members": labels, "factions": table, "faction_signature": signature, "credential_forms": c.credential_forms, "evidence": consensus.occurrences(c.facts)}
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def kit_members(c: Corpus, shown: int | None = None) -> DataFrame:
    """The kits with ``members``, the base names of their pages (the first ``shown``) in page order: one join for all kits."""
    base = F.regexp_extract(F.regexp_replace("path", "/+$", ""), r"([^/]*)$", 1)
    pages = c.faction_labels
    if shown is not None:
        pages = pages.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("artifact_id"))).where(F.col("nth") <= shown)
    pages = pages.join(c.artifacts.select("artifact_id", F.when(base == "", F.col("path")).otherwise(base).alias("name")), "artifact_id")
    names = pages.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("artifact_id", "name"))), lambda x: x["name"]).alias("members"))
    return c.kits.join(names, "root")


def kit_records(c: Corpus) -> DataFrame:
    """``rank, record``: every kit as a JSON text."""
    record = F.to_json(F.struct("members", "functional", F.col("fields").alias("harvests"), F.col("field_sets").alias("field_set"), F.col("actions").alias("posts_to"), F.col("resources").alias("loads"), "brand", F.col("shape_count").alias("skeleton_shingles")))
    return kit_members(c).select("rank", record.alias("record"))


def kit_json(c: Corpus) -> str:
    return json.dumps({"schema": "factweave.kit.v1", "kits": [json.loads(r["record"]) for r in kit_records(c).orderBy("rank").toLocalIterator()]}, ensure_ascii=False)


def kit_lines(c: Corpus) -> DataFrame:
    """``part, place, at, line``: every kit as lines of text (part 0), then every form outside all kits (part 1)."""
    head = F.format_string("kit #%d  %d pages  %s  %s", "rank", "size", F.when(F.col("functional"), "functional").otherwise("visual only"), _names(F.col("members")))
    lists = [("harvests", "fields"), ("field set", "field_sets"), ("posts to", "actions"), ("loads", "resources"), ("brand", "brand"), ("paths", "paths")]
    said = [F.when(F.size(col) > 0, F.concat(F.lit(f"  {label}: "), _names(F.col(col), LIST))) for label, col in lists]
    lines = F.array_compact(F.array(head, *said, F.format_string("  skeleton shingles: %d", "shape_count")))
    kits = kit_members(c, MEMBERS).select(F.lit(0).alias("part"), F.col("rank").cast("long").alias("place"), F.posexplode(lines).alias("at", "line"))
    loose = creds.ungrouped_forms(c.credential_forms, c.faction_labels)
    return kits.union(loose.select(F.lit(1), "artifact_id", F.lit(0), F.concat(F.lit("ungrouped form: "), "path", F.lit("  "), _names(F.col("fields"), FIELDS))))


def kit_text(c: Corpus) -> str:
    return "\n".join(r["line"] for r in kit_lines(c).orderBy("part", "place", "at").toLocalIterator()) or "no kits"


def chunk_heads(c: Corpus, contents: DataFrame) -> DataFrame | None:
    """``text, head``: the first bytes of the chunks that are atoms (at most ``ATOM_CAP`` a family), from ``artifact_id,
    content``: the tasks cut the family members' files again and send one short row per chunk. Nothing is read without such atoms."""
    from factweave.functions.formats.binary import chunks

    atoms = c.atoms.where("atom = 'chunk'").select("text").distinct()
    if atoms.isEmpty():
        return None

    def cut(batches):
        for batch in batches:
            for content in batch.column(0):
                found = chunks(content.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in found], pa.string()), pa.array([b[:CHUNK_SHOWN] for _, b, _ in found], pa.binary())], names=["text", "head"])

    members = contents.join(c.faction_labels.select("artifact_id"), "artifact_id", "left_semi").select("content")
    return members.mapInArrow(cut, "text string, head binary").join(atoms, "text", "left_semi").groupBy("text").agg(F.min("head").alias("head"))


#: Names of atoms in a rule.
_ATOM = {"import": "imp", "needs": "lib", "export": "exp", "string": "str", "section": "sec", "chunk": "c"}


def yara_rules(c: Corpus, heads: DataFrame | None = None) -> DataFrame:
    """``place, rule``: a rule for each faction with exclusive binary features, rendered by tasks; chunks are shown where
    ``heads`` (``chunk_heads``) has their bytes."""
    atoms = c.atoms
    atoms = atoms.withColumn("head", F.lit(None).cast("binary")) if heads is None else atoms.join(heads, "text", "left")
    name = F.concat(F.lit("        $"), F.create_map(*(F.lit(x) for kv in _ATOM.items() for x in kv))[F.col("atom")], (F.col("rank") - 1).cast("string"), F.lit(" = "))
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    octets = F.concat(F.lit("{ "), F.regexp_replace(F.lower(F.hex("head")), "(..)(?=.)", "$1 "), F.lit(" }"))
    line = F.concat(name, F.when(F.col("atom") == "chunk", octets).otherwise(F.concat(F.lit('"'), escaped, F.lit('" ascii wide'))))
    families = atoms.groupBy("faction_id").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("rank", line.alias("line"))))).alias("found"))
    placed = global_rank(materialize(families), [F.col("faction_id")], "place").join(c.faction_table.select("faction_id", "size"), "faction_id")
    n = F.size("found")
    condition = F.when(n == 0, "false").when(n <= 6, "all of them").otherwise("6 of them")
    body = F.when(n > 0, F.concat_ws("\n", F.lit("    strings:"), F.col("found.line")))
    head = F.format_string("rule factweave_family_%d\n{\n    meta:\n        members = %d", "place", "size")
    return placed.select("place", F.concat_ws("\n", head, body, F.lit("    condition:"), F.concat(F.lit("        "), condition), F.lit("}")).alias("rule"))


def yara(c: Corpus, heads: DataFrame | None = None) -> str:
    """YARA rules, one per faction with exclusive binary features."""
    return "\n\n".join(r["rule"] for r in yara_rules(c, heads).orderBy("place").toLocalIterator()) or "// no family with exclusive features"
