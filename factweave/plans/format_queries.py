"""Registered queries of the format parsers: files are composed from table rows in Spark SQL, parsed by the byte
extractors, and their facts stated independently in DuckDB SQL over the same tables."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.table_functions import register
from factweave.plans.corpus import Corpus
from factweave.sources.content import dealt, extract_rows, from_rows
from factweave.sources.rows import table_artifacts


def _extracted(spark: SparkSession, sf_dir: str, table: str, key: str, kind: str, content: str) -> DataFrame:
    """Facts of one file per row of ``table``: ``content`` is a Spark SQL expression of the file's text or bytes."""
    rows = dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key)
    return extract_rows(rows.select(F.col(key).cast("long").alias("artifact_id"), F.lit(kind).alias("kind"), F.expr(content).cast("binary").alias("content")))


def _facts(table: str, key: str, facts: list[tuple[str, str, int]]) -> str:
    """SQL of the facts, in order: kind, canonical as an SQL expression, line."""
    one = lambda n, f: f"SELECT CAST({key} AS BIGINT) AS artifact_id, CAST({n} AS INT) AS ord, '{f[0]}' AS kind, {f[1]} AS canonical, CAST({f[2]} AS INT) AS line FROM {table}"
    return "\nUNION ALL ".join(one(n, f) for n, f in enumerate(facts))


_TEXTS = {
    "config_facts": ("supplier", "s_suppkey", "config", r"""concat('# note\nname = "', s_name, '"\n[home]\n nation: ', s_nationkey, '\r\n;off\nexport BAL=', s_acctbal > 0, '\nplain ', s_suppkey, '\n=none\n[[x]]\nk=')"""),
    "yaml_facts": ("part", "p_partkey", "yaml", r"""concat('brand: ', p_brand, '\nspec:\n  type: "', p_type, '"\n  size: ', p_size, '\ntags:\n  - ', p_name, '\n  - fixed\nitems:\n  - name: i', p_partkey, '\n    up: yes\n---\n# note\nplain ', p_partkey, '\nlast:\n  deep:\n    at: end')"""),
    "json_facts": ("orders", "o_orderkey", "json", r"""concat('{"z": {"b": [1, true, null], "a": "x y"}, "k": ', o_orderkey, ', "s": "', o_orderstatus, '", "half": 1.50, "big": 12345678901234567890', o_custkey, ', "huge": 1e400, "e": {}, "l": []}')"""),
    "jsonc_facts": ("orders", "o_orderkey", "json", r"""concat('{ // head\n "k": [', o_orderkey, ', ', o_custkey, ',], /* b */ "u": "http://h//', o_orderkey, '",\n}')"""),
    "xml_facts": ("supplier", "s_suppkey", "xml", r"""concat('<?xml version="1.0"?><!DOCTYPE s><s id="', s_suppkey, '">\n<name> ', s_name, '\n x</name><x/>\n<n><![CDATA[ a<', s_nationkey, ' ]]></n><!-- c --><b>&amp;&#65;&nope;</b></s>')"""),
    "pdf_facts": ("supplier", "s_suppkey", "pdf", r"""concat('%PDF-1.4\n1 0 obj << >> stream\nBT (', s_name, ' \\(a\\)\\041) Tj 0 -14 Td [(A) -200 (B) -10 (', s_nationkey, ')] TJ T* <48 69> Tj ET\nendstream endobj\n2 0 obj << /Filter /DCTDecode >> stream\nBT (no) Tj ET\nendstream')"""),
    "sniffed_facts": ("nation", "n_nationkey", "text", r"""CASE n_nationkey % 3 WHEN 0 THEN concat(' {"n": "', n_name, '"}') WHEN 1 THEN concat('<n v="', n_name, '"/>') ELSE concat('{', n_name, '\n\n second ') END"""),
}
_PAGE = r"""concat('<!DOCTYPE html><html><head><title> Shop  ', c_custkey, '\n</title><meta property="og:site" content="S', c_nationkey, '"><meta name=author content=" A  B "><meta name=other content=z>',
'<link rel=icon href="//icons.example/i.png"><script src="https://CDN', c_nationkey, '.example:8443/x.js">if (a<b) { "</p>" }</script></head><body><h1>Hello ', c_custkey, '</h1><h2> </h2>',
'<form action="', CASE WHEN c_custkey % 3 = 0 THEN concat('https://Evil', c_nationkey, '.example/post?x') ELSE concat('/go/Next', c_nationkey, '.php#q') END, '"><input name="User"><input type=PASSWORD id="pw"><select name=s></select>',
CASE WHEN c_custkey % 2 = 0 THEN '<textarea></textarea>' ELSE '<input type=hidden>' END, '</form><img src=/local.png><iframe src="http://frames.example/f"></iframe><!-- note ', c_nationkey, ' --><p>unclosed <b', '></body>')"""


def _html_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own_bags(_extracted(spark, sf_dir, "customer", "c_custkey", "html", _PAGE))


def _own_bags(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("canonical").startswith("shape[]=") & ~F.col("canonical").startswith("formfields[]=")).select("artifact_id", "ord", "canonical")


def _html_bags_sql() -> str:
    head, form = "html>body>form", "html>body>form>"
    facts = [
        ("'title[]=Shop ' || c_custkey", ""), ("'meta[]=og:site=S' || c_nationkey", ""), ("'meta[]=author=A B'", ""), ("'resource[]=icons.example'", ""), ("'path[]=html>head>script'", ""), ("'resource[]=cdn' || c_nationkey || '.example'", ""),
        ("'heading[]=h1:Hello ' || c_custkey", ""), (f"'path[]={head}'", ""),
        ("'formaction[]=' || CASE WHEN c_custkey % 3 = 0 THEN 'evil' || c_nationkey || '.example' ELSE 'next' || c_nationkey || '.php' END", ""), ("'formhost[]=evil' || c_nationkey || '.example'", "c_custkey % 3 = 0"),
        (f"'path[]={form}input:text'", ""), ("'field[]=user'", ""), (f"'path[]={form}input:password'", ""), ("'field[]=pw'", ""), ("'field[]=password'", ""), (f"'path[]={form}select'", ""), ("'field[]=s'", ""),
        (f"CASE WHEN c_custkey % 2 = 0 THEN 'path[]={form}textarea' ELSE 'path[]={form}input:hidden' END", ""), ("CASE WHEN c_custkey % 2 = 0 THEN 'field[]=textarea' ELSE 'field[]=hidden' END", ""),
        ("NULL", ""), ("'path[]=html>body>iframe'", ""), ("'resource[]=frames.example'", ""), ("'comment[]=note ' || c_nationkey", ""),
    ]
    rows = "\nUNION ALL ".join(f"SELECT CAST(c_custkey AS BIGINT) AS artifact_id, {n} AS nth, {c} AS canonical FROM customer{' WHERE ' + w if w else ''}" for n, (c, w) in enumerate(facts))
    # the form's field set (left out: DuckDB has no BLAKE3) takes a place, so places are counted with it
    return f"SELECT artifact_id, ord, canonical FROM (SELECT artifact_id, canonical, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY nth) - 1 AS INT) AS ord FROM (\n{rows}\n)) WHERE canonical IS NOT NULL"


def _field_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the same form share one field-set identity, whatever the order of its fields."""
    page = r"""concat('<form>', CASE WHEN c_custkey % 2 = 0 THEN '<input name=a><input name=b>' ELSE '<input name=B><input name=A>' END, '<input name=n', c_nationkey, '></form>')"""
    facts = _extracted(spark, sf_dir, "customer", "c_custkey", "html", page).where("canonical like 'formfields[]=%'")
    return facts.groupBy("canonical").agg(F.min("artifact_id").alias("first_page"), F.count("*").alias("pages"), F.max(F.length("canonical")).alias("width")).drop("canonical")


#: Structural tokens of a page in SQL: opening and closing tags, void elements closed at once, script text left out.
_TOKENS = r"""p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(?:script|style)[^>]*>', '<\1></\1>', 'g'), '(?s)<!--.*?-->|<![^>]*>', '', 'g') AS h FROM pages),
g AS (SELECT page_id, regexp_extract_all(h, '</?[A-Za-z][A-Za-z0-9:_-]*[^>]*>') AS tags FROM p),
t AS (SELECT page_id, flatten([CASE WHEN x[2] = '/' THEN ['-' || lower(regexp_extract(x, '^</([A-Za-z0-9:_-]*)', 1))]
  WHEN x[-2] = '/' OR lower(regexp_extract(x, '^<([A-Za-z0-9:_-]*)', 1)) IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr')
  THEN ['+' || lower(regexp_extract(x, '^<([A-Za-z0-9:_-]*)', 1)), '-' || lower(regexp_extract(x, '^<([A-Za-z0-9:_-]*)', 1))]
  ELSE ['+' || lower(regexp_extract(x, '^<([A-Za-z0-9:_-]*)', 1))] END for x in tags]) AS k FROM g),
r AS (SELECT DISTINCT page_id, s FROM (SELECT page_id, unnest([array_to_string(k[i:i + 4], ' ') for i in range(1, len(k) - 3)]) AS s FROM t))"""


def _pages(spark: SparkSession, sf_dir: str) -> Corpus:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("artifact_id"), F.lit("html").alias("kind"), F.encode("html", "UTF-8").alias("content"))
    return Corpus(table_artifacts(pages, "artifact_id"), extract_rows(pages))


def _page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shapes are held by how many pages; digests stand for token runs, so only their counts compare."""
    shapes = _pages(spark, sf_dir).identities.where("canonical like 'shape[]=%'")
    return shapes.groupBy("k", "bucket").agg(F.count("*").alias("shapes"), F.sum("occurrences").alias("occurrences"))


def _page_shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).facts.where("canonical like 'shape[]=%'").groupBy("artifact_id").agg(F.count("*").alias("shapes"))


#: A CBOR map {n: text, k: uint32, t: true, l: [null, -1, 1.5], u: undefined}, self-described.
_CBOR = r"""concat(unhex('d9d9f7a5616e'), unhex(hex(96 + length(s_name))), encode(s_name, 'UTF-8'), unhex('616b1a'), unhex(lpad(hex(s_suppkey), 8, '0')), unhex('6174f5616c83f620f93e006175f7'))"""
_FORMAT_TAGS = [("7f454c460201010000000000000000000300 3e00", "elf/x86_64"), ("7f454c460101010000000000000000000300 2800", "elf/arm"), ("cffaedfe0c000001", "mach-o/64"), ("cafebabe00000002", "mach-o/universal"), ("0061736d01000000", "wasm"), ("4d5a9000", None), ("00ff00ff", "binary")]


def _binary_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = r"concat(unhex('01'), encode(s_name, 'UTF-8'), unhex('00ff'), encode('abcd', 'UTF-8'), unhex('00'), encode(s_name, 'UTF-8'), unhex('0001'), encode(concat('wide ', s_suppkey), 'UTF-16LE'), unhex('ffff'))"
    return _extracted(spark, sf_dir, "supplier", "s_suppkey", "binary", body).where("kind = 'kv'").select("artifact_id", "ord", "canonical")


def _format_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = [t for t in _FORMAT_TAGS if t[1]]
    heads = "CASE s_suppkey % {} {} END".format(len(tags), " ".join(f"WHEN {i} THEN '{h.replace(' ', '')}'" for i, (h, _) in enumerate(tags)))
    return _extracted(spark, sf_dir, "supplier", "s_suppkey", "binary", f"concat(unhex({heads}), unhex('0000'))").where("canonical like 'binary.format=%'").select("artifact_id", "canonical")


def _binary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of one byte has no content cut, so its chunks are of the greatest length."""
    return _extracted(spark, sf_dir, "nation", "n_nationkey", "binary", "repeat('A', 300 + 2500 * n_nationkey)").where("kind = 'chunk'").select("artifact_id", "line")


def elf(mark: bytes) -> bytes:
    """A 64-bit ELF with one section table: imports ``imp<mark>``, exports ``exp<mark>``, needs ``lib<mark>.so``."""
    names = b"\0.text\0.dynsym\0.dynstr\0.dynamic\0"
    texts = b"\0imp" + mark + b"@V1\0exp" + mark + b"\0lib" + mark + b".so\0"
    at = lambda s: texts.index(s + mark)
    symbols = bytes(24) + struct.pack("<IBBHQQ", at(b"imp"), 0x12, 0, 0, 0, 0) + struct.pack("<IBBHQQ", at(b"exp"), 0x12, 0, 1, 0, 0)
    dynamic = struct.pack("<QQQQ", 1, at(b"lib"), 0, 0)
    parts, off, end = [names, texts, symbols, dynamic], [], 64
    for p in parts:
        off.append(end)
        end += len(p)
    section = lambda name, kind, o, size, link: struct.pack("<IIQQQQIIQQ", name, kind, 0, 0, o, size, link, 0, 0, 0)
    table = [section(0, 0, 0, 0, 0), section(1, 1, 0, 0, 0), section(7, 11, off[2], len(symbols), 3), section(15, 3, off[1], len(texts), 0), section(23, 6, off[3], len(dynamic), 3), section(0, 3, off[0], len(names), 0)]
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 0x3E, 1, 0, 0, end, 0, 64, 0, 0, 64, 6, 5)
    return head + b"".join(parts) + b"".join(table)


def _pe(mark: bytes) -> bytes:
    """A 64-bit PE with one section that holds an import of ``imp<mark>`` from ``dll<mark>.dll`` and an export ``exp<mark>``."""
    va, raw = 0x1000, 0x200
    body = bytearray(0x200)
    body[0:40] = struct.pack("<5I", va + 40, 0, 0, va + 80, va + 40) + bytes(20)
    body[40:56] = struct.pack("<QQ", va + 120, 0)
    body[80 : 80 + 8 + len(mark)] = b"dll" + mark + b".dll\0"
    body[120 : 120 + 6 + len(mark)] = b"\0\0imp" + mark + b"\0"
    body[160:200] = struct.pack("<10I", 0, 0, 0, 0, 1, 1, 1, 0, va + 220, 0)
    body[220:224] = struct.pack("<I", va + 240)
    body[240 : 240 + 4 + len(mark)] = b"exp" + mark + b"\0"
    optional = bytearray(0x70 + 16)
    optional[0:2] = struct.pack("<H", 0x20B)
    optional[0x70:] = struct.pack("<4I", va + 160, 40, va, 40)
    section = b".data\0\0\0" + struct.pack("<4I", len(body), va, len(body), raw) + bytes(16)
    head = b"MZ" + bytes(0x3A) + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0) + bytes(optional) + section
    return head.ljust(raw, b"\0") + bytes(body)


def _macho(mark: bytes) -> bytes:
    """A 64-bit Mach-O with a section, an undefined symbol ``_imp<mark>`` and a defined one ``_exp<mark>``."""
    segment = struct.pack("<II16s4QIIII", 0x19, 152, b"__TEXT", 0, 0, 0, 0, 7, 5, 1, 0) + struct.pack("<16s16s", b"__text", b"__TEXT") + bytes(48)
    texts = b"\0_imp" + mark + b"\0_exp" + mark + b"\0"
    at = 32 + len(segment) + 24
    symbols = struct.pack("<IBBHQ", 1, 0x01, 0, 0, 0) + struct.pack("<IBBHQ", 1 + 5 + len(mark), 0x0F, 1, 0, 0)
    table = struct.pack("<6I", 2, 24, at, 2, at + len(symbols), len(texts))
    head = struct.pack("<8I", 0xFEEDFACF, 0x01000007, 3, 6, 2, len(segment) + len(table), 0, 0)
    return head + segment + table + symbols + texts


MARK = b"@@@@@@"
_EXECUTABLES = {"elf": elf, "pe": _pe, "macho": _macho}


def _content(kind: str) -> str:
    """One executable per part, its six-digit key in place of the mark."""
    return "concat(" + ", CAST(lpad(p_partkey, 6, '0') AS BINARY), ".join(f"unhex('{p.hex()}')" for p in _EXECUTABLES[kind](MARK).split(MARK)) + ")"


def _features(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'kv' and canonical not like 'strings[]=%'").select("artifact_id", "canonical")


def _executable(kind: str):
    return lambda spark, sf_dir: _features(_extracted(spark, sf_dir, "part", "p_partkey", "binary", _content(kind)))


def _executable_sql(facts: list[str]) -> str:
    return "SELECT CAST(p_partkey AS BIGINT) AS artifact_id, replace(unnest([{}]), '@', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS canonical FROM part".format(", ".join(f"'{f}'" for f in facts))


def _feature_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags stop at their caps: 4096 headings of a page, 4096 distinct strings and 8192 imports of a binary."""
    page = _extracted(spark, sf_dir, "nation", "n_nationkey", "html", "repeat('<h1>a</h1>', 4000 + 10 * n_nationkey)").where("canonical like 'heading[]=%'").select("artifact_id", F.lit("headings").alias("bag"))
    many = "array_join(transform(sequence(1, 4000 + 10 * n_nationkey), i -> lpad(i, 6, '0')), chr(1))"
    text = _extracted(spark, sf_dir, "nation", "n_nationkey", "binary", many).where("canonical like 'strings[]=%'").select("artifact_id", F.lit("strings").alias("bag"))
    little = lambda x: f"unhex(concat_ws('', reverse(regexp_extract_all(lpad(hex({x}), 8, '0'), '..', 0))))"
    n = "(8000 + 20 * n_nationkey)"
    head = struct.pack("<8I", 0xFEEDFACF, 0x01000007, 3, 6, 1, 24, 0, 0) + struct.pack("<3I", 2, 24, 56)
    macho = f"concat(unhex('{head.hex()}'), {little(n)}, {little(f'56 + 16 * {n}')}, {little('6')}, unhex(repeat('01000000010000000000000000000000', {n})), unhex('005f61626300'))"
    symbols = _extracted(spark, sf_dir, "nation", "n_nationkey", "binary", macho).where("canonical = 'imports[]=abc'").select("artifact_id", F.lit("imports").alias("bag"))
    return page.union(text).union(symbols).groupBy("artifact_id", "bag").agg(F.count("*").alias("n"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-memory sources: text with an early NUL is a binary, other text kinds with one and empty files are skipped."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").cast("long").alias("artifact_id"),
        F.concat(F.lit("f/"), "s_name").alias("path"),
        F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'json' WHEN 2 THEN 'binary' ELSE 'text' END").alias("kind"),
        F.expr("CASE WHEN s_suppkey % 5 = 0 THEN concat(s_name, chr(0), 'x') WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END").cast("binary").alias("content"),
    )
    artifacts, facts = from_rows(rows)
    first = facts.groupBy("artifact_id").agg(F.min_by("canonical", "ord").alias("first_fact"), F.count_if(F.col("kind") == "line").alias("n_lines"))
    return artifacts.join(first, "artifact_id", "left").select("artifact_id", "path", "kind", "size", F.when(F.col("kind") != "binary", F.col("first_fact")).alias("first_fact"), "n_lines")


def _by_sql(spark: SparkSession, sf_dir: str, table: str, key: str, kind: str, content: str) -> DataFrame:
    """``_extracted``, as one SQL query with the table function: row by row, or by batches for kinds whose facts hold digests."""
    register(spark)
    rows = dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key)
    braced = content.replace("{", "{{").replace("}", "}}")
    files = f"SELECT CAST({key} AS BIGINT) AS artifact_id, '{kind}' AS kind, CAST({braced} AS BINARY) AS content FROM {{rows}}"
    if kind in ("html", "binary"):
        return spark.sql(f"SELECT * FROM extract_files(TABLE({files}))", rows=rows)
    return spark.sql(f"SELECT f.artifact_id, x.ord, x.kind, x.canonical, x.line FROM ({files}) f, LATERAL extract_facts(f.kind, f.content) x", rows=rows)


QUERIES = {name: (lambda s, d, a=args: _extracted(s, d, *a)) for name, args in _TEXTS.items()}
QUERIES |= {
    "cbor_facts": lambda s, d: _extracted(s, d, "supplier", "s_suppkey", "cbor", _CBOR),
    "html_bags": _html_bags,
    "html_field_sets": _field_sets,
    "page_shapes": _page_shapes,
    "page_shape_counts": _page_shape_counts,
    "binary_strings": _binary_strings,
    "binary_formats": _format_tags,
    "binary_chunks": _binary_chunks,
    "elf_features": _executable("elf"),
    "pe_features": _executable("pe"),
    "macho_features": _executable("macho"),
    "feature_caps": _feature_caps,
    "routed_sources": _routed,
}
_SQL_TEXTS = _TEXTS | {"cbor_facts": ("supplier", "s_suppkey", "cbor", _CBOR)}
QUERIES |= {f"sql_{name}": (lambda s, d, a=args: _by_sql(s, d, *a)) for name, args in _SQL_TEXTS.items()}
QUERIES["sql_html_bags"] = lambda s, d: _own_bags(_by_sql(s, d, "customer", "c_custkey", "html", _PAGE))
QUERIES["sql_elf_features"] = lambda s, d: _features(_by_sql(s, d, "part", "p_partkey", "binary", _content("elf")))
ORACLE_SQL = {
    "config_facts": _facts("supplier", "s_suppkey", [("kv", "'name=' || s_name", 2), ("kv", "'home.nation=' || s_nationkey", 4), ("kv", "'home.BAL=' || (s_acctbal > 0)", 6), ("line", "'plain ' || s_suppkey", 7), ("kv", "'[x].k='", 10)]),
    "yaml_facts": _facts("part", "p_partkey", [
        ("kv", "'brand=' || p_brand", 1), ("kv", "'spec.type=' || p_type", 3), ("kv", "'spec.size=' || p_size", 4), ("kv", "'tags[]=' || p_name", 6), ("kv", "'tags[]=fixed'", 7),
        ("kv", "'items[].name=i' || p_partkey", 9), ("kv", "'items[].up=yes'", 10), ("line", "'plain ' || p_partkey", 13), ("kv", "'last.deep.at=end'", 16)]),
    "json_facts": _facts("orders", "o_orderkey", [
        ("kv", "'big=12345678901234567890' || o_custkey", 0), ("kv", "'e={}'", 0), ("kv", "'half=1.5'", 0), ("kv", "'huge=1e400'", 0), ("kv", "'k=' || o_orderkey", 0), ("kv", "'l=[]'", 0), ("kv", "'s=' || o_orderstatus", 0),
        ("kv", "'z.a=x y'", 0), ("kv", "'z.b[]=1'", 0), ("kv", "'z.b[]=true'", 0), ("kv", "'z.b[]=null'", 0)]),
    "jsonc_facts": _facts("orders", "o_orderkey", [("kv", "'k[]=' || o_orderkey", 0), ("kv", "'k[]=' || o_custkey", 0), ("kv", "'u=http://h//' || o_orderkey", 0)]),
    "xml_facts": _facts("supplier", "s_suppkey", [("kv", "'s.id=' || s_suppkey", 1), ("kv", "'s.name=' || s_name || ' x'", 2), ("kv", "'s.x='", 3), ("kv", "'s.n=a<' || s_nationkey", 4), ("kv", "'s.b=&A&nope;'", 4)]),
    "pdf_facts": _facts("supplier", "s_suppkey", [("line", "s_name || ' (a)!'", 1), ("line", "'A B' || s_nationkey", 2), ("line", "'Hi'", 3)]),
    "sniffed_facts": """SELECT CAST(n_nationkey AS BIGINT) AS artifact_id, CAST(0 AS INT) AS ord, 'kv' AS kind, 'n=' || n_name AS canonical, CAST(0 AS INT) AS line FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_nationkey, 0, 'kv', 'n.v=' || n_name, 1 FROM nation WHERE n_nationkey % 3 = 1
UNION ALL SELECT n_nationkey, 0, 'line', '{' || n_name, 1 FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT n_nationkey, 1, 'line', 'second', 3 FROM nation WHERE n_nationkey % 3 = 2""",
    "cbor_facts": _facts("supplier", "s_suppkey", [("kv", "'k=' || s_suppkey", 0), ("kv", "'l[]=null'", 0), ("kv", "'l[]=-1'", 0), ("kv", "'l[]=1.5'", 0), ("kv", "'n=' || s_name", 0), ("kv", "'t=true'", 0), ("kv", "'u=undefined'", 0)]),
    "html_bags": _html_bags_sql(),
    "html_field_sets": "SELECT min(c_custkey) AS first_page, count(*) AS pages, CAST(37 AS INT) AS width FROM customer GROUP BY c_nationkey",
    "page_shapes": f"""WITH {_TOKENS}, n AS (SELECT count(*) AS n FROM pages), i AS (SELECT s, count(*) AS k FROM r GROUP BY s)
SELECT k, CASE WHEN k = n THEN 'universal' WHEN k = 1 THEN 'unique' WHEN 2 * k > n THEN 'majority' ELSE 'minority' END AS bucket, count(*) AS shapes, CAST(sum(k) AS BIGINT) AS occurrences FROM i, n GROUP BY ALL""",
    "page_shape_counts": f"WITH {_TOKENS} SELECT page_id AS artifact_id, count(*) AS shapes FROM r GROUP BY page_id",
    "binary_strings": """SELECT CAST(s_suppkey AS BIGINT) AS artifact_id, CAST(0 AS INT) AS ord, 'binary.format=binary' AS canonical FROM supplier UNION ALL SELECT s_suppkey, 1, 'strings[]=' || s_name FROM supplier
UNION ALL SELECT s_suppkey, 2, 'strings[]=wide ' || s_suppkey FROM supplier""",
    "binary_formats": "SELECT CAST(s_suppkey AS BIGINT) AS artifact_id, 'binary.format=' || [{0}][s_suppkey % {1} + 1] AS canonical FROM supplier".format(", ".join(f"'{t}'" for _, t in _FORMAT_TAGS if t), sum(t is not None for _, t in _FORMAT_TAGS)),
    "binary_chunks": "SELECT CAST(n_nationkey AS BIGINT) AS artifact_id, CAST(unnest(range(0, 300 + 2500 * n_nationkey, 8192)) AS INT) AS line FROM nation",
    "elf_features": _executable_sql(["binary.format=elf/x86_64", "sections[]=.text", "sections[]=.dynsym", "sections[]=.dynstr", "sections[]=.dynamic", "imports[]=imp@", "exports[]=exp@", "needs[]=lib@.so"]),
    "pe_features": _executable_sql(["binary.format=pe/x86_64", "sections[]=.data", "needs[]=dll@.dll", "imports[]=imp@", "exports[]=exp@"]),
    "macho_features": _executable_sql(["binary.format=mach-o/64", "sections[]=__TEXT,__text", "imports[]=imp@", "exports[]=exp@"]),
    "feature_caps": """SELECT CAST(n_nationkey AS BIGINT) AS artifact_id, 'headings' AS bag, CAST(least(4096, 4000 + 10 * n_nationkey) AS BIGINT) AS n FROM nation
UNION ALL SELECT n_nationkey, 'strings', least(4096, 4000 + 10 * n_nationkey) FROM nation UNION ALL SELECT n_nationkey, 'imports', least(8192, 8000 + 20 * n_nationkey) FROM nation""",
    "routed_sources": """WITH r AS (SELECT s_suppkey AS a, s_name, ['text', 'json', 'binary', 'text'][s_suppkey % 4 + 1] AS kind, s_suppkey % 5 = 0 AS nul, s_suppkey % 5 <> 0 AND s_suppkey % 7 = 0 AS empty FROM supplier)
SELECT a AS artifact_id, 'f/' || s_name AS path, CASE WHEN nul AND kind = 'text' THEN 'binary' ELSE kind END AS kind, length(s_name) + CASE WHEN nul THEN 2 ELSE 0 END AS size,
  CASE WHEN kind <> 'binary' AND NOT nul THEN s_name END AS first_fact, CASE WHEN kind <> 'binary' AND NOT nul THEN CAST(1 AS BIGINT) ELSE 0 END AS n_lines FROM r WHERE NOT empty AND NOT (nul AND kind = 'json')""",
}
ORACLE_SQL |= {f"sql_{name}": ORACLE_SQL[name] for name in [*_SQL_TEXTS, "html_bags", "elf_features"]}
