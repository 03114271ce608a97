import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.functions import formats
from factweave.functions.blake3 import blake3, blake3_many
from factweave.functions.formats import binary, cbor, html, jsonc, pdf, xml


def canon(facts):
    return [c for _, c, _ in facts]


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(8192))
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(data[:1]).hex().startswith("2d3adedff11b61f14c886e35afa03673")
    assert blake3(data[:1025]).hex().startswith("d00278ae47eb27b34faecf67b4fe263f")
    assert blake3_many([data[:3073], data])[1].hex().startswith("aae792484c8efe4f")


def test_few_short_inputs_are_digested_as_many_are():
    data = bytes(i * 7 % 251 for i in range(1025))
    texts = [data[:n] for n in (0, 1, 63, 64, 65, 127, 128, 129, 700, 1023, 1024, 1025)]
    assert [blake3(x) for x in texts] == blake3_many(texts * 20)[: len(texts)]


@pytest.mark.parametrize("kind, of", [("binary", lambda i: _elf() + b"%06d" % i * 50), ("html", lambda i: PAGE + b"<form><input name=n%d></form>" % i)])
def test_digests_of_many_artifacts_take_one_pass(monkeypatch, kind, of):
    """A numpy pass costs about as much for one artifact as for a hundred, so time is by passes."""
    many = [(kind, of(i)) for i in range(100)]
    alone, passes = [formats.extract(*x) for x in many], []
    monkeypatch.setattr(formats, "blake3_many", lambda items: passes.append(len(items)) or blake3_many(items))
    assert formats.extract_many(many) == alone and len(passes) == 1


def test_structure_that_comes_again_is_digested_and_spelt_once(monkeypatch):
    tags = b"".join(b"<t%d><img></t%d>" % (i, i) for i in range(40))
    want, seen = formats.extract("html", tags + b"<title>0</title>"), []
    spelt = html._shape
    monkeypatch.setattr(html, "_shape", lambda run: seen.append(run) or spelt(run))
    monkeypatch.setattr(formats, "blake3_many", lambda items: seen.extend(items) or blake3_many(items))
    again = formats.extract("html", tags + b"<title>1</title>")
    assert seen == [] and [f for f in again if f[1] != "title[]=1"] == [f for f in want if f[1] != "title[]=0"]


@given(st.binary(max_size=3000), st.integers(0, 3))
def test_chunk_bounds_by_one_sum_a_byte(data, few):
    data = bytes(b % (2 + few) for b in data) * (1 + few)
    low, mask, bounds, start, total = binary._LOW.tolist(), (1 << binary.MASK_BITS) - 1, [], 0, 0
    for i, b in enumerate(data):
        total = (2 * total + low[b]) & mask
        if i + 1 - start >= binary.MAX_CHUNK or (total == 0 and i + 1 - start >= binary.MIN_CHUNK):
            bounds.append((start, i + 1))
            start = i + 1
    assert binary.chunk_bounds(data) == bounds + [(start, len(data))] * (start < len(data))


@given(st.text(alphabet="ab ÉİK\x0b\x00\x7f\n\t\r\x0c\x1fZ", max_size=200))
def test_plain_text_and_case(text):
    spaced = "".join(" " if c in " \t\n\r\x0c" else c for c in text if c in " \t\n\r\x0c" or (c >= " " and c != "\x7f"))
    out = ""
    for c in " ".join(w for w in spaced.split(" ") if w):
        out += c if len(out.encode()) < html.TEXT_MAX else ""
    assert html.plain(text) == out.rstrip(" ")
    assert html.lower(text) == "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_json_flattening_and_fallback():
    doc = b'{"db": {"port": 5432, "f": 1.50, "n": null}, "l": ["b", "a"], "e": {}, "z": []}'
    assert canon(jsonc.parse(doc)) == ["db.f=1.5", "db.n=null", "db.port=5432", "e={}", "l[]=b", "l[]=a", "z=[]"]
    assert canon(jsonc.parse(b'{"a": "x // y", /* c */ "b": [1, 2,], // d\n}')) == ["a=x // y", "b[]=1", "b[]=2"]
    assert canon(jsonc.parse(b"5.0")) == ["$=5"]
    assert canon(formats.extract("json", b"{oops\n line ")) == ["{oops", "line"]
    assert canon(formats.extract("text", b' {"a": true}')) == ["a=true"]


def test_json_of_any_depth_and_number():
    depth = 100_000
    for data, want in ((b"[" * depth + b"7" + b"]" * depth, "[]" * depth + "=7"), (b'{"a":' * depth + b'{"b":[]}' + b"}" * depth, ".".join(["a"] * depth) + ".b=[]")):
        assert canon(formats.extract("json", data)) == [want]
    for bad in (b"[" * depth, b"[" * depth + b"1" + b"]" * (depth - 1) + b"}", b"[" * depth + b"1,]" + b"]" * depth + b"x", b"[" * 3000 + b"1 2" + b"]" * 3000):
        assert formats.extract("json", bad)[0][0] == "line"
    deep = b"[" * 3000 + b' {"k": [1, "x", {}, []], "l": 1.50, "k2": {"m": null}} , true' + b"]" * 3000
    at = "[]" * 3000
    assert canon(jsonc.parse(deep)) == [f"{at}.k[]=1", f"{at}.k[]=x", f"{at}.k[]={{}}", f"{at}.k[]=[]", f"{at}.k2.m=null", f"{at}.l=1.5", f"{at}=true"]
    digits = b"9" * 5000
    assert canon(jsonc.parse(b'{"n": ' + digits + b', "m": -12, "h": 1e400, "s": 1e3}')) == ["h=1e400", "m=-12", "n=" + digits.decode(), "s=1000"]


def test_yaml_and_config():
    text = b"db:\n  port: 5432\nfeatures:\n  - a\nservers:\n  - host: x\n    up: yes\n---\nplain\n# c\n"
    assert canon(formats.extract("yaml", text)) == ["db.port=5432", "features[]=a", "servers[].host=x", "servers[].up=yes", "plain"]
    assert canon(formats.extract("yaml", b"features:\n- a")) == ["[]=a"]
    nested = b"a:\n  - b:\n      c: 1\n    d: |\n      text\n  - e: 2\n - f\n'q': \"v\"\n: x\n  - : y\n    z: 1\n...\nlast: >\n  k: 2\r\n"
    assert canon(formats.extract("yaml", nested)) == ["a[].b.c=1", "text", "a[].e=2", "a[]=f", "q=v", "[].z=1", "last.k=2"]
    assert canon(formats.extract("config", b"[s]\nexport A = 'b'\n;x\nc: d\nline\n=v")) == ["s.A=b", "s.c=d", "line"]
    assert formats.extract("markdown", b"# T\n##x\n#######y\n#")[:2] == [("heading", "h1:T", 1), ("heading", "h2:x", 2)]


def test_xml():
    doc = b'<?xml version="1"?><!DOCTYPE r [<!ENTITY a "b">]><r a="1 &amp; 2"><x> t  u </x><y/><![CDATA[ <z> ]]><!-- c --></r>'
    assert canon(xml.parse(doc)) == ["r.a=1 & 2", "r.x=t u", "r.y=", "r=<z>"]
    for bad in (b"<a></b>", b"<a>", b"x<a/>", b"<a b=c/>", b"<a>&#xD800;</a>", b""):
        with pytest.raises(formats.Unparseable):
            xml.parse(bad)
    assert canon(xml.parse(b"<a>&nope;&#65;</a>")) == ["a=&nope;A"]


PAGE = b"""<!doctype html><html><head><title> My  Bank </title><meta property="og:site" content="B"><script src="//cdn.example/x.js">if (a<b) {}</script></head>
<body><!-- note --><form action="https://Evil.example/post?x"><input name=User><input type=PASSWORD id="pw"><select name=s></select></form><h1>Hi</h1></body></html>"""


def test_html_features():
    got = canon(html.parse(PAGE))
    for want in ("title[]=My Bank", "meta[]=og:site=B", "resource[]=cdn.example", "comment[]=note", "field[]=user", "field[]=pw", "field[]=password", "formhost[]=evil.example", "formaction[]=evil.example", "heading[]=h1:Hi", "path[]=html>body>form>input:password"):
        assert want in got, want
    digest = blake3(b"pw\0s\0user\0")[:12].hex()
    assert f"formfields[]={digest}" in got
    assert any(c.startswith("shape[]=") for c in got) and got.index(f"formfields[]={digest}") < next(i for i, c in enumerate(got) if c.startswith("shape"))


def test_html_ignores_whitespace_and_attribute_order():
    a = canon(html.parse(b'<form action="n.php"><input name="a" type="text"></form><p>x</p>'))
    b = canon(html.parse(b'<form\n action=n.php >\n<input type=text   name=a>\n</form> <p >y</p>'))
    assert a == b


def test_cbor():
    item = b"\xa3\x61b\x01\x61a\x82\xf5\xf6\x61c\x43xyz"
    assert canon(cbor.parse(item)) == ["a[]=true", "a[]=null", "b=1", "c=bytes#" + blake3(b"xyz")[:6].hex()]
    assert canon(cbor.parse(b"\xd9\xd9\xf7\xf9\x3e\x00")) == ["$=1.5"]
    assert canon(cbor.parse(b"\x9f\x01\x20\xff")) == ["$[]=1", "$[]=-1"] or canon(cbor.parse(b"\x9f\x01\x20\xff")) == ["[]=1", "[]=-1"]
    for bad in (b"\x82\x01", b"\x01\x02", b"\x1c", b"\x5b\xff\xff\xff\xff\xff\xff\xff\xff"):
        with pytest.raises(formats.Unparseable):
            cbor.parse(bad)


def _pdf(content: bytes, deflate: bool) -> bytes:
    body = zlib.compress(content) if deflate else content
    head = b"<< /Filter /FlateDecode >>" if deflate else b"<< >>"
    return b"%PDF-1.4\n1 0 obj " + head + b" stream\n" + body + b"\nendstream endobj"


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf(deflate):
    content = b"BT (Hello \\(w\\)\\041) Tj 0 -14 Td [(A) -200 (B) -10 (C)] TJ T* <48 69> Tj (q) ' BI junk (x) EI (\\000\\001) Tj ET"
    assert pdf.parse(_pdf(content, deflate)) == [("line", "Hello (w)!", 1), ("line", "A BC", 2), ("line", "Hi", 3), ("line", "q", 4)]


def test_pdf_skips_what_it_cannot_read():
    assert formats.extract("pdf", b"no pdf") == []
    assert pdf.parse(_pdf(b"x", False).replace(b"<< >>", b"<< /Filter /DCTDecode >>")) == []
    assert pdf.parse(b"%PDF-1 obj << /FlateDecode >> stream\nnot deflate\nendstream") == []


def test_binary_chunks_survive_insertion():
    import random

    rng = random.Random(1)
    data = rng.randbytes(20_000)
    other = data[:9000] + rng.randbytes(200) + data[9000:]
    a, b = ({h for h, _, _ in binary.chunks(x)} for x in (data, other))
    assert len(a & b) / len(a | b) >= 0.7
    assert b"".join(x for _, x, _ in binary.chunks(data)) == data
    assert all(len(x) <= binary.MAX_CHUNK for _, x, _ in binary.chunks(bytes(30_000)))
    # the sliding sum equals the running gear hash
    gear, fp = binary._gear(), 0
    ends, start = [], 0
    for i, c in enumerate(data):
        fp = ((fp << 1) + int(gear[c])) & ((1 << 64) - 1)
        n = i + 1 - start
        if (n >= binary.MIN_CHUNK and fp & 1023 == 0) or n >= binary.MAX_CHUNK:
            ends.append(i + 1)
            start, fp = i + 1, 0
    assert [e for _, e in binary.chunk_bounds(data)] == ends + ([len(data)] if start < len(data) else [])


def _elf() -> bytes:
    names = b"\0.text\0.dynsym\0.dynstr\0.dynamic\0"
    dynstr = b"\0malloc@GLIBC_2\0run\0libc.so\0"
    sym = lambda name, info, shndx: struct.pack("<IBBHQQ", name, info, 0, shndx, 0, 0)
    syms = sym(0, 0, 0) + sym(1, 0x12, 0) + sym(16, 0x12, 1)
    dynamic = struct.pack("<QQQQ", 1, 20, 0, 0)
    parts, at, off = [names, dynstr, syms, dynamic], 64, []
    for p in parts:
        off.append(at)
        at += len(p)
    sh = lambda name, kind, o, size, link: struct.pack("<IIQQQQIIQQ", name, kind, 0, 0, o, size, link, 0, 0, 0)
    headers = sh(0, 0, 0, 0, 0) + sh(1, 1, 0, 0, 0) + sh(7, 11, off[2], len(syms), 3) + sh(15, 3, off[1], len(dynstr), 0) + sh(23, 6, off[3], len(dynamic), 3) + sh(0, 3, off[0], len(names), 0)
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 0x3E, 1, 0, 0, at, 0, 64, 0, 0, 64, 6, 5)
    return head + b"".join(parts) + headers


def test_elf_features_and_truncation():
    got = canon(binary.parse(_elf()))
    assert got[0] == "binary.format=elf/x86_64"
    for want in ("sections[]=.text", "imports[]=malloc", "exports[]=run", "needs[]=libc.so"):
        assert want in got
    for n in range(0, len(_elf()), 37):
        binary.parse(_elf()[:n])
    assert binary.strings(b"abcd\0hello\0hello\x01w\0i\0d\0e\0r\0") == ["hello", "wider"]
    assert binary.format_tag(b"\x00asm") == "wasm" and binary.format_tag(b"xx") == "binary"


scalars = st.one_of(st.integers(-(10**6), 10**6), st.booleans(), st.text("abcxyz01", min_size=1, max_size=6))
trees = st.recursive(scalars, lambda c: st.one_of(st.lists(c, min_size=1, max_size=3), st.dictionaries(st.text("abcdef", min_size=1, max_size=4), c, min_size=1, max_size=3)), max_leaves=8)


def _encode(v) -> bytes:
    def head(major: int, n: int) -> bytes:
        return bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 26]) + n.to_bytes(4, "big")

    if isinstance(v, bool):
        return b"\xf5" if v else b"\xf4"
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, str):
        return head(3, len(v)) + v.encode()
    if isinstance(v, list):
        return head(4, len(v)) + b"".join(map(_encode, v))
    return head(5, len(v)) + b"".join(_encode(k) + _encode(x) for k, x in v.items())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=4), trees, min_size=1, max_size=4))
def test_json_equals_cbor_and_ignores_key_order(tree):
    import json

    a = jsonc.parse(json.dumps(tree).encode())
    assert a == jsonc.parse(json.dumps(dict(reversed(tree.items())), indent=3).encode()) == cbor.parse(_encode(tree))


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(["json", "yaml", "xml", "html", "pdf", "cbor", "binary", "markdown", "config", "text"]))
def test_no_input_crashes(data, kind):
    formats.extract(kind, data)
