"""One pure-Python parser per format: bytes in, ``(kind, canonical, line)`` facts out.

Paths are dotted, lists add an index-less ``[]``, scalars are bare text, so the same fact in JSON, YAML,
XML, CBOR or INI has the same canonical form. Text is decoded with ``backslashreplace``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from factweave.functions.blake3 import blake3_many


class Digested:
    """A canonical that ends in a digest: the first ``size`` bytes of that of ``data``, in hex. ``text`` is None until it is taken;
    facts that come again share one object, so they are taken and spelt once."""

    __slots__ = ("data", "prefix", "size", "text")

    def __init__(self, prefix: str, data: bytes, size: int):
        self.prefix, self.data, self.size, self.text = prefix, data, size, None


Fact = tuple[str, str, int]
#: A fact whose canonical may still wait for its digest.
Read = tuple[str, str | Digested, int]

#: Digests of short texts that come again on many pages; emptied when full.
_KNOWN: dict[bytes, bytes] = {}
KNOWN_BYTES, KNOWN_MOST = 256, 1 << 14


def settled(found: list[list[Read]]) -> list[list[Fact]]:
    """The facts of several artifacts, with the digests that they wait for put in: taken together, each distinct text once."""
    digested = [(facts, i, c) for facts in found for i, (_, c, _) in enumerate(facts) if type(c) is Digested]
    if waiting := [c for _, _, c in digested if c.text is None]:
        if len(_KNOWN) > KNOWN_MOST:
            _KNOWN.clear()
        digests = {c.data: _KNOWN.get(c.data) for c in waiting}
        new = [d for d, known in digests.items() if known is None]
        for data, digest in zip(new, blake3_many(new)):
            digests[data] = digest
            if len(data) <= KNOWN_BYTES and len(_KNOWN) <= KNOWN_MOST:
                _KNOWN[data] = digest
        for c in waiting:
            c.text = c.prefix + digests[c.data][: c.size].hex()
    for facts, i, c in digested:
        facts[i] = (facts[i][0], c.text, facts[i][2])
    return found


class Unparseable(Exception):
    """The bytes are not in the format."""


def decode(data: bytes) -> str:
    return data.decode("utf-8", "backslashreplace")


def squeeze(text: str) -> str:
    """ASCII whitespace runs become one space; both ends are trimmed."""
    return " ".join(x for x in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x)


def scalar_text(value: object) -> str:
    """Bare text of a scalar: floats in shortest positional form, whole floats without a point."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return "nan" if value != value else "inf" if value > 0 else "-inf"
        return _positional(value)
    return str(value)


def _positional(value: float) -> str:
    from decimal import Decimal

    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def walk(value: object, path: str, out: list[Fact]) -> None:
    """Flatten nested dicts, lists and scalars of any depth; keys in byte order."""
    todo = [(value, path)]
    while todo:
        value, path = todo.pop()
        if isinstance(value, dict) and value:
            keys = sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"), reverse=True)
            todo += [(value[k], f"{path}.{k}" if path else k) for k in keys]
        elif isinstance(value, list) and value:
            below = f"{path}[]"
            todo += [(item, below) for item in reversed(value)]
        else:
            text = "{}" if isinstance(value, dict) else "[]" if isinstance(value, list) else scalar_text(value)
            out.append(("kv", f"{path or '$'}={text}", 0))


_REGISTRY: dict[str, Callable[[bytes], list[Fact]]] = {}


def register_extractor(kind: str, parse: Callable[[bytes], list[Fact]]) -> None:
    """Add or replace the parser of an artifact kind."""
    _REGISTRY[kind] = parse


def text_lines(data: bytes) -> list[Fact]:
    return [("line", t, n) for n, raw in enumerate(decode(data).split("\n"), 1) if (t := raw.strip(" \t\r"))]


def markdown(data: bytes) -> list[Fact]:
    out: list[Fact] = []
    for kind, t, n in text_lines(data):
        level = len(t) - len(t.lstrip("#"))
        rest = t[level:].strip(" \t")
        out.append(("heading", f"h{level}:{rest}", n) if 1 <= level <= 6 and rest else (kind, t, n))
    return out


def config(data: bytes) -> list[Fact]:
    out: list[Fact] = []
    section = ""
    for _, t, n in text_lines(data):
        if t[0] in "#;":
            continue
        if len(t) >= 2 and t[0] == "[" and t[-1] == "]":
            section = t[1:-1].strip(" \t")
            continue
        cut = min((i for i in (t.find("="), t.find(":")) if i >= 0), default=-1)
        if cut < 0:
            out.append(("line", t, n))
            continue
        key = t[:cut].strip(" \t")
        key = key[7:].strip(" \t") if key.startswith("export ") else key
        if key:
            out.append(("kv", f"{section}.{key}={t[cut + 1 :].strip(QUOTED)}" if section else f"{key}={t[cut + 1 :].strip(QUOTED)}", n))
    return out


QUOTED = " \t\"'"


def _yaml_lines(text: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """``(line, indent, is a list item, key if any, value)`` of the lines that say something; a document's end has the
    indent -1."""
    for n, raw in enumerate(text.split("\n"), 1):
        t = raw.rstrip("\r").strip(" \t")
        if not t or t[0] == "#":
            continue
        if t in ("---", "..."):
            yield n, -1, False, None, ""
            continue
        indent = next(i for i, c in enumerate(raw) if c not in " \t")
        body = t[2:].lstrip(" \t") if t.startswith("- ") else t
        key, colon, value = body.partition(":")
        if colon:
            yield n, indent, body is not t, key.strip(QUOTED), value.strip(QUOTED)
        else:
            yield n, indent, body is not t, None, body.strip(QUOTED) if body is not t else body


def yaml_lite(data: bytes) -> list[Fact]:
    """Indented maps and lists; anything else is kept as a line. Lines are told apart first, then folded into the paths
    that are open at their indents."""
    out: list[Fact] = []
    open_at: list[tuple[int, str]] = [(-1, "")]  # indent of the opening line, path below it

    def below(leaf: str) -> str:
        path = open_at[-1][1]
        return path + leaf if leaf == "[]" else f"{path}.{leaf}" if path else leaf

    for n, indent, item, key, value in _yaml_lines(decode(data)):
        while len(open_at) > 1 and open_at[-1][0] >= indent:
            open_at.pop()
        if indent < 0:
            continue
        if key is None:
            if not item:
                out.append(("line", value, n))
            elif value:
                out.append(("kv", f"{below('[]')}={value}", n))
            continue
        if item:  # the item's own keys stand two columns further in
            open_at.append((indent + 1, below("[]")))
            indent += 2
        if key and value in ("", "|", ">"):
            open_at.append((indent, below(key)))
        elif key:
            out.append(("kv", f"{below(key)}={value}", n))
    return out


def extract(kind: str, data: bytes) -> list[Fact]:
    """Facts of one artifact; formats that do not parse fall back as documented for each kind."""
    return settled([_read(kind, data)])[0]


def extract_many(artifacts: Iterable[tuple[str, bytes]]) -> list[list[Fact]]:
    """``extract`` of each ``(kind, data)``, with one pass for the digests of all of them."""
    return settled([_read(kind, data) for kind, data in artifacts])


#: Starts of the facts that tell of a page's forms.
FORM_FACTS = ("field[]=", "formhost[]=")


def form_facts(kind: str, data: bytes) -> list[Fact]:
    """The facts of ``extract`` that start as ``FORM_FACTS``, in their order; of a page nothing else is read."""
    from factweave.functions.formats import html

    if kind == "html" and kind not in _REGISTRY:
        return html.read_forms(data)
    return [f for f in _read(kind, data) if f[0] == "kv" and type(f[1]) is str and f[1].startswith(FORM_FACTS)]


def _read(kind: str, data: bytes) -> list[Read]:
    from factweave.functions.formats import binary, cbor, html, jsonc, pdf, xml

    if kind in _REGISTRY:
        return _REGISTRY[kind](data)
    if kind in ("json", "xml"):
        try:
            return jsonc.parse(data) if kind == "json" else xml.parse(data)
        except Unparseable:
            return text_lines(data)
    if kind == "pdf":
        try:
            return pdf.parse(data)
        except Unparseable:
            return []
    if kind == "cbor":
        try:
            return cbor.parse(data)
        except Unparseable:
            return binary.read(data)
    simple = {"yaml": yaml_lite, "html": html.read, "binary": binary.read, "markdown": markdown, "config": config}
    if kind in simple:
        return simple[kind](data)
    head = data.lstrip(b" \t\r\n")
    try:
        if head[:1] in (b"{", b"["):
            return jsonc.parse(data)
        if head[:1] == b"<":
            opening = head[:64].lower()
            if opening.startswith(b"<!doctype html") or any(t in opening for t in (b"<html", b"<head", b"<body")):
                return html.read(data)
            return xml.parse(data)
        if data.startswith(cbor.SELF_DESCRIBE):
            return cbor.parse(data)
    except Unparseable:
        pass
    return text_lines(data)
