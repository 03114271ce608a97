"""Tolerant HTML reader: structural shingles, form fields, hosts, headings, metadata and comments as bags."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import NamedTuple

from factweave.functions.formats import KNOWN_BYTES, Digested, Fact, Read, decode, settled

SHINGLE, MAX_TOKENS, MAX_SHINGLES, MAX_FEATURES, TEXT_MAX = 5, 200_000, 4096, 4096, 120
#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LANDMARKS = frozenset("form input script iframe select textarea button".split())
CAPTURED = frozenset("title h1 h2 h3".split())
META_KEYS = frozenset(("generator", "application-name", "author"))

_SPACES = " \t\n\r\x0c"
_ATTRIBUTE = re.compile(r"""[ \t\n\r\f]*(?:(?P<end>>)|(?P<slash>/)|(?P<name>[^ \t\n\r\f=>/]*)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:"(?P<d>[^"]*)"?|'(?P<s>[^']*)'?|(?P<u>[^ \t\n\r\f>]*)))?)(?:[ \t\n\r\f]*(?P<done>>))?""")
_HOST = re.compile(r"(?:[hH][tT][tT][pP][sS]?:)?//([^/?#:]*)")
_UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
#: Whitespace as spaces, other controls dropped.
_PLAIN = {c: " " if chr(c) in _SPACES else None for c in (*range(32), 127)}


def lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_UPPER)


def url_host(url: str) -> str | None:
    """Lower-case host of an absolute or ``//`` url."""
    m = _HOST.match(url)
    return lower(m[1]) if m and m[1] else None


def action_token(url: str) -> str | None:
    """A form action as its host, or its last path segment."""
    if host := url_host(url):
        return host
    base = re.split(r"[?#]", url, maxsplit=1)[0].rstrip("/").rpartition("/")[2]
    return lower(base) or None


def plain(raw: str) -> str:
    """Whitespace collapsed, controls dropped, at most ``TEXT_MAX`` bytes taken."""
    text = " ".join(w for w in raw.translate(_PLAIN).split(" ") if w)
    if text.isascii():
        return text[:TEXT_MAX].rstrip(" ")
    out, size = "", 0
    for c in text:
        if size >= TEXT_MAX:
            break
        out, size = out + c, size + len(c.encode())
    return out.rstrip(" ")


class Event(NamedTuple):
    """A piece of a page: ``open`` or ``close`` of a tag, ``text`` or ``comment``."""

    what: str
    tag: str = ""
    text: str = ""
    attrs: dict[str, str] = {}
    alone: bool = False
    typed: str = ""


#: Everything that is not text; what follows an opening tag's name is read by ``_attributes``.
_MARKUP = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<![^>]*>?|</(?P<close>[A-Za-z0-9:_-]*)[^>]*>?|<(?P<open>[A-Za-z][A-Za-z0-9:_-]*)", re.S)
_RAW_END = {t: re.compile(f"</{t}[^>]*>?", re.I | re.A) for t in ("script", "style")}


def events(src: str) -> Iterator[Event]:
    """The page's pieces in order; the text of scripts and styles is left out, brackets that open nothing are dropped."""
    at = 0
    while m := _MARKUP.search(src, at):
        start, end = m.span()
        if start > at:
            yield Event("text", "", src[at:start].replace("<", ""))
        at, what = end, m.lastgroup
        if what == "open":
            tag = lower(m[what])
            attrs, closed, at = ({}, False, at + 1) if src.startswith(">", at) else _attributes(src, at)
            yield Event(what, tag, "", attrs, closed or tag in VOID, f"input:{lower(attrs.get('type', 'text'))}" if tag == "input" else tag)
            if tag in _RAW_END and not closed:
                end = _RAW_END[tag].search(src, at)
                at = end.end() if end else len(src)
                yield Event("close", tag)
        elif what == "close":
            yield Event(what, lower(m[what]))
        elif what == "comment":
            yield Event(what, "", m[what])


#: A feature: the number of its event, its bag and its value; one without a value is not kept.
Feature = tuple[int, str, str | Digested | None]


def comment_bag(page: list[Event]) -> Iterator[Feature]:
    yield from ((i, "comment", plain(e.text)) for i, e in enumerate(page) if e.what == "comment")


def path_bag(page: list[Event]) -> Iterator[Feature]:
    """Landmarks behind the last five elements open around them."""
    around: list[str] = []
    for i, e in enumerate(page):
        if e.what == "open":
            if e.tag in LANDMARKS:
                yield i, "path", ">".join([*around[-5:], e.typed])
            if not e.alone:
                around.append(e.tag)
        elif e.what == "close" and e.tag in around:
            while around.pop() != e.tag:
                pass


def field_bags(page: list[Event]) -> Iterator[Feature]:
    """Names of fields inside a form, and at its end the digest of all of them in order."""
    forms: list[list[str]] = []
    for i, e in enumerate(page):
        if e.what == "open" and e.tag == "form":
            forms.append([])
        elif e.what == "open" and forms and e.tag in ("input", "select", "textarea"):
            forms[-1].append(lower(next((e.attrs[k] for k in ("name", "id", "type") if k in e.attrs), e.tag)))
            yield i, "field", forms[-1][-1]
            if lower(e.attrs.get("type", "")) == "password" and forms[-1][-1] != "password":
                yield i, "field", "password"
        elif e.what == "close" and e.tag == "form" and forms and (names := forms.pop()):
            yield i, "formfields", Digested("formfields[]=", b"".join(f.encode() + b"\0" for f in sorted(names, key=str.encode)), 12)


def action_bags(page: list[Event]) -> Iterator[Feature]:
    for i, e in enumerate(page):
        if e.what == "open" and e.tag == "form" and "action" in e.attrs:
            yield i, "formaction", action_token(e.attrs["action"])
            yield i, "formhost", url_host(e.attrs["action"])


def resource_bag(page: list[Event]) -> Iterator[Feature]:
    source = {"script": "src", "img": "src", "iframe": "src", "link": "href"}
    yield from ((i, "resource", url_host(e.attrs[source[e.tag]])) for i, e in enumerate(page) if e.what == "open" and source.get(e.tag) in e.attrs)


def meta_bag(page: list[Event]) -> Iterator[Feature]:
    for i, e in enumerate(page):
        if e.what == "open" and e.tag == "meta" and "content" in e.attrs:
            key = lower(e.attrs.get("property", e.attrs.get("name", "")))
            if (key in META_KEYS or key.startswith("og:")) and (text := plain(e.attrs["content"])):
                yield i, "meta", f"{key}={text}"


def title_bags(page: list[Event]) -> Iterator[Feature]:
    """Text from the last opening of a title or heading to its end."""
    since = None
    for i, e in enumerate(page):
        if e.what == "open" and e.tag in CAPTURED:
            since = i
        elif e.what == "close" and since is not None and page[since].tag == e.tag:
            text = plain("".join(x.text for x in page[since:i] if x.what == "text"))
            if text:
                yield (i, "title", text) if e.tag == "title" else (i, "heading", f"{e.tag}:{text}")
            since = None


#: Facts of the runs that come again on many pages; emptied when full.
_RUNS: dict[tuple[str, ...], Read] = {}
RUNS_MOST = 1 << 14


def _shape(run: tuple[str, ...]) -> Read:
    fact = ("kv", Digested("shape[]=", "".join(t + "\x1f" for t in run).encode(), 9), 0)
    if len(_RUNS) >= RUNS_MOST:
        _RUNS.clear()
    if len(fact[1].data) <= KNOWN_BYTES:
        _RUNS[run] = fact
    return fact


#: Shapes of the pages whose whole structure comes again; emptied when full.
_PAGES: dict[tuple[str, ...], list[Read]] = {}
PAGES_MOST, PAGE_TOKENS = 1 << 10, 256


def shapes(page: list[Event]) -> list[Read]:
    """Digests of the runs of five structural tokens."""
    tokens: list[str] = []
    for e in page:
        if e.what == "open":
            tokens.append(f"+{e.typed}")
            if e.alone:
                tokens.append(f"-{e.tag}")
        elif e.what == "close":
            tokens.append(f"-{e.tag}")
    del tokens[MAX_TOKENS:]
    whole = tuple(tokens) if len(tokens) <= PAGE_TOKENS else None
    if (known := _PAGES.get(whole)) is not None:
        if any(type(c) is Digested for _, c, _ in known) and all(c.text for _, c, _ in known):
            known[:] = [(k, c.text, n) for k, c, n in known]  # taken since
        return known
    runs = list(dict.fromkeys(zip(*(tokens[k:] for k in range(SHINGLE)))))[:MAX_SHINGLES]
    found = [_RUNS.get(r) or _shape(r) for r in runs]
    if whole is not None:
        if len(_PAGES) >= PAGES_MOST:
            _PAGES.clear()
        _PAGES[whole] = found
    return found


#: Elements that make up a form.
FORM_TAGS = frozenset("form input select textarea".split())
#: In the order of the facts of one event.
BAGS = (comment_bag, path_bag, action_bags, resource_bag, meta_bag, title_bags, field_bags)


def _attributes(src: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes (first of a name wins), whether self-closed, and the end of the tag."""
    attrs: dict[str, str] = {}
    closed = False
    while at < len(src):
        m = _ATTRIBUTE.match(src, at)
        end, slash, name, double, single, bare, done = m.groups()
        at = m.end()
        if end:
            break
        if slash:
            closed = True
        elif name:
            attrs.setdefault(lower(name), double or single or bare or "")
        if done:
            break
    return attrs, closed, at


def read(data: bytes) -> list[Read]:
    """The facts of a page; digests are left to be taken with those of other pages."""
    page = list(events(decode(data)))
    return _kept(page, BAGS) + shapes(page)


def _kept(page: list[Event], bags: tuple[Callable[[list[Event]], Iterator[Feature]], ...], only: tuple[str, ...] | None = None) -> list[Read]:
    """The features of the bags, in the order of their events, up to the limit of each."""
    kept: dict[str, int] = {}
    facts: list[Read] = []
    for _, bag, value in sorted((f for bag in bags for f in bag(page) if f[2] and (only is None or f[1] in only)), key=itemgetter(0)):
        kept[bag] = kept.get(bag, 0) + 1
        if kept[bag] <= MAX_FEATURES:
            facts.append(("kv", value if type(value) is Digested else f"{bag}[]={value}", 0))
    return facts


def read_forms(data: bytes) -> list[Fact]:
    """The facts of a page that tell of its forms: names of fields and hosts that forms post to."""
    page = [e for e in events(decode(data)) if e.tag in FORM_TAGS]
    return _kept(page, (action_bags, field_bags), ("field", "formhost"))


def parse(data: bytes) -> list[Fact]:
    return settled([read(data)])[0]
