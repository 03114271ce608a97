"""JSON, and JSON with comments and trailing commas."""

from __future__ import annotations

import json
import re

from factweave.functions.formats import Fact, Unparseable, walk

#: A string, a line comment, a block comment (perhaps unclosed), or a comma before a closing bracket.
_LOOSE = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_TRAILING = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _real(text: str) -> float | str:
    """The number, or its own text where a double cannot hold it."""
    value = float(text)
    return text if value in (float("inf"), float("-inf")) else value


#: Integers keep their own text, whatever their length.
_NUMBERS = {"parse_int": str, "parse_float": _real, "parse_constant": _no_constant}
_SCALAR = json.JSONDecoder(**_NUMBERS)
_BLANK = re.compile(r"[ \t\n\r]*")


def _load(text: str) -> object:
    try:
        return json.loads(text, **_NUMBERS)
    except RecursionError:
        return _load_deep(text)
    except ValueError as e:
        raise Unparseable(str(e)) from None


def _load_deep(text: str) -> object:
    """Values of any depth: open containers are kept in a list, not in calls."""
    skip = lambda at: _BLANK.match(text, at).end()
    top: list = []
    stack: list = [top]
    keys: list[str] = []
    at, want = skip(0), "value"  # value, value or end, key, key or end, comma or end
    try:
        while True:
            if stack[-1] is top and top:
                if at != len(text):
                    raise ValueError("text after the value")
                return top[0]
            c, inside = text[at : at + 1], stack[-1]
            if want == "comma" and c == ",":
                at, want = skip(at + 1), "key" if isinstance(inside, dict) else "value"
                continue
            if want != "value" and want != "key" and inside is not top and c == ("}" if isinstance(inside, dict) else "]"):
                stack.pop()
                at, want = skip(at + 1), "comma"
                continue
            if want.startswith("key"):
                if c != '"':
                    raise ValueError("a key is expected")
                key, at = _SCALAR.raw_decode(text, at)
                at = skip(at)
                if text[at : at + 1] != ":":
                    raise ValueError("a colon is expected")
                keys.append(key)
                at, want = skip(at + 1), "value"
                continue
            if want == "comma":
                raise ValueError("a comma is expected")
            opened = {} if c == "{" else [] if c == "[" else None
            if opened is None:
                value, at = _SCALAR.raw_decode(text, at)
            else:
                value, at = opened, at + 1
            if isinstance(inside, dict):
                inside[keys.pop()] = value
            else:
                inside.append(value)
            at = skip(at)
            if opened is None:
                want = "comma"
            else:
                stack.append(opened)
                want = "key or end" if c == "{" else "value or end"
    except (ValueError, RecursionError) as e:
        raise Unparseable(str(e)) from None


def parse(data: bytes) -> list[Fact]:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Unparseable(str(e)) from None
    try:
        value = _load(text)
    except Unparseable:
        keep_strings = lambda m: m[0] if m[0][0] == '"' else ""
        value = _load(_TRAILING.sub(keep_strings, _LOOSE.sub(keep_strings, text)))
    out: list[Fact] = []
    walk(value, "", out)
    return out
