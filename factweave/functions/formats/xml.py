"""A strict little XML reader: attributes and child elements unify into dotted paths."""

from __future__ import annotations

import re

from factweave.functions.formats import Fact, Unparseable, decode, squeeze

_ENTITY = re.compile(r"&([^;]*);")
#: The predefined entities.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_NAME = re.compile(r"[^\s=></]+")
_ATTRIBUTE = re.compile(r"([^\s=></]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]*")


def entities(text: str) -> str:
    """Predefined and numeric references decoded; unknown ones stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in _NAMED:
            return _NAMED[name]
        if len(name) > 1 and name[0] == "#":
            try:
                code = int(name[2:], 16) if name[1] in "xX" else int(name[1:], 10)
                if 0xD800 <= code <= 0xDFFF:
                    raise ValueError
                return chr(code)
            except (ValueError, OverflowError):
                raise Unparseable(f"bad reference {m[0]}") from None
        return m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def parse(data: bytes) -> list[Fact]:
    src, pos = decode(data), 0
    out: list[Fact] = []
    stack: list[list] = []  # name, path, has content, line

    def past(mark: str, start: int) -> int:
        at = src.find(mark, start)
        if at < 0:
            raise Unparseable(f"no {mark}")
        return at + len(mark)

    def text(raw: str, at_line: int) -> None:
        if not (t := squeeze(raw)):
            return
        if not stack:
            raise Unparseable("text outside elements")
        stack[-1][2] = True
        out.append(("kv", f"{stack[-1][1]}={t}", at_line))

    def close() -> None:
        _, path, filled, at_line = stack.pop()
        if not filled:
            out.append(("kv", f"{path}=", at_line))

    seen_line, seen_at = 1, 0
    while pos < len(src):
        seen_line += src.count("\n", seen_at, pos)
        seen_at = pos
        if src[pos] != "<":
            end = src.find("<", pos)
            end = len(src) if end < 0 else end
            text(entities(src[pos:end]), seen_line)
            pos = end
        elif src.startswith("<!--", pos):
            pos = past("-->", pos)
        elif src.startswith("<![CDATA[", pos):
            end = past("]]>", pos)
            text(src[pos + 9 : end - 3], seen_line)
            pos = end
        elif src.startswith("<!", pos):
            pos += 2
            while True:
                m = re.compile(r"[\[>]").search(src, pos)
                if not m:
                    raise Unparseable("open declaration")
                if m[0] == ">":
                    pos = m.end()
                    break
                pos = past("]", m.start())
        elif src.startswith("<?", pos):
            pos = past("?>", pos)
        elif src.startswith("</", pos):
            m = _NAME.match(src, pos + 2)
            end = _SPACE.match(src, m.end()).end() if m else 0
            if not m or src[end : end + 1] != ">" or not stack or stack[-1][0] != m[0]:
                raise Unparseable("unbalanced close")
            close()
            pos = end + 1
        else:
            m = _NAME.match(src, pos + 1)
            if not m:
                raise Unparseable("bad tag")
            path = f"{stack[-1][1]}.{m[0]}" if stack else m[0]
            if stack:
                stack[-1][2] = True
            stack.append([m[0], path, False, seen_line])
            at = m.end()
            while True:
                at = _SPACE.match(src, at).end()
                if src.startswith("/>", at):
                    close()
                    pos = at + 2
                    break
                if src[at : at + 1] == ">":
                    pos = at + 1
                    break
                a = _ATTRIBUTE.match(src, at)
                if not a:
                    raise Unparseable("bad attribute")
                value = a[2] if a[2] is not None else a[3]
                out.append(("kv", f"{path}.{a[1]}={entities(value)}", seen_line + src.count("\n", seen_at, at)))
                stack[-1][2] = True
                at = a.end()
    if stack or not out:
        raise Unparseable("unclosed or no elements")
    return out
