"""Text lines of PDF content streams: plain or deflated streams, simple fonts only."""

from __future__ import annotations

import re
import zlib

from factweave.functions.formats import Fact, Unparseable, decode, squeeze

MAX_INFLATED = 32 << 20
MIN_PRINTABLE = 0.7
WORD_GAP = -100
_LITERAL_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
_TOKEN = re.compile(rb"%[^\r\n]*|/[^\s/\[\]()<>]*|[+\-.0-9][0-9.]*|[A-Za-z'\"*][A-Za-z0-9*']*|<<|[()<>\[\]]", re.S)
_NEW_LINE = (b"Td", b"TD", b"T*", b"Tm", b"ET", b"BT")


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A ``(...)`` string from just after its opening parenthesis."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            at += 1
            if e == b"\r" and data[at : at + 1] == b"\n":
                at += 1
            if e not in (b"\r", b"\n"):
                out += _LITERAL_ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    raise Unparseable("open string")


def _hexadecimal(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b">", at)
    if end < 0:
        raise Unparseable("open hex string")
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1


def _readable(s: bytes) -> bool:
    return bool(s) and 0 not in s and sum(c >= 32 or c in b"\n\r\t" for c in s) >= MIN_PRINTABLE * len(s)


class _Lines:
    def __init__(self) -> None:
        self.facts: list[Fact] = []
        self.text = b""

    def flush(self) -> None:
        if line := squeeze(decode(self.text)):
            self.facts.append(("line", line, len(self.facts) + 1))
        self.text = b""

    def show(self, s: bytes) -> None:
        self.text += (b" " if self.text else b"") + s

    def run(self, data: bytes) -> None:
        """Evaluate one content stream."""
        shown, in_array, number, at = b"", False, 0.0, 0
        while m := _TOKEN.search(data, at):
            t, at = m[0], m.end()
            if t in (b"(", b"<"):
                s, at = (_literal if t == b"(" else _hexadecimal)(data, at)
                shown += (b" " if in_array and number < WORD_GAP else b"") + (s if _readable(s) else b"")
                number = 0.0
            elif t in (b"[", b"]"):
                in_array = t == b"["
                number = 0.0 if in_array else number
            elif t[:1] in b"+-.0123456789":
                try:
                    number = float(t)
                except ValueError:
                    number = 0.0
            elif t[:1].isalpha() or t[:1] in b"'\"*":
                if t in (b"Tj", b"TJ"):
                    self.show(shown)
                elif t in (b"'", b'"'):
                    self.flush()
                    self.text = shown
                elif t in _NEW_LINE:
                    self.flush()
                elif t == b"BI":
                    end = data.find(b"EI", at)
                    at = end + 2 if end >= 0 else len(data)
                shown = b""


def parse(data: bytes) -> list[Fact]:
    if not data.startswith(b"%PDF-"):
        raise Unparseable("not a PDF")
    lines, pos = _Lines(), 0
    while (kw := data.find(b"stream", pos)) >= 0:
        pos = kw + 6
        if kw and data[kw - 1 : kw] not in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c", b">", b"]", b")"):
            continue
        start = pos + (data[pos : pos + 1] == b"\r")
        start += data[start : start + 1] == b"\n"
        end = data.find(b"endstream", start)
        if end < 0:
            break
        pos = end + 9
        body, head = data[start:end].rstrip(b"\r\n"), data[max(0, data.rfind(b"obj", 0, kw)) : kw]
        if b"/FlateDecode" in head:
            try:
                inflater = zlib.decompressobj()
                body = inflater.decompress(body, MAX_INFLATED)
                if not inflater.eof:
                    continue
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" in body:
            lines.run(body)
    lines.flush()
    return lines.facts
