"""Binaries: format tag, executable features, strings, and content-defined chunks."""

from __future__ import annotations

import re
import struct
from bisect import bisect_left

import numpy as np

from factweave.functions.blake3 import blake3_many
from factweave.functions.formats import Digested, Fact, Read, settled

MIN_CHUNK, MAX_CHUNK, MASK_BITS, HASH_BYTES = 256, 8192, 10, 12
MAX_FEATURES, MAX_SECTIONS, MAX_DLLS = 8192, 96, 1024
MIN_STRING, MAX_STRING, MAX_STRINGS = 5, 192, 4096
#: Machine codes.
ELF_MACHINES = {0x03: "x86", 0x3E: "x86_64", 0x28: "arm", 0xB7: "aarch64", 0xF3: "riscv", 0x08: "mips"}
PE_MACHINES = {0x014C: "x86", 0x8664: "x86_64", 0xAA64: "aarch64", 0x01C0: "arm", 0x01C4: "arm"}
MACHO = {b"\xce\xfa\xed\xfe": "mach-o/32", b"\xcf\xfa\xed\xfe": "mach-o/64", b"\xca\xfe\xba\xbe": "mach-o/universal", b"\x00asm": "wasm"}
_PRINTABLE = rb"[\x20-\x7e\t]"


def _gear() -> np.ndarray:
    """The gear table: 256 draws of splitmix64."""
    mask, state, out = (1 << 64) - 1, 0x1234567890ABCDEF, []
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_LOW = (_gear() & np.uint64((1 << MASK_BITS) - 1)).astype(np.int64)


def chunk_bounds(data: bytes) -> list[tuple[int, int]]:
    """Chunks end where the low bits of the gear hash vanish. Only the last ``MASK_BITS`` bytes reach those
    bits, and no chunk is shorter, so one sliding sum serves every chunk: of two bytes, then four, eight and ten."""
    if len(data) <= MIN_CHUNK:
        return [(0, len(data))] if data else []
    two = _LOW[np.frombuffer(data, dtype=np.uint8)]
    two[1:] += two[:-1] << 1
    sums = two.copy()
    sums[2:] += two[:-2] << 2
    sums[4:] += sums[:-4] << 4
    sums[8:] += two[:-8] << 8
    cuts = (np.flatnonzero((sums & ((1 << MASK_BITS) - 1)) == 0) + 1).tolist()
    out, start = [], 0
    while start < len(data):
        i = bisect_left(cuts, start + MIN_CHUNK)
        end = min(cuts[i] if i < len(cuts) else len(data), start + MAX_CHUNK, len(data))
        out.append((start, end))
        start = end
    return out


def chunks(data: bytes) -> list[tuple[str, bytes, int]]:
    """``(hash, bytes, offset)`` of every chunk."""
    bounds = chunk_bounds(data)
    return [(d[:HASH_BYTES].hex(), data[s:e], s) for d, (s, e) in zip(blake3_many([data[s:e] for s, e in bounds]), bounds)]


def format_tag(d: bytes) -> str:
    if d[:4] == b"\x7fELF":
        if len(d) < 20:
            return "elf"
        machine = int.from_bytes(d[18:20], "big" if d[5] == 2 else "little")
        return f"elf/{ELF_MACHINES[machine]}" if machine in ELF_MACHINES else "elf"
    if d[:2] == b"MZ":
        at = int.from_bytes(d[0x3C:0x40], "little") if len(d) >= 0x40 else len(d)
        machine = int.from_bytes(d[at + 4 : at + 6], "little") if d[at : at + 4] == b"PE\0\0" and at + 6 <= len(d) else -1
        return f"pe/{PE_MACHINES[machine]}" if machine in PE_MACHINES else "pe"
    return MACHO.get(d[:4], "ar-archive" if d[:8] == b"!<arch>\n" else "binary")


class _Bytes:
    """Bounded reads; anything outside raises ``IndexError`` and ends the table being read."""

    def __init__(self, data: bytes, big: bool = False):
        self.data, self.order = data, ">" if big else "<"

    def u(self, size: int, at: int) -> int:
        if at < 0 or at + size > len(self.data):
            raise IndexError(at)
        return int.from_bytes(self.data[at : at + size], "big" if self.order == ">" else "little")

    def name(self, at: int, most: int | None = None) -> str | None:
        """NUL-terminated text at an offset; with ``most``, printable and shorter than that."""
        if not 0 <= at < len(self.data):
            return None
        end = self.data.find(b"\0", at, None if most is None else at + most)
        if end <= at:
            return None
        raw = self.data[at:end]
        if most is not None and not re.fullmatch(_PRINTABLE + rb"+", raw):
            return None
        return raw.decode("utf-8", "backslashreplace")


class _Bag:
    def __init__(self) -> None:
        self.facts: list[Fact] = []
        self.counts: dict[str, int] = {}

    def add(self, key: str, value: str | None) -> None:
        if value is not None and self.counts.get(key, 0) < MAX_FEATURES:
            self.counts[key] = self.counts.get(key, 0) + 1
            self.facts.append(("kv", f"{key}[]={value}", 0))


def _elf(d: bytes, bag: _Bag) -> None:
    if len(d) < 24 or d[4] not in (1, 2):
        return
    wide, b = d[4] == 2, _Bytes(d, d[5] == 2)
    word = 8 if wide else 4
    off_at, size_at, link_at = (0x18, 0x20, 0x28) if wide else (0x10, 0x14, 0x18)
    table = b.u(word, 0x28 if wide else 0x20)
    entry, count, names = (b.u(2, x) for x in ((0x3A, 0x3C, 0x3E) if wide else (0x2E, 0x30, 0x32)))
    if not entry or not count:
        return
    name_table = b.u(word, table + names * entry + off_at)

    def linked(header: int) -> tuple[int, int, int]:
        link = b.u(4, header + link_at)
        if link >= count:
            raise IndexError(link)
        return b.u(word, header + off_at), b.u(word, header + size_at), b.u(word, table + link * entry + off_at)

    def symbols(header: int) -> None:
        start, size, texts = linked(header)
        step = 24 if wide else 16
        for k in range(1, min(size, len(d)) // step):
            at = start + k * step
            info, section = (b.u(1, at + 4), b.u(2, at + 6)) if wide else (b.u(1, at + 12), b.u(2, at + 14))
            name = b.name(texts + b.u(4, at))
            if info & 15 not in (1, 2) or name is None:
                continue
            if section == 0:
                bag.add("imports", name.partition("@")[0])
            elif info >> 4 in (1, 2) and section < 0xFF00:
                bag.add("exports", name.partition("@")[0])

    def needed(header: int) -> None:
        start, size, texts = linked(header)
        for k in range(min(size, len(d)) // (2 * word)):
            tag, value = b.u(word, start + 2 * k * word), b.u(word, start + (2 * k + 1) * word)
            if tag == 0:
                return
            if tag == 1:
                bag.add("needs", b.name(texts + value))

    for k in range(count):
        header = table + k * entry
        try:
            bag.add("sections", b.name(name_table + b.u(4, header)))
            kind = b.u(4, header + 4)
        except IndexError:
            continue
        for kinds, read in (((2, 11), symbols), ((6,), needed)):
            if kind in kinds:
                try:
                    read(header)
                except IndexError:
                    pass


def _pe(d: bytes, bag: _Bag) -> None:
    b = _Bytes(d)
    at = b.u(4, 0x3C)
    if at + 24 > len(d) or d[at : at + 4] != b"PE\0\0":
        return
    optional = at + 24
    wide = b.u(2, optional) == 0x20B
    first = optional + b.u(2, at + 20)
    sections = []
    for k in range(min(b.u(2, at + 6), MAX_SECTIONS)):
        s = first + 40 * k
        if s + 40 > len(d):
            break
        raw = d[s : s + 8].partition(b"\0")[0]
        if re.fullmatch(_PRINTABLE + rb"+", raw):
            bag.add("sections", raw.decode())
        size, va, raw_size, raw_at = struct.unpack_from("<4I", d, s + 8)
        sections.append((va, max(size, raw_size), raw_at))

    def place(rva: int) -> int:
        for va, span, raw_at in sections:
            if va <= rva < va + span:
                return raw_at + rva - va
        raise IndexError(rva)

    directories = optional + (0x70 if wide else 0x60)

    def imports() -> None:
        rva = b.u(4, directories + 8)
        entry = place(rva) if rva else len(d)
        for _ in range(MAX_DLLS):
            if entry + 20 > len(d):
                return
            lookup, _, _, name, iat = struct.unpack_from("<5I", d, entry)
            entry += 20
            if not (lookup or name or iat):
                return
            try:
                bag.add("needs", b.name(place(name), 128) if name else None)
            except IndexError:
                pass
            try:
                thunk, step = place(lookup or iat), 8 if wide else 4
                for _ in range(MAX_FEATURES):
                    value = b.u(step, thunk)
                    thunk += step
                    if not value:
                        break
                    if value >> (8 * step - 1):
                        continue
                    try:
                        bag.add("imports", b.name(place(value & 0x7FFFFFFF) + 2, 256))
                    except IndexError:
                        continue
            except IndexError:
                continue

    def exports() -> None:
        rva = b.u(4, directories)
        if not rva:
            return
        table = place(rva)
        names = place(b.u(4, table + 32))
        for k in range(min(b.u(4, table + 24), MAX_FEATURES)):
            name = b.u(4, names + 4 * k)
            try:
                bag.add("exports", b.name(place(name), 256))
            except IndexError:
                continue

    for read in (imports, exports):
        try:
            read()
        except IndexError:
            pass


def _macho(d: bytes, bag: _Bag) -> None:
    b = _Bytes(d)
    wide = d[:4] == b"\xcf\xfa\xed\xfe"
    at = 32 if wide else 28
    segment, count_at, first, step = (0x19, 64, 72, 80) if wide else (0x1, 48, 56, 68)

    def fixed(raw: bytes) -> str:
        raw = raw.partition(b"\0")[0]
        return raw.decode() if re.fullmatch(_PRINTABLE + rb"*", raw) else ""

    def symbols() -> None:
        start, count, texts = b.u(4, at + 8), b.u(4, at + 12), b.u(4, at + 16)
        for k in range(min(count, MAX_FEATURES)):
            e = start + k * (16 if wide else 12)
            kind = b.u(1, e + 4)
            if kind & 0xE0 or not kind & 1 or (name := b.name(texts + b.u(4, e), 256)) is None:
                continue
            name = name[1:] if len(name) > 1 and name[0] == "_" else name
            key = {0x0: "imports", 0xE: "exports"}.get(kind & 0xE)
            if key:
                bag.add(key, name)

    for _ in range(min(b.u(4, 16), MAX_FEATURES)):
        command, size = b.u(4, at), b.u(4, at + 4)
        if size < 8 or at + size > len(d):
            return
        if command == segment:
            for k in range(min(b.u(4, at + count_at), MAX_SECTIONS)):
                s = at + first + k * step
                if s + 32 <= len(d) and (name := fixed(d[s : s + 16])):
                    bag.add("sections", f"{fixed(d[s + 16 : s + 32])},{name}")
        elif command == 0x2:
            try:
                symbols()
            except IndexError:
                pass
        at += size


_ASCII, _WIDE = re.compile(_PRINTABLE + rb"{%d,}" % MIN_STRING), re.compile(rb"(?:" + _PRINTABLE + rb"\0){%d,}" % MIN_STRING)
#: Printable bytes as ``P``, NUL as itself, others as ``x``; and what every wide string then holds.
_ROLES = bytes(0 if i == 0 else ord("P") if 0x20 <= i <= 0x7E or i == 9 else ord("x") for i in range(256))
_WIDE_ROLES = b"P\0" * MIN_STRING


def strings(d: bytes) -> list[str]:
    """Distinct printable runs, ASCII first, then UTF-16LE (looked for one by one only where there are any)."""
    found: dict[str, None] = {}
    for pattern, code in ((_ASCII, "ascii"), *(((_WIDE, "utf-16-le"),) if _WIDE_ROLES in d.translate(_ROLES) else ())):
        for m in pattern.finditer(d):
            if len(found) >= MAX_STRINGS:
                break
            found.setdefault(m[0].decode(code)[:MAX_STRING])
    return list(found)


def read(data: bytes) -> list[Read]:
    """The facts of a binary; the digests of its chunks are left to be taken with those of others."""
    bag = _Bag()
    try:
        if data[:4] == b"\x7fELF":
            _elf(data, bag)
        elif data[:2] == b"MZ":
            _pe(data, bag)
        elif data[:4] in (b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe"):
            _macho(data, bag)
    except IndexError:
        pass
    head: list[Fact] = [("kv", f"binary.format={format_tag(data)}", 0)]
    return head + bag.facts + [("kv", f"strings[]={s}", 0) for s in strings(data)] + [("chunk", Digested("", data[s:e], HASH_BYTES), s) for s, e in chunk_bounds(data)]


def parse(data: bytes) -> list[Fact]:
    return settled([read(data)])[0]
