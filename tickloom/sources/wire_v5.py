"""The older binary profile format: reading and writing the bytes of one file.

A text header line, then records of one tag byte each. `#`, `:` and `!` take the rest of a line; `z` turns what follows
into one zlib stream; the other tags are binary. Integers are packed by their first byte, big-endian; floats are eight
little-endian bytes; strings are a kind byte, a packed length and bytes. Files are read and written piece by piece, and
records come and go one at a time, so memory doesn't follow the file's length.
"""

from __future__ import annotations

import io
import itertools
import struct
import zlib
from collections.abc import Iterator

#: Fixed values of the format.
MAGIC, MAJOR = b"NYTProf ", 5
BYTES = {
    "START_DEFLATE": b"z", "PID_START": b"P", "PID_END": b"p", "NEW_FID": b"@", "TIME_LINE": b"+", "TIME_BLOCK": b"*", "DISCOUNT": b"-",
    "SUB_ENTRY": b">", "SUB_RETURN": b"<", "SUB_INFO": b"s", "SUB_CALLERS": b"c", "SRC_LINE": b"S", "COMMENT": b"#", "ATTRIBUTE": b":", "OPTION": b"!",
}
#: Arguments as they stand in the file, by their place among the record's arguments: u integer, i signed, n float, s string.
LAYOUT: dict[str, list[tuple[int, str]]] = {
    "TIME_LINE": [(0, "i"), (1, "u"), (2, "u")],
    "TIME_BLOCK": [(0, "i"), (1, "u"), (2, "u"), (3, "u"), (4, "u")],
    "DISCOUNT": [],
    "NEW_FID": [(0, "u"), (1, "u"), (2, "u"), (3, "u"), (4, "u"), (5, "u"), (6, "s")],
    "SRC_LINE": [(0, "u"), (1, "u"), (2, "s")],
    "SUB_ENTRY": [(0, "u"), (1, "u")],
    "SUB_RETURN": [(0, "u"), (1, "n"), (2, "n"), (3, "s")],
    "SUB_INFO": [(0, "u"), (3, "s"), (1, "u"), (2, "u")],
    "SUB_CALLERS": [(0, "u"), (1, "u"), (8, "s"), (2, "u"), (3, "n"), (4, "n"), (5, "n"), (6, "u"), (7, "s")],
    "PID_START": [(0, "u"), (1, "u"), (2, "n")],
    "PID_END": [(0, "u"), (1, "n")],
}
_TAGS = {v: k for k, v in BYTES.items()}
MOST_STRING = 64 << 20
#: Bytes read, compressed and inflated at once.
PIECE, MOST_INFLATED = 1 << 16, 1 << 20


class BadProfile(ValueError):
    """Bytes that aren't a profile."""


class CutShort(BadProfile):
    """A profile that ends within a record."""


def pack(n: int) -> bytes:
    """An unsigned 32-bit integer in one to five bytes."""
    if n < 0 or n > 0xFFFFFFFF:
        raise BadProfile(f"{n} isn't an unsigned 32-bit integer")
    if 0x4000 <= n < 0x10000000:
        return (n | 0xC00000).to_bytes(3, "big") if n < 0x200000 else (n | 0xE0000000).to_bytes(4, "big")
    for extra, limit, mark in ((0, 0x80, 0x00), (1, 0x4000, 0x80)):
        if n < limit:
            raw = bytearray(n.to_bytes(extra + 1, "big"))
            raw[0] |= mark
            return bytes(raw)
    return b"\xff" + n.to_bytes(4, "big")


class _Source:
    """Bytes to be read on, of bytes or an open file: the file's, then from `z` on the inflated ones. held has some of
    them, from place on; more() gets more."""

    def __init__(self, raw, at: int = 0):
        self.file = opened(raw)
        self.file.seek(at)
        self.inflate, self.rest, self.held, self.place, self.ended = None, b"", b"", 0, False

    def deflated(self) -> None:
        if self.inflate is not None:
            raise BadProfile("compressed twice")
        self.inflate, self.rest, self.held, self.place = zlib.decompressobj(), self.held[self.place :], b"", 0

    def more(self) -> bool:
        while not self.ended:
            piece, self.rest = self.rest or self.file.read(PIECE), b""
            got = piece
            if self.inflate is not None:
                if self.inflate.eof or not piece:
                    self.ended = True
                    if not self.inflate.eof:
                        raise CutShort("the compressed part isn't ended")
                    return False
                try:
                    got = self.inflate.decompress(piece, MOST_INFLATED)
                except zlib.error as e:
                    raise BadProfile(f"compressed part: {e}") from e
                self.rest = self.inflate.unconsumed_tail
            elif not piece:
                self.ended = True
            if got:
                self.held, self.place = self.held[self.place :] + got, 0
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.held) - self.place < n and self.more():
            pass
        out = self.held[self.place : self.place + n]
        self.place += n
        if len(out) < n:
            raise CutShort("ends within a record")
        return out

    def done(self) -> bool:
        return self.place >= len(self.held) and not self.more()

    def line(self) -> bytes:
        out = bytearray()
        while True:
            end = self.held.find(b"\n", self.place)
            if end >= 0:
                out += self.take(end + 1 - self.place)
                return bytes(out)
            out += self.held[self.place :]
            self.held, self.place = b"", 0
            if not self.more():
                raise CutShort("ends within a line")


def _unsigned(s: _Source) -> int:
    first = s.take(1)[0]
    if first < 0x80:
        return first
    extra, mask = _WIDTH[first]
    return int.from_bytes(bytes([first & mask]) + s.take(extra), "big")


#: first byte of an integer -> how many follow, and what of the first counts.
_WIDTH = [(0, 0x7F) if b < 0x80 else (1, 0x3F) if b < 0xC0 else (2, 0x1F) if b < 0xE0 else (3, 0x0F) if b < 0xFF else (4, 0) for b in range(256)]
_DOUBLE = struct.Struct("<d")
_PLANS = {BYTES[tag][0]: (tag, layout) for tag, layout in LAYOUT.items()}


def _held(s: _Source) -> Iterator[tuple[str, list]]:
    """The binary records that come next, up to a byte that begins none. One that ends beyond what is held is read once
    more when there is more."""
    unpack, width = _DOUBLE.unpack_from, _WIDTH
    while not s.done():
        raw, at, size = s.held, s.place, len(s.held)
        try:
            while at < size:
                plan = _PLANS.get(raw[at])
                if plan is None:
                    return
                at += 1
                tag, layout = plan
                args = [None] * len(layout)
                for place, kind in layout:
                    if kind == "n":
                        args[place] = unpack(raw, at)[0]
                        at += 8
                        continue
                    if kind == "s":
                        if raw[at] not in (39, 34):
                            raise BadProfile(f"a string begins with {raw[at : at + 1]!r}")
                        at += 1
                    n = raw[at]
                    at += 1
                    if n > 127:  # negative counts are read as unsigned
                        extra, mask = width[n]
                        if at + extra > size:
                            raise IndexError
                        n = int.from_bytes(raw[at : at + extra], "big") | (n & mask) << 8 * extra
                        at += extra
                    if kind == "s":
                        if n > MOST_STRING:
                            raise BadProfile(f"a string of {n} bytes")
                        if at + n > size:
                            raise IndexError
                        n, at = raw[at : at + n].decode("utf-8", "replace"), at + n
                    args[place] = n
                s.place = at
                yield tag, args
        except (IndexError, struct.error):
            if not s.more():
                raise CutShort("ends within a record") from None


def opened(raw):
    """bytes as a file; an open file as it is."""
    return raw if hasattr(raw, "read") else io.BytesIO(raw)


def decode(raw) -> Iterator[tuple[str, list]]:
    """(tag, arguments) of each record of bytes or an open file; raises where the bytes are bad or cut short."""
    raw = opened(raw)
    raw.seek(0)
    start = raw.read(64)
    end = start.find(b"\n")
    if not start.startswith(MAGIC) or end < 0:
        raise BadProfile("no header of this format")
    try:
        major, minor = (int(x) for x in start[len(MAGIC) : end].split())
    except ValueError as e:
        raise BadProfile("header without a version") from e
    if major != MAJOR:
        raise BadProfile(f"version {major}")
    yield "VERSION", [major, minor]
    s = _Source(raw, end + 1)
    while not s.done():
        byte = s.take(1)
        tag = _TAGS.get(byte)
        if tag is None:
            raise BadProfile(f"unknown tag {byte!r}")
        if tag == "COMMENT":
            yield tag, [s.line().decode("utf-8", "replace")]
        elif tag in ("ATTRIBUTE", "OPTION"):
            key, eq, value = s.line().rstrip(b"\n").partition(b"=")
            if not eq:
                raise BadProfile("a key without a value")
            yield tag, [key.decode("utf-8", "replace"), value.decode("utf-8", "replace")]
        elif tag == "START_DEFLATE":
            yield tag, []
            s.deflated()
        else:
            s.place -= 1
            yield from _held(s)


def salvaged(raw) -> tuple[int, int]:
    """How many records are before the first bad byte, and how many bytes they took. The compressed part counts as a
    whole or not at all: of one that is damaged or cut, nothing is kept but the records before it."""
    raw = opened(raw)
    kept = used = n = 0
    deflated = False
    try:
        for tag, args in decode(raw):
            deflated |= tag == "START_DEFLATE"
            n += 1
            if deflated:
                continue
            kept = n
            if n == 1:
                raw.seek(0)
                used = raw.read(64).find(b"\n") + 1
                raw.seek(used)
            else:
                used += len(_record(tag, args))
    except BadProfile:
        return kept, used
    return n, raw.seek(0, 2)


def salvage(raw) -> tuple[list[tuple[str, list]], int]:
    """The records that salvaged() counts, and their bytes."""
    _, used, rows = start(opened(raw))
    return list(rows), used


def start(raw) -> tuple[int, int, Iterator[tuple[str, list]]]:
    """salvaged() of an open file, and the records."""
    n, used = salvaged(raw)
    return n, used, itertools.islice(decode(raw), n)


def _packed(tag: str, v, signed: bool = False) -> bytes:
    if type(v) is int and v >= 0:
        return pack(v)
    if v is None or int(v) != v:
        raise BadProfile(f"{tag}: {v!r} isn't an integer")
    return pack(int(v) & 0xFFFFFFFF if signed and v < 0 else int(v))


_SMALL = [pack(n) for n in range(0x4000)]


def _record(tag: str, args: list) -> bytes:
    if tag == "COMMENT":
        return b"#" + args[0].encode()
    if tag in ("ATTRIBUTE", "OPTION"):
        return BYTES[tag] + f"{args[0]}={args[1]}\n".encode()
    if tag not in BYTES:
        raise BadProfile(f"unknown tag {tag}")
    parts = [BYTES[tag]]
    for place, kind in LAYOUT.get(tag, ()):
        v = args[place]
        if kind == "n":
            parts.append(_DOUBLE.pack(v))
        elif kind == "s":
            b = (v or "").encode()
            parts.append((b"'" if b.isascii() else b'"') + (_SMALL[len(b)] if len(b) < 0x4000 else pack(len(b))) + b)
        else:
            parts.append(_SMALL[v] if type(v) is int and 0 <= v < 0x4000 else _packed(tag, v, kind == "i"))
    return b"".join(parts)


def encode(records: list[tuple[str, list]] | Iterator[tuple[str, list]], *, minor: int = 0) -> bytes:
    """The file of these records, whole."""
    return b"".join(pieces(records, minor=minor))


def pieces(records: list[tuple[str, list]] | Iterator[tuple[str, list]], *, minor: int = 0) -> Iterator[bytes]:
    """The file of these records, piece by piece. VERSION may only come first; binary records are compressed from the
    first one on, and a START_DEFLATE says so even where none was given."""
    out, pack_, first, headed, size = [], None, True, False, 0
    for tag, args in records:
        if tag == "VERSION":
            if not first or int(args[0]) not in (5, 6):
                raise BadProfile("VERSION comes first, and is 5 or 6")
            minor = int(args[1]) if int(args[0]) == MAJOR else 0
            first = False
            continue
        if not headed:
            yield MAGIC + f"{MAJOR} {minor}\n".encode()
            headed = True
        first = False
        binary = tag not in ("COMMENT", "ATTRIBUTE", "OPTION")
        if tag == "START_DEFLATE" or (binary and pack_ is None):
            if pack_ is not None:
                raise BadProfile("compressed twice")
            yield b"".join([*out, b"z"])
            out, pack_, size = [], zlib.compressobj(6), 0
            if tag == "START_DEFLATE":
                continue
        raw = _record(tag, args)
        out.append(raw)
        size += len(raw)
        if size >= PIECE:
            whole = b"".join(out)
            yield pack_.compress(whole) if pack_ else whole
            out, size = [], 0
    if not headed:
        yield MAGIC + f"{MAJOR} {minor}\n".encode()
    whole = b"".join(out)
    yield pack_.compress(whole) + pack_.flush() if pack_ else whole
