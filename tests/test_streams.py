"""Both wire formats as streams: what a task holds doesn't follow the number of a profile's records."""

import random
import tracemalloc
import zlib

import pytest

from tickloom import schemas
from tickloom.sources import binary, wire_v5, wire_v6
from tickloom.sources.wire_v5 import BadProfile

SIDE = {"source": [[1, 2, "text"]], "index": [[1, 2, 3, "k"]], "summary": [[4, 5, 6, "z"]]}
#: A registered query's options of the encoder.
FORMS = {
    "v5_roundtrip": ("v5", {}),
    "v6_packed_roundtrip": ("v6", {"packed": True, "runs": True, "strings": True, "codec": wire_v6.ZSTD, "split_bytes": 4000}),
    "salvage_prefix": ("v6", {"per_chunk": 100, "codec": wire_v6.NONE}),
    "v6_mixed_roundtrip": ("v6", {"side": SIDE, "codec": wire_v6.LZ4, "codecs": {wire_v6.SOURCE: wire_v6.ZLIB, wire_v6.INDEX: wire_v6.ZSTD}}),
    "v6_roundtrip": ("v6", {}),
}


def records(n, seed=0):
    """Of all kinds that both formats hold, one at a time."""
    rng = random.Random(seed)
    for i in range(n):
        k = i % 4
        if k == 0:
            yield "TIME_BLOCK", [rng.randrange(1 << rng.randrange(1, 31)), rng.randrange(900), rng.randrange(300), rng.randrange(300), 0]
        elif k == 1:
            yield "TIME_LINE", [rng.randrange(1 << 20), 17, rng.randrange(2)]
        elif k == 2:
            yield "SUB_CALLERS", [rng.randrange(900), 6, 0, float(rng.randrange(10**7)), 0.0, 3.0, 1, f"P{rng.randrange(40)}::f", "main::" + "é" * rng.randrange(90)]
        else:
            yield rng.choice([("SUB_ENTRY", [17, 6]), ("DISCOUNT", []), ("SRC_LINE", [6, 0, f"text {rng.randrange(1000)}\n"]), ("PID_END", [rng.randrange(1 << 30), 5.0])])


@pytest.mark.parametrize("name", FORMS)
def test_memory_does_not_follow_the_records(tmp_path, name):
    wire, options = FORMS[name]
    peaks = []
    for n in (30_000, 90_000):
        tracemalloc.start()
        with open(tmp_path / "p", "wb") as f:
            f.writelines(binary._pieces(records(n), wire, options))
        with open(tmp_path / "p", "rb") as f:
            if name == "salvage_prefix":
                assert binary._salvage_counts(f)[1] == n + 1
            else:
                assert sum(b.num_rows for b in binary._rows(binary.decode(f, mixed=True), "p")) == n + (2 if wire == "v5" else 1)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize("name", FORMS)
def test_rows_are_the_records_in_order(name):
    wire, options = FORMS[name]
    want = list(records(25_000, 1))
    raw = b"".join(binary._pieces(iter(want), wire, options))
    rows = [r for b in binary._rows(binary.decode(raw, mixed=True), "p") for r in b.to_pylist()]
    extra = 2 if wire == "v5" else 1
    assert [r["seq"] for r in rows] == list(range(len(want) + extra))
    assert [(r["tag"], [r[c] for c, _ in schemas.TAGS[r["tag"]]]) for r in rows[extra:]] == want


def plainly_salvaged(raw):
    """The longest start of whole chunks, each tried from its first byte."""
    head, at = wire_v6.header(raw)
    ends, bodies, strings = [at], [], wire_v6.Strings(b"")
    try:
        for kind, body, end in wire_v6.chunks(raw, at):
            strings = wire_v6.Strings(body) if kind == wire_v6.FOOTER else strings
            bodies.append(body if kind == wire_v6.EVENT else b"")
            ends.append(end)
    except BadProfile:
        pass
    for n in range(len(bodies), -1, -1):
        try:
            rows = [wire_v6._event(t, v) for t, v, _ in wire_v6._Records(iter([b"".join(bodies[:n])]), strings)]
        except BadProfile:
            continue
        return [("VERSION", [head["major"], head["minor"]]), *rows], ends[n]


@pytest.mark.parametrize("options", [{"per_chunk": 3}, {"split_bytes": 7}, {"split_bytes": 40, "packed": True, "runs": True}, {"split_bytes": 50, "strings": True}, {"per_chunk": 5, "side": SIDE}])
def test_salvage_by_chunks(monkeypatch, options):
    """Records over many chunks, cut anywhere or damaged, read in small pieces too."""
    rng = random.Random(3)
    want = list(records(60, 2))
    raw = wire_v6.encode(want, **options)
    for piece in (1, 1 << 16):
        monkeypatch.setattr(wire_v6, "PIECE", piece)
        assert list(wire_v6.decode(raw, mixed=True))[1:] == want
        for n in range(45, len(raw), 11):
            x = bytearray(raw[: n if n % 2 else len(raw)])
            x[n - 1] ^= rng.randrange(2)
            got = wire_v6.salvage(bytes(x))
            assert got == plainly_salvaged(bytes(x)) and wire_v6.salvaged(bytes(x)) == (len(got[0]), got[1])


@pytest.mark.parametrize("version, tail", [(b"\x11\x00\x06\x00", b""), (b"\x11\x08\x05\x06\x00", b"\x0c\x00"), (b"\x11\x00\x05\x00", b"")])
def test_version_within_the_body(version, tail):
    """One is put first only where the body has none, however late; bytes that look like one don't count."""
    alike = b"\x04\x00\x11\x06" + b"\x0f\x00\x00\x04\x00\x11\x00\x06\x00"  # SUB_ENTRY of file 17, and such a comment
    many = alike * 5000 + b"\x12\x00\x11\x06\x02\x01\x02" + b"\x63\x02\x03\x11\x06\x00"  # a run, and an opcode that isn't known
    for body in (many, many + version + tail):
        raw = wire_v6.encode([])
        at = wire_v6.header(raw)[1]
        raw = raw[:at] + wire_v6.FRAME.pack(wire_v6.SYNC, wire_v6.EVENT, wire_v6.NONE, 1, 0, 0, 0, len(body), len(body), zlib.crc32(body)) + body + raw[at:]
        if version[-2] == 5 and body is not many:
            with pytest.raises(BadProfile, match="VERSION"):
                list(wire_v6.decode(raw))
            continue
        got = list(wire_v6.decode(raw))
        assert [i for i, (t, _) in enumerate(got) if t == "VERSION"] == [0 if body is many else 10_002]


def test_strings_beyond_the_dictionary_stand_inline(monkeypatch):
    monkeypatch.setattr(wire_v6, "FULL_BOOK", 1000)
    want = [("SRC_LINE", [1, n, f"line {n % 50}"]) for n in range(30_000)] + [("SRC_LINE", [1, n, f"other {n}"]) for n in range(30_000)]
    raw = wire_v6.encode(want + want, strings=True)
    assert list(wire_v6.decode(raw))[1:] == want + want


def test_v5_strings_longer_than_a_piece():
    want = [("ATTRIBUTE", ["k", "v" * 200_000]), ("SRC_LINE", [1, 1, "é" * 300_000]), ("PID_END", [2**32 - 1, 1.5])]
    raw = wire_v5.encode(want)
    assert [r for r in wire_v5.decode(raw) if r[0] not in ("VERSION", "START_DEFLATE")] == want
    for n in (len(raw) - 1, len(raw) // 2):
        assert [t for t, _ in wire_v5.salvage(raw[:n])[0]] in (["VERSION", "ATTRIBUTE"], ["VERSION"])
