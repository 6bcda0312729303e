"""Round trips and damage of both wire formats."""

import random

import pytest

from tickloom.sources import wire_v5, wire_v6
from tickloom.sources.wire_v5 import BadProfile


def test_packed_integers():
    for n in (0, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2**32 - 1):
        assert wire_v5._unsigned(wire_v5._Source(wire_v5.pack(n), 0)) == n
    with pytest.raises(BadProfile):
        wire_v5.pack(2**32)


def test_v5_round_trip_and_every_cut(workload):
    raw = wire_v5.encode(workload)
    assert list(wire_v5.decode(raw)) == workload
    for n in range(len(raw)):
        if n < len(raw) - 1:
            try:
                assert list(wire_v5.decode(raw[:n])) != workload
            except BadProfile:
                pass
        got, used = wire_v5.salvage(raw[:n])
        assert workload[: len(got)] == got and used <= n


def test_v5_negative_ticks_come_back_unsigned():
    raw = wire_v5.encode([("VERSION", [5, 0]), ("TIME_LINE", [-3, 1, 1])])
    assert ("TIME_LINE", [2**32 - 3, 1, 1]) in list(wire_v5.decode(raw))


def test_v5_refuses():
    for bad in ([("TIME_LINE", [1, 1, 1]), ("VERSION", [5, 0])], [("START_DEFLATE", []), ("START_DEFLATE", [])], [("NO_SUCH", [])]):
        with pytest.raises(BadProfile):
            wire_v5.encode(bad)
    for raw in (b"", b"else 5 0\n", wire_v5.MAGIC + b"4 0\n", wire_v5.MAGIC + b"5 0\n?"):
        with pytest.raises(BadProfile):
            list(wire_v5.decode(raw))


OPTIONS = [{}, {"packed": True}, {"strings": True}, {"runs": True}, {"packed": True, "runs": True, "strings": True, "per_chunk": 5}, {"split_bytes": 13}, {"codec": wire_v6.NONE}, {"codec": wire_v6.ZSTD}, {"codec": wire_v6.LZ4}]


def _v6(workload):
    return [("VERSION", [6, 0]), *[(t, [a[0], 0, 0, 0, 0, 0, a[6]]) if t == "NEW_FID" else (t, [*a[:3], 0.0, 0.0, 0.0, *a[6:]]) if t == "SUB_CALLERS" else (t, a) for t, a in workload[1:]]]


@pytest.mark.parametrize("options", OPTIONS)
def test_v6_round_trip(workload, options):
    events = _v6(workload)
    assert list(wire_v6.decode(wire_v6.encode(events, **options))) == events


def test_v6_codec_switch(workload):
    """Events up to START_DEFLATE in one codec, those after it in another; sites and sequence numbers go on."""
    for options in ({}, {"packed": True, "runs": True}):
        raw = wire_v6.encode(_v6(workload), switch=(wire_v6.NONE, wire_v6.ZSTD), **options)
        assert list(wire_v6.decode(raw)) == _v6(workload)
        at, seen = wire_v6.header(raw)[1], []
        while at < len(raw):
            f = wire_v6.FRAME.unpack_from(raw, at)
            seen.append((f[1], f[2]))
            at += wire_v6.FRAME.size + f[8]
        assert seen == [(wire_v6.EVENT, wire_v6.NONE), (wire_v6.EVENT, wire_v6.ZSTD), (wire_v6.FOOTER, wire_v6.NONE)]
    for switch, events in (((0, 0), _v6(workload)), ((0, 1), [("TIME_LINE", [1, 1, 1])])):
        with pytest.raises(BadProfile):
            wire_v6.encode(events, switch=switch)


def test_v6_mixed_kinds(workload):
    side = {"source": [[1, 2, "text"]], "index": [[1, 2, 3, "k"]], "summary": [[4, 5, 6, "z"]]}
    raw = wire_v6.encode(_v6(workload), side=side, strings=True, codecs={wire_v6.SOURCE: wire_v6.NONE})
    assert wire_v6.side_records(raw) == side
    assert list(wire_v6.decode(raw, mixed=True)) == _v6(workload)
    with pytest.raises(BadProfile):
        list(wire_v6.decode(raw))


def test_v6_salvage_keeps_a_start(workload):
    events = _v6(workload)
    raw = wire_v6.encode(events, per_chunk=4)
    for n in range(0, len(raw), 7):
        try:
            got, used = wire_v6.salvage(raw[:n])
        except BadProfile:
            continue
        assert events[: len(got)] == got and used <= n


def test_damage_never_does_worse_than_raise(workload):
    rng = random.Random(0)
    for raw, decode in ((wire_v5.encode(workload), wire_v5.decode), (wire_v6.encode(_v6(workload)), wire_v6.decode)):
        for _ in range(400):
            x = bytearray(raw)
            x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
            try:
                list(decode(bytes(x)))
            except BadProfile:
                pass


def test_v6_refuses_what_it_cannot_hold():
    for bad in ([("PID_END", [1, 0.5])], [("TIME_BLOCK", [1, 1, 1, 1, 2])], [("NEW_FID", [1, 2, 0, 0, 0, 0, "x"])], [("TIME_LINE", [-1, 1, 1])]):
        with pytest.raises(BadProfile):
            wire_v6.encode(bad)
