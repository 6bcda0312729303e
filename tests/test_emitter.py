"""The emitter's buffer, seals, states and retries, and what readers see of it."""

import os

import pytest

from tickloom.streaming import emitter
from tickloom.streaming.emitter import BadState, Emitter


def test_buffer_and_seals(tmp_path):
    now = [0.0]
    e = Emitter(str(tmp_path), "p", records=4, text=100, clock=lambda: now[0])
    e.activate()
    assert [e.emit("SUB_ENTRY", 1, i) for i in range(3)] == [0, 1, 2] and len(e.buffer) == 3 and e.file is None
    e.emit("SUB_ENTRY", 1, 3)
    assert not e.buffer and e.counts["high_water"] == 1 and os.listdir(e.home) == [".00000000.part"]
    e.emit("COMMENT", "a" * 60)
    e.emit("COMMENT", "b" * 60)  # over the bytes: the first is written
    assert len(e.buffer) == 1
    e.emit("COMMENT", "c" * 500)  # over the bound alone
    assert e.counts["direct"] == 1 and not e.buffer
    now[0] = 5.0
    for i in range(3000):
        e.emit("COMMENT", "d" * 90)
    assert e.counts["seals"] == 1  # enough bytes, and then not enough time
    e.close()
    e.close()
    names = sorted(os.listdir(e.home))
    assert names == ["00000000.jsonl", "00000001.jsonl"]
    seqs = [int(line.split(b'"seq":')[1].split(b",")[0]) for n in names for line in (e.home / n).read_bytes().splitlines()]
    assert seqs == list(range(e.next_seq + 1))


def test_states(tmp_path):
    e = Emitter(str(tmp_path), "p")
    e.activate()
    e.stop()
    with pytest.raises(BadState):
        e.emit("DISCOUNT")
    e.activate()
    e.emit("DISCOUNT")
    e.finalize()
    with pytest.raises(BadState):
        e.emit("TIME_LINE", 1, 1, 1)
    e.emit("PID_END", 1, 2.0)
    with pytest.raises(BadState):
        e.activate()
    e.close()
    with pytest.raises(BadState):
        e.emit("DISCOUNT")
    for bad in ({"records": 0}, {"records": 5000}, {"text": 2 << 20}):
        with pytest.raises(ValueError):
            Emitter(str(tmp_path), "q", **bad)
    with pytest.raises(ValueError):
        Emitter(str(tmp_path), "q").emit("DISCOUNT", 1)
    assert all(t in emitter.STATES for own in emitter.STATES.values() for t in own)


def test_a_retry_repeats_nothing(tmp_path, monkeypatch):
    e = Emitter(str(tmp_path), "p", records=100)
    e.activate()
    for i in range(10):
        e.emit("SUB_ENTRY", 1, i)
    real, left = e._write, [4]

    def failing(line):
        if not left[0]:
            raise OSError("full")
        left[0] -= 1
        real(line)

    monkeypatch.setattr(e, "_write", failing)
    with pytest.raises(OSError):
        e.flush()
    assert len(e.buffer) == 6
    monkeypatch.setattr(e, "_write", real)
    e.close()
    lines = (e.home / "00000000.jsonl").read_bytes().splitlines()
    assert len(lines) == 11 and len(set(lines)) == 11


def test_fork_and_reading(spark, tmp_path):
    parent = Emitter(str(tmp_path), "a 1+2")
    with pytest.raises(BadState):
        parent.fork("b")
    parent.activate()
    parent.emit("PID_START", 1, 0, 1.0)
    child = parent.fork("b")
    child.emit("PID_START", 2, 1, 1.5)
    parent.emit("TIME_LINE", 3, 1, 1)
    child.stop()
    parent.close()
    got = sorted((r.profile_id, r.seq, r.tag) for r in emitter.read_emitted(spark, str(tmp_path)).collect())
    assert got == [("a 1+2", 0, "PID_START"), ("a 1+2", 1, "TIME_LINE"), ("b", 0, "PID_START")]
    q = emitter.read_emitted(spark, str(tmp_path), stream=True).writeStream.format("memory").queryName("emitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.table("emitted").count() == 3
