"""Token-id shards as sorted string tables.

A shard holds documents in ascending key order. The key of an integer id is eight big-endian bytes with the sign bit
turned, that of a string id a byte 1 and its UTF-8 bytes, so that bytes sort as ids do; a null id is the empty key and
comes first. Layout of a shard:

    magic | block* | index | Bloom filter | footer

A block is zstd-compressed and holds entries (shared, rest, value length as varints; the key's rest; the value), where
shared is the number of leading bytes that the key has in common with the one before it in the block. The index has a
row for each block (first key, offset, stored bytes, CRC-32): it is sparse. The footer has the places of both, counts
and its own length. A lookup reads the footer, asks the Bloom filter, finds the block by binary search and reads it alone.

Shards are written under a name of the attempt and moved to a final one that no other attempt has; the manifest lists
the one of the attempt that counted, so a task that is run again, or twice at once, leaves nothing that is read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import _scan
from tickloom.llm._util import filesystem, release, stage, workspace
from tickloom.llm.tokens import encoder
from tickloom.shipping import ship

MAGIC = b"TLSST001"
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 128 << 10, 10, 7


def key_of(doc_id: int | str | None) -> bytes:
    if isinstance(doc_id, str):
        return b"\x01" + doc_id.encode()
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes, text: bool = False) -> int | str | None:
    if not key:
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key)[0] - (1 << 63)


def _id_kind(docs: DataFrame) -> str:
    """Ids are strings or whole numbers."""
    return "string" if docs.schema["doc_id"].dataType.typeName() in ("string", "char", "varchar") else "long"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Takes (key, value) in ascending key order and writes a shard to a stream; only a block is held in memory, and
    the index and 16 bytes a key for the Bloom filter."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.last, self.first = [], 0, b"", None
        self.index, self.hashes, self.count, self.ids = [], [], 0, 0
        self.low = self.high = None
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.high is not None and key < self.high:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.low = key if self.low is None else self.low
        self.last = self.high = key
        self.hashes.append(key)
        self.count += 1
        self.ids += len(ids)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            raw = struct.pack("<I", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)
            self.index.append((self.first, self.at, len(raw), zlib.crc32(raw)))
            self._put(raw)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQI", at, n, crc) for k, at, n, crc in self.index)
        bits = max(64, self.count * BLOOM_BITS)
        bloom = bytearray(-(-bits // 8))
        for k in self.hashes:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        footer = {"index_at": self.at, "index_bytes": len(index), "bloom_at": self.at + len(index), "bloom_bytes": len(bloom), "bloom_bits": bits, "blocks": len(self.index), "documents": self.count, "ids": self.ids, "width": self.width, "crc": zlib.crc32(index + bloom)}
        self._put(index)
        self._put(bytes(bloom))
        raw = json.dumps(footer, sort_keys=True).encode()
        self._put(raw + struct.pack("<I", len(raw)) + MAGIC)


class Reader:
    """Range reads of a shard; file has size() and read_at(bytes, offset)."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(min(size, 4096), max(0, size - 4096))
        if tail[-8:] != MAGIC:
            raise ValueError("not a shard, or cut short")
        n = struct.unpack("<I", tail[-12:-8])[0]
        self.footer = json.loads(tail[-12 - n : -12])
        f = self.footer
        index, self.bloom = file.read_at(f["index_bytes"], f["index_at"]), file.read_at(f["bloom_bytes"], f["bloom_at"])
        if zlib.crc32(index + self.bloom) != f["crc"]:
            raise ValueError("index or Bloom filter damaged")
        self.index, at = [], 0
        while at < len(index):
            k, at = _read_varint(index, at)
            self.index.append((index[at : at + k], *struct.unpack("<QQI", index[at + k : at + k + 20])))
            at += k + 20

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, crc = self.index[i]
        raw = self.file.read_at(n, at)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {i} damaged")
        raw, at, key = pa.decompress(raw[4:], struct.unpack("<I", raw[:4])[0], codec="zstd", asbytes=True), 0, b""
        kind = "<u2" if self.footer["width"] == 2 else "<u4"
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, dtype=kind, count=size // self.footer["width"], offset=at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The values of a key: of each of its rows, none if it isn't there."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.footer["bloom_bits"])):
            return []
        firsts = [x[0] for x in self.index]
        i, out = max(0, bisect.bisect_left(firsts, key) - 1), []
        while i < len(self.index) and firsts[i] <= key:
            out += [v for k, v in self.block(i) if k == key]
            i += 1
        return out


MANIFEST = "path string, low binary, high binary, documents long, ids long, bytes long"


def write(docs: DataFrame, tokenizer: str, *, end_id: int = 2, shards: int | None = None, folder: str | None = None, remember: int = 256 << 20, batch_bytes: int = 8 << 20, across_tasks: bool = True) -> DataFrame:
    """Encode docs (doc_id, text), range-partition by doc_id and write a shard for each range; the manifest.

    Null texts are empty, null ids come first, rows of one id stay together, ordered by text. `tokenizer` is the
    tokenizer's JSON (about 2 MB, broadcast). A worker encodes batch_bytes of text at a time, texts whole, and remembers
    the ids of stretches of text within `remember` bytes, for later tasks too if across_tasks. Ids are strings or whole
    numbers; other columns are ignored. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or workspace(spark, "sstables")
    fs, root = filesystem(folder)
    fs.create_dir(root)
    spec = spark.sparkContext.broadcast(tokenizer)
    docs = docs.select(F.col("doc_id").cast(_id_kind(docs)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    ranged = docs.repartitionByRange(shards, order[0]) if shards else docs.repartitionByRange(order[0])

    def run(batches):
        writer = None
        for batch in batches:
            for part in _scan.slices(batch, "text", batch_bytes):
                if writer is None:
                    own = encoder(spec.value, remember, across_tasks)
                    fs, root = filesystem(folder)
                    name = uuid.uuid4().hex
                    out = fs.open_output_stream(f"{root}/.{name}.part")
                    writer = Writer(out, 2 if max(own.size, end_id + 1) <= 1 << 16 else 4)
                end = struct.pack("<I", end_id)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist())):
                    writer.add(key_of(doc_id), np.frombuffer(ids + end, dtype="<u4"))
        if not across_tasks:
            own = None
            release()
        if writer is not None:
            writer.close()
            out.close()
            fs.move(f"{root}/.{name}.part", f"{root}/{name}.sst")
            row = [f"{folder}/{name}.sst", writer.low, writer.high, writer.count, writer.ids, writer.at]
            yield pa.RecordBatch.from_pylist([dict(zip(["path", "low", "high", "documents", "ids", "bytes"], row))], pa.schema([("path", pa.string()), ("low", pa.binary()), ("high", pa.binary()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    return stage(ranged.sortWithinPartitions(*order).mapInArrow(run, MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame, ids: str = "long") -> DataFrame:
    """The documents of the shards: doc_id, start (ids before it in key order), ids (little-endian unsigned 32-bit).
    ids: the type of doc_id, long or string."""
    return _per_document(spark, manifest, f"doc_id {ids}, start long, ids binary", [pa.int64(), pa.binary()], lambda ids: [ids.astype("<u4").tobytes()])


def digest(spark: SparkSession, manifest: DataFrame, ids: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents, as read back from the shards."""
    return _per_document(spark, manifest, f"doc_id {ids}, start long, n_tokens long, ids_crc32 long", [pa.int64()] * 3, lambda ids: [len(ids), zlib.crc32(ids.astype("<u4").tobytes())])


def _per_document(spark, manifest, schema, kinds, values) -> DataFrame:
    ship(spark)
    text = schema.startswith("doc_id string")
    kinds = [pa.string() if text else pa.int64(), *kinds]
    names = [x.split()[0] for x in schema.split(", ")]
    before = F.coalesce(F.sum("ids").over(Window.orderBy("low", "high", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("before"))  # a row for each shard
    count = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as file:
                    reader = Reader(file)
                    for i in range(len(reader.index)):
                        rows = []
                        for key, ids in reader.block(i):
                            rows.append([id_of(key, text), start, *values(ids)])
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return shards.repartition(count).mapInArrow(run, schema)


def lookup(manifest: DataFrame, doc_ids: list) -> dict:
    """Token ids of some documents by binary search: one job finds the shards whose range has an id, and they alone are
    opened, each once."""
    keys = {key_of(d): d for d in doc_ids}
    if not keys:
        return {}
    has = F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: (F.col("low") <= k) & (F.col("high") >= k))
    out: dict = {}
    for row in manifest.where(has).select("path", "low", "high").toLocalIterator():
        fs, at = filesystem(row.path)
        with fs.open_input_file(at) as file:
            reader = Reader(file)
            for key, doc_id in keys.items():
                if row.low <= key <= row.high and (got := [v.tolist() for v in reader.get(key)]):
                    out.setdefault(doc_id, []).extend(got)
    return out


def false_positive_rate() -> float:
    """Of the Bloom filter, as designed."""
    return (1 - math.exp(-BLOOM_HASHES / BLOOM_BITS)) ** BLOOM_HASHES
