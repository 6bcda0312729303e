"""Binary profiles as the event relation: one task decodes a file, told apart by its first bytes.

Files are decoded and encoded as streams: a task holds some records at a time, however many a profile has. A file in a
local or shared folder is read piece by piece; one in a store that only Spark's readers open comes as one value.
"""

from __future__ import annotations

import io
import itertools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import itemgetter, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.shipping import ship
from tickloom.sources import columns_v6, wire_v5, wire_v6
from tickloom.sources.wire_v5 import BadProfile
from tickloom.staging import filesystem, stage

_ARROW = {"u": pa.int64(), "i": pa.int64(), "n": pa.float64(), "s": pa.string()}
ROWS = 20_000


def wire_kind(raw: bytes) -> str:
    """`v5`, `v6` or `unknown`, by the first bytes."""
    return "v6" if raw.startswith(wire_v6.MAGIC) else "v5" if raw.startswith(wire_v5.MAGIC) else "unknown"


def _kind(raw) -> str:
    raw.seek(0)
    return wire_kind(raw.read(8))


def decode(raw, mixed: bool = False) -> Iterator[tuple[str, list]]:
    """Of bytes or an open file."""
    raw = wire_v5.opened(raw)
    kind = _kind(raw)
    if kind == "unknown":
        raise BadProfile("neither wire format")
    return wire_v5.decode(raw) if kind == "v5" else wire_v6.decode(raw, mixed=mixed)


def salvage(raw) -> tuple[list[tuple[str, list]], int]:
    used, rows = _salvage(raw)
    return list(rows), used


def _salvage(raw) -> tuple[int, Iterator[tuple[str, list]]]:
    raw = wire_v5.opened(raw)
    kind = _kind(raw)
    if kind == "unknown":
        return 0, iter(())
    _, used, rows = (wire_v5 if kind == "v5" else wire_v6).start(raw)
    return used, rows


def _salvage_counts(raw) -> tuple[str, int, int, int]:
    """wire, records, bytes_consumed, bytes."""
    kind, size = _kind(raw), raw.seek(0, 2)
    try:
        n, used = (0, 0) if kind == "unknown" else (wire_v5 if kind == "v5" else wire_v6).salvaged(raw)
    except BadProfile:
        n, used = 0, 0
    return kind, n, used, size


def _batches(raw, mixed: bool, profile_id: str) -> Iterator[pa.RecordBatch]:
    """_rows() of decode(), with records of the newer format read many at once."""
    raw = wire_v5.opened(raw)
    if _kind(raw) != "v6":
        yield from _rows(decode(raw, mixed), profile_id)
        return
    first, names = 0, [f.name for f in schemas.EVENTS.fields]
    for part in columns_v6.decode(raw, mixed):
        if isinstance(part, list):
            yield from _rows(part, profile_id, first)
            first += len(part)
            continue
        tags, columns = part.arrays()
        n = part.rows
        whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(profile_id, pa.string()), n), pa.array(np.arange(first, first + n)), tags, *columns], names)
        for at in range(0, n, ROWS):
            yield whole.slice(at, ROWS)
        first += n


def _rows(records, profile_id: str, first: int = 0) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in schemas.EVENTS.fields]
    records = iter(records)
    while part := list(itertools.islice(records, ROWS)):
        # a tag's arguments are columns of their own; the columns of all tags, one after the other, go back in order
        places, given = {}, {}
        for i, (tag, args) in enumerate(part):
            if tag in places:
                places[tag].append(i)
                given[tag].append(args)
            else:
                places[tag], given[tag] = [i], [args]
        columns = {c: [] for c in schemas.COLUMNS}
        for tag, rows in given.items():
            values = dict(zip([c for c, _ in schemas.TAGS[tag]], zip(*rows)))
            for c, k in schemas.COLUMNS.items():
                columns[c].append(pa.array(values[c], _ARROW[k]) if c in values else pa.nulls(len(rows), _ARROW[k]))
        order = [0] * len(part)
        for n, i in enumerate(itertools.chain.from_iterable(places.values())):
            order[i] = n
        tags = pa.array([t for t, _ in part], pa.string())
        order = pa.array(order, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([profile_id] * len(part), pa.string()), pa.array(range(first, first + len(part)), pa.int64()), tags, *[pa.concat_arrays(v).take(order) for v in columns.values()]],
            names,
        )
        first += len(part)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files; content is null of those that open_() opens by their path."""
    files = spark.read.format("binaryFile").load(path)
    local = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"
    return files.select("path", F.lit(None).cast("binary").alias("content") if local else F.col("content"))


@contextmanager
def _opened(path: str, content: bytes | None):
    if content is not None:
        yield io.BytesIO(content)
        return
    if path.startswith("file:/"):
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb", 1 << 18) as raw:
            yield raw
        return
    fs, at = filesystem(path)
    with fs.open_input_file(at) as raw:
        yield io.BufferedReader(raw, 1 << 18)


def _each(batch) -> Iterator[tuple[str, str, bytes | None]]:
    return zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))


def read(spark: SparkSession, path: str, *, mode: str = "FAILFAST", mixed: bool = False) -> DataFrame:
    """Event relation of the profiles at path (a file, folder or pattern). FAILFAST raises on a bad one; PERMISSIVE keeps
    the longest verified start; SKIP leaves bad ones out. One file is one task: land many as Parquet once."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for name, content in _each(batch):
                with _opened(name, content) as raw:
                    try:
                        if mode == "PERMISSIVE":
                            yield from _rows(_salvage(raw)[1], name)
                            continue
                        if mode == "SKIP":  # whether it is whole, before its first record is given
                            for _ in decode(raw, mixed):
                                pass
                        yield from _batches(raw, mixed, name)
                    except BadProfile as e:
                        if mode != "SKIP":
                            raise BadProfile(f"{name}: {e}") from e

    return _files(spark, path).mapInArrow(run, schemas.EVENTS)


def _salvaged(rows: DataFrame) -> DataFrame:
    """profile_id, wire, records, bytes_consumed, bytes of files given as rows (profile_id, path, content)."""

    def run(batches):
        for batch in batches:
            found = []
            for name, path, content in _each(batch):
                with _opened(path, content) as raw:
                    found.append((name, *_salvage_counts(raw)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["profile_id", "wire", "records", "bytes_consumed", "bytes"])

    return rows.mapInArrow(run, "profile_id string, wire string, records long, bytes_consumed long, bytes long")


def salvaged(spark: SparkSession, path: str) -> DataFrame:
    """profile_id, wire, records, bytes_consumed, bytes of each profile at path."""
    ship(spark)
    return _salvaged(_files(spark, path).select(F.col("path").alias("profile_id"), "path", "content"))


def salvaged_bytes(files: DataFrame) -> DataFrame:
    """The same of files that are rows (profile_id, content), as encoded() gives them."""
    ship(files.sparkSession)
    return _salvaged(files.select("profile_id", F.lit(None).cast("string").alias("path"), "content"))


def salvaged_files(files: DataFrame) -> DataFrame:
    """The same of files that are rows (profile_id, path), as write() gives them: dealt out, as the rows are few."""
    ship(files.sparkSession)
    n = max(1, min(files.count(), 10_000))
    return _salvaged(files.select("profile_id", "path", F.lit(None).cast("binary").alias("content")).repartition(n))


def side_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """profile_id, place and the records of one kind of the mixed profiles at path, in columns of their own names: source
    (fid, line, text), index (key_id, file_offset, length, label), summary (key_id, count, value, label) or footer
    (key_id, value, label), which is for files whose footer isn't a dictionary."""
    ship(spark)
    fields = {name: own for name, own in wire_v6.SIDE.values()}[kind]
    kinds = [pa.string(), pa.int64(), *[_ARROW[k] for _, k in fields]]
    names = ["profile_id", "place", *[c for c, _ in fields]]

    def run(batches):
        for batch in batches:
            for name, content in _each(batch):
                with _opened(name, content) as raw:
                    rows = [(name, i, *r) for i, r in enumerate(wire_v6.side_records(raw, footer=kind == "footer")[kind])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _files(spark, path).mapInArrow(run, "profile_id string, place long, " + ", ".join(f"{c} {'string' if k == 's' else 'long'}" for c, k in fields))


def _slots(tag: str) -> dict[str, str]:
    """column -> the slot that holds it in records of a tag: the first integer, the first float, the first text."""
    taken = {"n": 0, "i": 0, "s": 0}
    out = {}
    for c, k in schemas.TAGS[tag]:
        k = "i" if k == "u" else k
        out[c] = f"{k}{taken[k]}"
        taken[k] += 1
    return out


_SLOTS = {tag: _slots(tag) for tag in schemas.TAGS}
_ALL_SLOTS = sorted({x for of in _SLOTS.values() for x in of.values()})


def _arguments(tag: str) -> Callable[[tuple], tuple]:
    at = [2 + _ALL_SLOTS.index(x) for x in _SLOTS[tag].values()]
    return itemgetter(*at) if len(at) > 1 else (lambda row: tuple(row[k] for k in at))


_CODES = {tag: n for n, tag in enumerate(schemas.TAGS)}
_READ = [(tag, _arguments(tag)) for tag in schemas.TAGS]


#: Arguments that the newer format leaves out where they are 0, and so may be null.
_UNSAID = ("sub_line", "eval_fid", "eval_line", "flags", "size", "mtime")


#: Up to so many profiles are dealt out one to a task; more are even enough by hash.
MOST_DEALT = 10_000


def _dealt(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with each profile in a partition of its own: by hash several large ones meet in a task, which then sorts and
    holds that much more. events are read once more for the profiles' names."""
    names = [r.profile_id for r in events.select("profile_id").distinct().limit(MOST_DEALT + 1).collect()]
    if not 1 < len(names) <= MOST_DEALT:
        return rows.repartition("profile_id")
    table = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(names)), "part int, own string"))
    placed = rows.join(table, F.col("profile_id").eqNullSafe(F.col("own")), "left")
    return placed.repartitionById(len(names), F.coalesce("part", F.lit(0))).drop("part", "own")


def _in_order(events: DataFrame, wire: str, deal: bool = False) -> DataFrame:
    """profile_id, tag's number and slots of the records, a profile's in one partition and in order of seq; deal: as
    _dealt() has them. Rows are narrow, as each is sorted: a record's arguments take the first slots of their kinds. A
    number that is null is an error."""
    cases = {x: None for x in _ALL_SLOTS}
    number = F.lit(None).cast("int")
    for tag, slots in _SLOTS.items():
        here = F.col("tag") == tag
        needed = [F.col(c).isNull() for c, k in schemas.TAGS[tag] if k != "s" and not (wire == "v6" and c in _UNSAID)]
        code = F.lit(_CODES[tag])
        if needed:
            code = F.when(reduce(or_, needed), F.raise_error(F.lit(f"{tag}: null can't be held")).cast("int")).otherwise(code)
        number = F.when(here, code).otherwise(number)
        for c, x in slots.items():
            cases[x] = F.when(here, F.col(c)) if cases[x] is None else cases[x].when(here, F.col(c))
    number = F.coalesce(number, F.raise_error(F.concat(F.lit("unknown tag "), F.coalesce("tag", F.lit("null")))).cast("int"))
    rows = events.select("profile_id", "seq", number.alias("tag"), *[v.alias(x) for x, v in cases.items()])
    rows = _dealt(rows, events) if deal else rows.repartition("profile_id")
    return rows.sortWithinPartitions("profile_id", "seq").select("profile_id", "tag", *_ALL_SLOTS)


def _profiles(batches) -> Iterator[tuple[str, Iterator[tuple[str, tuple]]]]:
    """profile_id, and (tag, arguments) of its records, of batches of _in_order()."""
    def values(column) -> list:
        """Nulls of numbers are slots that the record doesn't use."""
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            return column.to_numpy(zero_copy_only=False).tolist()
        return column.fill_null(0).to_numpy(zero_copy_only=False).tolist()

    rows = (row for batch in batches for row in zip(*map(values, batch.columns)))
    for name, own in itertools.groupby(rows, key=itemgetter(0)):
        yield name, ((_READ[row[1]][0], _READ[row[1]][1](row)) for row in own)


#: tag -> the slots of its arguments, in order.
_ARGUMENTS = {tag: list(of.values()) for tag, of in _SLOTS.items()}


def _encoded(batches, wire: str, options: dict) -> Iterator[tuple[str, Iterator[bytes]]]:
    """profile_id, and the pieces of its file, of batches of _in_order()."""
    if wire == "v5" or options.get("switch"):
        for name, records in _profiles(batches):
            yield name, _pieces(records, wire, options)
        return
    parts = (part for batch in batches for part in _by_profile(batch))
    for name, own in itertools.groupby(parts, key=itemgetter(0)):
        yield name, wire_v6.pieces((table for _, table in own), slots=_ARGUMENTS, **options)


def _by_profile(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Table]]:
    """profile_id and its rows; a profile's are together."""
    names, at, n = batch.column(0), 0, batch.num_rows
    while at < n:
        name = names[at].as_py()
        end = n
        if names[n - 1].as_py() != name:
            own = pc.equal(names, pa.scalar(name, names.type)) if name is not None else pc.is_null(names)
            end = at + pc.sum(own.slice(at)).as_py()
        yield name, pa.Table.from_batches([batch.slice(at, end - at)])
        at = end


def _pieces(records, wire: str, options: dict) -> Iterator[bytes]:
    return wire_v5.pieces(records, **options) if wire == "v5" else wire_v6.pieces(records, **options)


def encoded(events: DataFrame, wire: str = "v5", **options) -> DataFrame:
    """profile_id, content: a file's bytes for each profile. A profile is encoded by one task, as its file is one stream.
    A task holds the bytes of a file; write() doesn't."""
    ship(events.sparkSession)

    def run(batches):
        for name, pieces in _encoded(batches, wire, options):
            raw = b"".join(pieces)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([raw], pa.binary())], ["profile_id", "content"])

    return _in_order(events, wire).mapInArrow(run, "profile_id string, content binary")


def _but_last(pieces: Iterator[bytes], n: int) -> Iterator[bytes]:
    """All but the last n bytes."""
    held = b""
    for piece in pieces:
        held += piece
        if len(held) > n:
            yield held[: len(held) - n]
            held = held[len(held) - n :]


def write(events: DataFrame, folder: str, wire: str = "v5", *, cut: int = 0, **options) -> DataFrame:
    """A file of each profile in a folder that all machines share, under a name of its own; profile_id, path of each. A
    file is moved to its name when it is whole; of a task that was run twice, the path returned is the one to read.
    cut: bytes that are left out at the end of each, as of a writer that broke off."""
    spark = events.sparkSession
    ship(spark)
    fs, root = filesystem(folder)
    fs.create_dir(root)

    def run(batches):
        fs, root = filesystem(folder)
        for profile_id, pieces in _encoded(batches, wire, options):
            name = f"{uuid.uuid4().hex}.{wire}"
            part = f"{root}/.{name}.part"
            try:
                with fs.open_output_stream(part, buffer_size=1 << 18) as out:
                    for piece in _but_last(pieces, cut) if cut else pieces:
                        out.write(piece)
            except BaseException:
                fs.delete_file(part)
                raise
            fs.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([profile_id], pa.string()), pa.array([f"{folder}/{name}"], pa.string())], ["profile_id", "path"])

    # the rows are few: in few files, as for each Spark's local file system starts a process (chmod) from an executor, which
    # counts as large as that until it runs
    return stage(_in_order(events, wire, deal=True).mapInArrow(run, "profile_id string, path string").hint("rebalance"), "written")


def convert(spark: SparkSession, path: str, wire: str, **options) -> DataFrame:
    """The profiles at path in a wire format; the same one repacks."""
    return encoded(read(spark, path), wire, **options)
