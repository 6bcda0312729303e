"""Command line: reports, exports, and conversion of profiles. `python -m tickloom COMMAND PATH...`"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tickloom.operators import tools
from tickloom.session import session
from tickloom.sinks import html, text
from tickloom.sources import binary, jsonl
from tickloom.views import Profile


def _events(spark, path: str, kind: str, mode: str = "FAILFAST"):
    if kind == "auto":
        kind = "jsonl" if path.endswith((".jsonl", ".json")) else "parquet" if path.rstrip("/").endswith(".parquet") else "binary"
    if kind == "jsonl":
        return jsonl.read(spark, path, mode="SKIP" if mode != "FAILFAST" else mode)
    if kind == "parquet":
        return spark.read.parquet(path)
    return binary.read(spark, path, mode=mode)


def _doctor(spark) -> dict[str, bool]:
    """What works here: each codec, both wire formats, variants."""
    import pyarrow as pa

    from tickloom.sources import wire_v5, wire_v6

    small = [("VERSION", [6, 0]), ("TIME_LINE", [1, 1, 1])]
    out = {f"v6 {n}": pa.Codec.is_available(c) and list(wire_v6.decode(wire_v6.encode(small, codec=k))) == small for n, c, k in (("zstd", "zstd", wire_v6.ZSTD), ("lz4", "lz4_raw", wire_v6.LZ4), ("zlib", "gzip", wire_v6.ZLIB))}
    out["v5"] = len(list(wire_v5.decode(wire_v5.encode(small)))) == 3
    out["variant"] = spark.sql("SELECT try_variant_get(parse_json('[1]'), '$[0]', 'int')").first()[0] == 1
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tickloom", description=__doc__)
    ap.add_argument("command", choices=["dump", "verify", "report", "aggregates", "csv", "folded", "callgrind", "dot", "flame", "html", "summary-html", "convert", "repack", "merge", "salvage", "compare", "normalize", "query", "doctor"])
    ap.add_argument("paths", nargs="*")
    ap.add_argument("--format", default="auto", choices=["auto", "jsonl", "parquet", "binary"])
    ap.add_argument("--out", help="file or folder to write")
    ap.add_argument("--to", default="v6", choices=["v5", "v6"])
    ap.add_argument("--lossy", action="store_true")
    ap.add_argument("--by-name", action="store_true", help="merge files of one name")
    ap.add_argument("--packages", action="store_true")
    ap.add_argument("--no-flame", action="store_true")
    ap.add_argument("--allow-incomplete", action="store_true")
    ap.add_argument("--json", action="store_true", help="query: one object instead of lines")
    ap.add_argument("--title", default="Profile")
    a = ap.parse_args(argv)
    spark = session("tickloom")
    if a.command == "doctor":
        found = _doctor(spark)
        print("\n".join(f"{k}: {'ok' if v else 'not available'}" for k, v in found.items()))
        return 0 if all(found.values()) else 1
    if not a.paths:
        ap.error("a path is needed")
    events = _events(spark, a.paths[0], a.format, "PERMISSIVE" if a.command == "salvage" else "FAILFAST")
    p = Profile.of(events)

    def put(said: str) -> None:
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(said)
        else:
            sys.stdout.write(said)

    def put_binary(done) -> None:
        raw = bytes(done.first().content)
        if not a.out:
            ap.error("--out is needed")
        with open(a.out, "wb") as f:
            f.write(raw)

    try:
        if a.command not in ("dump", "verify", "convert", "repack", "merge", "salvage", "compare", "normalize", "query"):
            tools.require_complete(p, a.allow_incomplete)
        if a.command == "dump":
            for r in jsonl.lines(events).orderBy("seq").toLocalIterator():
                print(r.value)
        elif a.command == "normalize":
            for r in jsonl.lines(tools.normalized(events)).orderBy("seq").toLocalIterator():
                print(r.value)
        elif a.command == "verify":
            rows = tools.verify(p).collect()
            for r in rows:
                print("\n".join(f"{k}: {v}" for k, v in r.asDict().items()))
            return 0 if rows and (a.allow_incomplete or all(r.complete for r in rows)) else 1
        elif a.command == "report":
            put(text.summary(p, a.paths[0]))
        elif a.command == "query":
            put(text.query_json(p) + "\n" if a.json else "".join(f"{x}\n" for x in text.query_text(p)))
        elif a.command == "aggregates":
            put(text.aggregates_json(p, a.paths[0]) + "\n")
        elif a.command in ("csv", "folded", "callgrind"):
            put({"csv": text.csv_report, "folded": text.folded, "callgrind": text.callgrind}[a.command](p))
        elif a.command == "dot":
            put(text.dot(p, a.packages))
        elif a.command == "flame":
            put(html.flame_svg(p))
        elif a.command == "summary-html":
            put(html.summary(p, a.title, not a.no_flame))
        elif a.command == "html":
            html.write_site(p, a.out or "", a.title, not a.no_flame, a.allow_incomplete)
        elif a.command in ("convert", "repack"):
            if a.command == "convert" and a.to == "v6":
                bad = tools.conversion_problems(events, lossy=a.lossy).first()
                if bad:
                    raise ValueError(f"record {bad.seq} ({bad.tag}): {bad.problem}")
                events = tools.lossy(events) if a.lossy else events
            kind = a.to
            if a.command == "repack":
                kind = spark.read.format("binaryFile").load(a.paths[0]).select(F.substring("content", 1, 8).alias("m")).first().m
                kind = binary.wire_kind(bytes(kind))
            put_binary(binary.encoded(events, kind))
        elif a.command == "merge":
            many = [_events(spark, x, a.format) for x in a.paths]
            done = (tools.merge_by_name if a.by_name else tools.merge_concat)(many)
            put_binary(binary.encoded(done, a.to))
        elif a.command == "salvage":
            r = binary.salvaged(spark, a.paths[0]).first()
            put_binary(binary.encoded(tools.salvage_labels(events, wire=r.wire, consumed=r.bytes_consumed, size=r.bytes), "v5"))
        elif a.command == "compare":
            rows = tools.compare(p, Profile.of(_events(spark, a.paths[1], a.format))).limit(1000).collect()
            print("\n".join(f"{r.aggregate} {r.key}: {r.left} | {r.right}" for r in rows) or "equal")
            return 1 if rows else 0
    except (tools.IncompleteProfile, html.BadFolder, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0
