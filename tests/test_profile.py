"""Sources, folds, tools, exports and streams on small profiles."""

import json
import os
import re

import pytest
from conftest import events_of
from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom import schemas
from tickloom import streaming
from tickloom.operators import aggregates as agg
from tickloom.operators import derived, sequence, tools
from tickloom.sinks import html, text
from tickloom.sources import binary, jsonl, wire_v5
from tickloom.views import Profile


@pytest.fixture(scope="module")
def events(spark, workload):
    return events_of(spark, workload).persist()


@pytest.fixture(scope="module")
def profile(events):
    return Profile.of(events)


def test_golden_facts(profile):
    subs = {r["name"]: r for r in agg.sub_totals(profile["SUB_RETURN"]).collect()}
    assert (subs["main::leaf"].returns, subs["main::mid"].returns) == (15, 3)
    edges = {(r.caller, r.called): r for r in agg.call_edges(profile["SUB_CALLERS"]).collect()}
    assert edges["main::mid", "main::leaf"].calls == 15 and edges["main::RUNTIME", "main::mid"].calls == 3 and edges["", "main::unused"].calls == 0
    c = agg.counters(profile).first()
    assert c.dump_records == c.total_events + 1 and c.time_line_events == 18 and c.discount_events == 15
    assert {r["name"]: (r.fid, r.first_line, r.last_line) for r in agg.sub_defs(profile).collect()} == {"main::leaf": (1, 3, 7), "main::mid": (1, 8, 12)}
    assert sorted(r["name"] for r in agg.workload_subs(profile["SUB_RETURN"]).collect()) == ["main::leaf", "main::mid"]


def test_order_of_rows_does_not_matter(events, profile):
    mixed = Profile.of(events.orderBy(F.rand(3)).repartition(7))
    assert tools.compare(profile, mixed).count() == 0


def test_last_write_wins(spark):
    e = events_of(spark, [("SRC_LINE", [1, 1, "old"]), ("SRC_LINE", [1, 1, "new"]), ("NEW_FID", [1, 0, 0, 0, 0, 0, "a"]), ("NEW_FID", [1, 0, 0, 0, 0, 0, "b"])])
    p = Profile.of(e.repartition(3))
    assert agg.source_lines(p).first().text == "new" and agg.files(p).first()["name"] == "b"


def test_saturation(spark):
    big = 2**63 - 1
    p = Profile.of(events_of(spark, [("TIME_LINE", [big, 1, 1]), ("TIME_LINE", [big, 1, 1]), ("TIME_LINE", [5, 1, 2])]))
    assert {r.line: r.ticks for r in agg.line_totals(p).collect()} == {1: big, 2: 5}


def test_call_site_limit(profile):
    with pytest.raises(ValueError):
        agg.call_sites(profile["SUB_CALLERS"], strict_limit=2)
    assert agg.call_sites(profile["SUB_CALLERS"], strict_limit=4).count() == 4


def test_jsonl_round_trip(spark, events, tmp_path):
    path = str(tmp_path / "dump.jsonl")
    rows = [r.value for r in jsonl.lines(events).orderBy("seq").collect()]
    assert json.loads(rows[-1])["tag"] == "_END"
    with open(path, "w", encoding="utf-8") as f:
        f.write("﻿" + "\n\n".join(rows) + "\n")
    back = jsonl.read(spark, path, profile=F.lit("p"))
    assert back.exceptAll(events).count() == 0 and events.exceptAll(back).count() == 0


@pytest.mark.parametrize("line", ['{"seq": 1, "tag": "NOPE", "args": []}', '{"seq": 1, "tag": "TIME_LINE", "args": ["1", 2, 3]}', '{"seq": 1, "tag": "TIME_LINE", "args": [1, -2, 3]}', '{"seq": 1, "tag": "PID_END", "args": [1, null]}', '{"seq": 1, "tag": "TIME_LINE", "args": [1]}', "not json", '{"tag": "DISCOUNT", "args": []}'])
def test_bad_lines(spark, tmp_path, line):
    path = str(tmp_path / "bad.jsonl")
    with open(path, "w") as f:
        f.write('{"seq": 0, "tag": "DISCOUNT", "args": []}\n' + line + "\n")
    assert jsonl.read(spark, path, mode="SKIP").count() == 1
    with pytest.raises(Exception, match="bad event record"):
        jsonl.read(spark, path).collect()


def test_binary_round_trip(spark, events, tmp_path):
    for wire in ("v5", "v6"):
        raw = binary.encoded(tools.lossy(events) if wire == "v6" else events, wire).first().content
        path = tmp_path / f"p.{wire}"
        path.write_bytes(raw)
        back = binary.read(spark, str(path)).withColumn("profile_id", F.lit("p"))
        same = (tools.lossy(events) if wire == "v6" else events).where("tag <> 'VERSION'")
        assert back.where("tag <> 'VERSION'").drop("seq").exceptAll(same.drop("seq")).count() == 0
        (tmp_path / f"cut.{wire}").write_bytes(raw[: len(raw) * 2 // 3])
        r = binary.salvaged(spark, str(tmp_path / f"cut.{wire}")).first()
        assert r.wire == wire and r.bytes_consumed <= r.bytes
        assert binary.read(spark, str(tmp_path / f"cut.{wire}"), mode="SKIP").count() == 0
        with pytest.raises(Exception):
            binary.read(spark, str(tmp_path / f"cut.{wire}")).count()
    assert binary.wire_kind(b"???") == "unknown"


def test_completeness(spark, profile):
    assert tools.completeness(profile).first().complete
    open_ = Profile.of(events_of(spark, [("PID_START", [1, 0, 1.0])]))
    assert tools.completeness(open_).first().reasons == f"{tools.MISSING_END},{tools.NO_TIMING}"
    with pytest.raises(tools.IncompleteProfile):
        tools.require_complete(open_)
    tools.require_complete(open_, allow_incomplete=True)


def test_compare_finds_one_tick(spark, workload, profile):
    other = [(t, [a[0] + 1, *a[1:]]) if i == 7 else (t, a) for i, (t, a) in enumerate(workload)]
    bad = tools.compare(profile, Profile.of(events_of(spark, other))).collect()
    assert [(r.aggregate, r.key) for r in bad] == [("lines", "1|5")]


def test_merge(spark, workload, events):
    twice = Profile.of(tools.merge_by_name([events, events_of(spark, workload)]))
    once = {r.line: (r.calls, r.ticks) for r in agg.line_totals(Profile.of(events)).collect()}
    assert {r.line: (r.calls, r.ticks) for r in agg.line_totals(twice).collect()} == {k: (2 * c, 2 * t) for k, (c, t) in once.items()}
    assert twice["VERSION"].count() == 1 and agg.files(twice).count() == 1
    apart = Profile.of(tools.merge_concat([events, events_of(spark, workload)]))
    assert sorted(r.fid for r in agg.files(apart).collect()) == [1, 2]
    seqs = [r.seq for r in apart.events().select("seq").orderBy("seq").collect()]
    assert seqs == list(range(len(seqs)))


def test_salvage_labels(events):
    out = tools.salvage_labels(events, wire="v5", consumed=90, size=100).orderBy("seq").collect()
    assert out[0].tag == "VERSION" and [r.tag for r in out[1:9]] == ["ATTRIBUTE"] * 7 + ["COMMENT"]
    assert {r.key: r.value for r in out[1:8]}["profile.salvage.discarded_tail"] == "10"
    assert [r.seq for r in out] == list(range(len(out)))


def test_conversion_problems(spark):
    e = events_of(spark, [("PID_END", [1, 0.5]), ("TIME_BLOCK", [1, 1, 1, 1, 2]), ("NEW_FID", [1, 3, 0, 0, 0, 0, "x"]), ("TIME_LINE", [1, 1, 1])])
    assert tools.conversion_problems(e).count() == 3
    assert tools.conversion_problems(tools.lossy(e)).count() == 0


def test_exclusive_by_plain_stack(spark):
    calls = [("p", 0, 100, 1, 3), ("p", 10, 40, 2, 1), ("p", 12, 20, 3, 0), ("p", 50, 90, 2, 0), ("p", 200, 210, 1, 50)]
    df = spark.createDataFrame(calls, "profile_id string, enter long, exit long, depth int, overhead int")
    assert {(r.enter, r.excl) for r in sequence.exclusive(df).collect()} == {(0, 27), (10, 21), (12, 8), (50, 40), (200, 0)}


def test_primary_file_rules(spark):
    def choose(*records):
        return derived.primary_file(Profile.of(events_of(spark, list(records)))).first().fid

    f = lambda i, n: ("NEW_FID", [i, 0, 0, 0, 0, 0, n])
    t = ("TIME_LINE", [1, 9, 1])
    assert choose(f(1, "/x/a.pl"), f(2, "/x/b.pl"), ("ATTRIBUTE", ["application", "b.pl"])) == 2
    assert choose(f(1, "/x/a.pl"), f(2, "/x/b.pl"), ("TIME_LINE", [9, 2, 1])) == 2
    assert choose(f(1, "/usr/lib/perl5/a.pl"), f(2, "my_workload")) == 2
    assert choose(f(3, "a"), f(4, "b"), ("SRC_LINE", [4, 1, "x"])) == 4
    assert choose(f(3, "a"), t) == 1 and choose(t) == 1


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    L = F.lit  # noqa: N806
    assert [one(fn.basename(L(p))) for p in ("/a/b.pl", "a\\b", "/a/", "x")] == ["b.pl", "b", "/a/", "x"]
    assert [one(fn.package_of(L(s))) for s in ("A::B::c", "c", "::c")] == ["A::B", "main", "main"]
    assert [one(fn.compact_seconds(L(v))) for v in (0.0, 5e-9, 2.5e-5, 0.00123, 0.0123, 0.5, 1.5, 99.0, 250.0, -2.0)] == ["0s", "5ns", "25µs", "1.23ms", "12.3ms", "500ms", "1.50s", "99.0s", "250s", "-2.00s"]
    assert [one(fn.callgrind_cost(L(a), L(b))) for a, b in ((3.0, 9), (0.4, 9), (2.6, 0), (-1.0, 0))] == [3, 9, 3, 0]
    assert one(fn.format_ticks(L(3.0))) == "3" and one(fn.format_ticks(L(0.25))) == "0.25"
    assert one(fn.time_cell(L(20_000_000.0), L(10_000_000))) == "2.00s" and one(fn.time_cell(L(5.0), L(None).cast("long"))) == "5"
    assert one(fn.csv_field(L('a,"b'))) == '"a,""b"' and one(fn.dot_quote(L('a"\\'))) == '"a\\"\\\\"'
    assert one(fn.close(L(1.0), L(1.0 + 1e-12))) and not one(fn.close(L(1.0), L(1.1)))


def test_text_exports(profile):
    s = text.summary(profile, "p")
    assert "  main::leaf  returns=15  excl=150  incl=150" in s and "  1  5  15  30  workload.pl" in s
    assert text.subs_csv(profile).split("\n")[:2] == ["name,returns,incl,excl", "main::CORE:print,1,4,4"]
    assert text.folded(profile) == "main::RUNTIME;main::CORE:print 1\nmain::RUNTIME;main::mid 3\nmain::mid;main::leaf 15\n"
    c = text.callgrind(profile)
    assert c.startswith("# callgrind format\npositions: line\nevents: Ticks\n\nfn=main::CORE:print\n0 4\n") and "fn=main::mid\n0 30\ncfn=main::leaf\ncalls=15 0\n0 15\n" in c
    assert '"main::mid" -> "main::leaf";' in text.dot(profile) and '"main" -> "main";' in text.dot(profile, packages=True)
    a = json.loads(text.aggregates_json(profile, "p"))
    assert a["leaf_returns"] == 15 and a["mid_leaf_edge"] == 15 and a["is_stream_complete"] and a["source_line_1_5"] == "line 5\n" and a["file_1_basename"] == "workload.pl" and a["option_calls"] == "1"


def test_site(profile, tmp_path):
    out = str(tmp_path / "site")
    for _ in range(2):
        html.write_site(profile, out, "Run <1>")
    assert sorted(os.listdir(out)) == ["file-1.html", "flame.svg", "index-subs-excl.html", "index.html", "packages.dot", "sort.js", "source.html", "style.css", "subs.dot"]
    page = open(f"{out}/index.html", encoding="utf-8").read()
    assert "Run &lt;1&gt;" in page and "main::leaf" in page
    source = open(f"{out}/file-1.html", encoding="utf-8").read()
    assert "called by main::mid:1:10:15" in source and "calls main::leaf:15:" in source and 'href="style.css"' in source and 'id="L5"' in source
    assert open(f"{out}/source.html", encoding="utf-8").read() == source and "main::leaf" in open(f"{out}/index-subs-excl.html", encoding="utf-8").read()
    assert os.listdir(tmp_path) == ["site"]
    for bad in ("", "a/../b", "a\0b"):
        with pytest.raises(html.BadFolder):
            html.check_folder(bad)


def test_stream_equals_batch(spark, events, profile, tmp_path):
    rows = [r.value for r in jsonl.lines(events).orderBy("seq").collect()]
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.jsonl").write_text("\n".join(rows[i::3]) + "\n", encoding="utf-8")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    stream = streaming.read_jsonl(spark, str(source), files_per_trigger=1).withColumn("profile_id", F.lit("p"))
    want = agg.line_totals(profile)
    got = run(streaming.line_totals(stream), "lines", "complete")
    assert sorted(got.collect()) == sorted(want.collect())
    src = run(streaming.last_values(stream, "SRC_LINE", ["fid", "line"], ["text"]), "src", "complete")
    assert sorted(src.collect()) == sorted(agg.source_lines(profile).collect())
    states = run(streaming.lifecycle(stream), "life", "update").collect()
    assert states and max(states, key=lambda r: (r.starts, r.ends)).state == "closed"
    seen = str(tmp_path / "out")
    again = str(tmp_path / "again")
    q = stream.writeStream.foreachBatch(streaming.fan_out(streaming.to_folder(seen), streaming.to_folder(again))).option("checkpointLocation", str(tmp_path / "fan")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.read.parquet(seen).count() == spark.read.parquet(again).count() == len(rows) - 1


def test_stream_gaps(spark, events, tmp_path):
    folder = str(tmp_path / "ev")
    events.where("seq not in (5, 9)").coalesce(1).write.parquet(folder)
    q = streaming.gaps(streaming.read_parquet(spark, folder)).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "g")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.seq, r.expected) for r in spark.table("gaps").collect()) == [(6, 5), (10, 9)]
    assert [(r.seq, r.expected) for r in sequence.gaps(events.where("seq not in (5, 9)")).collect()] == [(6, 5), (10, 9)]


def test_filters_and_columns_reach_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "events.parquet")
    events.write.parquet(path)
    plan = agg.sub_totals(Profile.read(spark, path)["SUB_RETURN"])._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "EqualTo(tag,SUB_RETURN)" in plan
    assert set(read.split(",")) == {"profile_id:string", "tag:string", "incl:double", "excl:double", "name:string"}


def test_schema_covers_all_arguments():
    assert {c for a in schemas.TAGS.values() for c, _ in a} == set(schemas.COLUMNS) and set(wire_v5.LAYOUT) < set(schemas.TAGS)


def test_known_keys_and_counting(spark, events):
    from pyspark.sql import Observation

    keys = events.where("tag IN ('ATTRIBUTE', 'OPTION')").select("key", fn.is_known_key("tag", "key").alias("known")).collect()
    assert keys and all(r.known for r in keys)
    seen = Observation("counts")
    events.observe(seen, F.count("*").alias("records"), F.count_if(F.col("tag") == "TIME_LINE").alias("lines")).write.format("noop").mode("overwrite").save()
    assert seen.get["lines"] == 18 and seen.get["records"] == events.count()


def test_html_has_all_rows(spark):
    """More edges, definitions, blocks and subs of a file than any page's former limits."""
    n = 2100
    records = [("NEW_FID", [1, 0, 0, 0, 0, 0, "/w/a.pl"]), ("SRC_LINE", [1, 1, "the only line"])]
    records += [("SUB_RETURN", [1, 2.0, 1.0, f"m::s{i:04d}"]) for i in range(n)] + [("SUB_INFO", [1, i + 1, i + 1, f"m::s{i:04d}"]) for i in range(n)]
    records += [("SUB_CALLERS", [1, 1, 1, 0.5, 0.25, 0.0, 0, f"m::s{i:04d}", "m::top"]) for i in range(n)]
    records += [("TIME_BLOCK", [3, 1, 1, i + 1, 0]) for i in range(n)]
    p = Profile.of(events_of(spark, records))
    pages = html.site(p, flame=False)
    cells = [f"m::s{i:04d}" for i in range(n)]
    for page in (pages["index.html"], one := html.summary(p, flame=False)):
        calls, rest = page.split("<h2>Calls</h2>")[1].split("<h2>Definitions</h2>")
        defs, blocks = rest.split("<h2>Blocks</h2>")
        assert all(c in calls and c in defs for c in cells) and blocks.split("</table>")[0].count("<tr>") == n + 1
    assert all(c in pages["file-1.html"].split("</table>")[0] for c in cells)
    assert all(c in one.split("<h2>Calls</h2>")[0] for c in cells) and "the only line" in one


def test_query_output(profile):
    lines = list(text.query_text(profile))
    for said in ("main::leaf returns=15", "main::mid -> main::leaf count=15", "source_line 1:5=line 5", "line_calls 1:5=", "pid_start_count=1", "pid_start pid=7 ppid=1 start_time=1", "pid_end pid=7 end_time=2", "attribute ticks_per_sec=10000000", "option calls=1"):
        assert any(x.startswith(said) for x in lines), said
    assert [x for x in lines if x.startswith("sub_def")][0] == "sub_def main::leaf fid=1 first=3 last=7"
    said = json.loads(text.query_json(profile))
    assert said["subs"]["main::leaf"] == 15 and said["edges"]["main::mid\tmain::leaf"] == 15 and said["ok"]


def test_options():
    assert fn.parse_options(r"file=/a\:b:calls=2:calls=1") == {"file": "/a:b", "calls": "1"} and fn.parse_options(None) == {}
    for bad in ("nope=1", "calls", "=1"):
        with pytest.raises(ValueError):
            fn.parse_options(bad)
    assert len(fn.OPTION_KEYS) == 36


def test_for_each_record(events, profile):
    seen, other = [], []
    lines = (r.value for r in jsonl.lines(events).orderBy("seq").toLocalIterator())
    n = jsonl.for_each(lines, {"SUB_RETURN": lambda a, s: seen.append(a), "*": lambda t, a, s: other.append(t)})
    assert n == events.count() + 1 and len(seen) == profile["SUB_RETURN"].count() and other[-1] == "_END" and "SUB_RETURN" not in other
    assert jsonl.for_each(["", "nope", '{"tag":"DISCOUNT"}'], {}, on_error="skip") == 1
    with pytest.raises(ValueError):
        jsonl.for_each(["nope"], {})
    views = profile.by_tag({"SUB_RETURN": lambda v: v.select("name"), "*": lambda v: v.limit(1)})
    assert views["SUB_RETURN"].columns == ["name"] and set(views) == set(schemas.TAGS)


def test_dual_and_counting_sinks(spark, events, tmp_path):
    folder, seen = str(tmp_path / "ev"), streaming.Counting()
    events.coalesce(1).write.parquet(folder)
    sinks = streaming.fan_out(streaming.dual(str(tmp_path / "l"), str(tmp_path / "r")), seen, seen)
    q = streaming.read_parquet(spark, folder).writeStream.foreachBatch(sinks).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    assert seen.total == events.count() and seen.logical == seen.total - 1 and seen.by_tag["TIME_LINE"] == 18 and seen.last_seq == events.count() - 1
    assert streaming.unequal(events, events).count() == 0
    moved = events.withColumn("seq", F.when(F.col("seq") == 9, 1000).otherwise(F.col("seq")))
    assert [(r.left == r.right, r.same_places) for r in streaming.unequal(events, moved).collect()] == [(True, False)]
    assert [r.tag for r in streaming.unequal(events, events.where("tag <> 'DISCOUNT'")).collect()] == ["DISCOUNT"]


def test_side_records(spark, workload, tmp_path):
    from tickloom.sources import wire_v6

    side = {"source": [[1, 2, "text"]], "index": [[1, 2, 3, "k"]], "summary": [[4, 5, 6, "z"]], "footer": [[7, 8, "f"]]}
    (tmp_path / "m").write_bytes(wire_v6.encode([("TIME_LINE", [1, 1, 1])], side=side))
    for kind, rows in side.items():
        got = binary.side_records(spark, str(tmp_path / "m"), kind)
        assert [list(r)[2:] for r in got.collect()] == rows and got.columns[2:] == [c for c, _ in {n: f for n, f in wire_v6.SIDE.values()}[kind]]


def test_normalized_numbers(spark):
    values = [3.0, 0.25, float("nan"), float("inf"), float("-inf"), 2.0**60, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.x for r in df.select(fn.normalized_number("v").alias("x")).collect()] == ["3", "0.25", "<NAN>", "<INF>", "<-INF>", "1.15292150460684698E18", None]


def test_merge_numbers_across_ranges(spark):
    """Records far apart and many inputs are numbered without a gap, in order."""
    a = events_of(spark, [("NEW_FID", [1, 0, 0, 0, 0, 0, "a"]), ("TIME_LINE", [1, 1, 1])]).withColumn("seq", F.col("seq") * 100_000)
    out = tools.merge_by_name([a, a, a]).orderBy("seq").collect()
    assert [r.seq for r in out] == list(range(len(out))) and [r.tag for r in out] == ["NEW_FID", "TIME_LINE", "COMMENT", "TIME_LINE", "COMMENT", "TIME_LINE"]
    assert sequence.numbered(a, ["profile_id"], "seq", ["tag"]).count() == 2
