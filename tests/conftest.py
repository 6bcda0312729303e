import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tickloom.session import session

    s = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows_of(pdf):
    """Sorted rows of a pandas frame, by column name, with nulls as None."""
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return x.item() if hasattr(x, "item") else x

    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(x) for x in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def workload():
    """A small profile as records: three calls of mid, each with five of leaf."""
    ev = [("VERSION", [5, 0]), ("ATTRIBUTE", ["ticks_per_sec", "10000000"]), ("ATTRIBUTE", ["application", "/w/workload.pl"]), ("OPTION", ["calls", "1"]), ("START_DEFLATE", []), ("PID_START", [7, 1, 1.0]), ("NEW_FID", [1, 0, 0, 0, 0, 0, "/w/workload.pl"])]
    for _ in range(3):
        for _ in range(5):
            ev += [("TIME_LINE", [2, 1, 5]), ("SUB_RETURN", [2, 10.0, 10.0, "main::leaf"]), ("DISCOUNT", [])]
        ev += [("TIME_LINE", [1, 1, 10]), ("SUB_RETURN", [1, 60.0, 10.0, "main::mid"])]
    ev += [("SUB_RETURN", [1, 4.0, 4.0, "main::CORE:print"]), ("SUB_INFO", [1, 3, 7, "main::leaf"]), ("SUB_INFO", [1, 8, 12, "main::mid"])]
    ev += [("SUB_CALLERS", [1, 10, 15, 0.5, 0.25, 0.0, 0, "main::leaf", "main::mid"]), ("SUB_CALLERS", [1, 14, 3, 0.5, 0.25, 0.0, 0, "main::mid", "main::RUNTIME"]), ("SUB_CALLERS", [1, 15, 1, 0.5, 0.25, 0.0, 0, "main::CORE:print", "main::RUNTIME"]), ("SUB_CALLERS", [0, 0, 0, 0.0, 0.0, 0.0, 0, "main::unused", ""])]
    ev += [("SRC_LINE", [1, n, f"line {n}\n"]) for n in range(1, 16)]
    return [*ev, ("PID_END", [7, 2.0])]


def events_of(spark, records, profile_id="p"):
    from tickloom import schemas

    rows = []
    for seq, (tag, args) in enumerate(records):
        r = {f.name: None for f in schemas.EVENTS.fields} | {"profile_id": profile_id, "seq": seq, "tag": tag}
        r |= {c: v for (c, _), v in zip(schemas.TAGS[tag], args)}
        rows.append(tuple(r.values()))
    return spark.createDataFrame(rows, schemas.EVENTS)
