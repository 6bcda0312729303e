"""The star-schema tables as a profile: a deterministic mapping of each table onto a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.views import Profile


def _cents(column: str) -> str:
    return f"cast(round({column} * 100) AS bigint)"


#: Of a timestamp without a zone, whatever the session's zone is.
_SECONDS = "cast(unix_date(cast(o_orderdate AS date)) * 86400L + hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS double)"
#: tag -> (table, condition, expressions in the order of the view's arguments, seq).
MAPPING: dict[str, tuple[str, str, list[str], str]] = {
    "TIME_LINE": ("lineitem", "l_linestatus = 'O'", [_cents("l_extendedprice"), "l_suppkey", "l_linenumber"], "l_orderkey"),
    "TIME_BLOCK": ("lineitem", "l_linestatus = 'F'", [_cents("l_extendedprice"), "l_suppkey", "l_linenumber", "l_linenumber - (l_linenumber - 1) % 3", "1"], "l_orderkey"),
    "DISCOUNT": ("lineitem", "l_discount = 0", [], "l_orderkey"),
    "SUB_ENTRY": ("events", "event_type = 'click'", ["user_id % 50", "event_id % 97"], "event_id"),
    "SUB_RETURN": ("events", "true", ["1 + event_id % 5", _cents("value"), f"{_cents('value')} - {_cents('value')} % 7", "concat('main::', event_type)"], "event_id"),
    "SUB_CALLERS": (
        "lineitem", "true",
        ["l_suppkey", "l_linenumber", "cast(l_quantity AS bigint)", _cents("l_extendedprice"), f"{_cents('l_extendedprice')} div 2", _cents("l_tax"), "l_linenumber",
         "concat('P', l_partkey % 10, '::f', l_partkey % 40)", "concat('P', l_suppkey % 10, '::f', l_suppkey % 40)"],
        "l_orderkey",
    ),
    "NEW_FID": ("supplier", "true", ["s_suppkey", "0", "0", "0", "0", "0", "concat('/app/lib/', s_name, CASE WHEN s_suppkey % 5 = 0 THEN '.pl' ELSE '.pm' END)"], "s_suppkey"),
    "SUB_INFO": ("part", "true", ["p_partkey % 100", "p_size", "p_size + p_partkey % 20", "concat('P', p_partkey % 10, '::f', p_partkey % 40)"], "p_partkey"),
    "SRC_LINE": ("part", "true", ["p_partkey % 100", "p_size", "p_name"], "p_partkey"),
    "ATTRIBUTE": ("region", "true", ["r_name", "cast(r_regionkey AS string)"], "r_regionkey"),
    "OPTION": ("nation", "true", ["n_name", "cast(n_nationkey AS string)"], "n_nationkey"),
    "PID_START": ("orders", "true", ["o_orderkey", "0", _SECONDS], "o_orderkey"),
    "PID_END": ("orders", "o_orderstatus = 'F'", ["o_orderkey", _SECONDS], "o_orderkey"),
}
TICKS_PER_SECOND = "10000000"


def profile(spark: SparkSession, sf_dir: str) -> Profile:
    """The whole profile; tables are read only for the views that a query uses."""
    return Profile(_Views(spark, sf_dir))


class _Views(dict):
    """Views that are planned when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, tag: str) -> DataFrame:
        if tag not in MAPPING:
            self[tag] = self.spark.createDataFrame([], schemas.EVENTS).select(*schemas.view_columns(tag))
            return self[tag]
        table, where, values, seq = MAPPING[tag]
        source = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").where(where)
        columns = [F.expr(v).cast(schemas.KINDS[k]).alias(c) for v, (c, k) in zip(values, schemas.TAGS[tag])]
        view = source.select(F.lit("tpch").alias("profile_id"), F.expr(seq).cast("long").alias("seq"), *columns)
        if tag == "ATTRIBUTE":
            view = view.unionByName(self.spark.sql(f"SELECT 'tpch' AS profile_id, -1L AS seq, 'ticks_per_sec' AS key, '{TICKS_PER_SECOND}' AS value"))
        self[tag] = view
        return view


def call_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUB_RETURN view whose names are the called subs of SUB_CALLERS."""
    return profile(spark, sf_dir)["SUB_CALLERS"].select("profile_id", "seq", F.col("line").alias("depth"), "incl", "excl", F.col("called").alias("name"))


def tree_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUB_CALLERS view of an acyclic call tree: a root, regions, nations, suppliers."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, supplier = t("region"), t("nation"), t("supplier")
    r = region.select(F.lit("main::RUNTIME").alias("caller"), F.concat(F.lit("R::"), "r_name").alias("called"), F.lit(1).alias("calls"), F.lit(0).alias("incl"))
    n = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.concat(F.lit("R::"), "r_name").alias("caller"), F.concat(F.lit("N::"), "n_name").alias("called"), F.lit(1).alias("calls"), F.lit(0).alias("incl"))
    s = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.concat(F.lit("N::"), "n_name").alias("caller"), F.concat(F.lit("S::f"), "s_suppkey").alias("called"), (F.col("s_suppkey") % 9 + 1).alias("calls"), (F.col("s_suppkey") % 50 + 1).alias("incl"))
    zero = {"fid": "long", "line": "long", "excl": "double", "reci": "double", "depth": "long"}
    all_ = r.union(n).union(s).select(F.lit("tpch").alias("profile_id"), F.lit(0).cast("long").alias("seq"), F.col("calls").cast("long").alias("calls"), F.col("incl").cast("double").alias("incl"), "called", "caller", *[F.lit(0).cast(k).alias(c) for c, k in zero.items()])
    return all_.select(*schemas.view_columns("SUB_CALLERS"))
