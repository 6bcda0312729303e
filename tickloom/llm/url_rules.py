"""URL filters by a sort-merge range join with a stack of active nested rules.

A host's canonical key is its labels in reverse order, each followed by a byte 1: `a.example.org` is org 1 example 1 a 1.
All names below a host then form the interval of keys that start with the host's. URLs are range-sorted by key and path
and dealt out; a task sweeps its URLs beside the sorted rules, from the first of its interval on, and keeps a stack of
the hosts whose interval it is in, the innermost on top. A host's rules are put in order when the sweep comes to it, so a
task builds what its interval has and no more. At a URL the path prefixes that are rules are looked up by length in each
level of the stack, from the longest. Of the rules that fit, the longest text (host and path) wins; of equal ones the one
with the longer host. An interval over host and path together would miss that a rule with a path also holds for the hosts
below its own, so the path is searched within each level.

Sorted rules within BROADCAST_BYTES go to every task, as Arrow columns. More are cut into ranges of keys: a range gets the
URLs of its keys and, besides its own rules, those of the hosts above its first key, a rule for each label and path.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm._util import release, stage
from tickloom.shipping import ship

BROADCAST_BYTES = 64 << 20


def host_of(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(F.regexp_replace(rest, r"\A[^/?#]*", ""), r"\A([^?#]*)", 1)


def _key(host):
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")))


def above(key: str) -> list[str]:
    """The keys of a key's host and of all hosts above it."""
    return [key[: i + 1] for i, c in enumerate(key) if c == "\x01"]


def sorted_rules(rules: DataFrame) -> DataFrame:
    """key, host, path, verdict of the rules that say anything, one for each host and path: the first verdict in order."""
    rules = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path", "verdict").dropna().where("host <> ''")
    return rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(_key(F.col("host")).alias("key"), "host", "path", "verdict")


class Sweep:
    """Rules in key order beside URLs in key order."""

    def __init__(self, table: pa.Table):
        self.keys = table.column("key").combine_chunks()
        self.rest = [table.column(c).combine_chunks() for c in ("host", "path", "verdict")]
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # key, host, verdicts by path, their lengths
        self.at = None

    def _find(self, key: str) -> int:
        """The first rule that isn't below the key."""
        low, high = 0, len(self.keys)
        while low < high:
            mid = (low + high) // 2
            if self.keys[mid].as_py() < key:
                low = mid + 1
            else:
                high = mid
        return low

    def _push(self, at: int) -> int:
        """Put the host of this rule on the stack; where the next host begins."""
        key = self.keys[at].as_py()
        end = self._find(key + "\x00")  # no key lies between
        host, paths, verdicts = (c.slice(at, end - at).to_pylist() for c in self.rest)
        self.stack.append((key, host[0], dict(zip(paths, verdicts)), sorted({len(p) for p in paths}, reverse=True)))
        return end

    def go(self, keys: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """(rule, verdict) for URLs in order, carrying on from the URLs before."""
        out, count = [], len(self.keys)
        for key, path in zip(keys, paths):
            if self.at is None:  # hosts above the first key, then from there on
                for k in above(key)[:-1]:
                    at = self._find(k)
                    if at < count and self.keys[at].as_py() == k:
                        self._push(at)
                self.at = self._find(key)
            while self.stack and not key.startswith(self.stack[-1][0]):
                self.stack.pop()
            while self.at < count and (rule := self.keys[self.at].as_py()) <= key:
                # one that isn't above this key has an interval that is over before it
                self.at = self._push(self.at) if key.startswith(rule) else self._past(self.at, key)
            best = None
            for _, host, own, lengths in self.stack:
                for n in lengths:
                    if n <= len(path) and path[:n] in own:
                        new = (len(host) + n, len(host), host + path[:n], own[path[:n]])
                        best = new if best is None or new[:2] > best[:2] else best
                        break
            out.append(best and best[2:])
        return out

    def _past(self, at: int, key: str) -> int:
        """The next rule that may be above this key: the first of those hosts that comes after `at`, or the key itself."""
        rule = self.keys[at].as_py()
        return self._find(min((k for k in (*above(key), key) if k > rule), default=key))


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", partitions: int | None = None) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (host and path of the rule that holds, else null), verdict.

    A null URL or one without :// has empty host and path and gets the default, as does a host that no rule fits.
    rules (host, path, verdict): with a null host, path or verdict, or an empty host, they are left out. Repeated rows
    come out as often as they went in, and URLs of any length are judged whole; an empty table gives none. A hot host is
    split among tasks, since the sort goes on by path and id.
    """
    spark = pages.sparkSession
    ship(spark)
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("u"))
    host, path = host_of(F.col("u"))
    base = base.select("page_id", host.alias("host"), path.alias("path")).fillna("", ["host", "path"])
    order = ["key", "path", "page_id"]
    keyed = base.withColumn("key", _key(F.col("host")))
    keyed = (keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)).sortWithinPartitions(*order)
    kind = base.schema["page_id"].dataType.simpleString()
    rules = sorted_rules(rules)
    size = rules.agg(F.sum(F.octet_length("host") * 2 + F.octet_length("path") + F.octet_length("verdict") + 17)).first()[0] or 0

    def swept(urls: DataFrame, own: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(own.orderBy("key", "path").toArrow())

        def run(batches):
            sweep = Sweep(held.value)
            for batch in batches:
                best = sweep.go(batch.column("key").to_pylist(), batch.column("path").to_pylist())
                columns = [pa.array([b and b[0] for b in best], pa.string()), pa.array([b[1] if b else default for b in best], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path")] + columns, ["page_id", "host", "path", "rule", "verdict"])
            release()

        return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")

    if size <= BROADCAST_BYTES:
        return swept(keyed, rules)
    rules = stage(rules, "rules")
    parts = rules.repartitionByRange(-(-size // BROADCAST_BYTES), "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("low"))
    cuts = sorted(r.low for r in parts.collect())  # a row for each part
    keyed, out = stage(keyed, "urls"), None  # sorted by key, so that a range reads only its row groups
    for low, high in zip(["", *cuts[1:]], [*cuts[1:], None]):
        inside = (F.col("key") >= low) if high is None else (F.col("key") >= low) & (F.col("key") < high)
        one = swept(keyed.where(inside).sortWithinPartitions(*order), rules.where(inside | F.col("key").isin(above(low))))
        out = one if out is None else out.unionByName(one)
    return out
