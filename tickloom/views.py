"""Typed views: one DataFrame for each tag, with the columns of its arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas


@dataclass(frozen=True)
class Profile:
    """A profile, or many: lazy views by tag. Nothing is read before an action, and then only the columns it needs."""

    views: dict[str, DataFrame] = field(repr=False)
    relation: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def of(cls, events: DataFrame) -> Profile:
        """From the event relation."""
        views = {tag: events.where(F.col("tag") == tag).select(*schemas.view_columns(tag)) for tag in schemas.TAGS}
        return cls(views, events.where(F.col("tag").isin(list(schemas.TAGS))))

    @classmethod
    def read(cls, spark: SparkSession, path: str, format: str = "parquet", **options) -> Profile:  # noqa: A002
        """From parquet (the event relation), jsonl, or binary (either wire format, by its first bytes)."""
        if format == "parquet":
            return cls.of(spark.read.schema(schemas.EVENTS).parquet(path))
        if format == "jsonl":
            from tickloom.sources import jsonl

            return cls.of(jsonl.read(spark, path, **options))
        if format == "binary":
            from tickloom.sources import binary

            return cls.of(binary.read(spark, path, **options))
        raise ValueError(f"format {format}: parquet, jsonl or binary")

    def __getitem__(self, tag: str) -> DataFrame:
        return self.views[tag]

    def by_tag(self, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
        """What the handler of each tag makes of its view; `*` is the handler of all other tags."""
        rest = handlers.get("*")
        made = {t: handlers.get(t, rest) for t in schemas.TAGS}
        return {t: f(self[t]) for t, f in made.items() if f}

    def events(self) -> DataFrame:
        """All views as one event relation."""
        if self.relation is not None:
            return self.relation.select([f.name for f in schemas.EVENTS.fields])
        out = None
        for tag in schemas.TAGS:
            v = self.views[tag].withColumn("tag", F.lit(tag))
            out = v if out is None else out.unionByName(v, allowMissingColumns=True)
        for c, k in schemas.COLUMNS.items():
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast(schemas.KINDS[k]))
        return out.select([f.name for f in schemas.EVENTS.fields])
