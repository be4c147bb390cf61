"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Scratch
from .fixtures import SPARK, VIEWS

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations", "labels")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Fixtures that were written once, by folder of the given tables and name; benchmarks fill this.
WRITTEN: dict[tuple[str, str], str] = {}


def write_fixtures(spark: SparkSession, sf_dir: str, into: str) -> None:
    """Write every fixture under a folder, so that queries read it and don't derive it again."""
    for name in VIEWS:
        getattr(Tables(spark, sf_dir), name).write.parquet(f"{into}/{name}")
        WRITTEN[sf_dir, name] = f"{into}/{name}"


class Tables:
    """The given tables and the fixtures over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._kept = spark, sf_dir, {}

    def kept(self, name: str) -> DataFrame:
        """A fixture for a query that reads it several times: written once, unless it lies written already."""
        if name not in self._kept:
            written = (self.sf_dir, name) in WRITTEN
            self._kept[name] = getattr(self, name) if written else Scratch(self.spark, name).keep(getattr(self, name))
        return self._kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if (self.sf_dir, name) in WRITTEN:
            return self.spark.read.parquet(WRITTEN[self.sf_dir, name])
        if name not in VIEWS:
            raise AttributeError(name)
        text = SPARK.get(name, VIEWS[name])
        base = [b for b in BASE if re.search(rf"FROM {b}\b", text)]
        for b in base:
            text = re.sub(rf"FROM {b}\b", f"FROM {{{b}}}", text)
        text = text.replace("'{\"", "'{{\"").replace("}'", "}}'") if "{\"" in text else text
        return self.spark.sql(text, **{b: getattr(self, b) for b in base})


def with_views(sql: str) -> str:
    """SQL over base tables: the fixtures it names become common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in used)
    body = sql.strip()
    if not used:
        return body
    if m := re.match(r"WITH (RECURSIVE )?", body):
        return f"WITH {m[1] or ''}{ctes}, {body[m.end():]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add
