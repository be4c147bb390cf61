"""Reading and writing: CSV files as tables, query results, backups, issue exports."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import work
from ..operators.text import markdown_head, to_markdown_rows


def table_names(paths: Sequence[str]) -> dict[str, str]:
    """A table name for each file: its stem with other signs as _, t_ before a digit, _1, _2 on a clash."""
    names: dict[str, str] = {}
    for path in paths:
        name = re.sub(r"\W", "_", os.path.splitext(os.path.basename(path.rstrip("/")))[0])
        name = f"t_{name}" if name[:1].isdigit() else name
        base, n = name, 0
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names[name] = path
    return names


def read_tables(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    out = {name: spark.read.csv(path, header=True, inferSchema=True) for name, path in table_names(paths).items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """SQL over tables given by their original names; the names become valid ones in the text."""
    for name, df in tables.items():
        safe = next(iter(table_names([name])))
        df.createOrReplaceTempView(safe)
        if safe != name:
            sql = re.sub(rf'(?<![\w"`])["`]?{re.escape(name)}["`]?(?![\w"`])', f"`{safe}`", sql)
    return spark.sql(sql)


def export_result(df: DataFrame, path: str, form: str) -> None:
    """CSV with a header, JSON lines, or a Markdown table (its head in a part of its own, named to come first)."""
    if form == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        df.write.mode("overwrite").json(path)
    elif form == "markdown":
        head = df.sparkSession.createDataFrame([(line,) for line in markdown_head(df)], "line string").coalesce(1)
        head.write.mode("overwrite").text(f"{path}/part=0")
        to_markdown_rows(df).write.mode("overwrite").text(f"{path}/part=1")
    else:
        raise ValueError(form)


VERSION = "1.1.0"
PARTS = ("documents", "memories", "spaces", "links", "threads")


def export_org(tables: dict[str, DataFrame], org: str) -> dict[str, DataFrame]:
    """Documents, memories, spaces, links and threads (each with its messages in order) of an organisation."""
    own = {p: tables[p].filter(F.col("org_id") == org) for p in ("documents", "memories", "spaces", "threads")}
    links = tables["links"].join(own["documents"].select(F.col("id").alias("document_id")), "document_id", "left_semi")
    said = tables["messages"].groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))
    return own | {"links": links, "threads": own["threads"].join(said, "thread_id", "left")}


def write_org(parts: dict[str, DataFrame], path: str) -> None:
    for name in PARTS:
        parts[name].withColumn("format_version", F.lit(VERSION)).write.mode("overwrite").json(f"{path}/{name}")


#: What a field gets where a backup has none (fixed values).
DEFAULTS = {"confidence": 1.0, "memory_level": "fact", "version": 1, "is_latest": True}


def import_org(spark: SparkSession, path: str, existing: dict[str, DataFrame], org: str) -> dict[str, DataFrame]:
    """Tables with a backup added, rows of known keys left as they are; everything goes to the given organisation."""
    keys = {"documents": ["id"], "memories": ["id"], "spaces": ["space_id"], "links": ["document_id", "space_id"], "threads": ["thread_id"]}
    out = {}
    for name in PARTS:
        want = existing[name].schema
        back = spark.read.json(f"{path}/{name}") if name == "threads" else spark.read.schema(want).json(f"{path}/{name}")
        if name == "threads":
            out["messages"] = existing["messages"].unionByName(
                back.join(existing["threads"].select("thread_id"), "thread_id", "left_anti").select("thread_id", F.explode("messages").alias("m")).select("thread_id", "m.turn", "m.role", "m.content")
            )
            back = back.select(*(F.col(f.name).cast(f.dataType) if f.name in back.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields))
        back = back.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(want[c].dataType)) for c, v in DEFAULTS.items() if name == "memories" and c in back.columns})
        if "org_id" in back.columns:
            back = back.withColumn("org_id", F.lit(org))
        out[name] = existing[name].unionByName(back.select(*want.names).join(existing[name].select(*keys[name]), keys[name], "left_anti"))
    return out


def issue_rows(issues: DataFrame, deps: DataFrame, labels: DataFrame, comments: DataFrame, skip_types: Sequence[str] = work.NOT_WORK, scrub: bool = False) -> DataFrame:
    """Issues with labels, dependencies and counts; scrub leaves out those that look like tests."""
    tags = labels.groupBy(F.col("issue_id").alias("id")).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    links = deps.groupBy(F.col("issue_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("depends_on_id", "type"))).alias("dependencies"))
    into = deps.groupBy(F.col("depends_on_id").alias("id")).agg(F.count("*").alias("dependent_count"))
    said = comments.groupBy(F.col("issue_id").alias("id")).agg(F.count("*").alias("comment_count"))
    rows = issues.filter(~F.col("issue_type").isin(*skip_types))
    if scrub:
        rows = rows.join(work.pollution_score(issues).select("id"), "id", "left_anti")
    out = rows.join(tags, "id", "left").join(links, "id", "left").join(into, "id", "left").join(said, "id", "left")
    return out.withColumn("dependency_count", F.size(F.coalesce("dependencies", F.array().cast("array<struct<depends_on_id:string,type:string>>")))).fillna(0, ["dependent_count", "comment_count"])


def export_issues(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def import_issues(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """Existing issues updated and extended by an export."""
    back = spark.read.schema(existing.schema).json(path)
    return work.upsert(existing, back, "id")


