"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Each source has a weight and a slope. Its share of the words is its weight's, and over training time
t from 0 to 1 it is drawn with density 1 + slope * (2t - 1), whose integral t + slope * (t^2 - t)
is the share of its words demanded by t. Inverting that gives the time of every visit to a document
from the words of its source that stand before it. The demand of all sources by that time, as a
share of the whole, is the visit's training position: half of all words stand before 0.5. Documents
of a source stand in an order that a hash of doc_id fixes; running sums are taken within hash
buckets, within groups of buckets and over these groups, so that a source that holds a third of all
rows is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, prepare

BUCKET_ROWS = 500
WORD = r"[^\x20\x09-\x0D]+"


def _cycle(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, scratch: Scratch, share: float, weights: Sequence[float], slopes: Sequence[float], cap: float) -> DataFrame:
    """(key, source_size, weight, slope, target, drift) of sources given as (key, source, source_size).

    Targets fill up by weight to cap times the size of the source, and what a full one leaves goes to
    the rest, until none is above: a round is one sum over sources, and only sums reach the driver.
    Ranks are by range partition, so that sources may be many. drift is the slope of all demand.
    """
    parts = scratch.keep(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    ahead = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_name = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    named = parts.withColumn("place", F.row_number().over(by_name) - 1).join(ahead.select("part", "ahead"), "part").withColumn("rank", F.col("place") + F.col("ahead"))
    named = scratch.keep(named.select("key", "source_size", _cycle(weights, F.col("rank")).alias("weight"), _cycle(slopes, F.col("rank")).alias("slope")))
    full_size, level, count = F.lit(float(cap)) * F.col("source_size"), F.lit(0.0), -1
    while True:
        full = level * F.col("weight") > full_size
        size, used, open_, now = named.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if now == count or not open_:
            break
        level, count = F.lit((share * size - cap * (used or 0)) / open_), now
    target = F.when(full, full_size).otherwise(F.least(full_size, level * F.col("weight")))
    targets = scratch.keep(named.select("*", target.alias("target")))
    demand, turned = targets.agg(F.sum("target"), F.sum(F.col("target") * F.col("slope"))).first()
    return targets.withColumn("drift", F.lit(round(turned / demand, 12) if demand else 0.0))


def _position(done: Column, slope: Column, drift: Column) -> Column:
    """The share of all demand by the time at which the share `done` of a source's words is demanded."""
    root = (1 - slope) + F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * done, F.lit(0.0)))
    time = F.when(done <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * done / root))
    return time + drift * (time * time - time)


def curriculum(
    docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), slopes: Sequence[float] = (0.5, 0.0, -0.5), cap: float = 2.0, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, visits), a row for each row of docs.

    docs: doc_id, text and source; other columns are ignored. size counts words; a source's target
    is its part of share * all sizes, at most cap * its size. Documents are taken whole, pass after
    pass, until the target is reached; visits lists each pass with its words and training position.

    Texts are counted whole, however long; only their sizes are shuffled. A null text has size 0 and is never taken; null sources are one source, ordered last. Null
    doc_ids stand first in their source. Rows that repeat a doc_id are taken one after the other.
    The result depends on the rows alone, not on partitions. An empty table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "mix")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        ).select("*", key.alias("key"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("turn"))
    )
    digits = max(1, min(8, math.ceil(math.log(max(1, rows.count() / bucket_rows), 16))))
    rows = rows.withColumn("bucket", F.substring("turn", 1, digits))
    buckets = scratch.keep(rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")))
    sizes = buckets.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, scratch, share, weights, slopes, cap)
    stem = F.substring("bucket", 1, digits // 2).alias("stem")
    before_stem = Window.partitionBy("key").orderBy("stem").rowsBetween(Window.unboundedPreceding, -1)
    before_bucket = Window.partitionBy("key", "stem").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    stems = buckets.groupBy("key", stem).agg(F.sum("words").alias("words")).select("key", "stem", F.coalesce(F.sum("words").over(before_stem), F.lit(0)).alias("stem_ahead"))
    inside = buckets.select("key", "bucket", stem, "words").withColumn("inside", F.coalesce(F.sum("words").over(before_bucket), F.lit(0)))
    placed = inside.join(stems, ["key", "stem"]).select("key", "bucket", (F.col("stem_ahead") + F.col("inside")).alias("ahead")).join(targets, "key")

    within = Window.partitionBy("key", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = rows.join(placed, ["key", "bucket"]).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    wanted = F.floor("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.sequence(F.lit(0), F.lit(math.ceil(cap)))).otherwise(F.array().cast("array<int>"))

    def visit(turn: Column) -> Column:
        start = turn * F.col("source_size") + F.col("ahead")
        words = F.greatest(F.lit(0), F.least(F.col("size"), wanted - start))
        return F.struct(turn.alias("pass"), words.alias("words"), _position((start + words / 2) / F.col("target"), F.col("slope"), F.col("drift")).alias("position"))

    visits = F.filter(F.transform(passes, visit), lambda v: v["words"] > 0)
    taken = F.aggregate("visits", F.lit(0).cast("bigint"), lambda n, v: n + v["words"])
    return lined.withColumn("visits", visits).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "visits")


def training_order(plan: DataFrame) -> DataFrame:
    """The plan's visits, range-sorted by training position: (doc_id, pass, words, position)."""
    return plan.select("doc_id", F.explode("visits").alias("v")).select("doc_id", "v.pass", "v.words", "v.position").orderBy("position", "doc_id", "pass")


def mix(docs: DataFrame) -> DataFrame:
    """One row a document, range-sorted by its first training position; documents not taken come last.

    positions lists every visit, in billionths of the training, comma-joined; training_order gives a
    row a visit. Nulls, ties, repeats, long texts and empty tables as in curriculum.
    """
    plan = curriculum(docs)
    first = F.round(F.element_at(F.col("visits.position"), 1), 9)
    every = F.array_join(F.transform("visits", lambda v: F.round(v["position"] * 1e9).cast("bigint").cast("string")), ",")
    out = plan.select("doc_id", "size", "source_size", "target", "taken", F.when(F.size("visits") > 0, first).alias("position"), every.alias("positions"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """mix of documents: a row a document. Edge cases as in curriculum."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes),
weighted AS (SELECT *, CAST([3, 1, 2][CAST(rank % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST([0.5, 0.0, -0.5][CAST(rank % 3 + 1 AS INT)] AS DOUBLE) AS slope FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER w, 0) AS BIGINT)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted WINDOW w AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (SELECT arg_min(level, source_size / weight) AS f FROM levels WHERE level * weight <= 2.0 * source_size),
targets AS (SELECT source, source_size, slope, coalesce(least(2.0::DOUBLE * source_size, f * weight), 2.0::DOUBLE * source_size) AS target FROM levels, final),
drifts AS (SELECT round(sum(target * slope) / sum(target), 12) AS drift FROM targets),
lined AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.slope, d.drift, CAST(floor(t.target) AS BIGINT) AS wanted,
    CAST(coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source, drifts d
), visits AS (
  SELECT *, k * source_size + ahead AS start, greatest(0, least(size, wanted - k * source_size - ahead)) AS words FROM lined, range(0, 3) AS passes(k)
), shares AS (SELECT *, (start + words / 2.0::DOUBLE) / target AS u FROM visits),
times AS (
  SELECT *, CASE WHEN u <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * u / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * u, 0.0::DOUBLE)))) END AS t FROM shares
), placed AS (SELECT *, t + drift * (t * t - t) AS position FROM times)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken, round(min(position) FILTER (words > 0), 9) AS position,
  coalesce(string_agg(CAST(CAST(round(position * 1e9) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (words > 0), '') AS positions
FROM placed GROUP BY doc_id, size, source_size, target
"""
