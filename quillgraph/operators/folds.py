"""Folds of ordered rows, c <- min(1, keep * c + gain * v + add), in which no list holds a whole key.

A step is min(m, a * c + b), and so is any run of steps. Rows are sorted by key and order over ranges
and cut into runs; each run folds to one step, and levels of at most 2 ** BITS pieces follow until every
key has few enough for one list. So a popular key is many short lists, however its rows lie in time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, prepare

BITS = 10


def in_runs(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """(key, piece, steps): rows in order in runs of at most 2 ** bits; pieces rise with the order.

    Rows of equal order go by value. The table is written, as the numbers hold for one placement of rows.
    Rows are sorted by a number that stands for the key, as long texts compare slowly; should two keys share
    one, their rows lie among each other, each key's own still in order.
    """
    sort = ["place", *order, "v"]
    flat = rows.select(*key, *order, F.col(value).cast("double").alias("v"), F.xxhash64(*key).alias("place"))
    placed = flat.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("piece", F.shiftright(F.monotonically_increasing_id(), bits))
    return scratch.keep(placed.groupBy(*key, "piece").agg(F.sort_array(F.collect_list(F.struct(*order, "v"))).alias("steps")))


def after(s: Column, a: Column, b: Column, m: Column) -> Column:
    """The step s followed by min(m, a * c + b)."""
    return F.struct((a * s["a"]).alias("a"), (a * s["b"] + b).alias("b"), F.least(m, a * s["m"] + b).alias("m"))


def applied(step: Column, c: Column) -> Column:
    return F.least(step["m"], step["a"] * c + step["b"])


def _nothing() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1e300).alias("m"))


def pieces_of(level: DataFrame, key: Sequence[str], up: Column | None = None) -> DataFrame:
    """(key, up, pieces): the pieces of a level in order, in one list for each value of up."""
    groups = [*key] if up is None else [*key, up.alias("up")]
    return level.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("piece", "n", "first", "all", "rest"))).alias("pieces"))


def parent(bits: int = BITS) -> Column:
    return F.shiftright("piece", bits)


def levels(runs: DataFrame, key: Sequence[str], keep: float, gain: float, add: float, scratch: Scratch, bits: int = BITS) -> list[DataFrame]:
    """(key, piece, n, first, all, rest) of runs, of runs of runs, and so on, to at most 2 ** bits pieces a key.

    all is the step of the whole piece, rest the one without its first row, whose value is first.
    """
    one = lambda s, x: after(s, F.lit(keep), gain * x["v"] + F.lit(add), F.lit(1.0))
    more = lambda s, x: after(s, x["all"]["a"], x["all"]["b"], x["all"]["m"])
    others = lambda c: F.slice(c, 2, 1 << 30)
    found = [scratch.keep(runs.select(
        *key, "piece", F.size("steps").cast("bigint").alias("n"), F.col("steps")[0]["v"].alias("first"),
        F.aggregate("steps", _nothing(), one).alias("all"), F.aggregate(others("steps"), _nothing(), one).alias("rest"),
    ))]
    while (found[-1].groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > 1 << bits:
        head = F.col("pieces")[0]
        found.append(scratch.keep(pieces_of(found[-1], key, parent(bits)).select(
            *key, F.col("up").alias("piece"), F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("n"), head["first"].alias("first"),
            F.aggregate("pieces", _nothing(), more).alias("all"), F.aggregate(others("pieces"), head["rest"], more).alias("rest"),
        )))
    return found


def capped_fold(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, keep: float, gain: float, add: float, bits: int = BITS) -> DataFrame:
    """(key, confidence, n): per key the fold of all rows in order; the first value starts it."""
    scratch = Scratch(prepare(rows.sparkSession), "fold")
    top = pieces_of(levels(in_runs(rows, key, order, value, scratch, bits), key, keep, gain, add, scratch, bits)[-1], key)
    head = F.col("pieces")[0]
    confidence = F.aggregate(F.slice("pieces", 2, 1 << 30), applied(head["rest"], head["first"]), lambda c, s: applied(s["all"], c))
    return top.select(*key, confidence.alias("confidence"), F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, s: n + s["n"]).alias("n"))


def starts(found: list[DataFrame], key: Sequence[str], begin: DataFrame, scratch: Scratch, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """From (key, c, n) before the first row: (key, c, n) after the last, and (key, piece, c, n) before each run.

    Lists are walked from the highest level down; each has at most 2 ** bits pieces.
    """

    def walked(lists: DataFrame, by: list[str]) -> DataFrame:
        zero = F.struct(F.col("c").alias("c"), F.col("n").alias("n"), F.array().cast("array<struct<piece:bigint,c:double,n:bigint>>").alias("out"))
        step = lambda x, p: F.struct(
            applied(p["all"], x["c"]).alias("c"), (x["n"] + p["n"]).alias("n"),
            F.concat(x["out"], F.array(F.struct(p["piece"].alias("piece"), x["c"].alias("c"), x["n"].alias("n")))).alias("out"),
        )
        return lists.select(*by, F.aggregate("pieces", zero, step).alias("w"))

    def inner(w: DataFrame) -> DataFrame:
        return w.select(*key, F.explode("w.out").alias("o")).select(*key, "o.piece", "o.c", "o.n")

    first = begin.select(*key, F.col("c").cast("double").alias("c"), F.col("n").cast("bigint").alias("n"))
    top = scratch.keep(walked(pieces_of(found[-1], key).join(first, list(key)), list(key)))
    last, at = top.select(*key, "w.c", "w.n"), inner(top)
    for level in reversed(found[:-1]):
        lists = pieces_of(level, key, parent(bits)).join(at.withColumnRenamed("piece", "up"), [*key, "up"])
        at = inner(walked(lists, [*key]))
    return last, at
