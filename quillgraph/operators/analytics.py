"""Usage, error and benchmark analytics; summaries of tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIODS = {"1h": dt.timedelta(hours=1), "24h": dt.timedelta(days=1), "7d": dt.timedelta(days=7), "30d": dt.timedelta(days=30), "90d": dt.timedelta(days=90)}


def in_period(period: str, now: dt.datetime, column: str = "created_at") -> Column:
    return (F.col(column) >= F.lit(now - PERIODS[period])) & (F.col(column) < F.lit(now))


def usage(requests: DataFrame, *by: str) -> DataFrame:
    return requests.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("avg_duration"), F.max("created_at").alias("last_used"))


def usage_hourly(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("avg_duration"))


def error_report(requests: DataFrame, *by: str) -> DataFrame:
    bad = F.sum((F.col("status_code") >= 400).cast("bigint"))
    return requests.groupBy(*by).agg(F.count("*").alias("total"), bad.alias("errors"), F.round(100 * bad / F.count("*"), 6).alias("error_rate"), F.round(100 - 100 * bad / F.count("*"), 6).alias("success_rate"), F.max("created_at").alias("last_request"))


def status_shares(requests: DataFrame) -> DataFrame:
    """(status_code, type, n, percent of all)."""
    per = requests.groupBy("status_code", "type").agg(F.count("*").alias("n"))
    return per.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def period_comparison(requests: DataFrame, now: dt.datetime, periods: Sequence[str] = ("7d", "30d", "90d")) -> DataFrame:
    """(period, tokens now and before, change) for each period and the one before it, and lifetime."""
    spans = [(p, F.lit(now - PERIODS[p]), F.lit(now - 2 * PERIODS[p])) for p in periods]
    rows = requests.withColumn("saved", F.col("original_tokens") - F.col("final_tokens"))
    tags = F.array_compact(F.array(*(x for p, a, b in spans for x in (
        F.when((F.col("created_at") >= a) & (F.col("created_at") < F.lit(now)), F.struct(F.lit(p).alias("period"), F.lit(True).alias("current"))),
        F.when((F.col("created_at") >= b) & (F.col("created_at") < a), F.struct(F.lit(p).alias("period"), F.lit(False).alias("current"))),
    )), F.struct(F.lit("lifetime").alias("period"), F.lit(True).alias("current"))))
    each = rows.select("original_tokens", "final_tokens", "saved", F.explode(tags).alias("t"))
    when = lambda c, x: F.coalesce(F.sum(F.when(F.col("t.current") == x, F.col(c))), F.lit(0))
    return each.groupBy("t.period").agg(
        when("original_tokens", True).alias("tokens_processed"), when("final_tokens", True).alias("tokens_sent"), when("saved", True).alias("tokens_saved"), when("saved", False).alias("tokens_saved_before")
    )


def tokens_by_weekday(requests: DataFrame) -> DataFrame:
    days = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
    return requests.groupBy("key_id").pivot("d", list(days)).agg(F.sum("t")) if "d" in requests.columns else tokens_by_weekday(requests.select("key_id", F.date_format("created_at", "E").alias("d"), F.col("original_tokens").alias("t")))


def growth(requests: DataFrame, now: dt.datetime, period: str = "7d") -> DataFrame:
    """(type, n, before, growth) with growth = (n - before) / before, null without any before."""
    span = PERIODS[period]
    current = F.sum((F.col("created_at") >= F.lit(now - span)).cast("bigint"))
    before = F.sum((F.col("created_at") < F.lit(now - span)).cast("bigint"))
    rows = requests.filter((F.col("created_at") >= F.lit(now - 2 * span)) & (F.col("created_at") < F.lit(now)))
    return rows.groupBy("type").agg(current.alias("n"), before.alias("before")).withColumn("growth", F.round(F.try_divide(F.col("n") - F.col("before"), F.col("before")), 6))


def is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


#: Rank error of a sketch that brackets a quantile: one row in ACCURACY.
ACCURACY = 10_000


def quantiles(df: DataFrame, names: Sequence[str], shares: Sequence[float], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of numeric columns; None for a column without values, NaN is the largest value.

    A sketch over the rows still open brackets each wanted rank; counts tell whether the rank lies on
    an end of its bracket or between two ends, and the rows there are what the next round looks at.
    A round leaves a few rows in `accuracy` open, so no task holds the values of a column; the driver
    gets some numbers for each column and share.
    """
    value_of = lambda c: F.col(f"`{c}`").cast("double")
    around = lambda share: [min(1.0, max(0.0, share + d / accuracy)) for d in (-2, 2)]
    sketch = lambda v, share: F.percentile_approx(v, around(share), accuracy)
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in names}
    sizes, *ends = df.agg(F.array(*(F.count(F.col(f"`{c}`")) for c in names)), *(sketch(value_of(c), s) for c in names for s in shares)).first()
    keys = [(c, i) for c in names for i in range(len(shares))]
    #: (column, number of the share) -> rank among its open rows, their number, the condition of being open
    wanted = {(c, i): (int(shares[i] * (n - 1)), n, value_of(c).isNotNull()) for c, n in zip(names, sizes) for i in range(len(shares)) if n}
    part = {(c, i): shares[i] * (n - 1) % 1 for c, n in zip(names, sizes) for i in range(len(shares)) if n}
    bracket = {k: e for k, e in zip(keys, ends) if k in wanted}

    def counted(key: tuple[str, int]) -> Column:
        v, still, (low, high) = value_of(key[0]), wanted[key][2], (F.lit(x) for x in bracket[key])
        above = lambda end: F.min(F.when(v > end, v))
        return F.struct(*(F.count_if(still & test) for test in (v < low, v <= low, v < high, v <= high)), above(low), above(high))

    while wanted:
        found = df.agg(*(counted(k) for k in wanted)).first()
        after = {}
        for (key, (rank, n, still)), (below, to_low, to_high, top, above_low, above_high) in zip(wanted.items(), found):
            (low, high), v = bracket[key], value_of(key[0])
            # the value at the rank, or the next one for its share of the way there
            here = lambda x, up_to, above: x if not part[key] or rank + 1 < up_to or x == above else (1 - part[key]) * x + part[key] * above  # noqa: B023, E731
            if rank < below:
                after[key] = rank, below, still & (v < F.lit(low))
            elif rank < to_low:
                out[key[0]][key[1]] = here(low, to_low, above_low)
            elif rank < to_high:
                after[key] = rank - to_low, to_high - to_low, still & (v > F.lit(low)) & (v < F.lit(high))
            elif rank < top:
                out[key[0]][key[1]] = here(high, top, above_high)
            else:
                after[key] = rank - top, n - top, still & (v > F.lit(high))
        wanted = after
        if wanted:
            bracket = dict(zip(wanted, df.agg(*(sketch(F.when(still, value_of(c)), (rank + 0.5) / n) for (c, _), (rank, n, still) in wanted.items())).first()))
    return out


def numeric_summary(df: DataFrame) -> DataFrame:
    """(column, n, mean, std, min, q25, median, q75, max, nulls) of numeric columns; quantiles are exact, by rounds of counts."""
    names = [f.name for f in df.schema.fields if is_number(f)]
    found = quantiles(df, names, (0.25, 0.5, 0.75))
    share = lambda c, i, name: F.round(F.lit(found[c][i]).cast("double"), 6).alias(name)
    one = lambda c, v: F.struct(
        F.lit(c).alias("column"), F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).cast("double").alias("min"),
        share(c, 0, "q25"), share(c, 1, "median"), share(c, 2, "q75"), F.max(v).cast("double").alias("max"), F.count_if(v.isNull()).alias("nulls"),
    )
    return df.agg(F.array(*(one(c, F.col(f"`{c}`")) for c in names)).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) of the columns that are not numeric."""
    names = [f.name for f in df.schema.fields if not is_number(f)]
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names))).alias("s"))
    return long.groupBy("s.column", "s.value").agg(F.count("*").alias("n"))


def categorical_summary(df: DataFrame, top: int = 5) -> DataFrame:
    """(column, total, distinct, nulls, mode, top): the commonest values with counts; ties by value."""
    counts = value_counts(df)
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.filter("value IS NOT NULL").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    best = ranked.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("r", "value", "n"))).alias("t"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    return totals.join(best, "column", "left").select("column", "total", "distinct", "nulls", F.col("t")[0]["value"].alias("mode"), F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top"))


def inspect(df: DataFrame) -> DataFrame:
    """(column, type, rows, non_null) in column order."""
    one = lambda f: F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("rows"), F.count(f.name).alias("non_null"))
    return df.agg(F.array(*(one(f) for f in df.schema.fields)).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def benchmark_summary(runs: DataFrame, metrics: Sequence[str] = ("pass_rate", "time_seconds", "tokens")) -> DataFrame:
    """(config, metric, mean, stddev, min, max) with four decimals; one run has no spread."""
    long = runs.select("config", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select("config", "x.*")
    r4 = lambda c: F.round(c, 4)
    return long.groupBy("config", "metric").agg(r4(F.avg("v")).alias("mean"), r4(F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("stddev"), r4(F.min("v")).alias("min"), r4(F.max("v")).alias("max"))


def benchmark_delta(summary: DataFrame, first: str, second: str) -> DataFrame:
    a, b = (summary.filter(F.col("config") == c).select("metric", F.col("mean").alias(n)) for c, n in ((first, "a"), (second, "b")))
    return a.join(b, "metric").select("metric", F.round(F.col("a") - F.col("b"), 4).alias("delta"))


def trigger_rates(runs: DataFrame) -> DataFrame:
    """(query, should_trigger, runs, triggers, passed): half of the runs decide."""
    rate = F.avg(F.col("triggered").cast("double"))
    should = F.col("should_trigger")
    out = runs.groupBy("query", "should_trigger").agg(F.count("*").alias("runs"), F.sum(F.col("triggered").cast("bigint")).alias("triggers"), rate.alias("rate"))
    return out.select("query", "should_trigger", "runs", "triggers", F.when(should, F.col("rate") >= 0.5).otherwise(F.col("rate") < 0.5).alias("passed"))


def memscore(runs: DataFrame, *by: str) -> DataFrame:
    """Accuracy in percent, mean latency, mean and total context tokens."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(100 * F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("latency"), 6).alias("latency"),
        F.round(F.avg("context_tokens"), 6).alias("context_tokens"), F.sum("context_tokens").alias("total_tokens"),
    )


def running_total_and_rank(rows: DataFrame, key: str, order: Sequence[str], amount: str) -> DataFrame:
    """rows with the running total and the rank of the amount, inside each key."""
    w = Window.partitionBy(key)
    return rows.withColumns({"running_total": F.sum(amount).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), "amount_rank": F.rank().over(w.orderBy(F.desc(amount)))})
