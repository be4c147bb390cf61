"""Queries over request logs, benchmark runs and plain tables, and round trips through files."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import analytics
from ..session import Scratch
from ..sources import tables
from .registry import query

NOW = dt.datetime(2024, 1, 31)
N = "TIMESTAMP '2024-01-31 00:00:00'"
USE = "count(*) AS n, round(avg(duration), 6) AS avg_duration, max(created_at) AS last_used"


@query("A13_usage_by_type", f"SELECT type, {USE} FROM api_requests WHERE created_at >= {N} - INTERVAL 7 DAY AND created_at < {N} GROUP BY 1")
def _(t):
    return analytics.usage(t.api_requests.filter(analytics.in_period("7d", NOW)), "type")


@query("A13_usage_by_key", f"SELECT key_id, type, {USE} FROM api_requests GROUP BY 1, 2")
def _(t):
    return analytics.usage(t.api_requests, "key_id", "type")


@query("A14_usage_hourly", "SELECT date_trunc('hour', created_at) AS hour, count(*) AS n, round(avg(duration), 6) AS avg_duration FROM api_requests GROUP BY 1")
def _(t):
    return analytics.usage_hourly(t.api_requests)


ERR = "count(*) AS total, count(*) FILTER (status_code >= 400) AS errors, round(100.0::DOUBLE * count(*) FILTER (status_code >= 400) / count(*), 6) AS error_rate, round(100 - 100.0::DOUBLE * count(*) FILTER (status_code >= 400) / count(*), 6) AS success_rate, max(created_at) AS last_request"


@query("A15_error_report", f"SELECT type, key_id, {ERR} FROM api_requests GROUP BY 1, 2")
def _(t):
    return analytics.error_report(t.api_requests, "type", "key_id")


@query("A15_status_shares", "SELECT status_code, type, count(*) AS n, round(100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER () AS BIGINT), 6) AS percent FROM api_requests GROUP BY 1, 2")
def _(t):
    return analytics.status_shares(t.api_requests)


def _period(p, d):
    cur = f"created_at >= {N} - INTERVAL {d} DAY AND created_at < {N}" if d else "true"
    old = f"created_at >= {N} - INTERVAL {2 * d} DAY AND created_at < {N} - INTERVAL {d} DAY" if d else "false"
    s = lambda c, w: f"CAST(coalesce(sum({c}) FILTER ({w}), 0) AS BIGINT)"
    return f"SELECT '{p}' AS period, {s('original_tokens', cur)} AS tokens_processed, {s('final_tokens', cur)} AS tokens_sent, {s('original_tokens - final_tokens', cur)} AS tokens_saved, {s('original_tokens - final_tokens', old)} AS tokens_saved_before FROM api_requests"


@query("A16_period_comparison", " UNION ALL ".join(_period(p, d) for p, d in (("7d", 7), ("30d", 30), ("90d", 90), ("lifetime", 0))))
def _(t):
    return analytics.period_comparison(t.api_requests, NOW)


@query("A17_tokens_by_weekday", "SELECT key_id, " + ", ".join(f'CAST(sum(original_tokens) FILTER (dayofweek(created_at) = {i}) AS BIGINT) AS "{d}"' for i, d in enumerate(("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))) + " FROM api_requests GROUP BY 1")
def _(t):
    return analytics.tokens_by_weekday(t.api_requests)


@query("A18_growth", f"""WITH g AS (SELECT type, count(*) FILTER (created_at >= {N} - INTERVAL 7 DAY) AS n, count(*) FILTER (created_at < {N} - INTERVAL 7 DAY) AS before FROM api_requests WHERE created_at >= {N} - INTERVAL 14 DAY AND created_at < {N} GROUP BY 1)
SELECT *, round((n - before) / nullif(before, 0)::DOUBLE, 6) AS growth FROM g""")
def _(t):
    return analytics.growth(t.api_requests, NOW)


NUMERIC = "SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max, count(*) - count({c}) AS nulls FROM {t}"


@query("A20_numeric_summary", " UNION ALL ".join(NUMERIC.format(c=c, t="part") for c in ("p_partkey", "p_size", "p_retailprice")))
def _(t):
    return analytics.numeric_summary(t.part)


@query("A21_categorical_summary", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS total, count(v) AS \"distinct\", CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS nulls, arg_max(v, n * 1000000 - r) AS mode FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM part GROUP BY 1)" for c in ("p_name", "p_brand", "p_type")))
def _(t):
    return analytics.categorical_summary(t.part).drop("top")


@query("A22_inspect", "SELECT 'c_custkey' AS \"column\", count(*) AS rows, count(c_custkey) AS non_null FROM customer UNION ALL SELECT 'c_name', count(*), count(c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', count(*), count(c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(c_mktsegment) FROM customer")
def _(t):
    return analytics.inspect(t.customer).drop("type")


BENCH = " UNION ALL ".join(f"SELECT config, '{m}' AS metric, round(avg({m}), 4) AS mean, round(coalesce(stddev_samp({m}), 0), 4) AS stddev, round(min({m}), 4) AS min, round(max({m}), 4) AS max FROM bench_runs GROUP BY 1" for m in ("pass_rate", "time_seconds", "tokens"))


@query("A23_benchmark_summary", BENCH)
def _(t):
    return analytics.benchmark_summary(t.bench_runs)


@query("A23_benchmark_delta", f"WITH b AS ({BENCH}) SELECT x.metric, round(x.mean - y.mean, 4) AS delta FROM b x JOIN b y USING (metric) WHERE x.config = 'config1' AND y.config = 'config2'")
def _(t):
    return analytics.benchmark_delta(analytics.benchmark_summary(t.bench_runs), "config1", "config2")


@query("A24_trigger_rates", "SELECT query, should_trigger, count(*) AS runs, count(*) FILTER (triggered) AS triggers, CASE WHEN should_trigger THEN avg(triggered::INT) >= 0.5 ELSE avg(triggered::INT) < 0.5 END AS passed FROM trigger_runs GROUP BY 1, 2")
def _(t):
    return analytics.trigger_rates(t.trigger_runs)


@query("A25_memscore", "SELECT run, provider, question_type, count(*) AS n, round(100.0::DOUBLE * avg(correct::INT), 6) AS accuracy, round(avg(latency), 6) AS latency, round(avg(context_tokens), 6) AS context_tokens, CAST(sum(context_tokens) AS BIGINT) AS total_tokens FROM qa_runs GROUP BY 1, 2, 3")
def _(t):
    return analytics.memscore(t.qa_runs, "run", "provider", "question_type")


@query("W8_running_total_and_rank", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running_total, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INT) AS amount_rank FROM orders")
def _(t):
    return analytics.running_total_and_rank(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", F.round("running_total", 2).alias("running_total"), "amount_rank")


# patterns of ad-hoc SQL: the same text runs on both engines


def adhoc(name, sql, *names):
    query(name, sql)(lambda t: tables.run_sql(t.spark, sql, {n: getattr(t, n) for n in names}))


adhoc("Q1_distribution", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY o_orderstatus", "orders")
adhoc("Q2_revenue_by_month", "SELECT l_returnflag, date_trunc('month', l_shipdate) AS month, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, date_trunc('month', l_shipdate)", "lineitem")
adhoc("Q3_top_customers", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY o_custkey ORDER BY spend DESC, o_custkey LIMIT 10", "orders")
adhoc("Q4_cross_file_join", "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 400000 AND c.c_acctbal > 0", "customer", "orders")
adhoc("Q5_pivot_by_month", "SELECT l_returnflag, " + ", ".join(f"round(sum(CASE WHEN month(l_shipdate) = {m} THEN l_extendedprice ELSE 0 END), 2) AS m{m}" for m in range(1, 13)) + " FROM lineitem GROUP BY l_returnflag", "lineitem")
adhoc("Q6_average_order_by_region", "SELECT r.r_name, round(avg(o.o_totalprice), 4) AS avg_value, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", "orders", "customer", "nation", "region")


@query("Q7_query_with_names", "SELECT p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_type")
def _(t):
    return tables.run_sql(t.spark, 'SELECT p_type, count(*) AS n FROM "2024 parts.csv" WHERE p_size > 10 GROUP BY p_type', {"2024 parts.csv": t.part})


# round trips through files


@query("S1_read_tables", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    at = Scratch(t.spark, "csv").base + "/2024-customers.csv"
    tables.export_result(t.customer.select("c_custkey", "c_name", "c_acctbal"), at, "csv")
    return tables.read_tables(t.spark, [at])["t_2024_customers"].select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal")


@query("S2_export_result", "SELECT '| ' || CAST(s_suppkey AS VARCHAR) || ' | ' || s_name || ' |' AS line FROM supplier UNION ALL SELECT '| s_suppkey | s_name |' UNION ALL SELECT '| --- | --- |'")
def _(t):
    at = Scratch(t.spark, "markdown").base
    tables.export_result(t.supplier.select("s_suppkey", "s_name"), at, "markdown")
    return t.spark.read.text([f"{at}/part=0", f"{at}/part=1"]).select(F.col("value").alias("line"))


def org_tables(t):
    threads = t.messages.select("thread_id", F.concat(F.lit("org"), (F.col("thread_id") % 2).cast("string")).alias("org_id")).distinct()
    spaces = t.memories.select("space_id", "org_id").distinct()
    return {
        "documents": t.docs.select("id", "org_id", "title", "status"), "memories": t.memories.select("id", "org_id", "memory", "confidence", "memory_level", "version", "is_latest"), "spaces": spaces,
        "links": t.doc_spaces.select(F.col("document_id").cast("string").alias("document_id"), "space_id"), "threads": threads, "messages": t.messages.select("thread_id", "turn", "role", "content"),
    }


@query("S3_export_org", "SELECT thread_id, count(*) AS n, string_agg(content, '|' ORDER BY turn) AS texts FROM messages WHERE thread_id % 2 = 0 GROUP BY 1")
def _(t):
    threads = tables.export_org(org_tables(t), "org0")["threads"]
    return threads.select("thread_id", F.size("messages").cast("bigint").alias("n"), F.array_join("messages.content", "|").alias("texts"))


@query("S4_import_org", "SELECT id, CASE WHEN org_id = 'org0' THEN 'org9' ELSE org_id END AS org_id, coalesce(confidence, CASE WHEN org_id = 'org0' THEN 1.0::DOUBLE END) AS confidence, memory_level FROM memories")
def _(t):
    have = org_tables(t)
    at = Scratch(t.spark, "backup").base
    tables.write_org(tables.export_org(have, "org0"), at)
    rest = {k: (v.filter("org_id <> 'org0'") if "org_id" in v.columns else v) for k, v in have.items()}
    return tables.import_org(t.spark, at, rest, "org9")["memories"].select("id", "org_id", "confidence", "memory_level")


@query("S5_export_issues_jsonl", """WITH a AS (SELECT issue_id AS id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM issue_labels GROUP BY 1), b AS (SELECT issue_id AS id, count(*) AS n FROM deps GROUP BY 1), c AS (SELECT depends_on_id AS id, count(*) AS n FROM deps GROUP BY 1), d AS (SELECT issue_id AS id, count(*) AS n FROM comments GROUP BY 1)
SELECT i.id, labels, CAST(coalesce(b.n, 0) AS BIGINT) AS dependency_count, coalesce(c.n, 0) AS dependent_count, coalesce(d.n, 0) AS comment_count FROM issues i LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id) LEFT JOIN d USING (id)""")
def _(t):
    at = Scratch(t.spark, "issues").base
    tables.export_issues(tables.issue_rows(t.issues, t.kept("deps"), t.issue_labels, t.comments), at)
    # a schema, as finding one reads all that was written
    back = t.spark.read.schema("id string, labels array<string>, dependency_count bigint, dependent_count bigint, comment_count bigint").json(at)
    return back.select("id", F.array_join("labels", ",").alias("labels"), "dependency_count", "dependent_count", "comment_count")


@query("S6_import_issues_jsonl", "SELECT id, CASE WHEN priority = 2 THEN 'moved' ELSE title END AS title, created_at FROM issues")
def _(t):
    at = Scratch(t.spark, "issues").base
    rows = t.issues.select("id", "title", "priority", "created_at")
    tables.export_issues(rows.filter("priority = 2").withColumn("title", F.lit("moved")).union(rows.filter("priority = 4")), at)
    return tables.import_issues(t.spark, at, rows.filter("priority < 4")).select("id", "title", "created_at")
