"""Plans that must not grow faster than the input, and the rows they must give all the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import folds, graph, text, work
from quillgraph.plans import catalog, fixtures, text_queries
from quillgraph.plans.registry import Tables
from quillgraph.session import Scratch
from quillgraph.sources import tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def noted_plans(monkeypatch) -> list[str]:
    """The plans of all tables that are kept from now on."""
    plans, keep = [], Scratch.keep

    def noted(self, df, **options):
        plans.append(plan_of(df))
        return keep(self, df, **options)

    monkeypatch.setattr(Scratch, "keep", noted)
    return plans


@pytest.mark.parametrize("name", ["deps", "issue_labels"])
def test_fixtures_group_numbers_and_give_the_rows_of_their_view(name, spark, sf_dir):
    t = Tables(spark, sf_dir)
    plan = plan_of(getattr(t, name))
    assert "SortAggregate" not in plan and "HashAggregate(keys=[issue_id" not in plan
    odd = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(500)
    for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "l_returnflag", "l_linestatus"):
        odd = odd.union(odd.limit(40).withColumn(c, F.lit(None).cast(odd.schema[c].dataType)))
    t.lineitem = t.lineitem.union(odd.withColumn("l_suppkey", F.col("l_suppkey") + 1)).localCheckpoint()
    got = sorted(getattr(t, name).collect(), key=str)
    text = fixtures.VIEWS[name].replace("FROM lineitem", "FROM {lineitem}").replace("'{\"", "'{{\"").replace("}'", "}}'")
    assert got == sorted(spark.sql(text, lineitem=t.lineitem).collect(), key=str)


def test_closure_rounds_neither_sort_nor_shuffle_edges(spark, monkeypatch):
    rng = random.Random(12)
    pairs = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(320)] + [(None, "n1"), ("n1", None), ("n1", "n1")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    start = spark.createDataFrame([("n1",), ("n2",), ("n1",)], "id string")
    depth, level = {}, {"n1", "n2"}
    while level:
        depth |= dict.fromkeys(level, max(depth.values(), default=-1) + 1)
        level = {b for a, b in pairs if a in level and b is not None} - depth.keys()
    monkeypatch.setattr(graph, "SMALL", 0)
    plans = noted_plans(monkeypatch)
    for cap in (1, 3, 50):
        plans.clear()
        assert sorted(graph.closure(start, edges, cap).collect()) == sorted((i, d) for i, d in depth.items() if d <= cap)
        assert len(plans) > cap % 50 and not any("SortMergeJoin" in plan or "Sort [" in plan for plan in plans)
    assert max(depth.values()) > 3


def test_graph_queries_without_confidence_put_no_mention_in_order(spark, sf_dir, monkeypatch):
    mentions = spark.createDataFrame([(n, t, o, i / 10, i, i) for i, (n, t, o) in enumerate([(" A", "x", "o"), ("a", "x", "o"), ("a", "y", "o"), (None, "x", None), ("b ", "x", None)])], "name string, type string, org_id string, confidence double, ts bigint, seq bigint")
    want = sorted(graph.upsert_nodes(mentions).select("name", "type", "org_id", "mention_count").collect(), key=str)
    links = spark.createDataFrame([("A", "B", "r", 0.5, 1, 1), ("a", "c", "r", 0.5, 1, 1), ("b", " a", "r", 0.5, 2, 2)], "source string, target string, relation string, confidence double, ts bigint, seq bigint")
    edges = sorted(graph.ingest_graph(mentions, links)[1].collect())

    def refuse(*_, **__):
        raise AssertionError("a fold")

    monkeypatch.setattr(graph, "capped_fold", refuse)
    nodes, same = graph.ingest_graph(mentions, links, confidence=False)
    assert sorted(nodes.collect(), key=str) == want and sorted(same.collect()) == edges and len(edges) == 2
    for name in ("G10_traverse_graph", "G11_graph_context"):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["G12_waves", "G13_layers", "G25_merged_dependencies", "G6_ready_items", "G6_blocked_items", "M15_promoted_labels", "M15_promoted_dependencies"])
def test_dependencies_are_derived_once_a_query(name, spark, sf_dir, monkeypatch):
    plans = noted_plans(monkeypatch)
    plans.append(plan_of(catalog.QUERIES[name](spark, sf_dir)))
    assert sum(len(re.findall(r"FileScan parquet \[l_", plan)) for plan in plans) == 1


def test_merged_links_are_sorted_once(spark):
    issues = spark.createDataFrame([(i, "t", "open", 1, "") for i in "abc"], "id string, title string, status string, priority int, description string")
    deps = spark.createDataFrame([("c", "b", "blocks", ""), ("c", "b", "related", ""), ("a", "c", "parent-child", "")], "issue_id string, depends_on_id string, type string, metadata string")
    plan = spark.createDataFrame([("b", "a"), ("c", "a")], "id string, target string")
    links = work.apply_merge(issues, deps, plan)[1]
    assert "REPARTITION_BY_COL" in plan_of(links)
    assert sorted(links.select("issue_id", "depends_on_id", "type").collect()) == [("b", "a", "related"), ("c", "a", "related"), ("c", "b", "blocks")]


def test_export_reads_dependencies_from_one_table(spark, sf_dir, monkeypatch):
    plans, export = [], tables.export_issues
    monkeypatch.setattr(tables, "export_issues", lambda rows, path: (plans.append(plan_of(rows)), export(rows, path))[1])
    read = []
    monkeypatch.setattr(type(spark.read), "schema", lambda self, s, was=type(spark.read).schema: (read.append(s), was(self, s))[1])
    found = catalog.QUERIES["S5_export_issues_jsonl"](spark, sf_dir)
    # labels alone are derived in the export; what was written is not read to find its columns
    assert len(re.findall(r"FileScan parquet \[l_", plans[0])) == 1 and any("labels array<string>" in str(s) for s in read)
    assert dict(found.dtypes)["dependency_count"] == "bigint"


def test_fold_sorts_by_a_number_and_stands_shared_numbers(spark, monkeypatch):
    rng = random.Random(16)
    rows = [(rng.choice(["a", "b", None]), i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "name string, ts bigint, c double").repartition(5)
    want = {}
    for name, _, c in rows:
        n, at = want.get(name, (0, None))
        want[name] = (n + 1, c if at is None else min(1.0, 0.8 * at + 0.2 * c + 0.05))
    plans = noted_plans(monkeypatch)
    for number in (F.xxhash64, lambda *_: F.lit(7)):
        monkeypatch.setattr(folds.F, "xxhash64", number)
        got = {r["name"]: (r["n"], r["confidence"]) for r in folds.capped_fold(df, ["name"], ["ts"], "c", 0.8, 0.2, 0.05, bits=2).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - at) < 1e-9 for k, (n, at) in want.items())
        assert any("Sort [place" in plan or "Sort [7" in plan for plan in plans)


def test_near_duplicates_shuffle_texts_once_whatever_the_blocks(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))).replace(" ", "x ")) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3).localCheckpoint()
    plans, found = noted_plans(monkeypatch), []
    for texts in (100, 4):
        plans.clear()
        near = text.near_duplicates(df, 0.3, texts=texts)
        assert "Exchange" not in plan_of(near) and sum(plan.count("Exchange") for plan in plans) == 1
        found.append(sorted(near.collect()))
    assert found[0] == found[1] and len(found[0]) > 100


def test_near_duplicates_of_many_copies_and_large_counts(spark, duck):
    """More copies than stand together, sums that single precision doesn't hold, words that only few texts have."""
    rng = random.Random(22)
    rows = [(i, "the same words here") for i in range(600)] + [(600 + i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=60))) for i in range(300)]
    rows += [(2000 + i, "many " * 5000 + "more " * (4990 + i) + f"w{i} ") for i in range(4)] + [(3000, "many words"), (3001, "w1 w1 w1 w2"), (3002, "the same words")]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    duck.sql("CREATE OR REPLACE TEMP TABLE near_rows (vec_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO near_rows VALUES (?, ?)", rows)
    want = sorted(duck.sql(f"WITH x AS (SELECT * FROM near_rows), {text_queries.NEAR}").fetchall())
    for blocks in ({}, {"texts": 300}):
        assert sorted(map(tuple, text.near_duplicates(df, 0.4, **blocks).collect())) == want
    assert len(want) > 180_000 and {b for _, b, _ in want} >= {2003, 3002}
