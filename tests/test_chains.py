"""Longest paths and strong components against plain loops, on random and on deep graphs."""

import random

from quillgraph.operators import chains, components, graph
from quillgraph.session import Scratch

EDGES = "src string, dst string"


def plain_components(edges):
    """Components of nodes on cycles: what a node reaches, by repeated unions."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, stack = set(), list(after.get(n, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += after.get(x, ())
        reach[n] = seen
    return {n: min(m for m in r if n in reach[m]) for n, r in reach.items() if n in r}


def plain_lengths(nodes, edges):
    out, left = {}, {n: {b for a, b in edges if a == n} for n in nodes}
    while ready := [n for n, bs in left.items() if bs <= out.keys()]:
        for n in ready:
            out[n] = max((out[b] + 1 for b in left[n]), default=0)
        for n in ready:
            del left[n]
    return out


def graphs():
    rng = random.Random(9)
    name = lambda i: f"n{i:03d}"
    for nodes, many in ((30, 25), (30, 40), (40, 60), (60, 62), (25, 80)):
        yield [(name(rng.randrange(nodes)), name(rng.randrange(nodes))) for _ in range(many)]
    # a tail into a circle, a circle with a way out, two circles that share a node, loops, a ladder
    yield [(name(i), name(i + 1)) for i in range(20)] + [(name(20), name(12)), (name(30), name(31)), (name(31), name(30)), (name(31), name(40)), (name(50), name(51)), (name(51), name(50)), (name(51), name(52)), (name(52), name(51)), (name(60), name(60)), (name(61), name(60)), (name(60), name(62))]
    yield [(name(2 * i), name(2 * i + j)) for i in range(15) for j in (2, 3)] + [(name(2 * i + 1), name(2 * i + j)) for i in range(15) for j in (2, 3)]


def test_random_graphs(spark):
    """All side by side, as one graph."""
    edges = [(f"g{i}-{a}", f"g{i}-{b}") for i, part in enumerate(graphs()) for a, b in part]
    df = spark.createDataFrame([*edges, edges[0], (None, "g0-n001"), ("g0-n001", None)], EDGES)
    want = plain_components(edges)
    assert {r["id"]: r["component"] for r in graph.cycle_nodes(df).collect()} == want
    # no part of it in one task
    few = [e for e in edges if e[0][:3] in ("g0-", "g5-")]
    got = chains.strong_components(spark.createDataFrame(few, EDGES), Scratch(spark, "t"), finish=0)
    assert {r["id"]: r["component"] for r in got.collect()} == plain_components(few)
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    got = chains.longest_paths(spark.createDataFrame([(n,) for n in nodes], "id string"), df, Scratch(spark, "t")).collect()
    assert {r["id"]: r["length"] for r in got} == plain_lengths(nodes, edges) and len(got) == len({r["id"] for r in got})


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert graph.cycle_nodes(none).collect() == []
    assert chains.longest_paths(spark.createDataFrame([("a",)], "id string"), none, Scratch(spark, "t")).collect() == [("a", 0)]
    assert chains.longest_paths(spark.createDataFrame([], "id string"), none, Scratch(spark, "t")).collect() == []


def test_chain_of_5000(spark):
    """Tens of tables are written where a round a level would write thousands."""
    line = spark.range(5000).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst")
    scratch = Scratch(spark, "line")
    assert chains.strong_components(line, scratch).count() == 0 and scratch.count < 40
    ring = line.union(spark.createDataFrame([("n5000", "n0"), ("n0", "out"), ("in", "n77")], EDGES))
    scratch = Scratch(spark, "ring")
    got = chains.strong_components(ring, scratch)
    assert [tuple(r) for r in got.groupBy("component").count().collect()] == [("n0", 5001)] and scratch.count < 60
    scratch = Scratch(spark, "paths")
    nodes = spark.range(5001).selectExpr("concat('n', id) AS id")
    got = chains.longest_paths(nodes, line, scratch)
    assert {r["id"]: r["length"] for r in got.collect()} == {f"n{i}": 5000 - i for i in range(5001)} and scratch.count < 40


def test_loop_of_a_chain_inside_a_component(spark):
    """a gets a loop when x is contracted, and is itself contracted between b and c afterwards."""
    edges = [("a", "x"), ("x", "a"), ("b", "a"), ("a", "c"), ("c", "b"), ("b", "d"), ("d", "c"), ("e", "e"), ("e", "a"), ("f", "f"), ("f", "g"), ("g", "f")]
    got = chains.strong_components(spark.createDataFrame(edges, EDGES), Scratch(spark, "t"), finish=0).collect()
    assert len(got) == 8 and {r["id"]: r["component"] for r in got} == plain_components(edges)


def test_components_reduce_numbers(spark, monkeypatch):
    """Rounds see numbers only, and the least id is that of the strings."""
    seen, round_ = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: seen.append(edges.schema["a"].dataType.simpleString()) or round_(edges))
    edges = [("n9", "n10"), ("n10", "n2"), ("n2", "n9"), ("b", "a"), ("a", "b"), ("c", "c"), ("z", "n9")]
    got = components.components(spark.createDataFrame(edges, "a string, b string").repartition(3), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("b", "a"), ("n10", "n10"), ("n2", "n10"), ("n9", "n10"), ("z", "n10")]
    assert set(seen) == {"bigint"}


def test_parallelism(spark):
    members = spark.createDataFrame([("e", x) for x in "abcd"] + [("f", "a")], "epic string, id string")
    found = graph.waves(members, spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c")], EDGES))
    assert {tuple(r) for r in graph.parallelism(found).collect()} == {("e", 2), ("f", 1)}
