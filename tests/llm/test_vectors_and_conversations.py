"""Centroids, neighbours and conversation repair against plain loops, other algorithms and odd tables."""

import hashlib
import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import centroids, conversation_repair, neighbours, queries

VECTORS = "vec_id bigint, embedding array<float>"
CLASHES = ("label", "key", "code", "x", "cluster", "score", "rank", "members", "place", "asked", "at", "symbol", "run", "begin")


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


# centroids


def test_orchard_equals_argmin():
    rng = np.random.default_rng(5)
    for k, span in ((1, 3), (2, 3), (40, 4), (200, 1000), (60, centroids.LARGEST)):
        c, x = rng.integers(-span, span + 1, (k, 6)), rng.integers(-span, span + 1, (500, 6))
        c[-1] = c[0]
        number, distance = centroids.Orchard(c).nearest(x)
        all_distances = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (number == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()


def plain_clusters(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~"
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in got)
    return sorted(((i, j, d, sum(e for _, e, h in got if h == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in got), key=str)


def test_clusters_by_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(300)]), [rng.uniform(-1, 1) for _ in range(4)]) for _ in range(300)]
    rows += [(7, [0.5, 0.5, 0.5, 0.5])] * 150 + [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None, 1.0, 1.0]), (5, [1.0, float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0, 1.0]), (8, [0.0] * 4)]
    df = with_clashes(spark.createDataFrame(rows, VECTORS).repartition(7))
    for k, rounds in ((5, 4), (1, 2), (600, 1), (3, 0)):
        got = [tuple(r) for r in centroids.clusters(df, k, rounds, 4).collect()]
        assert sorted(got, key=str) == plain_clusters(rows, k, rounds, 4, 1024)


def test_clusters_of_nothing_and_of_huge_values(spark):
    for rows in ([], [(1, None)], [(1, [1.0])]):
        out = centroids.clusters(with_clashes(spark.createDataFrame(rows, VECTORS)))
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for huge in (1e30, -1e30):
        with pytest.raises(Exception, match="beyond"):
            centroids.clusters(spark.createDataFrame([(1, [huge] * 64)], VECTORS)).collect()


# neighbours


def plain_nearest(rows, asks, k):
    kept = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, a) in enumerate(kept):
        if q is not None and asks(q):
            cos = lambda b: float(sum(x * y for x, y in zip(a, b, strict=True))) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))  # noqa: B023, E731
            near = sorted((-cos(b), i is None, i or 0) for m, (i, b) in enumerate(kept) if m != n and len(b) == len(a))[:k]
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(near, 1)]
    return sorted(out, key=lambda r: (r[0], r[1], str(r[2:])))


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], str(r[2:])))


def test_neighbours_of_odd_vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (None, [6.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (50, rows[3][1]), (50, rows[50][1]), (50, rows[50][1]), (200, [2.0, 4.0, 6.0, 8.0, 10.0, 12.0])]
    rows += [(1, None), (2, []), (300, [0.0] * 6), (350, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (502, [1.0])]
    got = found(neighbours.nearest(with_clashes(spark.createDataFrame(rows, VECTORS).repartition(5)), F.col("vec_id") % 50 == 0))
    assert got == plain_nearest(rows, lambda q: q % 50 == 0, 5)
    for few in ([], [(50, [1.0, 2.0])], [(50, [1.0, 2.0]), (51, [1.0, 2.5]), (100, [1.0, 2.0])]):
        assert found(neighbours.nearest(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 50 == 0)) == plain_nearest(few, lambda q: q % 50 == 0, 5)


def test_neighbours_recall(spark):
    """Beyond the number of seeds: spread vectors, tight groups far from each other, and one vector that is a third of all rows."""
    rng = np.random.default_rng(1)
    spread = rng.normal(size=(1600, 24))
    groups = np.repeat(rng.normal(size=(40, 24)), 20, axis=0) + 0.01 * rng.normal(size=(800, 24))
    m = np.concatenate([spread, groups, np.tile(rng.normal(size=24), (1200, 1))]).astype(np.float32)
    order = rng.permutation(len(m))
    m = m[order]
    got = found(neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], VECTORS), F.col("vec_id") % 20 == 0))
    u = m.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(m), 20):
        scores = u @ u[q]
        scores[q] = -9
        least = np.sort(scores)[-5]
        own = [r for r in got if r[0] == q]
        assert [r[1] for r in own] == [1, 2, 3, 4, 5] and all(abs(r[3] - scores[r[2]]) < 1e-12 for r in own)
        if own[4][3] > 1 - 1e-9 and (scores > 1 - 1e-9).sum() > 10:  # copies: the five least other ids
            assert [r[2] for r in own] == [int(i) for i in np.flatnonzero(scores > 1 - 1e-9)[:5]]
        hits += sum(r[3] >= least - 1e-12 for r in own)
    assert hits >= 0.9 * 5 * len(range(0, len(m), 20))


# conversations


def by_search(rows):
    """(cost, audit) by uniform-cost search over (row, letters so far), least cost and then least audit first."""
    best, queue = set(), [(0, "", 0, "")]
    while True:
        cost, audit, i, tail = heapq.heappop(queue)
        if i == len(rows) and tail in ("", "a"):
            return cost, audit
        if (i, tail) in best:
            continue
        best.add((i, tail))
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
        if cost < 5 * len(rows) + 20:
            supplied = "a" if tail == "u" else "u"
            heapq.heappush(queue, (cost + 5, audit + "I", i, supplied))
            if i < len(rows):
                initial, fault = rows[i]
                heapq.heappush(queue, (cost + 2, audit + "D", i + 1, tail))
                if fault not in (1, 2):
                    more = 5 if fault == 3 else 0
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, supplied))
                    if initial in after:
                        heapq.heappush(queue, (cost + more, audit + "K", i + 1, initial))


def walked(rows, cuts):
    """The same through blocks: matrices, costs at borders, ways, walks."""
    symbols = bytes(4 * "suao".index(i) + f for i, f in rows)
    blocks = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True) if b > a]
    afters, after = [], list(conversation_repair.END)
    for b in reversed(blocks):
        afters.append(after)
        after = conversation_repair.chained(conversation_repair.matrix(b), after)
    audit, state = "", 0
    for b, border in zip(blocks, reversed(afters), strict=True):
        said, state = conversation_repair.walk(b, tuple(border), state)
        audit += "".join(said)
    return after[0], audit + conversation_repair.tail(state)


def test_cheapest_least_edits():
    rng = random.Random(2)
    kinds = list(itertools.product("suao", range(4)))
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)] + [[(rng.choice("suaoua"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(3, 14))] for _ in range(600)]
    for rows in cases:
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randint(0, 3))))
        assert walked(rows, cuts) == walked(rows, []) == by_search(rows), rows


def test_long_conversation_in_blocks():
    rng = random.Random(4)
    rows = [(rng.choice("suaua"), rng.choice([0, 0, 0, 3, 2, 1])) for _ in range(20_000)]
    whole = walked(rows, [])
    assert walked(rows, [1, 777, 5000, 5001, 16_384]) == whole and sum(e != "I" for e in whole[1]) == len(rows)


def test_small_blocks_against_sql(spark, sf_dir, duck, same):
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for bits in (0, 2):
        same(conversation_repair.repaired_all(messages, conversation_repair.damage(messages), bits), queries.SQL["op13_conversations"], duck)


def test_odd_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, None, "who?"), (2, 1, "assistant", None), (3, None, "assistant", "no turn."), (3, 4, "user", "late!"), (3, 9, "tool", "x" * 300_000),
        (None, 0, "user", "lost."), (None, None, "system", "rules."), (4, 0, "", "no role."), (5, 0, "user", "same."), (5, 0, "user", "same."), (5, 1, "user", "same."), (6, 0, "user", "　"), (6, 1, "assistant", "ok. \x0b\n"),
    ]
    df = with_clashes(spark.createDataFrame(rows, schema).repartition(4))
    got = {r["conv_id"]: r for r in conversation_repair.repair(df, 1).collect()}
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    said = {c: tuple(r)[1:] for c, r in got.items()}
    assert said[1] == (0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.", "assistant:Yes."))
    assert said[2] == (0, 1, 0, 0, 1, 4, "DD", sha())
    assert said[3][:5] == (4, 0, 0, 1, 1) and said[3][5:7] == by_search([("a", 0), ("u", 0), ("o", 3)])
    assert said[None][:5] == (0, 0, 0, 0, 0) and said[None][5:7] == by_search([("s", 0), ("u", 0)])
    assert said[4][6] == by_search([("o", 0)])[1] and said[5][1:4] == (0, 2, 0) and said[5][6] == by_search([("u", 0), ("u", 2), ("u", 2)])[1]
    assert said[6][6] == by_search([("u", 3), ("a", 0)])[1]
    every = conversation_repair.repaired_all(df, conversation_repair.damage(df)).collect()
    assert sorted(str(r["conv_id"]) for r in every) == ["1", "2", "3", "4", "5", "6", "None"]
    empty = spark.createDataFrame([], schema)
    assert conversation_repair.repaired_all(empty, conversation_repair.damage(empty)).collect() == []
    gone = conversation_repair.repaired_all(df, empty).filter("conv_id = 1").first()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", sha())


def test_hot_conversation(spark):
    """One conversation of one row over and over: a single row stands, wherever the others lie."""
    rows = spark.range(0, 30_000, 1, 8).select(F.lit(1).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("again.").alias("text"))
    r = conversation_repair.repair(rows, 8).first()
    assert (r["duplicate"], r["cost"], r["illegal"], r["gaps"]) == (29_999, 60_000, 29_999, 0) and r["audit"] == "D" * 30_000
