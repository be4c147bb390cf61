"""Hand tables, limits and invariants of the operators."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.filters import glob_regex, metadata_filter, relative_time
from quillgraph.operators import analytics, conversation, graph, memory, retrieval, text, work
from quillgraph.plans import text_queries
from quillgraph.sources import tables
from quillgraph.streaming import jobs

NOW = dt.datetime(2024, 1, 31)


def issues(spark, rows):
    """rows: (id, status)"""
    full = [(i, "t", "d", s, 2, "task", "", NOW, NOW, NOW if s == "closed" else None, None, None, False, False, 0, "{}") for i, s in rows]
    return spark.createDataFrame(
        full,
        "id string, title string, description string, status string, priority int, issue_type string, assignee string, created_at timestamp, updated_at timestamp, closed_at timestamp, defer_until timestamp, due_at timestamp, pinned boolean, ephemeral boolean, compaction_level int, metadata string",
    )


def deps(spark, rows):
    return spark.createDataFrame([(*r, "") if len(r) == 3 else r for r in rows], "issue_id string, depends_on_id string, type string, metadata string")


def ids(df):
    return {r[0] for r in df.select("id").collect()}


def test_blocking_semantics(spark):
    i = issues(spark, [("a", "open"), ("b", "open"), ("c", "closed"), ("d", "open"), ("e", "open"), ("f", "open"), ("k1", "closed"), ("k2", "open"), ("s", "open"), ("g", "open"), ("p", "open")])
    d = deps(spark, [
        ("a", "b", "blocks"), ("b", "c", "blocks"), ("d", "b", "related"), ("e", "b", "conditional-blocks"), ("k1", "s", "parent-child"), ("k2", "s", "parent-child"),
        ("f", "s", "waits-for"), ("g", "s", "waits-for", '{"gate":"any-children"}'), ("p", "a", "parent-child"),
    ])
    assert ids(work.blocked_ids(i, d)) == {"a", "e", "f"}
    ready = ids(work.ready_work(i, d, NOW))
    assert ready == {"b", "d", "k2", "s", "g"}
    assert not ready & ids(work.blocked_ids(i, d))
    by = {r["id"]: r["blocked_by"] for r in work.blocked_issues(i, d).collect()}
    assert by["p"] == ["a"] and by["a"] == ["b"]


def test_graph_loops_and_waves(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "z"), ("q", "q")], "src string, dst string")
    found = {r["id"]: r["component"] for r in graph.cycle_nodes(e).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "q": "q"}
    members = spark.createDataFrame([("E", x) for x in "abcd"], "epic string, id string")
    w = {r["id"]: r["wave"] for r in graph.waves(members, spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "outside")], "src string, dst string")).collect()}
    assert w == {"a": 0, "b": 1, "c": 2, "d": 0}
    c = graph.connected(spark.createDataFrame([(x,) for x in "abcdef"], "id string"), spark.createDataFrame([("f", "e"), ("e", "d"), ("b", "a")], "src string, dst string"))
    assert {r["id"]: r["component"] for r in c.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "d"}


def test_version_chain(spark):
    m = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("4", "1"), ("5", None), ("6", "gone")], "id string, parent_memory_id string")
    assert {(r["id"], r["root"], r["place"]) for r in graph.version_chain(m).collect()} == {("1", "1", 0), ("2", "1", 1), ("3", "1", 2)}


def test_fold_equals_steps(spark):
    rng = random.Random(3)
    rows = [("k", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), i, rng.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq int, v double")
    c = rows[0][3]
    for r in rows[1:]:
        c = min(1.0, 0.8 * c + 0.2 * r[3] + 0.05)
    for bits in (1, 2, 10):
        got = graph.capped_fold(df, ["k"], ["ts", "seq"], "v", 0.8, 0.2, 0.05, bits).first()
        assert got["n"] == 40 and math.isclose(got["confidence"], c, abs_tol=1e-9)


MEMORY = "id string, confidence double, memory_level string, source_count int, is_static boolean, is_forgotten boolean, is_latest boolean, forget_after timestamp, updated_at timestamp"


def test_reinforce_batches_and_promotion(spark):
    m = spark.createDataFrame([("a", 0.5, "fact", 1, False, True, True, None, NOW), ("b", None, "fact", 1, False, False, True, None, NOW)], MEMORY)
    hits = [("a", 0.9, NOW + dt.timedelta(hours=9 * i), i) for i in range(6)]
    h = lambda rows: spark.createDataFrame(rows, "memory_id string, confidence double, ts timestamp, event_id int")
    whole = {r["id"]: r for r in memory.reinforce(m, h(hits)).collect()}
    step = m
    for x in hits:
        step = spark.createDataFrame(memory.reinforce(step, h([x])).select(*m.columns).collect(), MEMORY)
    one = {r["id"]: r for r in step.collect()}
    for k in ("a", "b"):
        assert one[k]["memory_level"] == whole[k]["memory_level"] and one[k]["source_count"] == whole[k]["source_count"]
        assert (one[k]["confidence"] is None) == (whole[k]["confidence"] is None)
    assert math.isclose(one["a"]["confidence"], whole["a"]["confidence"], abs_tol=1e-9)
    assert whole["a"]["memory_level"] == "core" and not whole["a"]["is_forgotten"] and whole["b"]["source_count"] == 1


def test_reinforce_cuts_a_hot_memory(spark):
    """All hits of one minute and one memory, in runs of two or four, against a plain loop."""
    m = spark.createDataFrame([("a", 0.1, "fact", 1, False, True, True, None, NOW), ("b", 0.4, "fact", 1, False, False, True, None, NOW)], MEMORY)
    rng = random.Random(5)
    hits = [("a", rng.random() / 3, NOW + dt.timedelta(seconds=i % 3), i) for i in range(37)] + [("b", 0.2, NOW, 1), ("b", 0.2, NOW, 1)]
    rows = spark.createDataFrame(hits, "memory_id string, confidence double, ts timestamp, event_id int")
    want = {"a": [0.1, 1], "b": [0.4, 1]}
    for k, v, _, _ in sorted(hits, key=lambda x: (x[0], x[2], x[3])):
        want[k] = [min(1.0, 0.7 * want[k][0] + 0.3 * v + 0.1), want[k][1] + 1]
    for bits in (1, 2, 10):
        got = {r["id"]: r for r in memory.reinforce(m, rows, bits).collect()}
        for k, (c, s) in want.items():
            assert math.isclose(got[k]["confidence"], c, abs_tol=1e-9) and got[k]["source_count"] == s and not got[k]["is_forgotten"]
    assert memory.reinforce(m, rows.limit(0)).filter("confidence IS NOT NULL").count() == 2


def test_decay_invariants(spark):
    rows = [(str(i), (i % 11) / 10, ["fact", "core", "profile", "preference", "episodic"][i % 5], 1, i % 7 == 0, False, True, NOW - dt.timedelta(days=3) if i % 4 == 0 else None, NOW - dt.timedelta(days=i * 5)) for i in range(60)]
    m = spark.createDataFrame(rows, MEMORY)
    once = memory.maintenance(m, NOW)
    pairs = m.select("id", F.col("confidence").alias("old")).join(once, "id").collect()
    assert all(p["confidence"] <= p["old"] + 1e-12 for p in pairs)
    twice = memory.maintenance(once, NOW)
    key = ["id", "confidence", "is_forgotten", "updated_at"]
    assert sorted(map(tuple, once.select(*key).collect())) == sorted(map(tuple, twice.select(*key).collect()))


def test_filter_conversation(spark):
    rows = [(1, 0, "user", "<uploaded_files>x</uploaded_files>"), (1, 1, "assistant", "got it"), (1, 2, "user", "<uploaded_files>x</uploaded_files>\nhello"), (1, 3, "assistant", "hi"), (1, 4, "tool", "t"), (1, 5, "user", "that's wrong")]
    m = spark.createDataFrame(rows, "thread_id int, turn int, role string, content string")
    assert [(r["turn"], r["content"]) for r in conversation.filter_conversation(m).orderBy("turn").collect()] == [(2, "hello"), (3, "hi"), (5, "that's wrong")]
    assert conversation.detect_correction(m).first()["corrected"]


def test_budget_stops_at_first_that_does_not_fit(spark):
    f = spark.createDataFrame([("o", 1, "x" * 10, "k", 0.9), ("o", 2, "x" * 400, "k", 0.8), ("o", 3, "x", "k", 0.7)], "owner string, fact_id int, content string, category string, confidence double")
    assert [r["fact_id"] for r in conversation.token_budget_pack(f, 60).collect()] == [1]


def test_dedupe_memories(spark):
    d = lambda *v: spark.createDataFrame(list(enumerate(v)), "pos int, memory string")
    got = memory.dedupe_memories(d("a", "a ", ""), d("a", "b", "b"), d("b", "c"))
    assert sorted((r["list"], r["memory"]) for r in got.collect()) == [("dynamic", "b"), ("search", "c"), ("static", "a"), ("static", "a")]


def test_chunks(spark):
    rng = random.Random(5)
    para = lambda n: " ".join("w" * rng.randint(1, 9) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    texts = ["", "   ", "short", "\n\n".join(para(n) for n in (100, 300, 50, 900, 20, 400)), para(3000)]
    for t in texts:
        chunks = text.chunk_text(t)
        assert all(c.strip() == c and c for c in chunks) and bool(chunks) == bool(t.strip())
        joined = " ".join(chunks).split()
        assert set(t.split()) <= set(joined)
    rows = text.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    for i in range(len(texts)):
        assert sorted(r["position"] for r in rows if r["id"] == str(i)) == list(range(len(text.chunk_text(texts[i]))))
    assert text.tokens("") == 2


def test_markdown():
    title, md = text.html_to_markdown('<html><head><title> T </title><style>x{}</style></head><body><h2>Head</h2><script>var a;</script><p>See <a href="/x">here</a> or <a href="mailto:a@b">mail</a><br>next</p><ul><li>one<li>two</ul></body></html>')
    assert title == "T" and md == "## Head\n\nSee [here](/x) or mail\nnext\n\n- one\n- two"


def test_markdown_references_end_with_a_semicolon():
    title, md = text.html_to_markdown('<title>a&amp;b &amp</title><h1>c&amp</h1><p>&lt;d&gt; &copy 1 &#65; &#66 &nosuch; <a href="/x?a=1&amp;copy=2">e</a>')
    assert title == "a&b &amp" and md == "# c&amp\n\n<d> &copy 1 A &#66 &nosuch; [e](/x?a=1&copy=2)"


def test_near_duplicate_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(60)] + [(100, None), (101, ""), (102, "w1 w2"), (103, "W2, w1!")]
    got = {(r["a"], r["b"]): r["similarity"] for r in text.near_duplicates(spark.createDataFrame(rows, "id int, text string"), 0.5).collect()}
    bag = {i: {w: (t or "").lower().split().count(w) for w in set((t or "").lower().replace(",", "").replace("!", "").split())} for i, t in rows}
    bag[103] = {"w2": 1, "w1": 1}
    first = {}
    for i in sorted(bag):
        first.setdefault(tuple(sorted(bag[i].items())), i)
    for a in bag:
        for b in bag:
            ka, kb = tuple(sorted(bag[a].items())), tuple(sorted(bag[b].items()))
            if a < b and ka and kb and first[ka] == a and (first[kb] == b or ka == kb):
                m = sum(min(c, bag[b].get(w, 0)) for w, c in bag[a].items())
                j = m / (sum(bag[a].values()) + sum(bag[b].values()) - m)
                s = (j + sum(c * bag[b].get(w, 0) for w, c in bag[a].items()) / math.sqrt(sum(c * c for c in bag[a].values()) * sum(c * c for c in bag[b].values()))) / 2
                assert ((a, b) in got) == (s >= 0.5 - 1e-12), (a, b, s)


def test_near_duplicates_in_blocks(spark):
    """The same pairs from one block and from many; at a low threshold no pair is lost in between."""
    rng = random.Random(4)
    rows = [(f"t{i}", " ".join(rng.choices([f"w{k}" for k in range(9)] + ["the"] * 6, k=rng.randint(1, 20)))) for i in range(90)] + [("t", None), (None, "w1 the")]
    df = spark.createDataFrame(rows, "id string, text string")
    one = sorted(text.near_duplicates(df, 0.1).collect())
    assert one == sorted(text.near_duplicates(df, 0.1, texts=13).collect()) == sorted(text.near_duplicates(df, 0.1, tokens=50).collect())
    assert len(one) > 3000 and all(r["a"] < r["b"] for r in one) and len({r[:2] for r in one}) == len(one)
    few = text.near_duplicates(df, 0.1, max_df=5)
    assert 0 < few.count() < len(one)
    assert text.near_duplicates(df.limit(0), 0.1).collect() == []


def test_near_duplicates_pair_all_copies(spark, duck):
    """Copies pair with each other and with all that is near, as in the SQL of the query."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(14)], k=rng.randint(1, 12))) for _ in range(25)]
    rows = [(i, rng.choice([str.upper, str.lower])(rng.choice(texts))) for i in range(120)] + [(200, None), (None, texts[0]), (201, "..."), (7, "w1 more of it"), (202, "w3 " * 40), (203, "w3, " * 40), (204, "W3 " * 40)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    duck.sql("CREATE OR REPLACE TEMP TABLE near_rows (vec_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO near_rows VALUES (?, ?)", rows)
    want = {(a, b): s for a, b, s in duck.sql(f"WITH x AS (SELECT * FROM near_rows), {text_queries.NEAR}").fetchall()}
    for blocks in ({}, {"texts": 17}, {"tokens": 60}):
        got = text.near_duplicates(df, 0.4, **blocks).collect()
        assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want) > 1000
    assert want[(202, 204)] == want[(203, 204)] == 1


def test_vectors(spark):
    rng = random.Random(1)
    rows = [(str(i), [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [("zero", [0.0] * 8), ("short", [1.0]), ("none", None)] + [(f"same{i}", [1.0] * 8) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    q = df.filter("id IN ('1', '2', 'same3')")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if any(a) and any(b) else 0.0  # noqa: B905, E731
    full = {i: v for i, v in rows if v and len(v) == 8}
    for block in (8192, 1):
        got = {}
        for r in retrieval.vector_topk(q, df, 7, block=block).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        for i in ("1", "2", "same3"):
            assert got[i] == [x for _, x in sorted((-round(cos(full[i], v), 9), k) for k, v in full.items())[:7]]


def test_consolidate_is_greedy(spark):
    rows = [("n1", "s", [1.0, 0.0]), ("n2", "s", [0.99, 0.1]), ("n3", "t", [1.0, 0.0]), ("n4", "s", [0.0, 1.0])]
    new = spark.createDataFrame(rows, "id string, space_id string, embedding array<float>")
    old = spark.createDataFrame([("e", "s", [0.05, 1.0])], "id string, space_id string, embedding array<float>")
    got = {r["id"]: (r["action"], r["target"]) for r in retrieval.consolidate(new, old).collect()}
    assert got == {"n1": ("create", None), "n2": ("reinforce", "n1"), "n3": ("create", None), "n4": ("reinforce", "e")}


def test_consolidate_against_one_after_the_other(spark):
    """Blocks of any size give what a walk in order gives, in spaces of several sizes, with rows that are like no other."""
    rng = random.Random(3)
    rows = [(f"m{i:03d}", "big" if i % 3 else f"s{i % 5}", [rng.choice([-1.0, 0.0, 1.0]) + rng.random() / 3 for _ in range(4)]) for i in range(240)]
    rows += [(f"m{i}", "big", [1.0, 1.0, 0.0, 0.0]) for i in range(300, 340)] + [("null1", "big", None), ("null2", "big", None), ("zero", "big", [0.0] * 4), ("alone", None, [1.0, 1.0, 0.0, 0.0])]
    schema = "id string, space_id string, embedding array<float>"
    new, none = spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame([], schema)
    single = {i: np.array(v, dtype=np.float32).astype(float) for i, _, v in rows if v and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in single.items()}
    want, leaders = {}, []
    for i, space, _ in sorted(rows, key=lambda r: r[0]):
        near = [(round(float(unit[i] @ unit[j]), 12), j) for j, s in leaders if s == space and i in unit and j in unit and space]
        score, target = max(near, default=(-1.0, None))
        want[i] = ("reinforce", target) if score >= 0.9 else ("create", None)
        if score < 0.9:
            leaders.append((i, space))
    for block in (4096, 7):
        got = {r["id"]: (r["action"], r["target"]) for r in retrieval.consolidate(new, none, least=0.9, block=block).collect()}
        assert got == want


def test_quantiles_by_rounds_of_counts(spark):
    """Coarse sketches, ties, nulls, NaN and columns without values give the sorted column's quantiles."""
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1e6), rng.randrange(4), None, i, float("nan") if i % 2 else 1.0) for i in range(3001)] + [(None, None, None, None, None)] * 7
    df = spark.createDataFrame(rows, "`a.b` double, few int, none double, all long, nan double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.731, 1.0)
    for accuracy in (10, 10_000):
        got = analytics.quantiles(df, df.columns, shares, accuracy)
        assert got["none"] == [None] * 5
        for i, c in ((0, "a.b"), (1, "few"), (3, "all")):
            assert np.allclose(got[c], np.quantile([r[i] for r in rows if r[i] is not None], shares), rtol=1e-12)
        assert got["nan"][:2] == [1.0, 1.0] and math.isnan(got["nan"][4])
    assert analytics.quantiles(df.limit(0), ["few"], shares) == {"few": [None] * 5}


def test_split_of_one_class(spark):
    """One class of all rows, a null class, a class of one row, and a table without rows."""
    rows = [(i, "all") for i in range(2000)] + [(5000, "one")] + [(i, None) for i in range(6000, 6010)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(3)
    out = text.stratified_split(df, "label", "id", 0.3, 7)
    assert out.columns == ["id", "label", "is_test"]
    rank = lambda label: [i for _, i in sorted((hashlib.md5(f"{i}:7".encode()).hexdigest(), i) for i, c in rows if c == label)]
    want = set(rank("all")[:600] + rank("one")[:1] + rank(None)[:3])
    got = out.collect()
    assert len(got) == len(rows) and {r["id"] for r in got if r["is_test"]} == want
    assert text.stratified_split(df.limit(0), "label", "id", 0.3, 7).count() == 0


def test_promotion_moves_rows_once(spark):
    """What the permanent side has stays as it is there; rows of other ephemeral issues stay behind; unknown ids move nothing."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    sides = []
    for issue_rows, labels, events in (([("p", False), ("x", False)], [("x", "a")], [(1, "x", "there")]), ([("x", True), ("y", True)], [("x", "a"), ("x", "b"), ("y", "a")], [(1, "x", "here"), (2, "x", "new"), (3, "y", "new")])):
        sides.append({
            "issues": table(issue_rows, "id string, ephemeral boolean"), "labels": table(labels, "issue_id string, label string"),
            "events": table(events, "id int, issue_id string, text string"),
        })
    after, left = work.promote(table([("x",), ("gone",), ("p",)], "id string"), *sides)
    read = lambda df: sorted(tuple(r) for r in df.collect())
    assert read(after["issues"]) == [("p", False), ("x", False)] and read(left["issues"]) == [("y", True)]
    assert read(after["labels"].select("issue_id", "label")) == [("x", "a"), ("x", "b")] and read(left["labels"].select("issue_id", "label")) == [("y", "a")]
    assert read(after["events"].select("id", "issue_id", "text")) == [(1, "x", "there"), (2, "x", "new")] and [r["id"] for r in left["events"].collect()] == [3]


def test_explanation_summary_counts_items_and_cycles(spark):
    i = issues(spark, [("a", "open"), ("b", "open"), ("c", "closed"), ("d", "open"), ("e", "open")])
    d = deps(spark, [("a", "b", "blocks"), ("d", "c", "blocks")])
    ready, blocked = work.ready_items(i, d, NOW), work.blocked_items(i, d)
    cycles = spark.createDataFrame([("x", "x"), ("y", "x"), ("z", "z")], "id string, component string")
    assert {(r["id"], r["reason"], *r["resolved_blockers"]) for r in ready.collect()} == {("b", "no blocking dependencies"), ("d", "1 blocker(s) resolved", "c"), ("e", "no blocking dependencies")}
    assert [(r["id"], [b["id"] for b in r["blockers"]]) for r in blocked.collect()] == [("a", ["b"])]
    assert tuple(work.explanation_summary(ready, blocked, cycles).first()) == (3, 1, 2)
    assert tuple(work.explanation_summary(ready.limit(0), blocked.limit(0), cycles.limit(0)).first()) == (0, 0, 0)


def test_filters(spark):
    df = spark.createDataFrame([(1, '{"a":"x","n":"7","t":["p","q"]}'), (2, '{"a":"Yx"}'), (3, None)], "id int, metadata string")
    run = lambda tree: sorted(r["id"] for r in df.filter(metadata_filter(tree)).collect())
    assert run({"key": "a", "value": "x"}) == [1]
    assert run({"key": "a", "value": "X", "filterType": "string_contains", "ignoreCase": True}) == [1, 2]
    assert run({"key": "n", "value": 5, "filterType": "numeric", "numericOperator": ">"}) == [1]
    assert run({"OR": [{"key": "t", "value": "q", "filterType": "array_contains"}, {"key": "a", "value": "x", "negate": True}]}) == [1, 2, 3]
    with pytest.raises(ValueError):
        metadata_filter({"key": "bad key", "value": 1})
    with pytest.raises(ValueError):
        metadata_filter({"AND": [{"key": "a", "value": 1}] * 201})
    import re

    assert re.match(glob_regex("src/**/*.py", segments=True), "src/a/b/c.py") and not re.match(glob_regex("src/*.py", segments=True), "src/a/b.py")
    assert relative_time("-2w", NOW) == NOW - dt.timedelta(days=14) and relative_time("1m", dt.datetime(2024, 1, 15)) == dt.datetime(2024, 2, 15)
    assert relative_time("2024-05-01T02:00:00+02:00", NOW) == dt.datetime(2024, 5, 1)


def test_table_names():
    assert list(tables.table_names(["/a/2024 sales.csv", "/b/x.csv", "/c/x.csv"])) == ["t_2024_sales", "x", "x_1"]


def test_streams_in_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One.\n\nTwo."), (2, "x " * 900)], "id int, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: jobs.read_folder(spark, f"{tmp_path}/in", docs.schema, files_a_batch=1)
    jobs.ingest(stream(), f"{tmp_path}/out")
    spark.createDataFrame([(2, "short now"), (3, "new")], "id int, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    jobs.ingest(stream(), f"{tmp_path}/out")
    got = {(r["id"], r["position"]): r["content"] for r in jobs.current_chunks(spark, f"{tmp_path}/out").collect()}
    assert got == {("1", 0): "One.\n\nTwo.", ("2", 0): "short now", ("3", 0): "new"}


def test_loop_detector_thresholds(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(seconds=i), h) for i, h in enumerate("aabacaaad")]
    df = spark.createDataFrame(rows, "thread_id bigint, event_id bigint, ts timestamp, call_hash string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = jobs.run_available(jobs.loop_detector(jobs.read_folder(spark, f"{tmp_path}/in", df.schema)), "t").orderBy("event_id").collect()
    assert [r["verdict"] for r in got] == ["ok", "ok", "ok", "warn", "ok", "ok", "stop", "stop", "ok"]


def test_loop_detector_warns_once_and_evicts(spark, tmp_path):
    """Warned once a hash even after it left the window; with room for three threads the least recently used one begins anew."""

    def run(name, rows, **how):
        df = spark.createDataFrame([(t, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), h) for i, (t, h) in enumerate(rows)], "thread_id bigint, event_id bigint, ts timestamp, call_hash string")
        for lo in range(0, len(rows), 4):  # a micro-batch for each four calls
            df.filter(f"event_id BETWEEN {lo} AND {lo + 3}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        found = jobs.run_available(jobs.loop_detector(jobs.read_folder(spark, f"{tmp_path}/{name}", df.schema, 1), **how), name)
        return [(r["n"], r["verdict"]) for r in found.orderBy("event_id").collect()]

    assert [v for _, v in run("once", [(1, h) for h in "aaabbbcdefaaa"], stop=10, window=5)] == ["ok", "ok", "warn", "ok", "ok", "warn", "ok", "ok", "ok", "ok", "ok", "ok", "ok"]
    assert [v for _, v in run("hard", [(1, "a")] * 5, warn=2, stop=4)] == ["ok", "warn", "ok", "stop", "stop"]
    evicted = run("lru", [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (0, "a"), (2, "a"), (3, "a")], warn=2, threads=3, shards=1)
    assert evicted == [(1, "ok"), (1, "ok"), (1, "ok"), (1, "ok"), (1, "ok"), (2, "warn"), (2, "warn")]
    assert run("idle", [(0, "a"), *[(1, "b")] * 5, (0, "a")], idle="5 seconds", stop=9)[-1] == (1, "ok")


def test_live_state_batch_and_stream_agree(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    rows = [
        (1, "a", "label_added", "mode:normal", at(1)), (2, "a", "status_changed", "open", at(2)), (3, "a", "label_added", "plain", at(3)), (4, "b", "label_added", "mode:x", at(9)),
        (5, "a", "label_added", "mode:degraded", at(5)), (6, "a", "label_removed", "mode:normal", at(6)), (7, "a", "status_changed", "closed", at(1)), (8, "b", "label_removed", "mode:x", at(8)),
        (9, "a", "label_added", "health:ok", at(4)), (10, "a", "label_removed", "plain", at(7)), (11, "c", "label_removed", "never", at(1)), (12, None, "status_changed", "lost", at(1)), (13, "b", "status_changed", None, at(20)), (14, "a", "status_changed", "late", at(0)),
    ]
    df = spark.createDataFrame(rows, "id bigint, issue_id string, event_type string, new_value string, created_at timestamp")
    for lo in range(1, 15, 4):
        df.filter(f"id BETWEEN {lo} AND {lo + 3}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = {("a", "open", 3, ("health:ok", "mode:degraded")), ("b", None, 0, ("mode:x",)), ("c", None, 0, ())}
    assert {(r["issue_id"], r["status"], r["n"], tuple(r["labels"])) for r in work.live_state(df).collect()} == want
    live = jobs.merge_updates(jobs.live_state(jobs.read_folder(spark, f"{tmp_path}/in", df.schema, 1)), "live", "issue_id")
    assert {(r["issue_id"], r["status"], r["n"], tuple(r["labels"])) for r in live.collect()} == want


def test_apply_merge(spark):
    issues = spark.createDataFrame([(i, "open", f"t-{i}") for i in ("a", "b", "c", "d", "kid", "e")], "id string, status string, title string")
    deps = spark.createDataFrame([("kid", "b", "parent-child", 1), ("a", "b", "parent-child", 2), ("kid", "a", "related", 3), ("d", "c", "blocks", 4), ("e", "c", "parent-child", 5), ("e", "b", "parent-child", 6)], "issue_id string, depends_on_id string, type string, n int")
    plan = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "a"), ("a", "a")], "id string, target string")
    merged, links, children = work.apply_merge(issues, deps, plan)
    assert {(r["id"], r["status"], r["close_reason"]) for r in merged.collect()} == {("a", "open", None), ("b", "closed", "Duplicate of a"), ("c", "closed", "Duplicate of a"), ("d", "open", None), ("kid", "open", None), ("e", "open", None)}
    assert {(r["issue_id"], r["depends_on_id"], r["type"]) for r in links.collect()} == {("kid", "a", "related"), ("d", "c", "blocks"), ("e", "a", "parent-child"), ("b", "a", "related"), ("c", "a", "related")}
    assert {tuple(r) for r in children.collect()} == {("kid", "b", "a"), ("e", "c", "a"), ("e", "b", "a")}
    circle = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, target string")
    assert work.apply_merge(issues, deps, circle)[0].filter("status = 'closed'").count() == 0


def test_properties_of_a_hot_node(spark):
    rows = spark.range(20_000).selectExpr("' Hot ' AS name", "'t' AS type", "CAST(NULL AS STRING) AS org_id", "0.5D AS confidence", "id AS ts", "0 AS seq", "map(concat('k', id % 3), id, 'all', -id) AS properties")
    r = graph.upsert_nodes(rows.repartition(8)).first()
    assert (r["name"], r["mention_count"], r["properties"]) == ("hot", 20_000, {"all": -19_999, "k0": 19_998, "k1": 19_999, "k2": 19_997})
    assert graph.upsert_nodes(rows.limit(1).withColumn("properties", F.lit(None).cast("map<string,bigint>"))).first()["properties"] == {}


def test_adaptive_length_and_ids(spark):
    import hashlib

    assert [work.adaptive_length(n) for n in (0, 163, 164, 983, 984, 10**9)] == [3, 3, 4, 4, 5, 8]
    for n in (100, 500, 5_000, 40_000):
        k = work.adaptive_length(n)
        risk = lambda k: 1 - math.exp(-n * n / (2 * 36.0**k))  # noqa: B023, E731
        assert risk(k) <= 0.25 and (k == 3 or risk(k - 1) > 0.25)
    size = {3: 2, 4: 3, 5: 4, 6: 4, 7: 5, 8: 5}
    rows = spark.createDataFrame([(f"text {i}",) for i in range(50)], "t string")
    for k in range(3, 9):
        for text_, got in rows.select("t", work.hash_id("bd", F.col("t"), k)).collect():
            x, out = int.from_bytes(hashlib.sha256(text_.encode()).digest()[: size[k]], "big"), ""
            while x:
                x, d = divmod(x, 36)
                out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
            assert got == "bd-" + out.rjust(k, "0")[-k:]


def test_sentences_keep_their_digits(spark):
    """The place of a sentence is not a set of signs to trim."""
    row = spark.createDataFrame([("0123 parts were here. 1900 others came.  11 more are at 21",)], "text string")
    assert row.select(memory.sentences(row["text"])).first()[0] == ["0123 parts were here.", "1900 others came.", "11 more are at 21"]


def test_extract_memories_brute_force(spark, sf_dir):
    import re

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("CAST(doc_id AS STRING) AS id", "text", "CASE WHEN doc_id % 3 = 0 THEN concat('Title ', doc_id) END AS title", "CASE WHEN doc_id % 6 = 0 THEN 'http://x' END AS url")
    want = set()
    for i, body, title, url in docs.collect():
        if body is None or len(body.strip(" ")) < 50:
            continue
        rows = [(-1, f"{title} ({url})" if url else title, 0.9)] if title else []
        seen, position = {}, 0
        for sentence in (s.strip(" ") for s in re.split(r"(?<=[.!?])\s+|\n+", body, flags=re.ASCII)):
            if not sentence:
                continue
            if position < 50 and 20 <= len(sentence) <= 500 and sentence not in seen:
                entity = re.search(r"(?<=[a-zà-ÿ,;] )[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)*", sentence, re.ASCII)
                if entity or re.search(r"[0-9]", sentence) or re.search(r"(?i)\b(is|are|was|were|means|refers to|defined as)\b", sentence, re.ASCII):
                    seen[sentence] = (position, sentence, 0.7 if entity else 0.5)
            position += 1
        want |= {(i, *r) for r in (rows + list(seen.values()))[:10]}
    assert {tuple(r) for r in memory.extract_memories(docs).select("id", "pos", "memory", "confidence").collect()} == want


def test_ingest_takes_the_newest_and_replaces_chunks(spark, tmp_path):
    schema, feed, out = "id string, text string, edited int", str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", "old words here", 1), ("a", "new words here", 2), ("b", "stays", 1)], [("a", "newest words", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        jobs.ingest(jobs.read_folder(spark, feed, schema), out, "edited")
        now = {r["id"]: r["content"] for r in jobs.current_chunks(spark, out).collect()}
        assert now == ({"a": "new words here", "b": "stays"} if len(rows) > 1 else {"a": "newest words", "b": "stays"})
    parts = lambda: {p.name for p in (tmp_path / "out" / "chunks").glob("part=*")}
    before = jobs.current_chunks(spark, out)
    jobs.compact(spark, out)
    assert {r["id"]: r["content"] for r in before.collect()} == now and len(parts()) == 3
    jobs.vacuum(spark, out)
    assert {r["id"]: r["content"] for r in jobs.current_chunks(spark, out).collect()} == now and len(parts()) == 1
    spark.createDataFrame([("b", "", 2), ("c", "after compaction", 1), (None, "no id", 1)], schema).coalesce(1).write.mode("append").parquet(feed)
    jobs.ingest(jobs.read_folder(spark, feed, schema), out, "edited")
    assert {r["id"]: r["content"] for r in jobs.current_chunks(spark, out).collect()} == {"a": "newest words", "c": "after compaction"}


def test_a_batch_that_fails_leaves_the_old_chunks(spark, tmp_path, monkeypatch):
    """Chunks without their manifest are not seen; the batch runs again and is seen once."""
    schema, feed, out = "id string, text string", str(tmp_path / "in"), str(tmp_path / "out")
    assert jobs.current_chunks(spark, out).count() == 0
    spark.createDataFrame([("a", "old words"), ("b", "stays")], schema).coalesce(1).write.mode("append").parquet(feed)
    jobs.ingest(jobs.read_folder(spark, feed, schema), out)
    spark.createDataFrame([("a", "new words")], schema).coalesce(1).write.mode("append").parquet(feed)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(jobs, "_switch", fails)
        with pytest.raises(Exception, match="lost"):
            jobs.ingest(jobs.read_folder(spark, feed, schema), out)
    read = lambda: sorted((r["id"], r["content"]) for r in jobs.current_chunks(spark, out).collect())
    assert read() == [("a", "old words"), ("b", "stays")] and len(list((tmp_path / "out" / "chunks").glob("part=*"))) == 2
    jobs.ingest(jobs.read_folder(spark, feed, schema), out)
    assert read() == [("a", "new words"), ("b", "stays")]
    jobs.vacuum(spark, out)
    assert read() == [("a", "new words"), ("b", "stays")] and len(list((tmp_path / "out" / "chunks").glob("part=*"))) == 2


def test_ignored_names_and_sizes(spark):
    paths = ["src/a.py", ".git/a.py", "x/node_modules/a.py", "pkg.egg-info/a.py", "a.bak", "logs/a.py", "my.cache", "catalogs/a.py", "Thumbs.db", "notes~"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in text.path_glob_filter(rows, "**").collect()] == ["src/a.py", "catalogs/a.py"]
    files = spark.createDataFrame([("small", "hit"), ("large", "hit\n" + "x" * 100)], "path string, text string")
    assert [r["path"] for r in text.regex_log_search(files, "hit", most_bytes=50).collect()] == ["small"]


def test_version_chains_by_doubling(spark):
    rows = [(f"{i}", f"{i - 1}" if i % 40 else None) for i in range(200)] + [("x", "y"), ("y", "x"), ("200", "5"), ("301", "gone"), ("302", "301")]
    got = {(r["id"], r["root"], r["place"]) for r in graph.version_chain(spark.createDataFrame(rows, "id string, parent_memory_id string")).collect()}
    assert got == {(f"{i}", f"{i - i % 40}", i % 40) for i in range(200)} | {("301", "301", 0), ("302", "301", 1)}


def test_waves_stop_at_cycles(spark):
    members = spark.createDataFrame([(e, x) for e in "EF" for x in "abcdefg"], "epic string, id string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("f", "d"), ("f", "a"), ("g", "g")], "src string, dst string")
    got = {(r["epic"], r["id"], r["wave"]) for r in graph.waves(members, edges).collect()}
    assert got == {(e, x, w) for e in "EF" for x, w in (("a", 0), ("b", 1), ("c", 2))}


def test_running_piece_count(monkeypatch):
    """Chunks are as if every joined text was split anew."""

    def plain(body):
        chunks, now = [], ""

        def add(piece, glue):
            nonlocal now
            if now.strip() and text.tokens(now + glue + piece) > text.TARGET:
                chunks.append(now.strip())
                now = now[-text.OVERLAP :] + glue + piece
            else:
                now += (glue if now else "") + piece

        import re

        for paragraph in re.split(r"\n{2,}", body):
            if not paragraph.strip():
                continue
            if text.tokens(paragraph) <= text.MOST:
                add(paragraph, "\n\n")
                continue
            if now.strip():
                chunks.append(now.strip())
            now = ""
            for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
                add(sentence, " ")
        if now.strip():
            if chunks and text.tokens(now) < text.LEAST:
                chunks[-1] += "\n\n" + now.strip()
            else:
                chunks.append(now.strip())
        return chunks

    rng = random.Random(3)
    for name, value in (("TARGET", 12), ("LEAST", 4), ("MOST", 20), ("OVERLAP", 9)):
        monkeypatch.setattr(text, name, value)
    for _ in range(400):
        body = "".join(rng.choices(["word", "a", " ", "  ", "\n", "\n\n", ". ", "! ", "\t", "ü"], k=rng.randint(0, 120)))
        assert text.chunk_text(body) == plain(body), repr(body)


def test_pivots_skip_rows_and_lose_none():
    """Against the full product: bunches of vectors, copies, zero and broken ones, in batches; and how much is skipped."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16))
    rows = np.concatenate([middle[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 16)), rng.normal(size=(500, 16)), np.zeros((3, 16)), np.full((30, 16), 0.5)])
    rows[17, 3], rows[18, 4] = np.nan, np.inf
    rows = rows[rng.permutation(len(rows))]
    names = np.array([f"v{i}" for i in range(len(rows))], dtype=object)
    ids = [*range(0, len(rows), 37), int(np.flatnonzero(~rows.any(axis=1))[0])]
    with np.errstate(invalid="ignore"):
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        unit = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
    ids = [i for i in ids if np.isfinite(unit[i]).all()]
    for k, n in ((1, len(rows)), (7, len(rows)), (300, 200)):
        batch = pa.RecordBatch.from_arrays([pa.array(names[:n].tolist()), pa.array(rows[:n].tolist(), pa.list_(pa.float64()))], ["id", "embedding"])
        pairs, got = [], {}
        run = retrieval._nearest([names[i] for i in ids], None, unit[ids], k, pairs.append)
        for part in run(iter([batch.slice(at, 500) for at in range(0, n, 500)])):
            for q, i, s in zip(*(c.to_pylist() for c in part.columns), strict=True):
                got.setdefault(q, []).append((-s, i))
        finite = np.flatnonzero(np.isfinite(unit[:n]).all(axis=1))
        for i in ids:
            want = sorted((-round(float(s), 9) + 0.0, names[j]) for s, j in zip(unit[finite] @ unit[i], finite, strict=True))[:k]
            have = sorted(got[names[i]])
            assert len(have) == len(want) and all(abs(a - b) < 3e-9 for (a, _), (b, _) in zip(have, want, strict=True))
            assert {name for s, name in want if s < want[-1][0] - 3e-9} <= {name for _, name in have}
        assert sum(pairs) <= len(ids) * n * (0.5 if k < n else 1)


def test_nearest_in_blocks(spark):
    rng = random.Random(9)
    rows = [(f"v{i}", [float(rng.randint(-2, 2)) for _ in range(3)], f"s{i % 3}") for i in range(300)]
    corpus = spark.createDataFrame(rows, "id string, embedding array<double>, space string").repartition(3)
    queries = corpus.filter("id LIKE 'v%7'")
    for scope in (None, "space"):
        got = [{(r["query_id"], r["id"], r["rank"]) for r in retrieval.vector_topk(queries, corpus, 5, scope, block).collect()} for block in (8192, 7)]
        unit = {i: [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] for i, v, _ in rows}
        want = set()
        for i, _, s in rows:
            if i.endswith("7"):
                scored = sorted((-round(sum(x * y for x, y in zip(unit[i], unit[j], strict=True)), 9) + 0.0, j) for j, _, t in rows if scope is None or s == t)[:5]
                want |= {(i, j, n + 1) for n, (_, j) in enumerate(scored)}
        assert got[0] == got[1]
        assert len(got[0]) == len(want) and len(got[0] & want) >= 0.9 * len(want)


def test_unknown_predicates_raise(spark):
    empty = spark.createDataFrame([], "id string")
    with pytest.raises(ValueError, match="titel_contains"):
        work.filter_issues(empty, empty, empty, titel_contains="x")


def test_closures_collect_no_large_frontier(spark, monkeypatch):
    """Frontiers over SMALL rows are shuffled: the plans of a search broadcast none, and its rows are the same."""
    rng = random.Random(8)
    edges = spark.createDataFrame([(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(150)], "src string, dst string")
    start = spark.createDataFrame([("", "n1"), ("", "n2"), ("o", "n3")], "origin string, id string")
    small = sorted(graph.bfs(start, edges, 50).collect())
    plans, keep = [], graph.Scratch.keep

    def noted(self, df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, **options)

    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph.Scratch, "keep", noted)
    assert sorted(graph.bfs(start, edges, 50).collect()) == small
    assert len(plans) > 4 and not any("Broadcast" in plan for plan in plans)
    plans.clear()
    deps = edges.select(F.col("src").alias("issue_id"), F.col("dst").alias("depends_on_id"), F.lit("replies-to").alias("type"))
    graph.message_thread(start.select("id"), deps).collect()
    assert not any("Broadcast" in plan for plan in plans if "LeftAnti" not in plan)
    # one anti-join for the roots, not one for each table of the closure
    assert max(plan.count("LeftAnti") for plan in plans) <= 2
