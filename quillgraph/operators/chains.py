"""Long ways through a graph in few rounds: chains are contracted by pointer doubling.

longest_paths: a node with one open way points to where it leads, and each pointer carries the map
v -> max(base, length + v) from the value there to its own. Two such maps make one of the same kind, so
pointers double. strong_components: nodes with one way in and one way out become edges between the
nodes around them, and are put back when the components of the rest are known. Either way a path of n
nodes takes about log2(n) rounds, each a join. Only counts reach the driver. What contraction leaves of a
graph's components is tangled and often small; up to FINISH edges of it are searched in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: What is left of a graph once chains were contracted is searched in one task when it has at most this many edges (some MB).
FINISH = 20_000
#: Levels are peeled one by one while each takes at least this share of the rows; else chains are contracted.
WORTH = 0.2


def _count(df: DataFrame, what: str) -> int:
    return df.filter(what).count()


def _pointers(one: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pointers (id, to, w, base) followed to their end: those that end, and the ids of those that go round for ever.

    When a round ends no pointer, the rest leads into circles: of a way that ends, every distance below
    its length occurs, so each round would end the pointers within its reach.
    """
    known = one.select(F.col("id").alias("to"), F.lit(True).alias("goes_on"))
    now = scratch.keep(one.join(known, "to", "left").select("id", "to", "w", "base", F.coalesce("goes_on", F.lit(False)).alias("goes_on")))
    before, going = None, _count(now, "goes_on")
    while going and going != before:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"), F.col("base").alias("above"), F.col("goes_on").alias("on"))
        stays, moves = now.filter("NOT goes_on"), now.filter("goes_on").join(ahead, "to")
        moved = moves.select("id", F.col("next").alias("to"), (F.col("w") + F.col("more")).alias("w"), F.greatest("base", F.col("w") + F.col("above")).alias("base"), F.col("on").alias("goes_on"))
        after = scratch.keep(stays.union(moved))
        scratch.drop(now)
        now, before, going = after, going, _count(after, "goes_on")
    return now.filter("NOT goes_on").drop("goes_on"), now.filter("goes_on").select("id")


def longest_paths(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, length) of the longest way from each node along edges (src, dst); nodes that reach a cycle have no row.

    An open node has one row without dst, whose w is the length known so far, and a row for each way
    on, whose w is the longest of its kind. A round peels the nodes without ways on. Where that takes
    few rows, all nodes with a single way on are contracted: they wait for the node their pointer ends at.
    """
    inside = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    none = F.lit(None).cast("string").alias("dst")
    rows = scratch.keep(nodes.select(F.col("id").alias("src"), none, F.lit(0).cast("bigint").alias("w")).distinct().union(inside.withColumn("w", F.lit(1).cast("bigint"))))
    done, waiting, count = [], [], rows.count()
    while count:
        ways = rows.groupBy("src").agg(F.count("dst").alias("n"), F.max(F.when(F.col("dst").isNull(), F.col("w"))).alias("base"), F.max("dst").alias("to"), F.max(F.when(F.col("dst").isNotNull(), F.col("w"))).alias("w"))
        settled = scratch.keep(ways.filter("n = 0").select(F.col("src").alias("id"), F.col("base").alias("length")))
        done.append(settled)
        left = rows.join(settled.select(F.col("id").alias("src")), "src", "left_anti").join(settled.withColumnRenamed("id", "dst"), "dst", "left")
        reached = F.col("length").isNotNull()
        left = left.select("src", F.when(~reached, F.col("dst")).alias("dst"), F.when(reached, F.col("w") + F.col("length")).otherwise(F.col("w")).alias("w"))
        after = scratch.keep(left.groupBy("src", "dst").agg(F.max("w").alias("w")))
        scratch.drop(rows)
        rows, before, count = after, count, after.count()
        if not count or before - count > WORTH * before:
            continue
        ways = rows.groupBy("src").agg(F.count("dst").alias("n"), F.max(F.when(F.col("dst").isNull(), F.col("w"))).alias("base"), F.max("dst").alias("to"), F.max(F.when(F.col("dst").isNotNull(), F.col("w"))).alias("w"))
        one = ways.filter("n = 1 AND src <> to").select(F.col("src").alias("id"), "to", "w", "base")
        ends, circles = _pointers(one, scratch)
        waiting.append(ends)
        circles = scratch.keep(circles)
        # a node that leads into a circle keeps a way to itself only, so it never settles
        left = rows.join(ends.select(F.col("id").alias("src")).union(circles.withColumnRenamed("id", "src")), "src", "left_anti")
        ahead = ends.select(F.col("id").alias("dst"), "to", F.col("w").alias("more"), "base")
        moved = left.join(ahead, "dst", "left").withColumn("here", F.col("to").isNotNull())
        links = moved.select("src", F.coalesce("to", "dst").alias("dst"), F.when(F.col("here"), F.col("w") + F.col("more")).otherwise(F.col("w")).alias("w"))
        bases = moved.filter("here").select("src", none, (F.col("w") + F.col("base")).alias("w"))
        stuck = circles.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("bigint").alias("w"))
        after = scratch.keep(links.union(bases).union(stuck).groupBy("src", "dst").agg(F.max("w").alias("w")))
        scratch.drop(rows)
        peeled, rows, count = count, after, after.count()
        if before == peeled == count:
            break
    known = done[0] if done else nodes.select("id", F.lit(0).cast("bigint").alias("length")).limit(0)
    for part in done[1:]:
        known = known.union(part)
    for ends in reversed(waiting):
        there = known.select(F.col("id").alias("to"), "length")
        known = scratch.keep(known.union(ends.join(there, "to").select("id", F.greatest("base", F.col("w") + F.col("length")).alias("length"))))
    return known


def _trimmed(edges: DataFrame, scratch: Scratch, whole: bool) -> DataFrame:
    """Edges between nodes that have ways in and out, trimmed to the end, or while that takes a good part of them."""
    count = edges.count()
    while count:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        after = scratch.keep(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        scratch.drop(edges)
        edges, before, count = after, count, after.count()
        if before - count <= (0 if whole else WORTH * before):
            break
    return edges


def _contracted(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges around chains; (id, before, after) of the nodes of chains; (id, component) of circles that nothing else touches.

    A node of a chain has one way in and one way out. Pointers run to the last node of its chain.
    """
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).filter("n = 1").select("id")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("m"), F.min("dst").alias("next")).filter("m = 1").select("id", "next")
    chain = scratch.keep(out.join(into, "id"))
    heads = chain.select(F.col("id").alias("next"), F.lit(True).alias("inner"))
    linked = chain.join(heads, "next", "left")
    last = linked.filter("inner IS NULL").select("id", "next")
    now = scratch.keep(linked.select("id", F.when(F.col("inner").isNull(), F.col("id")).otherwise(F.col("next")).alias("at"), F.col("id").alias("least"), F.col("inner").isNull().alias("ended")))
    said = None
    while True:
        ahead = now.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("least").alias("other"), F.col("ended").alias("over"))
        stays, moves = now.filter("ended"), now.filter("NOT ended").join(ahead, "at")
        after = scratch.keep(stays.union(moves.select("id", F.col("far").alias("at"), F.least("least", "other").alias("least"), F.col("over").alias("ended"))))
        scratch.drop(now)
        now = after
        seen = now.agg(F.count(F.when(~F.col("ended"), 1)), F.bit_xor(F.xxhash64("id", "least"))).first()
        if not seen[0] or seen == said:
            break
        said = seen
    circles = now.filter("NOT ended").select("id", F.col("least").alias("component"))
    ends = now.filter("ended").select("id", "at").join(last.select(F.col("id").alias("at"), F.col("next").alias("after")), "at")
    mine = chain.select("id")
    entry = edges.join(mine.withColumnRenamed("id", "src"), "src", "left_anti").select(F.col("src").alias("before"), F.col("dst").alias("id")).join(ends, "id")
    spans = scratch.keep(entry.select("at", "before", "after"))
    members = scratch.keep(ends.select("id", "at").join(spans, "at").select("id", "before", "after"))
    rest = edges.join(mine.withColumnRenamed("id", "src"), "src", "left_anti").join(mine.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    return scratch.keep(rest.union(spans.select("before", "after")).distinct()), members, scratch.keep(circles)


def _spread(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Least label of all that reach a node, itself included: (id, label). Labels also jump to the label of their label."""
    now = scratch.keep(labels)
    while True:
        into = edges.join(now.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label")
        jump = now.filter("id <> label").join(now.select(F.col("id").alias("label"), F.col("label").alias("further")), "label").filter("further < label").select("id", F.col("further").alias("label"))
        best = into.union(jump).groupBy("id").agg(F.min("label").alias("other"))
        after = scratch.keep(now.join(best, "id", "left").select("id", F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("moved")))
        scratch.drop(now)
        if after.filter("moved").isEmpty():
            return after.select("id", "label")
        now = after.select("id", "label")


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of more than one node, by a search along edges and one against them in the order of its returns."""
    edges = pd.concat(batches)
    ahead, behind = edges.groupby("src")["dst"].agg(list).to_dict(), edges.groupby("dst")["src"].agg(list).to_dict()
    seen, returns = set(), []
    for start in ahead:
        path = [] if start in seen else [(start, iter(ahead[start]))]
        seen.add(start)
        while path:
            at, ways = path[-1]
            new = next((x for x in ways if x not in seen), None)
            if new is None:
                returns.append(path.pop()[0])
            else:
                seen.add(new)
                path.append((new, iter(ahead.get(new, ()))))
    out, taken = [], set()
    for start in reversed(returns):
        part = [] if start in taken else [start]
        taken.add(start)
        for at in part:
            for x in behind.get(at, ()):
                if x not in taken:
                    taken.add(x)
                    part.append(x)
        if len(part) > 1:
            least = min(part)
            out += [(x, least) for x in part]
    yield pd.DataFrame(out, columns=["id", "component"])


def strong_components(edges: DataFrame, scratch: Scratch, finish: int = FINISH) -> DataFrame:
    """(id, component) of the nodes of edges (src, dst) that lie on a cycle, a loop included; component is the least id.

    Edges are trimmed and chains contracted until neither takes anything, or no more than `finish` edges
    are left, which one task searches. Of more, every node is a pivot at once: the least id that reaches
    a node is its label, and what reaches the pivot backward inside its label is a component. These go,
    and the rest follows in the same way. Edges without an end are left out; no edges, no rows.
    """
    named = f"id {edges.schema['src'].dataType.simpleString()}"
    rest = scratch.keep(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    own = lambda df: df.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    loops, found, levels = own(rest), [], []
    rest = scratch.keep(rest.filter("src <> dst"))
    while True:
        count, whole = rest.count(), False
        while count:
            rest = _trimmed(rest, scratch, whole)
            rest, members, circles = _contracted(rest, scratch)
            levels.append((members, own(rest)))
            found.append(circles)
            rest = scratch.keep(rest.filter("src <> dst"))
            before, count = count, rest.count()
            if count <= finish or whole and before == count:
                break
            whole = before - count <= WORTH * before
        if not count:
            break
        if count <= finish:
            found.append(scratch.keep(rest.coalesce(1).mapInPandas(_searched, f"{named}, {named.replace('id', 'component', 1)}")))
            break
        nodes = rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct()
        labels = _spread(nodes.select("id", F.col("id").alias("label")), rest, scratch)
        a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
        inside = scratch.keep(rest.join(a, "src").join(b, "dst").filter("la = lb").select("src", "dst", F.col("la").alias("label")))
        reach = scratch.keep(labels.filter("id = label"))
        front = reach
        while not front.isEmpty():
            step = front.select(F.col("id").alias("dst"), "label").join(inside, ["dst", "label"]).select(F.col("src").alias("id"), "label").distinct()
            front = scratch.keep(step.join(reach.select("id"), "id", "left_anti"))
            reach = scratch.keep(reach.union(front))
        several = reach.join(reach.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"), "label", "left_semi")
        found.append(several.select("id", F.col("label").alias("component")))
        gone = reach.select("id")
        rest = scratch.keep(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    known = found[0] if found else loops.limit(0)
    for part in found[1:]:
        known = known.union(part)
    # a node with a loop stands alone only if no later level puts it into a larger component
    for members, alone in reversed(levels):
        known = scratch.keep(known.union(alone.join(known.select("id"), "id", "left_anti")))
        a, b = known.toDF("before", "component"), known.toDF("after", "other")
        back = members.join(a, "before").join(b, "after").filter("component = other").select("id", "component")
        known = scratch.keep(known.union(back.join(known.select("id"), "id", "left_anti")))
    known = scratch.keep(known.union(loops.join(known.select("id"), "id", "left_anti")))
    least = known.groupBy("component").agg(F.min("id").alias("least"))
    return known.join(least, "component").select("id", F.col("least").alias("component"))
