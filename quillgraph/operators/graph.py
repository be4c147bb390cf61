"""Graph operators: breadth-first closures, cycles, waves, layers, components, knowledge-graph upserts.

Loops join only the frontier with the edges; each round's rows are written to the shared folder, so
plans stay short and a lost executor costs one round. Only counts reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, prepare
from .chains import longest_paths, strong_components
from .components import components
from .folds import capped_fold


#: A frontier of at most this many rows (about a MB) goes to every task; a larger one is shuffled, as the driver collects what it broadcasts.
SMALL = 10_000
#: A closure of at most this many rounds reads the edges as they are; for more of them they are written in buckets.
FEW_ROUNDS = 3


def bfs(start: DataFrame, edges: DataFrame, max_depth: int, parents: bool = True) -> DataFrame:
    """(origin, id, depth, parent): what each origin reaches along edges (src, dst), at least depth; ties by least parent, which is null without parents.

    start: (origin, id) at depth 0. What is known lies in tables of falling size: two of like size are
    written as one, so a round reads few tables and a row is written again a logarithmic number of times.
    A round joins all of them at once, so that a task sorts its share of them once.
    """
    scratch = Scratch(prepare(start.sparkSession), "bfs")
    edges = scratch.keep(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    frontier = scratch.keep(start.select("origin", "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct())
    known = [(frontier, new := frontier.count())]
    for depth in range(1, max_depth + 1):
        at = frontier.select("origin", F.col("id").alias("src"))
        met = edges.join(F.broadcast(at) if new <= SMALL else at.hint("merge"), "src").select("origin", F.col("dst").alias("id"), F.col("src").alias("parent"))
        step = met.groupBy("origin", "id").agg(F.min("parent").alias("parent")) if parents else met.select("origin", "id").distinct().withColumn("parent", F.lit(None).cast("string"))
        seen = reduce(DataFrame.union, (part.select("origin", "id") for part, _ in known))
        frontier = scratch.keep(step.join(seen.hint("merge"), ["origin", "id"], "left_anti").select("origin", "id", F.lit(depth).alias("depth"), "parent"))
        if not (new := frontier.count()):
            break
        known = _settled(known + [(frontier, new)], frontier, scratch)
    return reduce(DataFrame.unionByName, (part for part, _ in known))


def _settled(known: list[tuple[DataFrame, int]], frontier: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, int]]:
    """Tables with their counts of rows, of which two of like size became one."""
    while len(known) > 1 and known[-2][1] <= 2 * known[-1][1]:
        (a, n), (b, m) = known[-2:]
        known[-2:] = [(scratch.keep(a.unionByName(b)), n + m)]
        for table in (a, b):
            if table is not frontier:
                scratch.drop(table)
    return known


def one_origin(ids: DataFrame) -> DataFrame:
    return ids.select(F.lit("").alias("origin"), "id")


def closure(ids: DataFrame, edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(id, depth) of all that a set of ids reaches, itself included.

    Edges are written once in buckets of src, so that a round neither shuffles nor sorts them; a search of
    few rounds reads them as they are. An id stands once in a frontier and in what is known, so a task
    holds its share of the ids in a hash table, however many edges meet in one of them.
    """
    spark = prepare(edges.sparkSession)
    scratch = Scratch(spark, "closure")
    edges = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    table = scratch.in_buckets(edges, "src") if max_depth > FEW_ROUNDS else None
    edges = spark.table(table) if table else scratch.keep(edges)
    frontier = scratch.keep(ids.select("id", F.lit(0).alias("depth")).distinct())
    known = [(frontier, new := frontier.count())]
    for depth in range(1, max_depth + 1):
        at = frontier.select(F.col("id").alias("src"))
        met = edges.join(F.broadcast(at) if new <= SMALL else at.hint("shuffle_hash"), "src").select(F.col("dst").alias("id")).distinct()
        seen = reduce(DataFrame.union, (part.select("id") for part, _ in known))
        frontier = scratch.keep(met.join(seen.hint("shuffle_hash"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        if not (new := frontier.count()):
            break
        known = _settled(known + [(frontier, new)], frontier, scratch)
    if table:
        scratch.drop_buckets(table)
    return reduce(DataFrame.unionByName, (part for part, _ in known))


def edges_of(deps: DataFrame, *types: str, reverse: bool = False) -> DataFrame:
    rows = deps.filter(F.col("type").isin(*types)) if types else deps
    names = ("depends_on_id", "issue_id") if reverse else ("issue_id", "depends_on_id")
    return rows.select(F.col(names[0]).alias("src"), F.col(names[1]).alias("dst"))


def ready_transitive(issues: DataFrame, deps: DataFrame, max_depth: int = 50) -> DataFrame:
    """(id) of open issues not blocked (blocks only) and not below a blocked parent."""
    from .work import direct_blocks

    direct = direct_blocks(issues, deps, ("blocks",)).select(F.col("issue_id").alias("id")).distinct()
    return issues.filter("status = 'open'").select("id").join(closure(direct, edges_of(deps, "parent-child", reverse=True), max_depth), "id", "left_anti")


def would_create_cycle(candidates: DataFrame, edges: DataFrame, max_depth: int = 100) -> DataFrame:
    """(src, dst, cycle) for new edges: self edges, and those whose src the dst already reaches.

    A way from a dst to a src runs only over nodes that some dst reaches and from which some src is
    reached. Two closures of plain ids find these; only edges among them, and only candidates with
    both ends among them, enter the search that keeps its origin.
    """
    scratch = Scratch(prepare(candidates.sparkSession), "candidates")
    new = scratch.keep(candidates.select("src", "dst"))
    edges = scratch.keep(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    open_ends = new.filter("src <> dst").distinct()
    ahead = closure(open_ends.select(F.col("dst").alias("id")), edges, max_depth).select("id")
    known = scratch.keep(edges.join(ahead.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst"))
    ends = open_ends.select(F.col("src").alias("id")).join(ahead, "id", "left_semi")
    between = scratch.keep(closure(ends, known.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth).select("id"))
    inside = known.join(between.withColumnRenamed("id", "src"), "src", "left_semi").join(between.withColumnRenamed("id", "dst"), "dst", "left_semi")
    asked = open_ends.join(between.withColumnRenamed("id", "src"), "src", "left_semi").join(between.withColumnRenamed("id", "dst"), "dst", "left_semi")
    starts = asked.select(F.col("dst").alias("origin"), F.col("dst").alias("id")).distinct()
    reached = bfs(starts, inside, max_depth, parents=False).select(F.col("origin").alias("dst"), F.col("id").alias("src"), F.lit(True).alias("hit"))
    return new.join(reached, ["src", "dst"], "left").select("src", "dst", (F.col("hit").isNotNull() | (F.col("src") == F.col("dst"))).alias("cycle"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes on cycles; component is the least id of the strongly connected set."""
    return strong_components(edges, Scratch(prepare(edges.sparkSession), "cycles"))


def traverse(starts: DataFrame, edges: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes reached over undirected edges with least depth, and the edges with both ends reached."""
    edges = Scratch(prepare(edges.sparkSession), "traversed").keep(edges)
    both = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    nodes = closure(starts, both.union(both.select("dst", "src")), max_depth)
    kept = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes, kept


def waves(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(epic, id, wave): wave 0 has no dependency inside its epic, others come after their last; cyclic parts have none.

    members: (epic, id); edges: (src, dst), src depends on dst. A wave is a longest path.
    """
    scratch = Scratch(prepare(members.sparkSession), "waves")
    key = lambda c: F.concat("epic", F.lit("\1"), c)
    all_members = scratch.keep(members.select("epic", "id").distinct())
    inside = all_members.withColumnRenamed("id", "src").join(edges, "src").join(all_members.withColumnRenamed("id", "dst"), ["epic", "dst"], "left_semi").select(key("src").alias("src"), key("dst").alias("dst"))
    named = scratch.keep(all_members.select("epic", F.col("id").alias("own"), key("id").alias("id")))
    lengths = longest_paths(named.select("id"), inside, scratch)
    return named.join(lengths, "id").select("epic", F.col("own").alias("id"), F.col("length").cast("int").alias("wave"))


def parallelism(found: DataFrame) -> DataFrame:
    """(epic, max_parallelism): the size of each epic's widest wave."""
    return found.groupBy("epic", "wave").agg(F.count("*").alias("n")).groupBy("epic").agg(F.max("n").alias("max_parallelism"))


def layers(nodes: DataFrame, edges: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, layer): longest path over edges (src, dst); nodes on or behind cycles get 0; children rise to their parent's layer.

    parents: (id, parent).
    """
    one = waves(nodes.select(F.lit("").alias("epic"), "id"), edges).select("id", F.col("wave").alias("layer"))
    base = nodes.select("id").join(one, "id", "left").fillna(0, ["layer"])
    up = parents.join(base.select(F.col("id").alias("parent"), F.col("layer").alias("above")), "parent").groupBy("id").agg(F.max("above").alias("above"))
    return base.join(up, "id", "left").select("id", F.greatest("layer", F.coalesce("above", F.lit(0))).alias("layer"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes, component the least id; edges (src, dst) with both ends in nodes count."""
    scratch = Scratch(prepare(nodes.sparkSession), "connected")
    ids = nodes.select("id")
    both = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    found = components(both.toDF("a", "b"), scratch)
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def message_thread(messages: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, depth) of the threads that messages (id) stand in: up replies-to to the roots, then all replies below."""
    scratch = Scratch(prepare(messages.sparkSession), "thread")
    replies = scratch.keep(edges_of(deps, "replies-to"))
    # written, as an anti-join on the tables of a closure would sort the replies once for each of them
    up = scratch.keep(closure(messages, replies).select("id"))
    roots = up.join(replies.select(F.col("src").alias("id")), "id", "left_anti")
    return closure(roots, replies.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def version_chain(memories: DataFrame) -> DataFrame:
    """(id, root, place) of chains with more than one entry: from the root forward by the first child (least id).

    Each entry points to its parent, and pointers double each round, so rounds follow the logarithm
    of the longest chain. Entries on a circle of parents have no root.
    """
    scratch = Scratch(prepare(memories.sparkSession), "versions")
    child = memories.filter("parent_memory_id IS NOT NULL").groupBy(F.col("parent_memory_id").alias("up")).agg(F.min(F.struct(F.length("id"), F.col("id")))["id"].alias("id"))
    known = memories.select("id")
    child = child.join(known.withColumnRenamed("id", "up"), "up", "left_semi")
    roots = memories.join(known.withColumnRenamed("id", "parent_memory_id"), "parent_memory_id", "left_anti").select(F.col("id").alias("root"))
    links = scratch.keep(child.select("id", "up", F.lit(1).cast("bigint").alias("place")))
    longest, reach = links.count(), 1
    while reach < longest:
        above = links.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"))
        after = scratch.keep(links.join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(links)
        links, reach = after.drop("moved"), 2 * reach
        if after.filter("moved").isEmpty():
            break
    chains = links.join(roots, F.col("up") == F.col("root"), "left_semi").select("id", F.col("up").alias("root"), F.col("place").cast("int").alias("place"))
    return chains.union(chains.select(F.col("root").alias("id"), "root", F.lit(0)).distinct())


RELATIONS = ("updates", "extends", "derives")


def memory_edges(memories: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target, relation): documents to memories, and relations of memories whose target exists.

    Without a relation map, the parent counts as updates; unknown relations count as updates.
    """
    derives = links.select(F.concat(F.lit("doc:"), "document_id").alias("source"), F.col("memory_id").alias("target"), F.lit("derives").alias("relation"))
    fallback = F.when(F.col("parent_memory_id").isNotNull(), F.create_map("parent_memory_id", F.lit("updates")))
    pairs = F.when(F.size(F.coalesce("memory_relations", F.create_map().cast("map<string,string>"))) > 0, F.col("memory_relations")).otherwise(fallback)
    named = memories.select(F.col("id").alias("target"), F.explode(pairs).alias("source", "relation"))
    known = named.join(memories.select(F.col("id").alias("source")), "source", "left_semi")
    return derives.union(known.select("source", "target", F.when(F.col("relation").isin(*RELATIONS), F.col("relation")).otherwise("updates")))


def upsert_nodes(mentions: DataFrame) -> DataFrame:
    """(name, type, org_id, mention_count, confidence) of node mentions (name, type, org_id, confidence, ts, seq).

    With a map column properties in the mentions, also (properties): of each key the value of the last
    mention that has it. A node's entries are reduced by key, so a popular node is no list of its mentions.
    """
    key = ["name", "type", "org_id"]
    keyed = mentions.withColumn("name", F.lower(F.trim("name")))
    nodes = capped_fold(keyed, key, ["ts", "seq"], "confidence", 0.8, 0.2, 0.05).withColumnRenamed("n", "mention_count")
    if "properties" not in mentions.columns:
        return nodes
    entries = keyed.select(*key, "ts", "seq", F.explode("properties").alias("k", "v"))
    # sorted by a number first, as long texts compare slowly
    last = entries.groupBy(F.xxhash64(*key, "k").alias("place"), *key, "k").agg(F.max_by("v", F.struct("ts", "seq", "v")).alias("v"))
    merged = last.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))
    empty = F.create_map().cast(merged.schema["properties"].dataType)
    return nodes.join(merged.alias("m"), [nodes[c].eqNullSafe(F.col(f"m.{c}")) for c in key], "left").select(*(nodes[c] for c in nodes.columns), F.coalesce("m.properties", empty).alias("properties"))


def upsert_edges(mentions: DataFrame) -> DataFrame:
    """(source, target, relation, confidence, weight) of edge mentions; closed forms of the first row and the count."""
    first = F.min(F.struct("ts", "seq", "confidence"))["confidence"]
    more = F.count("*") - 1
    return mentions.groupBy("source", "target", "relation").agg(F.least(F.lit(1.0), first + 0.1 * more).alias("confidence"), F.least(F.lit(5.0), 1.0 + 0.5 * more).alias("weight"))


def count_nodes(mentions: DataFrame) -> DataFrame:
    """(name, type, org_id, mention_count) of the nodes of upsert_nodes; nothing is put in order for it."""
    return mentions.groupBy(F.lower(F.trim("name")).alias("name"), "type", "org_id").agg(F.count("*").alias("mention_count"))


def ingest_graph(entities: DataFrame, relationships: DataFrame, confidence: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; edges find their ends by lower-case name, those with a missing end go.

    Without confidence the nodes have counts only, and no mention is sorted.
    """
    nodes = upsert_nodes(entities) if confidence else Scratch(prepare(entities.sparkSession), "nodes").keep(count_nodes(entities))
    names = nodes.select("name").distinct()
    edges = relationships.withColumns({"source": F.lower(F.trim("source")), "target": F.lower(F.trim("target"))})
    edges = edges.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    return nodes, upsert_edges(edges)


def graph_stats(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(kind, name, n): counts of nodes and edges, top entities and relations."""
    total = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("name"), "n")
    entities = nodes.orderBy(F.desc("mention_count"), "name", "type", "org_id").limit(top).select(F.lit("entity"), "name", F.col("mention_count"))
    relations = edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(top).select(F.lit("relation"), "relation", "n")
    return total(nodes, "nodes").union(total(edges, "edges")).union(entities).union(relations)


def visualize(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The most mentioned nodes with a size, and the edges among them."""
    top = nodes.orderBy(F.desc("mention_count"), "name", "type", "org_id").limit(min(limit, 500)).withColumn("size", F.least(F.lit(30), 5 + 2 * F.col("mention_count")))
    names = top.select("name").distinct()
    return top, edges.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")


def node_search(nodes: DataFrame, org: str, text: str, limit: int = 20) -> DataFrame:
    if len(text) < 2:
        raise ValueError("a search needs two characters")
    return nodes.filter((F.col("org_id") == org) & F.lower("name").contains(text.lower())).orderBy(F.desc("mention_count"), "name", "type").limit(limit)


def node_with_edges(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, direction, relation, other, other_count) for given names."""
    wanted, other = names.select("name"), nodes.select(F.col("name").alias("other"), F.col("mention_count").alias("other_count"))
    out = edges.select(F.col("source").alias("name"), F.lit("out").alias("direction"), "relation", F.col("target").alias("other"))
    into = edges.select(F.col("target").alias("name"), F.lit("in").alias("direction"), "relation", F.col("source").alias("other"))
    return out.union(into).join(wanted, "name", "left_semi").join(other, "other").select("name", "direction", "relation", "other", "other_count")


def graph_context(nodes: DataFrame, edges: DataFrame, text: str, max_nodes: int = 3, depth: int = 2, lines: int = 15) -> DataFrame:
    """(line) of the form - A -> rel -> B around the most mentioned nodes whose name has the text."""
    starts = nodes.filter(F.lower("name").contains(text.lower())).orderBy(F.desc("mention_count"), "name").limit(max_nodes).select(F.col("name").alias("id"))
    near = traverse(starts, edges.select("source", "relation", "target"), depth)[1]
    line = F.concat(F.lit("- "), "source", F.lit(" → "), F.translate("relation", "_", " "), F.lit(" → "), "target")
    return near.select(line.alias("line")).distinct().orderBy("line").limit(lines)
