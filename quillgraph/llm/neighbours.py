"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, queries by greedy search on it.

Equal vectors are one node, so that a vector which is a third of all rows is searched and listed once.
Every round of the descent is a set of joins: nodes offer their best neighbours, open and settled, both
ways; the members that meet at a node are compared there, and what beats a member's worst neighbour goes
back to it. A round of the search joins the best unexpanded nodes of each query's pool with their
neighbours' lists, which lie in buckets and are not shuffled again. The graph is built over codes of a
byte a component; the last ranking is by the exact cosine of the original vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, prepare

NEIGHBOURS = 32  # a node's list
OFFERED = 12  # members that a node takes of each kind (open, settled) and direction
RETURNED = 3  # members that a node names to each member in a round
ROUNDS = 7
LEAST_CHANGE = 0.002  # the descent ends when fewer of all entries are new
BLOCK = 128  # rows of a block in which the first lists are filled
REVERSE = 32  # entries of the search graph that point back
POOL, EXPANDED = 320, 64  # nodes that a query's search keeps, and that it expands in a round
SEEDS = 256  # nodes that every query starts from, besides its own
RESCORED = 48  # nodes that are ranked again by exact cosines
FLUSH = 1 << 20  # pairs that a task holds before it thins them out

LISTS = "key bigint, code binary, ids array<bigint>, scores array<float>, open array<boolean>, kind array<int>"


def usable(v: Column) -> Column:
    """Whether a vector takes part: some component is not zero, none is null or not finite."""
    x = lambda e: e.cast("double")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(x(e)) | (F.abs(x(e)) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda e: x(e) != 0), F.lit(False))


def exact_cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, summed from the first component to the last."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _flat(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a byte a component, and places along two random directions of the vector's length."""
    directions: dict[int, np.ndarray] = {}
    for batch in batches:
        codes, along = [], []
        for v in batch.column("embedding"):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x / np.abs(x).max()
            codes.append(np.rint(127 * x).astype(np.int8).tobytes())
            if len(x) not in directions:
                directions[len(x)] = np.random.default_rng(len(x)).normal(size=(2, len(x)))
            along.append(directions[len(x)] @ (x / np.linalg.norm(x)))
        a = np.array(along).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(codes, pa.binary()), pa.array(a[:, 0]), pa.array(a[:, 1])], ["key", "code", "along0", "along1"])


def _unit(codes: pa.Array) -> np.ndarray:
    """Codes as unit rows; shorter ones are filled with zeros."""
    codes = codes.cast(pa.large_binary())
    offsets = np.frombuffer(codes.buffers()[1], dtype=np.int64, count=codes.offset + len(codes) + 1)[codes.offset :]
    data = np.frombuffer(codes.buffers()[2] or b"", dtype=np.int8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        m = data.reshape(len(size), width).astype(np.float32)
    else:
        m = np.zeros((len(size), width), dtype=np.float32)
        m[np.arange(width) < size[:, None]] = data
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=m, where=norms > 0)


def _lists(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, codes: pa.Array | None = None, is_open: np.ndarray | None = None, kind: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a key; entries are sorted by owner, the place of their key."""
    n = len(keys)
    offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
    listed = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(x, t))
    is_open = np.ones(len(ids), bool) if is_open is None else is_open
    kind = np.zeros(len(ids), np.int32) if kind is None else kind
    columns = [pa.array(keys, pa.int64()), pa.nulls(n, pa.binary()) if codes is None else codes, listed(ids, pa.int64()), listed(scores, pa.float32()), listed(is_open, pa.bool_()), listed(kind, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["key", "code", "ids", "scores", "open", "kind"])


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, is_open: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best entries of each owner, best first, ties by id; of equal ids one, settled if any of them is."""
    order = np.lexsort((is_open, ids, owner))
    owner, ids, scores, is_open = owner[order], ids[order], scores[order], is_open[order]
    one = np.ones(len(ids), bool)
    one[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    owner, ids, scores, is_open = owner[one], ids[one], scores[one], is_open[one]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores, is_open = owner[order], ids[order], scores[order], is_open[order]
    kept = np.arange(len(ids)) - np.searchsorted(owner, owner) < k
    return owner[kept], ids[kept], scores[kept], is_open[kept]


def _in_blocks(k: int):
    """First lists: the k nearest inside blocks of rows that lie side by side along a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code")
            width = np.array(pc.binary_length(codes))
            cuts = np.flatnonzero(np.diff(width)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(codes)), strict=True):
                for at in range(lo, hi, BLOCK):
                    part = batch.slice(at, min(BLOCK, hi - at))
                    keys, m = part.column("key").to_numpy(), _unit(part.column("code"))
                    owner, other = np.nonzero(~np.eye(len(keys), dtype=bool))
                    owner, ids, scores, _ = _best(owner, keys[other], (m @ m.T)[owner, other], np.ones(len(owner), bool), k)
                    yield _lists(keys, owner, ids, scores, part.column("code"))

    return run


def _merged(k: int, first: int, second: int):
    """The k best of all entries that came for a key; kind 1 marks the first open ones, 2 the first settled ones.

    Entries that were marked 1 have had their turn and are settled now.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lists")
            rows = lists.flatten()
            row_owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            field = lambda name: pa.chunked_array([rows]).combine_chunks().field(name)
            owner = np.repeat(row_owner, field("ids").value_lengths().to_numpy())
            is_open = _flat(field("open"), bool) & (_flat(field("kind"), np.int32) != 1)
            owner, ids, scores, is_open = _best(owner, _flat(field("ids"), np.int64), _flat(field("scores"), np.float32), is_open, k)
            kind = np.zeros(len(ids), np.int32)
            for mark, flag, most in ((1, True, first), (2, False, second)):
                at = np.flatnonzero(is_open == flag)
                kind[at[np.arange(len(at)) - np.searchsorted(owner[at], owner[at]) < most]] = mark
            yield _lists(batch.column("key").to_numpy(), owner, ids, scores, batch.column("code"), is_open, kind)

    return run


def _together(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.max("code").alias("code"), F.collect_list(F.struct("ids", "scores", "open", "kind")).alias("lists"))


def _thin(found: list[tuple], k: int) -> pa.RecordBatch:
    key, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keys, owner = np.unique(key, return_inverse=True)
    owner, ids, scores, _ = _best(owner, other, score, np.ones(len(owner), bool), k)
    return _lists(keys, owner, ids, scores)


def _compared(k: int, returned: int):
    """Members that met at a node, compared pair by pair if one of them is open: lists of better neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                lists = whole.column("members").slice(at, 128)
                rows, sizes = lists.flatten(), lists.value_lengths().to_numpy()
                n, most = len(lists), int(sizes.max())
                place = np.arange(most) < sizes[:, None]
                ids, worst, fresh = np.full((n, most), -1), np.full((n, most), np.inf, np.float32), np.zeros((n, most), bool)
                ids[place], worst[place], fresh[place] = rows.field("id").to_numpy(), rows.field("worst").to_numpy(), rows.field("kind").to_numpy() == 1
                units = _unit(rows.field("code"))
                m = np.zeros((n, most, units.shape[1]), np.float32)
                m[place] = units
                scores = m @ m.transpose(0, 2, 1)
                good = place[:, :, None] & place[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (fresh[:, :, None] | fresh[:, None, :]) & (scores > worst[:, :, None])
                scores[~good] = -np.inf
                if most > returned:
                    good &= scores >= -np.partition(-scores, returned - 1, axis=2)[:, :, returned - 1 : returned]
                x, y, z = np.nonzero(good)
                found.append((ids[x, y], ids[x, z], scores[x, y, z]))
                held += len(x)
                if held > FLUSH:
                    yield _thin(found, k)
                    found, held = [], 0
        if held:
            yield _thin(found, k)

    return run


def _named(lists: DataFrame, size: int) -> DataFrame:
    """(id, code, worst): a node's code and the score that a new neighbour must beat."""
    return lists.select(F.col("key").alias("id"), "code", F.when(F.size("ids") < size, F.lit(-2.0)).otherwise(F.element_at("scores", -1)).cast("float").alias("worst"))


def _entries(lists: DataFrame) -> DataFrame:
    e = lists.select("key", F.explode(F.arrays_zip("ids", "scores", "kind")).alias("e"))
    return e.select("key", F.col("e.ids").alias("id"), F.col("e.scores").alias("score"), F.col("e.kind").alias("kind"))


def _back(entries: DataFrame, most: int) -> DataFrame:
    """Entries turned round, the best of each node and kind: a node that is in very many lists takes as many as others."""
    turned = entries.select(F.col("id").alias("key"), F.col("key").alias("id"), "score", "kind")
    w = Window.partitionBy("key", "kind").orderBy(F.desc("score"), "id")
    return turned.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("place")


def descend(nodes: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph of nodes (key, code, along0, along1), as LISTS."""
    first = None
    for along in ("along0", "along1"):
        order = [F.length("code"), F.col(along), F.col("key")]
        part = nodes.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "code").mapInArrow(_in_blocks(NEIGHBOURS), LISTS)
        first = part if first is None else first.union(part)
    merge = _merged(NEIGHBOURS, OFFERED, OFFERED)
    graph = scratch.keep(_together(first).mapInArrow(merge, LISTS))
    for _ in range(rounds):
        offered = _entries(graph).filter("kind > 0")
        members = offered.union(_back(offered, OFFERED)).join(_named(graph, NEIGHBOURS), "id")
        met = members.groupBy("key").agg(F.collect_list(F.struct("id", "kind", "worst", "code")).alias("members"))
        found = met.select("members").mapInArrow(_compared(NEIGHBOURS, RETURNED), LISTS)
        after = scratch.keep(_together(graph.union(found)).mapInArrow(merge, LISTS))
        scratch.drop(graph)
        graph = after
        total, new = graph.agg(F.sum(F.size("ids")), F.sum(F.size(F.filter("open", lambda x: x)))).first()
        if not total or new <= LEAST_CHANGE * total:
            break
    return graph


def _started(keys: np.ndarray, codes: list[bytes], width: int, pool: int):
    """Pools of new queries: the seeds of the same length, and the query's own node at the top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(c) for c in codes])
        seeds = _unit(pa.array(codes, pa.binary()))
        for batch in batches:
            own, m = batch.column("key").to_numpy(), batch.column("code")
            lengths = np.array(pc.binary_length(m))
            units = _unit(m)
            d = max(units.shape[1], seeds.shape[1])
            pad = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))  # noqa: B023, E731
            scores = pad(units) @ pad(seeds).T
            owner, at = np.nonzero((lengths[:, None] == sizes[None, :]) & (own[:, None] != keys[None, :]))
            owner, ids, scores = np.concatenate([owner, np.arange(len(own))]), np.concatenate([keys[at], own]), np.concatenate([scores[owner, at], np.full(len(own), 2, np.float32)])
            owner, ids, scores, is_open = _best(owner, ids, scores, np.ones(len(ids), bool), pool)
            kind = (np.arange(len(ids)) - np.searchsorted(owner, owner) < width).astype(np.int32)
            yield _lists(own, owner, ids, scores, m, is_open, kind)

    return run


def _expanded(pool: int):
    """Neighbours of expanded nodes that beat the worst of the query's pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                near = part.column("near")
                rows, sizes = near.flatten(), near.value_lengths().to_numpy()
                owner = np.repeat(np.arange(len(near)), sizes)
                scores = np.einsum("ij,ij->i", _unit(rows.field("code")), _unit(part.column("code"))[owner])
                good = scores > part.column("worst").to_numpy()[owner]
                keys, place = np.unique(part.column("query").to_numpy(), return_inverse=True)
                owner, ids, scores, _ = _best(place[owner[good]], rows.field("id").to_numpy()[good], scores[good], np.ones(int(good.sum()), bool), pool)
                yield _lists(keys, owner, ids, scores)

    return run


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, scratch: Scratch) -> DataFrame:
    """Pools (LISTS) of queries (key, code), each a node of the graph, after greedy search.

    In a round a query expands the EXPANDED best nodes of its pool that it has not expanded yet; it
    ends when none of the POOL best is left.
    """
    spark = nodes.sparkSession
    entries = _entries(graph).withColumn("kind", F.lit(0))
    links = entries.union(_back(entries, REVERSE)).select("key", "id").distinct().join(nodes.select(F.col("key").alias("id"), "code"), "id")
    table = f"near_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = links.groupBy("key").agg(F.collect_list(F.struct("id", "code")).alias("near"))
    near.write.bucketBy(parts, "key").option("path", f"{scratch.base}/{table}").saveAsTable(table)
    seeds = nodes.orderBy(F.xxhash64("key"), "key").limit(SEEDS).select("key", "code").collect()
    keys, codes = np.array([r["key"] for r in seeds], dtype=np.int64), [bytes(r["code"]) for r in seeds]
    pools = scratch.keep(queries.select("key", "code").mapInArrow(_started(keys, codes, EXPANDED, POOL), LISTS))
    merge = _merged(POOL, EXPANDED, 0)
    while not pools.filter(F.exists("kind", lambda x: x == 1)).isEmpty():
        asked = _entries(pools).filter("kind = 1").select(F.col("key").alias("query"), F.col("id").alias("key"))
        asked = asked.join(_named(pools, POOL).withColumnRenamed("id", "query"), "query")
        found = spark.table(table).join(asked.hint("shuffle_hash"), "key").select("query", "code", "worst", "near").mapInArrow(_expanded(POOL), LISTS)
        after = scratch.keep(_together(pools.union(found)).mapInArrow(merge, LISTS))
        scratch.drop(pools)
        pools = after
    spark.sql(f"DROP TABLE {table}")
    return pools


def nearest(vectors: DataFrame, asked: Column, k: int = 5, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that asked holds for, its k nearest other rows by cosine.

    vectors: vec_id and embedding (any float type); other columns are ignored. Null, empty and zero
    vectors and those with null or non-finite components take no part. Vectors are compared with those
    of their own length only. Ties go by the smaller vec_id, null ids last; repeated rows are rows of
    their own, and only the query's own row is left out. An empty table, or one with a single row, gives
    no rows. Neighbours are found by a graph, so a far one may stand in for a near one now and then;
    scores are exact. With at most SEEDS different vectors nothing is missed.
    """
    scratch = Scratch(prepare(vectors.sparkSession), "neighbours")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce(asked, F.lit(False)).alias("asked")).filter(usable(F.col("embedding")))
    w = Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last())
    least = rows.select("embedding", "vec_id").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1)
    classes = least.groupBy("embedding").agg(F.collect_list(F.struct("place", "vec_id")).alias("members"))
    classes = scratch.keep(classes.withColumn("key", F.monotonically_increasing_id()))
    nodes = scratch.keep(classes.select("key", "embedding").mapInArrow(_describe, "key bigint, code binary, along0 double, along1 double"))
    queries = scratch.keep(rows.filter("asked").select("embedding", F.col("vec_id").alias("query_id")).join(classes.select("embedding", "key"), "embedding").select("query_id", "key"))
    starts = nodes.join(queries.select("key").distinct(), "key", "left_semi")
    pools = search(starts, nodes, descend(nodes, scratch, rounds), scratch)

    # exact cosines of what the pools hold at the top, then of its rows the k + 1 best, then each query without its own row
    top = pools.select(F.col("key").alias("query"), F.explode(F.slice("ids", 1, RESCORED)).alias("key"))
    pairs = top.join(classes, "key").join(classes.select(F.col("key").alias("query"), F.col("embedding").alias("asking")), "query")
    scored = pairs.select("query", "key", exact_cosine(F.col("asking"), F.col("embedding")).alias("score"), F.explode("members.vec_id").alias("vec_id"))
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("key")]
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k + 1)
    found = scratch.keep(best.groupBy(F.col("query").alias("key")).agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", F.col("key").alias("node")))).alias("found")))
    own = F.array_position(F.transform("found", lambda x: (x["node"] == F.col("key")) & x["vec_id"].eqNullSafe(F.col("query_id"))), True)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != own), 1, k)
    return queries.join(found, "key").select("query_id", F.posexplode(others).alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """nearest over embeddings, asked by rows whose vec_id is divisible by 50. Nulls, ties, repeats and empty tables as there."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: Exact search; equal while the graph misses nothing.
OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, x: s + x)) AS norm FROM v),
p AS (SELECT q.n AS own, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda s, x: s + x) / (q.norm * c.norm) AS score
  FROM u q JOIN u c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
