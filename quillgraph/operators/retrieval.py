"""Exact vector retrieval, ranking, and consolidation of memories.

Queries are sent to the corpus in blocks of at most QUERY_BLOCK, as a matrix; the corpus is scanned
batch by batch where it lies, and only each partition's best rows are shuffled; rows that can't be among
them by their angle to a pivot are not multiplied. With several blocks,
each block's rows are written before the next is read, so the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, prepare

QUERY_BLOCK = 8192
ROWS = 1024
#: Pivots a block of queries, and scores held at once (16 MB).
PIVOTS, CELLS = 32, 1 << 21


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for other lengths, empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors of the given width, and which rows these are."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    ok = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), width)
    norms = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norms, out=np.zeros_like(flat), where=norms > 0), ok


def _spread(matrix: np.ndarray, n: int) -> np.ndarray:
    """Up to n unit rows, each the one least like those before it."""
    few = matrix[np.linalg.norm(matrix, axis=1) > 0.5][: 64 * n]
    chosen, nearest = [], np.full(len(few), -np.inf)
    while len(chosen) < min(n, len(few)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, few @ few[chosen[-1]])
    return few[chosen]


class _Best:
    """The k best rows of each query so far, by score of 9 decimals, ties by name."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.names = k, np.full((n, k), -np.inf), np.empty((n, k), dtype=object)

    def least(self) -> np.ndarray:
        """What a row must reach for each query; what rounding may still change is let through."""
        return self.scores[:, -1] - 2e-9

    def add(self, live: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        """scores: a row for each of the queries in `live`, a column for each name."""
        least = self.least()[live]
        if scores.shape[1] > self.k:
            least = np.maximum(least, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1] - 2e-9)
        q, c = np.nonzero(scores >= least[:, None])
        if not len(q):
            return
        value, name = np.round(scores[q, c], 9), names[c]
        touched = np.unique(q)
        old = self.scores[live[touched]]
        i, j = np.nonzero(np.isfinite(old))
        q, value, name = np.concatenate([q, touched[i]]), np.concatenate([value, old[i, j]]), np.concatenate([name, self.names[live[touched]][i, j]])
        order = np.lexsort((-value, q))
        q, value, name = q[order], value[order], name[order]
        same = (q[1:] == q[:-1]) & (value[1:] == value[:-1])
        if same.any():
            tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
            name[tied] = name[tied][np.lexsort((np.unique(name[tied].astype(str), return_inverse=True)[1], -value[tied], q[tied]))]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.scores[live[q[keep]], place[keep]], self.names[live[q[keep]], place[keep]] = value[keep], name[keep]


def _nearest(ids: list[str], scopes: list[str | None] | None, matrix: np.ndarray, k: int, multiplied: Callable[[int], None] | None = None):
    """The k nearest rows of a partition to each query; rows whose angle to a pivot rules them out are not multiplied.

    Pivots are some of the queries. Rows lie with their nearest pivot; a query whose angle to the pivot is
    a, and rows whose angles to it are between low and high, are at least max(low - a, a - high) apart.
    `multiplied` is told how many pairs were compared.
    """
    width = matrix.shape[1]
    everyone = np.arange(len(ids))
    pivots = _spread(matrix, PIVOTS)
    turned = np.arccos(np.clip(matrix @ pivots.T, -1, 1))
    turned[np.linalg.norm(matrix, axis=1) < 0.5] = np.nan
    of_scope: dict[str, list[int]] = {}
    for i, name in enumerate(scopes or []):
        if name is not None:
            of_scope.setdefault(name, []).append(i)

    def groups(rows: np.ndarray, own: list[str | None] | None, best: _Best):
        """(queries, rows) that may meet; what lies in other scopes never does."""
        if own is not None:
            places: dict[str, list[int]] = {}
            for i, name in enumerate(own):
                if name in of_scope:
                    places.setdefault(name, []).append(i)
            yield from ((np.array(of_scope[name]), np.array(at)) for name, at in places.items())
            return
        zero = np.linalg.norm(rows, axis=1) < 0.5
        if not len(pivots):
            zero[:] = True
        if zero.any():
            yield everyone, np.flatnonzero(zero)
        if zero.all():
            return
        some = np.flatnonzero(~zero)
        angles = np.arccos(np.clip(rows[some] @ pivots.T, -1, 1))
        nearest = angles.argmin(axis=1)
        angle = angles[np.arange(len(some)), nearest]
        for p in np.unique(nearest):
            mine = nearest == p
            gap = np.maximum(angle[mine].min() - turned[:, p], turned[:, p] - angle[mine].max()) - 1e-6
            far = np.cos(np.clip(gap, 0, np.pi)) < best.least()
            live = np.flatnonzero(~far)
            if len(live):
                yield live, some[mine]

    def run(batches):
        best = _Best(len(ids), k)
        for batch in batches:
            rows, ok = _matrix(batch.column("embedding"), width)
            finite = np.isfinite(rows).all(axis=1)
            rows, ok = rows[finite], ok[finite]
            if not len(ok):
                continue
            names = np.array(batch.column("id").to_pylist(), dtype=object)[ok]
            own = None if scopes is None else batch.column("scope").take(pa.array(ok)).to_pylist()
            for live, at in groups(rows, own, best):
                step = max(1, CELLS // len(live))
                for start in range(0, len(at), step):
                    part = at[start : start + step]
                    best.add(live, matrix[live] @ rows[part].T, names[part])
                if multiplied:
                    multiplied(len(live) * len(at))
        q, c = np.nonzero(np.isfinite(best.scores))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], pa.string()), pa.array(best.names[q, c].tolist(), pa.string()), pa.array(best.scores[q, c], pa.float64())], ["query_id", "id", "score"])

    return run


def _scanned(queries: DataFrame, rows: DataFrame, scope: str | None, block: int, k: int) -> DataFrame:
    """(query_id, id, score) of all blocks."""
    scratch, found, several = Scratch(queries.sparkSession, "nearest"), None, queries.count() > block
    for ids, scopes, matrix in _blocks(queries, scope, block):
        some = rows.mapInArrow(_nearest(ids, scopes, matrix, k), "query_id string, id string, score double")
        some = scratch.keep(some) if several else some
        found = some if found is None else found.union(some)
    return rows.sparkSession.createDataFrame([], "query_id string, id string, score double") if found is None else found


def _blocks(queries: DataFrame, scope: str | None, block: int):
    n = queries.count()
    parts = max(1, -(-n // block))
    columns = [F.col("id").cast("string").alias("id"), "embedding", *([F.col(scope).cast("string").alias("scope")] if scope else [])]
    for b in range(parts):
        table = queries.filter((F.pmod(F.xxhash64("id"), F.lit(parts)) == b) & (F.size("embedding") > 0)).select(*columns).toArrow()
        if not table.num_rows:
            continue
        batch = table.combine_chunks().to_batches()[0]
        vectors = batch.column("embedding")
        matrix, ok = _matrix(vectors, len(vectors[0]))
        if len(ok) < len(vectors):
            raise ValueError("all queries must have vectors of one length")
        yield batch.column("id").to_pylist(), batch.column("scope").to_pylist() if scope else None, matrix


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, scope: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): each query's k nearest rows by cosine, ties by id.

    Both sides have id and embedding; with scope, only rows with the same value there. Vectors of
    other lengths are not compared; all queries have one length. Without a scope, angles to pivots tell
    which rows can't be among a query's k nearest. Rows with components that are not finite are left out.
    """
    prepare(queries.sparkSession)
    rows = corpus.select("id", "embedding", *([F.col(scope).cast("string").alias("scope")] if scope else []))
    found = _scanned(queries, rows, scope, block, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


LEVEL_BOOST = {"core": 1.3, "profile": 1.2, "preference": 1.1, "fact": 1.0, "episodic": 0.9}


def retrieve_memories(queries: DataFrame, memories: DataFrame, k: int = 10, least: float = 0.25, scope: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the top 3k by vector, without stale and forgotten ones, weighed by confidence and level."""
    top = vector_topk(queries, memories, 3 * k, scope).withColumnRenamed("rank", "near")
    kept = memories.filter("is_latest AND NOT is_forgotten").select("id", "confidence", "memory_level")
    boost = F.coalesce(F.create_map(*(F.lit(x) for kv in LEVEL_BOOST.items() for x in kv))[F.col("memory_level")], F.lit(1.0))
    rows = top.join(kept, "id").withColumn("score", F.round(F.col("score") * (0.6 + 0.4 * F.coalesce("confidence", F.lit(0.5))) * boost, 9)).filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def search_documents(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, limit: int = 10, chunk_least: float = 0.0, document_least: float = 0.0, org: str | None = None, pre_filter: bool = False
) -> DataFrame:
    """(query_id, document_id, score, chunks, rank): the best 3 * limit chunks, filtered by organisation and documents after the search
    (before it with pre_filter), their mean by document, the first five chunks of each, the best `limit` documents."""

    def allowed(rows: DataFrame) -> DataFrame:
        if org is not None:
            rows = rows.filter(F.col("org_id") == org)
        return rows if documents is None else rows.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")

    corpus = allowed(chunks) if pre_filter else chunks
    top = vector_topk(queries, corpus, 3 * limit).drop("rank")
    found = allowed(top.join(chunks.drop("embedding"), "id")).filter(F.col("score") >= chunk_least)
    one = F.struct((-F.col("score")).alias("o"), "id", "score", (F.col("score") > 0.5).alias("is_relevant"))
    per = found.groupBy("query_id", "document_id").agg(F.round(F.avg("score"), 9).alias("score"), F.slice(F.array_sort(F.collect_list(one)), 1, 5).alias("chunks")).filter(F.col("score") >= document_least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, id) again by cosine of query and content: (query_id, id, score, rank)."""
    rows = candidates.select("query_id", "id").join(queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(corpus.select("id", "embedding"), "id")
    scored = rows.select("query_id", "id", F.round(cosine(F.col("q"), F.col("embedding")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def rag_context(queries: DataFrame, memories: DataFrame, chunks: DataFrame, graph_lines: DataFrame | None = None, chunk_least: float = 0.3) -> DataFrame:
    """(query_id, context): profile memories, other memories, chunks and graph lines (query_id, line) in this order."""
    found = retrieve_memories(queries, memories).join(memories.select("id", "memory", "memory_level"), "id")
    first = F.col("memory_level").isin("core", "profile")
    lines = found.select("query_id", F.when(first, 0).otherwise(1).alias("part"), "rank", F.concat(F.lit("- "), "memory").alias("line"))
    near = vector_topk(queries, chunks, 5).filter(F.col("score") >= chunk_least)
    lines = lines.union(near.select("query_id", F.lit(2), "rank", F.concat(F.lit("[chunk "), "id", F.lit("]"))))
    if graph_lines is not None:
        lines = lines.union(graph_lines.select("query_id", F.lit(3), F.lit(0), "line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


def forget_by_similarity(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 5, least: float = 0.85) -> DataFrame:
    """Documents without the best match of each query, where that is similar enough."""
    best = search_documents(queries, chunks, limit=k).filter((F.col("rank") == 1) & (F.col("score") >= least))
    return documents.join(best.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def search_with_context(queries: DataFrame, memories: DataFrame, least: float, k: int = 10) -> DataFrame:
    """(query_id, id, score, related): hits and, of the same version chain, other entries as (distance, id), -1 for the one before."""
    hits = vector_topk(queries, memories, k).filter(F.col("score") >= least)
    root = F.coalesce("root_memory_id", "id")
    chain = memories.select("id", root.alias("root"), "version")
    others = chain.toDF("other", "root", "other_version")
    pairs = hits.join(chain, "id").join(others, "root").filter("id <> other")
    related = pairs.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct((F.col("other_version") - F.col("version")).alias("distance"), F.col("other").alias("id")))).alias("related"))
    return hits.join(related, ["query_id", "id"], "left").select("query_id", "id", "score", "related")


def similarity_or_relevance(links: DataFrame, memories: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, memory_id, score): cosine if both have vectors, else relevance / 100 within 0..1, else 0.5; never negative."""
    a, b = memories.select(F.col("id").alias("memory_id"), F.col("embedding").alias("m")), documents.select(F.col("id").alias("document_id"), F.col("embedding").alias("d"))
    rows = links.join(a, "memory_id", "left").join(b, "document_id", "left")
    relevance = F.when(F.col("relevance").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("relevance") / 100)))
    score = F.when(F.col("m").isNotNull() & F.col("d").isNotNull(), F.greatest(F.lit(0.0), cosine(F.col("m"), F.col("d")))).otherwise(F.coalesce(relevance, F.lit(0.5)))
    return rows.select("document_id", "memory_id", F.round(score, 6).alias("score"))


def chunks_with_context(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, previous, next) for hit chunks (id)."""
    w = Window.partitionBy("document_id").orderBy("position", "id")
    return chunks.select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next")).join(hits.select("id"), "id", "left_semi")


LEADERS = 4096


def _leaders(least: float):
    """(id, scope, place, embedding) of the rows of a group that no earlier leader of it covers."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        column = table.column("embedding").chunk(0)
        rows, _ = _matrix(column, len(column[0]))
        covered, chosen = np.zeros(len(rows), bool), []
        for i in range(len(rows)):
            if not covered[i]:
                chosen.append(i)
                covered |= np.round(rows @ rows[i], 12) >= least
        return table.take(pa.array(chosen, pa.int64()))

    return run


def _covered(ids: list[str], scopes: list[str], places: np.ndarray, matrix: np.ndarray, least: float):
    """(id, near, score): the nearest of the leaders of its scope that come before a row, where it is near enough; ties to the larger id."""
    width, of_scope = matrix.shape[1], {}
    for i in sorted(range(len(ids)), key=lambda i: ids[i], reverse=True):
        of_scope.setdefault(scopes[i], []).append(i)
    of_scope = {name: np.array(at) for name, at in of_scope.items()}

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows, ok = _matrix(part.column("embedding"), width)
                names, own = part.column("id").to_pylist(), part.column("scope").to_pylist()
                place = part.column("place").to_numpy()[ok]
                inside: dict[str, list[int]] = {}
                for i, at in enumerate(ok):
                    if own[at] in of_scope:
                        inside.setdefault(own[at], []).append(i)
                out = []
                for name, at in inside.items():
                    lead = of_scope[name]
                    scores = np.round(rows[at] @ matrix[lead].T, 12)
                    scores[places[lead][None, :] >= place[at][:, None]] = -np.inf
                    best = scores.argmax(axis=1)
                    top = scores[np.arange(len(at)), best]
                    out += [(names[ok[i]], ids[lead[j]], s) for i, j, s in zip(at, best, top) if s >= least]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], ["id", "near", "score"])

    return run


def consolidate(new: DataFrame, existing: DataFrame, scope: str = "space_id", least: float = 0.85, order: Sequence[str] = ("id",), block: int = LEADERS) -> DataFrame:
    """(id, action, target) for new memories: reinforce the best of the three nearest existing ones in the space, or an earlier
    new one that was created, or create.

    Among new ones the earliest leads: it is created unless an earlier created one of its space is similar
    enough, else it reinforces the most similar of these (ties to the larger id). A round takes the first
    `block` undecided rows of each space, finds the leaders among them in one task, and compares all rows
    with these leaders where they lie; what they cover is decided. A row gives at most one link a round, so
    equal memories give a link each; rounds are as many as the leaders of a space fill blocks.

    Null ids are left out. Rows without a vector, with a zero vector or without a space are like no other one and are
    created (`least` is above 0). Rows of one id are one memory, its first. All vectors have one length.
    """
    spark = prepare(new.sparkSession)
    scratch = Scratch(spark, "consolidate")
    best = vector_topk(new, existing, 3, scope).filter((F.col("rank") == 1) & (F.col("score") >= least)).select(F.col("query_id").alias("id"), F.col("id").alias("target"))
    matched = scratch.keep(best.select("id", F.lit("reinforce").alias("action"), "target"))
    rest = new.filter("id IS NOT NULL").join(matched, "id", "left_anti").groupBy("id").agg(
        *(F.min_by(c, F.struct(*order)).alias(n) for c, n in ((F.col(scope).cast("string"), "scope"), (F.col("embedding"), "embedding"))), F.min(F.struct(*order)).alias("turn")
    )
    sorted_rows = rest.repartitionByRange("scope", "turn", "id").sortWithinPartitions("scope", "turn", "id")
    placed = scratch.keep(sorted_rows.select("id", "scope", "embedding", F.monotonically_increasing_id().alias("place")))
    made = lambda ids: ids.select("id", F.lit("create").alias("action"), F.lit(None).cast("string").alias("target"))
    comparable = F.coalesce(F.col("scope").isNotNull() & F.exists("embedding", lambda x: x != 0), F.lit(False))
    alone, rows = placed.filter(~comparable), placed.filter(comparable)
    out, waiting, links, old = matched.unionByName(made(alone)), rows, None, None
    first = Window.partitionBy("scope").orderBy("place")
    while not waiting.isEmpty():
        head = waiting.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= block).drop("n")
        leaders = scratch.keep(head.groupBy("scope").applyInArrow(_leaders(least), waiting.schema))
        out = out.unionByName(made(leaders))
        found = None
        parts = max(1, -(-leaders.count() // QUERY_BLOCK))
        for part in range(parts):
            few = leaders.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
            if not few.num_rows:
                continue
            vectors = few.column("embedding").combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            matrix, _ = _matrix(vectors, len(vectors[0]))
            task = _covered(few.column("id").to_pylist(), few.column("scope").to_pylist(), few.column("place").to_numpy(), matrix, least)
            some = scratch.keep(rows.select("id", "scope", "place", "embedding").mapInArrow(task, "id string, near string, score double"))
            found = some if found is None else found.unionByName(some)
        links = found if links is None else links.unionByName(found)
        after = scratch.keep(waiting.join(found.select("id"), "id", "left_anti").join(leaders.select("id"), "id", "left_anti"))
        if old is not None:
            scratch.drop(old)
        waiting = old = after
    if links is None:
        return out
    target = links.groupBy("id").agg(F.max(F.struct("score", "near"))["near"].alias("target"))
    return out.unionByName(target.select("id", F.lit("reinforce").alias("action"), "target"))
