"""Queries over vectors. Queries are the rows whose id is divisible by 100, searched against all rows."""

from pyspark.sql import functions as F

from ..operators import retrieval
from .registry import query

SIM = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9)"
TOP = """top AS (SELECT * FROM (SELECT q.id AS query_id, c.id, {sim} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {sim} DESC, c.id) AS rank
  FROM {table} q JOIN {table} c ON {on} WHERE CAST(q.id AS INT) % 100 = 0) WHERE rank <= {k})"""


def top(table, k, on="true"):
    return TOP.format(sim=SIM, table=table, k=k, on=on)


def asked(df):
    return df.filter("CAST(id AS INT) % 100 = 0")


@query("V1_vector_topk", f"WITH {top('memories', 10)} SELECT query_id, id, rank FROM top")
def _(t):
    return retrieval.vector_topk(asked(t.memories), t.memories, 10).select("query_id", "id", "rank")


@query("V1_vector_topk_scoped", f"WITH {top('memories', 5, 'q.space_id = c.space_id')} SELECT query_id, id, rank FROM top")
def _(t):
    return retrieval.vector_topk(asked(t.memories), t.memories, 5, "space_id").select("query_id", "id", "rank")


@query("V2_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


WEIGHED = f"""{top('memories', 30)}, s AS (SELECT t.query_id, t.id, round(t.score * (0.6::DOUBLE + 0.4::DOUBLE * coalesce(m.confidence, 0.5::DOUBLE)) * CASE m.memory_level WHEN 'core' THEN 1.3::DOUBLE WHEN 'profile' THEN 1.2::DOUBLE WHEN 'preference' THEN 1.1::DOUBLE WHEN 'episodic' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score,
  m.memory, m.memory_level FROM top t JOIN memories m USING (id) WHERE m.is_latest AND NOT m.is_forgotten),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.25) WHERE rank <= 10)"""


@query("V3_retrieve_memories", f"WITH {WEIGHED} SELECT query_id, id, round(score, 6) AS score, rank FROM found")
def _(t):
    return retrieval.retrieve_memories(asked(t.memories), t.memories).withColumn("score", F.round("score", 6))


@query("V4_search_documents", f"""WITH {top('chunks', 30)}, f AS (SELECT t.*, c.document_id FROM top t JOIN chunks c USING (id) WHERE c.org_id = 'org1' AND score >= 0.1),
d AS (SELECT query_id, document_id, round(avg(score), 9) AS score, array_to_string(list(id ORDER BY score DESC, id)[1:5], ',') AS chunks FROM f GROUP BY 1, 2)
SELECT query_id, document_id, round(score, 6) AS score, chunks FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rn FROM d WHERE score >= 0.1) WHERE rn <= 10""")
def _(t):
    out = retrieval.search_documents(asked(t.chunks), t.chunks, limit=10, chunk_least=0.1, document_least=0.1, org="org1")
    return out.select("query_id", "document_id", F.round("score", 6).alias("score"), F.array_join("chunks.id", ",").alias("chunks"))


@query("V5_rerank_by_similarity", f"WITH {top('memories', 20)} SELECT query_id, id, round(score, 6) AS score FROM top WHERE rank <= 3")
def _(t):
    q = asked(t.memories)
    return retrieval.rerank(retrieval.vector_topk(q, t.memories, 20), q, t.memories, 3).select("query_id", "id", F.round("score", 6).alias("score"))


@query("V6_rag_context", f"""WITH {WEIGHED}, {top('chunks', 5).replace('top AS', 'near AS')}, l AS (SELECT query_id, CASE WHEN memory_level IN ('core', 'profile') THEN 0 ELSE 1 END AS part, rank, '- ' || memory AS line FROM found UNION ALL SELECT query_id, 2, rank, '[chunk ' || id || ']' FROM near WHERE score >= 0.3)
SELECT query_id, string_agg(line, chr(10) ORDER BY part, rank, line) AS context FROM l GROUP BY 1""")
def _(t):
    return retrieval.rag_context(asked(t.memories), t.memories, t.chunks)


@query("V7_forget_by_similarity", f"""WITH {top('chunks', 15)}, d AS (SELECT query_id, document_id, round(avg(score), 9) AS score FROM top JOIN chunks USING (id) GROUP BY 1, 2),
b AS (SELECT document_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rn FROM d) WHERE rn = 1 AND score >= 0.85)
SELECT id FROM docs WHERE id NOT IN (SELECT document_id FROM b)""")
def _(t):
    return retrieval.forget_by_similarity(asked(t.chunks), t.chunks, t.docs).select("id")


@query("V8_memory_search_with_context", f"""WITH {top('memories', 10)}, h AS (SELECT * FROM top WHERE score >= 0.2), c AS (SELECT id, coalesce(root_memory_id, id) AS root, version FROM memories)
SELECT h.query_id, h.id, (SELECT string_agg((o.version - c.version) || '=' || o.id, ',' ORDER BY o.version - c.version, o.id) FROM c o WHERE o.root = c.root AND o.id <> c.id) AS related FROM h JOIN c ON c.id = h.id""")
def _(t):
    out = retrieval.search_with_context(asked(t.memories), t.memories, 0.2)
    return out.select("query_id", "id", F.array_join(F.transform("related", lambda r: F.concat_ws("=", r["distance"].cast("string"), r["id"])), ",").alias("related"))


@query("J12_memory_similarity_or_relevance", """SELECT l.document_id, l.memory_id, round(CASE WHEN CAST(l.memory_id AS INT) % 3 = 0 THEN greatest(0.0::DOUBLE, list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])))
  WHEN CAST(l.memory_id AS INT) % 3 = 1 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, l.relevance / 100.0::DOUBLE)) ELSE 0.5::DOUBLE END, 6) AS score FROM memory_docs l JOIN memories m ON l.memory_id = m.id JOIN memories d ON d.id = l.document_id""")
def _(t):
    k = F.col("memory_id").cast("int") % 3
    links = t.memory_docs.withColumn("relevance", F.when(k < 2, F.col("relevance")))
    some = t.memories.withColumn("embedding", F.when(F.col("id").cast("int") % 3 == 0, F.col("embedding")))
    return retrieval.similarity_or_relevance(links, some, t.memories)


@query("W15_chunks_with_context", """WITH w AS (SELECT id, lag(id) OVER (PARTITION BY document_id ORDER BY position, id) AS previous, lead(id) OVER (PARTITION BY document_id ORDER BY position, id) AS next FROM chunks) SELECT * FROM w""")
def _(t):
    return retrieval.chunks_with_context(t.chunks, t.chunks)


@query("M1_consolidate", """WITH RECURSIVE x AS (SELECT id, CAST(id AS INT) AS n, space_id, CAST(embedding AS DOUBLE[]) AS v FROM memories),
near AS (SELECT q.id, c.id AS target, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM x q JOIN x c ON q.space_id = c.space_id WHERE q.n % 2 = 0 AND c.n % 2 = 1),
m AS (SELECT id, target FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, target) AS place FROM near) WHERE place = 1 AND score >= 0.45),
r AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM x WHERE n % 2 = 0 AND id NOT IN (SELECT id FROM m)),
p AS (SELECT a.k, b.k AS j, b.id AS target, list_cosine_similarity(a.v, b.v) AS score FROM r a JOIN r b ON a.space_id = b.space_id AND b.k < a.k WHERE list_cosine_similarity(a.v, b.v) >= 0.45),
l AS (SELECT r.k, coalesce(list(p.j) FILTER (p.j IS NOT NULL), []) AS js FROM r LEFT JOIN p ON p.k = r.k GROUP BY r.k),
s AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS made UNION ALL SELECT l.k, CASE WHEN list_has_any(s.made, l.js) THEN s.made ELSE list_append(s.made, l.k) END FROM s JOIN l ON l.k = s.k + 1),
c AS (SELECT unnest(made) AS k FROM (SELECT made FROM s ORDER BY k DESC LIMIT 1))
SELECT id, 'reinforce' AS action, target FROM m UNION ALL SELECT id, 'create', NULL FROM r WHERE k IN (SELECT k FROM c)
UNION ALL SELECT r.id, 'reinforce', (SELECT p.target FROM p WHERE p.k = r.k AND p.j IN (SELECT k FROM c) ORDER BY p.score DESC, p.target DESC LIMIT 1) FROM r WHERE k NOT IN (SELECT k FROM c)""")
def _(t):
    rows = t.memories.withColumn("n", F.col("id").cast("int"))
    return retrieval.consolidate(rows.filter("n % 2 = 0"), rows.filter("n % 2 = 1"), least=0.45, order=("n",))
