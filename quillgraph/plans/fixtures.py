"""Fixture tables derived from the given tables, as SQL that Spark and DuckDB both run."""

VIEWS = {
    "issues": """
SELECT concat('bd-', CAST(o_orderkey AS STRING)) AS id,
  concat('Order ', CAST(o_orderkey % 500 AS STRING), ' for customer ', CAST(o_custkey % 50 AS STRING)) AS title,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('see bd-', CAST(o_custkey AS STRING), ' ## Acceptance Criteria') END AS description,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'P' THEN 'in_progress'
       WHEN o_orderkey % 17 = 0 THEN 'deferred' ELSE 'open' END AS status,
  CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS priority,
  CASE WHEN o_orderkey % 10 = 0 THEN 'epic' WHEN o_orderkey % 10 <= 3 THEN 'feature'
       WHEN o_orderkey % 10 <= 5 THEN 'bug' ELSE 'task' END AS issue_type,
  CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat('u', CAST(o_custkey % 40 AS STRING)) END AS assignee,
  o_orderdate AS created_at,
  o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 60 AS INT) AS updated_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 60 AS INT) END AS closed_at,
  CASE WHEN o_orderkey % 23 = 0 THEN TIMESTAMP '2001-09-01 00:00:00' END AS defer_until,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '90' DAY END AS due_at,
  o_orderkey % 29 = 0 AS pinned, o_orderkey % 31 = 0 AS ephemeral,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS compaction_level,
  concat('{"team":"t', CAST(o_custkey % 6 AS STRING), '","points":', CAST(o_orderkey % 13 AS STRING), '}') AS metadata
FROM orders
""",
    "deps": """
SELECT concat('bd-', CAST(src AS STRING)) AS issue_id, concat('bd-', CAST(dst AS STRING)) AS depends_on_id,
  min(type) AS type, min(metadata) AS metadata
FROM (SELECT l_orderkey AS src,
        CASE WHEN l_linenumber = 2 THEN t - t % 10 ELSE t END AS dst,
        CASE WHEN l_linenumber = 1 THEN 'blocks' WHEN l_linenumber = 2 THEN 'parent-child'
             WHEN l_linenumber = 3 THEN 'waits-for' WHEN l_linenumber = 4 THEN 'related'
             WHEN l_linenumber = 5 THEN 'conditional-blocks' WHEN l_linenumber = 6 THEN 'replies-to'
             ELSE 'discovered-from' END AS type,
        CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN '{"gate":"any-children"}' ELSE '' END AS metadata
      FROM (SELECT l_orderkey, l_linenumber, l_suppkey, (l_partkey * 7 + l_linenumber) % l_orderkey AS t
            FROM lineitem WHERE l_orderkey > 0) a) b
GROUP BY src, dst
""",
    "issue_labels": """
SELECT DISTINCT concat('bd-', CAST(l_orderkey AS STRING)) AS issue_id,
  CASE WHEN l_linenumber <= 3 THEN concat('area-', l_returnflag) ELSE concat('state:', l_linestatus) END AS label
FROM lineitem
""",
    "memories": """
SELECT CAST(vec_id AS STRING) AS id, concat('org', CAST(label % 2 AS STRING)) AS org_id,
  concat('space', CAST(label AS STRING)) AS space_id, concat('memory ', CAST(vec_id % 400 AS STRING)) AS memory,
  CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(vec_id % 100 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN vec_id % 7 = 0 THEN 'core' WHEN vec_id % 7 = 1 THEN 'profile' WHEN vec_id % 7 = 2 THEN 'preference'
       WHEN vec_id % 7 = 3 THEN 'episodic' ELSE 'fact' END AS memory_level,
  CAST(1 + vec_id % 6 AS INT) AS source_count, vec_id % 9 = 0 AS is_static, vec_id % 13 = 0 AS is_forgotten,
  vec_id % 10 >= 4 AS is_latest,
  CASE WHEN vec_id % 10 BETWEEN 1 AND 4 THEN CAST(vec_id - 1 AS STRING) END AS parent_memory_id,
  CASE WHEN vec_id % 10 BETWEEN 1 AND 4 THEN CAST(vec_id - vec_id % 10 AS STRING) END AS root_memory_id,
  CAST(CASE WHEN vec_id % 10 < 5 THEN 1 + vec_id % 10 ELSE 1 END AS INT) AS version,
  CASE WHEN vec_id % 8 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS forget_after,
  TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' DAY * CAST(vec_id % 200 AS INT) AS updated_at, embedding
FROM embeddings
""",
    "memory_hits": """
SELECT CAST(user_id AS STRING) AS memory_id, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
  concat('doc', CAST(event_id % 300 AS STRING)) AS document_id, ts, event_id
FROM events
""",
    "mentions": """
SELECT concat('Part ', CAST(l_partkey % 300 AS STRING)) AS source, concat('Supplier ', CAST(l_suppkey AS STRING)) AS target,
  'supplied_by' AS relation, concat('org', CAST(l_suppkey % 2 AS STRING)) AS org_id,
  CAST(l_quantity AS DOUBLE) / 100 AS confidence, l_shipdate AS ts, l_orderkey, l_linenumber
FROM lineitem
""",
    "api_requests": """
SELECT event_id AS id, event_type AS type, concat('key', CAST(user_id % 10 AS STRING)) AS key_id,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 0 THEN 429 ELSE 200 END AS status_code,
  value AS duration, CAST(event_id % 900 AS INT) AS original_tokens, CAST(event_id % 300 AS INT) AS final_tokens, ts AS created_at
FROM events
""",
    "tool_calls": """
SELECT user_id AS thread_id, event_id, ts, md5(concat(event_type, CAST(event_id % 3 AS STRING))) AS call_hash
FROM events
""",
    "chunks": """
SELECT CAST(vec_id AS STRING) AS id, CAST(vec_id % 97 AS STRING) AS document_id, CAST(vec_id AS INT) AS position,
  concat('org', CAST(vec_id % 97 % 2 AS STRING)) AS org_id, embedding FROM embeddings
""",
    "messages": """
SELECT conv_id AS thread_id, turn, role,
  CASE WHEN role = 'user' AND (conv_id + turn) % 11 = 0 THEN '<uploaded_files>a.csv</uploaded_files>'
       WHEN role = 'user' AND (conv_id + turn) % 7 = 0 THEN concat('<uploaded_files>b.csv</uploaded_files> ', text)
       WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN concat(text, ' That is wrong, try again.')
       ELSE text END AS content
FROM conversations
""",
    "doc_spaces": """
SELECT doc_id AS document_id, source AS space_id, concat('sm_project_', source) AS container_tag FROM documents
""",
    "comments": """
SELECT concat('c', CAST(event_id AS STRING)) AS id, concat('bd-', CAST(user_id AS STRING)) AS issue_id, event_type AS text, ts AS created_at
FROM events
""",
    "issue_events": """
SELECT event_id AS id, concat('bd-', CAST(user_id AS STRING)) AS issue_id,
  CASE WHEN event_id % 4 = 0 THEN 'label_added' ELSE 'status_changed' END AS event_type,
  CASE WHEN event_id % 4 = 0 THEN concat('state:', event_type) WHEN event_id % 4 = 1 THEN 'in_progress' WHEN event_id % 4 = 2 THEN 'closed' ELSE 'open' END AS new_value,
  event_id % 5 = 0 AS ephemeral, ts AS created_at
FROM events
""",
    "issue_log": """
SELECT event_id AS id, concat('bd-', CAST(user_id AS STRING)) AS issue_id,
  CASE WHEN event_id % 4 <> 0 THEN 'status_changed' WHEN event_id % 20 = 8 THEN 'label_removed' ELSE 'label_added' END AS event_type,
  CASE WHEN event_id % 4 = 1 THEN 'in_progress' WHEN event_id % 4 = 2 THEN 'closed' WHEN event_id % 4 = 3 THEN 'open'
       WHEN event_id % 12 = 0 THEN concat('state:', event_type) WHEN event_id % 12 = 4 THEN concat('mode:', event_type) ELSE event_type END AS new_value, ts AS created_at
FROM events
""",
    "history": """
SELECT concat('bd-', CAST(l_orderkey AS STRING)) AS id, l_shipdate AS commit_date, l_linenumber AS seq,
  concat('Title ', CAST(l_partkey % 3 AS STRING)) AS title, l_linestatus AS status, CAST(l_quantity % 5 AS INT) AS priority, l_returnflag AS description
FROM lineitem
""",
    "commits": """
SELECT md5(CAST(event_id AS STRING)) AS hash, concat('fix (bd-', CAST(user_id * 3 AS STRING), ') and more') AS message, ts AS committed_at
FROM events
""",
    "external_issues": """
SELECT concat('EXT-', CAST(o_orderkey AS STRING)) AS external_ref, concat(CASE WHEN o_orderkey % 4 = 1 THEN 'new-' ELSE 'bd-' END, CAST(o_orderkey AS STRING)) AS id,
  concat('Order ', CAST(o_orderkey % 500 AS STRING), ' for customer ', CAST((o_custkey + o_orderkey % 2) % 50 AS STRING)) AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE 'open' END AS status, CAST(o_orderkey % 5 AS INT) AS priority,
  o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 70 AS INT) AS updated_at
FROM orders
""",
    "docs": """
SELECT CAST(doc_id AS STRING) AS id, concat('org', CAST(doc_id % 2 AS STRING)) AS org_id, concat('custom-', CAST(doc_id % 500 AS STRING)) AS custom_id,
  concat('Document ', CAST(doc_id AS STRING)) AS title, source AS space_id, concat('sm_project_', source) AS container_tag,
  CASE WHEN doc_id % 6 = 0 THEN 'queued' WHEN doc_id % 6 = 1 THEN 'embedding' WHEN doc_id % 6 = 2 THEN 'failed' ELSE 'done' END AS status,
  concat('{"team":"t', CAST(doc_id % 4 AS STRING), '","pages":', CAST(doc_id % 30 AS STRING), ',"tags":["', lang, '","x"]}') AS metadata,
  TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' DAY * CAST(doc_id % 100 AS INT) AS created_at, n_chars
FROM documents
""",
    "memory_docs": """
SELECT CAST(vec_id AS STRING) AS memory_id, CAST(vec_id % 97 AS STRING) AS document_id, CAST(vec_id * 7 % 140 AS INT) - 20 AS relevance
FROM embeddings
""",
    "facts": """
SELECT concat('u', CAST(user_id % 20 AS STRING)) AS owner, event_id AS fact_id, concat(event_type, ' fact ', CAST(event_id % 200 AS STRING)) AS content,
  CASE WHEN event_id % 3 = 0 THEN 'preference' ELSE 'knowledge' END AS category, CAST(event_id * 37 % 100 AS DOUBLE) / 100 AS confidence
FROM events
""",
    "bench_runs": """
SELECT concat('config', CAST(l_linenumber % 2 + 1 AS STRING)) AS config, l_orderkey AS eval_id, l_linenumber AS run_number,
  l_discount AS pass_rate, l_quantity AS time_seconds, l_extendedprice AS tokens
FROM lineitem
""",
    "trigger_runs": """
SELECT concat('query ', CAST(user_id AS STRING)) AS query, user_id % 2 = 0 AS should_trigger, event_id % 3 <> 0 AS triggered FROM events
""",
    "qa_runs": """
SELECT concat('run', CAST(user_id % 3 AS STRING)) AS run, event_type AS provider, concat('type', CAST(event_id % 4 AS STRING)) AS question_type,
  event_id % 5 <> 0 AS correct, value AS latency, event_id % 1000 AS context_tokens FROM events
""",
    "text_lines": """
SELECT concat('src/', source, '/', CASE WHEN doc_id % 5 = 0 THEN 'target/' WHEN doc_id % 7 = 0 THEN 'a.egg-info/' ELSE 'lib/' END, CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN '.py' WHEN doc_id % 3 = 1 THEN '.md' WHEN doc_id % 11 = 0 THEN '.js.bak' ELSE '.js' END) AS path, text FROM documents
""",
}

#: Forms for Spark of views above, with the same rows: numbers are grouped, as a least text is found by sorting all rows twice; texts are made of what is left.
SPARK = {
    "deps": """
SELECT concat('bd-', CAST(src AS STRING)) AS issue_id, concat('bd-', CAST(dst AS STRING)) AS depends_on_id,
  element_at(array('blocks', 'conditional-blocks', 'discovered-from', 'parent-child', 'related', 'replies-to', 'waits-for'), place) AS type,
  CASE WHEN gated = 1 THEN '{"gate":"any-children"}' ELSE '' END AS metadata
FROM (SELECT src, dst, min(place) AS place, min(gated) AS gated
      FROM (SELECT l_orderkey AS src, CASE WHEN l_linenumber = 2 THEN t - t % 10 ELSE t END AS dst,
              CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber = 2 THEN 4 WHEN l_linenumber = 3 THEN 7 WHEN l_linenumber = 4 THEN 5
                   WHEN l_linenumber = 5 THEN 2 WHEN l_linenumber = 6 THEN 6 ELSE 3 END AS place,
              CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS gated
            FROM (SELECT l_orderkey, l_linenumber, l_suppkey, (l_partkey * 7 + l_linenumber) % l_orderkey AS t
                  FROM lineitem WHERE l_orderkey > 0) a) b
      GROUP BY src, dst) c
""",
    "issue_labels": """
SELECT concat('bd-', CAST(src AS STRING)) AS issue_id, CASE WHEN first THEN concat('area-', flag) ELSE concat('state:', flag) END AS label
FROM (SELECT DISTINCT l_orderkey AS src, coalesce(l_linenumber <= 3, false) AS first, CASE WHEN l_linenumber <= 3 THEN l_returnflag ELSE l_linestatus END AS flag
      FROM lineitem) a
""",
}
