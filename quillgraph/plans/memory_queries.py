"""Queries over the memory table, documents and spaces."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions.filters import metadata_filter
from ..operators import graph, memory
from .registry import query

NOW = dt.datetime(2024, 1, 31)
N = "TIMESTAMP '2024-01-31 00:00:00'"


def r6(c):
    return F.round(c, 11).alias(c)


def joined(c):
    return F.array_join(c, ",").alias(c)


@query("F1_list_memories", "SELECT id, memory, confidence FROM memories WHERE org_id = 'org1' AND is_latest AND NOT is_forgotten ORDER BY confidence DESC NULLS LAST, updated_at DESC, id LIMIT 50 OFFSET 10")
def _(t):
    return memory.list_memories(t.memories, "org1", offset=10).select("id", "memory", "confidence")


@query("F2_list_documents", """WITH f AS (SELECT * FROM docs WHERE org_id = 'org0' AND container_tag IN ('sm_project_src0', 'sm_project_src2'))
SELECT id, title, container_tag AS tags, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""")
def _(t):
    links = t.doc_spaces.withColumn("document_id", F.col("document_id").cast("string"))
    return memory.list_documents(t.docs, links, "org0", tags=["sm_project_src0", "sm_project_src2"], page=2, limit=20).select("id", "title", joined("tags"), "total")


@query("F3_documents_with_memories", """WITH f AS (SELECT * FROM docs WHERE org_id = 'org0' ORDER BY created_at DESC, id LIMIT 50)
SELECT f.id, string_agg(m.memory_id || '=' || m.relevance, ',' ORDER BY m.memory_id) AS memories FROM f LEFT JOIN memory_docs m ON m.document_id = f.id GROUP BY f.id""")
def _(t):
    links = t.doc_spaces.withColumn("document_id", F.col("document_id").cast("string"))
    rows = memory.documents_with_memories(t.docs, links, t.memory_docs, t.memories, "org0", tags=["no such tag"], limit=50)
    texts = F.transform("memories", lambda m: F.concat(m["memory_id"], F.lit("="), m["relevance"].cast("string")))
    return rows.select("id", F.array_join(texts, ",").alias("memories"))


@query("F4_documents_by_ids", "SELECT id, title FROM docs WHERE org_id = 'org0' AND custom_id IN (SELECT concat('custom-', CAST(n_nationkey * 4 AS VARCHAR)) FROM nation)")
def _(t):
    wanted = t.nation.select(F.concat(F.lit("custom-"), (F.col("n_nationkey") * 4).cast("string")).alias("id"))
    return memory.documents_by_ids(t.docs, "org0", wanted, by="custom_id").select("id", "title")


@query("F5_metadata_filter", """SELECT id FROM docs WHERE (json_extract_string(metadata, '$.team') = 't1' OR CAST(json_extract_string(metadata, '$.pages') AS DOUBLE) >= 20) AND list_contains(CAST(json_extract(metadata, '$.tags') AS VARCHAR[]), 'en')
AND NOT contains(lower(json_extract_string(metadata, '$.team')), 't3')""")
def _(t):
    tree = {"AND": [
        {"OR": [{"key": "team", "value": "t1"}, {"key": "pages", "value": 20, "filterType": "numeric", "numericOperator": ">="}]},
        {"key": "tags", "value": "en", "filterType": "array_contains"}, {"key": "team", "value": "T3", "filterType": "string_contains", "ignoreCase": True, "negate": True},
    ]}
    return t.docs.filter(metadata_filter(tree)).select("id")


@query("F6_container_tag_match", "SELECT id FROM docs WHERE container_tag IN ('sm_project_src1', 'sm_project_src3')")
def _(t):
    links = t.doc_spaces.withColumn("document_id", F.col("document_id").cast("string"))
    return memory.tag_match(t.docs, links, ["sm_project_src1", "sm_project_src3"]).select("id")


@query("J1_memory_detail", """WITH a AS (SELECT id AS asked, coalesce(root_memory_id, id) AS root FROM memories WHERE version = 3)
SELECT asked, m.id, m.version, d.document_id AS documents FROM a JOIN memories m ON coalesce(m.root_memory_id, m.id) = a.root LEFT JOIN memory_docs d ON d.memory_id = m.id""")
def _(t):
    return memory.memory_detail(t.memories, t.memories.filter("version = 3"), t.memory_docs).select("asked", "id", "version", joined("documents"))


@query("J3_space_document_counts", "SELECT space_id, count(*) AS documents FROM doc_spaces GROUP BY 1")
def _(t):
    spaces = t.doc_spaces.select("space_id", "container_tag").distinct()
    return memory.space_document_counts(spaces, t.doc_spaces).select("space_id", "documents")


@query("A1_memory_stats", """SELECT org_id, coalesce(memory_level, 'unknown') AS level, count(*) AS n, CAST(sum(count(*)) OVER w AS BIGINT) AS total,
  round(sum(sum(confidence)) OVER w / CAST(sum(count(confidence)) OVER w AS BIGINT), 3) AS avg_confidence, CAST(sum(count(*) FILTER (is_forgotten)) OVER w AS BIGINT) AS forgotten FROM memories GROUP BY org_id, memory_level WINDOW w AS (PARTITION BY org_id)""")
def _(t):
    return memory.memory_stats(t.memories)


PROFILE = """SELECT org_id, '{part}' AS part, id, row_number() OVER (PARTITION BY org_id ORDER BY {order}, id) AS rank FROM memories WHERE is_latest AND NOT is_forgotten AND {test}"""


@query("W1_profile_static", f"SELECT * FROM ({PROFILE.format(part='static', order='updated_at DESC', test='is_static')}) WHERE rank <= 50")
def _(t):
    return memory.profile(t.memories, NOW).filter("part = 'static'")


@query("W2_profile_dynamic", f"SELECT * FROM ({PROFILE.format(part='dynamic', order='confidence DESC NULLS LAST, updated_at DESC', test=f'NOT is_static AND updated_at >= {N} - INTERVAL 30 DAY')}) WHERE rank <= 50")
def _(t):
    return memory.profile(t.memories, NOW).filter("part = 'dynamic'")


@query("W3_latest_version", "SELECT id, version FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(root_memory_id, id) ORDER BY version DESC, updated_at DESC, id) AS rn FROM memories) WHERE rn = 1")
def _(t):
    return memory.latest_version(t.memories).select("id", "version")


@query("U3_dedupe_memories", """WITH a AS (SELECT 0 AS rank, 'static' AS list, CAST(id AS INT) AS pos, trim(memory) AS memory FROM memories WHERE is_static UNION ALL SELECT 1, 'dynamic', CAST(id AS INT), trim(memory) FROM memories WHERE NOT is_static AND is_latest
  UNION ALL SELECT 2, 'search', CAST(id AS INT), trim(memory) FROM memories), w AS (SELECT *, row_number() OVER (PARTITION BY memory ORDER BY rank, pos) AS n FROM a) SELECT list, pos, memory FROM w WHERE n = 1 OR rank = 0""")
def _(t):
    rows = t.memories.withColumn("pos", F.col("id").cast("int"))
    return memory.dedupe_memories(rows.filter("is_static"), rows.filter("NOT is_static AND is_latest"), rows)


FOLD = """WITH RECURSIVE h AS (SELECT memory_id, confidence AS v, row_number() OVER (PARTITION BY memory_id ORDER BY ts, event_id) AS k FROM memory_hits),
r AS (SELECT id, coalesce(confidence, 1.0::DOUBLE) AS c, source_count AS s, memory_level AS level, 0::BIGINT AS k FROM memories
  UNION ALL SELECT r.id, least(1.0::DOUBLE, 0.7::DOUBLE * r.c + 0.3::DOUBLE * h.v + 0.1::DOUBLE), r.s + 1,
    CASE WHEN level IN ('fact', 'preference') AND r.s + 1 >= 5 AND least(1.0::DOUBLE, 0.7::DOUBLE * r.c + 0.3::DOUBLE * h.v + 0.1::DOUBLE) >= 0.8 THEN 'core'
      WHEN level = 'fact' AND r.s + 1 >= 3 AND least(1.0::DOUBLE, 0.7::DOUBLE * r.c + 0.3::DOUBLE * h.v + 0.1::DOUBLE) >= 0.6 THEN 'preference' ELSE level END, h.k FROM r JOIN h ON h.memory_id = r.id AND h.k = r.k + 1),
f AS (SELECT id, arg_max(c, k) AS c, arg_max(s, k) AS s, arg_max(level, k) AS level, max(k) AS k FROM r GROUP BY id)
"""


@query("M2_reinforce", FOLD + "SELECT f.id, CASE WHEN k > 0 THEN round(c, 11) ELSE round(m.confidence, 11) END AS confidence, f.s AS source_count, m.is_forgotten AND k = 0 AS is_forgotten FROM f JOIN memories m USING (id)")
def _(t):
    return memory.reinforce(t.memories, t.memory_hits).select("id", r6("confidence"), "source_count", "is_forgotten")


@query("M2_hit_links", "SELECT memory_id, document_id, CAST(round(arg_min(confidence, (ts, event_id)) * 100) AS INT) AS relevance FROM memory_hits GROUP BY 1, 2")
def _(t):
    return memory.hit_links(t.memory_hits)


@query("M3_promote_level", FOLD + "SELECT id, level AS memory_level FROM f")
def _(t):
    return memory.reinforce(t.memories, t.memory_hits).select("id", "memory_level")


DECAY = f"""d AS (SELECT *, coalesce(confidence, 1.0::DOUBLE) AS c0, (epoch({N}) - epoch(updated_at)) / 86400.0::DOUBLE AS days,
  CASE memory_level WHEN 'profile' THEN 0.25::DOUBLE WHEN 'preference' THEN 0.5::DOUBLE WHEN 'episodic' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS k FROM memories),
e AS (SELECT *, greatest(0.0::DOUBLE, c0 * (1 - 0.005::DOUBLE * k * days)) AS c1, is_latest AND NOT is_forgotten AND NOT is_static AND memory_level <> 'core' AND days >= 1 AS due FROM d),
g AS (SELECT *, due AND c1 < 0.15 AS gone, due AND (c1 < 0.15 OR abs(c1 - c0) > 0.001) AS written FROM e),
m AS (SELECT id, round(CASE WHEN written THEN c1 ELSE confidence END, 11) AS confidence, is_forgotten OR gone AS f1, CASE WHEN written THEN {N} ELSE updated_at END AS updated_at, gone, written, forget_after FROM g)"""


@query("M4_temporal_decay", f"WITH {DECAY} SELECT id, confidence, f1 AS is_forgotten, updated_at FROM m")
def _(t):
    return memory.temporal_decay(t.memories, NOW).select("id", r6("confidence"), "is_forgotten", "updated_at")


@query("M5_forget_expired", f"SELECT id, is_forgotten OR coalesce(forget_after < {N}, false) AS is_forgotten FROM memories")
def _(t):
    return memory.forget_expired(t.memories, NOW).select("id", "is_forgotten")


@query("M6_maintenance", f"WITH {DECAY} SELECT count(*) FILTER (written AND NOT gone AND NOT (NOT f1 AND coalesce(forget_after < {N}, false))) + count(*) FILTER (written AND NOT gone AND NOT f1 AND coalesce(forget_after < {N}, false)) AS decayed, count(*) FILTER (gone) AS forgotten, count(*) FILTER (NOT f1 AND coalesce(forget_after < {N}, false)) AS expired FROM m")
def _(t):
    return memory.maintenance_counts(memory.maintenance(t.memories, NOW))


EDITED = """WITH e AS (SELECT id, version, parent_memory_id, root_memory_id, is_latest AND CAST(id AS INT) % 25 <> 0 AS is_latest, CASE WHEN version = 3 THEN parent_memory_id || '=extends' ELSE '' END AS relations, '' AS reason FROM memories
UNION ALL SELECT concat('new-', id), version + 1, id, coalesce(root_memory_id, id), true, CASE WHEN version = 3 THEN id || '=updates,' || parent_memory_id || '=extends' ELSE id || '=updates' END, 'because of ' || id FROM memories WHERE CAST(id AS INT) % 25 = 0)"""


def edited(t):
    edits = t.memories.filter("CAST(id AS INT) % 25 = 0").select("id", F.concat(F.lit("new-"), "id").alias("new_id"), F.lit("edited").alias("memory"), F.concat(F.lit("because of "), "id").alias("reason"))
    return memory.new_version(t.memories.withColumn("memory_relations", F.when(F.col("version") == 3, F.create_map("parent_memory_id", F.lit("extends")))), edits)


@query("M7_new_version", f"{EDITED} SELECT * FROM e")
def _(t):
    said = F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries("memory_relations"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","), F.lit(""))
    return edited(t).select("id", "version", "parent_memory_id", "root_memory_id", "is_latest", said.alias("relations"), F.coalesce(F.col("metadata")["versionReason"], F.lit("")).alias("reason"))


@query("G20_edges_of_edits", f"{EDITED} SELECT parent_memory_id AS source, id AS target, 'updates' AS relation FROM e WHERE reason <> ''")
def _(t):
    edges = graph.memory_edges(edited(t), t.memory_docs)
    return edges.filter(F.col("target").startswith("new-") & (F.col("relation") == "updates"))


@query("M8_forget_pin_patch", """SELECT id, is_forgotten OR CAST(id AS INT) % 4 = 0 AS is_forgotten, is_static OR CAST(id AS INT) % 4 = 1 AS is_static, CASE WHEN CAST(id AS INT) % 4 = 2 THEN 'core' ELSE memory_level END AS memory_level,
  CASE WHEN CAST(id AS INT) % 4 = 2 THEN 1.0::DOUBLE ELSE confidence END AS confidence FROM memories""")
def _(t):
    k = F.col("id").cast("int") % 4
    commands = t.memories.filter(k < 3).select("id", F.when(k == 0, "forget").when(k == 1, "pin").otherwise("patch").alias("command"), F.lit("core").alias("level"), F.lit(1.7).alias("confidence"))
    return memory.apply_commands(t.memories, commands).select("id", "is_forgotten", "is_static", "memory_level", "confidence")


@query("M9_extract_memories", r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, concat('Document ', doc_id) AS title, text FROM documents WHERE length(trim(text, ' ')) >= 50),
p AS (SELECT id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: trim(s, ' ')), lambda s: s <> '')[1:50] AS parts FROM d),
s AS (SELECT id, unnest(parts) AS memory, generate_subscripts(parts, 1) - 1 AS pos FROM p),
k AS (SELECT id, pos, memory, regexp_matches(memory, '[a-zà-ÿ,;] [A-ZÀ-Þ][\w''-]') AS entity FROM s WHERE length(memory) BETWEEN 20 AND 500),
u AS (SELECT id, min(pos) AS pos, memory, max(CASE WHEN entity THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END) AS confidence FROM k
  WHERE entity OR regexp_matches(memory, '[0-9]') OR regexp_matches(memory, '(?i)(^|[^\p{L}\p{N}_])(is|are|was|were|means|refers to|defined as)($|[^\p{L}\p{N}_])') GROUP BY id, memory),
a AS (SELECT id, -1 AS pos, title AS memory, 0.9::DOUBLE AS confidence FROM d UNION ALL SELECT id, pos, memory, confidence FROM u)
SELECT id, CAST(pos AS INT) AS pos, memory, confidence FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 10""")
def _(t):
    docs = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.lit("").alias("url"), "text")
    return memory.extract_memories(docs)


@query("M10_extract_entities", r"""WITH g AS (SELECT n_name AS word, 'location' AS type FROM nation UNION ALL SELECT * FROM (VALUES ('The', 'organization'), ('En', 'person'), ('La', 'person'), ('Der', 'location'), ('The', 'person'), ('Los', 'organization')) v(word, type)),
w AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(text, '[\p{L}][\p{L}''-]+')) AS word, generate_subscripts(regexp_extract_all(text, '[\p{L}][\p{L}''-]+'), 1) AS pos FROM documents WHERE length(trim(text)) >= 30),
f AS (SELECT id, type, w.word AS name, min(pos) AS pos FROM w JOIN g USING (word) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY pos) AS n FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY id, lower(name) ORDER BY CASE type WHEN 'person' THEN 0 WHEN 'location' THEN 1 ELSE 2 END, pos) AS k FROM r WHERE n <= 10)
SELECT id, name, type, CASE WHEN type = 'person' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM b WHERE k = 1""")
def _(t):
    words = [("The", "organization"), ("En", "person"), ("La", "person"), ("Der", "location"), ("The", "person"), ("Los", "organization")]
    gazetteer = t.nation.select(F.col("n_name").alias("word"), F.lit("location").alias("type")).union(t.spark.createDataFrame(words, "word string, type string"))
    return memory.extract_entities(t.documents.select(F.col("doc_id").cast("string").alias("id"), "text"), gazetteer)


CLEAN = """WITH x AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, concat('Part ', CAST(l_partkey % 5 AS VARCHAR)) AS source, concat('Part ', CAST(l_suppkey % 5 AS VARCHAR)) AS target, l_tax * 30 - 1 AS c FROM lineitem),
r AS (SELECT * FROM x WHERE pos <= 3 AND source <> target) SELECT r.id, r.source, r.target, 'ships_with_' AS relation, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)), 6) AS confidence FROM r WHERE EXISTS (SELECT 1 FROM x WHERE x.id = r.id AND x.pos <= 3 AND x.source = r.target)"""


@query("M11_clean_extractions", CLEAN)
def _(t):
    return extractions(t.lineitem)[1]


@query("M11_clean_extractions_all", CLEAN)
def _(t):
    return extractions(t.lineitem)[1]


@query("M11_clean_entities", """SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, concat('Part ', CAST(l_partkey % 5 AS VARCHAR)) AS name,
CASE WHEN l_linenumber % 2 = 0 THEN 'tool' ELSE 'concept' END AS type, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_tax * 30 - 1)), 6) AS confidence FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= 3""")
def _(t):
    return extractions(t.lineitem)[0]


def extractions(lineitem):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part = lambda c: F.concat(F.lit(" part   "), (F.col(c) % 5).cast("string"))
    x = lineitem.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "TOOL").otherwise("Thing").alias("type"), F.row_number().over(w).alias("pos"), part("l_partkey").alias("source"), part("l_suppkey").alias("target"), (F.col("l_tax") * 30 - 1).alias("confidence"))
    ents = x.select("id", "pos", F.col("source").alias("name"), "type", "confidence")
    rels = x.select("id", "pos", "source", "target", F.lit(" Ships with !").alias("relation"), "confidence")
    return tuple(df.withColumn("confidence", F.round("confidence", 6)) for df in memory.clean_extractions(ents, rels, limit=3))


@query("M12_strip_upload_mentions", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Likes ' || event_type || '.' ELSE 'Likes ' || event_type || '.Done.' END AS summary FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Likes "), "event_type", F.lit(". User uploaded two files today."))).otherwise(F.concat(F.lit("Likes "), "event_type", F.lit(". A file upload was made! Done.")))
    return t.events.select("event_id", memory.strip_upload_mentions(text).alias("summary"))


@query("M13_space_move", """SELECT document_id, space_id, container_tag FROM doc_spaces UNION SELECT document_id, 'src2', 'sm_project_src2' FROM doc_spaces WHERE space_id = 'src1'""")
def _(t):
    return memory.space_move(t.doc_spaces, "src1", "src2", "sm_project_src2")


@query("M13_space_delete", "SELECT id FROM docs WHERE space_id <> 'src1'")
def _(t):
    return memory.space_delete(t.docs, t.doc_spaces.withColumn("document_id", F.col("document_id").cast("string")), "src1").select("id")


def without_space(t):
    links = t.doc_spaces.withColumn("document_id", F.col("document_id").cast("string"))
    moved = memory.space_move(links, "src1", "src2", "sm_project_src2")
    return memory.delete_space(t.docs, t.memories.withColumn("space_id", F.concat(F.lit("src"), F.substring("space_id", 6, 9))), moved, "src2")


@query("M13_deleted_space_documents", "SELECT id FROM docs WHERE space_id NOT IN ('src1', 'src2')")
def _(t):
    return without_space(t)[0].select("id")


@query("M13_deleted_space_memories", "SELECT id, 'src' || substring(space_id, 6) AS space_id FROM memories WHERE space_id <> 'space2'")
def _(t):
    return without_space(t)[1].select("id", "space_id")


@query("M13_deleted_space_links", "SELECT CAST(document_id AS VARCHAR) AS document_id, space_id, container_tag FROM doc_spaces WHERE space_id NOT IN ('src1', 'src2')")
def _(t):
    return without_space(t)[2]


@query("M14_bulk_delete", "SELECT id FROM docs WHERE container_tag NOT IN ('sm_project_src0', 'sm_project_src4')")
def _(t):
    return memory.bulk_delete(t.docs, t.doc_spaces.withColumn("document_id", F.col("document_id").cast("string")), tags=["sm_project_src0", "sm_project_src4"]).select("id")


@query("A28_processing_status", "SELECT status, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM docs WHERE status NOT IN ('done', 'failed') GROUP BY 1")
def _(t):
    waiting = t.docs.filter("status NOT IN ('done', 'failed')").groupBy("status").agg(F.count("*").alias("n"))
    return waiting.join(F.broadcast(waiting.agg(F.sum("n").alias("total"))), F.lit(True))
