"""Queries over conversations, texts, pages and facts."""

from pyspark.sql import functions as F

from ..operators import conversation as conv
from ..operators import text
from .registry import query

FILTERED = r"""f0 AS (SELECT thread_id, turn, role, CASE WHEN role = 'user' THEN regexp_replace(regexp_replace(content, '<uploaded_files>[\s\S]*?</uploaded_files>\n*', '', 'gi'), '^\s+|\s+$', '', 'g') ELSE content END AS content, role = 'user' AND contains(content, '<uploaded_files>') AS up FROM messages WHERE role IN ('user', 'assistant')),
f1 AS (SELECT *, up AND content = '' AS blank FROM f0), f2 AS (SELECT *, lag(blank) OVER (PARTITION BY thread_id ORDER BY turn) AS after_blank FROM f1),
f AS (SELECT thread_id, turn, role, content FROM f2 WHERE NOT blank AND NOT (role = 'assistant' AND coalesce(after_blank, false)))"""


@query("T3_filter_conversation", f"WITH {FILTERED} SELECT * FROM f")
def _(t):
    return conv.filter_conversation(t.messages)


LAST = "r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC) AS n FROM f)"


@query("W11_recent_turns", f"WITH {FILTERED}, {LAST} SELECT thread_id, turn FROM r WHERE n <= 3")
def _(t):
    return conv.recent_turns(conv.filter_conversation(t.messages), 3).select("thread_id", "turn")


@query("T4_detect_correction", rf"""WITH {FILTERED}, {LAST} SELECT thread_id, bool_or(role = 'user' AND regexp_matches(content, '(?i)\bthat(''s| is) (wrong|incorrect)\b|\byou misunderstood\b|\btry again\b|\bredo\b|不对|你理解错了|你理解有误|重试|重新来|换一种|改用')) AS corrected FROM r WHERE n <= 6 GROUP BY 1""")
def _(t):
    return conv.detect_correction(t.messages)


@query("T5_conversation_transcript", """SELECT thread_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(content) > 1000 THEN substring(content, 1, 1000) || '...' ELSE content END, chr(10) || chr(10) ORDER BY turn) AS transcript FROM messages WHERE role IN ('user', 'assistant') GROUP BY 1""")
def _(t):
    return conv.transcript(t.messages)


SUMMARY = r"""s AS (SELECT *, count(*) OVER (PARTITION BY thread_id) AS n, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS k FROM messages),
l AS (SELECT thread_id, any_value(n - 4) AS message_count, array_to_string(list(substring(trim(string_split_regex(content, '[.!?\n]')[1]), 1, 200) ORDER BY k) FILTER (role = 'user' AND k <= n - 4 AND trim(string_split_regex(content, '[.!?\n]')[1]) <> '')[1:10], '; ') AS summary FROM s WHERE n > 4 GROUP BY 1)"""


def summaries(t):
    none = t.spark.createDataFrame([], "thread_id bigint, message_count bigint")
    return conv.summarize(t.messages, none, threshold=4)


@query("T6_summarize_threads", f"WITH {SUMMARY} SELECT thread_id, message_count, coalesce(summary, '') AS summary FROM l")
def _(t):
    return summaries(t)


@query("T7_conversation_context", f"WITH {SUMMARY} SELECT s.thread_id, any_value(coalesce(l.summary, CASE WHEN l.thread_id IS NOT NULL THEN '' END)) AS summary, string_agg(CASE WHEN s.k > coalesce(l.message_count, 0) THEN s.content END, '|' ORDER BY s.k) AS recent FROM s LEFT JOIN l USING (thread_id) GROUP BY 1")
def _(t):
    return conv.conversation_context(t.messages, summaries(t)).withColumn("recent", F.array_join("recent", "|"))


@query("W10_loop_windows", """WITH w AS (SELECT *, list(call_hash) OVER (PARTITION BY thread_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM tool_calls),
n AS (SELECT thread_id, event_id, CAST(len(list_filter(l, lambda h: h = call_hash)) AS INT) AS n FROM w) SELECT *, CASE WHEN n >= 5 THEN 'stop' WHEN n >= 3 THEN 'warn' ELSE 'ok' END AS verdict FROM n""")
def _(t):
    return conv.loop_windows(t.tool_calls)


THREADS = "th AS (SELECT thread_id, concat('org', CAST(thread_id % 2 AS VARCHAR)) AS org_id, CASE WHEN thread_id % 3 > 0 THEN concat('p', CAST(thread_id % 3 AS VARCHAR)) END AS project, CASE WHEN thread_id % 4 = 0 THEN 'busy' ELSE 'idle' END AS status, max(turn) AS updated_at FROM messages GROUP BY thread_id)"


def threads(t):
    k = F.col("thread_id")
    rows = t.messages.groupBy("thread_id").agg(F.max("turn").alias("updated_at"))
    return rows.select(
        k, F.concat(F.lit("org"), (k % 2).cast("string")).alias("org_id"), F.when(k % 3 > 0, F.concat(F.lit("p"), (k % 3).cast("string"))).alias("project"),
        F.when(k % 4 == 0, "busy").otherwise("idle").alias("status"), F.concat(F.lit('{"team":"t'), (k % 5).cast("string"), F.lit('"}')).alias("metadata"), "updated_at",
    )


@query("F13_search_threads", f"WITH {THREADS} SELECT thread_id, updated_at FROM th WHERE thread_id % 5 = 2 AND status = 'idle' ORDER BY updated_at DESC, thread_id LIMIT 10 OFFSET 2")
def _(t):
    return conv.search_threads(threads(t), {"team": "t2"}, "idle", 10, 2).select("thread_id", "updated_at")


@query("F17_list_threads", f"WITH {THREADS}, n AS (SELECT * FROM th WHERE org_id = 'org1' ORDER BY updated_at DESC, thread_id LIMIT 50) SELECT thread_id, project FROM n WHERE project IS NULL OR project = 'p1'")
def _(t):
    return conv.list_threads(t.messages, threads(t), "org1", "p1").select("thread_id", "project")


@query("W6_facts_top_n", "SELECT owner, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY confidence DESC, fact_id) AS n FROM facts) WHERE n <= 100")
def _(t):
    return conv.facts_top_n(t.facts).select("owner", "fact_id")


@query("W7_token_budget_pack", """WITH l AS (SELECT owner, fact_id, confidence, CAST(floor(length('- [' || category || ' | ' || printf('%.2f', confidence) || '] ' || content || chr(10)) / 4) AS BIGINT) AS tok FROM facts),
w AS (SELECT owner, fact_id, sum(tok) OVER (PARTITION BY owner ORDER BY confidence DESC, fact_id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY owner ORDER BY confidence DESC, fact_id) AS place FROM l) SELECT owner, fact_id, place FROM w WHERE total <= 500""")
def _(t):
    return conv.token_budget_pack(t.facts, 500)


@query("U4_fact_merge", """WITH k AS (SELECT * FROM facts WHERE fact_id < 5000 AND fact_id % 7 <> 0), c AS (SELECT *, row_number() OVER (PARTITION BY owner, trim(content) ORDER BY fact_id) AS n FROM facts WHERE fact_id >= 5000 AND confidence >= 0.7),
m AS (SELECT owner, fact_id, confidence FROM k UNION ALL SELECT owner, fact_id, confidence FROM c WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.owner = c.owner AND trim(k.content) = trim(c.content)))
SELECT owner, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY confidence DESC, fact_id) AS r FROM m) WHERE r <= 100""")
def _(t):
    facts = t.facts
    return conv.fact_merge(facts.filter("fact_id < 5000"), facts.filter("fact_id >= 5000"), facts.filter("fact_id % 7 = 0")).select("owner", "fact_id")


@query("A27_token_usage", "SELECT key_id, sum(original_tokens) AS input_tokens, sum(final_tokens) AS output_tokens, sum(original_tokens + final_tokens) AS total_tokens FROM api_requests GROUP BY 1")
def _(t):
    return conv.token_usage(t.api_requests.withColumnsRenamed({"original_tokens": "input_tokens", "final_tokens": "output_tokens"}), "key_id")


# texts


def docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query("T1_chunk_documents")
def _(t):
    return text.chunk_documents(docs(t)).select("id", "position", F.md5("content").alias("digest"), F.length("content").alias("n"))


@query("A19_document_stats", r"SELECT CAST(doc_id AS VARCHAR) AS id, CAST(len(string_split_regex(text, '\s+')) AS INT) AS words, CAST(ceil(len(string_split_regex(text, '\s+')) * 1.3::DOUBLE) AS INT) AS tokens FROM documents")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), "text")
    return text.document_stats(rows, text.chunk_documents(docs(t))).select("id", "words", "tokens")


NEAR = r"""b AS (SELECT id, w, count(*) AS c FROM (SELECT vec_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}-]+'), lambda w: strlen(w) > 1)) AS w FROM x) GROUP BY 1, 2),
n AS (SELECT id, sum(c) AS n, sum(c * c) AS q FROM b GROUP BY 1), p AS (SELECT a.id AS a, d.id AS b, sum(least(a.c, d.c)) AS m, sum(a.c * d.c) AS p FROM b a JOIN b d ON a.w = d.w AND a.id < d.id GROUP BY 1, 2)
SELECT p.a, p.b, round((m / (x.n + y.n - m)::DOUBLE + p / sqrt(x.q::DOUBLE * y.q)) / 2, 6) AS similarity FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE (m / (x.n + y.n - m)::DOUBLE + p / sqrt(x.q::DOUBLE * y.q)) / 2 >= 0.4"""


@query("T2_near_duplicates", f"WITH x AS (SELECT conv_id * 100 + turn AS vec_id, text FROM conversations), {NEAR}")
def _(t):
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return text.near_duplicates(rows, 0.4)


@query("F11_regex_log_search", r"""WITH l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM text_lines)
SELECT path, CAST(line_number AS INT) AS line_number, CASE WHEN length(line) > 200 THEN substring(line, 1, 197) || '...' ELSE line END AS line FROM l WHERE length(line) <= 2000 AND regexp_matches(line, '(?i)licen[sc]e|reserved') ORDER BY path, line_number LIMIT 100""")
def _(t):
    return text.regex_log_search(t.text_lines, "licen[sc]e|reserved")


@query("F12_path_glob_filter", f"SELECT path FROM text_lines WHERE path LIKE 'src/src1%/%' AND regexp_matches(path, '^src/src1[^/]*/[^/]*/[^/]*$') AND len(list_filter(string_split(path, '/'), lambda s: {' OR '.join(f"s GLOB '{g}'" for g in text.IGNORED)})) = 0")
def _(t):
    paths = t.text_lines.select("path")
    return text.path_glob_filter(paths, "src/src1*/*/*")


@query("F15_rank_catalog", "SELECT p_partkey AS pos, p_name AS name FROM part WHERE regexp_matches(p_name || ' ' || p_type, '(?i)small|promo') ORDER BY CASE WHEN regexp_matches(p_name, '(?i)small|promo') THEN 2 ELSE 1 END DESC, p_partkey LIMIT 5")
def _(t):
    return text.rank_catalog(t.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("description")), "small|promo").select("pos", "name")


@query("F16_search_notes", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name LIKE 'Customer#%' AND (contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build'))")
def _(t):
    return text.search_notes(t.customer.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")), "Build", "Customer#")


@query("T15_stratified_split", "SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY toxic) * 0.3::DOUBLE)) AS is_test FROM labels")
def _(t):
    return text.stratified_split(t.labels, "toxic", "doc_id", 0.3, 7).select("doc_id", "toxic", "is_test")


@query("T16_to_markdown_table", "SELECT '| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS line FROM nation")
def _(t):
    return text.to_markdown_rows(t.nation)


def _replaced(column, *rules):
    for pattern, by in rules:
        column = f"regexp_replace({column}, '{pattern}', {by}, 'gs')"
    return column


#: The tags that pages have, one rule after the other; entities come last.
MARKDOWN = _replaced(
    "html", (r"[ \t\n\r\f\v]+", "' '"), ("<!--.*?-->|<![^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title>.*?</title>", "''"),
    ("<a href=\"([^\"]*)\">([^<]*)</a>", r"'[\2](\1)'"), ("<h1[^>]*>", "chr(10) || chr(10) || '# '"), ("<li[^>]*>", "chr(10) || '- '"), ("<br[^>]*>", "chr(10)"), ("</?(b|strong)>", "'**'"),
    ("</?(p|div|nav|article|footer|ul)( [^>]*)?>|</h1>", "chr(10) || chr(10)"), ("<[^>]*>", "''"),
)


def _unescaped(column):
    for name, sign in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        column = f"replace({column}, '{name}', '{sign}')"
    return column


@query("S7_web_pages_to_markdown", f"""SELECT page_id, trim({_unescaped("regexp_extract(html, '<title>(.*?)</title>', 1)")}, chr(10) || ' ') AS title,
trim({_replaced(_unescaped(MARKDOWN), (r'\n[ \t]+', 'chr(10)'), (r'[ \t]+\n', 'chr(10)'), (r'\n{3,}', 'chr(10) || chr(10)'))}, chr(10) || ' ') AS markdown FROM pages""")
def _(t):
    return text.pages_to_markdown(t.pages)
