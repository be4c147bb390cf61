"""Queries over issues, dependencies, labels and history."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions.filters import issue_query, relative_time
from ..operators import work
from .registry import query

NOW = dt.datetime(2001, 8, 2)
T = "TIMESTAMP '2001-08-02 00:00:00'"

ACTIVE = "SELECT * FROM issues WHERE status NOT IN ('closed', 'pinned')"
BLOCKED = f"""
act AS ({ACTIVE}),
direct AS (SELECT DISTINCT d.issue_id, d.depends_on_id FROM deps d JOIN act a ON d.issue_id = a.id JOIN act b ON d.depends_on_id = b.id WHERE d.type IN ('blocks', 'conditional-blocks')),
kids AS (SELECT d.depends_on_id AS spawner, bool_or(i.status NOT IN ('closed', 'pinned')) AS any_active, bool_or(i.status = 'closed') AS any_closed FROM deps d JOIN issues i ON d.issue_id = i.id WHERE d.type = 'parent-child' GROUP BY 1),
gated AS (SELECT DISTINCT d.issue_id, d.depends_on_id FROM deps d JOIN act a ON d.issue_id = a.id JOIN kids k ON d.depends_on_id = k.spawner WHERE d.type = 'waits-for' AND CASE WHEN d.metadata LIKE '%any-children%' THEN NOT any_closed AND any_active ELSE any_active END),
blocked AS (SELECT DISTINCT issue_id AS id FROM (SELECT * FROM direct UNION ALL SELECT * FROM gated))
"""
READY = f"""
{BLOCKED},
held AS (SELECT id FROM blocked UNION SELECT issue_id FROM deps WHERE type = 'parent-child' AND depends_on_id IN (SELECT id FROM blocked UNION SELECT id FROM issues WHERE defer_until > {T})),
ready AS (SELECT * FROM issues WHERE status IN ('open', 'in_progress') AND NOT pinned AND NOT ephemeral AND issue_type NOT IN ('merge-request', 'gate', 'molecule', 'message', 'agent', 'role', 'rig')
  AND coalesce(defer_until, {T}) <= {T} AND id NOT IN (SELECT id FROM held))
"""


def ids(df, *more):
    return df.select("id", *more)


def joined(column):
    return F.array_join(column, ",")


@query("G1_blocked_ids", f"WITH {BLOCKED} SELECT id FROM blocked")
def _(t):
    return work.blocked_ids(t.issues, t.kept("deps"))


@query("G2_blocked_issues", f"""WITH {BLOCKED},
own AS (SELECT d.issue_id AS id, d.depends_on_id AS by FROM deps d JOIN blocked b ON d.issue_id = b.id JOIN act a ON d.depends_on_id = a.id WHERE d.type IN ('blocks', 'conditional-blocks', 'waits-for')),
below AS (SELECT d.issue_id AS id, d.depends_on_id AS by FROM deps d JOIN blocked b ON d.depends_on_id = b.id WHERE d.type = 'parent-child' AND d.issue_id NOT IN (SELECT id FROM blocked))
SELECT a.id, a.priority, string_agg(DISTINCT x.by, ',' ORDER BY x.by) AS blocked_by FROM (SELECT * FROM own UNION ALL SELECT * FROM below) x JOIN act a USING (id) GROUP BY a.id, a.priority""")
def _(t):
    return work.blocked_issues(t.issues, t.kept("deps")).select("id", "priority", joined("blocked_by").alias("blocked_by"))


HOLDING = """own AS (SELECT d.issue_id AS id, d.depends_on_id AS by FROM deps d JOIN blocked b ON d.issue_id = b.id JOIN act a ON d.depends_on_id = a.id WHERE d.type IN ('blocks', 'conditional-blocks', 'waits-for')),
below AS (SELECT d.issue_id AS id, d.depends_on_id AS by FROM deps d JOIN blocked b ON d.depends_on_id = b.id JOIN act a ON d.issue_id = a.id WHERE d.type = 'parent-child' AND d.issue_id NOT IN (SELECT id FROM blocked)),
holding AS (SELECT DISTINCT x.id, x.by AS blocker FROM (SELECT * FROM own UNION ALL SELECT * FROM below) x JOIN act ON act.id = x.id)"""
HELD = f"{BLOCKED}, {HOLDING}"


@query("G2_blocked_issues_of_parent", f"WITH {HELD} SELECT id, string_agg(blocker, ',' ORDER BY blocker) AS blocked_by FROM holding WHERE id IN (SELECT issue_id FROM deps WHERE type = 'parent-child' AND depends_on_id = 'bd-10') GROUP BY 1")
def _(t):
    return work.blocked_issues(t.issues, t.kept("deps"), parent="bd-10").select("id", joined("blocked_by").alias("blocked_by"))


@query("G3_ready_work", f"WITH {READY} SELECT id, title, priority, status FROM ready")
def _(t):
    return work.ready_work(t.issues, t.kept("deps"), NOW).orderBy(*work.ready_order("hybrid", NOW)).select("id", "title", "priority", "status")


@query("G5_blocked_view", f"""WITH act AS (SELECT id FROM issues WHERE status NOT IN ('closed', 'pinned', 'deferred'))
SELECT d.issue_id AS id, count(*) AS blocked_by_count FROM deps d JOIN act a ON d.issue_id = a.id JOIN act b ON d.depends_on_id = b.id WHERE d.type = 'blocks' GROUP BY 1""")
def _(t):
    return work.blocked_view(t.issues, t.deps, ["deferred"])


@query("G6_ready_explanation", f"""WITH {READY},
counts AS (SELECT d.issue_id AS id, count(*) FILTER (i.status = 'closed') AS r, count(*) FILTER (i.status NOT IN ('closed', 'pinned')) AS b FROM deps d JOIN issues i ON d.depends_on_id = i.id WHERE d.type IN ('blocks', 'conditional-blocks') GROUP BY 1),
parents AS (SELECT issue_id AS id, min(depends_on_id) AS parent FROM deps WHERE type = 'parent-child' GROUP BY 1)
SELECT i.id, i.id IN (SELECT id FROM ready) AS ready, coalesce(r, 0) AS n_resolved, coalesce(b, 0) AS n_blockers,
  CASE WHEN i.id NOT IN (SELECT id FROM ready) THEN 'blocked by ' || coalesce(b, 0) || ' issue(s)' WHEN coalesce(r, 0) > 0 THEN r || ' blocker(s) resolved' ELSE 'no blocking dependencies' END AS reason, parent
FROM issues i LEFT JOIN counts USING (id) LEFT JOIN parents USING (id) WHERE status IN ('open', 'in_progress')""")
def _(t):
    return work.ready_explanation(t.issues, t.kept("deps"), NOW)


@query("G6_ready_items", f"""WITH {READY},
waited AS (SELECT issue_id AS id, count(DISTINCT depends_on_id) AS n, string_agg(DISTINCT depends_on_id, ',' ORDER BY depends_on_id) AS resolved FROM deps WHERE type IN ('blocks', 'conditional-blocks', 'waits-for') GROUP BY 1),
parents AS (SELECT issue_id AS id, min(depends_on_id) AS parent FROM deps WHERE type = 'parent-child' GROUP BY 1)
SELECT r.id, CASE WHEN n > 0 THEN n || ' blocker(s) resolved' ELSE 'no blocking dependencies' END AS reason, coalesce(resolved, '') AS resolved_blockers,
  (SELECT count(*) FROM deps d WHERE d.type = 'blocks' AND d.issue_id = r.id) AS dependencies, (SELECT count(*) FROM deps d WHERE d.type = 'blocks' AND d.depends_on_id = r.id) AS dependents, parent
FROM ready r LEFT JOIN waited USING (id) LEFT JOIN parents USING (id)""")
def _(t):
    return work.ready_items(t.issues, t.kept("deps"), NOW).withColumn("resolved_blockers", joined("resolved_blockers"))


@query("G6_blocked_items", f"""WITH {HELD} SELECT h.id, count(*) AS n_blockers, string_agg(concat_ws('|', h.blocker, i.title, i.status, CAST(i.priority AS VARCHAR)), chr(10) ORDER BY h.blocker) AS blockers FROM holding h LEFT JOIN issues i ON i.id = h.blocker GROUP BY 1""")
def _(t):
    line = lambda b: F.concat_ws("|", b["id"], b["title"], b["status"], b["priority"].cast("string"))
    return work.blocked_items(t.issues, t.kept("deps")).withColumn("blockers", F.array_join(F.transform("blockers", line), "\n"))


@query("G15_swarm_status", """WITH ch AS (SELECT d.depends_on_id AS epic, i.id, i.status FROM deps d JOIN issues e ON d.depends_on_id = e.id AND e.issue_type = 'epic' JOIN issues i ON d.issue_id = i.id WHERE d.type = 'parent-child'),
w AS (SELECT DISTINCT a.epic, a.id FROM ch a JOIN deps d ON d.issue_id = a.id AND d.type IN ('blocks', 'conditional-blocks') JOIN ch b ON b.epic = a.epic AND b.id = d.depends_on_id AND b.status <> 'closed')
SELECT epic, count(*) AS total, count(*) FILTER (status = 'closed') AS completed, count(*) FILTER (status = 'in_progress') AS active,
  count(*) FILTER (status NOT IN ('closed', 'in_progress') AND w.id IS NULL) AS ready, count(*) FILTER (status NOT IN ('closed', 'in_progress') AND w.id IS NOT NULL) AS blocked,
  round(100.0::DOUBLE * count(*) FILTER (status = 'closed') / count(*), 6) AS percent
FROM ch LEFT JOIN w USING (epic, id) GROUP BY epic""")
def _(t):
    return work.swarm_status(t.issues, t.kept("deps"))


EPICS = """SELECT d.depends_on_id AS id, count(*) AS total, count(*) FILTER (i.status = 'closed') AS closed, count(*) = count(*) FILTER (i.status = 'closed') AS eligible
FROM deps d JOIN issues e ON d.depends_on_id = e.id AND e.issue_type = 'epic' AND e.status <> 'closed' JOIN issues i ON d.issue_id = i.id WHERE d.type = 'parent-child' GROUP BY 1"""


@query("A9_epic_status", EPICS)
def _(t):
    return work.epic_status(t.issues, t.deps)


STALE = """SELECT e.id, i.title, i.assignee, e.total, e.closed, coalesce(string_agg(h.id, ',' ORDER BY h.id), '') AS blocking, count(h.id) AS n_blocking FROM e JOIN issues i USING (id) LEFT JOIN holding h ON h.blocker = e.id WHERE e.eligible GROUP BY ALL"""


@query("G24_stale_molecules", f"WITH {HELD}, e AS ({EPICS}) {STALE}")
def _(t):
    return work.stale_molecules(t.issues, t.kept("deps")).withColumn("blocking", joined("blocking"))


@query("G24_stale_unassigned", f"WITH {HELD}, e AS ({EPICS}) SELECT * FROM ({STALE}) WHERE assignee = ''")
def _(t):
    return work.stale_molecules(t.issues, t.kept("deps"), unassigned_only=True).withColumn("blocking", joined("blocking"))


@query("G24_stale_blocking", f"WITH {HELD}, e AS ({EPICS}) SELECT * FROM ({STALE}) WHERE n_blocking > 0")
def _(t):
    return work.stale_molecules(t.issues, t.kept("deps"), blocking_only=True).withColumn("blocking", joined("blocking"))


@query("G25_merge_duplicates", r"""WITH d1 AS (SELECT issue_id AS id, count(*) AS n FROM deps WHERE type = 'blocks' GROUP BY 1), d2 AS (SELECT depends_on_id AS id, count(*) AS n FROM deps WHERE type = 'blocks' GROUP BY 1),
refs AS (SELECT id, count(*) AS n FROM (SELECT unnest(regexp_extract_all(title || chr(10) || description, '\b[a-zA-Z][-a-zA-Z0-9]*-\d+\b')) AS id FROM issues) GROUP BY 1),
w AS (SELECT i.id, first_value(i.id) OVER (PARTITION BY title, status, priority ORDER BY 3 * coalesce(d2.n, 0) + coalesce(d1.n, 0) DESC, coalesce(refs.n, 0) DESC, i.id) AS target
  FROM issues i LEFT JOIN d1 USING (id) LEFT JOIN d2 USING (id) LEFT JOIN refs USING (id))
SELECT id, target FROM w WHERE id <> target""")
def _(t):
    return work.merge_duplicates(t.issues, t.deps, ["title", "status", "priority"])


MERGE = r"""d1 AS (SELECT issue_id AS id, count(*) AS n FROM deps WHERE type = 'blocks' GROUP BY 1), d2 AS (SELECT depends_on_id AS id, count(*) AS n FROM deps WHERE type = 'blocks' GROUP BY 1),
refs AS (SELECT id, count(*) AS n FROM (SELECT unnest(regexp_extract_all(title || chr(10) || description, '\b[a-zA-Z][-a-zA-Z0-9]*-\d+\b')) AS id FROM issues) GROUP BY 1),
plan AS (SELECT id, target FROM (SELECT i.id, first_value(i.id) OVER (PARTITION BY title, status, priority ORDER BY 3 * coalesce(d2.n, 0) + coalesce(d1.n, 0) DESC, coalesce(refs.n, 0) DESC, i.id) AS target
  FROM issues i LEFT JOIN d1 USING (id) LEFT JOIN d2 USING (id) LEFT JOIN refs USING (id)) WHERE id <> target)"""


def merged(t):
    return work.apply_merge(t.issues, t.kept("deps"), work.merge_duplicates(t.issues, t.kept("deps"), ["title", "status", "priority"]))


@query("G25_merged_dependencies", f"""WITH {MERGE}, x AS (SELECT d.issue_id, d.depends_on_id, d.type, 0 AS rank FROM deps d WHERE NOT (d.type = 'parent-child' AND d.depends_on_id IN (SELECT id FROM plan))
  UNION ALL SELECT d.issue_id, p.target, d.type, 1 FROM deps d JOIN plan p ON d.depends_on_id = p.id WHERE d.type = 'parent-child' AND d.issue_id <> p.target UNION ALL SELECT id, target, 'related', 2 FROM plan)
SELECT issue_id, depends_on_id, arg_min(type, rank) AS type FROM x GROUP BY 1, 2""")
def _(t):
    return merged(t)[1].select("issue_id", "depends_on_id", "type")


@query("G25_merged_issues", f"WITH {MERGE} SELECT i.id, CASE WHEN target IS NULL THEN status ELSE 'closed' END AS status, 'Duplicate of ' || target AS close_reason FROM issues i LEFT JOIN plan USING (id)")
def _(t):
    return merged(t)[0].select("id", "status", "close_reason")


@query("G25_reparented", f"WITH {MERGE} SELECT d.issue_id AS child, d.depends_on_id AS source, p.target FROM deps d JOIN plan p ON d.depends_on_id = p.id WHERE d.type = 'parent-child' AND d.issue_id <> p.target")
def _(t):
    return merged(t)[2]


# filters and sorts


@query("F7_filter_issues", f"""SELECT id, title FROM issues i WHERE contains(lower(title), 'order 1') AND status NOT IN ('closed') AND priority BETWEEN 1 AND 3 AND NOT pinned AND created_at > TIMESTAMP '1996-01-01 00:00:00'
AND due_at < {T} AND status <> 'closed' AND id IN (SELECT issue_id FROM issue_labels WHERE label IN ('area-N', 'state:O') GROUP BY 1 HAVING count(DISTINCT label) = 2)
AND id NOT IN (SELECT issue_id FROM deps WHERE type = 'parent-child' AND depends_on_id = 'bd-0') AND json_extract_string(metadata, '$.team') = 't1'""")
def _(t):
    out = work.filter_issues(
        t.issues, t.deps, t.issue_labels, title_contains="Order 1", not_status=["closed"], priority_min=1, priority_max=3, pinned=False,
        created_after=dt.datetime(1996, 1, 1), overdue=NOW, labels_all=["area-N", "state:O"], metadata={"team": "t1"},
    )
    return out.join(t.deps.filter("type = 'parent-child' AND depends_on_id = 'bd-0'").select(F.col("issue_id").alias("id")), "id", "left_anti").select("id", "title")


@query("F7_no_parent_no_label", "SELECT id FROM issues WHERE id NOT IN (SELECT issue_id FROM deps WHERE type = 'parent-child') AND id NOT IN (SELECT issue_id FROM issue_labels)")
def _(t):
    return ids(work.filter_issues(t.issues, t.deps, t.issue_labels, no_parent=True, no_labels=True))


@query("F8_label_pattern", r"SELECT id FROM issues WHERE id IN (SELECT issue_id FROM issue_labels WHERE label LIKE 'area-%') AND id IN (SELECT issue_id FROM issue_labels WHERE regexp_matches(label, '^state:[OF]$'))")
def _(t):
    return ids(work.filter_issues(t.issues, t.deps, t.issue_labels, label_glob="area-*", label_regex="^state:[OF]$"))


@query("F9_issue_query", f"""WITH l AS (SELECT issue_id AS id, list(label) AS labels FROM issue_labels GROUP BY 1)
SELECT i.id FROM issues i LEFT JOIN l USING (id) WHERE (status = 'open' AND priority <= 1 OR contains(lower(title), 'order 7')) AND NOT issue_type = 'epic'
AND updated_at > {T} - INTERVAL 365 DAY AND NOT coalesce(assignee, '') = '' AND list_contains(coalesce(labels, []), 'area-N')""")
def _(t):
    tree = {"and": [
        {"or": [{"and": [{"field": "status", "value": "open"}, {"field": "priority", "op": "<=", "value": 1}]}, {"field": "title", "value": "Order 7"}]},
        {"not": {"field": "type", "value": "epic"}}, {"field": "updated", "op": ">", "value": "365d"}, {"not": {"field": "assignee", "value": "none"}}, {"field": "label", "value": "area-N"},
    ]}
    labels = t.issue_labels.groupBy(F.col("issue_id").alias("id")).agg(F.collect_list("label").alias("labels"))
    rows = t.issues.join(labels, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    return ids(rows.filter(issue_query(tree, NOW)))


@query("F10_search_issues", "SELECT id, title, priority FROM issues WHERE contains(lower(title), 'customer 7')")
def _(t):
    both = work.merge_ephemeral(t.issues.filter("NOT ephemeral"), t.issues.filter("ephemeral OR priority = 0"))
    return work.sort_issues(work.filter_issues(both, t.deps, t.issue_labels, text="customer 7"), "priority").select("id", "title", "priority")


@query("W4_ready_order", f"WITH {READY} SELECT id, created_at FROM ready ORDER BY created_at, id")
def _(t):
    return work.ready_work(t.issues, t.kept("deps"), NOW).orderBy(*work.ready_order("oldest", NOW)).select("id", "created_at")


@query("W5_sort_issues", "SELECT id, closed_at FROM issues ORDER BY closed_at DESC NULLS LAST, id LIMIT 500")
def _(t):
    return work.sort_issues(t.issues, "closed").select("id", "closed_at").limit(500)


@query("W9_rapid_creation", "SELECT id, in_minute FROM (SELECT id, count(*) OVER (PARTITION BY date_trunc('minute', created_at)) AS in_minute FROM issues) WHERE in_minute >= 10")
def _(t):
    return work.rapid_creation(t.issues)


@query("W12_stale_issues", f"SELECT id, updated_at FROM issues WHERE updated_at < {T} - INTERVAL 30 DAY AND status IN ('open', 'in_progress') AND NOT ephemeral")
def _(t):
    return work.stale_issues(t.issues, NOW, 30).select("id", "updated_at")


@query("W13_compaction_candidates", f"""SELECT i.id, closed_at, length(description) AS size, CAST(floor(length(description) * 3 / 10) AS INT) AS estimate, coalesce(n, 0) AS dependents
FROM issues i LEFT JOIN (SELECT depends_on_id AS id, count(*) AS n FROM deps WHERE type = 'blocks' GROUP BY 1) USING (id) WHERE status = 'closed' AND compaction_level = 0 AND closed_at <= {T} - INTERVAL 30 DAY""")
def _(t):
    return work.compaction_candidates(t.issues, t.deps, NOW, 1).withColumn("size", F.col("size").cast("bigint"))


# joins


@query("J4_newly_unblocked", """WITH c AS (SELECT id FROM issues WHERE issue_type = 'bug' AND priority <= 1),
act AS (SELECT id FROM issues WHERE status NOT IN ('closed', 'pinned') AND id NOT IN (SELECT id FROM c))
SELECT id FROM act WHERE id IN (SELECT issue_id FROM deps WHERE type = 'blocks' AND depends_on_id IN (SELECT id FROM c)) AND id NOT IN (SELECT issue_id FROM deps WHERE type = 'blocks' AND depends_on_id IN (SELECT id FROM act))""")
def _(t):
    return work.newly_unblocked(t.issues, t.deps, t.issues.filter("issue_type = 'bug' AND priority <= 1").select("id"))


@query("J5_blocking_info", """WITH e AS (SELECT issue_id, depends_on_id FROM deps WHERE type = 'blocks' AND depends_on_id IN (SELECT id FROM issues WHERE status <> 'closed')),
a AS (SELECT issue_id AS id, string_agg(DISTINCT depends_on_id, ',' ORDER BY depends_on_id) AS blocked_by FROM e GROUP BY 1),
b AS (SELECT depends_on_id AS id, string_agg(DISTINCT issue_id, ',' ORDER BY issue_id) AS blocks FROM e GROUP BY 1),
p AS (SELECT issue_id AS id, min(depends_on_id) AS parent FROM deps WHERE type = 'parent-child' GROUP BY 1)
SELECT id, blocked_by, blocks, parent FROM a FULL JOIN b USING (id) FULL JOIN p USING (id)""")
def _(t):
    return work.blocking_info(t.issues, t.deps).select("id", joined("blocked_by").alias("blocked_by"), joined("blocks").alias("blocks"), "parent")


@query("J6_upsert", "SELECT id, title, 'done' AS status FROM issues WHERE priority = 0 UNION ALL SELECT id, title, status FROM issues WHERE priority > 0")
def _(t):
    state = t.issues.filter("priority < 4").select("id", "title", "status")
    changes = t.issues.filter("priority = 0").select("id", "title", F.lit("done").alias("status")).union(t.issues.filter("priority = 4").select("id", "title", "status"))
    return work.upsert(state, changes, "id")


@query("J7_sync_conflicts", "SELECT i.id, i.updated_at AS local_updated, e.updated_at AS external_updated FROM issues i JOIN external_issues e USING (id) WHERE i.updated_at > TIMESTAMP '1999-06-01 00:00:00' AND e.updated_at > TIMESTAMP '1999-06-01 00:00:00'")
def _(t):
    return work.sync_conflicts(t.issues, t.external_issues, dt.datetime(1999, 6, 1))


@query("J8_resolve_conflicts", "SELECT i.id, CASE WHEN i.updated_at > e.updated_at THEN 'push' ELSE 'pull' END AS action FROM issues i JOIN external_issues e USING (id) WHERE i.updated_at > TIMESTAMP '1999-06-01 00:00:00' AND e.updated_at > TIMESTAMP '1999-06-01 00:00:00'")
def _(t):
    return work.resolve_conflicts(work.sync_conflicts(t.issues, t.external_issues, dt.datetime(1999, 6, 1)), "timestamp")


@query("J9_pull_merge", """WITH mine AS (SELECT * FROM issues WHERE priority < 4)
SELECT e.id, CASE WHEN m.id IS NULL THEN 'create' WHEN (m.title = e.title AND m.status = e.status AND m.priority = e.priority) OR m.updated_at > TIMESTAMP '1999-06-01 00:00:00' THEN 'skip' ELSE 'update' END AS action
FROM external_issues e LEFT JOIN mine m USING (id)""")
def _(t):
    return work.pull_merge(t.issues.filter("priority < 4"), t.external_issues, ["title", "status", "priority"], dt.datetime(1999, 6, 1))


@query("J10_orphaned_dependencies", "SELECT issue_id, depends_on_id FROM deps WHERE depends_on_id NOT LIKE 'external:%' AND depends_on_id NOT IN (SELECT id FROM issues WHERE priority < 3)")
def _(t):
    return work.orphaned_dependencies(t.issues.filter("priority < 3"), t.deps).select("issue_id", "depends_on_id")


@query("J11_orphaned_by_commits", r"""WITH c AS (SELECT unnest(regexp_extract_all(message, '\((bd-[0-9a-z.]+)\)', 1)) AS id, hash, committed_at FROM commits), m AS (SELECT id, max(committed_at) AS committed_at FROM c GROUP BY 1)
SELECT i.id, i.status, c.hash, m.committed_at FROM issues i JOIN m USING (id) JOIN c ON c.id = i.id AND c.committed_at = m.committed_at WHERE i.status IN ('open', 'in_progress')""")
def _(t):
    return work.orphaned_by_commits(t.issues, t.commits, "bd")


@query("J13_children_of_blocked", f"WITH {BLOCKED} SELECT DISTINCT issue_id AS id FROM deps WHERE type = 'parent-child' AND depends_on_id IN (SELECT id FROM blocked UNION SELECT id FROM issues WHERE defer_until > {T})")
def _(t):
    deferred = t.issues.filter(F.col("defer_until") > F.lit(NOW)).select("id")
    return work.children_of(t.kept("deps"), work.blocked_ids(t.issues, t.kept("deps")).union(deferred))


AS_OF = "SELECT id, commit_date, title, status, priority, description FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY commit_date DESC, seq DESC, title DESC, status DESC, priority DESC, description DESC) AS rn FROM history WHERE commit_date <= TIMESTAMP '{} 00:00:00') WHERE rn = 1"


@query("J14_as_of", AS_OF.format("1999-01-01"))
def _(t):
    return work.as_of(t.history, dt.datetime(1999, 1, 1)).select("id", "commit_date", "title", "status", "priority", "description")


@query("J15_diff", f"""WITH a AS ({AS_OF.format("1998-01-01")}), b AS ({AS_OF.format("1999-01-01")})
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
  a.title AS old_title, a.status AS old_status, a.priority AS old_priority, b.title AS new_title, b.status AS new_status, b.priority AS new_priority
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.title <> b.title OR a.status <> b.status OR a.priority <> b.priority""")
def _(t):
    return work.diff(t.history, dt.datetime(1998, 1, 1), dt.datetime(1999, 1, 1), ["title", "status", "priority"])


DOTTED = "SELECT CASE WHEN l_linenumber = 1 THEN concat('bd-', CAST(l_orderkey % 900 AS STRING)) ELSE concat('bd-', CAST(l_orderkey % 1000 AS STRING), '.', CAST(l_linenumber AS STRING)) END AS id FROM lineitem GROUP BY 1"


def dotted(t):
    line = t.lineitem
    plain = F.concat(F.lit("bd-"), (F.col("l_orderkey") % 900).cast("string"))
    child = F.concat(F.lit("bd-"), (F.col("l_orderkey") % 1000).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return line.select(F.when(F.col("l_linenumber") == 1, plain).otherwise(child).alias("id")).distinct()


@query("J16_missing_parents", f"WITH x AS ({DOTTED}) SELECT id FROM x WHERE contains(id, '.') AND string_split(id, '.')[1] NOT IN (SELECT id FROM x)")
def _(t):
    return work.missing_parents(dotted(t))


@query("A29_child_counters", f"WITH x AS ({DOTTED}) SELECT string_split(id, '.')[1] AS parent, max(CAST(string_split(id, '.')[2] AS INT)) AS last_child FROM x WHERE contains(id, '.') AND string_split(id, '.')[1] IN (SELECT id FROM x) GROUP BY 1")
def _(t):
    return work.child_counters(dotted(t))


# aggregates

STATS = """count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status = 'deferred') AS deferred,
  count(*) FILTER (pinned) AS pinned, count(*) FILTER (b.id IS NOT NULL) AS blocked, greatest(0, count(*) FILTER (status = 'open') - count(*) FILTER (b.id IS NOT NULL)) AS ready, count(*) FILTER (e.eligible) AS epics_eligible,
  round(avg(CASE WHEN status = 'closed' THEN (epoch(closed_at) - epoch(created_at)) / 3600 END), 6) AS lead_time_hours"""


@query("A3_issue_statistics", f"WITH {BLOCKED}, e AS ({EPICS}) SELECT {STATS} FROM issues i LEFT JOIN blocked b ON i.id = b.id LEFT JOIN e ON e.id = i.id AND e.eligible")
def _(t):
    return work.issue_statistics(t.issues, t.kept("deps"))


@query("A4_assignee_statistics", f"WITH {BLOCKED}, e AS ({EPICS}) SELECT assignee, {STATS} FROM issues i LEFT JOIN blocked b ON i.id = b.id LEFT JOIN e ON e.id = i.id AND e.eligible GROUP BY assignee")
def _(t):
    return work.issue_statistics(t.issues, t.kept("deps"), "assignee")


for dim, expr in {"status": "status", "priority": "concat('P', CAST(priority AS STRING))", "type": "issue_type", "assignee": "CASE WHEN assignee = '' THEN '(unassigned)' ELSE assignee END"}.items():
    query(f"A5_count_by_{dim}", f'SELECT {expr} AS "group", count(*) AS n FROM issues GROUP BY 1')(lambda t, d=dim: work.count_by(t.issues, t.issue_labels, d))


@query("A5_count_by_label", """SELECT coalesce(label, '(no labels)') AS "group", count(*) AS n FROM issues i LEFT JOIN issue_labels l ON i.id = l.issue_id GROUP BY 1""")
def _(t):
    return work.count_by(t.issues, t.issue_labels, "label")


@query("A6_label_counts", "SELECT label, count(DISTINCT issue_id) AS n FROM issue_labels GROUP BY 1")
def _(t):
    return work.label_counts(t.issue_labels)


@query("A7_dependency_counts", """WITH a AS (SELECT issue_id AS id, count(*) AS n FROM deps WHERE type = 'blocks' GROUP BY 1), b AS (SELECT depends_on_id AS id, count(*) AS n FROM deps WHERE type = 'blocks' GROUP BY 1)
SELECT id, coalesce(a.n, 0) AS dependencies, coalesce(b.n, 0) AS dependents FROM a FULL JOIN b USING (id)""")
def _(t):
    return work.dependency_counts(t.deps)


@query("A8_comment_counts", "SELECT issue_id, count(*) AS n FROM comments GROUP BY 1")
def _(t):
    return t.comments.groupBy("issue_id").agg(F.count("*").alias("n"))


@query("A10_molecule_progress", """WITH g AS (SELECT d.depends_on_id AS id, count(*) AS total, count(*) FILTER (status = 'closed') AS completed, count(*) FILTER (status = 'in_progress') AS in_progress,
  min(CASE WHEN status = 'in_progress' THEN i.id END) AS current, (epoch(max(closed_at)) - epoch(min(closed_at))) / 3600.0::DOUBLE AS hours FROM deps d JOIN issues i ON d.issue_id = i.id WHERE d.type = 'parent-child' GROUP BY 1),
r AS (SELECT *, CASE WHEN completed > 1 AND hours > 0 THEN (completed - 1) / hours END AS rate0 FROM g)
SELECT id, total, completed, in_progress, current, round(100.0::DOUBLE * completed / total, 6) AS percent, round(rate0, 6) AS rate, round((total - completed) / rate0, 6) AS eta_hours FROM r""")
def _(t):
    return work.molecule_progress(t.issues, t.deps)


@query("A11_molecule_last_activity", """WITH g AS (SELECT d.depends_on_id AS id, max(updated_at) AS u, max(closed_at) AS c FROM deps d JOIN issues i ON d.issue_id = i.id WHERE d.type = 'parent-child' GROUP BY 1)
SELECT i.id, CASE WHEN c > u THEN c ELSE coalesce(u, i.updated_at) END AS last_activity, CASE WHEN u IS NULL THEN 'own_updated' WHEN c > u THEN 'child_closed' ELSE 'child_updated' END AS source FROM issues i LEFT JOIN g USING (id)""")
def _(t):
    return work.molecule_last_activity(t.issues, t.deps)


@query("A12_exact_duplicates", "SELECT title, description, status, count(*) AS n, min(id) AS first_id, count(*) - 1 AS surplus FROM issues GROUP BY title, description, status HAVING count(*) > 1")
def _(t):
    return work.exact_duplicates(t.issues, ["title", "description", "status"])


@query("A26_text_reference_counts", r"SELECT id, count(*) AS refs FROM (SELECT unnest(regexp_extract_all(title || chr(10) || description, '\b[a-zA-Z][-a-zA-Z0-9]*-\d+\b')) AS id FROM issues) GROUP BY 1")
def _(t):
    return work.text_reference_counts(t.issues)


@query("A30_prefix_counts", "SELECT regexp_extract(id, '^([a-z]+)-', 1) AS prefix, count(*) AS n FROM issues GROUP BY 1")
def _(t):
    return work.prefix_counts(t.issues)


# state, sets, quality


@query("U1_all_events_since", "SELECT id, issue_id, event_type, new_value FROM issue_events WHERE created_at > TIMESTAMP '2024-01-20 00:00:00'")
def _(t):
    both = t.issue_events.filter("NOT ephemeral").unionByName(t.issue_events.filter("ephemeral"))
    return both.filter(F.col("created_at") > F.lit(dt.datetime(2024, 1, 20))).orderBy("created_at", "id").select("id", "issue_id", "event_type", "new_value")


@query("U2_merge_permanent_and_ephemeral", "SELECT id, title, false AS from_wisp FROM issues WHERE NOT ephemeral UNION ALL SELECT id, title, true FROM issues WHERE ephemeral")
def _(t):
    permanent = t.issues.filter("NOT ephemeral").select("id", "title", F.lit(False).alias("from_wisp"))
    return work.merge_ephemeral(permanent, t.issues.filter("ephemeral OR priority = 1").select("id", "title", F.lit(True).alias("from_wisp")))


@query("U5_ready_ids", f"WITH {BLOCKED}, kids2 AS (SELECT issue_id FROM deps WHERE type = 'parent-child' AND depends_on_id IN (SELECT id FROM blocked)) SELECT id FROM issues WHERE status = 'open' AND id NOT IN (SELECT id FROM blocked) AND id NOT IN (SELECT issue_id FROM kids2)")
def _(t):
    blocked = work.blocked_ids(t.issues, t.kept("deps"))
    return t.issues.filter("status = 'open'").select("id").join(blocked, "id", "left_anti").join(work.children_of(t.kept("deps"), blocked), "id", "left_anti")


@query("M15_promote_ephemeral", "SELECT id, CASE WHEN ephemeral AND priority = 2 THEN false ELSE ephemeral END AS ephemeral FROM issues")
def _(t):
    return work.promote_ephemeral(t.issues, t.issues.filter("ephemeral AND priority = 2")).select("id", "ephemeral")


PROMOTED = {
    "issues": ("id", "SELECT id, ephemeral AND priority <> 2 AS ephemeral FROM issues"),
    "labels": ("issue_id, label", "SELECT issue_id, label FROM issue_labels"), "dependencies": ("issue_id, depends_on_id, type", "SELECT issue_id, depends_on_id, type FROM deps"),
    "events": ("id, issue_id, event_type", "SELECT id, issue_id, event_type FROM issue_events"), "comments": ("id, issue_id, text", "SELECT id, issue_id, text FROM comments"),
}


def promoted(t, name):
    """The permanent side of a table after the ephemeral issues of priority 2 were promoted."""
    wisps = t.issues.filter("ephemeral").select(F.col("id").alias("issue_id"))
    source = {"labels": "issue_labels", "dependencies": "deps", "events": "issue_events", "comments": "comments"}
    of = {name: t.kept(source[name]).drop("ephemeral")} if name in source else {}
    sides = [{"issues": t.issues.filter(test)} | {n: df.join(wisps, "issue_id", how) for n, df in of.items()} for test, how in (("NOT ephemeral", "left_anti"), ("ephemeral", "left_semi"))]
    return work.promote(t.issues.filter("priority = 2"), *sides)[0][name]


for _name, (_columns, _sql) in PROMOTED.items():
    _owner = "id" if _name == "issues" else "issue_id"

    @query(f"M15_promoted_{_name}", f"SELECT * FROM ({_sql}) WHERE {_owner} NOT IN (SELECT id FROM issues WHERE ephemeral AND priority <> 2)")
    def _(t, name=_name, columns=_columns):
        return promoted(t, name).select(*columns.split(", "), *(["ephemeral"] if name == "issues" else []))


@query("M16_rename_prefix", "SELECT concat('qg-', substring(issue_id, 4)) AS issue_id, concat('qg-', substring(depends_on_id, 4)) AS depends_on_id, type FROM deps")
def _(t):
    return work.rename_prefix(t.deps, "bd", "qg", "issue_id", "depends_on_id").select("issue_id", "depends_on_id", "type")


@query("T8_lint_issues", """WITH x AS (SELECT id, list_filter(CASE issue_type WHEN 'bug' THEN ['steps to reproduce', 'acceptance criteria'] WHEN 'epic' THEN ['success criteria'] ELSE ['acceptance criteria'] END, lambda s: NOT contains(lower(description), s)) AS m FROM issues)
SELECT id, array_to_string(m, ',') AS missing FROM x WHERE len(m) > 0""")
def _(t):
    return work.lint_issues(t.issues).select("id", joined("missing").alias("missing"))


@query("T9_pollution_score", r"""WITH x AS (SELECT *, count(*) OVER (PARTITION BY date_trunc('minute', created_at)) AS busy FROM issues),
s AS (SELECT id, round((CASE WHEN regexp_matches(id, '^[a-z]+-\d+$') AND strlen(description) < 20 THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN trim(description) = '' THEN 0.2::DOUBLE ELSE 0 END)
  + (CASE WHEN trim(description) <> '' AND strlen(description) < 20 THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN busy >= 10 THEN 0.3::DOUBLE ELSE 0 END), 6) AS score FROM x)
SELECT id, score FROM s WHERE score >= 0.7""")
def _(t):
    return work.pollution_score(t.issues).select("id", "score")


@query("T10_content_hash", "SELECT id, sha256(concat(title, chr(0), description, chr(0), status, chr(0), CAST(priority AS VARCHAR), chr(0))) AS content_hash FROM issues")
def _(t):
    return t.issues.select("id", work.content_hash(["title", "description", "status", "priority"]).alias("content_hash"))


@query("T11_hash_id", """WITH k AS (SELECT coalesce(min(k) FILTER (1 - exp(-(n * n)::DOUBLE / (2 * pow(36, k))) <= 0.25), 8) AS k FROM (SELECT count(*) AS n FROM issues), range(3, 9) AS r(k)),
h AS (SELECT id, k, CAST('0x' || substr(sha256(concat_ws('|', title, description, assignee)), 1, 2 * CAST([2, 3, 4, 4, 5, 5][CAST(k - 2 AS INT)] AS INT)) AS BIGINT) AS x FROM issues, k)
SELECT id, 'bd-' || array_to_string(list_transform(range(k - 1, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((x // CAST(pow(36, i) AS BIGINT)) % 36 + 1 AS INT), 1)), '') AS hash_id FROM h""")
def _(t):
    length = work.adaptive_length(t.issues.count())
    return t.issues.select("id", work.hash_id("bd", F.concat_ws("|", "title", "description", "assignee"), length).alias("hash_id"))


@query("T12_state_of", "SELECT issue_id AS id, min(substring(label, 7)) AS value FROM issue_labels WHERE label LIKE 'state:%' GROUP BY 1")
def _(t):
    return work.state_of(t.issue_labels, "state")


@query("T13_failure_close", "SELECT id, regexp_matches(lower(text), 'failed|rejected|wontfix|won''t fix|canceled|cancelled|abandoned|blocked|error|timeout|aborted') AS failed FROM comments")
def _(t):
    return t.comments.select("id", work.failure_close(F.col("text")).alias("failed"))


@query("T14_relative_time", f"SELECT id FROM issues WHERE updated_at >= {T} - INTERVAL 14 DAY AND created_at < TIMESTAMP '2001-07-25 00:00:00'")
def _(t):
    return t.issues.filter((F.col("updated_at") >= F.lit(relative_time("-2w", NOW))) & (F.col("created_at") < F.lit(relative_time("2001-07-25", NOW)))).select("id")


LIVE = """WITH s AS (SELECT issue_id, arg_max(new_value, (created_at, id)) FILTER (event_type = 'status_changed') AS status, count(*) FILTER (event_type = 'status_changed') AS n FROM issue_log GROUP BY 1),
a AS (SELECT issue_id, arg_max(new_value, (created_at, id)) AS label, max((created_at, id)) AS added FROM issue_log WHERE event_type = 'label_added' GROUP BY issue_id, split_part(new_value, ':', 1)),
g AS (SELECT issue_id, new_value AS label, max((created_at, id)) AS gone FROM issue_log WHERE event_type = 'label_removed' GROUP BY 1, 2),
l AS (SELECT issue_id, string_agg(label, ',' ORDER BY label) AS labels FROM a LEFT JOIN g USING (issue_id, label) WHERE gone IS NULL OR gone < added GROUP BY 1)
SELECT issue_id, status, n, coalesce(labels, '') AS labels FROM s LEFT JOIN l USING (issue_id)"""


@query("R5_live_issue_state", LIVE)
def _(t):
    return work.live_state(t.issue_log).withColumn("labels", F.array_join("labels", ","))


@query("R6_ephemeral_expiry", "SELECT event_id, event_type FROM events WHERE (epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts))) / 3600 > CASE event_type WHEN 'error' THEN 168 ELSE 1 END")
def _(t):
    rows = t.events.select("event_id", "event_type", F.col("event_type").alias("wisp_type"), F.col("ts").alias("updated_at"))
    return work.ephemeral_expired(rows, dt.datetime(2024, 1, 31)).select("event_id", "event_type")


@query("R8_gc_closed", f"""WITH gone AS (SELECT id FROM issues WHERE status = 'closed' AND NOT pinned AND closed_at < {T} - INTERVAL 90 DAY)
SELECT issue_id, depends_on_id FROM deps WHERE issue_id NOT IN (SELECT id FROM gone) AND depends_on_id NOT IN (SELECT id FROM gone)""")
def _(t):
    return work.gc_closed(t.issues, t.deps, NOW)[1].select("issue_id", "depends_on_id")


GONE = f"gone AS (SELECT id FROM issues WHERE status = 'closed' AND NOT pinned AND closed_at < {T} - INTERVAL 90 DAY)"


def collected(t):
    return work.gc_closed(t.issues, t.deps, NOW, 90, t.issue_labels, t.comments)


@query("R8_gc_issues", f"WITH {GONE} SELECT id, status FROM issues WHERE id NOT IN (SELECT id FROM gone)")
def _(t):
    return collected(t)[0].select("id", "status")


@query("R8_gc_labels", f"WITH {GONE} SELECT issue_id, label FROM issue_labels WHERE issue_id NOT IN (SELECT id FROM gone)")
def _(t):
    return collected(t)[2]


@query("R8_gc_comments", f"WITH {GONE} SELECT id, issue_id FROM comments WHERE issue_id NOT IN (SELECT id FROM gone)")
def _(t):
    return collected(t)[3].select("id", "issue_id")
