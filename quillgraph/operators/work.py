"""Work graph: issues, typed dependencies, labels, events.

issues: id, title, description, status, priority, issue_type, assignee, created_at, updated_at,
closed_at, defer_until, due_at, pinned, ephemeral, compaction_level, metadata (JSON).
deps: issue_id, depends_on_id, type, metadata. labels: issue_id, label. `now` is a parameter.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import all_of, glob_regex
from ..session import Scratch, prepare

INACTIVE = ("closed", "pinned")
BLOCKING = ("blocks", "conditional-blocks")
#: Types that are no work by themselves (fixed values).
NOT_WORK = ("merge-request", "gate", "molecule", "message", "agent", "role", "rig")


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def active(issues: DataFrame) -> DataFrame:
    return issues.filter(~F.col("status").isin(*INACTIVE))


def direct_blocks(issues: DataFrame, deps: DataFrame, types: Sequence[str] = BLOCKING) -> DataFrame:
    """(issue_id, depends_on_id) of blocking edges with both ends active."""
    on = active(issues).select("id")
    edges = deps.filter(F.col("type").isin(*types)).select("issue_id", "depends_on_id").distinct()
    return edges.join(on.withColumnRenamed("id", "issue_id"), "issue_id", "left_semi").join(on.withColumnRenamed("id", "depends_on_id"), "depends_on_id", "left_semi")


def gate_blocks(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """(issue_id, depends_on_id) of waits-for gates that hold: any child active, or for any-children none closed and one active."""
    gate = F.coalesce(F.get_json_object(F.when(F.col("metadata") != "", F.col("metadata")), "$.gate"), F.lit("all-children"))
    gates = deps.filter("type = 'waits-for'").select("issue_id", "depends_on_id", gate.alias("gate"))
    gates = gates.join(active(issues).select(F.col("id").alias("issue_id")), "issue_id", "left_semi")
    children = deps.filter("type = 'parent-child'").select(F.col("depends_on_id"), F.col("issue_id").alias("child"))
    state = children.join(issues.select(F.col("id").alias("child"), "status"), "child").groupBy("depends_on_id").agg(
        F.max(~F.col("status").isin(*INACTIVE)).alias("any_active"), F.max(F.col("status") == "closed").alias("any_closed")
    )
    held = F.when(F.col("gate") == "any-children", ~F.col("any_closed") & F.col("any_active")).otherwise(F.col("any_active"))
    return gates.join(state, "depends_on_id").filter(held).select("issue_id", "depends_on_id").distinct()


def blocked_ids(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """(id) of active issues that a blocking edge or a gate holds."""
    return direct_blocks(issues, deps).select("issue_id").union(gate_blocks(issues, deps).select("issue_id")).distinct().withColumnRenamed("issue_id", "id")


def children_of(deps: DataFrame, parents: DataFrame) -> DataFrame:
    """(id) one parent-child step below parents (id)."""
    return deps.filter("type = 'parent-child'").join(parents.select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_semi").select(F.col("issue_id").alias("id")).distinct()


def blocked_issues(issues: DataFrame, deps: DataFrame, parent: str | None = None) -> DataFrame:
    """(id, priority, created_at, blocked_by): blocked issues with active targets, and their active children with their parent.

    With a parent, only its direct children; what blocks them may lie elsewhere.
    """
    on = active(issues)
    targets = deps.filter(F.col("type").isin(*BLOCKING, "waits-for")).select("issue_id", "depends_on_id")
    targets = targets.join(on.select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_semi")
    blocked = Scratch(prepare(issues.sparkSession), "blocked").keep(blocked_ids(issues, deps))
    own = targets.join(blocked.withColumnRenamed("id", "issue_id"), "issue_id", "left_semi").select("issue_id", "depends_on_id")
    below = deps.filter("type = 'parent-child'").select("issue_id", "depends_on_id")
    below = below.join(blocked.select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_semi").join(blocked.select(F.col("id").alias("issue_id")), "issue_id", "left_anti")
    by = own.union(below.select("issue_id", "depends_on_id")).groupBy("issue_id").agg(F.sort_array(F.collect_set("depends_on_id")).alias("blocked_by"))
    if parent is not None:
        on = on.join(deps.filter((F.col("type") == "parent-child") & (F.col("depends_on_id") == parent)).select(F.col("issue_id").alias("id")), "id", "left_semi")
    return on.join(by.withColumnRenamed("issue_id", "id"), "id").select("id", "priority", "created_at", "blocked_by").orderBy("priority", F.desc("created_at"), "id")


def ready_work(issues: DataFrame, deps: DataFrame, now: dt.datetime, where: Column | None = None) -> DataFrame:
    """Open work that nothing blocks or defers, one level of parents included."""
    later = F.coalesce(F.col("defer_until") > F.lit(now), F.lit(False))
    open_work = issues.filter(F.col("status").isin("open", "in_progress") & ~flag("pinned") & ~flag("ephemeral") & ~F.col("issue_type").isin(*NOT_WORK) & ~later)
    blocked = Scratch(prepare(issues.sparkSession), "blocked").keep(blocked_ids(issues, deps))
    deferred = issues.filter(later).select("id")
    held = blocked.union(children_of(deps, blocked.union(deferred))).distinct()
    out = open_work.join(held, "id", "left_anti")
    return out.filter(where) if where is not None else out


def ready_order(policy: str, now: dt.datetime) -> list[Column]:
    """hybrid: the last 48 hours by priority, then the rest by age; priority: newest first in each; oldest: by age."""
    if policy == "priority":
        return [F.asc("priority"), F.desc("created_at"), F.asc("id")]
    if policy == "oldest":
        return [F.asc("created_at"), F.asc("id")]
    recent = F.col("created_at") >= F.lit(now - dt.timedelta(hours=48))
    return [F.when(recent, 0).otherwise(1).asc(), F.when(recent, F.col("priority")).otherwise(999).asc(), F.asc("created_at"), F.asc("id")]


SORTS = {
    "priority": [F.asc, "priority"], "created": [F.desc, "created_at"], "updated": [F.desc, "updated_at"], "closed": [F.desc_nulls_last, "closed_at"], "status": [F.asc, "status"],
    "id": [F.asc, "id"], "title": [F.asc, "title"], "type": [F.asc, "issue_type"], "assignee": [F.asc, "assignee"],
}


def sort_issues(issues: DataFrame, field: str, reverse: bool = False) -> DataFrame:
    """Priority and text ascending, times newest first, unclosed last; ties by id."""
    order, name = SORTS[field]
    column = F.lower(name) if field in ("title", "assignee", "status", "type") else F.col(name)
    first = order(name) if not reverse and field not in ("title", "assignee", "status", "type") else (column.asc() if (order is F.asc) != reverse else column.desc())
    return issues.orderBy(first, "id")


def ready_explanation(issues: DataFrame, deps: DataFrame, now: dt.datetime) -> DataFrame:
    """(id, ready, n_resolved, n_blockers, reason, parent) of open issues."""
    ready = ready_work(issues, deps, now).select("id", F.lit(True).alias("ready"))
    ends = deps.filter(F.col("type").isin(*BLOCKING)).join(issues.select(F.col("id").alias("depends_on_id"), F.col("status").alias("target")), "depends_on_id")
    counts = ends.groupBy(F.col("issue_id").alias("id")).agg(
        F.sum((F.col("target") == "closed").cast("bigint")).alias("n_resolved"), F.sum((~F.col("target").isin(*INACTIVE)).cast("bigint")).alias("n_blockers")
    )
    parents = deps.filter("type = 'parent-child'").groupBy(F.col("issue_id").alias("id")).agg(F.min("depends_on_id").alias("parent"))
    out = issues.filter(F.col("status").isin("open", "in_progress")).select("id").join(counts, "id", "left").join(ready, "id", "left").join(parents, "id", "left")
    resolved, blockers = F.coalesce("n_resolved", F.lit(0)), F.coalesce("n_blockers", F.lit(0))
    reason = (
        F.when(~flag("ready"), F.concat(F.lit("blocked by "), blockers.cast("string"), F.lit(" issue(s)")))
        .when(resolved > 0, F.concat(resolved.cast("string"), F.lit(" blocker(s) resolved")))
        .otherwise("no blocking dependencies")
    )
    return out.select("id", flag("ready").alias("ready"), resolved.cast("bigint").alias("n_resolved"), blockers.cast("bigint").alias("n_blockers"), reason.alias("reason"), "parent")


def ready_items(issues: DataFrame, deps: DataFrame, now: dt.datetime) -> DataFrame:
    """(id, reason, resolved_blockers, dependencies, dependents, parent) of ready work: what it once waited for, and its counts of blocks edges."""
    kind = F.col("type")
    # one pass by issue and one by target, not one for each column
    own = deps.filter(kind.isin(*BLOCKING, "waits-for", "parent-child")).groupBy(F.col("issue_id").alias("id")).agg(
        F.sort_array(F.collect_set(F.when(kind.isin(*BLOCKING, "waits-for"), F.col("depends_on_id")))).alias("resolved"),
        F.count_if(kind == "blocks").alias("dependencies"), F.min(F.when(kind == "parent-child", F.col("depends_on_id"))).alias("parent"),
    )
    into = deps.filter("type = 'blocks'").groupBy(F.col("depends_on_id").alias("id")).agg(F.count("*").alias("dependents"))
    rows = ready_work(issues, deps, now).select("id").join(own, "id", "left").join(into, "id", "left")
    resolved = F.coalesce("resolved", F.array().cast("array<string>"))
    reason = F.when(F.size(resolved) > 0, F.concat(F.size(resolved).cast("string"), F.lit(" blocker(s) resolved"))).otherwise("no blocking dependencies")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", reason.alias("reason"), resolved.alias("resolved_blockers"), count("dependencies"), count("dependents"), "parent")


def blocked_items(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, n_blockers, blockers) of blocked issues, blockers as (id, title, status, priority) by id; null details of an unknown one."""
    by = blocked_issues(issues, deps).select("id", F.explode("blocked_by").alias("by"))
    details = issues.select(F.col("id").alias("by"), "title", "status", "priority")
    one = F.struct(F.col("by").alias("id"), "title", "status", "priority")
    return by.join(details, "by", "left").groupBy("id").agg(F.count("*").alias("n_blockers"), F.sort_array(F.collect_list(one)).alias("blockers"))


def explanation_summary(ready: DataFrame, blocked: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row (total_ready, total_blocked, n_cycles) of ready and blocked items and of cycles (id, component)."""
    part = lambda df, name, column: df.select(F.lit(name).alias("part"), F.col(column).alias("key"))
    rows = part(ready, "ready", "id").union(part(blocked, "blocked", "id")).union(part(cycles.select("component").distinct(), "cycle", "component"))
    return rows.agg(*(F.count_if(F.col("part") == p).alias(n) for p, n in (("ready", "total_ready"), ("blocked", "total_blocked"), ("cycle", "n_cycles"))))


def blocked_view(issues: DataFrame, deps: DataFrame, inactive: Sequence[str]) -> DataFrame:
    """(id, blocked_by_count) by blocks edges, with custom statuses of category done or frozen as inactive."""
    on = issues.filter(~F.col("status").isin(*INACTIVE, *inactive)).select("id")
    edges = deps.filter("type = 'blocks'").join(on.select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_semi")
    return edges.join(on.select(F.col("id").alias("issue_id")), "issue_id", "left_semi").groupBy(F.col("issue_id").alias("id")).agg(F.count("*").alias("blocked_by_count"))


# filters


PREDICATES = {
    "text", "title_contains", "description_contains", "notes_contains", "status", "not_status", "types", "not_types", "assignee", "priority", "priority_min", "priority_max", "ids", "id_prefix",
    "parent", "no_parent", "labels_all", "labels_any", "no_labels", "label_glob", "label_regex", "pinned", "ephemeral", "empty_description", "no_assignee", "deferred", "overdue", "has_metadata", "metadata",
    *(f"{time}_{side}" for time in ("created", "updated", "closed", "defer", "due") for side in ("after", "before")),
}


def filter_issues(issues: DataFrame, deps: DataFrame, labels: DataFrame, **spec) -> DataFrame:
    """Predicates by name; all hold.

    text, title/description/notes_contains, status, not_status, types, not_types, assignee,
    priority, priority_min, priority_max, ids, id_prefix, parent, no_parent, labels_all, labels_any,
    no_labels, label_glob, label_regex, pinned, ephemeral, empty_description, no_assignee,
    created/updated/closed/defer/due_after/_before, deferred, overdue (its now), has_metadata, metadata.
    Another name raises an error.
    """
    if unknown := [key for key in spec if key not in PREDICATES]:
        raise ValueError(f"unknown predicates: {', '.join(unknown)}")
    tests: list[Column] = []
    for key, value in spec.items():
        match key:
            case "text":
                tests.append(F.lower("id").contains(value.lower()) | F.lower("title").contains(value.lower()))
            case "title_contains" | "description_contains" | "notes_contains":
                tests.append(F.lower(key.split("_")[0]).contains(value.lower()))
            case "status":
                tests.append(F.col("status").isin(*([value] if isinstance(value, str) else value)))
            case "not_status":
                tests.append(~F.col("status").isin(*value))
            case "types":
                tests.append(F.col("issue_type").isin(*value))
            case "not_types":
                tests.append(~F.col("issue_type").isin(*value))
            case "assignee" | "priority":
                tests.append(F.col(key) == value)
            case "priority_min":
                tests.append(F.col("priority") >= value)
            case "priority_max":
                tests.append(F.col("priority") <= value)
            case "ids":
                tests.append(F.col("id").isin(*value))
            case "id_prefix":
                tests.append(F.col("id").startswith(value))
            case "pinned" | "ephemeral":
                tests.append(flag(key) == value)
            case "empty_description":
                tests.append(F.coalesce(F.col("description"), F.lit("")) == "")
            case "no_assignee":
                tests.append(F.coalesce(F.col("assignee"), F.lit("")) == "")
            case "deferred":
                tests.append(F.col("defer_until").isNotNull())
            case "overdue":
                tests.append((F.col("due_at") < F.lit(value)) & (F.col("status") != "closed"))
            case "has_metadata":
                tests.append(F.get_json_object("metadata", f"$.{value}").isNotNull())
            case "metadata":
                tests += [F.get_json_object("metadata", f"$.{k}") == str(v) for k, v in value.items()]
            case _ if key.endswith(("_after", "_before")):
                name, side = key.rsplit("_", 1)
                column = F.col({"defer": "defer_until"}.get(name, f"{name}_at"))
                tests.append(column > F.lit(value) if side == "after" else column < F.lit(value))
    out = issues.filter(all_of(tests)) if tests else issues
    edges = deps.filter("type = 'parent-child'")
    tagged = labels.select(F.col("issue_id").alias("id"), "label")
    if "parent" in spec:
        below = edges.filter(F.col("depends_on_id") == spec["parent"]).select(F.col("issue_id").alias("id"))
        dotted = issues.filter(F.col("id").startswith(spec["parent"] + ".")).select("id")
        out = out.join(below.union(dotted), "id", "left_semi")
    if spec.get("no_parent"):
        out = out.join(edges.select(F.col("issue_id").alias("id")), "id", "left_anti")
    if spec.get("labels_all"):
        wanted = list(dict.fromkeys(spec["labels_all"]))
        has = tagged.filter(F.col("label").isin(*wanted)).groupBy("id").agg(F.countDistinct("label").alias("n")).filter(F.col("n") == len(wanted))
        out = out.join(has, "id", "left_semi")
    if spec.get("labels_any"):
        out = out.join(tagged.filter(F.col("label").isin(*spec["labels_any"])), "id", "left_semi")
    if spec.get("label_glob"):
        out = out.join(tagged.filter(F.col("label").rlike(glob_regex(spec["label_glob"]))), "id", "left_semi")
    if spec.get("label_regex"):
        out = out.join(tagged.filter(F.col("label").rlike(spec["label_regex"])), "id", "left_semi")
    if spec.get("no_labels"):
        out = out.join(tagged, "id", "left_anti")
    return out


def merge_ephemeral(permanent: DataFrame, ephemeral: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; the permanent one wins on a key."""
    return permanent.unionByName(ephemeral.join(permanent.select(key), key, "left_anti"))


# joins


def newly_unblocked(issues: DataFrame, deps: DataFrame, closed: DataFrame) -> DataFrame:
    """(id) of active issues that a closed one (id) blocked and that have no other active blocker."""
    blocks = deps.filter("type = 'blocks'").select("issue_id", "depends_on_id")
    touched = blocks.join(closed.select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_semi").select(F.col("issue_id").alias("id")).distinct()
    still = active(issues).select("id").join(closed, "id", "left_anti").withColumnRenamed("id", "depends_on_id")
    held = blocks.join(still, "depends_on_id", "left_semi").select(F.col("issue_id").alias("id"))
    return active(issues).select("id").join(touched, "id", "left_semi").join(closed, "id", "left_anti").join(held, "id", "left_anti")


def blocking_info(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, blocked_by, blocks, parent) of issues with any; closed blockers do not count."""
    on = issues.filter("status <> 'closed'").select("id")
    edges = deps.filter("type = 'blocks'").select("issue_id", "depends_on_id")
    edges = edges.join(on.withColumnRenamed("id", "depends_on_id"), "depends_on_id", "left_semi")
    by = edges.groupBy(F.col("issue_id").alias("id")).agg(F.sort_array(F.collect_set("depends_on_id")).alias("blocked_by"))
    to = edges.groupBy(F.col("depends_on_id").alias("id")).agg(F.sort_array(F.collect_set("issue_id")).alias("blocks"))
    parent = deps.filter("type = 'parent-child'").groupBy(F.col("issue_id").alias("id")).agg(F.min("depends_on_id").alias("parent"))
    return by.join(to, "id", "full").join(parent, "id", "full")


def upsert(state: DataFrame, changes: DataFrame, key: str, update: bool = True) -> DataFrame:
    """State with changes by key: replaced and added, or with update=False only added."""
    if update:
        return state.join(changes.select(key), key, "left_anti").unionByName(changes)
    return state.unionByName(changes.join(state.select(key), key, "left_anti"))


def sync_conflicts(local: DataFrame, external: DataFrame, last_sync: dt.datetime | None) -> DataFrame:
    """Rows changed on both sides after the last sync: (id, local_updated, external_updated)."""
    both = local.select("id", F.col("updated_at").alias("local_updated")).join(external.select("id", F.col("updated_at").alias("external_updated")), "id")
    return both.filter(F.lit(False)) if last_sync is None else both.filter((F.col("local_updated") > F.lit(last_sync)) & (F.col("external_updated") > F.lit(last_sync)))


def resolve_conflicts(conflicts: DataFrame, strategy: str) -> DataFrame:
    """(id, action): push the local row or pull the external one; by time, local wins only if strictly newer."""
    push = {"local": F.lit(True), "external": F.lit(False)}.get(strategy, F.col("local_updated") > F.col("external_updated"))
    return conflicts.select("id", F.when(push, "push").otherwise("pull").alias("action"))


def pull_merge(local: DataFrame, external: DataFrame, fields: Sequence[str], last_sync: dt.datetime, overwrite: bool = False) -> DataFrame:
    """(id, action) for external rows: create, skip (identical, or local newer than the last sync) or update."""
    mine = local.select("id", F.col("updated_at").alias("mine_at"), F.struct(*fields).alias("mine"), F.lit(True).alias("known"))
    both = external.select("id", F.struct(*fields).alias("theirs")).join(mine, "id", "left")
    newer = F.lit(False) if overwrite else F.col("mine_at") > F.lit(last_sync)
    action = F.when(F.col("known").isNull(), "create").when(F.col("mine").eqNullSafe(F.col("theirs")) | newer, "skip").otherwise("update")
    return both.select("id", action.alias("action"))


def orphaned_dependencies(issues: DataFrame, deps: DataFrame) -> DataFrame:
    return deps.filter(~F.col("depends_on_id").startswith("external:")).join(issues.select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_anti")


def orphaned_by_commits(issues: DataFrame, commits: DataFrame, prefix: str) -> DataFrame:
    """Open issues named as (prefix-n) in a commit message, with the newest such commit."""
    found = commits.select("hash", "committed_at", F.explode(F.regexp_extract_all("message", F.lit(rf"\(({prefix}-[0-9a-z.]+)\)"), F.lit(1))).alias("id"))
    newest = found.groupBy("id").agg(F.max(F.struct("committed_at", "hash")).alias("c"))
    return issues.filter(F.col("status").isin("open", "in_progress")).select("id", "status").join(newest, "id").select("id", "status", F.col("c.hash").alias("hash"), F.col("c.committed_at").alias("committed_at"))


def as_of(history: DataFrame, at: dt.datetime, key: str = "id") -> DataFrame:
    """The newest row of each key at a time; ties by seq."""
    rows = history.filter(F.col("commit_date") <= F.lit(at))
    others = [c for c in history.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct("commit_date", "seq", *(c for c in others if c not in ("commit_date", "seq")))).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in others))


def diff(history: DataFrame, start: dt.datetime, end: dt.datetime, fields: Sequence[str], key: str = "id") -> DataFrame:
    """(id, change, old_*, new_*): added, removed or modified between two times."""
    old = as_of(history, start, key).select(key, F.struct(*fields).alias("old"))
    new = as_of(history, end, key).select(key, F.struct(*fields).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    both = old.join(new, key, "full").withColumn("change", change).filter("change IS NOT NULL")
    return both.select(key, "change", *(F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("old", "new") for f in fields))


def missing_parents(ids: DataFrame, mode: str = "strict") -> DataFrame:
    """Dotted ids: strict gives those whose parent is absent, skip gives all others, allow gives all."""
    if mode == "allow":
        return ids
    parent = F.regexp_extract("id", r"^(.*)\.[^.]+$", 1)
    with_parent = ids.withColumn("parent", F.when(parent != "", parent))
    known = ids.select(F.col("id").alias("parent"))
    missing = with_parent.filter("parent IS NOT NULL").join(known, "parent", "left_anti")
    return missing.select(*ids.columns) if mode == "strict" else ids.join(missing.select("id"), "id", "left_anti")


# aggregates


def issue_statistics(issues: DataFrame, deps: DataFrame, *by: str) -> DataFrame:
    """Counts by status, blocked, ready = open - blocked (never below 0), epics to close, mean lead time in hours; overall or by columns."""
    blocked = blocked_ids(issues, deps).withColumn("is_blocked", F.lit(True))
    epics = epic_status(issues, deps).filter("eligible").select("id", F.lit(True).alias("closable"))
    rows = issues.join(blocked, "id", "left").join(epics, "id", "left")
    count = lambda test: F.coalesce(F.sum(test.cast("bigint")), F.lit(0))
    status = F.col("status")
    lead = F.avg(F.when(status == "closed", (F.unix_timestamp("closed_at") - F.unix_timestamp("created_at")) / 3600))
    n_open, n_blocked = count(status == "open"), count(flag("is_blocked"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"), n_open.alias("open"), count(status == "in_progress").alias("in_progress"), count(status == "closed").alias("closed"),
        count(status == "deferred").alias("deferred"), count(flag("pinned")).alias("pinned"), n_blocked.alias("blocked"),
        F.greatest(F.lit(0), n_open - n_blocked).alias("ready"), count(flag("closable")).alias("epics_eligible"), F.round(lead, 6).alias("lead_time_hours"),
    )


def count_by(issues: DataFrame, labels: DataFrame, dim: str) -> DataFrame:
    """(group, n) by status, priority (P<n>), type, assignee or label."""
    if dim == "label":
        rows = issues.select("id").join(labels.select(F.col("issue_id").alias("id"), "label"), "id", "left").select(F.coalesce("label", F.lit("(no labels)")).alias("group"))
    else:
        rows = issues.select({
            "status": F.col("status"), "priority": F.concat(F.lit("P"), F.col("priority").cast("string")), "type": F.col("issue_type"),
            "assignee": F.when(F.coalesce(F.col("assignee"), F.lit("")) == "", "(unassigned)").otherwise(F.col("assignee")),
        }[dim].alias("group"))
    return rows.groupBy("group").agg(F.count("*").alias("n")).orderBy("group")


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.countDistinct("issue_id").alias("n")).orderBy("label")


def dependency_counts(deps: DataFrame) -> DataFrame:
    """(id, dependencies, dependents) over blocks edges."""
    blocks = deps.filter("type = 'blocks'")
    out = blocks.groupBy(F.col("issue_id").alias("id")).agg(F.count("*").alias("dependencies"))
    into = blocks.groupBy(F.col("depends_on_id").alias("id")).agg(F.count("*").alias("dependents"))
    return out.join(into, "id", "full").select("id", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


def epic_status(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, total, closed, eligible) of open epics with children."""
    epics = issues.filter((F.col("issue_type") == "epic") & (F.col("status") != "closed")).select("id")
    children = deps.filter("type = 'parent-child'").select(F.col("depends_on_id").alias("id"), F.col("issue_id").alias("child"))
    states = children.join(epics, "id", "left_semi").join(issues.select(F.col("id").alias("child"), "status"), "child")
    done = F.sum((F.col("status") == "closed").cast("bigint"))
    return states.groupBy("id").agg(F.count("*").alias("total"), done.alias("closed"), (F.count("*") == done).alias("eligible"))


def molecule_progress(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """Progress of every parent: counts, first issue under way, percent, rate an hour and hours left."""
    children = deps.filter("type = 'parent-child'").select(F.col("depends_on_id").alias("id"), F.col("issue_id").alias("child"))
    rows = children.join(issues.select(F.col("id").alias("child"), "status", "closed_at"), "child")
    done = F.sum((F.col("status") == "closed").cast("bigint"))
    out = rows.groupBy("id").agg(
        F.count("*").alias("total"), done.alias("completed"), F.sum((F.col("status") == "in_progress").cast("bigint")).alias("in_progress"),
        F.min(F.when(F.col("status") == "in_progress", F.col("child"))).alias("current"),
        ((F.max(F.unix_timestamp("closed_at")) - F.min(F.unix_timestamp("closed_at"))) / 3600).alias("hours"),
    )
    rate = F.when((F.col("completed") > 1) & (F.col("hours") > 0), (F.col("completed") - 1) / F.col("hours"))
    return out.select("id", "total", "completed", "in_progress", "current", F.round(100 * F.col("completed") / F.col("total"), 6).alias("percent"), F.round(rate, 6).alias("rate"), F.round((F.col("total") - F.col("completed")) / rate, 6).alias("eta_hours"))


def molecule_last_activity(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, last_activity, source): the newest child update, or child close if strictly newer; without children the own update."""
    children = deps.filter("type = 'parent-child'").select(F.col("depends_on_id").alias("id"), F.col("issue_id").alias("child"))
    rows = children.join(issues.select(F.col("id").alias("child"), F.col("updated_at").alias("u"), F.col("closed_at").alias("c")), "child").groupBy("id").agg(F.max("u").alias("u"), F.max("c").alias("c"))
    out = issues.select("id", "updated_at").join(rows, "id", "left")
    closed = F.coalesce(F.col("c") > F.col("u"), F.lit(False))
    return out.select("id", F.when(closed, F.col("c")).otherwise(F.coalesce("u", "updated_at")).alias("last_activity"), F.when(F.col("u").isNull(), "own_updated").when(closed, "child_closed").otherwise("child_updated").alias("source"))


def exact_duplicates(issues: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(fields, n, first_id, surplus) of groups with equal fields."""
    digest = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(f).cast("string"), F.lit("\1")) for f in fields)), 256)
    groups = issues.groupBy(digest.alias("digest"), *fields).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return groups.filter("n > 1").select(*fields, "n", "first_id", (F.col("n") - 1).alias("surplus"))


def child_counters(issues: DataFrame) -> DataFrame:
    """(parent, last_child) from dotted ids whose parent exists."""
    parts = issues.select(F.regexp_extract("id", r"^(.*)\.(\d+)$", 1).alias("parent"), F.regexp_extract("id", r"^(.*)\.(\d+)$", 2).alias("n")).filter("parent <> ''")
    return parts.join(issues.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy("parent").agg(F.max(F.col("n").cast("int")).alias("last_child"))


def prefix_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(F.regexp_extract("id", r"^([a-z]+)-", 1).alias("prefix")).agg(F.count("*").alias("n"))


def stale_issues(issues: DataFrame, now: dt.datetime, days: int, status: Sequence[str] = ("open", "in_progress")) -> DataFrame:
    old = F.col("updated_at") < F.lit(now - dt.timedelta(days=days))
    return issues.filter(old & F.col("status").isin(*status) & ~flag("ephemeral")).orderBy("updated_at", "id")


def compaction_candidates(issues: DataFrame, deps: DataFrame, now: dt.datetime, tier: int) -> DataFrame:
    """Closed issues to compact: (id, closed_at, size, estimate, dependents); tier 1 after 30 days at level 0, tier 2 after 90 at level 1."""
    days = {1: 30, 2: 90}[tier]
    level = F.coalesce(F.col("compaction_level"), F.lit(0)) == tier - 1
    old = issues.filter((F.col("status") == "closed") & level & (F.col("closed_at") <= F.lit(now - dt.timedelta(days=days))))
    texts = [c for c in ("description", "design", "notes", "acceptance_criteria") if c in issues.columns]
    size = sum((F.coalesce(F.char_length(c), F.lit(0)) for c in texts), F.lit(0))
    counts = deps.filter("type = 'blocks'").groupBy(F.col("depends_on_id").alias("id")).agg(F.count("*").alias("dependents"))
    return old.select("id", "closed_at", size.alias("size"), F.floor(size * 3 / 10).cast("int").alias("estimate")).join(counts, "id", "left").fillna(0, ["dependents"])


def swarm_status(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """Children of every epic by state: completed, active, ready, blocked (by open issues of the same epic), percent."""
    epics = issues.filter("issue_type = 'epic'").select(F.col("id").alias("epic"))
    children = deps.filter("type = 'parent-child'").select(F.col("depends_on_id").alias("epic"), F.col("issue_id").alias("id")).join(epics, "epic", "left_semi")
    states = children.join(issues.select("id", "status"), "id")
    inside = deps.filter(F.col("type").isin(*BLOCKING)).select(F.col("issue_id").alias("id"), "depends_on_id")
    waiting = (
        states.filter("status <> 'closed'").select("epic", F.col("id").alias("depends_on_id")).join(inside, "depends_on_id").join(states.select("epic", "id"), ["epic", "id"], "left_semi").select("epic", "id").distinct()
    )
    rows = states.join(waiting.withColumn("waits", F.lit(True)), ["epic", "id"], "left")
    status, waits = F.col("status"), flag("waits")
    count = lambda t: F.sum(t.cast("bigint"))
    return rows.groupBy("epic").agg(
        F.count("*").alias("total"), count(status == "closed").alias("completed"), count(status == "in_progress").alias("active"),
        count(~status.isin("closed", "in_progress") & ~waits).alias("ready"), count(~status.isin("closed", "in_progress") & waits).alias("blocked"),
        F.round(100 * count(status == "closed") / F.count("*"), 6).alias("percent"),
    )


def stale_molecules(issues: DataFrame, deps: DataFrame, blocking_only: bool = False, unassigned_only: bool = False) -> DataFrame:
    """(id, title, assignee, total, closed, blocking, n_blocking): epics that could be closed, with the issues that they block.

    blocking_only leaves those that block something, unassigned_only those with a null or empty assignee.
    """
    closable = epic_status(issues, deps).filter("eligible").join(issues.select("id", "title", "assignee"), "id")
    if unassigned_only:
        closable = closable.filter(F.coalesce("assignee", F.lit("")) == "")
    held = blocked_issues(issues, deps).select(F.col("id").alias("held"), F.explode("blocked_by").alias("id"))
    blocking = held.groupBy("id").agg(F.sort_array(F.collect_set("held")).alias("blocking"))
    rows = closable.join(blocking, "id", "inner" if blocking_only else "left").withColumn("blocking", F.coalesce("blocking", F.array().cast("array<string>")))
    return rows.select("id", "title", "assignee", "total", "closed", "blocking", F.size("blocking").cast("bigint").alias("n_blocking"))


def merge_duplicates(issues: DataFrame, deps: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, target): for groups of equal fields the row to keep, by 3 * dependents + dependencies, then text references, then least id."""
    counts = dependency_counts(deps)
    refs = text_reference_counts(issues)
    rows = issues.join(counts, "id", "left").join(refs, "id", "left")
    weight = 3 * F.coalesce("dependents", F.lit(0)) + F.coalesce("dependencies", F.lit(0))
    # one row a group, by partial aggregation; nulls are equal
    best = F.min(F.struct((-weight).alias("w"), (-F.coalesce("refs", F.lit(0))).alias("r"), "id"))["id"]
    # and a number first, as long texts compare slowly in the sort that a least struct takes
    groups = rows.groupBy(F.xxhash64(*fields).alias("_place"), *(F.col(f).alias(f"_{f}") for f in fields)).agg(best.alias("target"), F.count("*").alias("n")).filter("n > 1")
    same = reduce(and_, (F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields))
    return issues.join(groups, same).filter("id <> target").select("id", "target")


def _resolved(plan: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, target) with each target followed until it is no source itself; pointers double. A circle of sources has no target."""
    now = scratch.keep(plan.select("id", "target").filter("id <> target").groupBy("id").agg(F.min("target").alias("target")))
    going = before = None
    while going is None or (going and going != before):
        ahead = now.select(F.col("id").alias("target"), F.col("target").alias("further"))
        after = scratch.keep(now.join(ahead, "target", "left").select("id", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        before, going = going, after.filter("moved").count()
        now = after.select("id", "target")
    return now if not going else now.join(now.select(F.col("id").alias("target")), "target", "left_anti").select("id", "target")


def apply_merge(issues: DataFrame, deps: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A plan (id, target) carried out: issues, dependencies, and (child, source, target) of children with a new parent.

    Children of a source go to its target; a target that was its source's child loses that link. Sources
    are closed with the reason `Duplicate of <target>` and get a related link to the target. Of several
    links between two issues the one that was there stays, then a new parent, then the related one.
    """
    scratch = Scratch(prepare(issues.sparkSession), "merge")
    known = _resolved(plan, scratch).join(issues.select("id"), "id", "left_semi")
    source = known.select(F.col("id").alias("depends_on_id"), "target")
    rows = deps.join(source, "depends_on_id", "left")
    moves = (F.col("type") == "parent-child") & F.col("target").isNotNull()
    names = [c for c in deps.columns if c not in ("issue_id", "depends_on_id")]
    stay = rows.filter(~F.coalesce(moves, F.lit(False))).select("issue_id", "depends_on_id", F.lit(0).alias("rank"), *names)
    moved = rows.filter(moves & (F.col("issue_id") != F.col("target"))).select("issue_id", F.col("target").alias("depends_on_id"), F.lit(1), *names)
    related = known.select(F.col("id").alias("issue_id"), F.col("target").alias("depends_on_id"), F.lit(2), *(F.lit("related" if c == "type" else None).cast(deps.schema[c].dataType).alias(c) for c in names))
    # shuffled as they are and sorted once: links hardly ever meet, so reducing them before would sort all of them for nothing
    links = stay.union(moved).union(related).repartition("issue_id", "depends_on_id").groupBy("issue_id", "depends_on_id").agg(F.min(F.struct("rank", *names)).alias("one")).select("issue_id", "depends_on_id", *(F.col(f"one.{c}").alias(c) for c in names))
    merged = issues.join(known, "id", "left")
    gone = F.col("target").isNotNull()
    reason = F.when(gone, F.concat(F.lit("Duplicate of "), "target")).otherwise(F.col("close_reason") if "close_reason" in issues.columns else F.lit(None).cast("string"))
    closed = merged.withColumn("close_reason", reason).withColumn("status", F.when(gone, "closed").otherwise(F.col("status"))).drop("target")
    children = rows.filter(moves & (F.col("issue_id") != F.col("target"))).select(F.col("issue_id").alias("child"), F.col("depends_on_id").alias("source"), "target")
    return closed, links, children


def text_reference_counts(issues: DataFrame) -> DataFrame:
    """(id, refs): how often each issue id stands in texts of all issues."""
    texts = F.concat_ws("\n", "title", "description")
    found = issues.select(F.explode(F.regexp_extract_all(texts, F.lit(r"\b[a-zA-Z][-a-zA-Z0-9]*-\d+\b"), F.lit(0))).alias("id"))
    return found.groupBy("id").agg(F.count("*").alias("refs"))


# state changes


def promote_ephemeral(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """Issues with the ephemeral flag off for the given ids."""
    return issues.join(ids.select("id", F.lit(True).alias("promoted")), "id", "left").withColumn("ephemeral", F.when(F.col("promoted"), False).otherwise(F.col("ephemeral"))).drop("promoted")


#: What moves with a promoted issue: the column that names the issue, and the columns that tell rows apart.
MOVING = {
    "issues": ("id", ("id",)), "labels": ("issue_id", ("issue_id", "label")), "dependencies": ("issue_id", ("issue_id", "depends_on_id")),
    "events": ("issue_id", ("id",)), "comments": ("issue_id", ("id",)),
}


def promote(ids: DataFrame, permanent: dict[str, DataFrame], ephemeral: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Both sides, by names of MOVING, after the given ephemeral issues (id) and what belongs to them moved to the permanent side.

    A row that the permanent side has already, by its key, is left as it is there; the ephemeral one goes all the same.
    Ids that are no ephemeral issue move nothing.
    """
    known = ids.select("id").join(ephemeral["issues"].select("id"), "id", "left_semi").distinct()
    after, left = {}, {}
    for name, (owner, key) in MOVING.items():
        if name not in ephemeral:
            continue
        of_them = known.select(F.col("id").alias(owner))
        # only rows of the issues that move can be there already; all others need not be sorted by the whole key
        there = permanent[name].join(of_them, owner, "left_semi").select(*key)
        moved = ephemeral[name].join(of_them, owner, "left_semi").dropDuplicates(list(key)).join(there, list(key), "left_anti")
        if name == "issues":
            moved = moved.withColumn("ephemeral", F.lit(False))
        after[name] = permanent[name].unionByName(moved)
        left[name] = ephemeral[name].join(of_them, owner, "left_anti")
    return after, left


def rename_prefix(df: DataFrame, old: str, new: str, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).startswith(f"{old}-"), F.concat(F.lit(f"{new}-"), F.substring(c, len(old) + 2, 1 << 30))).otherwise(F.col(c)))
    return df


def gc_closed(issues: DataFrame, deps: DataFrame, now: dt.datetime, days: int = 90, *of_issues: DataFrame) -> tuple[DataFrame, ...]:
    """Issues and dependencies without those closed, unpinned and older than days; then each further table (issue_id), say labels and comments, without their rows."""
    gone = issues.filter((F.col("status") == "closed") & ~flag("pinned") & (F.col("closed_at") < F.lit(now - dt.timedelta(days=days)))).select("id")
    without = lambda df, *columns: reduce(lambda d, c: d.join(gone.select(F.col("id").alias(c)), c, "left_anti"), columns, df)
    return without(issues, "id"), without(deps, "issue_id", "depends_on_id"), *(without(df, "issue_id") for df in of_issues)


# quality of issues

#: Sections that a description must name, by type (fixed values).
SECTIONS = {
    "bug": ["steps to reproduce", "acceptance criteria"],
    "task": ["acceptance criteria"],
    "feature": ["acceptance criteria"],
    "story": ["acceptance criteria"],
    "epic": ["success criteria"],
    "decision": ["decision", "rationale", "alternatives considered"],
    "spike": ["goal", "findings"],
}

#: Words in a close reason that mean failure (fixed values).
FAILURES = ("failed", "rejected", "wontfix", "won't fix", "canceled", "cancelled", "abandoned", "blocked", "error", "timeout", "aborted")


def lint_issues(issues: DataFrame) -> DataFrame:
    """(id, missing): required sections that an issue lacks; a filled acceptance field stands for its section."""
    wanted = F.create_map(*(x for k, v in SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    filled = F.coalesce(F.col("acceptance_criteria"), F.lit("")) != "" if "acceptance_criteria" in issues.columns else F.lit(False)
    text = F.lower(F.coalesce("description", F.lit("")))
    missing = F.filter(wanted[F.col("issue_type")], lambda s: ~F.contains(text, s) & ~(filled & s.isin("acceptance criteria", "success criteria")))
    return issues.select("id", missing.alias("missing")).filter(F.size("missing") > 0)


def rapid_creation(issues: DataFrame, least: int = 10) -> DataFrame:
    """Issues of minutes with at least `least` of them: (id, in_minute)."""
    minute = F.date_trunc("minute", "created_at").alias("minute")
    busy = issues.groupBy(minute).agg(F.count("*").alias("in_minute")).filter(F.col("in_minute") >= least)
    return issues.select("id", minute).join(busy, "minute").select("id", "in_minute")


def pollution_score(issues: DataFrame) -> DataFrame:
    """(id, score, reasons) of issues that look like tests, from 0.7 on."""
    minute = F.date_trunc("minute", "created_at").alias("minute")
    busy = issues.groupBy(minute).agg(F.count("*").alias("busy")).filter("busy >= 10")
    title, text = F.lower("title"), F.coalesce(F.col("description"), F.lit(""))
    short = F.octet_length(text) < 20
    signs = [
        (title.rlike(r"^(test|benchmark|sample|tmp|temp|debug|dummy)[-_\s]"), 0.7, F.lit("Title starts with test prefix")),
        (F.col("id").rlike(r"^[a-z]+-\d+$") & short, 0.4, F.lit("Sequential ID with minimal description")),
        (F.trim(text) == "", 0.2, F.lit("No description")),
        ((F.trim(text) != "") & short, 0.1, F.lit("Very short description")),
        (F.col("busy") >= 10, 0.3, F.concat(F.lit("Created with "), (F.col("busy") - 1).cast("string"), F.lit(" other issues in same minute"))),
        (title.contains("issue for testing") | title.contains("test issue") | title.contains("sample issue"), 0.5, F.lit("Generic test title")),
    ]
    score = sum((F.when(t, F.lit(v)).otherwise(0.0) for t, v, _ in signs), F.lit(0.0))
    reasons = F.array_compact(F.array(*(F.when(t, r) for t, _, r in signs)))
    return issues.withColumn("minute", minute).join(busy, "minute", "left").select("id", F.round(score, 6).alias("score"), reasons.alias("reasons")).filter("score >= 0.7")


def content_hash(fields: Sequence[str]) -> Column:
    """SHA-256 of the fields in order, each with a NUL after it."""
    return F.sha2(F.concat(*(x for f in fields for x in (F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\0")))), 256)


def adaptive_length(n: int, least: int = 3, most: int = 8, risk: float = 0.25) -> int:
    """The shortest id length at which two of n ids are equal with a probability of at most risk."""
    return next((k for k in range(least, most + 1) if -math.expm1(-n * n / (2 * 36.0**k)) <= risk), most)


def hash_id(prefix: str, content: Column, length: int) -> Column:
    """prefix-xxx in base 36 from leading bytes of SHA-256."""
    digits = {3: 2, 4: 3, 5: 4, 6: 4, 7: 5, 8: 5}.get(length, 3) * 2
    number = F.lower(F.conv(F.substring(F.sha2(content, 256), 1, digits), 16, 36))
    return F.concat(F.lit(f"{prefix}-"), F.right(F.lpad(number, 32, "0"), F.lit(length)))


def state_of(labels: DataFrame, dimension: str) -> DataFrame:
    """(id, value) of labels dimension:value; of several the least."""
    rows = labels.filter(F.col("label").startswith(f"{dimension}:"))
    return rows.groupBy(F.col("issue_id").alias("id")).agg(F.min(F.substring("label", len(dimension) + 2, 1 << 30)).alias("value"))


def failure_close(reason: Column) -> Column:
    return F.coalesce(F.lower(reason).rlike("|".join(FAILURES)), F.lit(False))


def live_state(events: DataFrame) -> DataFrame:
    """(issue_id, status, n, labels) from an event log (id, issue_id, event_type, new_value, created_at), newest by time, then id.

    n counts status changes. A label dimension:value replaces the one that its dimension had; other labels
    stand for themselves. A label stands unless it was removed after it was added last.
    """
    events = events.filter("issue_id IS NOT NULL AND new_value IS NOT NULL").withColumn("at", F.struct("created_at", "id"))
    of = lambda kind: F.col("event_type") == kind
    status = events.groupBy("issue_id").agg(F.max(F.when(of("status_changed"), F.struct("at", "new_value")))["new_value"].alias("status"), F.count(F.when(of("status_changed"), 1)).alias("n"))
    dimension = F.when(F.col("new_value").contains(":"), F.substring_index("new_value", ":", 1)).otherwise(F.col("new_value"))
    added = events.filter(of("label_added")).groupBy("issue_id", dimension.alias("dimension")).agg(F.max(F.struct("at", "new_value")).alias("newest"))
    removed = events.filter(of("label_removed")).groupBy("issue_id", F.col("new_value").alias("label")).agg(F.max("at").alias("gone"))
    standing = added.select("issue_id", F.col("newest.new_value").alias("label"), F.col("newest.at").alias("at")).join(removed, ["issue_id", "label"], "left").filter("gone IS NULL OR gone < at")
    labels = standing.groupBy("issue_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    none = F.array().cast("array<string>")
    return status.join(labels, "issue_id", "left").select("issue_id", "status", "n", F.coalesce("labels", none).alias("labels"))


def ephemeral_expired(rows: DataFrame, now: dt.datetime, default_hours: int = 1) -> DataFrame:
    """Rows (wisp_type, updated_at) older than the time of their class."""
    hours = {"heartbeat": 6, "ping": 6, "patrol": 24, "gc_report": 24, "recovery": 168, "error": 168, "escalation": 168}
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("updated_at")) / 3600
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in hours.items() for x in kv))[F.col("wisp_type")], F.lit(default_hours))
    return rows.filter(age > limit)
