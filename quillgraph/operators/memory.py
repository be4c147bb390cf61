"""Memory lifecycle: lists, statistics, versions, reinforcement, decay, forgetting, extraction.

memories: id, org_id, space_id, memory, confidence, memory_level, source_count, is_static,
is_forgotten, is_latest, parent_memory_id, root_memory_id, version, forget_after, updated_at.
Every operator takes tables and gives a new table; `now` is a parameter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, prepare
from . import folds

#: Constants of the lifecycle (fixed values).
FORGET_BELOW, DECAY_A_DAY, BOOST = 0.15, 0.005, 0.1
DECAY_BY_LEVEL = {"profile": 0.25, "preference": 0.5, "fact": 1.0, "episodic": 1.5}


def list_memories(memories: DataFrame, org: str, level: str | None = None, forgotten: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = memories.filter((F.col("org_id") == org) & F.col("is_latest") & (F.col("is_forgotten") == forgotten))
    if level:
        rows = rows.filter(F.col("memory_level") == level)
    return rows.orderBy(F.desc_nulls_last("confidence"), F.desc("updated_at"), "id").offset(offset).limit(min(limit, 200))


def with_tags(documents: DataFrame, links: DataFrame) -> DataFrame:
    tags = links.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("container_tag")).alias("tags"))
    return documents.join(tags, "id", "left")


def tag_match(documents: DataFrame, links: DataFrame, tags: list[str], exact: bool = False) -> DataFrame:
    """Documents in a space with one of the tags; with exact, those whose tags are just these."""
    if not exact:
        return documents.join(links.filter(F.col("container_tag").isin(*tags)).select(F.col("document_id").alias("id")), "id", "left_semi")
    return with_tags(documents, links).filter(F.col("tags") == F.array_sort(F.array(*map(F.lit, sorted(set(tags)))))).drop("tags")


def list_documents(documents: DataFrame, links: DataFrame, org: str, status: str | None = None, tags: list[str] | None = None, page: int = 1, limit: int = 100) -> DataFrame:
    """A page of documents, newest first, with tags and the total; an unknown tag gives none."""
    rows = documents.filter(F.col("org_id") == org)
    if status:
        rows = rows.filter(F.col("status") == status)
    if tags:
        rows = tag_match(rows, links, tags)
    limit = min(limit, 1100)
    total = rows.agg(F.count("*").alias("total"))
    chosen = rows.orderBy(F.desc("created_at"), "id").offset((page - 1) * limit).limit(limit)
    # the total is one row
    return with_tags(chosen, links).join(F.broadcast(total), F.lit(True))


def documents_with_memories(documents: DataFrame, links: DataFrame, memory_docs: DataFrame, memories: DataFrame, org: str, tags: list[str] | None = None, page: int = 1, limit: int = 100) -> DataFrame:
    """A page of documents with their memories as an array; an unknown tag is ignored."""
    rows = documents.filter(F.col("org_id") == org)
    if tags and not links.filter(F.col("container_tag").isin(*tags)).isEmpty():
        rows = tag_match(rows, links, tags)
    limit = min(limit, 100)
    chosen = rows.orderBy(F.desc("created_at"), "id").offset((page - 1) * limit).limit(limit)
    held = memory_docs.join(memories.select(F.col("id").alias("memory_id"), "memory"), "memory_id")
    per = held.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("memory_id", "memory", "relevance"))).alias("memories"))
    return chosen.join(per, "id", "left")


def documents_by_ids(documents: DataFrame, org: str, ids: DataFrame, by: str = "id") -> DataFrame:
    return documents.filter(F.col("org_id") == org).join(ids.select(F.col("id").alias(by)).distinct(), by, "left_semi")


def memory_detail(memories: DataFrame, ids: DataFrame, memory_docs: DataFrame) -> DataFrame:
    """(asked, id, version, memory, documents): the version history of each asked memory, newest first, with linked documents."""
    root = F.coalesce("root_memory_id", "id")
    asked = memories.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("asked"), root.alias("root"))
    chain = memories.withColumn("root", root).join(asked, "root").select("asked", "id", "version", "memory")
    documents = memory_docs.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    return chain.join(documents, "id", "left").orderBy("asked", F.desc("version"), "id")


def space_document_counts(spaces: DataFrame, links: DataFrame, prefix: str = "sm_project_") -> DataFrame:
    counts = links.groupBy("space_id").agg(F.count("*").alias("documents"))
    return spaces.filter(F.col("container_tag").startswith(prefix)).join(counts, "space_id", "left").fillna(0, ["documents"])


def memory_stats(memories: DataFrame) -> DataFrame:
    """(org_id, level, n, total, avg_confidence, forgotten); a null level is unknown."""
    per = memories.groupBy("org_id", F.coalesce("memory_level", F.lit("unknown")).alias("level")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("s"), F.count("confidence").alias("k"), F.sum(F.col("is_forgotten").cast("bigint")).alias("f")
    )
    w = Window.partitionBy("org_id")
    return per.select("org_id", "level", "n", F.sum("n").over(w).alias("total"), F.round(F.sum("s").over(w) / F.sum("k").over(w), 3).alias("avg_confidence"), F.sum("f").over(w).alias("forgotten"))


def profile(memories: DataFrame, now: dt.datetime, limit: int = 50) -> DataFrame:
    """(org_id, part, id, rank): newest static memories, and recent others by confidence, of every org."""
    kept = memories.filter("is_latest AND NOT is_forgotten")
    fixed = kept.filter("is_static").select("org_id", F.lit("static").alias("part"), "id", F.row_number().over(Window.partitionBy("org_id").orderBy(F.desc("updated_at"), "id")).alias("rank"))
    recent = kept.filter(~F.col("is_static") & (F.col("updated_at") >= F.lit(now - dt.timedelta(days=30))))
    moving = recent.select("org_id", F.lit("dynamic").alias("part"), "id", F.row_number().over(Window.partitionBy("org_id").orderBy(F.desc_nulls_last("confidence"), F.desc("updated_at"), "id")).alias("rank"))
    return fixed.filter(F.col("rank") <= limit).union(moving.filter(F.col("rank") <= limit))


def latest_version(memories: DataFrame) -> DataFrame:
    """The newest row of every root."""
    w = Window.partitionBy(F.coalesce("root_memory_id", "id")).orderBy(F.desc("version"), F.desc("updated_at"), "id")
    return memories.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


# changes


def promote_level(level: Column, sources: Column, confidence: Column) -> Column:
    """One step of promotion by number of sources and confidence."""
    core = (sources >= 5) & (confidence >= 0.8)
    return F.when(level.isin("fact", "preference") & core, "core").when((level == "fact") & (sources >= 3) & (confidence >= 0.6), "preference").otherwise(level)


def reinforce(memories: DataFrame, hits: DataFrame, bits: int = folds.BITS) -> DataFrame:
    """Memories after hits (memory_id, confidence, ts, event_id) in order: confidence, sources, level, un-forgotten.

    A hit makes c <- min(1, 0.7 c + 0.3 n + 0.1) and may promote. Hits are cut into runs of bounded length
    (folds), whose steps give the confidence that each run starts from; then every run goes through its
    own hits. So a hot memory is many short lists, and every hit counts in order.
    """
    scratch, key = Scratch(prepare(memories.sparkSession), "reinforce"), ["memory_id"]
    base = memories.select(F.col("id").alias("memory_id"), F.coalesce("confidence", F.lit(1.0)).alias("c"), F.col("source_count").alias("n"))
    lists = folds.in_runs(hits, key, ["ts", "event_id"], "confidence", scratch, bits)
    found = folds.levels(lists, key, 0.7, 0.3, BOOST, scratch, bits)
    last, at = folds.starts(found, key, base, scratch, bits)
    run = at.withColumnRenamed("n", "s").join(lists, ["memory_id", "piece"])
    zero = F.struct(F.col("c"), F.col("s"), F.lit(False).alias("core"), F.lit(False).alias("pref"))

    def hit(x: Column, h: Column) -> Column:
        c, s = F.least(F.lit(1.0), 0.7 * x["c"] + 0.3 * h["v"] + BOOST), x["s"] + 1
        return F.struct(c.alias("c"), s.alias("s"), (x["core"] | ((s >= 5) & (c >= 0.8))).alias("core"), (x["pref"] | ((s >= 3) & (c >= 0.6))).alias("pref"))

    signs = run.select("memory_id", F.aggregate("steps", zero, hit).alias("h")).groupBy("memory_id").agg(F.max("h.core").alias("core"), F.max("h.pref").alias("pref"))
    seen = last.select(F.col("memory_id").alias("id"), F.col("c").alias("after"), F.col("n").cast("int").alias("sources")).join(signs.withColumnRenamed("memory_id", "id"), "id")
    rows = memories.join(seen, "id", "left")
    was_hit, level = F.col("sources").isNotNull(), F.col("memory_level")
    promoted = F.when(level.isin("fact", "preference") & F.col("core"), "core").when((level == "fact") & F.col("pref"), "preference").otherwise(level)
    return rows.withColumns({
        "confidence": F.coalesce("after", "confidence"), "source_count": F.coalesce("sources", "source_count"), "memory_level": F.when(was_hit, promoted).otherwise(level),
        "is_forgotten": F.col("is_forgotten") & ~was_hit,
    }).drop("after", "sources", "core", "pref")


def hit_links(hits: DataFrame) -> DataFrame:
    """(memory_id, document_id, relevance) of hits, relevance = confidence * 100; the first of a pair stays."""
    first = F.min(F.struct("ts", "event_id", "confidence"))["confidence"]
    return hits.groupBy("memory_id", "document_id").agg(F.round(first * 100).cast("int").alias("relevance"))


def temporal_decay(memories: DataFrame, now: dt.datetime) -> DataFrame:
    """Linear decay by days since the last update, slower for lasting levels; very low confidence is forgotten."""
    days = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("updated_at")) / 86400
    factor = F.coalesce(F.create_map(*(F.lit(x) for kv in DECAY_BY_LEVEL.items() for x in kv))[F.col("memory_level")], F.lit(1.0))
    old = F.coalesce("confidence", F.lit(1.0))
    new = F.greatest(F.lit(0.0), old * (1 - DECAY_A_DAY * factor * days))
    due = F.col("is_latest") & ~F.col("is_forgotten") & ~F.col("is_static") & (F.coalesce(F.col("memory_level"), F.lit("")) != "core") & (days >= 1)
    rows = memories.withColumns({"due": due, "new": new})
    gone = F.col("due") & (F.col("new") < FORGET_BELOW)
    written = gone | (F.col("due") & (F.abs(F.col("new") - old) > 0.001))
    reason = F.col("forget_reason") if "forget_reason" in memories.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "forget_reason": F.when(gone, "temporal_decay").otherwise(reason), "is_forgotten": F.col("is_forgotten") | gone,
        "updated_at": F.when(written, F.lit(now)).otherwise(F.col("updated_at")), "confidence": F.when(written, F.col("new")).otherwise(F.col("confidence")), "decayed": written,
    }).drop("due", "new")


def forget_expired(memories: DataFrame, now: dt.datetime) -> DataFrame:
    gone = F.coalesce(F.col("forget_after") < F.lit(now), F.lit(False)) & ~F.col("is_forgotten")
    reason = F.col("forget_reason") if "forget_reason" in memories.columns else F.lit(None).cast("string")
    return memories.withColumns({"forget_reason": F.when(gone, "expired").otherwise(reason), "is_forgotten": F.col("is_forgotten") | gone})


def maintenance(memories: DataFrame, now: dt.datetime) -> DataFrame:
    return forget_expired(temporal_decay(memories, now), now)


def maintenance_counts(after: DataFrame) -> DataFrame:
    count = lambda test: F.sum(test.cast("bigint"))
    reason = F.coalesce("forget_reason", F.lit(""))
    return after.agg(count(F.col("decayed") & (reason != "temporal_decay")).alias("decayed"), count(reason == "temporal_decay").alias("forgotten"), count(reason == "expired").alias("expired"))


def new_version(memories: DataFrame, edits: DataFrame) -> DataFrame:
    """Memories with edits (id, new_id, memory, and reason if there is one): the old row is no longer latest, the new one points to it.

    The maps memory_relations and metadata are added where they are missing. The new row's relations
    gain old id -> updates, its metadata versionReason -> reason, null without a reason.
    """
    kind = "map<string,string>"
    for c in ("memory_relations", "metadata"):
        if c not in memories.columns:
            memories = memories.withColumn(c, F.lit(None).cast(kind))
    old = memories.join(edits.select("id"), "id", "left_semi").withColumn("is_latest", F.lit(False))
    rest = memories.join(edits.select("id"), "id", "left_anti")
    reason = (F.col("reason") if "reason" in edits.columns else F.lit(None)).cast("string").alias("new_reason")
    changed = memories.join(edits.select("id", "new_id", F.col("memory").alias("new_memory"), reason), "id")
    with_entry = lambda c, k, v: F.map_concat(F.map_filter(F.coalesce(c, F.create_map().cast(kind)), lambda x, _: x != k), F.create_map(k, v))
    fresh = changed.withColumns({
        "root_memory_id": F.coalesce("root_memory_id", "id"), "parent_memory_id": F.col("id"), "version": F.col("version") + 1, "is_latest": F.lit(True), "memory": F.col("new_memory"),
        "memory_relations": with_entry(F.col("memory_relations"), F.col("id"), F.lit("updates")), "metadata": with_entry(F.col("metadata"), F.lit("versionReason"), F.col("new_reason")),
    }).withColumn("id", F.col("new_id"))
    return rest.unionByName(old).unionByName(fresh.select(*memories.columns))


def apply_commands(memories: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (id, command, level, confidence): forget, pin, unpin or patch; the confidence is held to 0..1."""
    rows = memories.join(commands.select("id", "command", F.col("level").alias("new_level"), F.col("confidence").alias("new_confidence")), "id", "left")
    is_ = lambda c: F.coalesce(F.col("command") == c, F.lit(False))
    return rows.withColumns({
        "is_forgotten": F.col("is_forgotten") | is_("forget"), "is_static": F.when(is_("pin"), True).when(is_("unpin"), False).otherwise(F.col("is_static")),
        "memory_level": F.when(is_("patch"), F.coalesce("new_level", "memory_level")).otherwise(F.col("memory_level")),
        "confidence": F.when(is_("patch") & F.col("new_confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "new_confidence"))).otherwise(F.col("confidence")),
    }).drop("command", "new_level", "new_confidence")


def space_move(links: DataFrame, source: str, target: str, target_tag: str) -> DataFrame:
    moved = links.filter(F.col("space_id") == source).select("document_id", F.lit(target).alias("space_id"), F.lit(target_tag).alias("container_tag"))
    return links.select("document_id", "space_id", "container_tag").union(moved).dropDuplicates(["document_id", "space_id"])


def space_delete(documents: DataFrame, links: DataFrame, space: str) -> DataFrame:
    return documents.join(links.filter(F.col("space_id") == space).select(F.col("document_id").alias("id")), "id", "left_anti")


def delete_space(documents: DataFrame, memories: DataFrame, links: DataFrame, space: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, memories and links without a space: its documents go with all their links, its memories go."""
    kept = space_delete(documents, links, space)
    gone = links.filter(F.col("space_id") == space).select("document_id")
    rest = links.filter(~F.col("space_id").eqNullSafe(F.lit(space))).join(gone, "document_id", "left_anti")
    return kept, memories.filter(~F.col("space_id").eqNullSafe(F.lit(space))), rest


def bulk_delete(documents: DataFrame, links: DataFrame, ids: DataFrame | None = None, tags: list[str] | None = None) -> DataFrame:
    gone = ids.select("id") if ids is not None else links.filter(F.col("container_tag").isin(*(tags or []))).select(F.col("document_id").alias("id"))
    return documents.join(gone.distinct(), "id", "left_anti")


def dedupe_memories(static: DataFrame, dynamic: DataFrame, search: DataFrame) -> DataFrame:
    """(list, pos, memory): trimmed, empty dropped; a later list loses what an earlier one or itself has, the static list keeps its own repeats."""
    tagged = None
    for rank, (name, df) in enumerate((("static", static), ("dynamic", dynamic), ("search", search))):
        rows = df.select(F.lit(rank).alias("rank"), F.lit(name).alias("list"), "pos", F.trim("memory").alias("memory"))
        tagged = rows if tagged is None else tagged.union(rows)
    # the first of each text, by partial aggregation
    first = tagged.filter("memory <> ''").groupBy("memory").agg(F.min(F.struct("rank", "pos", "list")).alias("first")).filter("first.rank > 0")
    return tagged.filter("rank = 0 AND memory <> ''").select("list", "pos", "memory").union(first.select("first.list", "first.pos", "memory"))


# extraction

DEFINES = r"(?i)\b(is|are|was|were|means|refers to|defined as)\b"
#: A run of capitalised words that does not begin a sentence stands for an entity.
ENTITY = r"(?<=[a-zà-ÿ,;] )[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)*"


def sentences(text: Column) -> Column:
    # F.trim itself as the function would get the place of a sentence as the signs to trim
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def extract_memories(docs: DataFrame, limit: int = 10) -> DataFrame:
    """(id, pos, memory, confidence): the title first, then telling sentences of the first 50, distinct, at most `limit`."""
    rows = docs.filter(F.length(F.trim("text")) >= 50)
    title = rows.filter(F.coalesce("title", F.lit("")) != "").select("id", F.lit(-1).alias("pos"), F.when(F.coalesce("url", F.lit("")) != "", F.concat("title", F.lit(" ("), "url", F.lit(")"))).otherwise(F.col("title")).alias("memory"), F.lit(0.9).alias("confidence"))
    each = rows.select("id", F.posexplode(F.slice(sentences(F.col("text")), 1, 50)).alias("pos", "memory")).filter(F.length("memory").between(20, 500))
    entity = F.col("memory").rlike(ENTITY)
    telling = each.filter(entity | F.col("memory").rlike(r"\d") | F.col("memory").rlike(DEFINES)).select("id", "pos", "memory", F.when(entity, 0.7).otherwise(0.5).alias("confidence"))
    distinct = telling.groupBy("id", "memory").agg(F.min("pos").alias("pos"), F.max("confidence").alias("confidence")).select("id", "pos", "memory", "confidence")
    w = Window.partitionBy("id").orderBy("pos")
    return title.union(distinct).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


def title_case(name: Column) -> Column:
    return F.initcap(F.regexp_replace(F.trim(name), r"\s+", " "))


def extract_entities(docs: DataFrame, gazetteer: DataFrame, limit: int = 10) -> DataFrame:
    """(id, name, type, confidence) of words in the gazetteer (word, type): people, places, organizations, at most `limit` each; the first type wins a name."""
    rank = F.create_map(*(F.lit(x) for x in ("person", 0, "location", 1, "organization", 2)))
    words = docs.filter(F.length(F.trim("text")) >= 30).select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}][\p{L}'-]+"), F.lit(0))).alias("pos", "word"))
    found = words.join(gazetteer, "word").select("id", "pos", "type", title_case(F.col("word")).alias("name")).groupBy("id", "type", "name").agg(F.min("pos").alias("pos"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("id", "type").orderBy("pos"))).filter(F.col("n") <= limit)
    best = first.withColumn("k", F.row_number().over(Window.partitionBy("id", F.lower("name")).orderBy(rank[F.col("type")], "pos"))).filter("k = 1")
    return best.select("id", "name", "type", F.when(F.col("type") == "person", 0.7).otherwise(0.6).alias("confidence"))


TYPES = ("person", "organization", "location", "concept", "event", "tool")


def clean_extractions(entities: DataFrame, relationships: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Per document at most `limit` entities and relationships, confidences held to 0..1, types and relations normalised, ends known, no loops."""
    hold = lambda c, default: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(default))))
    w = Window.partitionBy("id").orderBy("pos")
    kind = F.lower(F.coalesce("type", F.lit("concept")))
    ents = entities.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select("id", "pos", title_case(F.col("name")).alias("name"), F.when(kind.isin(*TYPES), kind).otherwise("concept").alias("type"), hold("confidence", 0.7).alias("confidence"))
    slug = F.regexp_replace(F.regexp_replace(F.trim(F.lower("relation")), r"\s+", "_"), "[^a-z0-9_]", "")
    rels = relationships.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select(
        "id", title_case(F.col("source")).alias("source"), title_case(F.col("target")).alias("target"), F.when(F.coalesce(slug, F.lit("")) == "", "related_to").otherwise(slug).alias("relation"), hold("confidence", 0.6).alias("confidence")
    )
    names = ents.select("id", "name").distinct()
    rels = rels.filter(F.lower("source") != F.lower("target")).join(names.withColumnRenamed("name", "source"), ["id", "source"], "left_semi").join(names.withColumnRenamed("name", "target"), ["id", "target"], "left_semi")
    return ents, rels


#: Sentences about an upload as an event (fixed pattern).
UPLOAD = r"(?i)[^.!?]*\b(?:upload(?:ed|ing)?(?:\s+\w+){0,3}\s+(?:file|files?|document|documents?|attachment|attachments?)|file\s+upload|/mnt/user-data/uploads/|<uploaded_files>)[^.!?]*[.!?]?\s*"


def strip_upload_mentions(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, UPLOAD, "")), "  +", " ")


def mentions_upload(text: Column) -> Column:
    return text.rlike(UPLOAD)
