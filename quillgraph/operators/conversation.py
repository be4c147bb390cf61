"""Conversations: filtering, corrections, transcripts, summaries, facts and budgets.

messages: thread_id, turn, role ('user', 'assistant' or 'tool'), content; assistant turns with
tool calls have has_calls. Windows run inside a thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPLOADS = r"(?i)<uploaded_files>[\s\S]*?</uploaded_files>\n*"
#: Signs that a user corrects the assistant (fixed values).
CORRECTIONS = (
    r"(?i)\bthat(?:'s| is) (?:wrong|incorrect)\b", r"(?i)\byou misunderstood\b", r"(?i)\btry again\b", r"(?i)\bredo\b",
    "不对", "你理解错了", "你理解有误", "重试", "重新来", "换一种", "改用",
)


def filter_conversation(messages: DataFrame) -> DataFrame:
    """User turns and final assistant turns without upload blocks; a user turn of uploads alone goes with the next assistant reply."""
    calls = F.coalesce(F.col("has_calls"), F.lit(False)) if "has_calls" in messages.columns else F.lit(False)
    kept = messages.filter((F.col("role") == "user") | ((F.col("role") == "assistant") & ~calls))
    text = F.when(F.col("role") == "user", F.regexp_replace(F.regexp_replace("content", UPLOADS, ""), r"^\s+|\s+$", "")).otherwise(F.col("content"))
    blank = (F.col("role") == "user") & F.col("content").rlike("(?i)<uploaded_files>") & (text == "")
    marked = kept.withColumn("blank", blank).withColumn("content", text)
    w = Window.partitionBy("thread_id").orderBy("turn")
    # a reply goes when the last turn that is not a reply, or a reply not taken, is a blank user turn
    before = F.lag(F.struct("role", "blank")).over(w)
    dropped = (F.col("role") == "assistant") & F.coalesce(before["blank"], F.lit(False))
    return marked.withColumn("dropped", dropped).filter("NOT blank AND NOT dropped").drop("blank", "dropped")


def recent_turns(messages: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    return messages.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


def detect_correction(messages: DataFrame, last: int = 6) -> DataFrame:
    """(thread_id, corrected) over user turns among the last filtered messages."""
    hit = F.lit(False)
    for p in CORRECTIONS:
        hit = hit | F.col("content").rlike(p)
    return recent_turns(filter_conversation(messages), last).groupBy("thread_id").agg(F.max((F.col("role") == "user") & hit).alias("corrected"))


def transcript(messages: DataFrame, most: int = 1000) -> DataFrame:
    """(thread_id, transcript): User: and Assistant: lines, long ones cut."""
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    text = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    rows = messages.filter(F.col("role").isin("user", "assistant")).select("thread_id", F.struct("turn", F.concat(who, text).alias("line")).alias("m"))
    return rows.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n\n").alias("transcript"))


def summarize(messages: DataFrame, summaries: DataFrame, threshold: int = 20, mode: str = "sliding") -> DataFrame:
    """(thread_id, message_count, summary) of threads longer than threshold with enough new messages since the last summary (thread_id, message_count)."""
    last = summaries.groupBy("thread_id").agg(F.max("message_count").alias("last"))
    w = Window.partitionBy("thread_id")
    rows = messages.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("turn"))}).join(last, "thread_id", "left")
    rows = rows.filter((F.col("n") > threshold) & (F.col("n") - F.coalesce("last", F.lit(0)) >= threshold / 2))
    covered = F.col("n") - (threshold if mode == "sliding" else 1)
    sentence = F.substring(F.trim(F.split("content", r"[.!?\n]")[0]), 1, 200)
    said = F.when((F.col("role") == "user") & (F.col("k") <= covered) & (sentence != ""), F.struct("k", sentence.alias("s")))
    lines = F.slice(F.array_sort(F.collect_list(said)), 1, 10)
    return rows.groupBy("thread_id").agg(F.first(covered).cast("bigint").alias("message_count"), F.array_join(F.transform(lines, lambda x: x["s"]), "; ").alias("summary"))


def conversation_context(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """(thread_id, summary, recent): the latest summary and the messages after those that it covers."""
    latest = summaries.groupBy("thread_id").agg(F.max(F.struct("message_count", "summary")).alias("s"))
    k = F.row_number().over(Window.partitionBy("thread_id").orderBy("turn"))
    rows = messages.withColumn("k", k).join(latest, "thread_id", "left")
    after = F.when(F.col("k") > F.coalesce("s.message_count", F.lit(0)), F.struct("k", F.col("content").alias("t")))
    out = rows.groupBy("thread_id").agg(F.first("s.summary").alias("summary"), F.array_sort(F.collect_list(after)).alias("m"))
    return out.select("thread_id", "summary", F.transform("m", lambda m: m["t"]).alias("recent"))


def loop_windows(calls: DataFrame, window: int = 20, warn: int = 3, stop: int = 5) -> DataFrame:
    """(thread_id, event_id, n, verdict): how often a call's hash is among the thread's last calls."""
    w = Window.partitionBy("thread_id").orderBy("ts", "event_id").rowsBetween(-(window - 1), 0)
    n = F.size(F.filter(F.collect_list("call_hash").over(w), lambda h: h == F.col("call_hash")))
    return calls.withColumn("n", n).select("thread_id", "event_id", "n", F.when(F.col("n") >= stop, "stop").when(F.col("n") >= warn, "warn").otherwise("ok").alias("verdict"))


def list_threads(messages: DataFrame, threads: DataFrame, org: str, project: str | None = None) -> DataFrame:
    """The newest 50 threads (thread_id, org_id, project, updated_at) of an organisation, then by project; rows without one pass."""
    newest = threads.filter(F.col("org_id") == org).orderBy(F.desc("updated_at"), "thread_id").limit(50)
    return newest if project is None else newest.filter(F.col("project").isNull() | (F.col("project") == project))


def search_threads(threads: DataFrame, metadata: dict[str, str], status: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    rows = threads if status is None else threads.filter(F.col("status") == status)
    for key, value in metadata.items():
        rows = rows.filter(F.get_json_object("metadata", f"$.{key}") == value)
    return rows.orderBy(F.desc("updated_at"), "thread_id").offset(offset).limit(limit)


def facts_top_n(facts: DataFrame, most: int = 100) -> DataFrame:
    """The facts of each owner with most confidence; ties by place."""
    w = Window.partitionBy("owner").orderBy(F.desc("confidence"), "fact_id")
    return facts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def fact_merge(current: DataFrame, fresh: DataFrame, removed: DataFrame, least: float = 0.7, most: int = 100) -> DataFrame:
    """Facts without removed ids and with new confident ones whose trimmed content is not there yet; then the cap."""
    kept = current.join(removed.select("owner", "fact_id"), ["owner", "fact_id"], "left_anti")
    key = F.trim("content")
    confident = fresh.filter(F.col("confidence") >= least).withColumn("key", key)
    w = Window.partitionBy("owner", "key").orderBy("fact_id")
    first = confident.withColumn("n", F.row_number().over(w)).filter("n = 1 OR key = ''").drop("n")
    new = first.join(kept.filter(key != "").select("owner", key.alias("key")), ["owner", "key"], "left_anti").drop("key")
    return facts_top_n(kept.unionByName(new), most)


def token_budget_pack(facts: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """(owner, fact_id, place): facts by confidence until the first line that does not fit; a token is four characters."""
    line = F.concat(F.lit("- ["), "category", F.lit(" | "), F.format_number("confidence", 2), F.lit("] "), "content", F.lit("\n"))
    tokens = F.floor(F.length(line) / 4)
    w = Window.partitionBy("owner").orderBy(F.desc("confidence"), "fact_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = facts.withColumns({"total": F.sum(tokens).over(w), "place": F.count("*").over(w)})
    return rows.filter(F.col("total") <= max_tokens).select("owner", "fact_id", "place")


def token_usage(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


