"""Streaming forms of ingestion, debouncing, usage windows, loop detection, expiry and event polling.

Functions take a streaming DataFrame and give one, or take a sink folder. run_available() reads all
that is there and ends, which makes each a batch job too.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.text import chunk_documents
from ..session import Scratch, prepare


def read_folder(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Append what a stream yields for all present input to a table in the shared folder, and read that."""
    spark = prepare(stream.sparkSession)
    base = Scratch(spark, name).base
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _exists(spark: SparkSession, path: str) -> bool:
    files, make = _files(spark, path)
    return files.exists(make(path))


def _switch(manifest: DataFrame, path: str, name: str) -> None:
    """Write a manifest aside and rename it into place; readers see all of it or nothing."""
    spark = manifest.sparkSession
    files, make = _files(spark, path)
    aside = f"{path}/pending/{uuid.uuid4().hex}"
    manifest.write.parquet(aside)
    files.mkdirs(make(f"{path}/manifest"))
    if not files.rename(make(aside), make(f"{path}/manifest/{name}")):
        raise OSError(f"{name} could not be put in place under {path}/manifest")


def _manifests(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The manifests that count, and the number of the last batch: the newest compaction and the batches after it."""
    files, make = _files(spark, path)
    if not files.exists(make(f"{path}/manifest")):
        return [], -1
    names = [s.getPath().getName() for s in files.listStatus(make(f"{path}/manifest"))]
    batches, upto = ({int(n.split("=")[1]) for n in names if n.startswith(k)} for k in ("batch=", "upto="))
    base = max(upto, default=-1)
    return [f"{path}/manifest/upto={base}"] * bool(upto) + [f"{path}/manifest/batch={n}" for n in sorted(batches) if n > base], max(batches | upto, default=-1)


def ingest(documents: DataFrame, path: str, version: str | None = None) -> None:
    """Chunk arriving documents (id, text) under path. A batch writes its chunks to a folder of its own, then a manifest
    (id, batch, part) of its documents that is renamed into place: until then the chunks from before are what readers see,
    afterwards the new ones are, also for a document that has no chunks any more. A batch that has its manifest is not done again.

    Of documents that repeat an id in a batch, the one with the largest `version` (a column, say the
    time of the edit) is chunked; without one, or of equal ones, that of the last text in order. Null ids are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if any(_exists(spark, f"{path}/manifest/{kind}={number}") for kind in ("batch", "upto")):
            return
        part = f"{number}-{uuid.uuid4().hex}"
        order = F.struct(*([version] if version else []), "text")
        newest = batch.filter("id IS NOT NULL").groupBy("id").agg(F.max_by("text", order).alias("text")).persist()
        chunk_documents(newest).write.parquet(f"{path}/chunks/part={part}")
        _switch(newest.select(F.col("id").cast("string").alias("id"), F.lit(number).cast("bigint").alias("batch"), F.lit(part).alias("part")), path, f"batch={number}")
        newest.unpersist()

    documents.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def _current(spark: SparkSession, path: str, manifests: list[str]) -> tuple[DataFrame, DataFrame]:
    """The newest manifest row of each document, and its chunks."""
    rows = spark.read.schema("id string, batch long, part string").parquet(*manifests)
    last = rows.groupBy("id").agg(F.max_by("part", "batch").alias("part"), F.max("batch").alias("batch"))
    parts = [f"{path}/chunks/part={r['part']}" for r in rows.select("part").distinct().collect()]
    chunks = spark.read.option("basePath", f"{path}/chunks").schema("id string, position int, content string, part string").parquet(*parts)
    return last, chunks.join(last, ["id", "part"])


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(id, batch, position, content): the chunks of each document's last batch, as the manifests tell."""
    manifests, _ = _manifests(spark, path)
    if not manifests:
        return spark.createDataFrame([], "id string, batch long, position int, content string")
    return _current(spark, path, manifests)[1].select("id", "batch", "position", "content")


def compact(spark: SparkSession, path: str) -> None:
    """Bring the current chunks together in place: one folder and one manifest up to the last batch stand for all before.

    Readers that began earlier can go on; vacuum() deletes what no reader needs. Not to be run beside another one or an ingestion.
    """
    manifests, number = _manifests(spark, path)
    if not manifests or manifests == [f"{path}/manifest/upto={number}"]:
        return
    last, chunks = _current(spark, path, manifests)
    part = f"upto-{number}-{uuid.uuid4().hex}"
    chunks.select("id", "position", "content").write.parquet(f"{path}/chunks/part={part}")
    _switch(last.select("id", "batch", F.lit(part).alias("part")), path, f"upto={number}")


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete chunks and manifests that the newest manifests don't name, and what failed batches left. No reader or ingestion may run."""
    manifests, _ = _manifests(spark, path)
    named = {f"part={r['part']}" for r in spark.read.schema("id string, batch long, part string").parquet(*manifests).select("part").distinct().collect()} if manifests else set()
    keep = {"manifest": {m.rsplit("/", 1)[1] for m in manifests}, "chunks": named, "pending": set()}
    files, make = _files(spark, path)
    for folder, names in keep.items():
        if files.exists(make(f"{path}/{folder}")):
            for status in files.listStatus(make(f"{path}/{folder}")):
                if status.getPath().getName() not in names:
                    files.delete(status.getPath(), True)


def debounce(updates: DataFrame, silence: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(thread_id, start, end, payload, flag, n): the newest update of each burst of a thread, once it has been silent."""
    return (
        updates.withWatermark("ts", late).groupBy("thread_id", F.session_window("ts", silence).alias("w"))
        .agg(F.max_by("payload", "ts").alias("payload"), F.max("flag").alias("flag"), F.count("*").alias("n"))
        .select("thread_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "payload", "flag", "n")
    )


def usage_windows(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(hour, n, avg_duration) of closed windows; rows later than the watermark are dropped."""
    rows = requests.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.avg("duration").alias("avg_duration")).select(F.col("w.start").alias("hour"), "n", "avg_duration")


#: Several values and lists a key need this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _with_store(stream: DataFrame) -> DataFrame:
    for key, value in STORE.items():
        stream.sparkSession.conf.set(key, value)
    return stream


class Loops(StatefulProcessor):
    """The threads of a shard, least recently used first: each its last hashes and those it was warned about."""

    def __init__(self, window: int, warn: int, stop: int, threads: int, idle_ms: int, ttl_ms: int | None):
        self.window, self.warn, self.stop, self.threads, self.idle_ms, self.ttl_ms = window, warn, stop, threads, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracked = handle.getListState("tracked", "thread_id bigint, used bigint, recent array<string>, warned array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracked = OrderedDict((t, [used, list(recent), list(warned)]) for t, used, recent, warned in self.tracked.get())
        calls, found = pd.concat(list(rows)).sort_values(["ts", "event_id"]), []
        for thread, event, at, call in zip(calls["thread_id"], calls["event_id"], calls["at"], calls["call_hash"], strict=True):
            state = tracked.pop(thread, None)
            if state is None or at - state[0] > self.idle_ms:
                state = [at, [], []]
            tracked[thread] = state
            if len(tracked) > self.threads:
                tracked.popitem(last=False)
            state[0], state[1] = max(at, state[0]), [*state[1], call][-self.window :]
            n = state[1].count(call)
            verdict = "stop" if n >= self.stop else "warn" if n >= self.warn and call not in state[2] else "ok"
            if verdict == "warn":
                state[2].append(call)
            found.append((thread, event, n, verdict))
        if tracked:
            self.tracked.put([(int(t), int(used), recent, warned) for t, (used, recent, warned) in tracked.items()])
        yield pd.DataFrame(found, columns=["thread_id", "event_id", "n", "verdict"])

    def close(self) -> None:
        pass


def loop_detector(calls: DataFrame, window: int = 20, warn: int = 3, stop: int = 5, threads: int = 100, shards: int = 200, idle: str = "1 hour", ttl: str | None = None) -> DataFrame:
    """(thread_id, event_id, n, verdict) of each call (thread_id, event_id, ts, call_hash).

    n counts a hash in the thread's last `window` calls; from `stop` on the verdict is stop, from `warn` on
    warn, once a hash. A thread idle for longer by event time begins anew. Threads are dealt to shards, each
    of which tracks its `threads` most recently used ones; a thread that was dropped begins anew. With `ttl`,
    a shard's state also goes when no call has touched it for so long by the clock. That is for streams that
    run on: Spark then keeps looking at the clock, and a run over what is there (run_available) never ends.
    """
    out = "thread_id bigint, event_id bigint, n int, verdict string"
    ms = lambda span: int(pd.Timedelta(span).total_seconds() * 1000)
    dealt = _with_store(calls).select(F.pmod(F.xxhash64("thread_id"), F.lit(shards)).alias("shard"), "thread_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "ts", "call_hash")
    return dealt.groupBy("shard").transformWithStateInPandas(Loops(window, warn, stop, threads, ms(idle), ms(ttl) if ttl else None), out, "append", "processingTime" if ttl else "none")


def first_seen(rows: DataFrame, key: str, ttl: str) -> DataFrame:
    """Each key once within its time to live."""
    return rows.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def new_events_since(events: DataFrame, cursor: dt.datetime) -> DataFrame:
    """Events after the cursor; the stream's checkpoint moves it on."""
    return events.filter(F.col("created_at") > F.lit(cursor))


class LiveIssue(StatefulProcessor):
    """An issue's newest status, the newest label of each dimension, and the newest removal of each label."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string, at bigint, id bigint, n bigint")
        self.labels = handle.getMapState("labels", "dimension string", "label string, at bigint, id bigint")
        self.removed = handle.getMapState("removed", "label string", "at bigint, id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status = self.status.get() or (None, -(1 << 62), 0, 0)
        labels = {k[0]: tuple(v) for k, v in self.labels.iterator()}
        removed = {k[0]: tuple(v) for k, v in self.removed.iterator()}
        events = pd.concat(list(rows))
        for kind, value, at, number in zip(events["event_type"], events["new_value"], events["at"], events["id"], strict=True):
            at, number = int(at), int(number)
            if kind == "status_changed":
                newest = max((status[1], status[2], status[0]), (at, number, value))
                status = (newest[2], newest[0], newest[1], status[3] + 1)
            elif kind == "label_added":
                dimension = value.split(":", 1)[0] if ":" in value else value
                if dimension not in labels or labels[dimension][1:] < (at, number):
                    labels[dimension] = (value, at, number)
                    self.labels.updateValue((dimension,), labels[dimension])
            elif kind == "label_removed" and removed.get(value, (-(1 << 62), 0)) < (at, number):
                removed[value] = (at, number)
                self.removed.updateValue((value,), removed[value])
        self.status.update(status)
        standing = sorted(label for label, at, number in labels.values() if removed.get(label, (-(1 << 62), 0)) < (at, number))
        yield pd.DataFrame({"issue_id": [key[0]], "status": [status[0]], "n": [status[3]], "labels": [standing]})

    def close(self) -> None:
        pass


def live_state(events: DataFrame) -> DataFrame:
    """(issue_id, status, n, labels) of an issue whenever events arrive for it, for update mode: work.live_state as a stream.

    Events may arrive in any order: the newest by (created_at, id) counts.
    """
    rows = _with_store(events).select("issue_id", "id", "event_type", "new_value", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")).filter("issue_id IS NOT NULL AND new_value IS NOT NULL")
    return rows.groupBy("issue_id").transformWithStateInPandas(LiveIssue(), "issue_id string, status string, n bigint, labels array<string>", "update", "none")


def merge_updates(stream: DataFrame, name: str, key: str) -> DataFrame:
    """What a stream in update mode says last of each key, for all present input.

    A batch's rows are a folder of its own, which a batch that runs again overwrites; the newest folder
    that names a key holds its row.
    """
    spark = prepare(stream.sparkSession)
    base = Scratch(spark, name).base

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi").drop("batch")
