"""Structured Streaming operators. Each micro-batch is written under its number, so that a repeated one replaces itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.rules import RuleSet
from ..operators import lines as L
from ..operators.records import MOST_REQUEUES, PROCESSING, STALE_SECONDS, recover_stale, repair_detected_targets, upsert_records
from ..operators.stats import batch_rollup
from .store import Snapshots

TEST_FOLDER = "/tmp/dossier-streams"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where none is set and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or TEST_FOLDER
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")  # a pattern: a table may be a file or a folder


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Runs all that is there now through `each`."""
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _into(folder: str) -> Callable[[DataFrame, int], None]:
    return lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drains a stream and reads what it gave; of an update or complete stream the last batch."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    drain(stream, _into(folder), folder, mode)
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if mode == "append":
        return out.drop("batch")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).drop("batch")


def analyse(docs: DataFrame, rules: RuleSet) -> DataFrame:
    """Quality of each document; one without a source (null) or without text fails with an error, and fails alone."""
    error = F.when(F.col("text").isNull(), "no_source").when(F.trim("text") == "", "no_text").otherwise("")
    known = docs.withColumn("error", error)
    good = known.where("error = ''")
    quality = L.parse_quality(L.features(good, L.segment_by_heading(L.lines_of(good), rules.headings))).select("doc_id", "quality")
    return known.select("doc_id", "error").join(quality, "doc_id", "left").select("doc_id", F.when(F.col("error") == "", "success").otherwise("failed").alias("status"), "error", F.coalesce("quality", F.lit("")).alias("quality"))


def analysed_into(rules: RuleSet) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """S2, A10. What becomes of records (doc_id, status, error, quality) when documents come: new ones begin as processing, and those that are take the result of their document;
    one that has ended stays as it is. Of a document that a batch holds several times the greatest text counts."""

    def merge(records: DataFrame, docs: DataFrame) -> DataFrame:
        docs = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
        fresh = docs.join(records, "doc_id", "left_anti").select("doc_id", F.lit("processing").alias("status"), F.lit("").alias("error"), F.lit("").alias("quality"))
        return upsert_records(records.unionByName(fresh), analyse(docs, rules), "doc_id", ("status", "error", "quality"))

    return merge


def stream_analyze(stream: DataFrame, rules: RuleSet, folder: str | None = None) -> DataFrame:
    """S2. Analyses new documents batch by batch and upserts the results into snapshots; a batch that is repeated changes nothing."""
    folder = folder or shared_folder(stream.sparkSession)
    kind = StructType().add("doc_id", stream.schema["doc_id"].dataType).add("status", "string").add("error", "string").add("quality", "string")
    store = Snapshots(stream.sparkSession, f"{folder}/records", kind, "doc_id")
    merge = analysed_into(rules)
    drain(stream.select("doc_id", "text"), lambda df, number: store.apply(df, number, merge), folder)
    return store.read()


def stream_progress(items: DataFrame) -> DataFrame:
    """S3. Progress and final status of each batch, as its items come."""
    return batch_rollup(items)


def stream_daily_volume(events: DataFrame, late: str = "2 days") -> DataFrame:
    """S7. Events by day; later ones than `late` are not counted any more."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def stream_dedupe(items: DataFrame, late: str = "7 days") -> DataFrame:
    """S8. The first successful item of each (batch, file) within `late`; its state goes once the watermark has passed that, so a later one counts as new."""
    good = items.where(F.col("status") == "success").withColumn("ts", F.col("ts").cast("timestamp"))
    return good.withWatermark("ts", late).dropDuplicatesWithinWatermark(["batch_id", "filename"])


def reused_flags(items: DataFrame) -> DataFrame:
    """S8 in batch: whether an item's (batch, file) had succeeded before it, by time and number."""
    w = Window.partitionBy("batch_id", "filename").orderBy("ts", "item_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(F.col("status") == "success", F.struct("ts", "item_no"))).over(w)
    return items.withColumn("reused", F.coalesce(first < F.struct("ts", "item_no"), F.lit(False)))


def _limited(events: DataFrame, key: str, seconds: float, late: str, decide: Callable[[list[float], list], tuple[list[bool], list]]) -> DataFrame:
    """Runs decide(times, state) over each key's events in order of time within a micro-batch. Events that come more than `late` after later ones are dropped;
    a key's state goes when the watermark is `seconds` past its last event, when it can decide nothing any more."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = stamped.select(F.col(key).cast("string").alias("key"), F.col("event_id"), F.col("ts"), F.col("ts").cast("double").alias("at"))

    def run(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat([p[["event_id", "at"]] for p in parts]).sort_values(["at", "event_id"])
        allowed, kept = decide(pdf["at"].tolist(), list(state.get[0]) if state.exists else [])
        state.update((kept,))
        last = max([float(pdf["at"].iloc[-1]), *kept[:1]])
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": who[0], "event_id": pdf["event_id"].to_numpy(), "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(run, "key string, event_id bigint, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def fixed_window(limit: int, seconds: float) -> Callable[[list[float], list], tuple[list[bool], list]]:
    """The window opens at a key's first event; every attempt counts; state: its start and count."""

    def decide(times: list[float], state: list) -> tuple[list[bool], list]:
        start, n = state or (None, 0)
        out = []
        for t in times:
            if start is None or t - start >= seconds:
                start, n = t, 0
            n += 1
            out.append(n <= limit)
        return out, [start, float(n)] if start is not None else []

    return decide


def sliding_log(limit: int, seconds: float) -> Callable[[list[float], list], tuple[list[bool], list]]:
    """Only admitted events of the last seconds count; state: their times, `limit` at most."""

    def decide(times: list[float], state: list) -> tuple[list[bool], list]:
        log, out = list(state), []
        for t in times:
            log = [x for x in log if t - x < seconds]
            out.append(len(log) < limit)
            if out[-1]:
                log.append(t)
        return out, log

    return decide


def limit_fixed(events: DataFrame, key: str, limit: int, seconds: float, late: str = "1 day") -> DataFrame:
    """S4. Whether each event of a key is allowed by a fixed window."""
    return _limited(events, key, seconds, late, fixed_window(limit, seconds))


def limit_sliding(events: DataFrame, key: str, limit: int, seconds: float, late: str = "1 day") -> DataFrame:
    """S5. Whether each event of a key is allowed by a sliding log."""
    return _limited(events, key, seconds, late, sliding_log(limit, seconds))


def overdue(state: tuple[str, float, int] | None, rows: list[tuple[float, str, int]], now: float, seconds: float, most: int) -> tuple[tuple[str, float, int] | None, list[str]]:
    """S6. A task's state (status, since, requeues) and what is done after rows (time, status, requeues so far or -1) came by `now`: processing for over `seconds` it is queued again,
    and fails the time after `most`. A task that ends is forgotten."""
    out = []

    def late(at: float) -> None:
        nonlocal state
        if state and state[0] == PROCESSING and at - state[1] > seconds:
            out.append("fail" if state[2] >= most else "requeue")
            state = None if out[-1] == "fail" else ("pending", at, state[2] + 1)

    for at, status, requeues in sorted(rows):
        late(at)
        if status in (PROCESSING, "pending"):
            state = (status, at, requeues if requeues >= 0 else state[2] if state else 0)
        else:
            state = None
    late(now)
    return state, out


def overdue_tasks(known: dict[str, tuple[str, float, int]], came: dict[str, list[tuple[float, str, int]]], now: float, by_time: bool, seconds: float, most: int) -> tuple[dict[str, tuple[str, float, int]], list[tuple[str, str]]]:
    """S6. overdue() for all tasks that are known or of which rows came: those known from then on, and (task, action). Without `by_time` a row moves its own task's clock on."""
    after, out = {}, []
    for task in known.keys() | came.keys():
        rows = came.get(task, [])
        state, actions = overdue(known.get(task), rows, now if by_time else max([now, *(at for at, _, _ in rows)]), seconds, most)
        out += [(task, a) for a in actions]
        if state is not None:
            after[task] = state
    return after, out


#: Groups of tasks that share a state in S6. A stream that goes on from a checkpoint keeps the number it began with.
TASK_BUCKETS = 8192


def recover_stream(tasks: DataFrame, seconds: float = STALE_SECONDS, most: int = MOST_REQUEUES, late: str | None = None, buckets: int = TASK_BUCKETS) -> DataFrame:
    """S6. (task_id, action) for tasks that stay in processing: requeue, or fail after `most`. tasks: task_id, status, requeues (null: as known), ts.

    A timer fires when `seconds` have passed since a task began: by the clock of the cluster, or with `late` by the events' own time, once the watermark is there.
    Tasks share states and timers by hash, in `buckets` of them, as a call of Python for each task takes far longer than what it does; a state has the tasks that have not ended, its timer is that of the first one due.
    """
    by_time = late is not None
    stamped = tasks.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", late) if by_time else stamped
    rows = stamped.select(F.col("task_id").cast("string").alias("task_id"), "status", F.coalesce(F.col("requeues").cast("int"), F.lit(-1)).alias("requeues"), "ts", F.col("ts").cast("double").alias("at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets)))

    def run(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = (state.getCurrentWatermarkMs() if by_time else state.getCurrentProcessingTimeMs()) / 1000
        known = {task: (status, since, requeues) for task, status, since, requeues in zip(*state.get, strict=True)} if state.exists else {}
        came: dict[str, list[tuple[float, str, int]]] = {}
        for p in () if state.hasTimedOut else parts:
            for task, at, status, requeues in zip(p["task_id"].tolist(), p["at"].tolist(), p["status"].tolist(), p["requeues"].tolist(), strict=True):
                came.setdefault(task, []).append((at, status, requeues))
        known, actions = overdue_tasks(known, came, now, by_time, seconds, most)
        if known:
            state.update(([*known], *(list(c) for c in zip(*known.values(), strict=True))))
        elif state.exists:
            state.remove()
        due = [since + seconds for status, since, _ in known.values() if status == PROCESSING]
        if due and by_time:
            state.setTimeoutTimestamp(max(int(min(due) * 1000), state.getCurrentWatermarkMs()) + 1)
        elif due:
            state.setTimeoutDuration(max(int((min(due) - now) * 1000), 0) + 1)
        if actions:
            yield pd.DataFrame(actions, columns=["task_id", "action"])

    timer = GroupStateTimeout.EventTimeTimeout if by_time else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("bucket").applyInPandasWithState(run, "task_id string, action string", "task_id array<string>, status array<string>, since array<double>, requeues array<int>", "append", timer)


def maintenance_tick(records: DataFrame, as_of: str, limit: int = 50) -> DataFrame:
    """S9. What one tick changes: the newest rows whose target is repaired and the oldest stale tasks, `limit` of each."""
    repaired = repair_detected_targets(records).where("repaired").orderBy(F.desc("record_id")).limit(limit).select("record_id", F.lit("repair").alias("action"))
    stale = recover_stale(records.withColumns({"updated_at": F.to_timestamp("created_at"), "requeues": F.col("record_id") % 4}), F.lit(as_of).cast("timestamp")).where("action <> 'keep'")
    return repaired.unionByName(stale.orderBy("updated_at", "record_id").limit(limit).select("record_id", "action"))


def maintain(ticks: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], as_of: Callable[[], str], folder: str, interval: str = "60 seconds"):
    """S9. Every interval one tick over the records as they are then; returns the running query."""
    return ticks.writeStream.foreachBatch(lambda df, number: write(maintenance_tick(read(), as_of()), number)).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=interval).start()
