"""Streaming forms of the stateful behaviours: sessions, history, URL dedupe, progress counters, ingestion."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..plans import retrieval
from ..sources import stores


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Closed inactivity sessions, once the watermark passes them (append mode)."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = rows.groupBy(F.session_window("__t", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("events"), F.max("__t").alias("session_end"))
    return out.select(key, F.col("s.start").alias("session_start"), "session_end", "events")


def new_urls(found: DataFrame, visited: DataFrame | None = None, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each URL once within the watermark, without those visited before."""
    rows = found.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark(["url"])
    rows = rows.drop("__t")
    return rows if visited is None else rows.join(visited.select("url").distinct(), "url", "left_anti")


def progress(events: DataFrame, key: str = "domain", *more: Column) -> DataFrame:
    """Running counts, and more aggregates, of a stream (update or complete mode) or a table."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *more)


def windowed_counts(events: DataFrame, time: str, window: str, key: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return rows.groupBy(F.window("__t", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


class _History:
    """The last messages of one conversation as list state, which goes when its timer runs out; ``keep`` messages at most are held."""

    def __init__(self, keep: int, ttl_minutes: float | None):
        self.keep, self.ttl_ms = keep, int(ttl_minutes * 60_000) if ttl_minutes else None

    def processor(self):
        from pyspark.sql.streaming import StatefulProcessor

        keep, ttl_ms = self.keep, self.ttl_ms

        class History(StatefulProcessor):
            def init(self, handle):
                self.handle = handle
                self.messages = handle.getListState("messages", "role string, content string")

            def handleInputRows(self, key, rows, timerValues):
                new = pd.concat(list(rows)).sort_values(["ts", "role", "content"])
                every = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
                every = (every + list(zip(new["role"], new["content"], strict=True)))[-keep:]
                self.messages.put(every)
                if ttl_ms:
                    for t in self.handle.listTimers():
                        self.handle.deleteTimer(t)
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + ttl_ms)
                yield pd.DataFrame({"conv_id": [key[0]], "messages": [len(every)], "history": ["\n".join(f"{r.upper()}: {c}" for r, c in every)], "expired": [False]})

            def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
                n = len(list(self.messages.get())) if self.messages.exists() else 0
                self.messages.clear()
                yield pd.DataFrame({"conv_id": [key[0]], "messages": [n], "history": [""], "expired": [True]})

            def close(self):
                pass

        return History()


#: The state store that list state and timers need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def conversation_history(messages: DataFrame, keep: int = 20, ttl_minutes: float | None = 120) -> DataFrame:
    """conv_id, messages, history (the last ``keep`` messages), expired: a row for each conversation that a batch touches.

    A conversation's state goes after so many quiet minutes, with a row that says so. With no ttl the state stays. List state and timers need the
    session to keep states in RocksDB (``ROCKSDB``).
    """
    rows = messages.select("conv_id", "ts", "role", "content").groupBy("conv_id")
    return rows.transformWithStateInPandas(_History(keep, ttl_minutes).processor(), "conv_id bigint, messages int, history string, expired boolean", "Update", "ProcessingTime" if ttl_minutes else "None")


def query_id(batch: DataFrame) -> str:
    """The id of the running query, which its checkpoint keeps across restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"


def ingest(raw: DataFrame, sink: str, checkpoint: str, keep: bool = False, embedder=None, dim: int = 64):
    """Raw pages (url, html) to processed pages, chunks, nodes and edges of a knowledge base, batch by batch and each batch once.

    A batch goes into the ledger of the sink in one commit under the query's id and the batch's number. One that comes again after a failure
    is not worked out again and changes nothing. Dropped pages are a table of the same ledger.
    """
    base = stores.KnowledgeBase(raw.sparkSession, sink)

    def load(batch: DataFrame, number: int) -> None:
        load_batch(base, batch, (query_id(batch), number), keep, embedder, dim)

    return raw.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_batch(base: stores.KnowledgeBase, batch: DataFrame, source: tuple[str, int], keep: bool = False, embedder=None, dim: int = 64) -> bool:
    """Processes and loads one batch of raw pages; false if it was loaded before."""
    if base.ledger.seen(*source):
        return False
    made = retrieval.ingest(batch, dim, embedder)
    try:
        chunks = made["chunks"].withColumn("embedding", F.col("embedding").cast("array<float>"))
        return base.load(made["pages"], chunks, made["mentions"], source, made["dropped"] if keep else None)
    finally:
        made["all"].unpersist()


class Snapshots(StreamingQueryListener):
    """Running totals of what streams observe, kept as JSON files under a path: at least every ``every`` rows, and when a query ends.

    ``metrics`` names an observation (``df.observe(name, ...)``) whose values are added up; one of them is ``rows``. A new listener on the path starts from
    the last snapshot, and a batch that it counted already doesn't count twice.
    """

    def __init__(self, path: str, metrics: str, every: int = 50, kept: int = 10):
        self.path, self.metrics, self.every, self.kept = path, metrics, every, kept
        self.spark = SparkSession.getActiveSession()
        jvm = self.spark.sparkContext._jvm
        self._at = lambda part: jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        self._fs = self._at("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        last = self.last(self.spark, path)
        self.totals, self.batches, self.number = last.get("totals", {}), last.get("batches", {}), last.get("number", 0)
        self._new = 0

    @staticmethod
    def last(spark: SparkSession, path: str) -> dict:
        """The latest whole snapshot: number, totals, batches (by query), seconds, rate (rows a second)."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
        for name in (n for n in names if n.endswith(".json")):
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:  # its writer died
                continue
            finally:
                stream.close()
        return {}

    def _write(self) -> None:
        self.number += 1
        seconds = self.totals.get("seconds", 0.0)
        said = {"number": self.number, "totals": self.totals, "batches": self.batches, "rate": round(self.totals.get("rows", 0) / seconds, 3) if seconds else 0.0}
        out = self._fs.create(self._at(f"{self.number:012d}.json"), True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        old = self._at(f"{self.number - self.kept:012d}.json")
        if self.number > self.kept and self._fs.exists(old):
            self._fs.delete(old, False)
        self._new = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.metrics)
        if row is None or self.batches.get(str(p.id), -1) >= p.batchId:
            return
        for k, v in row.asDict().items():
            self.totals[k] = self.totals.get(k, 0) + (v or 0)
        self.totals["seconds"] = self.totals.get("seconds", 0.0) + p.batchDuration / 1000
        self.batches[str(p.id)] = p.batchId
        self._new += row.asDict().get("rows") or 0
        if self._new >= self.every:
            self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._new:
            self._write()


def observed(pages: DataFrame, name: str = "progress") -> DataFrame:
    """Processed pages with an observation of their counts: rows, kept, dropped, words."""
    drop = F.col("drop_reason").isNotNull()
    return pages.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
