"""Streams give what batches give."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import chat, pages
from tessella.sources import stores
from tessella.streaming import jobs


def run(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, df, folder, parts=3):
    df.repartition(parts).write.mode("overwrite").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(folder))


def test_sessions(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    late = events.agg(F.max("ts")).first()[0]
    closed = chat.sessions(events).where(F.col("session_end") < F.lit(late).cast("timestamp") - F.expr("INTERVAL 3 HOURS"))
    got = run(jobs.sessions(stream(spark, events, tmp_path / "e")), "append", tmp_path, "sess").collect()
    assert set(map(tuple, closed.collect())) <= set(map(tuple, got))


def test_counters_and_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = run(jobs.progress(stream(spark, events, tmp_path / "e"), "event_type"), "complete", tmp_path, "prog").collect()
    assert {r.event_type: r.total for r in got} == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    w = run(jobs.windowed_counts(stream(spark, events, tmp_path / "f"), "ts", "1 day", "event_type"), "append", tmp_path, "win")
    assert w.agg(F.sum("n")).first()[0] <= events.count() and w.count() > 0


def test_new_urls(spark, tmp_path):
    rows = [(f"u{i % 4}", f"2024-01-01 00:0{i % 6}:00") for i in range(20)]
    df = spark.createDataFrame(rows, "url string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    visited = spark.createDataFrame([("u0",)], "url string")
    got = run(jobs.new_urls(stream(spark, df, tmp_path / "u"), visited), "append", tmp_path, "urls").collect()
    assert sorted(r.url for r in got) == ["u1", "u2", "u3"]


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    yield
    spark.conf.set(jobs.ROCKSDB[0], before)


def test_history(spark, tmp_path, rocksdb):
    rows = [(c, f"2024-01-01 00:00:{i:02d}", "user" if i % 2 == 0 else "assistant", f"m{i}") for c in (1, 2) for i in range(25)]
    df = spark.createDataFrame(rows, "conv_id bigint, ts string, role string, content string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(jobs.conversation_history(stream(spark, df, tmp_path / "h", 1), ttl_minutes=None), "update", tmp_path, "hist").collect()
    last = {r.conv_id: r for r in got}
    assert last[1].messages == 20 and last[1].history.split("\n")[0] == "ASSISTANT: m5" and last[1].history.split("\n")[-1] == "USER: m24" and not last[1].expired


class Handle:
    """A stand-in for the state handle, whose clock the test moves."""

    def __init__(self):
        self.lists, self.timers, self.now = {}, set(), 0

    def getListState(self, name, schema):
        handle = self

        class State:
            def exists(self):
                return name in handle.lists

            def get(self):
                return iter(handle.lists.get(name, []))

            def put(self, rows):
                handle.lists[name] = list(rows)

            def clear(self):
                handle.lists.pop(name, None)

        return State()

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_history_expires():
    """Each message moves the one timer on; when it runs out, the state is gone and later messages begin anew."""
    h = Handle()
    p = jobs._History(3, 120).processor()
    p.init(h)
    say = lambda *texts: next(p.handleInputRows((7,), iter([pd.DataFrame({"ts": range(len(texts)), "role": "user", "content": texts})]), h)).iloc[0]
    assert say("a", "b").messages == 2 and h.timers == {7_200_000}
    h.now = 60_000
    assert say("c", "d").history == "USER: b\nUSER: c\nUSER: d" and h.timers == {7_260_000}
    h.now = 7_260_000
    out = next(p.handleExpiredTimer((7,), h, None)).iloc[0]
    assert out.expired and out.messages == 3 and not h.lists
    assert say("e").history == "USER: e"


def test_history_timer_runs_out_in_a_stream(spark, tmp_path, rocksdb):
    """With a ttl of zero minutes and a bit, a later batch of other conversations expires the earlier ones."""
    df = spark.createDataFrame([(1, "2024-01-01", "user", "m")], "conv_id bigint, ts string, role string, content string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = jobs.conversation_history(stream(spark, df, tmp_path / "t", 1), ttl_minutes=0.01)
    q = rows.writeStream.format("memory").queryName("expiring").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("expiring").where("expired").count():
                break
    finally:
        q.stop()
    assert [(r.conv_id, r.messages) for r in spark.table("expiring").where("expired").collect()] == [(1, 1)]


# --- ingestion


def contents(base):
    keys = ("url", "chunk_key", "key", "src_key", "dst_key", "count")
    tables = (base.pages(), base.dropped(), base.vectors.rows(), base.graph.nodes(), base.graph.edges())
    return [sorted(tuple(r) for r in t.select(*[c for c in keys if c in t.columns]).collect()) for t in tables]


def test_ingest_loads_each_batch_once(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/pages.parquet").drop("page_id").limit(20)
    raw = raw.withColumn("html", F.replace("html", F.lit("</article>"), F.lit(" The robotics lab works on deep learning.</article>")))
    out = str(tmp_path / "out")
    jobs.ingest(stream(spark, raw, tmp_path / "p"), out, str(tmp_path / "ck"), keep=True).awaitTermination()
    base = stores.KnowledgeBase(spark, out)
    assert base.pages().count() + base.dropped().count() == raw.select("url").distinct().count()
    assert base.vectors.rows().count() and base.graph.edges().count()
    before, version = contents(base), base.ledger.state()[0]
    again = lambda: spark.readStream.schema(raw.schema).parquet(str(tmp_path / "p"))
    # Nothing new: a restarted query changes nothing.
    jobs.ingest(again(), out, str(tmp_path / "ck"), keep=True).awaitTermination()
    (query, number), *more = base.ledger.state()[2].items()
    assert not more and query != "stream" and number == 0 and base.ledger.state()[0] == version
    # The batch that a query would repeat whose checkpoint missed it: same query and number, another checkpoint.
    q = again().writeStream.foreachBatch(lambda b, n: jobs.load_batch(base, b, (query, n), True) and None).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and contents(base) == before and base.ledger.state()[0] == version


def test_snapshots_go_on_after_a_restart(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/pages.parquet").drop("page_id").limit(30)
    folder, ck, at = tmp_path / "p", str(tmp_path / "ck"), str(tmp_path / "snapshots")
    schema = raw.schema

    def once(rows):
        listener = jobs.Snapshots(at, "progress", every=5)
        spark.streams.addListener(listener)
        try:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
            q = jobs.observed(pages.process(source)).writeStream.format("noop").option("checkpointLocation", ck).trigger(availableNow=True).start()
            q.awaitTermination()
            for _ in range(40):
                time.sleep(0.25)
                if listener.totals.get("rows") == rows and not listener._new:
                    break
        finally:
            spark.streams.removeListener(listener)
        return listener

    raw.repartition(2).write.parquet(str(folder))
    once(30)
    first = jobs.Snapshots.last(spark, at)
    assert first["totals"]["rows"] == 30 and first["totals"]["kept"] + first["totals"]["dropped"] == 30 and first["rate"] > 0
    raw.limit(12).write.mode("append").parquet(str(folder))
    again = once(42)
    last = jobs.Snapshots.last(spark, at)
    assert last["totals"]["rows"] == again.totals["rows"] == 42 and last["number"] > first["number"] and len(last["batches"]) == 1
