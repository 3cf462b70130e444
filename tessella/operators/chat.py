"""Chat threads, messages and contexts as tables; sessions and history windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def thread_title(question: Column) -> Column:
    return F.concat(F.substring(question, 1, 50), F.when(F.length(question) > 50, "...").otherwise(""))


def stable_id(*parts: Column) -> Column:
    """A reproducible id in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)


def new_threads(first: DataFrame, now: Column, user: str = "default") -> DataFrame:
    """From question and an optional user_id: thread rows."""
    who = F.col("user_id") if "user_id" in first.columns else F.lit(user)
    return first.select(stable_id(who, F.col("question"), now.cast("string")).alias("thread_id"), who.alias("user_id"), thread_title(F.col("question")).alias("title"), now.alias("created_at"), now.alias("updated_at"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("message_count"))


def add_messages(threads: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, messages) with new messages (message_id, thread_id, role, content, context_used, created_at); counts and times follow."""
    more = new.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("t"))
    out = threads.join(more, "thread_id", "left").withColumns({"message_count": F.col("message_count") + F.coalesce("n", F.lit(0)), "updated_at": F.greatest("updated_at", "t")}).drop("n", "t")
    return out.select(*threads.columns), messages.unionByName(new.select(*messages.columns))


def message_contexts(sources: DataFrame, limit: int = 1000) -> DataFrame:
    return sources.withColumn("chunk_text", F.substring("chunk_text", 1, limit))


def threads_of(turns: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """Thread summaries derived from messages: title of the first user message, count, last turn."""
    return turns.groupBy(F.col(conv).alias("thread_id")).agg(F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(order))).alias("q"), F.count(F.lit(1)).alias("message_count"), F.max(order).alias("last_turn")).select("thread_id", thread_title(F.col("q")).alias("title"), "message_count", "last_turn")


def thread_list(threads: DataFrame, user: str | None = None, status: str | None = "active", limit: int = 50) -> DataFrame:
    rows = threads if user is None else threads.where(F.col("user_id") == user)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("updated_at"), "thread_id").limit(limit)


def thread_messages(messages: DataFrame, thread_id, limit: int | None = None, latest: bool = False, order: str = "created_at") -> DataFrame:
    """Messages of a thread in order: the first ``limit``, or the last with ``latest``."""
    rows = messages.where(F.col("thread_id") == thread_id)
    if limit is None:
        return rows.orderBy(order)
    return rows.orderBy(F.desc(order)).limit(limit).orderBy(order) if latest else rows.orderBy(order).limit(limit)


def search_threads(threads: DataFrame, messages: DataFrame, query: str, user: str | None = None, limit: int = 20) -> DataFrame:
    """Threads whose title or a message is like %query% (wildcards count, case doesn't); a semi join, so a thread is there once."""
    pattern = f"%{query}%"
    rows = threads if user is None else threads.where(F.col("user_id") == user)
    said = messages.where(F.col("content").ilike(pattern)).select("thread_id").distinct().withColumn("__hit", F.lit(True))
    found = rows.join(said, "thread_id", "left").where(F.col("title").ilike(pattern) | F.col("__hit")).drop("__hit")
    return found.orderBy(F.desc("updated_at"), "thread_id").limit(limit)


def filter_titles(threads: DataFrame, part: str) -> DataFrame:
    return threads.where(F.contains(F.lower("title"), F.lit(part.lower())))


def archive(threads: DataFrame, thread_id, now: Column) -> DataFrame:
    hit = F.col("thread_id") == thread_id
    return threads.withColumns({"status": F.when(hit, "archived").otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def delete(threads: DataFrame, messages: DataFrame, contexts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Threads in ids (thread_id) with their messages and contexts."""
    gone = messages.join(ids, "thread_id", "left_semi").select("message_id")
    return threads.join(ids, "thread_id", "left_anti"), messages.join(ids, "thread_id", "left_anti"), contexts.join(gone, "message_id", "left_anti")


def purgeable(threads: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return threads.where((F.col("status") == "archived") & (F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS"))).select("thread_id")


def last_messages(turns: DataFrame, n: int = 20, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each conversation."""
    r = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(order)))
    return turns.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def history_text(turns: DataFrame, n: int = 6, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    rows = last_messages(turns, n, conv, order)
    one = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.upper(role), F.lit(": "), F.col(text)).alias("x"))))
    return rows.groupBy(conv).agg(F.array_join(F.transform(one, lambda s: s["x"]), "\n").alias("history"))


def running_counts(messages: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    return messages.withColumn("message_count", F.count(F.lit(1)).over(Window.partitionBy(conv).orderBy(order)))


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "2 hours") -> DataFrame:
    """Inactivity sessions: key, session_start, session_end (of the last event, not of the gap), events."""
    t = F.col(time).cast("timestamp")
    out = events.withColumn("__t", t).groupBy(key, F.session_window("__t", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"), F.max("__t").alias("session_end"))
    return out.select(key, F.col("s.start").alias("session_start"), "session_end", "events")


def expired(last_access: Column, now: Column, gap: str = "2 HOURS") -> Column:
    return last_access < now - F.expr(f"INTERVAL {gap}")


def time_label(then: Column, now: Column) -> Column:
    """Just now, 5m ago, 3h ago, Yesterday, 4d ago, or month and day."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    ago = lambda n, u: F.concat(n.cast("string"), F.lit(f"{u} ago"))
    return F.when(m < 1, "Just now").when(m < 60, ago(m, "m")).when(h < 24, ago(h, "h")).when(d == 1, "Yesterday").when(d < 7, ago(d, "d")).otherwise(F.date_format(then, "MMM d"))
