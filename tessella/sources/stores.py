"""Durable stores: chunks with embeddings, the property graph and chat threads, each a ledger of Parquet tables.

An add or a deletion writes rows in proportion to itself and one commit for all tables of the store; a read merges what was written
(the newest row of a key, properties by the newest value, counts by their sum, deletions as rows of their own). ``compact`` writes the merged rows anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chat, graph
from ..operators.vector import embed, filtered, nearest, similarity
from ..operators.vector_index import VectorIndex
from .ledger import Ledger

CHUNKS = "chunk_key string, page_id string, chunk_id int, text string, word_count int, start_word int, end_word int, url string, domain string, page_type string, title string, embedding array<float>"
THREADS = "thread_id string, user_id string, title string, created_at timestamp, updated_at timestamp, status string, message_count bigint"
PAGE_ROWS = "page_id string, url string, title string, domain string, page_type string, cleaned_text string, word_count int, text_quality_score double, response_status int, content_length int"
DROPPED = "url string, drop_reason string"
MESSAGES = "message_id string, thread_id string, role string, content string, context_used int, created_at timestamp"
CONTEXTS = "context_id string, message_id string, chunk_url string, chunk_text string, relevance_score double, created_at timestamp"
#: Rows of a deletion: the key, and whether it is gone.
GONE = "_gone boolean"


def chunk_rows(processed: DataFrame) -> DataFrame:
    """Chunks of processed pages with their page's metadata where their own is missing; those without embedding are left out."""
    page = [F.coalesce(c, F.lit("")).alias(c) for c in ("url", "domain", "page_type", "title")]
    rows = processed.select("page_id", *page, F.explode("chunks").alias("c"))
    rows = rows.select(F.concat("page_id", F.lit("_"), F.col("c.chunk_id").cast("string")).alias("chunk_key"), "page_id", *[F.col(f"c.{x}").alias(x) for x in ("chunk_id", "text", "word_count", "start_word", "end_word")], "url", "domain", "page_type", "title", F.col("c.embedding").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull())


def load_counts(processed: DataFrame) -> DataFrame:
    """Totals of a batch load: pages, stored (with a URL and an embedded chunk), failed, chunks stored."""
    embedded = F.coalesce(F.size(F.filter("chunks", lambda c: c["embedding"].isNotNull())), F.lit(0))
    ok = (F.coalesce("url", F.lit("")) != "") & (embedded > 0)
    return processed.agg(F.count(F.lit(1)).alias("pages"), F.count_if(ok).alias("stored"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(embedded), F.lit(0)).alias("chunks"))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last commit, if that isn't a deletion; rows have _seq and _gone."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_seq")))
    return rows.withColumn("_n", last).where((F.col("_n") == 1) & ~F.coalesce("_gone", F.lit(False))).drop("_n", "_seq", "_gone")


def _gone(keys: DataFrame, schema: str) -> DataFrame:
    """Deletion rows of these keys: all other columns are null."""
    empty = keys.sparkSession.createDataFrame([], f"{schema}, {GONE}")
    return empty.unionByName(keys.withColumn("_gone", F.lit(True)), allowMissingColumns=True)


def _there(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_gone", F.lit(False))


class VectorStore:
    """A chunk table under a path, and an index over it where ``index`` was called."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ledger = spark, path, Ledger(spark, path)

    @property
    def version(self) -> int:
        return self.ledger.state()[0]

    def rows(self, at: int | None = None) -> DataFrame:
        """The chunks now, or as of an earlier version."""
        return newest(self.ledger.read("chunks", f"{CHUNKS}, {GONE}", at), ["chunk_key"])

    def _tables(self, chunks: DataFrame) -> dict:
        new = chunks.where(F.col("embedding").isNotNull()).dropDuplicates(["chunk_key"])
        return {"chunks": (_there(new), f"{CHUNKS}, {GONE}")}

    def add(self, chunks: DataFrame, source: tuple[str, int] | None = None) -> bool:
        """New chunks win over old ones of the same key. A source and number that were added before change nothing (false)."""
        return self.ledger.add(self._tables(chunks), source)

    def load(self, processed: DataFrame) -> DataFrame:
        """Adds the chunks of processed pages in one write; gives the totals of the load."""
        self.add(chunk_rows(processed.where(F.coalesce("url", F.lit("")) != "")))
        return load_counts(processed)

    def index(self, cells: int | None = None) -> VectorIndex:
        """An index of the chunks as they are now, for ``query``; later chunks are not in it."""
        n = self.version
        made = VectorIndex.build(self.rows(), f"{self.path}/index/{n}", cells, "chunk_key")
        self.ledger._fs.create(self.ledger._at(f"indexed/{n}"), True).close()
        return made

    def _index(self) -> VectorIndex | None:
        """The index of the present version, if there is one."""
        n = self.version
        return VectorIndex(self.spark, f"{self.path}/index/{n}", "chunk_key") if self.ledger._fs.exists(self.ledger._at(f"indexed/{n}")) else None

    def query(self, queries: DataFrame, k: int = 50, where: dict | None = None, metric: str = "l2", probes: int | None = None) -> DataFrame:
        """queries: query_id, query_vector. Hits with text, metadata, distance, score and rank; over all rows, or with ``probes`` through the index's nearest cells."""
        rows = filtered(self.rows(), where)
        if probes:
            if where:
                raise ValueError("the index holds all rows; search with filters without probes")
            index = self._index() or self.index()
            hits = index.search(queries, k, probes, metric=metric).withColumnRenamed("doc_id", "chunk_key")
        else:
            hits = nearest(queries, rows, k, metric, doc_id="chunk_key").withColumnRenamed("doc_id", "chunk_key")
        return hits.join(rows.drop("embedding"), "chunk_key").withColumn("score", similarity(F.col("distance")))

    def by_metadata(self, where: dict, limit: int = 50) -> DataFrame:
        return filtered(self.rows(), where).orderBy("chunk_key").limit(limit)

    def delete_page(self, page_id: str) -> None:
        keys = self.rows().where(F.col("page_id") == page_id).select("chunk_key")
        self.ledger.add({"chunks": (_gone(keys, CHUNKS), f"{CHUNKS}, {GONE}")})

    def reset(self) -> None:
        self.ledger.replace({"chunks": (None, "")})

    def compact(self) -> None:
        """The merged rows as one batch; fails if another writer commits meanwhile."""
        base = self.version
        self.ledger.replace({"chunks": (_there(self.rows(base)), f"{CHUNKS}, {GONE}")}, base)

    def reembed(self, model=None, dim: int = 64) -> None:
        """All embeddings anew; empty texts are embedded as the word empty."""
        base = self.version
        text = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").otherwise(F.col("text"))
        rows = embed(self.rows(base).withColumn("_text", text), "_text", model, dim).drop("_text")
        self.ledger.replace({"chunks": (_there(rows.withColumn("embedding", F.col("embedding").cast("array<float>"))), f"{CHUNKS}, {GONE}")}, base)

    def stats(self) -> DataFrame:
        return self.rows().agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("page_id").alias("pages"), F.max(F.size("embedding")).alias("dimension"))


class GraphStore:
    """Nodes and edges under a path. Nodes are upserted by label and key with merged properties, edges by both ends and kind with added counts."""

    NODE, EDGE = ["label", "key"], ["src_label", "src_key", "rel", "dst_label", "dst_key"]

    def __init__(self, spark: SparkSession, path: str, ledger: Ledger | None = None):
        self.ledger = ledger or Ledger(spark, path)

    @staticmethod
    def _props(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Of each key the newest value of each property."""
        each = rows.select(*keys, "_seq", F.explode("props").alias("k", "x"))
        last = each.groupBy(*keys, "k").agg(F.max_by("x", F.struct("_seq", "x")).alias("x"))
        return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "x")))).alias("props"))

    def _merged(self, rows: DataFrame, keys: list[str], *value) -> DataFrame:
        out = rows.groupBy(*keys).agg(*value)
        return out.join(self._props(rows, keys), keys, "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))

    def nodes(self, at: int | None = None) -> DataFrame:
        """name, type and alias are the newest; several of one commit: the largest (name, type, alias)."""
        rest = ["name", "type", "alias"]
        rows = self.ledger.read("nodes", graph.NODES, at)
        out = self._merged(rows, self.NODE, F.max(F.struct("_seq", *rest)).alias("r"))
        return out.select(*self.NODE, *[F.col(f"r.{c}").alias(c) for c in rest], "props")

    def edges(self, at: int | None = None) -> DataFrame:
        out = self._merged(self.ledger.read("edges", graph.EDGES, at), self.EDGE, F.sum("count").alias("count"))
        return out.select(*self.EDGE, "count", "props")

    def add(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, source: tuple[str, int] | None = None) -> bool:
        """Nodes and edges in one commit."""
        new = {"nodes": (nodes, graph.NODES), "edges": (edges, graph.EDGES)}
        return self.ledger.add({t: x for t, x in new.items() if x[0] is not None}, source)

    def add_nodes(self, new: DataFrame) -> None:
        self.add(nodes=new)

    def add_edges(self, new: DataFrame) -> None:
        self.add(edges=new)

    def compact(self) -> None:
        base = self.ledger.state()[0]
        self.ledger.replace({"nodes": (self.nodes(base), graph.NODES), "edges": (self.edges(base), graph.EDGES)}, base)

    def clear(self) -> None:
        """No nodes and no edges; the versions before stay readable."""
        self.ledger.replace({"edges": (None, ""), "nodes": (None, "")})

    def search(self, kind: str, value: str) -> DataFrame:
        """faculty: people by part of their name, with labs, projects and topics; topic: topics with people and labs."""
        found = {"faculty": graph.find_faculty, "topic": graph.find_topic}
        if kind not in found:
            raise ValueError(f"no search for {kind}; there are {sorted(found)}")
        return found[kind](self.nodes(), self.edges(), value)


class ChatStore:
    """Threads, messages and the contexts of messages under a path.

    A thread's row changes by rows with the same id: counts add up, times grow, the last status counts. So adding
    messages writes the messages, their contexts and one small row a thread, in one commit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.ledger = Ledger(spark, path)

    def threads(self, at: int | None = None) -> DataFrame:
        rows = self.ledger.read("threads", f"{THREADS}, {GONE}", at)
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c)
        out = rows.groupBy("thread_id").agg(last("user_id"), last("title"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), last("status"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_count"), F.max("_gone").alias("_gone"))
        # Changes of threads that don't exist, and threads that were deleted, are not there.
        return out.where(~F.col("_gone") & F.col("created_at").isNotNull()).drop("_gone")

    def messages(self, at: int | None = None) -> DataFrame:
        return newest(self.ledger.read("messages", f"{MESSAGES}, {GONE}", at), ["message_id"])

    def contexts(self, at: int | None = None) -> DataFrame:
        return newest(self.ledger.read("contexts", f"{CONTEXTS}, {GONE}", at), ["context_id"])

    def _changed(self, rows: DataFrame) -> tuple[DataFrame, str]:
        empty = rows.sparkSession.createDataFrame([], f"{THREADS}, {GONE}")
        return empty.unionByName(_there(rows), allowMissingColumns=True), f"{THREADS}, {GONE}"

    def create(self, first: DataFrame, now: Column) -> DataFrame:
        """A thread for each first question; gives the new rows."""
        new = chat.new_threads(first, now)
        self.ledger.add({"threads": self._changed(new)})
        return new

    def add(self, new: DataFrame, sources: DataFrame | None = None) -> None:
        """Messages, and the chunks that they were answered from (message_id, chunk_text, source, score; their first 1000 characters)."""
        more = new.groupBy("thread_id").agg(F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("updated_at"))
        tables = {"messages": (_there(new), f"{MESSAGES}, {GONE}"), "threads": self._changed(more)}
        if sources is not None:
            used = chat.message_contexts(sources).join(new.select("message_id", "created_at"), "message_id", "left")
            number = F.row_number().over(Window.partitionBy("message_id").orderBy(F.desc("score"), "source", "chunk_text"))
            used = used.select(chat.stable_id(F.col("message_id"), number.cast("string")).alias("context_id"), "message_id", F.col("source").alias("chunk_url"), "chunk_text", F.col("score").alias("relevance_score"), "created_at")
            tables["contexts"] = (_there(used), f"{CONTEXTS}, {GONE}")
        self.ledger.add(tables)

    def archive(self, thread_id: str, now: Column) -> None:
        row = self.threads().where(F.col("thread_id") == thread_id).select("thread_id", now.alias("updated_at"), F.lit("archived").alias("status"))
        self.ledger.add({"threads": self._changed(row)})

    def delete(self, ids: DataFrame) -> None:
        """Threads with their messages and contexts, in one commit."""
        ids = ids.select("thread_id").distinct()
        said = self.messages().join(ids, "thread_id", "left_semi").select("message_id")
        used = self.contexts().join(said, "message_id", "left_semi").select("context_id")
        self.ledger.add({
            "threads": (_gone(ids, THREADS), f"{THREADS}, {GONE}"), "messages": (_gone(said, MESSAGES), f"{MESSAGES}, {GONE}"), "contexts": (_gone(used, CONTEXTS), f"{CONTEXTS}, {GONE}"),
        })

    def compact(self) -> None:
        base = self.ledger.state()[0]
        parts = (("threads", self.threads(base), THREADS), ("messages", self.messages(base), MESSAGES), ("contexts", self.contexts(base), CONTEXTS))
        self.ledger.replace({t: (_there(rows), f"{schema}, {GONE}") for t, rows, schema in parts}, base)

    def purge(self, now: Column, days: int = 30) -> int:
        """Deletes threads that are archived and untouched for so many days; gives their number."""
        old = chat.purgeable(self.threads(), now, days)
        n = old.count()
        if n:
            self.delete(old)
        return n


class KnowledgeBase:
    """Chunks, graph and pages under one path and one ledger, loaded together: a batch is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.vectors = VectorStore(spark, path)
        self.ledger = self.vectors.ledger
        self.graph = GraphStore(spark, path, self.ledger)

    def pages(self, at: int | None = None) -> DataFrame:
        """The newest row of each page."""
        return newest(self.ledger.read("pages", f"{PAGE_ROWS}, {GONE}", at), ["page_id"])

    def dropped(self) -> DataFrame:
        return newest(self.ledger.read("dropped", f"{DROPPED}, {GONE}"), ["url"])

    def load(self, pages: DataFrame, chunks: DataFrame, mentions: DataFrame, source: tuple[str, int] | None = None, dropped: DataFrame | None = None) -> bool:
        """Page rows, chunks with embeddings, and mentions as nodes and edges, in one commit. A source and number that were loaded before change nothing (false).

        A node stands for each page and each entity, an edge (its count among it) for each mention.
        """
        if source and self.ledger.seen(*source):
            return False
        props = F.create_map().cast("map<string,string>")
        alias = F.lit(None).cast("string")
        page_nodes = pages.select(F.lit("Page").alias("label"), F.col("page_id").alias("key"), F.col("title").alias("name"), F.col("page_type").alias("type"), alias.alias("alias"), F.create_map(F.lit("url"), F.col("url")).alias("props"))
        names = mentions.select("entity_type", "entity_name").distinct()
        named = names.select(F.col("entity_type").alias("label"), F.col("entity_name").alias("key"), F.col("entity_name").alias("name"), F.col("entity_type").alias("type"), alias.alias("alias"), props.alias("props"))
        edges = mentions.groupBy("page_id", "entity_type", "entity_name").agg(F.sum("count").alias("count"))
        edges = edges.select(F.lit("Page").alias("src_label"), F.col("page_id").alias("src_key"), F.lit("MENTIONS").alias("rel"), F.col("entity_type").alias("dst_label"), F.col("entity_name").alias("dst_key"), "count", props.alias("props"))
        own = self.spark.createDataFrame([], f"{PAGE_ROWS}, {GONE}")
        rows = own.unionByName(_there(pages.select(*[c for c in own.columns if c != "_gone"]))).dropDuplicates(["page_id"])
        tables = {"pages": (rows, f"{PAGE_ROWS}, {GONE}"), "nodes": (page_nodes.unionByName(named), graph.NODES), "edges": (edges, graph.EDGES)}
        if dropped is not None:
            tables["dropped"] = (_there(dropped.dropDuplicates(["url"])), f"{DROPPED}, {GONE}")
        return self.ledger.add(self.vectors._tables(chunks) | tables, source)

    def load_in_parts(self, pages: DataFrame, chunks: DataFrame, mentions: DataFrame, source: str, flush: int = 10_000) -> int:
        """As ``load``, in commits of about ``flush`` pages (by a hash of their ids); goes on where an earlier call broke off. Gives the commits made."""
        parts = max(1, -(-pages.count() // flush))
        here = lambda df, n: df.where(F.pmod(F.xxhash64("page_id"), F.lit(parts)) == n)
        return sum(self.load(here(pages, n), here(chunks, n), here(mentions, n), (f"{source}/{parts}", n)) for n in range(parts))
