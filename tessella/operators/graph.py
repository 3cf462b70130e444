"""The property graph as node, edge and mention tables: upserts, one-hop patterns, counts, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .dictionary import containing
from .entities import AGGREGATED_TYPES

NODES = "label string, key string, name string, type string, alias string, props map<string,string>"
EDGES = "src_label string, src_key string, rel string, dst_label string, dst_key string, count bigint, props map<string,string>"


def upsert_nodes(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last writer wins: of each key the row of the highest version; one partial aggregation."""
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(new.select(*old.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*old.columns)


def upsert_edges(old: DataFrame, new: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Counts of equal edges add up."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def merge_properties(old: DataFrame, new: DataFrame, keys: list[str], props: str = "props") -> DataFrame:
    """Property maps merge; the new value of a property wins."""
    rows = old.select(*keys, props, F.lit(0).alias("v")).unionByName(new.select(*keys, props, F.lit(1).alias("v")))
    each = rows.select(*keys, "v", F.explode_outer(props).alias("k", "x"))
    last = each.groupBy(*keys, "k").agg(F.max_by("x", "v").alias("x"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.filter(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "x"))), lambda e: e.isNotNull())).alias(props))


def create_edges(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges (src_label, src_name, rel, dst_label, dst_name) between nodes that exist: keys of both ends and a count of 1."""
    a = nodes.select(F.col("label").alias("src_label"), F.col("name").alias("src_name"), F.col("key").alias("src_key"))
    b = nodes.select(F.col("label").alias("dst_label"), F.col("name").alias("dst_name"), F.col("key").alias("dst_key"))
    return wanted.join(a, ["src_label", "src_name"]).join(b, ["dst_label", "dst_name"]).select("src_label", "src_key", "rel", "dst_label", "dst_key", F.lit(1).cast("long").alias("count")).distinct()


def page_entity_edges(pages: DataFrame, chained: bool = False) -> DataFrame:
    """MENTIONED_IN edges from a map of entities by label. ``chained`` loses labs of pages without persons, and topics of pages without labs, as nested unwinding does."""
    kinds = (("PERSON", "Faculty"), ("LAB_NAME", "Lab"), ("RESEARCH_TOPIC", "ResearchTopic"))
    out, alive = None, F.lit(True)
    for label, node in kinds:
        names = F.col("entities")[label]
        here = F.coalesce(F.size(names) > 0, F.lit(False))
        part = pages.where(alive).select("page_id", F.explode(names).alias("name")).select(F.lit(node).alias("src_label"), F.col("name").alias("src_key"), F.lit("MENTIONED_IN").alias("rel"), F.lit("Page").alias("dst_label"), F.col("page_id").alias("dst_key"), F.lit(1).cast("long").alias("count")).distinct()
        out = part if out is None else out.unionByName(part)
        alive = alive & here if chained else alive
    return out


def _sample(url: str = "url", title: str = "title") -> Column:
    return F.slice(F.array_sort(F.collect_set(F.struct(F.col(url).alias("url"), F.col(title).alias("title")))), 1, 3)


def entity_statistics(mentions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per entity: page_count (distinct), total_mentions and, with pages (page_id, url, title), three sample pages.

    Samples are the first by page id, taken before pages are joined, so that no entity gathers all of its pages.
    """
    base = mentions.groupBy("entity_name", "entity_type").agg(F.countDistinct("page_id").alias("page_count"), F.sum("count").alias("total_mentions"))
    if pages is None:
        return base
    first = mentions.select("entity_name", "entity_type", "page_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("entity_name", "entity_type").orderBy("page_id"))).where("r <= 3")
    named = first.join(pages.select("page_id", "url", "title"), "page_id").groupBy("entity_name", "entity_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "url", "title"))), lambda s: s.dropFields("r")).alias("samples"))
    return base.join(named, ["entity_name", "entity_type"], "left")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def type_statistics(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_type").agg(F.countDistinct("entity_name").alias("entities"), F.sum("count").alias("mentions"))


def top_entities(mentions: DataFrame, kind: str, k: int = 5) -> DataFrame:
    return mentions.where(F.col("entity_type") == kind).groupBy("entity_name").agg(F.countDistinct("page_id").alias("pages")).orderBy(F.desc("pages"), "entity_name").limit(k)


def stats(pages: DataFrame, entities: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    parts = [t.agg(n.alias("count")).select(F.lit(name).alias("item"), "count") for name, t in (("pages", pages), ("entities", entities), ("mentions", mentions), ("chunks", chunks))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def _top(rows: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("total_mentions"), F.desc("page_count"), "entity_name", "entity_type")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matching(queries: DataFrame, entities: DataFrame, terms: str, k: int, columns: tuple[str, ...] = ("entity_name", "entity_type")) -> DataFrame:
    """For each query_id the entities that a term is part of (of their name or type); of each term only the k best, as no other can be among a query's k best.

    So entities meet different terms, not queries, however many queries share a term that is part of many names.
    """
    asked = queries.select("query_id", F.explode(terms).alias("term")).where("term <> ''").distinct()
    best = _top(containing(asked, entities, [*columns]).join(entities, [*columns]), k, "term")
    return best.join(asked, "term").select("query_id", *entities.columns).dropDuplicates(["query_id", "entity_name", "entity_type"])


def search(queries: DataFrame, mentions: DataFrame, entities: DataFrame, pages: DataFrame | None = None, k: int = 20, divisor: float = 100.0) -> DataFrame:
    """Graph strategy: an exact name or alias scores 1 and stands alone; else entities by parts of their names, by mentions.

    queries: query_id, query, search_keywords; entities: entity_name, entity_type, alias. Adds text, score, rank and source.
    """
    low = lambda c: F.lower(F.trim(c)) if isinstance(c, Column) else F.lower(F.trim(F.col(c)))
    names = entities.select("entity_name", "entity_type", F.explode(F.array_distinct(F.filter(F.array(F.lower("entity_name"), F.lower("alias")), lambda x: x.isNotNull()))).alias("__n"))
    exact = queries.select("query_id", low("query").alias("__n")).join(names, "__n").select("query_id", "entity_name", "entity_type").distinct()
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("entity_name", "entity_type"))).where(F.col("rank") <= k)
    nulls = {"page_count": F.lit(None).cast("long"), "total_mentions": F.lit(None).cast("long")}
    exact = exact.withColumns(nulls | {"score": F.lit(1.0), "text": F.concat("entity_name", F.lit(" ("), "entity_type", F.lit(")"))})
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    fuzzy = _top(_matching(rest, entity_statistics(mentions, pages), "search_keywords", k), k)
    fuzzy = fuzzy.withColumns({"score": F.least(F.lit(1.0), F.coalesce("total_mentions", F.lit(0)) / divisor), "text": F.concat("entity_name", F.lit(" ("), "entity_type", F.lit(") - "), F.col("total_mentions").cast("string"), F.lit(" mentions"))})
    return exact.unionByName(fuzzy, allowMissingColumns=True).withColumn("source", F.lit("knowledge_graph"))


def named_entities(queries: DataFrame, mentions: DataFrame, pages: DataFrame, k: int, divisor: float = 100.0) -> DataFrame:
    """For each query (query_id, keywords) the k most mentioned entities whose names hold one of its keywords, with their first page as source and title."""
    rows = mentions.join(pages.select("page_id", "url", "title"), "page_id")
    known = rows.groupBy("entity_name", "entity_type").agg(F.countDistinct("page_id").alias("page_count"), F.sum("count").alias("total_mentions"), F.min(F.struct("url", "title")).alias("p"))
    found = _matching(queries, known, "keywords", k, ("entity_name",))
    return _top(found, k).select("query_id", "entity_name", "entity_type", "page_count", "total_mentions", F.col("p.url").alias("source"), F.col("p.title").alias("title"), F.least(F.col("total_mentions") / divisor, F.lit(1.0)).alias("score"), "rank")


def aggregate_entities(queries: DataFrame, mentions: DataFrame, pages: DataFrame, k: int = 20, least: int = 2, divisor: float = 50.0) -> DataFrame:
    """For list questions: entities of the asked type whose name or page fits a domain term, mentioned more than twice.

    queries: query_id, entities (of analysis). Types are compared in normal form, so that loaders' names fit.
    """
    kw, acronyms = F.col("entities.keywords"), F.col("entities.acronyms")
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    kind = F.when(F.arrays_overlap(kw, arr("faculty", "professor", "researcher", "staff")), "PERSON").when(F.arrays_overlap(kw, arr("lab", "laboratory", "group")), "ORG")
    terms = F.when(F.size(acronyms) > 0, F.transform(acronyms, F.lower)).otherwise(F.slice(F.filter(kw, lambda w: F.length(w) > 3), 1, 3))
    asked = queries.select("query_id", kind.alias("kind"), F.explode(terms).alias("term")).where("kind IS NOT NULL AND term <> ''")
    asked = asked.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("kind", "term"))).alias("wants")).withColumn("key", F.sha2(F.to_json("wants"), 256))
    # Queries that want the same are answered once: pages meet each set of wants, not each query.
    wants = asked.groupBy("key").agg(F.first("wants").alias("wants")).select("key", F.explode("wants").alias("w")).select("key", "w.kind", "w.term")
    own = None
    for name, types in AGGREGATED_TYPES.items():
        own = (F.when if own is None else own.when)(F.lower("entity_type").isin(name.lower(), *types), name)
    # Names, and the mentions that fit by name and by page, are all read from here, so that texts are searched once.
    spark, folder = mentions.sparkSession, shared_folder(mentions.sparkSession, "aggregated")
    mentions.select("page_id", "entity_name", "entity_type", "count", own.alias("kind")).where("kind IS NOT NULL").write.parquet(folder)
    rows, about = spark.read.parquet(folder), pages.select("page_id", "url", "title")
    named = containing(wants, rows, ["entity_name"]).join(wants, "term").select("key", "kind", "entity_name").distinct()
    paged = containing(wants, about, ["url", "title"], keys=["page_id"]).join(wants, "term").select("key", "kind", "page_id", "url", "title").distinct()
    one = rows.join(named, ["kind", "entity_name"]).join(about, "page_id")
    two = rows.join(paged, ["kind", "page_id"])
    cols = ["key", "entity_name", "entity_type", "page_id", "url", "title", "count"]
    hit = one.select(*cols).unionByName(two.select(*cols)).distinct()
    out = hit.groupBy("key", "entity_name", "entity_type").agg(F.countDistinct("page_id").alias("page_count"), F.sum("count").alias("total_mentions"), F.min(F.struct("url", "title")).alias("p"))
    best = _top(out.where(F.col("total_mentions") > least), k, "key")
    out = asked.select("query_id", "key").join(best, "key")
    return out.select("query_id", "entity_name", "entity_type", "page_count", "total_mentions", F.col("p.url").alias("source"), F.col("p.title").alias("title"), F.least(F.col("total_mentions") / divisor, F.lit(1.0)).alias("score"), "rank")


def profiles(nodes: DataFrame, edges: DataFrame, label: str, relations: dict[str, str]) -> DataFrame:
    """Nodes of a label with the names on the other end of each relation (name: column); each side is aggregated before the left join."""
    out = nodes.where(F.col("label") == label).select("key", "name")
    named = nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), F.col("name").alias("other"))
    for rel, column in relations.items():
        side = edges.where((F.col("rel") == rel) & (F.col("src_label") == label)).join(named, ["dst_label", "dst_key"]).groupBy(F.col("src_key").alias("key")).agg(F.array_sort(F.collect_set("other")).alias(column))
        out = out.join(side, "key", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out


def find_faculty(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    return profiles(nodes.where((F.col("label") != "Faculty") | F.contains(F.lower("name"), F.lit(name.lower()))), edges, "Faculty", {"WORKS_IN": "labs", "CONDUCTS": "projects", "RESEARCHES": "topics"})


def find_topic(nodes: DataFrame, edges: DataFrame, topic: str) -> DataFrame:
    """Topics by part of the name with the faculty and the labs that point to them."""
    found = nodes.where((F.col("label") == "ResearchTopic") & F.contains(F.lower("name"), F.lit(topic.lower()))).select("key", F.col("name").alias("topic"))
    for rel, label, column in (("RESEARCHES", "Faculty", "faculty"), ("COVERS", "Lab", "labs")):
        ends = nodes.where(F.col("label") == label).select(F.col("key").alias("src_key"), F.col("name").alias("other"))
        side = edges.where((F.col("rel") == rel) & (F.col("dst_label") == "ResearchTopic")).join(ends, "src_key").groupBy(F.col("dst_key").alias("key")).agg(F.array_sort(F.collect_set("other")).alias(column))
        found = found.join(side, "key", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return found


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs connected by one edge of each relation, with the number of ways."""
    a = edges.where(F.col("rel") == first).select("src_key", F.col("dst_key").alias("mid"))
    b = edges.where(F.col("rel") == second).select(F.col("src_key").alias("mid"), "dst_key")
    return a.join(b, "mid").groupBy("src_key", "dst_key").agg(F.count(F.lit(1)).alias("ways"))


def unique_violations(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
