"""Page operators: validation, processing, quality, classification, relevance, links, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions.names import free
from ..functions.text import bound, contains_any, words
from .phrases import gate

#: Terms of research texts; weights of relevance; page types in order of precedence.
RESEARCH_TERMS = ("research", "publication", "paper", "study", "analysis", "journal", "conference", "proceedings", "phd", "thesis", "professor")
RELEVANCE = (
    ("research", 2.0), ("publication", 2.0), ("laboratory", 1.5), ("project", 1.5), ("professor", 1.5), ("phd", 1.5), ("paper", 1.0), ("conference", 1.0), ("journal", 1.0),
    ("study", 1.0), ("experiment", 1.0), ("thesis", 1.5), ("dissertation", 1.5), ("faculty", 1.5), ("lab", 1.5), ("team", 1.0), ("collaboration", 1.0),
)
PAGE_TYPES = (
    ("faculty", ("/faculty/", "/people/", "/staff/"), ("professor", "research interests", "publications")),
    ("lab", ("/lab/", "/labs/", "/research-group/"), ("laboratory", "research group", "lab members")),
    ("course", ("/courses/", "/teaching/", "/academics/"), ("course", "syllabus", "credits")),
    ("project", ("/project/", "/projects/", "/research/"), ("project", "funded by", "collaboration")),
)
REDIRECTS = (301, 302, 303, 307, 308)


def valid(url: Column, title: Column, raw: Column) -> Column:
    ok = lambda c: F.coalesce(c, F.lit("")) != ""
    return ok(url) & ok(title) & ok(raw)


def quality_reason(text: Column, status: Column, split: Column | None = None) -> Column:
    """Why a page is dropped (short, repetitive, redirect), null if it stays. ``split``: the text's words, if they are at hand."""
    w = words(text) if split is None else split
    repeated = 1 - F.size(F.array_distinct(w)) / F.size(w)
    return F.when(F.size(w) < 50, "short").when(repeated > 0.7, "repetitive").when(F.coalesce(status, F.lit(200)).isin(*REDIRECTS), "redirect")


def filter_statistics(pages: DataFrame, reason: str = "reason") -> DataFrame:
    n = F.count(F.lit(1))
    dropped = F.count(reason)
    return pages.agg(n.alias("total"), dropped.alias("dropped"), F.when(n > 0, 100.0 * dropped / n).otherwise(0.0).alias("dropped_percent"))


def text_quality(text: Column, split: Column | None = None) -> Column:
    """From 0 (empty) over 0.5 to 1 by length, research terms and diversity."""
    w = words(text) if split is None else split
    n = F.size(w)
    terms = bound(F.lower(text), lambda low: sum((F.contains(low, F.lit(t)).cast("int") for t in RESEARCH_TERMS), F.lit(0)))
    score = 0.5 + F.when(n >= 200, 0.2).when(n >= 100, 0.1).otherwise(0.0) + F.when(terms >= 3, 0.2).when(terms >= 1, 0.1).otherwise(0.0) + F.when(F.size(F.array_distinct(w)) / n > 0.5, 0.1).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def page_type(url: Column, text: Column, types=PAGE_TYPES) -> Column:
    """The first type of which a URL pattern or two keywords occur, else general."""
    def first(t: Column) -> Column:
        u, out = F.lower(url), None
        for name, patterns, terms in types:
            fits = contains_any(u, patterns) | (sum((F.contains(t, F.lit(k)).cast("int") for k in terms), F.lit(0)) >= 2)
            out = (F.when if out is None else out.when)(fits, name)
        return out.otherwise("general")

    return bound(F.lower(text), first)


def chunk_hints(kind: Column, heading_count: Column) -> Column:
    size = F.when(kind == "faculty", 768).when(kind == "publication", 1024).otherwise(512)
    strategy = F.when(kind.isin("faculty", "lab"), "section").when(kind == "publication", "paragraph").otherwise("sentence")
    return F.struct(size.alias("suggested_chunk_size"), F.lit(50).alias("overlap"), strategy.alias("strategy"), (heading_count > 0).alias("has_headings"), heading_count.alias("heading_count"))


def relevance(raw: Column, lowered: Column | None = None) -> Column:
    """Weighted keyword counts (five at most each) of the raw page, against twice the weights of those present.

    ``lowered``: the page in lower case, if a column has it; else it is made anew for every keyword.
    """
    low = F.lower(raw) if lowered is None else lowered
    # Each keyword is counted by its own search, as keywords lie inside others (lab, laboratory); of a page without it, at the price of looking for it.
    times = F.array(*[F.when(~F.contains(low, F.lit(k)), 0).otherwise(F.least(F.regexp_count(low, F.lit(k)), F.lit(5))) for k, _ in RELEVANCE])

    def score(n: Column) -> Column:
        top = sum((n[i] * w for i, (_, w) in enumerate(RELEVANCE)), F.lit(0.0))
        present = sum((F.when(n[i] > 0, w).otherwise(0.0) for i, (_, w) in enumerate(RELEVANCE)), F.lit(0.0))
        return F.when(present > 0, F.least(F.lit(1.0), top / (2 * present))).otherwise(0.0)

    return bound(times, score)


MADE_COLUMNS = ("title", "domain", "cleaned_text", "metadata", "response_status")
PROCESSED_COLUMNS = ("word_count", "page_type", "text_quality_score", "relevance_score", "content_length", "page_id", "drop_reason", "chunking_hints")


def process(raw: DataFrame, url: str = "url", body: str = "html", status: str | None = None) -> DataFrame:
    """Raw pages to page rows: text, title, metadata, type, quality, ids and hints; one pass, no shuffle."""
    u, h = F.col(url), F.col(body)
    code = F.col(status) if status else F.lit(200)
    low, cut = (free(c, [*raw.columns, *MADE_COLUMNS, *PROCESSED_COLUMNS]) for c in ("own_low", "own_words"))
    made = dict(zip(MADE_COLUMNS, (html.title(h, u, F.col(low)), urls.part(u, "host"), html.page_text(h), html.metadata(h, F.col(low)), code), strict=True))
    # Columns of the raw table that are made here are replaced; all others stay.
    out = raw.withColumn(low, F.lower(h)).withColumns(made)
    text = F.col("cleaned_text")
    out = out.withColumn(cut, words(text)).withColumns({
        "word_count": F.size(cut), "page_type": page_type(u, text), "text_quality_score": text_quality(text, F.col(cut)),
        "relevance_score": relevance(h, F.col(low)), "content_length": F.octet_length(h), "page_id": urls.page_id(u, F.col("domain")), "drop_reason": quality_reason(text, F.col("response_status"), F.col(cut)),
    }).drop(cut, low)
    return out.withColumn("chunking_hints", chunk_hints(F.col("page_type"), F.size("metadata.headings")))


def links(raw: DataFrame, keys: list[str], url: str = "url", body: str = "html") -> DataFrame:
    """A row for each anchor: keys, pos, source, link (absolute and normal), blocked (rule or null), follow, priority."""
    rows = raw.select(*keys, F.col(url).alias("source"), F.posexplode(html.hrefs(F.col(body))).alias("pos", "href"))
    rows = rows.withColumn("link", urls.normalize(urls.resolve(F.col("source"), F.col("href"))))
    return rows.select(*keys, "pos", "source", "link", urls.block_reason(F.col("link")).alias("blocked"), urls.should_follow(F.col("link"), F.col("source")).alias("follow"), urls.priority(F.col("link")).alias("priority"))


def crawl_progress(pages: DataFrame, domain: str = "domain", kind: str = "page_type", time: str = "crawl_date") -> DataFrame:
    """Per domain: pages, first and last crawl, and a map of counts by page type; two partial aggregations."""
    by_type = pages.groupBy(domain, kind).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("a"), F.max(time).alias("b"))
    return by_type.groupBy(F.col(domain).alias("domain")).agg(F.sum("n").alias("total_pages"), F.min("a").alias("started_at"), F.max("b").alias("last_crawl"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("page_types"))


def top_domains(progress: DataFrame, k: int = 5) -> DataFrame:
    return progress.orderBy(F.desc("total_pages"), "domain").limit(k).select("domain", "total_pages")


def expand_frontier(seeds: DataFrame, link_table: DataFrame, primary_host: str, internal_depth: int = 5, external_depth: int = 2, visited: DataFrame | None = None) -> DataFrame:
    """Breadth-first crawl over a table of links (source, link): url, depth, internal; depth starts anew across the host boundary.

    One join a round; rounds end when nothing new is reached, at most after the sum of both depths. Where the table has a column relevance (of the
    source page), only pages that pass the relevance gate are followed.
    """
    inner = lambda c: urls.is_internal(urls.part(c, "host"), primary_host)
    limit = F.when(F.col("internal"), internal_depth).otherwise(external_depth)
    relevance_of = F.coalesce(F.col("relevance"), F.lit(0.0)) if "relevance" in link_table.columns else F.lit(1.0)
    front = seeds.select("url").distinct().withColumns({"depth": F.lit(0), "internal": inner(F.col("url"))})
    if visited is not None:
        front = front.join(visited.select("url").distinct(), "url", "left_anti")
    seen = front
    for _ in range(internal_depth + external_depth + 1):
        step = front.where(F.col("depth") < limit).join(link_table.select(F.col("source").alias("url"), F.col("link"), relevance_of.alias("relevance")), "url")
        step = step.where(gate(F.col("depth"), limit, F.col("relevance")))
        step = step.select(F.col("link").alias("url"), "depth", "internal", inner(F.col("link")).alias("to"))
        step = step.select("url", urls.next_depth(F.col("internal"), F.col("to"), F.col("depth")).alias("depth"), F.col("to").alias("internal"))
        step = step.groupBy("url", "internal").agg(F.min("depth").alias("depth")).select("url", "depth", "internal")
        step = step.join(seen.select("url"), "url", "left_anti")
        if visited is not None:
            step = step.join(visited.select("url").distinct(), "url", "left_anti")
        # With a folder for checkpoints each round is cut off from the ones before; else the kept rounds are the caller's to unpersist.
        front = step.checkpoint() if seeds.sparkSession.sparkContext.getCheckpointDir() else step.persist()
        if front.isEmpty():
            front.unpersist()
            break
        seen = seen.unionByName(front)
    return seen


def seed_frontier(spark, seeds: list[str], primary_host: str, internal_depth: int = 5, external_depth: int = 2) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in seeds], "url string")
    internal = urls.is_internal(urls.part(F.col("url"), "host"), primary_host)
    return rows.select("url", F.lit(0).alias("depth"), F.when(internal, internal_depth).otherwise(external_depth).alias("max_depth"), F.when(internal, "internal").otherwise("external").alias("domain_type"), urls.priority(F.col("url")).alias("priority"))
