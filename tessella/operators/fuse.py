"""Rank fusion, boosts and diversification of hits; all queries of a batch in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import EXAMPLE, Profile
from ..functions.text import contains_any
from ..functions.urls import host_of

RRF_K = 60
#: Order in which strategies are merged, and URL patterns.
STRATEGIES = ("dense", "lexical", "graph", "targeted")
URL_PATTERNS = {
    "faculty": ("/faculty/", "/people/", "/members/", "/staff/", "/researchers/", "/team/"),
    "lab": ("/lab/", "/laboratory/", "/research-group/", "/group/", "/center/", "/centre/"),
    "exclude": ("/form/", "google.com/forms", "/admission/", "/apply/", "/application/"),
}


def document_key(source: Column, entity: Column, text: Column) -> Column:
    full = lambda c: F.when(c != "", c)
    return F.coalesce(full(source), full(entity), F.substring(text, 1, 100))


def reciprocal_rank(hits: DataFrame, key: str = "doc_key", top: int | None = 100, payload: list[str] | None = None) -> DataFrame:
    """Fuses hits (query_id, strategy, rank from 1, key, payload): the score is the sum of 1 / (60 + rank).

    num_strategies counts contributing hits, n_distinct_strategies their strategies; the payload is the first seen in the
    order of strategies, then rank. Ties in score go to the first seen, then the key.
    """
    order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy")), F.lit(0))
    order = F.when(order == 0, len(STRATEGIES) + 1).otherwise(order)
    rows = hits.withColumn("__seen", F.struct(order.alias("o"), F.col("rank").alias("r")))
    first = [F.min_by(F.struct(*payload), F.col("__seen")).alias("__payload")] if payload else []
    # Distinct strategies are counted in the list: a distinct count beside other aggregates takes two more rounds of them.
    fused = rows.groupBy("query_id", key).agg(
        F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf_score"), F.transform(F.array_sort(F.collect_list(F.struct("__seen", "strategy"))), lambda s: s["strategy"]).alias("matched_strategies"),
        F.count(F.lit(1)).alias("num_strategies"), F.min("__seen").alias("__first"), *first,
    )
    distinct = F.size(F.array_compact(F.array_distinct("matched_strategies"))).cast("long")
    fused = fused.select("query_id", key, "rrf_score", "matched_strategies", "num_strategies", distinct.alias("n_distinct_strategies"), "__first", *[F.col(f"__payload.{c}").alias(c) for c in payload or []])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "__first", key))
    fused = fused.withColumn("fused_rank", rank).drop("__first")
    return fused.where(F.col("fused_rank") <= top) if top else fused


def fuse_variations(hits: DataFrame, key: str = "source", top: int | None = None) -> DataFrame:
    """The same fusion over variations of a query (query_id, variation, rank from 0, key); a missing key is doc_ and the rank."""
    k = F.coalesce(F.when(F.col(key) != "", F.col(key)), F.concat(F.lit("doc_"), F.col("rank").cast("string")))
    fused = hits.withColumn("__key", k).groupBy("query_id", F.col("__key").alias("doc_key")).agg(F.sum(1 / (RRF_K + F.col("rank") + 1)).alias("score"), F.count(F.lit(1)).alias("hits"))
    fused = fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_key")))
    return fused.where(F.col("fused_rank") <= top) if top else fused


def _product(factors: list[Column]) -> Column:
    out = F.lit(1.0)
    for f in factors:
        out = out * f
    return out


def _reasons(pairs: list[Column]) -> Column:
    return F.filter(F.array(*pairs), lambda r: r.isNotNull())


def intelligence_boost(hits: DataFrame, faculty: str = "is_faculty_query", listing: str = "is_list_query", depts: str = "departments", base: str = "rrf_score") -> DataFrame:
    """Adds intelligence_boost, boost_reasons and final_score from page type, source and number of strategies."""
    p, s, n = F.lower(F.coalesce("page_type", F.lit(""))), F.lower(F.coalesce("source", F.lit(""))), F.coalesce("num_strategies", F.lit(1))
    fac, lst = F.col(faculty), F.col(listing)
    is_list = contains_any(p, ("faculty-list", "faculty_list"))
    kind = F.when(is_list, 2.5).when(F.contains(p, F.lit("faculty")), 2.0).when(F.contains(p, F.lit("department")), 1.8).otherwise(1.0)
    kind_why = F.when(is_list, "faculty-list page for faculty query").when(F.contains(p, F.lit("faculty")), "faculty page for faculty query").when(F.contains(p, F.lit("department")), "department page for faculty query")
    path = fac & contains_any(s, ("/faculty/", "/people/", "/members/"))
    pages = lst & contains_any(p, ("faculty-list", "department", "directory"))
    dept = F.exists(F.col(depts), lambda d: F.contains(s, d))
    several = F.when(n >= 3, 1.4).when(n >= 2, 1.2).otherwise(1.0)
    boost = _product([F.when(fac, kind).otherwise(1.0), F.when(path, 1.5).otherwise(1.0), F.when(pages, 1.8).otherwise(1.0), F.when(dept, 1.6).otherwise(1.0), several])
    why = _reasons([F.when(fac, kind_why), F.when(path, "faculty URL pattern"), F.when(pages, "list-type page for list query"), F.when(dept, "department domain match"), F.when(n >= 2, F.format_string("matched %d strategies", n))])
    return hits.withColumn("intelligence_boost", boost).withColumn("boost_reasons", why).withColumn("final_score", F.col(base) * F.col("intelligence_boost"))


def url_boost(url: Column, query: Column, profile: Profile = EXAMPLE) -> Column:
    """Of targeted retrieval: 0.3 for excluded pages, else a product of patterns that suit the query."""
    u, q = F.lower(url), F.lower(query)
    people = contains_any(q, ("faculty", "professor", "researcher", "staff", "who is", "people")) & contains_any(u, URL_PATTERNS["faculty"])
    labs = contains_any(q, ("lab", "laboratory", "group")) & contains_any(u, URL_PATTERNS["lab"])
    own = F.contains(u, F.lit(profile.primary_host))
    return F.when(contains_any(u, URL_PATTERNS["exclude"]), 0.3).otherwise(_product([F.when(people, 2.0).otherwise(1.0), F.when(labs, 1.8).otherwise(1.0), F.when(own, 1.3).otherwise(1.0)]))


def dynamic_boost(url: Column, patterns: Column, hints: Column, profile: Profile = EXAMPLE) -> Column:
    """Of adaptive retrieval: 0.2 for other institutions, 0.3 for forms, else a product."""
    u = F.lower(url)
    own = F.when(F.contains(u, F.lit(profile.primary_host)), 2.0).otherwise(1.0)
    directory = F.when(u.rlike("/(faculty|people|staff)/$"), 3.0).otherwise(1.0)
    fit = F.when(F.exists(patterns, lambda p: F.contains(u, F.lower(p))), 1.8).otherwise(1.0)
    named = F.when(F.exists(hints, lambda h: F.contains(u, F.lower(h))), 1.5).otherwise(1.0)
    return F.when(contains_any(u, profile.external_hosts), 0.2).when(contains_any(u, URL_PATTERNS["exclude"][:4]), 0.3).otherwise(own * directory * fit * named)


def department_match(depts: Column, domain: Column, url: Column) -> Column:
    return F.exists(depts, lambda d: F.contains(F.lower(F.coalesce(domain, F.lit(""))), d) | F.contains(F.lower(F.coalesce(url, F.lit(""))), d))


def diversified(hits: DataFrame, k: int = 50, host_cap: int = 5, type_cap: int = 10, sure: float = 0.05) -> DataFrame:
    """At most k hits a query: greedily with caps by host and page type (lifted for high scores), then filled up in order.

    A query's hits (at most twice k come out of fusion) are one group; adds div_rank.
    """
    host = F.coalesce(F.when(F.col("domain") != "", F.col("domain")), host_of(F.col("source")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.nanvl("final_score", F.lit(None))), "fused_rank"))
    rows = hits.withColumns({"__host": host, "__own": host_of(F.col("source")), "__place": place})
    schema = hits.withColumn("div_rank", F.lit(1)).schema

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The window leaves a query's rows together and in order, so a query ends where a first place follows; its rows may stand in two batches."""
        left = None
        for b in batches:
            whole = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            first = np.flatnonzero(whole.column("__place").to_numpy() == 1)
            if len(first):
                yield from chosen(whole.slice(0, first[-1]), first)
            left = whole.slice(first[-1] if len(first) else 0)
        if left is not None:
            yield from chosen(left, np.zeros(1, dtype=int))

    def chosen(whole: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(whole):
            return
        score, hosts, owns, types = whole.column("final_score").to_numpy(), *(whole.column(c).to_pylist() for c in ("__host", "__own", "page_type"))
        rows, ranks = [], []
        for start, end in zip(first, [*first[1:], len(whole)], strict=True):
            if start < end:
                own = range(start, end) if end - start <= k else greedy(score, hosts, owns, types, start, end)
                rows += own
                ranks += range(1, len(own) + 1)
        out = whole.take(pa.array(rows)).drop_columns(["__host", "__own", "__place"]).append_column("div_rank", pa.array(ranks, pa.int32()))
        yield from out.combine_chunks().to_batches()

    def greedy(score, hosts, owns, types, start: int, end: int) -> list[int]:
        taken, skipped, by_host, by_type = [], [], {}, {}
        for i in range(start, end):
            if len(taken) == k:
                break
            if score[i] <= sure and (by_host.get(hosts[i], 0) >= host_cap or by_type.get(types[i], 0) >= type_cap):
                skipped.append(i)
                continue
            taken.append(i)
            by_host[owns[i]] = by_host.get(owns[i], 0) + 1
            by_type[types[i]] = by_type.get(types[i], 0) + 1
        return taken + skipped[: k - len(taken)]

    return rows.mapInArrow(pick, schema)


def cap_per_source(hits: DataFrame, n: int = 10, order: str = "rank") -> DataFrame:
    return hits.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(order))).where(F.col("__r") <= n).drop("__r")
