"""The five stages of reranking: cross scores, intent boosts, marginal relevance, signals, quality filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import EXAMPLE, Profile
from ..functions.text import contains_any
from ..functions.urls import host_of
from .fuse import _product, _reasons

EXCLUDED = ("/form/", "google.com/forms", "/admission/", "/apply/")


def _top(df: DataFrame, score: str, k: int, before: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 12)), before))
    return df.withColumn("__r", r).where(F.col("__r") <= k).drop(before).withColumnRenamed("__r", before)


def _low(name: str) -> Column:
    return F.lower(F.coalesce(name, F.lit("")))


def token_overlap(query: Column, text: Column) -> Column:
    """The offline cross scorer: share of the query's distinct tokens that the text has."""
    tokens = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)))
    q = tokens(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def stage1(hits: DataFrame, k: int = 100, scorer=None, score: str = "score", rank: str = "rank") -> DataFrame:
    """Cross scores of (query, first 512 characters) or, without a scorer, the hits' own scores. A scorer is a function of two columns."""
    s = scorer(F.col("query"), F.substring("text", 1, 512)) if scorer else F.col(score)
    return _top(hits.withColumn("stage1_score", F.coalesce(s.cast("double"), F.lit(0.0))), "stage1_score", k, rank)


def stage2_boost(query: Column, faculty: Column, listing: Column, page_type: Column, title: Column, source: Column) -> tuple[Column, Column]:
    """(boost, reasons)."""
    lists = contains_any(page_type, ("faculty-list", "faculty_list"))
    fac = F.contains(page_type, F.lit("faculty"))
    dept = F.contains(page_type, F.lit("department")) & contains_any(title, ("faculty", "people"))
    path = faculty & contains_any(source, ("/faculty/", "/people/"))
    wide = listing & contains_any(page_type, ("faculty-list", "directory", "department"))
    person = contains_any(page_type, ("profile", "bio"))
    detail = ~listing & contains_any(F.lower(query), ("about", "tell me", "describe", "what is")) & person
    boost = _product([
        F.when(faculty, F.when(lists, 2.5).when(fac, 2.0).when(dept, 2.2).otherwise(1.0)).otherwise(1.0), F.when(path, 1.8).otherwise(1.0),
        F.when(wide, 1.9).otherwise(1.0), F.when(listing & person, 0.7).otherwise(1.0), F.when(detail, 1.5).otherwise(1.0),
    ])
    why = _reasons([
        F.when(faculty, F.when(lists, "faculty-list page highly relevant for faculty query").when(fac, "faculty page relevant for faculty query").when(dept, "department page with faculty info")),
        F.when(path, "faculty directory URL"), F.when(wide, "comprehensive list page for list query"), F.when(listing & person, "individual profile less useful for list query"), F.when(detail, "detailed profile good for specific query"),
    ])
    return boost, why


def stage2(hits: DataFrame, k: int = 80, rank: str = "rank") -> DataFrame:
    boost, why = stage2_boost(F.col("query"), F.col("is_faculty_query"), F.col("is_list_query"), _low("page_type"), _low("title"), _low("source"))
    rows = hits.withColumns({"llm_boost": boost, "llm_reasons": why})
    return _top(rows.withColumn("stage2_score", F.col("stage1_score") * F.col("llm_boost")), "stage2_score", k, rank)


def select_diverse(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float = 0.7) -> list[int]:
    """Maximal marginal relevance: the first row, then by weight * scaled relevance - (1 - weight) * largest cosine with those taken."""
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-8)
    taken, left = [0], list(range(1, len(relevance)))
    near = unit @ unit[0]
    while left and len(taken) < k:
        r = relevance[left]
        spread = r.max() - r.min()
        r = (r - r.min()) / spread if spread > 0 else r
        best = left.pop(int(np.argmax(np.round(weight * r - (1 - weight) * near[left], 12))))
        taken.append(best)
        near = np.maximum(near, unit @ unit[best])
    return taken


def stage3(hits: DataFrame, k: int = 70, weight: float = 0.7, rank: str = "rank", vector: str = "embedding") -> DataFrame:
    """Diverse selection where a query has more than k hits with vectors, else as they are; at most 80 rows are a group."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable").reset_index(drop=True)
        if len(pdf) > k:
            whole = pdf[vector].map(lambda v: v is not None and len(v) > 0).all()
            order = select_diverse(pdf["stage2_score"].to_numpy(dtype=float), np.array(pdf[vector].tolist(), dtype=float), k, weight) if whole else range(k)
            pdf = pdf.iloc[list(order)]
        return pdf.assign(**{rank: np.arange(1, len(pdf) + 1, dtype=np.int32), "stage3_score": pdf["stage2_score"].to_numpy()})

    return hits.groupBy("query_id").applyInPandas(pick, hits.withColumn(rank, F.col(rank).cast("int")).withColumn("stage3_score", F.col("stage2_score")).schema)


def signals(profile: Profile = EXAMPLE) -> dict[str, Column]:
    """The ten factors of stage 4 from the columns of hits."""
    s, p, t = _low("source"), _low("page_type"), _low("title")
    d = F.lower(F.coalesce(F.when(F.col("domain") != "", F.col("domain")), host_of(s)))
    has = lambda c, *x: contains_any(c, x).cast("int")
    tokens = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0)))
    common = F.size(F.array_intersect(tokens(F.lower("query")), tokens(t)))
    depts, n, rrf = F.coalesce("departments", F.array().cast("array<string>")), F.coalesce("num_strategies", F.lit(1)), F.coalesce("rrf_score", F.lit(0.0))
    full = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    return {
        "url_pattern": 1 + 0.3 * has(s, "/faculty/", "/people/", "/members/", "/staff/") + 0.2 * has(s, "/department/", "/dept/") + 0.15 * has(s, "/lab/", "/laboratory/"),
        "page_type": 1 + 0.35 * has(p, "faculty") + 0.35 * has(p, "department", "faculty-list") + 0.2 * has(p, "research", "lab"),
        "domain_authority": F.when(F.contains(d, F.lit(profile.primary_host)), 1.4).when(contains_any(d, profile.academic_hosts), 1.1).otherwise(1.0),
        "department_match": 1 + 0.25 * ((F.size(depts) > 0) & F.coalesce("matches_dept", F.lit(False))).cast("int") + 0.2 * F.exists(depts, lambda x: F.contains(s, x) | F.contains(d, x)).cast("int"),
        "multi_strategy": F.when(n >= 3, 1.3).when(n >= 2, 1.15).otherwise(1.0),
        "title_relevance": F.when(common >= 3, 1.25).when(common >= 2, 1.15).when(common >= 1, 1.05).otherwise(1.0),
        "content_quality": 1 + 0.1 * full("title") * full("source") + 0.05 * full("description"),
        "exclude_penalty": F.when(contains_any(s, EXCLUDED), 0.3).otherwise(1.0),
        "rrf_contribution": F.when(rrf > 0.02, 1.2).when(rrf > 0.01, 1.1).otherwise(1.0),
        "retriever_intelligence": F.coalesce("intelligence_boost", F.lit(1.0)),
    }


def stage4(hits: DataFrame, profile: Profile = EXAMPLE, rank: str = "rank", description: bool = False) -> DataFrame:
    rows = hits if "description" in hits.columns else hits.withColumn("description", F.lit(None).cast("string"))
    parts = signals(profile)
    rows = rows.withColumn("signal_scores", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))]))
    rows = rows.withColumn("multi_signal_boost", _product([F.col("signal_scores")[k] for k in parts]))
    return _top(rows.withColumn("stage4_score", F.col("stage3_score") * F.col("multi_signal_boost")), "stage4_score", 1 << 30, rank)


def threshold(score: str = "stage4_score") -> Column:
    """max(0.01, min(mean - 2 sd, mean / 10)) over a query's hits."""
    own = Window.partitionBy("query_id")
    mean, sd = F.avg(score).over(own), F.stddev_pop(score).over(own)
    return F.greatest(F.lit(0.01), F.least(mean - 2 * sd, mean * 0.1))


def stage5(hits: DataFrame, k: int = 50, score: str = "stage4_score", rank: str = "rank") -> DataFrame:
    """Above the threshold, with source and text, no form pages; the first of each source and of each title over ten characters.

    A row that falls for its title doesn't use up its source, so the choice is a fold over the query's rows in order.
    """
    s = F.lower("source")
    rows = hits.withColumn("__t", threshold(score)).where(F.col(score) >= F.col("__t")).drop("__t")
    rows = rows.where((F.coalesce("source", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "") & ~contains_any(s, EXCLUDED[:3]))
    rows = rows.withColumn("__low", F.lower(F.coalesce("title", F.lit(""))))
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("source").alias("s"), F.col("__low").alias("t")))).alias("x"))
    start = F.struct(F.array().cast("array<int>").alias("rows"), F.array().cast("array<string>").alias("sources"), F.array().cast("array<string>").alias("titles"))

    def step(acc: Column, x: Column) -> Column:
        ok = (F.size(acc["rows"]) < k) & ~F.array_contains(acc["sources"], x["s"]) & ~(F.array_contains(acc["titles"], x["t"]) & (F.length(x["t"]) > 10))
        return F.when(ok, F.struct(F.array_append(acc["rows"], x["r"].cast("int")).alias("rows"), F.array_append(acc["sources"], x["s"]).alias("sources"), F.array_append(acc["titles"], x["t"]).alias("titles"))).otherwise(acc)

    kept = ordered.select("query_id", F.posexplode(F.aggregate("x", start, step)["rows"]).alias("__p", rank))
    return rows.drop("__low").join(kept, ["query_id", rank]).withColumn("final_rerank_score", F.col(score)).withColumn(rank, F.col("__p") + 1).drop("__p")


def rerank(hits: DataFrame, k: int = 50, scorer=None, profile: Profile = EXAMPLE) -> DataFrame:
    """All stages: 100, 80, 70, all, k hits a query."""
    return stage5(stage4(stage3(stage2(stage1(hits, scorer=scorer))), profile), k)


def apply_listwise(hits: DataFrame, orders: DataFrame, rank: str = "rank") -> DataFrame:
    """Reorders by a list of 1-based positions a query (query_id, positions), as a listwise model gives it; rows not named follow in order."""
    pos = orders.select("query_id", F.posexplode("positions").alias("__p", rank)).groupBy("query_id", rank).agg(F.min("__p").alias("__p"))
    rows = hits.join(pos, ["query_id", rank], "left")
    return rows.withColumn("llm_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("__p"), rank))).drop("__p")


def conversation_rerank(hits: DataFrame, history: DataFrame, factor: float = 1.3, score: str = "score") -> DataFrame:
    """Hits in a new order: the score grows where the text holds an entity of the conversation so far (history: query_id, entities), in any case."""
    said = history.select("query_id", F.transform(F.filter("entities", lambda e: e != ""), lambda e: F.lower(e)).alias("history_entities"))
    low = F.lower(F.coalesce("text", F.lit("")))
    known = F.coalesce(F.exists("history_entities", lambda e: F.contains(low, e)), F.lit(False))
    out = hits.join(said, "query_id", "left").withColumn("history_match", known).withColumn(score, F.when(F.col("history_match"), F.col(score) * factor).otherwise(F.col(score))).drop("history_entities")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 12)), "rank")))
