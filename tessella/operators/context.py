"""Context and prompts from ranked hits: word budgets, sources, graph lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def packed(hits: DataFrame, budget: int = 4000, rank: str = "rank") -> DataFrame:
    """Hits within a budget of words a query; the one that crosses it is cut. Adds words_before and text (cut)."""
    before = Window.partitionBy("query_id").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.withColumn("__w", words(F.col("text"))).withColumn("words_before", F.coalesce(F.sum(F.size("__w")).over(before), F.lit(0)))
    rows = rows.where(F.col("words_before") < budget)
    cut = F.size("__w") + F.col("words_before") > budget
    return rows.withColumn("text", F.when(cut, F.array_join(F.slice("__w", F.lit(1), (F.lit(budget) - F.col("words_before")).cast("int")), " ")).otherwise(F.col("text"))).drop("__w")


def _joined(df: DataFrame, line: Column, separator: str, rank: str = "rank", name: str = "context") -> DataFrame:
    one = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("x"))))
    return df.groupBy("query_id").agg(F.array_join(F.transform(one, lambda s: s["x"]), separator).alias(name))


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def generation_context(hits: DataFrame, graph: DataFrame | None = None, budget: int = 4000, graph_lines: int = 5) -> DataFrame:
    """query_id, context: documents within the budget, then graph lines, between empty lines."""
    rows = packed(hits, budget)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("line", F.concat(F.lit("[Document "), n.cast("string"), F.lit(" - "), _or("page_type", "general"), F.lit("] "), _or("title", "Untitled"), F.lit("\n"), F.col("text"), F.lit("\nSource: "), _or("source", "Unknown"))).select("query_id", F.col("rank").cast("long").alias("rank"), "line")
    if graph is not None:
        lines = graph.where(F.col("rank") <= graph_lines).select("query_id", (F.col("rank") + (1 << 40)).alias("rank"), F.concat(F.lit("[Knowledge Graph] "), _or("entity_name", "Entity"), F.lit(" ("), _or("entity_type", "Unknown"), F.lit(") - "), F.coalesce("total_mentions", F.lit(0)).cast("string"), F.lit(" mentions")).alias("line"))
        rows = rows.unionByName(lines)
    return _joined(rows, F.col("line"), "\n\n")


def enhanced_context(hits: DataFrame) -> DataFrame:
    """20 full hits for list questions, else 10 of 500 characters."""
    r, lst = F.col("rank").cast("string"), F.col("is_list_query")
    rows = hits.where(F.col("rank") <= F.when(lst, 20).otherwise(10))
    full = F.concat(F.lit("[Source "), r, F.lit(" - "), _or("page_type", "general"), F.lit("]\nTitle: "), _or("title", "Untitled"), F.lit("\nContent: "), F.col("text"), F.lit("\nURL: "), _or("source", "Unknown"), F.lit("\n"))
    short = F.concat(F.lit("[Source "), r, F.lit("] "), F.when(F.length("text") <= 500, F.col("text")).otherwise(F.concat(F.substring("text", 1, 500), F.lit("..."))), F.lit("\n"))
    return _joined(rows, F.when(lst, full).otherwise(short), "\n---\n")


def prompt_context(hits: DataFrame) -> DataFrame:
    """All hits with 500 characters each, as the conversation flow shows them."""
    return _joined(hits, F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] Title: "), _or("title", "Unknown"), F.lit("\nURL: "), _or("source", "Unknown"), F.lit("\n"), F.substring("text", 1, 500)), "\n\n")


def graph_text(name: Column, kind: Column, pages: Column, mentions: Column, titles: Column, urls: Column) -> Column:
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    line = F.concat(F.lit("Entity: "), name, F.lit(" ("), kind, F.lit(") - Mentioned in "), n(pages), F.lit(" pages, "), n(mentions), F.lit(" total mentions"))
    more = lambda a, k, label: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.concat(F.lit(label), F.array_join(F.slice(a, 1, k), ", "))).otherwise("")
    return F.concat(line, more(titles, 3, "\nRelated pages: "), more(urls, 2, "\nSources: "))


def sources(hits: DataFrame, k: int = 5) -> DataFrame:
    return hits.where(F.col("rank") <= k).select("query_id", "rank", _or("title", "Untitled").alias("title"), F.coalesce("source", F.lit("")).alias("url"), _or("page_type", "general").alias("page_type"), F.format_string("%.3f", F.coalesce("final_rerank_score", F.lit(0.0))).alias("relevance_score"))


SYSTEM = {
    "list": "You list everything the context holds on the question: every name, with affiliation and link, none left out.",
    "specific": "You answer from the context alone: name people, groups and places, cite sources, keep the order of importance.",
}


def prompt(query: Column, listing: Column, history: Column, context: Column, max_tokens: int = 1500) -> Column:
    """Struct (system, user, max_tokens): three times the tokens for list questions, 4000 at most; history is the last messages as text."""
    user = F.concat(F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("Conversation so far:\n"), history, F.lit("\n\n"))).otherwise(""), F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query)
    return F.struct(F.when(listing, SYSTEM["list"]).otherwise(SYSTEM["specific"]).alias("system"), user.alias("user"), F.when(listing, min(4000, 3 * max_tokens)).otherwise(max_tokens).alias("max_tokens"))


def extractive_answer(context: Column, limit: int = 1000) -> Column:
    """The offline answer: the head of the context, or a plain word that there is none."""
    return F.when(F.coalesce(context, F.lit("")) == "", "No relevant information was found.").otherwise(F.substring(context, 1, limit))


def neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (page_id, chunk_id) with the chunks before and after as text_before and text_after."""
    w = Window.partitionBy("page_id").orderBy("chunk_id")
    return hits.join(chunks.select("page_id", "chunk_id", F.lag("text").over(w).alias("text_before"), F.lead("text").over(w).alias("text_after")), ["page_id", "chunk_id"], "left")
