"""Phrases and scored spans of pluggable recognisers, and the relevance gate of a crawl."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noun_phrases(text: Column, model=None) -> Column:
    """Distinct phrases of at least two words, sorted. ``model`` maps a text column to an array; without one, runs of capitalised words."""
    found = model(text) if model else F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}[\p{L}\p{N}]*(?: +\p{Lu}[\p{L}\p{N}]*)+"), F.lit(0))
    single = F.transform(found, lambda p: F.regexp_replace(p, " +", " "))
    return F.array_sort(F.array_distinct(F.filter(single, lambda p: F.contains(p, F.lit(" ")))))


def confident(spans: Column, least: float = 0.7) -> Column:
    """Spans (structs with a score) above the least score; null, as without a recogniser, gives none."""
    return F.filter(spans, lambda s: s["score"] > least)


def gate(depth: Column, max_depth: Column, relevance: Column, least: float = 0.3) -> Column:
    """Whether a page's links are followed: it lies above the depth limit and is relevant enough."""
    return (depth < max_depth) & (relevance >= least)
