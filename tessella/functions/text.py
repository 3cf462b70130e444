"""Text columns: cleaning, sentences, statistics, overlapping chunks, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words of keyword extraction, and the shorter list of query analysis.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are", "was", "were", "be", "this",
    "that", "these", "those", "what", "which", "who", "when", "where", "how", "why", "all", "about", "tell", "me",
)
SHORT_STOP_WORDS = ("the", "and", "for", "are", "with", "this", "that")


def bound(value: Column, f) -> Column:
    """f(value), where the value is worked out once however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words; Unicode white space counts, null and blank texts have none."""
    # Most texts come with single spaces already: finding that out is cheaper than replacing them.
    spaced = bound(F.coalesce(text, F.lit("")), lambda t: F.trim(F.when(t.rlike(r"(?U)[\s&&[^ ]]|  "), F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t)))
    return bound(spaced, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def clean_text(text: Column) -> Column:
    """White space to single spaces, control characters out, repeated .!? to one, trimmed; null stays null."""
    t = F.regexp_replace(text, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"[\x00-\x1f\x7f-\x9f]", "")
    for mark in (r"\.", "!", r"\?"):
        t = F.regexp_replace(t, mark + "{2,}", mark[-1])
    return F.trim(t)


def sentences(text: Column) -> Column:
    """Non-empty trimmed parts between runs of .!?"""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def text_stats(text: Column) -> Column:
    """Struct of char, word and sentence counts, mean word length and words a sentence (0 where there is none)."""
    w, s = words(text), sentences(text)
    n, letters = F.size(w), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    return F.struct(
        F.length(F.coalesce(text, F.lit(""))).alias("char_count"), n.alias("word_count"), F.size(s).alias("sentence_count"),
        F.when(n > 0, letters / n).otherwise(0.0).alias("avg_word_length"), F.when(F.size(s) > 0, n / F.size(s)).otherwise(0.0).alias("avg_sentence_length"),
    )


def chunk_count(n: Column, size: int = 250, overlap: int = 50, least: int = 50) -> Column:
    """Number of overlapping windows that n words give."""
    return F.when(n < least, 0).otherwise(1 + F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)))).cast("int")


def chunks(df: DataFrame, keys: list[str], text_col: str = "text", size: int = 250, overlap: int = 50, least: int = 50) -> DataFrame:
    """A row for each window of ``size`` words, ``overlap`` shared with the next: keys, chunk_id (from 1), text, word_count, start_word, end_word.

    Texts are cut where they lie; nothing is shuffled.
    """
    step = size - overlap
    rows = df.select(*keys, words(F.col(text_col)).alias("__w"))
    windows = bound(chunk_count(F.size("__w"), size, overlap, least), lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    # Texts without a window go after the generator: a filter before it, written or inferred, would cut every text into words again.
    rows = rows.select(*keys, "__w", F.explode_outer(windows).alias("__i")).where("__i IS NOT NULL")
    part = F.slice("__w", F.col("__i") * step + 1, size)
    return rows.select(
        *keys, (F.col("__i") + 1).alias("chunk_id"), F.array_join(part, " ").alias("text"), F.size(part).alias("word_count"),
        (F.col("__i") * step).alias("start_word"), (F.col("__i") * step + F.size(part)).alias("end_word"),
    )


def keywords(query: Column, stop_words: list[str] = STOP_WORDS, longer_than: int = 2) -> Column:
    """Lower-cased word tokens that are no stop words and longer than two characters."""
    tokens = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(tokens, lambda w: ~w.isin(*stop_words) & (F.length(w) > longer_than))


def contains_any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, whatever stands between."""
    spaced = F.regexp_replace(F.lower(text), r"(\p{L}+)", "\u0001$1")
    parts = F.split(spaced, "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
