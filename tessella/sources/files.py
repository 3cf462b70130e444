"""Scans and sinks: JSON lines with bad lines aside, resume, latest file, exports, versioned tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import free

PAGES = (
    "page_id string, url string, title string, domain string, page_type string, crawl_date timestamp, cleaned_text string, raw_html string, depth int, response_status int, content_length int, "
    "word_count int, relevance_score double, text_quality_score double, metadata struct<description string, keywords string, author string, headings array<struct<level int, text string>>>, "
    "chunking_hints struct<suggested_chunk_size int, overlap int, strategy string, has_headings boolean, heading_count int>"
)
PROCESSED = PAGES + (
    ", text_stats struct<char_count int, word_count int, sentence_count int, avg_word_length double, avg_sentence_length double>, entities map<string, array<struct<text string, label string, start int, `end` int>>>, "
    "keywords array<struct<keyword string, score double>>, chunks array<struct<chunk_id int, text string, word_count int, start_word int, end_word int, embedding array<float>>>, "
    "nlp_processed_date timestamp, embedding_dimension int, nlp_error string, processing_time double, text_truncated boolean, original_length int"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = PAGES, keep_bad: bool = False) -> DataFrame:
    """JSON lines; malformed ones are left out, or kept in _bad."""
    if keep_bad:
        return spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The file last modified, by name among equals."""
    return spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def visited_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string").option("mode", "DROPMALFORMED").json(path).where("url IS NOT NULL").distinct()


def item_id(df: DataFrame) -> Column:
    """page_id or, where it is missing or empty, url."""
    return F.coalesce(F.when(F.col("page_id") != "", F.col("page_id")), F.col("url"))


def unprocessed(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages that no row of done stands for."""
    own = free("own_id", pages.columns)
    ids = done.select(item_id(done).alias(own)).distinct()
    return pages.withColumn(own, item_id(pages)).join(ids, own, "left_anti").drop(own)


def unseen(urls: DataFrame, visited: DataFrame) -> DataFrame:
    return urls.dropDuplicates(["url"]).join(visited.select("url").distinct(), "url", "left_anti")


def export_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Page rows as JSON lines without the raw page."""
    pages.drop("raw_html").write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """A backup under another path."""
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


class Settings:
    """Nested settings with defaults: from a dictionary, or a JSON or YAML file; ``overrides`` maps dotted names to values."""

    def __init__(self, source: dict | str | None = None, overrides: dict | None = None):
        if isinstance(source, str):
            path = source
            with open(path) as f:
                text = f.read()
            try:
                source = json.loads(text)
            except ValueError:
                try:
                    import yaml
                except ImportError as e:
                    raise ValueError(f"{path} is no JSON, and YAML can't be read here") from e
                source = yaml.safe_load(text)  # a broken file is an error, not an empty one
        self.values = source or {}
        for name, value in (overrides or {}).items():
            at = self.values
            *path, last = name.split(".")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value

    def get(self, *keys: str, default=None):
        at = self.values
        for k in keys:
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at
