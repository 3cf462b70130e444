"""Names in texts: a multi-pattern automaton over a broadcast dictionary, in blocks of bounded size.

A block of names (BLOCK_CHARS characters at most on average) goes to all tasks; each builds its automaton once and reads its own texts in one pass
whatever the number of names. More names than a block take a pass each, so neither texts nor names are shuffled, and no name, however frequent, is a
key that rows meet under.

Names and texts are compared in lower case. Null or empty names match nothing, null texts hold none. Repeated names count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the names of one block: the automaton of a worker takes some 50 bytes a character at most.
BLOCK_CHARS = 4_000_000


def _automaton(names: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for n in names:
        a.add_word(n, n)
    a.make_automaton()
    return a


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _spans(automaton, text: str, whole: bool) -> dict[str, list[int]]:
    """name: number of occurrences and place of the first."""
    found: dict[str, list[int]] = {}
    for end, n in automaton.iter(text):
        start = end + 1 - len(n)
        if whole and (_is_word(n[0]) and start > 0 and _is_word(text[start - 1]) or _is_word(n[-1]) and end + 1 < len(text) and _is_word(text[end + 1])):
            continue
        if n in found:
            found[n][0] += 1
            found[n][1] = min(found[n][1], start)
        else:
            found[n] = [1, start]
    return found


def occurrences(texts: DataFrame, names: DataFrame, keys: list[str], text: str = "text", name: str = "name", whole: bool = True) -> DataFrame:
    """keys, name (lower case), count, first (0-based place of the first): a row for each name in each text; whole words, or parts of words too."""
    spark = texts.sparkSession
    low = names.select(F.lower(F.col(name)).alias("name")).where("name <> ''").distinct()
    size = low.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    rows = texts.select(*keys, F.lower(F.col(text)).alias("_text")).where("_text <> ''")
    schema = T.StructType([*texts.select(*keys).schema.fields, T.StructField("name", T.StringType()), T.StructField("count", T.LongType()), T.StructField("first", T.IntegerType())])
    out = None
    for b in range(blocks):
        own = low if blocks == 1 else low.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([r[0] for r in own.collect()])
        found = rows.mapInArrow(_search(shared, len(keys), whole), schema)
        out = found if out is None else out.unionAll(found)
    return out


def _search(shared, keys: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        automaton = None
        for b in batches:
            if not shared.value:
                return
            automaton = automaton or _automaton(shared.value)
            rows, names, counts, first = [], [], [], []
            for i, text in enumerate(b.column(keys)):
                for n, (k, at) in _spans(automaton, text.as_py(), whole).items():
                    rows.append(i)
                    names.append(n)
                    counts.append(k)
                    first.append(at)
            own = [b.column(c).take(pa.array(rows, pa.int64())) for c in range(keys)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(first, pa.int32())], names=[*b.schema.names[:keys], "name", "count", "first"])

    return run


def name_mentions(pages: DataFrame, entities: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """page_id, entity_name, entity_type, count: mentions of known entities (entity_name, entity_type, optional alias), names and aliases together."""
    alias = F.col("alias") if "alias" in entities.columns else F.lit(None).cast("string")
    names = entities.select("entity_name", "entity_type", F.explode(F.array_distinct(F.filter(F.array(F.lower("entity_name"), F.lower(alias)), lambda x: x.isNotNull()))).alias("name")).distinct()
    found = occurrences(pages, names, [page_id], text)
    return found.join(names, "name").groupBy(page_id, "entity_name", "entity_type").agg(F.sum("count").alias("count"))


def containing(terms: DataFrame, texts: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """terms (term) and the distinct texts that hold them in one of the columns, in any case, inside words too: (term, *columns).

    With ``keys``, rows are taken as they are, without a shuffle for different texts, and their keys come first: (term, *keys, *columns).
    """
    out = [*(keys or []), *columns]
    kept = texts.select(*out) if keys else texts.select(*out).distinct()
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    # A mark that no term holds keeps terms from reaching over the border of two columns.
    joined = kept.withColumn("_both", F.concat_ws("\u0001", *low))
    found = occurrences(joined, terms.where(~F.contains("term", F.lit("\u0001"))), out, "_both", "term", whole=False)
    lowered = terms.select("term", F.lower("term").alias("name")).where("name <> ''").distinct()
    return found.join(lowered, "name").select("term", *out)
