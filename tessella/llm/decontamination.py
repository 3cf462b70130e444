"""Benchmark decontamination: a prefix-filtered set join of item windows with documents; DataFrame operations only.

A window is WINDOW consecutive words of an item (a shorter item is one window). A document that contains a window
contains every shingle of it, hence also the rarest: a prefix of one shingle is necessary and enough for a candidate.

1. The distinct windows of all items, and their shingles of up to SHINGLE words, as 64-bit hashes with their offsets.
2. One pass over the documents finds all occurrences of these shingles, and writes each with its place and the words around it
   (2 * WINDOW - 1 at most), beside a row for each document. That is all that is read of the texts.
3. How often each shingle occurs orders a window's shingles by rarity; the rarest is its prefix. A window with a shingle that
   never occurs is dropped. Occurrences of prefixes are joined with their windows: a window can only begin at the place
   of its prefix less its offset; it must not begin before the document or end behind it (positional and length bounds),
   and its words must equal the document's there. So hashes only propose, words decide.
4. Hits are spans; a document's hit words are the union of its spans, its items those of its windows.

In the pass a document is cut into segments of SEGMENT words with their surroundings, so that what a place carries along doesn't grow with
the text. Hashes to look for are broadcast, BLOCK at a time (16 MB); a larger benchmark takes several passes in blocks. Windows are
broadcast up to BROADCAST_WINDOWS rows and shuffled beyond. Texts never move. Nothing is paired but a prefix with its own occurrences. What is
written grows with the hits: some 100 bytes for each word of a passage.

Documents are told apart by their place in the scan, which has to be the same when it is repeated (files are). Null and empty texts have no words. Items
without words have no window. Items with a null id count as one item, listed as an empty string; repeated item ids are one item. Documents with equal
ids and texts are rows of their own with equal results; null ids are kept. Extra columns are ignored. Empty tables: no rows, or no hits. Very long texts are
read whole, as one array of words in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, removed, table, written

WINDOW, SHINGLE, SEGMENT = 10, 5, 32
#: Hashes that one pass over the documents looks for; windows and hit documents up to which a side is broadcast (about 200 bytes each).
BLOCK, BROADCAST_WINDOWS = 1_000_000, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for a document's own row among the hashes; its place is 0.
OWN = 0


def _table(rows: DataFrame, name: str) -> DataFrame:
    """Written without compression, whose buffers are memory beside the heap in every task that writes or reads."""
    return written(rows, name, packed=False)


def item_words(text: Column) -> Column:
    """Lower-cases A-Z, by the faster function where all characters are ASCII, and cuts words."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle(hashes: Column, i: Column, k: int) -> Column:
    """The hash of the k words from the 0-based place i, all of which must be there."""
    return F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)])


def _segments(words: str, length: int, shingle: int) -> Column:
    """Structs (n_words, first, near, hashes): the place of a segment's first word, its words and those around it, the hashes from its first word on. One with first 0 stands for the document."""

    def cut(d: Column) -> Column:
        w, h = d["w"], d["h"]
        n = F.size(w)
        of = lambda i: F.struct(n.alias("n_words"), i.alias("first"), F.slice(w, F.greatest(i - length + 1, F.lit(1)), SEGMENT + 2 * (length - 1)).alias("near"), F.slice(h, i, SEGMENT + shingle - 1).alias("hashes"))
        own = F.struct(n.alias("n_words"), F.lit(0).alias("first"), F.slice(w, 1, 0).alias("near"), F.slice(h, 1, 0).alias("hashes"))
        return F.concat(F.array(own), F.transform(F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(SEGMENT))).otherwise(F.array().cast("array<int>")), of))

    # The transform of a single value names it, so that words are hashed once.
    return F.transform(F.array(F.struct(F.col(words).alias("w"), _hashes(F.col(words)).alias("h"))), cut)[0]


def _windows(items: DataFrame, item_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """windows (wid, words) and members (wid, item): each distinct window, and the items that have it."""
    rows = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), item_words(F.col(f"`{text_col}`")).alias("w"))
    cut = F.when(F.size("w") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1))), lambda i: F.slice(F.col("w"), i, length)))
    rows = _table(rows.select("item", F.explode(cut).alias("words")).distinct(), "item_windows")
    windows = _table(rows.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return windows, _table(rows.join(windows, "words").select("wid", "item"), "window_items")


def _grams(windows: DataFrame, shingle: int) -> DataFrame:
    """wid, k, place, h: the shingles of each window, of k = min(its words, shingle) words."""
    n = F.size("words")
    of = lambda k: F.transform(F.array(_hashes(F.col("words"))), lambda h: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.struct(F.lit(k).alias("k"), i.alias("place"), _shingle(h, i - 1, k).alias("h"))))[0]
    sized = F.when(n >= shingle, of(shingle))
    for k in range(1, shingle):
        sized = sized.when(n == k, of(k))
    return windows.select("wid", F.inline(sized))


def occurrences(docs: DataFrame, keys: DataFrame, sizes: list[int], length: int, shingle: int) -> DataFrame:
    """From docs (row, doc_id, w): row, doc_id, n_words, place, begin, near, h for each occurrence of a hash in ``keys`` (a written table), and a row with place 0 for each document."""
    keys = keys.unionAll(keys.sparkSession.createDataFrame([(OWN,)], "h bigint"))
    blocks = -(-keys.count() // BLOCK)
    at = docs.select("row", "doc_id", F.inline_outer(_segments("w", length, shingle)))
    steps = F.when(F.col("first") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SEGMENT * max(1, len(sizes)) - 1)))
    at = at.select("*", F.explode_outer(steps).alias("p"))
    i = F.pmod(F.col("p"), F.lit(SEGMENT))
    h = F.when(F.col("first") == 0, F.lit(OWN).cast("long"))
    for j, k in enumerate(sizes):
        h = h.when((F.col("p") < SEGMENT * (j + 1)) & (F.col("p") >= SEGMENT * j) & (F.col("first") + i + k - 1 <= F.col("n_words")), _shingle(F.col("hashes"), i, k))
    at = at.select("row", "doc_id", "n_words", "first", "near", (F.col("first") + i).alias("place"), h.alias("h"))
    out = None
    for b in range(blocks):
        own = keys if blocks == 1 else keys.where(F.pmod("h", F.lit(blocks)) == b)
        here = at.join(F.broadcast(own), "h", "left_semi")
        out = here if out is None else out.unionAll(here)
    begin, whole = F.greatest(F.col("place") - length + 1, F.lit(1)), F.greatest(F.col("first") - length + 1, F.lit(1))
    return out.select("row", "doc_id", "n_words", "place", begin.alias("begin"), F.slice("near", begin - whole + 1, F.col("place") - begin + length).alias("near"), "h")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", length: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted), contaminated."""
    windows, members = _windows(items, item_col, item_text, length)
    grams = _table(_grams(windows, shingle), "window_shingles")
    keys = _table(grams.select("h").distinct(), "shingle_keys")
    sizes = sorted(r["k"] for r in grams.select("k").distinct().collect())  # at most ``shingle`` of them
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), item_words(F.col(f"`{text_col}`")).alias("w"))
    seen = _table(occurrences(rows, keys, sizes, length, shingle), "shingle_occurrences")
    places = seen.where("place > 0")

    count = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(count, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place")).alias("p")).where(F.col("p.n") > 0)
    prefix = rarest.join(windows, "wid").select("wid", F.col("p.h").alias("h"), F.col("p.place").alias("offset"), "words", F.size("words").alias("length"))
    prefix = _table(prefix, "prefixes")
    start = F.col("place") - F.col("offset") + 1
    pairs = places.join(F.broadcast(prefix) if prefix.count() <= BROADCAST_WINDOWS else prefix, "h").where((start >= 1) & (start + F.col("length") - 1 <= F.col("n_words")))
    hits = _table(pairs.where(F.slice("near", start - F.col("begin") + 1, F.col("length")) == F.col("words")).select("row", start.alias("start"), "length", "wid"), "window_hits")

    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.groupBy("row", "start").agg(F.max("length").alias("length")).withColumn("before", before)
    words = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce("before", F.lit(0))))).alias("n_hit"))
    owners = hits.select("row", "wid").distinct().join(F.broadcast(members) if members.count() <= BROADCAST_WINDOWS else members, "wid").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = _table(words.join(owners, "row"), "hit_documents")
    out = seen.where("place = 0").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words")).join(F.broadcast(both) if both.count() <= BROADCAST_WINDOWS else both, "row", "left")
    removed(keys, prefix, hits)
    listed, n = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.0) -> DataFrame:
    """Rows of docs, with all their columns, of whose words at most the share ``most`` are hit."""
    own, mark = (free(c, docs.columns) for c in ("hit_id", "hit_mark"))
    rows = docs.withColumns({mark: F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)), own: F.col(f"`{id_col}`")})
    bad = contaminated(docs.withColumn(mark, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))), items, mark, text_col).where(F.col("n_hit") > most * F.col("n_words"))
    bad = written(bad.select(F.col("doc_id").alias(mark)).distinct(), "contaminated")
    return rows.join(F.broadcast(bad) if bad.count() <= BROADCAST_WINDOWS else bad, mark, "left_anti").drop(own, mark)


def op13(spark, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM i),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) s WHERE len(w) >= n),
g AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM p),
h AS (SELECT g.* FROM g SEMI JOIN v ON g.win = v.win AND g.n = v.n),
c AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS spot FROM h) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h JOIN v ON h.win = v.win AND h.n = v.n) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN o ON d.r = o.r
"""
