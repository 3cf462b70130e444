"""URL filter: rules, then a character language-model ratio; DataFrame operations only.

Two smoothed variable-order Markov models over the characters of host and path, one of
accepted URLs and one of rejected ones, share a table of character-gram counts.
The probability of a character mixes all orders from 0 to ORDER, each with the weight of
its context's count against MIX (an unseen context leaves the shorter one's estimate).
A URL is blocked when the log ratio (rejected over accepted), divided by its
length, exceeds a threshold. The counts come from all labelled URLs, in aggregations that combine on the
map side. They are kept for the grams themselves, so the table grows with the input. Each
different window of ORDER + 1 characters is looked up once; the smallest tables, up to
BROADCAST_GRAMS rows together, are broadcast, the others shuffled.

Labelled URLs can be passed as ``examples``. Without them labels are weak: a URL whose host has one of a few seed terms is a
rejected example, any other an accepted one, so some accepted examples may be bad ones that no term names. So that the verdict is the models' and
no echo of the list, hosts are dealt into FOLDS folds, all hosts with one term into the same, and every URL is judged by models that saw
no URL of its fold: neither its host nor, where it has one, its term. A host with a term that looks like no other rejected one is allowed, and one without any term that
looks like them is blocked. The threshold comes from the same unseen scores: above the share 1 - MAX_FALSE of the accepted ones, and half way to the low end of the
rejected ones when the two lie apart.

Null URLs and URLs without ``://`` have an empty host and path, no rule, and are allowed, as
are URLs without a rule when the other folds have no rejected or no accepted examples. Very long
URLs are read whole, in segments. Repeated URLs are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ORDER, MIX, MAX_FALSE, SEGMENT, FOLDS = 4, 2.0, 0.001, 128, 5
#: Rows of grams, and of windows with their log ratios, up to which tables are broadcast.
BROADCAST_GRAMS = 300_000
ALPHABET = 96.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEED_TERMS = ("casino", "adult", "porn", "xxx", "pills", "viagra", "spam", "bets", "betting", "poker", "lottery", "ads-", "-ads", "adserver", "track", "malware", "phish", "warez")
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def url_host(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict string, rule string>")


def _text(host: Column, path: Column) -> Column:
    """Padded in front, so that every character has a full context, and closed by an end mark."""
    return F.concat(F.lit("^" * ORDER), host, path, F.lit("$"))


def _segments(text: Column) -> Column:
    """Cut so that each character but the padding is the (ORDER + 1)th or a later one of exactly one segment."""
    n = F.length(text) - ORDER
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SEGMENT).cast("int")), lambda j: F.substring(text, j * SEGMENT + 1, F.lit(SEGMENT + ORDER)))


def _windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each character, with the window w of ORDER characters before it and itself."""
    cut = rows.select(*keys, F.explode(_segments(_text(F.col("host"), F.col("path")))).alias("s"))
    cut = cut.select(*keys, "s", F.explode(F.sequence(F.lit(ORDER + 1), F.length("s"))).alias("i"))
    return cut.select(*keys, F.substring("s", F.col("i") - ORDER, F.lit(ORDER + 1)).alias("w"))


SLOTS = 2 * (ORDER + 1)


def _gram(slot: int) -> Column:
    """Of a window: the last character with the k = slot // 2 before it (odd slots), or these k alone (even slots)."""
    k, n = divmod(slot, 2)
    return F.substring("w", ORDER + 1 - k, k + n)


def train(urls: DataFrame) -> DataFrame:
    """From host, path, rejected: slot, gram, a, r (counts among accepted and rejected URLs), a row for each gram that occurs.

    With a column fold, a and r are arrays: at place f the counts of the URLs that are not in fold f.
    """
    keys = ["fold"] if "fold" in urls.columns else []
    counts = _windows(urls, ["rejected", *keys]).groupBy("w", *keys).agg(F.sum(F.when(F.col("rejected"), 0.0).otherwise(1.0)).alias("a"), F.sum(F.when(F.col("rejected"), 1.0).otherwise(0.0)).alias("r"))
    grams = counts.select(F.explode(F.array(*[F.struct(F.lit(j).alias("slot"), _gram(j).alias("gram")) for j in range(SLOTS)])).alias("g"), "a", "r", *keys).select("g.*", "a", "r", *keys).groupBy("slot", "gram")
    if not keys:
        return grams.agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    others = lambda c: F.array(*[F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0.0)) for f in range(FOLDS)])
    return grams.agg(others("a").alias("a"), others("r").alias("r"))


def _ratios(windows: DataFrame, model: DataFrame) -> DataFrame:
    """For each different window (of a fold): ratio, the log-likelihood of its last character among rejected URLs less that among accepted ones."""
    size = {r["slot"]: r["count"] for r in model.groupBy("slot").count().collect()}
    keys = [c for c in ("w", "fold") if c in windows.columns]
    own = (lambda c: F.get(c, F.col("fold"))) if "fold" in keys else (lambda c: c)
    out, room = windows.select(*keys).distinct(), BROADCAST_GRAMS
    for j in sorted(range(SLOTS), key=lambda j: (size.get(j, 0), j)):
        room -= size.get(j, 0)
        grams = model.where(F.col("slot") == j).select(F.col("gram").alias(f"g{j}"), F.col("a").alias(f"a{j}"), F.col("r").alias(f"r{j}"))
        out = out.withColumn(f"g{j}", _gram(j)).join(F.broadcast(grams) if room >= 0 else grams.hint("shuffle_merge"), f"g{j}", "left").drop(f"g{j}")
        out = out.withColumns({f"a{j}": own(F.col(f"a{j}")), f"r{j}": own(F.col(f"r{j}"))})

    def prob(side: str) -> Column:
        p = F.lit(1 / ALPHABET)
        for k in range(ORDER + 1):
            seen, context = (F.coalesce(f"{side}{2 * k + n}", F.lit(0.0)) for n in (1, 0))
            p = (seen + F.lit(MIX) * p) / (context + F.lit(MIX))
        return p

    return out.select(*keys, (F.log(prob("r")) - F.log(prob("a"))).alias("ratio"))


def scored(rows: DataFrame, keys: list[str], model: DataFrame) -> DataFrame:
    """keys (host and path among them; fold, for a model with folds) and score: the length-normalised log-likelihood difference, rejected less accepted."""
    at = _windows(rows, keys)
    ratios = written(_ratios(at, model), "url_ratios")
    by = [c for c in ("w", "fold") if c in ratios.columns]
    at = at.join(F.broadcast(ratios) if ratios.count() <= BROADCAST_GRAMS else ratios.hint("shuffle_merge"), by)
    return at.groupBy(*keys).agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))


def seed_term(host: Column, terms=SEED_TERMS) -> Column:
    """The first of the terms that the host has, else null."""
    return F.coalesce(*[F.when(F.contains(host, F.lit(t)), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def fold_of(host: Column, terms=()) -> Column:
    """Hosts with the same term are in one fold."""
    return F.pmod(F.xxhash64(F.coalesce(seed_term(host, terms), host)), F.lit(FOLDS)).cast("int")


def threshold(held: DataFrame) -> Column:
    """Of scores with rejected: above all but MAX_FALSE of the accepted ones, half way to the low end of the rejected ones if that is higher; null without accepted ones."""
    cut = held.agg(F.percentile_approx(F.when(~F.col("rejected"), F.col("score")), 1 - MAX_FALSE, 10000).alias("a"), F.percentile_approx(F.when(F.col("rejected"), F.col("score")), 0.05, 10000).alias("r"))
    return written(cut.select(F.greatest(F.col("a"), F.coalesce((F.col("a") + F.col("r")) / 2, F.col("a"))).alias("threshold")), "url_threshold").select("threshold").scalar()


def judged(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules=RULES, seed_terms=SEED_TERMS, examples: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    url = F.col(f"`{url_col}`")
    terms = seed_terms if examples is None else ()
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path")).withColumns({"n": F.monotonically_increasing_id(), "fold": fold_of(F.col("host"), terms)})
    # The written rows fix the numbers that scores are kept under.
    rows = written(rows.withColumns({"hit": ruled(F.col("host"), F.col("path"), rules), "rejected": seed_term(F.col("host"), terms).isNotNull()}), "url_rows")
    keys = ["n", "host", "path", "fold"]
    if examples is None:
        taught = rows.where("host <> ''")
    else:
        taught = examples.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "rejected").withColumns({"n": F.monotonically_increasing_id(), "fold": fold_of(F.col("host"))})
        taught = written(taught, "url_examples")
    model = written(train(taught.select("host", "path", "rejected", "fold")), "url_model")
    scores = written(scored(rows.select(*keys), keys, model).select("n", "score"), "url_scores")
    own = scores if examples is None else scored(taught.select(*keys), keys, model).select("n", "score")
    cut = threshold(taught.select("n", "rejected").join(own, "n"))
    both = {r["fold"]: (r["a"], r["r"]) for r in taught.groupBy("fold").agg(F.count_if(~F.col("rejected")).alias("a"), F.count_if("rejected").alias("r")).collect()}  # a row for each fold
    known = [all(sum(both.get(g, (0, 0))[i] for g in range(FOLDS) if g != f) for i in (0, 1)) for f in range(FOLDS)]
    block = F.get(F.array(*[F.lit(k) for k in known]), F.col("fold")) & (F.col("host") != "") & (F.col("score") > F.col("threshold"))
    out = rows.join(scores, "n").withColumn("threshold", cut)
    free = F.col("hit").isNull()
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.when(free, F.when(block, "block").otherwise("allow")).otherwise(F.col("hit.verdict")).alias("verdict"), F.when(free, F.col("score")).alias("score"))


def op7(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")
