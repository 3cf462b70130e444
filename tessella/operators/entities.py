"""Entities and keywords from text, URLs and titles."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, bound, contains_any, title_case

W = r"[\p{L}\p{N}_]+"
#: Patterns (applied to lower-cased text) and lists of the extraction rules.
LAB_PATTERNS = (rf"(?:the\s+)?({W}(?:\s+{W}){{0,3}})\s+lab(?:oratory)?", rf"lab(?:oratory)?\s+(?:of|for|on)\s+({W}(?:\s+{W}){{0,3}})", rf"({W})\s+research\s+(?:group|lab|laboratory)")
TOPIC_PATTERNS = (rf"research\s+(?:in|on|area|focus)[\s:]+({W}(?:\s+{W}){{0,4}})", rf"(?:studies?|work(?:ing)?\s+on)\s+({W}(?:\s+{W}){{0,3}})")
TOPICS = (
    "machine learning", "artificial intelligence", "deep learning", "computer vision", "natural language processing", "cloud computing", "data science", "quantum computing",
    "bioinformatics", "neuroscience", "robotics", "cybersecurity", "blockchain", "iot", "edge computing",
)
ORG_PATTERNS = (rf"department\s+of\s+({W}(?:\s+{W}){{0,4}})", rf"centre\s+for\s+({W}(?:\s+{W}){{0,4}})", rf"school\s+of\s+({W}(?:\s+{W}){{0,4}})")
INSTITUTE_PATTERN = rf"institute\s+(?:of|for)\s+({W}(?:\s+{W}){{0,4}})"
NOT_LABS = ("the", "this", "that", "their")
NOT_NAMES = ("faculty", "people", "staff", "www", "http", "html", "php")
NOT_DEPARTMENTS = ("www", "http", "https", "faculty", "people", "staff", "research", "about", "contact", "news", "events", "index", "home")
RESEARCH_TOPICS = (
    "machine learning", "deep learning", "artificial intelligence", "computer vision", "natural language processing", "nlp", "data science", "algorithms", "optimization", "theory",
    "networks", "security", "cryptography", "databases", "software engineering", "systems", "architecture", "computational biology", "bioinformatics", "genomics",
)
LAB_NAMES = (rf"(?i)\b{W}\s+Lab(?:oratory)?\b", rf"(?i)\b{W}\s+Research\s+Group\b", rf"(?i)\b{W}\s+Research\s+Lab\b", rf"(?i)\bLab\s+for\s+{W}\b")
COURSE_CODES = (r"\b[A-Z]{2,4}[\s-]?\d{3,4}\b", r"\b[A-Z]\d-\d{3}\b")
KEYWORDS = {
    "research_areas": ("machine learning", "deep learning", "computer vision", "nlp", "artificial intelligence", "data science", "algorithms", "theory", "systems", "networks", "security", "databases", "software engineering"),
    "methods": ("supervised learning", "unsupervised learning", "reinforcement learning", "neural network", "classification", "regression", "clustering", "optimization", "simulation", "modeling", "analysis"),
    "technologies": ("python", "tensorflow", "pytorch", "java", "c++", "gpu", "cloud", "distributed", "parallel", "cuda"),
}
AGGREGATED_TYPES = {"PERSON": ("person", "faculty"), "ORG": ("lab", "organization", "org")}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _all_where(text: Column, pattern: str, *needles: str) -> Column:
    """As _all, but only texts that hold a literal without which the pattern can't match are searched."""
    return F.when(contains_any(text, needles), _all(text, pattern)).otherwise(F.array().cast("array<string>"))


def _titled(found: Column, longer_than: int = 3, without=()) -> Column:
    kept = F.filter(F.transform(found, F.trim), lambda x: (F.length(x) > longer_than) & ~x.isin(*(without or ("",))))
    return F.array_sort(F.array_distinct(F.transform(kept, title_case)))


@dataclass(frozen=True)
class Rules:
    """Patterns of entity types and the topics to look for, in place of the built-in ones; types without patterns keep those.

    Patterns have one group, the name, and are applied to lower-cased text; \\w, \\s and \\b follow Unicode.
    """

    lab: tuple[str, ...] | None = None
    research_topic: tuple[str, ...] | None = None
    organization: tuple[str, ...] | None = None
    topics: tuple[str, ...] = TOPICS

    @classmethod
    def of(cls, settings) -> Rules:
        """From settings with ``extraction_patterns.TYPE`` lists and an optional list ``topics``; types are read in any spelling of case and underscores."""
        plain = lambda t: t.lower().replace("_", "")
        given = {plain(t): tuple(p) for t, p in (settings.get("extraction_patterns") or {}).items()}
        for patterns in given.values():
            for p in patterns:
                if re.compile(p).groups != 1:
                    raise ValueError(f"a pattern needs one group: {p}")
        return cls(given.get("lab"), given.get("researchtopic"), given.get("organization"), tuple(settings.get("topics") or TOPICS))


def _own(text: Column, patterns: tuple[str, ...]) -> list[Column]:
    return [_all(text, f"(?U){p}") for p in patterns]


def labs(text: Column, rules: Rules | None = None) -> Column:
    if rules and rules.lab is not None:
        return _titled(F.concat(F.array().cast("array<string>"), *_own(F.lower(text), rules.lab)), without=NOT_LABS)
    return _titled(bound(F.lower(text), lambda low: F.concat(*[_all_where(low, p, "lab" if "group" not in p else "research") for p in LAB_PATTERNS])), without=NOT_LABS)


def topics(text: Column, gazetteer=TOPICS, rules: Rules | None = None) -> Column:
    gazetteer = rules.topics if rules else gazetteer

    def listed(low: Column) -> Column:
        pattern = "(" + "|".join(t.replace(" ", r"\s+") for t in gazetteer) + ")"
        if gazetteer is TOPICS:
            return _all_where(low, pattern, *dict.fromkeys(t.split(" ")[0] for t in TOPICS))
        return _all(low, pattern) if gazetteer else F.array().cast("array<string>")

    if rules and rules.research_topic is not None:
        return _titled(bound(F.lower(text), lambda low: F.concat(*_own(low, rules.research_topic), listed(low))))
    return _titled(bound(F.lower(text), lambda low: F.concat(*[_all_where(low, p, *needles) for p, needles in zip(TOPIC_PATTERNS, (("research",), ("stud", "work")), strict=True)], listed(low))))


def organizations(text: Column, institutes: bool = False, rules: Rules | None = None) -> Column:
    if rules and rules.organization is not None:
        return _titled(F.concat(F.array().cast("array<string>"), *_own(F.lower(text), rules.organization)))
    return _titled(bound(F.lower(text), lambda low: F.concat(*[_all_where(low, p, p.split("\\")[0]) for p in ORG_PATTERNS + ((INSTITUTE_PATTERN,) if institutes else ())])))


def url_persons(url: Column, without=NOT_NAMES) -> Column:
    """Names in the path of faculty, people and staff pages: up to three words."""
    parts = F.filter(F.split(url, "/"), lambda p: (F.length(p) > 2) & ~F.startswith(p, F.lit("http")))
    names = F.transform(parts, lambda p: F.trim(F.translate(p, "-_", "  ")))
    ok = F.filter(names, lambda n: (n != "") & ~contains_any(F.lower(n), without) & (F.size(F.split(n, r"\s+")) <= 3))
    here = contains_any(url, ("/faculty/", "/people/", "/staff/"))
    return F.when(here, F.array_sort(F.array_distinct(F.transform(ok, title_case)))).otherwise(F.array().cast("array<string>"))


def title_labs(title: Column) -> Column:
    name = F.regexp_extract(title, rf"(?i)({W}(?:\s+{W}){{0,3}})\s+lab", 1)
    return F.when(name != "", F.array(title_case(F.trim(name)))).otherwise(F.array().cast("array<string>"))


def title_persons(title: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(title, r"(?:Prof(?:essor)?|Dr)\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)")))


def url_departments(url: Column, title: Column) -> Column:
    """Upper-case codes from path segments, the subdomain and a department named in the title (as an acronym if long)."""
    low = F.lower(url)
    path = F.filter(_all(low, "/([a-z]{2,10})(?=/)"), lambda x: ~x.isin(*NOT_DEPARTMENTS))
    sub = F.regexp_extract(low, r"https?://([a-z]+)\.", 1)
    name = F.trim(F.regexp_extract(F.lower(title), r"department\s+of\s+([a-z\s]+)", 1))
    short = F.when(F.length(name) > 15, F.array_join(F.transform(F.split(name, r"\s+"), lambda w: F.substring(w, 1, 1)), "")).otherwise(name)
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(path, F.array(F.when(sub.isin("www", "web", "portal"), "").otherwise(sub), short)), lambda x: x != ""), F.upper)))


def page_entities(text: Column, url: Column, title: Column, longer_than: int = 2, rules: Rules | None = None) -> Column:
    """Struct of persons, labs, topics and organizations of a page, each sorted."""
    clean = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: F.length(x) > longer_than)))
    return F.struct(clean(F.concat(url_persons(url), title_persons(title))).alias("persons"), clean(F.concat(labs(text, rules), title_labs(title))).alias("labs"), clean(topics(text, rules=rules)).alias("topics"), clean(organizations(text, rules=rules)).alias("organizations"))


def mentions(pages: DataFrame, page_id: str = "page_id", entities: str = "entities") -> DataFrame:
    """page_id, entity_name, entity_type, count: a row for each distinct entity of a page."""
    kinds = (("persons", "Person"), ("labs", "Lab"), ("topics", "ResearchTopic"), ("organizations", "Organization"))
    # A generator of the struct itself keeps the entities from being worked out once for each kind.
    rows = pages.select(page_id, F.explode(F.array(entities)).alias("x"))
    typed = lambda k, t: F.transform(F.col(f"x.{k}"), lambda n: F.struct(n.alias("n"), F.lit(t).alias("t")))
    every = F.concat(*[typed(k, t) for k, t in kinds])
    return rows.select(page_id, F.explode(every).alias("e")).select(page_id, F.col("e.n").alias("entity_name"), F.col("e.t").alias("entity_type"), F.lit(1).cast("long").alias("count"))


def term_mentions(docs: DataFrame, gazetteer: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Mentions of a gazetteer's terms (term: type) as whole words: doc_id, entity_name, entity_type, count of occurrences."""
    types = F.create_map(*[F.lit(x) for kv in gazetteer.items() for x in kv])
    found = docs.select(doc_id, F.explode(_all(F.lower(text), W, 0)).alias("entity_name")).where(F.col("entity_name").isin(*gazetteer))
    return found.groupBy(doc_id, "entity_name").agg(F.count(F.lit(1)).alias("count")).select(doc_id, "entity_name", types[F.col("entity_name")].alias("entity_type"), "count")


def nlp_spans(text: Column) -> Column:
    """Structs (text, label, start, end) by patterns: topics, labs, course codes; the first of equal texts (in any case) counts."""
    low = F.lower(text)
    span = lambda x, label: F.struct(x.alias("text"), F.lit(label).alias("label"), (F.instr(low, F.lower(x)) - 1).alias("start"), (F.instr(low, F.lower(x)) - 1 + F.length(x)).alias("end"))
    parts = [F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), span(F.lit(t), "RESEARCH_TOPIC")) for t in RESEARCH_TOPICS]), lambda s: s.isNotNull())]
    parts += [F.transform(_all(text, p, 0), lambda x: span(x, "LAB_NAME")) for p in LAB_NAMES]
    parts += [F.transform(_all(text, p, 0), lambda x: span(x, "COURSE_CODE")) for p in COURSE_CODES]
    every = F.concat(*parts)
    return F.filter(F.transform(every, lambda s, i: F.when(~F.exists(F.slice(every, 1, i), lambda o: F.lower(o["text"]) == F.lower(s["text"])), s)), lambda s: s.isNotNull())


def entity_summary(spans: Column) -> Column:
    labels = F.transform(spans, lambda s: s["label"])
    kinds = F.array_sort(F.array_distinct(labels))
    return F.struct(F.size(spans).alias("total"), kinds.alias("types"), F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter(labels, lambda x: x == k))))).alias("by_type"))


def categorized(text: Column) -> Column:
    """Struct of the fixed research areas, methods and technologies that occur."""
    low = F.lower(text)
    return F.struct(*[F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)).alias(name) for name, terms in KEYWORDS.items()])


def tfidf_keywords(docs: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", limit: int | None = None, digits: int = 6) -> DataFrame:
    """The k one- and two-word terms of highest tf-idf in each text (its first ``limit`` characters, if given): doc_id, keyword, score, rank.

    A substitute for an embedding model's keywords, deterministic and native. Stop words and short words are left out.
    """
    read = F.coalesce(text, F.lit(""))
    tokens = F.filter(_all(F.lower(F.substring(read, 1, limit) if limit else read), W, 0), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    rows = docs.select(doc_id, tokens.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    terms = rows.select(doc_id, F.explode(F.concat("w", F.filter(pairs, lambda p: p.isNotNull()))).alias("keyword")).groupBy(doc_id, "keyword").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = terms.join(df, "keyword").withColumn("score", F.round(F.col("tf") * F.log((1 + n.select("n").scalar()) / (1 + F.col("df"))), digits))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(doc_id).orderBy(F.desc("score"), "keyword"))).where(F.col("rank") <= k).select(doc_id, "keyword", "score", "rank")


def keyword_summary(keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """Count, mean, least, largest score, first keyword and the top five of each text."""
    return keywords.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.min_by("keyword", "rank").alias("top_keyword"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"]), 1, 5).alias("top_keywords"))


def udf_model(function, returns: str):
    """A pluggable model (recogniser, keyword or cross scorer) on Arrow batches: a function of pandas Series."""
    return F.pandas_udf(function, returns)
