"""Query understanding: acronyms, references to earlier turns, intents, departments, strategy, expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import EXAMPLE, Profile
from ..functions.text import SHORT_STOP_WORDS, contains_any, keywords, words

#: Substrings that make a question refer to what was said before.
REFERENCES = (
    "his ", "her ", "their ", "this ", "that ", "these ", "those ", "the same ", "it ", "they ", "he ", "she ",
    "tell me more", "more about", "what about", "more info", "continue", "go on", "elaborate", "explain more",
)
#: Patterns of each intent, applied without regard to case.
INTENTS = {
    "list_all": (r"\b(list|show|display|give|tell)\s+(all|me\s+all)\b", r"\ball\s+(faculty|professors|researchers|staff|people|members|labs|departments)\b", r"\bwho\s+are\s+(all|the)\b"),
    "faculty_query": (r"\b(faculty|professor|researcher|staff|instructor|teacher|PI|principal investigator)\b", r"\bwho\s+is\b", r"\bpeople\s+in\b"),
    "lab_query": (r"\b(lab|laboratory|research\s+group|center|centre|team)\b",),
    "department_query": (r"\b(department|division|school|institute|dept)\b",),
    "person_query": (r"\bwho\s+is\s+[A-Z][a-z]+\b", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    "about_query": (r"\b(tell|about|describe|what|explain|info|information)\b",),
}
#: The type of a query by its first intent; words of list and faculty questions; words for people and labs.
QUERY_TYPES = (("list_all", "list_aggregation"), ("person_query", "person_lookup"), ("faculty_query", "faculty_search"), ("lab_query", "lab_search"), ("department_query", "department_search"), ("about_query", "information_retrieval"))
LIST_WORDS = ("list", "all", "show all", "who are", "faculty members", "researchers")
FACULTY_WORDS = ("faculty", "professor", "researcher", "staff", "who is", "people")
PEOPLE, LABS = ("faculty", "professor", "researcher", "staff"), ("lab", "laboratory", "group")


def expand_acronyms(query: Column, profile: Profile = EXAMPLE) -> Column:
    """Replaces acronyms that stand between spaces, one after the other in the profile's order; lower case throughout."""
    padded = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    return F.trim(reduce(lambda t, kv: F.replace(t, F.lit(f" {kv[0]} "), F.lit(f" {kv[1]} ")), profile.acronyms, padded))


def refers_back(query: Column) -> Column:
    return contains_any(F.lower(query), REFERENCES)


def resolved(query: Column, history_size: Column, last_question: Column) -> Column:
    """The question with the one before it, if it refers back and at least two messages came before."""
    with_it = F.concat(F.lit("Previous question was: '"), last_question, F.lit("'. Now answering: "), query)
    return F.when(refers_back(query) & (history_size >= 2) & (last_question != ""), with_it).otherwise(query)


def resolve_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each user turn of conversations: conv, order, resolved question, from the turns before it."""
    before = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select(conv, order, role, F.col(text).alias("query"), F.count(F.lit(1)).over(before).alias("n"), F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(before).alias("asked"))
    return rows.where(F.col(role) == "user").select(conv, order, resolved(F.col("query"), F.col("n"), F.coalesce("asked", F.lit(""))).alias("query"))


def intents(query: Column) -> Column:
    q = F.lower(query)
    found = [F.when(reduce(lambda a, b: a | b, [q.rlike("(?iU)" + p) for p in patterns]), F.lit(name)) for name, patterns in INTENTS.items()]
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def query_type(found: Column) -> Column:
    out = None
    for intent, kind in QUERY_TYPES:
        out = (F.when if out is None else out.when)(F.array_contains(found, intent), kind)
    return out.otherwise("general_search")


def query_entities(query: Column) -> Column:
    """Struct of proper nouns (capitalised, not first), acronyms (2 to 5 upper-case characters) and keywords."""
    w = words(query)
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    first = lambda x: F.substring(x, 1, 1)
    return F.struct(
        F.filter(w, lambda x, i: (i > 0) & upper(first(x)) & (F.length(x) > 1)).alias("proper_nouns"),
        F.filter(w, lambda x: upper(x) & F.length(x).between(2, 5)).alias("acronyms"),
        F.transform(F.filter(w, lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*SHORT_STOP_WORDS)), lambda x: F.lower(x)).alias("keywords"),
    )


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def search_strategy(kind: Column, keyword_list: Column) -> Column:
    """Struct: weights of vector and graph search, aggregation, preferred URL patterns and page types."""
    people, labs = F.arrays_overlap(keyword_list, _strings(*PEOPLE)), F.arrays_overlap(keyword_list, _strings(*LABS))
    listing = kind == "list_aggregation"
    patterns = (
        F.when(listing & people, _strings("/faculty/", "/people/", "/staff/", "/members/")).when(listing & labs, _strings("/lab/", "/research/", "/group/"))
        .when(kind.isin("person_lookup", "faculty_search"), _strings("/faculty/", "/people/", "/profile/", "/~")).when(kind == "lab_search", _strings("/lab/", "/research/", "/group/", "/center/"))
        .when(kind == "department_search", _strings("/department/", "/about/", "/overview/")).otherwise(_strings())
    )
    types = (
        F.when(listing & people, _strings("faculty", "people")).when(listing & labs, _strings("lab", "research")).when(kind.isin("person_lookup", "faculty_search"), _strings("faculty", "profile"))
        .when(kind == "lab_search", _strings("lab", "research")).when(kind == "department_search", _strings("department", "overview")).otherwise(_strings())
    )
    return F.struct(
        F.when(kind.isin("person_lookup", "faculty_search"), 1.5).otherwise(1.0).alias("vector_weight"), F.when(listing, 2.0).otherwise(1.0).alias("graph_weight"),
        listing.alias("use_entity_aggregation"), patterns.alias("boost_url_patterns"), types.alias("preferred_page_types"),
    )


def expansion_terms(kind: Column, found: Column) -> Column:
    own = (
        F.when(kind.isin("faculty_search", "person_lookup"), _strings("faculty", "professor", "researcher", "staff", "member")).when(kind == "lab_search", _strings("laboratory", "research", "group", "center", "team"))
        .when(kind == "department_search", _strings("department", "division", "school", "institute")).otherwise(_strings())
    )
    every = F.when(F.array_contains(found, "list_all"), _strings("members", "people", "team", "staff")).otherwise(_strings())
    return F.array_sort(F.array_distinct(F.concat(own, every)))


def departments(query: Column, profile: Profile = EXAMPLE) -> Column:
    """Keys of departments of which a name (the key among them) stands in the query as words, in the profile's order."""
    found = []
    for key, names in profile.departments.items():
        pattern = r"(?U)\b(?:" + "|".join([key, *names]) + r")\b"
        found.append(F.when(F.lower(query).rlike(pattern), F.lit(key)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def is_list_query(query: Column) -> Column:
    return contains_any(F.lower(query), LIST_WORDS)


def is_faculty_query(query: Column) -> Column:
    return contains_any(F.lower(query), FACULTY_WORDS)


def semantic_expansion(query: Column, found: Column, profile: Profile = EXAMPLE) -> Column:
    """The query with its departments' first names and synonyms of what it asks for."""
    q, names = F.lower(query), F.create_map(*[F.lit(x) for k, v in profile.departments.items() for x in (k, v[0])])
    return F.concat(
        query, F.array_join(F.transform(found, lambda d: F.concat(F.lit(" "), names[d])), ""),
        F.when(contains_any(q, ("faculty", "professor")), " researcher scientist staff instructor teacher").otherwise(""),
        F.when(F.contains(q, F.lit("lab")), " laboratory research group").otherwise(""), F.when(F.contains(q, F.lit("research")), " study investigation project").otherwise(""),
    )


def target_page_types(faculty: Column, kind: Column) -> Column:
    parts = [
        F.when(faculty, _strings("faculty", "faculty-list", "department", "lab")).otherwise(_strings()),
        F.when(F.contains(kind, F.lit("lab")), _strings("lab", "research")).otherwise(_strings()),
        F.when(F.contains(kind, F.lit("department")), _strings("department", "faculty-list")).otherwise(_strings()),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def analyze(queries: DataFrame, query: str = "query", profile: Profile = EXAMPLE) -> DataFrame:
    """Adds what the retrieval strategies need to know of each query."""
    q = F.col(query)
    out = queries.withColumn("intents", intents(q)).withColumn("query_type", query_type(F.col("intents"))).withColumn("entities", query_entities(q))
    out = out.withColumn("search_strategy", search_strategy(F.col("query_type"), F.col("entities.keywords"))).withColumn("domain_hints", F.col("entities.acronyms"))
    out = out.withColumn("expansion_terms", expansion_terms(F.col("query_type"), F.col("intents"))).withColumn("departments", departments(q, profile))
    out = out.withColumns({"is_list_query": is_list_query(q), "is_faculty_query": is_faculty_query(q), "search_keywords": keywords(q)})
    return out.withColumn("target_page_types", target_page_types(F.col("is_faculty_query"), F.col("query_type"))).withColumn("expanded_query", semantic_expansion(q, F.col("departments"), profile))
