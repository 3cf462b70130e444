"""Further registered queries, each beside its SQL: routing, threads, contexts, prompts, edges, loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..functions.profile import EXAMPLE
from ..operators import adaptive, analyze, chat, context, entities, fuse, graph, pages, phrases, rerank, tfidf, vector
from ..sources import stores
from . import retrieval
from . import sql as S
from .queries import ORACLES, QUERIES, _mentions, _page_hits, _star, _t, _threads, _wide, query

__all__ = ["ORACLES", "QUERIES"]

NOW = "2024-05-05 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- Crawling

_EVENTS = """e AS (SELECT page_id, [200, 429, 500, 503, 404, 522][page_id % 6 + 1] AS s, (page_id // 6) % 4 AS n, ['http', 'timeout', 'dns', 'refused'][(page_id // 24) % 4 + 1] AS k, (page_id // 96) % 2 = 0 AS i FROM pages),
r AS (SELECT *, s IN (500, 502, 503, 504, 522, 524, 408, 429) AND n < 3 AS again, k = 'http' AND s = 429 AND n < 1 AS limited, k = 'http' AND s IN (500, 502, 503, 504) AND n < 2 AS server, k = 'timeout' AND i AND n < 2 AS late FROM e)"""


@query("error_routing", f"WITH {_EVENTS} SELECT page_id, again AS retry, CASE WHEN again THEN pow(2.0, n) END AS delay_s, CASE WHEN again THEN -1 END AS priority_change, limited OR server OR late AS routed, CASE WHEN limited THEN -100 WHEN server THEN 100 - 50 * n WHEN late THEN 150 - 50 * n END::INT AS priority FROM r")
def error_routing(spark, sf):
    rows = _t(spark, sf, "pages").selectExpr("page_id", "element_at(array(200, 429, 500, 503, 404, 522), cast(page_id % 6 + 1 AS int)) AS s", "cast((page_id div 6) % 4 AS int) AS n", "element_at(array('http', 'timeout', 'dns', 'refused'), cast((page_id div 24) % 4 + 1 AS int)) AS k", "(page_id div 96) % 2 = 0 AS i")
    s, n = F.col("s"), F.col("n")
    rows = rows.withColumns({"a": urls.retry_decision(s, n), "b": urls.error_route(F.col("k"), s, n, F.col("i"))})
    return rows.select("page_id", "a.*", F.col("b.retry").alias("routed"), F.col("b.priority").alias("priority"))


_FOLLOWED = ("example.com", "example.net")


@query("follow_allowed", f"""SELECT page_id, {S.part("url", "scheme")} IN ('http', 'https') AND NOT regexp_matches(lower({S.part("url", "path")}), '\\.({"|".join((*urls.SKIPPED_EXTENSIONS, "avi", "mov"))})$') AND {S.any_in(S.part("url", "host"), _FOLLOWED)} AS follow,
  {S.any_in(S.part("url", "host"), ("example.org",))} AS override FROM pages""")
def follow_allowed(spark, sf):
    u = F.col("url")
    return _t(spark, sf, "pages").select("page_id", urls.should_follow(u, F.lit(""), allowed_hosts=_FOLLOWED).alias("follow"), urls.robots_override(urls.part(u, "host"), ("example.org",)).alias("override"))


@query("relevance_gate", f"SELECT page_id, page_id % 4 < 3 AND CASE WHEN {S._PRESENT} > 0 THEN least(1.0, {S._REL} / (2 * {S._PRESENT})) ELSE 0.0 END >= 0.3 AS follow FROM pages")
def relevance_gate(spark, sf):
    return _wide(spark, sf, "pages").select("page_id", phrases.gate(F.col("page_id") % 4, F.lit(3), pages.relevance(F.col("html"))).alias("follow"))


# --- Filters and caps


@query("metadata_scan", "SELECT vec_id FROM embeddings WHERE label IN (1, 2) ORDER BY vec_id LIMIT 50")
def metadata_scan(spark, sf):
    return vector.scan_by_metadata(_t(spark, sf, "embeddings"), {"label": {"$in": [1, 2]}}, 50, "vec_id").select("vec_id")


@query("source_cap", f"WITH {S._PH} SELECT query_id, page_id, rank::INT AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 3")
def source_cap(spark, sf):
    return fuse.cap_per_source(_page_hits(spark, sf), 3).select("query_id", "page_id", F.col("rank").cast("int").alias("rank"))


_PRE = "v AS (SELECT query_id, page_id % 3 AS variation, min(source) AS source, page_id, max(score) AS score FROM h GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, variation ORDER BY score DESC, page_id) AS r FROM v WHERE score > 0.3 QUALIFY r <= 25)"


@query("fused_variations", f"""WITH {S._PH}, {_PRE}, f AS (SELECT query_id, 'p' || page_id AS doc_key, sum(1 / (60 + r)) AS s, count(*) AS hits FROM p GROUP BY ALL)
SELECT query_id, doc_key, round(s, 9) AS score, hits, (row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_key))::INT AS fused_rank FROM f QUALIFY fused_rank <= 10""".replace("ORDER BY score DESC, page_id", "ORDER BY score DESC, 'p' || page_id"))
def fused_variations(spark, sf):
    hits = _page_hits(spark, sf).select("query_id", (F.col("page_id") % 3).alias("variation"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source"), "score")
    out = adaptive.fused_variations(hits, 10)
    return out.select("query_id", "doc_key", F.round("score", 9).alias("score"), "hits", F.col("fused_rank").cast("int").alias("fused_rank"))


@query("cross_scores", f"WITH {S._PH}, t AS (SELECT page_id, {S._TOK('query')} AS a, {S._TOK('title')} AS b FROM h) SELECT page_id, round(len(list_intersect(a, b)) / len(a), 6)::DOUBLE AS score FROM t")
def cross_scores(spark, sf):
    return _page_hits(spark, sf).select("page_id", F.round(rerank.token_overlap(F.col("query"), F.col("title")), 6).alias("score"))


# --- Entities and graph


@query("graph_stats", f"WITH {S._M} SELECT 'pages' AS item, count(*) AS count FROM documents UNION ALL SELECT 'entities', count(*) FROM (SELECT DISTINCT entity_name, entity_type FROM m) UNION ALL SELECT 'mentions', count(*) FROM m UNION ALL SELECT 'chunks', count(*) FROM embeddings")
def graph_stats(spark, sf):
    m = _mentions(spark, sf)
    return graph.stats(_t(spark, sf, "documents"), m.select("entity_name", "entity_type").distinct(), m, _t(spark, sf, "embeddings"))


@query("edge_creation", """WITH s AS (SELECT a.s_suppkey, n_name FROM supplier a JOIN nation ON n_nationkey = s_nationkey)
SELECT DISTINCT 'Faculty' AS src_label, b.s_suppkey::VARCHAR AS src_key, 'WORKS_IN' AS rel, 'Lab' AS dst_label, n.n_nationkey::VARCHAR AS dst_key, 1::BIGINT AS count FROM s JOIN supplier a USING (s_suppkey) JOIN supplier b ON a.s_name = b.s_name JOIN nation n ON n.n_name = s.n_name""")
def edge_creation(spark, sf):
    nodes, _ = _star(spark, sf)
    named = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    wanted = named.select(F.lit("Faculty").alias("src_label"), F.col("s_name").alias("src_name"), F.lit("WORKS_IN").alias("rel"), F.lit("Lab").alias("dst_label"), F.col("n_name").alias("dst_name"))
    return graph.create_edges(nodes, wanted)


@query("property_merge", "SELECT n_nationkey AS key, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS b, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS c FROM nation")
def property_merge(spark, sf):
    n = _t(spark, sf, "nation")
    old = n.select(F.col("n_nationkey").alias("key"), F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("old")).alias("props"))
    new = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.col("n_name")).alias("props"))
    return graph.merge_properties(old, new, ["key"]).select("key", *[F.try_element_at("props", F.lit(k)).alias(k) for k in "abc"])


@query("entity_edges", """SELECT DISTINCT 'Faculty' AS src_label, source AS src_key, doc_id::VARCHAR AS dst_key FROM documents UNION ALL SELECT DISTINCT 'Lab', lang, doc_id::VARCHAR FROM documents WHERE doc_id % 2 = 0""")
def entity_edges(spark, sf):
    names = F.create_map(F.lit("PERSON"), F.array("source"), F.lit("LAB_NAME"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")))
    return graph.page_entity_edges(_t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("page_id"), names.alias("entities"))).select("src_label", "src_key", "dst_key")


@query("url_departments", f"""WITH {S._PH}, p AS (SELECT page_id, lower(source) AS u, CASE WHEN page_id % 2 = 0 THEN 'department of applied sciences' ELSE 'department of physics' END AS t FROM h),
q AS (SELECT page_id, string_split(u, '/') AS s, regexp_extract(u, 'https?://([a-z]+)\\.', 1) AS sub, CASE WHEN page_id % 2 = 0 THEN 'as' ELSE 'physics' END AS short FROM p)
SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_concat(list_filter(s[2:len(s) - 1], lambda x: regexp_full_match(x, '[a-z]{{2,10}}') AND x NOT IN ({S.lst(entities.NOT_DEPARTMENTS)[1:-1]})), [CASE WHEN sub IN ('www', 'web', 'portal') THEN '' ELSE sub END, short]), lambda x: x <> ''), lambda x: upper(x)))), ',') AS departments FROM q""")
def url_departments(spark, sf):
    title = F.when(F.col("page_id") % 2 == 0, "Department of Applied Sciences").otherwise("Department of Physics")
    return _page_hits(spark, sf).select("page_id", F.array_join(entities.url_departments(F.col("source"), title), ",").alias("departments"))


@query("noun_phrases", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\p{Lu}[\p{L}\p{N}]*(?: +\p{Lu}[\p{L}\p{N}]*)+', 0), lambda x: regexp_replace(x, ' +', ' ', 'g')))), '|') AS phrases FROM documents")
def noun_phrases(spark, sf):
    return _wide(spark, sf, "documents").select("doc_id", F.array_join(phrases.noun_phrases(F.col("text")), "|").alias("phrases"))


@query("confident_spans", "SELECT doc_id, CASE WHEN (doc_id % 10) / 10.0 > 0.7 THEN source ELSE '' END AS spans FROM documents")
def confident_spans(spark, sf):
    spans = F.array(F.struct(F.col("source").alias("text"), ((F.col("doc_id") % 10) / 10.0).alias("score")))
    return _t(spark, sf, "documents").select("doc_id", F.array_join(F.transform(phrases.confident(spans), lambda s: s["text"]), ",").alias("spans"))


@query("keyword_summary", f"WITH k AS ({S.TFIDF}) SELECT doc_id, count(*) AS n, round(avg(score), 8) AS avg_score, min(score) AS min_score, max(score) AS max_score, arg_min(keyword, rank) AS top_keyword, string_agg(keyword, ',' ORDER BY rank) AS top_keywords FROM k GROUP BY 1")
def keyword_summary(spark, sf):
    out = entities.keyword_summary(tfidf.keywords(_wide(spark, sf, "documents").select("doc_id", "text"), 5))
    return out.select("doc_id", F.col("count").alias("n"), F.round("avg_score", 8).alias("avg_score"), "min_score", "max_score", "top_keyword", F.array_join("top_keywords", ",").alias("top_keywords"))


# --- Threads and times


@query("thread_titles", f"WITH {S._TH0} SELECT thread_id, title FROM t WHERE contains(lower(title), 'ion')")
def thread_titles(spark, sf):
    return chat.filter_titles(_threads(spark, sf)[0], "ION").select("thread_id", "title")


@query("thread_insert", f"""WITH a AS (SELECT 'u' || conv_id % 3 AS user_id, conv_id || ' ' || text AS q FROM conversations WHERE turn = 0 AND role = 'user')
SELECT substr(sha256(user_id || chr(1) || q || chr(1) || '{NOW}'), 1, 32) AS thread_id, user_id, {S._TITLE} AS title, 1::BIGINT AS message_count, '2024-05-05 13:00:00' AS updated_at, 'active' AS status FROM a""")
def thread_insert(spark, sf):
    first = _t(spark, sf, "conversations").where("turn = 0 AND role = 'user'").select(F.concat(F.lit("u"), (F.col("conv_id") % 3).cast("string")).alias("user_id"), F.concat(F.col("conv_id").cast("string"), F.lit(" "), F.col("text")).alias("question"))
    threads = chat.new_threads(first, _now())
    new = threads.select(F.concat(F.lit("m-"), "thread_id").alias("message_id"), "thread_id", F.lit("user").alias("role"), F.col("title").alias("content"), F.lit(0).alias("context_used"), (_now() + F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    out, _ = chat.add_messages(threads, new.limit(0), new)
    return out.select("thread_id", "user_id", "title", "message_count", _stamp("updated_at").alias("updated_at"), "status")


@query("thread_purge", "SELECT conv_id AS thread_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 0 AND conv_id % 60 > 30 AND conv_id <> 35")
def thread_purge(spark, sf):
    """Archived threads that weren't touched for 30 days; number 35 is archived anew just now."""
    t = _threads(spark, sf)[0].withColumn("updated_at", _now() - F.make_dt_interval(days=(F.col("thread_id") % 60).cast("int")))
    return chat.purgeable(chat.archive(t, 35, _now()), _now(), 30)


@query("expired_sessions", "SELECT user_id, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 HOURS AS expired FROM events GROUP BY 1")
def expired_sessions(spark, sf):
    e = _t(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("t"))
    return last.select("user_id", chat.expired(F.col("t"), e.agg(F.max("ts").alias("t")).select("t").scalar()).alias("expired"))


@query("time_labels", f"""WITH a AS (SELECT conv_id, conv_id * 7919 % 900000 AS s FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s // 86400 = 1 THEN 'Yesterday' WHEN s // 86400 < 7 THEN (s // 86400) || 'd ago' ELSE strftime(TIMESTAMP '{NOW}' - to_seconds(s), '%b %-d') END AS label FROM a""")
def time_labels(spark, sf):
    rows = _t(spark, sf, "conversations").select("conv_id").distinct()
    return rows.select("conv_id", chat.time_label(_now() - F.make_dt_interval(secs=F.col("conv_id") * 7919 % 900000), _now()).alias("label"))


@query("neighbour_chunks", "SELECT * FROM (SELECT conv_id AS page_id, turn AS chunk_id, lag(md5(text)) OVER w AS text_before, lead(md5(text)) OVER w AS text_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE chunk_id % 2 = 0")
def neighbour_chunks(spark, sf):
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("chunk_id"), F.md5("text").alias("text"))
    return context.neighbours(rows.where("chunk_id % 2 = 0").drop("text"), rows)


# --- Contexts, prompts, answers

_NL = "chr(10)"


@query("generation_contexts", f"""WITH {S._PH}, w AS (SELECT *, {S.words("text")} AS w FROM h), b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wb FROM w)
SELECT query_id, md5(string_agg('[Document ' || rank || ' - ' || page_type || '] ' || title || {_NL} || CASE WHEN wb + len(w) > 4000 THEN array_to_string(w[1 : 4000 - wb], ' ') ELSE text END || {_NL} || 'Source: ' || source, {_NL} || {_NL} ORDER BY rank)) AS md5 FROM b WHERE wb < 4000 GROUP BY 1""")
def generation_contexts(spark, sf):
    return context.generation_context(_page_hits(spark, sf)).select("query_id", F.md5("context").alias("md5"))


@query("enhanced_contexts", f"""WITH {S._PH} SELECT query_id, md5(string_agg(CASE WHEN lis THEN '[Source ' || rank || ' - ' || page_type || ']' || {_NL} || 'Title: ' || title || {_NL} || 'Content: ' || text || {_NL} || 'URL: ' || source || {_NL}
  ELSE '[Source ' || rank || '] ' || CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || '...' END || {_NL} END, {_NL} || '---' || {_NL} ORDER BY rank)) AS md5 FROM h WHERE rank <= CASE WHEN lis THEN 20 ELSE 10 END GROUP BY 1""")
def enhanced_contexts(spark, sf):
    return context.enhanced_context(_page_hits(spark, sf)).select("query_id", F.md5("context").alias("md5"))


@query("prompt_contexts", f"WITH {S._PH} SELECT query_id, md5(string_agg('[Source ' || rank || '] Title: ' || title || {_NL} || 'URL: ' || source || {_NL} || substr(text, 1, 500), {_NL} || {_NL} ORDER BY rank)) AS md5 FROM h GROUP BY 1")
def prompt_contexts(spark, sf):
    return context.prompt_context(_page_hits(spark, sf)).select("query_id", F.md5("context").alias("md5"))


@query("prompts", f"""WITH a AS (SELECT conv_id, {S._pick(S.QUESTIONS, 'conv_id % 7')} AS q, text FROM conversations WHERE turn = 0), b AS (SELECT *, {S.any_in('lower(q)', analyze.LIST_WORDS)} AS lis FROM a)
SELECT conv_id, CASE WHEN lis THEN {S.q(context.SYSTEM["list"])} ELSE {S.q(context.SYSTEM["specific"])} END AS system, md5(CASE WHEN text <> '' THEN 'Conversation so far:' || {_NL} || text || {_NL} || {_NL} ELSE '' END || 'Context:' || {_NL} || 'c' || {_NL} || {_NL} || 'Question: ' || q) AS user_md5,
  CASE WHEN lis THEN 4000 ELSE 1500 END AS max_tokens, md5(substr(text, 1, 1000)) AS answer FROM b""")
def prompts(spark, sf):
    q = F.element_at(F.array(*[F.lit(x) for x in S.QUESTIONS]), (F.col("conv_id") % 7 + 1).cast("int"))
    rows = _t(spark, sf, "conversations").where("turn = 0").select("conv_id", "text", context.prompt(q, analyze.is_list_query(q), F.col("text"), F.lit("c")).alias("p"))
    return rows.select("conv_id", "p.system", F.md5("p.user").alias("user_md5"), "p.max_tokens", F.md5(context.extractive_answer(F.col("text"))).alias("answer"))


@query("graph_lines", f"""SELECT n_nationkey AS key, 'Entity: ' || n_name || ' (Lab) - Mentioned in ' || n_nationkey || ' pages, ' || CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_nationkey % 5 END || ' total mentions'
  || {_NL} || 'Related pages: ' || n_name || ', b, c' || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE {_NL} || 'Sources: ' || n_name || ', y' END AS line FROM nation""")
def graph_lines(spark, sf):
    key, name = F.col("n_nationkey"), F.col("n_name")
    urls_ = F.when(key % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(name, F.lit("y"), F.lit("z")))
    return _t(spark, sf, "nation").select(key.alias("key"), context.graph_text(name, F.lit("Lab"), key, F.when(key % 5 != 0, key % 5), F.array(name, F.lit("b"), F.lit("c"), F.lit("d")), urls_).alias("line"))


@query("question_templates", "SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 3 = 0 THEN 'List all faculty members' ELSE 'List all faculty members in the ' || n_name || ' department' END AS listed, 'What research is being done on ' || n_name || '?' AS topic FROM nation")
def question_templates(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("dept"), "n_name")
    listed, _ = retrieval.templated(n, "faculty_list", "dept")
    topic, _ = retrieval.templated(n, "topic", "n_name")
    return listed.withColumnRenamed("query", "listed").join(topic.withColumnRenamed("query", "topic"), "query_id")


_FIRST = ", ".join(f"CASE WHEN regexp_matches(lower(query), {S.q(chr(92) + 'b(?:' + '|'.join([k, *v]) + ')' + chr(92) + 'b')}) THEN {S.q(' ' + v[0])} END" for k, v in EXAMPLE.departments.items())


@query("query_expansion", f"""WITH a AS (SELECT conv_id, {S._pick(("physics faculty", "who works in CSA or cds", "neuroscience labs", "research"), "conv_id % 4")} AS query FROM conversations WHERE turn = 0)
SELECT conv_id, query || array_to_string(list_filter([{_FIRST}], lambda x: x IS NOT NULL), '') || CASE WHEN {S.any_in("lower(query)", ("faculty", "professor"))} THEN ' researcher scientist staff instructor teacher' ELSE '' END
  || CASE WHEN contains(lower(query), 'lab') THEN ' laboratory research group' ELSE '' END || CASE WHEN contains(lower(query), 'research') THEN ' study investigation project' ELSE '' END AS expanded FROM a""")
def query_expansion(spark, sf):
    q = F.element_at(F.array(F.lit("physics faculty"), F.lit("who works in CSA or cds"), F.lit("neuroscience labs"), F.lit("research")), (F.col("conv_id") % 4 + 1).cast("int"))
    rows = _t(spark, sf, "conversations").where("turn = 0").select("conv_id", q.alias("query"))
    return rows.select("conv_id", analyze.semantic_expansion(F.col("query"), analyze.departments(F.col("query"))).alias("expanded"))


# --- Loads


def _processed(spark, sf):
    chunk = F.struct(F.lit(1).alias("chunk_id"), F.col("text"), F.lit(2).alias("word_count"), F.lit(0).alias("start_word"), F.lit(2).alias("end_word"), F.when(F.col("doc_id") % 4 != 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    return _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("url"), F.lit(None).cast("string").alias("domain"), F.col("lang").alias("page_type"), F.lit(None).cast("string").alias("title"), F.array(chunk).alias("chunks"))


@query("chunk_load", "SELECT doc_id || '_1' AS chunk_key, CASE WHEN doc_id % 7 <> 0 THEN source ELSE '' END AS url, '' AS domain, lang AS page_type, '' AS title FROM documents WHERE doc_id % 4 <> 0")
def chunk_load(spark, sf):
    return stores.chunk_rows(_processed(spark, sf)).select("chunk_key", "url", "domain", "page_type", "title")


@query("load_counts", "SELECT count(*) AS pages, count(*) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 4 <> 0) AS stored, count(*) FILTER (WHERE doc_id % 7 = 0 OR doc_id % 4 = 0) AS failed, count(*) FILTER (WHERE doc_id % 4 <> 0) AS chunks FROM documents")
def load_counts(spark, sf):
    return stores.load_counts(_processed(spark, sf))
