"""SQL of the registered queries, for comparison on another engine."""

from __future__ import annotations

from functools import reduce

from ..functions import html, urls
from ..functions.profile import EXAMPLE
from ..functions.text import STOP_WORDS
from ..operators import analyze, entities, pages

QUESTIONS = (
    "list all faculty members in physics", "who is Ada Byron", "Tell me about the lab research group", "describe CDS department courses",
    "what machine learning projects are there", "show all labs", "weather",
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def any_in(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in parts) + ")"


PARTS = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$'"


def part(u: str, which: str) -> str:
    return f"regexp_extract({u}, {PARTS}, {1 + ('scheme', 'host', 'path', 'query', 'fragment').index(which)})"


URL_PARTS = f"""
SELECT page_id, {part("url", "scheme")} AS scheme, {part("url", "host")} AS host, {part("url", "path")} AS path, {part("url", "query")} AS query_string, {part("url", "fragment")} AS fragment,
  len(list_filter(string_split({part("url", "path")}, '/'), lambda s: s <> ''))::INT AS segments FROM pages"""


def normal(u: str) -> str:
    params = f"list_filter(string_split({part(u, 'query')}, '&'), lambda p: p <> '')"
    keyed = f"list_transform({params}, lambda p, i: {{'k': string_split(p, '=')[1], 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}})"
    query = f"array_to_string(list_transform(list_sort({keyed}), lambda s: s.p), '&')"
    return f"""(CASE WHEN {part(u, "scheme")} IN ('http', 'https') THEN 'https:' WHEN {part(u, "scheme")} = '' THEN '' ELSE {part(u, "scheme")} || ':' END
  || CASE WHEN {part(u, "host")} = '' THEN '' ELSE '//' || lower({part(u, "host")}) END
  || CASE WHEN {part(u, "path")} = '/' THEN '/' ELSE regexp_replace({part(u, "path")}, '/+$', '') END
  || CASE WHEN {query} = '' OR {query} IS NULL THEN '' ELSE '?' || {query} END)"""


URL_NORMALIZE = f"SELECT page_id, {normal('url')} AS normal FROM pages"
PAGE_ID = f"SELECT page_id, replace({part('url', 'host')}, '.', '_') || '_' || substr(md5(url), 1, 12) AS key FROM pages"


def blocked(u: str) -> str:
    low, path, query = f"lower({u})", f"lower({part(u, 'path')})", f"lower({part(u, 'query')})"
    black = "|".join("(" + g.replace("*", ".*") + ")" for g in urls.BLACKLIST)
    return f"""CASE WHEN regexp_matches({path}, '\\.({"|".join(urls.BLOCKED_EXTENSIONS)})$') THEN 'extension'
  WHEN {any_in(low, urls.NOISE_WORDS)} AND len(list_filter(string_split({path}, '/'), lambda s: s <> '')) > 1 THEN 'noise'
  WHEN {any_in(query, urls.DATE_PARAMS)} AND {any_in(low, urls.DATE_WORDS)} THEN 'date'
  WHEN try_cast(regexp_extract({query}, 'page=([^&]*)', 1) AS INT) > 3 THEN 'pagination'
  WHEN {any_in(query, urls.TRACKING_PARAMS)} THEN 'tracking'
  WHEN regexp_matches({u}, '{black}') THEN 'blacklist' END"""


def priority(u: str) -> str:
    bands = " ".join(f"WHEN {any_in(f'lower({u})', terms)} THEN {v}" for terms, v in urls.PRIORITY_BANDS)
    return f"greatest(-100, least(1000, 500 + CASE {bands} ELSE 0 END))::INT"


LINK_RULES = f"""
SELECT page_id, {blocked("url")} AS blocked, {priority("url")} AS priority,
  {part("url", "scheme")} IN ('http', 'https') AND NOT regexp_matches(lower({part("url", "path")}), '\\.({"|".join(urls.SKIPPED_EXTENSIONS)})$') AS follow FROM pages"""

_HREFS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']*)["'']', 1)"""
_ABS = f"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href WHEN starts_with(href, '//') THEN {part("url", "scheme")} || ':' || href
  WHEN starts_with(href, '/') THEN {part("url", "scheme")} || '://' || {part("url", "host")} || href WHEN starts_with(href, '#') THEN regexp_replace(url, '#[\\s\\S]*$', '') || href
  WHEN starts_with(href, '?') THEN {part("url", "scheme")} || '://' || {part("url", "host")} || {part("url", "path")} || href
  ELSE {part("url", "scheme")} || '://' || {part("url", "host")} || CASE WHEN regexp_replace({part("url", "path")}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({part("url", "path")}, '[^/]*$', '') END || href END"""
_LINKS = f"""raw AS (SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT page_id, url, list_transform({_HREFS}, lambda h: replace(h, '&amp;', '&')) AS hs FROM pages)),
absolute AS (SELECT page_id, url, pos, {_ABS} AS a FROM raw), links AS (SELECT page_id, url, pos, {normal("a")} AS link FROM absolute)"""
EXTRACT_LINKS = f"WITH {_LINKS} SELECT page_id, pos::INT AS pos, link, {blocked('link')} AS blocked, {priority('link')} AS priority FROM links"
LINK_DEPTH = f"""
WITH {_LINKS}, d AS (SELECT *, (page_id % 4)::INT AS depth, page_id * 7 % 700 AS w, contains({part("url", "host")}, 'example.com') = contains({part("link", "host")}, 'example.com') AS same FROM links)
SELECT page_id, count(*) AS links, sum(CASE WHEN same THEN depth + 1 ELSE 0 END)::BIGINT AS depth_sum, max(CASE WHEN w > 500 THEN 6 WHEN w < 100 THEN greatest(depth + 1, 4) ELSE 5 END)::INT AS max_depth FROM d GROUP BY page_id"""


def plain(h: str) -> str:
    t = f"regexp_replace({h}, '<[^>]*>', ' ', 'g')"
    for name, char in html.ENTITIES:
        t = f"replace({t}, {q(name)}, {q(char)})"
    return f"trim(regexp_replace(regexp_replace({t}, '[\\s ]+', ' ', 'g'), ' ([.,!?;:])', '\\1', 'g'))"


_STRIPPED = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in html.UNWANTED) + "', ' ', 'g')"
_MAIN = r"""coalesce(nullif(regexp_extract(kept, '(?is)<main\b[^>]*>(.*?)</main>', 1), ''), nullif(regexp_extract(kept, '(?is)<article\b[^>]*>(.*?)</article>', 1), ''),
  nullif(regexp_extract(kept, '(?is)<div\b[^>]*class=["''][^"'']*(?:content|main)[^"'']*["''][^>]*>(.*?)</div>', 1), ''), kept)"""
_TEXTS = f"kept AS (SELECT page_id, url, html, {_STRIPPED} AS kept FROM pages), texts AS (SELECT page_id, url, html, {plain(_MAIN)} AS t FROM kept)"
HTML_CLEAN = f"WITH {_TEXTS} SELECT page_id, t AS cleaned_text FROM texts"
_HEADS = "list_concat(" + ", ".join(rf"regexp_extract_all(html, '(?is)<h{k}\b[^>]*>(.*?)</h{k}>', 1)" for k in (1, 2)) + r", regexp_extract_all(html, '(?is)<h3\b[^>]*>(.*?)</h3>', 1))"
TITLES = rf"""
SELECT page_id, trim(coalesce(nullif({plain(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)")}, ''), nullif({plain(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)")}, ''), nullif(string_split(url, '/')[-1], ''), 'Untitled')) AS title,
  least(10, len({_HEADS}))::INT AS headings, {plain(_HEADS + "[1]")} AS first_heading, nullif(regexp_extract(html, '(?is)<meta\b[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1), '') AS description FROM pages"""


def words(t: str) -> str:
    """In RE2 \\s is ASCII: further white space is spelled out."""
    return f"list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"


def _hits(text: str, terms) -> str:
    return "(" + " + ".join(f"contains({text}, {q(t)})::INT" for t in terms) + ")"


def quality(w: str, t: str) -> str:
    return f"""CASE WHEN len({w}) = 0 THEN 0.0 ELSE least(1.0, 0.5 + CASE WHEN len({w}) >= 200 THEN 0.2 WHEN len({w}) >= 100 THEN 0.1 ELSE 0 END
  + CASE WHEN {_hits(f"lower({t})", pages.RESEARCH_TERMS)} >= 3 THEN 0.2 WHEN {_hits(f"lower({t})", pages.RESEARCH_TERMS)} >= 1 THEN 0.1 ELSE 0 END + CASE WHEN len(list_distinct({w})) / len({w}) > 0.5 THEN 0.1 ELSE 0 END) END"""


def reason(w: str) -> str:
    return f"CASE WHEN len({w}) < 50 THEN 'short' WHEN 1 - len(list_distinct({w})) / len({w}) > 0.7 THEN 'repetitive' END"


_TYPE = "CASE " + " ".join(f"WHEN {any_in('lower(url)', u)} OR {_hits('lower(t)', k)} >= 2 THEN {q(n)}" for n, u, k in pages.PAGE_TYPES) + " ELSE 'general' END"


def _count(t: str, k: str) -> str:
    return f"least(5, (length({t}) - length(replace({t}, {q(k)}, ''))) // {len(k)})"


_REL = f"({' + '.join(f'{_count("lower(html)", k)} * {w}' for k, w in pages.RELEVANCE)})"
_PRESENT = f"({' + '.join(f'(contains(lower(html), {q(k)})::INT * {w})' for k, w in pages.RELEVANCE)})"
_PROCESSED = f"{_TEXTS}, p AS (SELECT *, {words('t')} AS w, {_TYPE} AS page_type FROM texts)"
PAGE_PROCESSING = f"""
WITH {_PROCESSED}
SELECT page_id AS number, len(w)::INT AS word_count, page_type, round({quality("w", "t")}, 6)::DOUBLE AS text_quality_score,
  round(CASE WHEN {_PRESENT} > 0 THEN least(1.0, {_REL} / (2 * {_PRESENT})) ELSE 0.0 END, 6)::DOUBLE AS relevance_score, {reason("w")} AS drop_reason,
  CASE page_type WHEN 'faculty' THEN 768 WHEN 'publication' THEN 1024 ELSE 512 END AS chunk_size, CASE WHEN page_type IN ('faculty', 'lab') THEN 'section' WHEN page_type = 'publication' THEN 'paragraph' ELSE 'sentence' END AS strategy,
  strlen(html) AS content_length FROM p"""
FILTER_STATISTICS = f"WITH {_PROCESSED}, r AS (SELECT {reason('w')} AS r FROM p) SELECT count(*) AS total, count(r) AS dropped, round(100.0 * count(r) / count(*), 6)::DOUBLE AS dropped_percent FROM r"
CRAWL_PROGRESS = f"""
WITH t AS (SELECT {part("url", "host")} AS domain, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS k, count(*) AS n, min(page_id) AS a, max(page_id) AS b FROM pages GROUP BY ALL)
SELECT domain, sum(n)::BIGINT AS total_pages, min(a) AS started_at, max(b) AS last_crawl, string_agg(k || ':' || n, ',' ORDER BY k) AS page_types FROM t GROUP BY domain"""
TOP_DOMAINS = f"SELECT {part('url', 'host')} AS domain, count(*) AS total_pages FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_WS}', ' ', 'g'), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), '\\.{{2,}}', '.', 'g'), '!{{2,}}', '!', 'g'), '\\?{{2,}}', '?', 'g'))"
CLEAN_TEXT = f"SELECT doc_id, md5({_CLEAN}) AS md5, length({_CLEAN})::INT AS n FROM documents"
_SENT = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^{_WS}|{_WS}$', '', 'g')), lambda s: s <> '')"
SENTENCES = f"SELECT doc_id, len({_SENT})::INT AS n, md5(array_to_string({_SENT}, '|')) AS md5 FROM documents"
TEXT_STATS = f"""
WITH w AS (SELECT doc_id, text, {words("text")} AS w, len({_SENT}) AS s FROM documents)
SELECT doc_id, length(text)::INT AS char_count, len(w)::INT AS word_count, s::INT AS sentence_count, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END, 6)::DOUBLE AS avg_word_length,
  round(CASE WHEN s > 0 THEN len(w) / s ELSE 0 END, 6)::DOUBLE AS avg_sentence_length FROM w"""
CHUNKS = f"""
WITH w AS (SELECT doc_id, {words("text")} AS w FROM documents), n AS (SELECT *, CASE WHEN len(w) < 50 THEN 0 ELSE 1 + greatest(0, ceil((len(w) - 250) / 200.0)) END::INT AS n FROM w),
c AS (SELECT doc_id, w, unnest(range(n)) AS i FROM n)
SELECT doc_id, (i + 1)::INT AS chunk_id, len(w[200 * i + 1 : 200 * i + 250])::INT AS word_count, (200 * i)::INT AS start_word, (200 * i + len(w[200 * i + 1 : 200 * i + 250]))::INT AS end_word, md5(array_to_string(w[200 * i + 1 : 200 * i + 250], ' ')) AS md5 FROM c"""
DOCUMENT_QUALITY = f"WITH w AS (SELECT doc_id, text, {words('text')} AS w FROM documents) SELECT doc_id, round({quality('w', 'text')}, 6)::DOUBLE AS quality_score, {reason('w')} AS reason, quality FROM w LEFT JOIN labels USING (doc_id)"
KEYWORD_CATEGORIES = "WITH d AS (SELECT doc_id, lower(text || ' ' || source || ' Python CLOUD theory') AS t FROM documents) SELECT doc_id, " + ", ".join(f"array_to_string(list_filter({lst(v)}, lambda k: contains(t, k)), ',') AS {k}" for k, v in entities.KEYWORDS.items()) + " FROM d"
_W = r"[\p{L}\p{N}_]+"
_STOP = "(" + ", ".join(q(w) for w in STOP_WORDS) + ")"
TFIDF = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_W}'), lambda w: length(w) > 2 AND w NOT IN {_STOP}) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS keyword FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
tf AS (SELECT doc_id, keyword, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT keyword, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, keyword, round(tf * ln((1 + (SELECT count(*) FROM documents)) / (1 + df)), 6) AS score FROM tf JOIN df USING (keyword))
SELECT doc_id, keyword, score, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword))::INT AS rank FROM s QUALIFY rank <= 5"""



def _named(patterns, without=()) -> str:
    """What the patterns find in a text t, joined."""
    every = " || ".join(f"regexp_extract_all(t, {q(p)}, 1)" for p in patterns)
    kept = f"list_filter(list_transform({every}, lambda x: trim(x)), lambda x: length(x) > 3" + (f" AND x NOT IN ({lst(without)[1:-1]}))" if without else ")")
    return f"array_to_string(list_sort(list_distinct({kept})), '|')"


_TOPIC_LIST = "(" + "|".join(t.replace(" ", r"\s+") for t in entities.TOPICS) + ")"
ENTITY_PATTERNS = f"""
SELECT doc_id, {_named(entities.LAB_PATTERNS, entities.NOT_LABS)} AS labs, {_named((*entities.TOPIC_PATTERNS, _TOPIC_LIST))} AS topics, {_named(entities.ORG_PATTERNS)} AS organizations
FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"""

TERMS = {"the": "Lab", "and": "Lab", "that": "Person", "der": "Person", "die": "ResearchTopic", "que": "ResearchTopic", "les": "Organization", "una": "Organization"}
_TERMS = "(VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in TERMS.items()) + ") AS g(entity_name, entity_type)"
_M = f"m AS (SELECT doc_id AS page_id, entity_name, entity_type, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS entity_name FROM documents) JOIN {_TERMS} USING (entity_name) GROUP BY ALL)"
_E = "e AS (SELECT entity_name, entity_type, count(DISTINCT page_id) AS page_count, sum(count)::BIGINT AS total_mentions FROM m GROUP BY ALL)"
MENTIONS = f"WITH {_M} SELECT * FROM m"
ENTITY_STATISTICS = f"""
WITH {_M}, {_E}, s AS (SELECT entity_name, doc_id, source || '/' || lang AS x FROM m JOIN documents ON doc_id = page_id QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY doc_id) <= 3),
a AS (SELECT entity_name, string_agg(x, ',' ORDER BY doc_id) AS samples FROM s GROUP BY 1) SELECT e.*, samples FROM e JOIN a USING (entity_name)"""
TYPE_COUNTS = f"WITH {_M} SELECT entity_type, count(DISTINCT entity_name) AS entities, sum(count)::BIGINT AS mentions FROM m GROUP BY 1"
TOP_LABS = f"WITH {_M} SELECT entity_name, count(DISTINCT page_id) AS pages FROM m WHERE entity_type = 'Lab' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
GRAPH_SEARCH = f"""
WITH {_M}, {_E}, u AS (SELECT conv_id AS query_id, CASE WHEN conv_id % 10 = 0 THEN 'que' WHEN conv_id % 10 = 1 THEN 'die-alias' ELSE '' END AS qq FROM conversations WHERE role = 'user' AND turn = 0),
x AS (SELECT query_id, entity_name, NULL::BIGINT AS total_mentions, 1.0::DOUBLE AS score, (row_number() OVER (PARTITION BY query_id ORDER BY entity_name))::INT AS rank, entity_name || ' (' || entity_type || ')' AS text FROM u JOIN e ON qq = entity_name OR qq = entity_name || '-alias'),
f AS (SELECT query_id, entity_name, total_mentions, round(least(1.0, total_mentions / 100.0), 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY query_id ORDER BY total_mentions DESC, page_count DESC, entity_name))::INT AS rank,
  entity_name || ' (' || entity_type || ') - ' || total_mentions || ' mentions' AS text FROM u JOIN e ON {" OR ".join(f"contains(lower(entity_name), {q(t)}) OR contains(lower(entity_type), {q(t)})" for t in ("th", "lab", "di"))} WHERE query_id NOT IN (SELECT query_id FROM x) QUALIFY rank <= 20)
SELECT * FROM x UNION ALL SELECT * FROM f"""
ENTITY_AGGREGATION = f"""
WITH {_M}, u AS (SELECT conv_id AS query_id, 'src' || conv_id % 5 AS term FROM conversations WHERE role = 'user' AND turn = 0),
h AS (SELECT query_id, entity_name, count(DISTINCT page_id) AS page_count, sum(count)::BIGINT AS total_mentions, min({{'u': source, 't': lang}}) AS p FROM m JOIN documents ON doc_id = page_id JOIN u ON contains(source, term) OR contains(lang, term) OR contains(entity_name, term)
  WHERE entity_type = 'Person' GROUP BY ALL HAVING sum(count) > 2)
SELECT query_id, entity_name, page_count, total_mentions, p.u AS source, p.t AS title, round(least(total_mentions / 50.0, 1.0), 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY query_id ORDER BY total_mentions DESC, page_count DESC, entity_name))::INT AS rank FROM h QUALIFY rank <= 20"""
NODE_UPSERT = "SELECT source AS key, arg_max(lang, doc_id) AS name, max(doc_id) AS version FROM documents GROUP BY 1"
EDGE_UPSERT = "SELECT source AS src_key, lang AS dst_key, sum(n_chars)::BIGINT AS count FROM documents GROUP BY ALL"
FACULTY_PROFILES = """
WITH r AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY p_brand) AS topics FROM r GROUP BY 1)
SELECT s_suppkey::VARCHAR AS key, s_name AS name, coalesce(n_name, '') AS labs, '' AS projects, coalesce(topics, '') AS topics FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN t ON l_suppkey = s_suppkey WHERE contains(lower(s_name), '0')"""
TOPIC_SEARCH = """
SELECT p_partkey::VARCHAR AS key, p_brand AS topic, count(DISTINCT s_name)::INT AS faculty, 0 AS labs FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE contains(lower(p_brand), '1') GROUP BY ALL"""
TWO_HOPS = "SELECT p::VARCHAR AS src_key, s_nationkey::VARCHAR AS dst_key, count(*) AS ways FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) JOIN supplier ON s_suppkey = s GROUP BY ALL"

_D = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))"
_C = "1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE ** 2))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE ** 2))))"


def _near(metric: str, k: int, condition: str = "") -> str:
    return f"SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({metric}, 6) + 0.0 AS distance, (row_number() OVER (PARTITION BY a.vec_id ORDER BY round({metric}, 6), b.vec_id))::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 {condition} QUALIFY rank <= {k}"


def knn(kind: str) -> str:
    return {"l2": _near(_D, 50), "cosine": _near(_C, 10), "filtered": _near(_D, 30, "AND a.label = b.label")}[kind]


VECTOR_FUNCTIONS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS b FROM embeddings),
d AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / list_sum(list_transform(a, lambda x: x * x)) AS c, list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) ** 2)) AS d FROM v)
SELECT vec_id, round(c, 6) AS cosine, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM d"""
_STRATEGIES = f"h AS (SELECT *, 'dense' AS strategy, 1 AS o FROM ({_near(_D, 50)}) UNION ALL SELECT *, 'targeted', 4 FROM ({_near(_D, 30, 'AND a.label = b.label')}))"
RRF = f"""
WITH {_STRATEGIES}, f AS (SELECT query_id, doc_id::VARCHAR AS doc_key, arg_min(distance, {{'o': o, 'r': rank}}) AS distance, sum(1 / (60 + rank)) AS s, string_agg(strategy, ',' ORDER BY o, rank) AS strategies, count(*) AS num_strategies, count(DISTINCT strategy) AS n_distinct_strategies, min({{'o': o, 'r': rank}}) AS first FROM h GROUP BY ALL)
SELECT query_id, doc_key, distance, round(s, 9) AS rrf_score, strategies, num_strategies, n_distinct_strategies, round(s * CASE WHEN num_strategies >= 3 THEN 1.4 WHEN num_strategies >= 2 THEN 1.2 ELSE 1.0 END, 9) AS final_score,
  (row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, first, doc_key))::INT AS fused_rank FROM f QUALIFY fused_rank <= 100"""
RRF_VARIATIONS = f"""
WITH {_STRATEGIES}, f AS (SELECT query_id, 's' || doc_id % 7 AS doc_key, sum(1 / (60 + rank)) AS s, count(*) AS hits FROM h GROUP BY ALL)
SELECT query_id, doc_key, round(s, 9) AS score, hits, (row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, doc_key))::INT AS fused_rank FROM f QUALIFY fused_rank <= 5"""


def _pick(values, index: str) -> str:
    return f"{lst(values)}[({index}) + 1]"


_PH = f"""h0 AS (SELECT page_id, page_id % 7 AS query_id, {part("url", "scheme")} || '://' || {part("url", "host")} || {_pick(("/faculty/", "/people/", "/department/", "/lab/", "/form/", "/x/"), "page_id * 5 % 6")} || page_id % 40 || '/' AS source,
  {_pick(("faculty-list", "faculty", "department", "lab", "profile", "general"), "page_id % 6")} AS page_type, {_pick(("Faculty of physics", "People directory", "All labs", "About"), "page_id % 4")} || ' ' || page_id % 9 AS title, {part("url", "host")} AS domain, html AS text,
  (page_id * 37 % 101) / 1000.0::DOUBLE AS rrf_score, page_id % 4 AS n, page_id % 3 = 0 AS matches FROM pages),
h AS (SELECT *, {_pick(QUESTIONS, "query_id")} AS query, {any_in(f"lower({_pick(QUESTIONS, 'query_id')})", analyze.FACULTY_WORDS)} AS fac, {any_in(f"lower({_pick(QUESTIONS, 'query_id')})", analyze.LIST_WORDS)} AS lis,
  query_id % 2 = 0 AS has_dept, query_id % 2 = 0 AND contains(source, 'tion') AS dept, rrf_score * 4 AS score, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS rank FROM h0)"""
_IB = f"""(CASE WHEN fac THEN CASE WHEN contains(page_type, 'faculty-list') THEN 2.5 WHEN contains(page_type, 'faculty') THEN 2.0 WHEN contains(page_type, 'department') THEN 1.8 ELSE 1 END ELSE 1 END::DOUBLE
  * CASE WHEN fac AND {any_in("source", ("/faculty/", "/people/", "/members/"))} THEN 1.5 ELSE 1 END * CASE WHEN lis AND {any_in("page_type", ("faculty-list", "department", "directory"))} THEN 1.8 ELSE 1 END * CASE WHEN dept THEN 1.6 ELSE 1 END
  * CASE WHEN n >= 3 THEN 1.4 WHEN n >= 2 THEN 1.2 ELSE 1 END)"""
INTELLIGENCE = f"""
WITH {_PH} SELECT page_id, round({_IB}, 6) AS boost, concat_ws('; ', CASE WHEN fac THEN CASE WHEN contains(page_type, 'faculty-list') THEN 'faculty-list page for faculty query' WHEN contains(page_type, 'faculty') THEN 'faculty page for faculty query' WHEN contains(page_type, 'department') THEN 'department page for faculty query' END END,
  CASE WHEN fac AND {any_in("source", ("/faculty/", "/people/", "/members/"))} THEN 'faculty URL pattern' END, CASE WHEN lis AND {any_in("page_type", ("faculty-list", "department", "directory"))} THEN 'list-type page for list query' END,
  CASE WHEN dept THEN 'department domain match' END, CASE WHEN n >= 2 THEN 'matched ' || n || ' strategies' END) AS reasons, round(rrf_score * {_IB}, 6) AS final_score FROM h"""
URL_BOOSTS = f"""
WITH {_PH} SELECT page_id, round(CASE WHEN contains(source, '/form/') THEN 0.3 ELSE CASE WHEN {any_in("lower(query)", ("faculty", "professor", "researcher", "staff", "who is", "people"))} AND {any_in("source", ("/faculty/", "/people/"))} THEN 2.0 ELSE 1.0 END
  * CASE WHEN {any_in("lower(query)", ("lab", "laboratory", "group"))} AND contains(source, '/lab/') THEN 1.8 ELSE 1.0 END * CASE WHEN contains(source, 'example.com') THEN 1.3 ELSE 1.0 END END, 6)::DOUBLE AS url_boost,
  round(CASE WHEN contains(source, 'example.org') THEN 0.2 WHEN contains(source, '/form/') THEN 0.3 ELSE CASE WHEN contains(source, 'example.com') THEN 2.0 ELSE 1.0 END * CASE WHEN {any_in("source", ("/people/", "/x/"))} THEN 1.8 ELSE 1.0 END * CASE WHEN contains(source, 'tion') THEN 1.5 ELSE 1.0 END END, 6)::DOUBLE AS dynamic_boost,
  has_dept AND contains(source, 'tion') AS dept FROM h"""
_S2 = f"""(CASE WHEN fac THEN CASE WHEN contains(page_type, 'faculty-list') THEN 2.5 WHEN contains(page_type, 'faculty') THEN 2.0 WHEN contains(page_type, 'department') AND {any_in("lower(title)", ("faculty", "people"))} THEN 2.2 ELSE 1 END ELSE 1 END::DOUBLE
  * CASE WHEN fac AND {any_in("source", ("/faculty/", "/people/"))} THEN 1.8 ELSE 1 END * CASE WHEN lis AND {any_in("page_type", ("faculty-list", "directory", "department"))} THEN 1.9 ELSE 1 END * CASE WHEN lis AND page_type = 'profile' THEN 0.7 ELSE 1 END
  * CASE WHEN NOT lis AND page_type = 'profile' AND {any_in("lower(query)", ("about", "tell me", "describe", "what is"))} THEN 1.5 ELSE 1 END)"""
STAGE2 = f"""
WITH {_PH}, a AS (SELECT *, score AS s1, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, rank) AS r1 FROM h QUALIFY r1 <= 100)
SELECT page_id, round(s1, 6) AS stage1_score, round({_S2}, 6) AS llm_boost, round(s1 * {_S2}, 6) AS stage2_score, concat_ws('; ', CASE WHEN fac THEN CASE WHEN contains(page_type, 'faculty-list') THEN 'faculty-list page highly relevant for faculty query' WHEN contains(page_type, 'faculty') THEN 'faculty page relevant for faculty query'
  WHEN contains(page_type, 'department') AND {any_in("lower(title)", ("faculty", "people"))} THEN 'department page with faculty info' END END, CASE WHEN fac AND {any_in("source", ("/faculty/", "/people/"))} THEN 'faculty directory URL' END,
  CASE WHEN lis AND {any_in("page_type", ("faculty-list", "directory", "department"))} THEN 'comprehensive list page for list query' END, CASE WHEN lis AND page_type = 'profile' THEN 'individual profile less useful for list query' END,
  CASE WHEN NOT lis AND page_type = 'profile' AND {any_in("lower(query)", ("about", "tell me", "describe", "what is"))} THEN 'detailed profile good for specific query' END) AS reasons,
  (row_number() OVER (PARTITION BY query_id ORDER BY round(s1 * {_S2}, 12) DESC, r1))::INT AS rank FROM a QUALIFY rank <= 80"""
_TOK = lambda t: f"list_distinct(regexp_extract_all(lower({t}), '{_W}'))"
_SIG = {
    "url_pattern": "1 + 0.3 * (contains(source, '/faculty/') OR contains(source, '/people/'))::INT + 0.2 * contains(source, '/department/')::INT + 0.15 * contains(source, '/lab/')::INT",
    "page_type": "1 + 0.35 * contains(p, 'faculty')::INT + 0.35 * (contains(p, 'department') OR contains(p, 'faculty-list'))::INT + 0.2 * contains(p, 'lab')::INT",
    "domain_authority": "CASE WHEN contains(domain, 'example.com') THEN 1.4 ELSE 1.0 END",
    "department_match": "1 + 0.25 * (has_dept AND matches)::INT + 0.2 * (has_dept AND contains(source, 'tion'))::INT",
    "multi_strategy": "CASE WHEN n >= 3 THEN 1.3 WHEN n >= 2 THEN 1.15 ELSE 1 END",
    "title_relevance": f"CASE WHEN len(list_intersect({_TOK('query')}, {_TOK('title')})) >= 3 THEN 1.25 WHEN len(list_intersect({_TOK('query')}, {_TOK('title')})) >= 2 THEN 1.15 WHEN len(list_intersect({_TOK('query')}, {_TOK('title')})) >= 1 THEN 1.05 ELSE 1 END",
    "content_quality": "1.1", "exclude_penalty": "CASE WHEN contains(source, '/form/') THEN 0.3 ELSE 1.0 END", "rrf_contribution": "CASE WHEN rrf_score > 0.02 THEN 1.2 WHEN rrf_score > 0.01 THEN 1.1 ELSE 1.0 END", "retriever_intelligence": _IB,
}
STAGE4 = f"""
WITH {_PH}, g AS (SELECT *, page_type AS p FROM h), s AS (SELECT page_id, query_id, rank AS r0, score, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in _SIG.items())} FROM g), b AS (SELECT *, {" * ".join(_SIG)} AS m FROM s)
SELECT page_id, {", ".join(f"round({k}, 12) AS {k}" for k in _SIG)}, round(m, 12) AS multi_signal_boost, round(score * m, 12) AS stage4_score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score * m, 12) DESC, r0))::INT AS rank FROM b"""
_TH = "greatest(0.01, least(avg(s4) OVER g - 2 * stddev_pop(s4) OVER g, 0.1 * avg(s4) OVER g))"
STAGE5_THRESHOLD = f"WITH {_PH}, s AS (SELECT *, score + 0.05 AS s4 FROM h) SELECT page_id, round({_TH}, 6) AS threshold FROM s WINDOW g AS (PARTITION BY query_id)"
STAGE5 = f"""
WITH RECURSIVE {_PH}, s AS (SELECT *, round(score + 0.05, 9) AS s4 FROM h), k AS (SELECT *, {_TH} AS th FROM s WINDOW g AS (PARTITION BY query_id)),
o AS (SELECT query_id, page_id, source, lower(title) AS t, s4, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM k WHERE s4 >= th AND source <> '' AND text <> '' AND NOT contains(source, '/form/')),
f AS (SELECT query_id, 0::BIGINT AS i, []::VARCHAR[] AS ss, []::VARCHAR[] AS ts, []::BIGINT[] AS ps FROM o GROUP BY query_id
  UNION ALL SELECT f.query_id, o.i, CASE WHEN ok THEN list_append(ss, source) ELSE ss END, CASE WHEN ok THEN list_append(ts, t) ELSE ts END, CASE WHEN ok THEN list_append(ps, page_id) ELSE ps END
  FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1, LATERAL (SELECT len(ps) < 12 AND NOT list_contains(ss, source) AND NOT (list_contains(ts, t) AND length(t) > 10) AS ok)),
z AS (SELECT query_id, arg_max(ps, i) AS ps FROM f GROUP BY 1), u AS (SELECT query_id, unnest(ps) AS page_id, generate_subscripts(ps, 1)::INT AS rank FROM z)
SELECT u.query_id, page_id, round(s4, 6) AS score, u.rank FROM u JOIN o USING (query_id, page_id)"""
DIVERSIFY = f"""
WITH RECURSIVE {_PH}, s AS (SELECT *, round(rrf_score / 2, 9) AS fs FROM h), o AS (SELECT query_id, page_id, domain, page_type, fs, row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, rank) AS i, count(*) OVER (PARTITION BY query_id) AS c FROM s),
f AS (SELECT query_id, 0::BIGINT AS i, []::VARCHAR[] AS hs, []::VARCHAR[] AS ts, []::BIGINT[] AS ps, []::BIGINT[] AS sk FROM o WHERE c > 15 GROUP BY query_id
  UNION ALL SELECT f.query_id, o.i, CASE WHEN ok THEN list_append(hs, domain) ELSE hs END, CASE WHEN ok THEN list_append(ts, page_type) ELSE ts END, CASE WHEN ok THEN list_append(ps, page_id) ELSE ps END, CASE WHEN ok OR len(ps) >= 15 THEN sk ELSE list_append(sk, page_id) END
  FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1, LATERAL (SELECT len(ps) < 15 AND (fs > 0.05 OR (len(list_filter(hs, lambda x: x = domain)) < 2 AND len(list_filter(ts, lambda x: x = page_type)) < 4)) AS ok)),
z AS (SELECT query_id, arg_max(list_concat(ps, sk), i)[1:15] AS ps FROM f GROUP BY 1)
SELECT query_id, unnest(ps) AS page_id, generate_subscripts(ps, 1)::INT AS div_rank FROM z UNION ALL SELECT query_id, page_id, i::INT FROM o WHERE c <= 15"""
LISTWISE = f"WITH {_PH} SELECT query_id, page_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE rank WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 7 THEN 2 ELSE 9 END, rank))::INT AS llm_rank FROM h WHERE rank <= 20"


def _conf(k: str, patterns) -> str:
    return f"""least(1.0, 0.5 + least(0.2 * max(score) FILTER (WHERE rank = 1), 0.2) + CASE WHEN count(DISTINCT score) FILTER (WHERE {k}) > 5 THEN 0.1 ELSE 0 END + CASE WHEN count(DISTINCT source) FILTER (WHERE {k}) > 5 THEN 0.1 ELSE 0 END
  + least(count(*) FILTER (WHERE {k} AND {any_in("source", patterns)}) / 10, 0.1))"""


CONFIDENCE = f"WITH {_PH} SELECT query_id, round({_conf('rank <= 10', ('/faculty/', '/people/'))}, 6)::DOUBLE AS confidence FROM h GROUP BY 1"
ADAPTIVE = f"""
WITH {_PH}, c AS (SELECT query_id, count(*) AS n, {", ".join(f"{_conf(f'rank <= {min(10, k)}', ('/nowhere/',))} AS c{k}" for k in (3, 6, 12))} FROM h GROUP BY 1)
SELECT query_id, (CASE WHEN c3 >= 0.65 THEN 3 WHEN c6 >= 0.65 THEN 6 WHEN c12 >= 0.65 THEN 12 WHEN c3 >= greatest(c6, c12) THEN 3 WHEN c6 >= c12 THEN 6 ELSE 12 END)::INT AS k,
  round(CASE WHEN c3 >= 0.65 THEN c3 WHEN c6 >= 0.65 THEN c6 WHEN c12 >= 0.65 THEN c12 ELSE greatest(c3, c6, c12) END, 6)::DOUBLE AS confidence, least(n, k) AS hits FROM c"""
BM25 = f"""
WITH a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM benchmark WHERE item_id % 100 = 0),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_W}') AS w FROM documents), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM a) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
r AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN a USING (term), s GROUP BY ALL)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM r QUALIFY rank <= 10"""

def _bounded(p: str) -> str:
    """Word borders as classes: in RE2 \\b knows ASCII letters only."""
    p = r"(?:^|[^\p{L}\p{N}_])" + p[2:] if p.startswith(r"\b") else p
    return p[:-2] + r"(?:[^\p{L}\p{N}_]|$)" if p.endswith(r"\b") else p


_QA = f"SELECT conv_id, {_pick(QUESTIONS, 'conv_id % 7')} || ' ' || text AS query FROM conversations WHERE turn = 0"
_INT = "list_sort(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(lower(query), {q('(?i)' + _bounded(p))})" for p in ps) + f" THEN {q(n)} END" for n, ps in analyze.INTENTS.items()) + "], lambda x: x IS NOT NULL))"
_QT = "CASE " + " ".join(f"WHEN list_contains(i, {q(n)}) THEN {q(k)}" for n, k in analyze.QUERY_TYPES) + " ELSE 'general_search' END"
QUERY_ANALYSIS = f"""
WITH a AS ({_QA}), b AS (SELECT *, {_INT} AS i, {words("query")} AS w FROM a), c AS (SELECT *, {_QT} AS k, {any_in("lower(query)", analyze.LIST_WORDS)} AS li, {any_in("lower(query)", analyze.FACULTY_WORDS)} AS fa FROM b)
SELECT conv_id, array_to_string(i, ',') AS intents, k AS query_type, array_to_string(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) BETWEEN 2 AND 5), ',') AS acronyms,
  len(list_filter(w, lambda x: length(x) > 2 AND lower(x) NOT IN ('the', 'and', 'for', 'are', 'with', 'this', 'that')))::INT AS keywords, len(list_filter(w[2:], lambda x: upper(x[1:1]) = x[1:1] AND lower(x[1:1]) <> x[1:1] AND length(x) > 1))::INT AS proper_nouns, li AS is_list_query, fa AS is_faculty_query,
  CASE WHEN k = 'list_aggregation' THEN 2.0 ELSE 1.0 END::DOUBLE AS graph_weight,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN k IN ('faculty_search', 'person_lookup') THEN ['faculty', 'professor', 'researcher', 'staff', 'member'] WHEN k = 'lab_search' THEN ['laboratory', 'research', 'group', 'center', 'team'] WHEN k = 'department_search' THEN ['department', 'division', 'school', 'institute'] ELSE [] END,
    CASE WHEN list_contains(i, 'list_all') THEN ['members', 'people', 'team', 'staff'] ELSE [] END))), ',') AS expansion,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN fa THEN ['faculty', 'faculty-list', 'department', 'lab'] ELSE [] END, list_concat(CASE WHEN contains(k, 'lab') THEN ['lab', 'research'] ELSE [] END, CASE WHEN contains(k, 'department') THEN ['department', 'faculty-list'] ELSE [] END)))), ',') AS targets FROM c"""
_AC = [k for k, _ in EXAMPLE.acronyms]
_ACQ = f"' ' || lower(upper({_pick(_AC, f'conv_id * 3 % {len(_AC)}')}) || ' labs ' || {_pick(_AC, f'conv_id * 7 % {len(_AC)}')} || ' ' || {_pick(_AC, f'conv_id * 7 % {len(_AC)}')} || ' x ' || {_pick(_AC, f'conv_id * 11 % {len(_AC)}')}) || ' '"
ACRONYMS = f"SELECT conv_id, trim({reduce(lambda t, kv: f'replace({t}, {q(" " + kv[0] + " ")}, {q(" " + kv[1] + " ")})', EXAMPLE.acronyms, 'z')}) AS expanded FROM (SELECT conv_id, {_ACQ} AS z FROM conversations WHERE turn = 0)"
RESOLUTION = f"""
WITH w AS (SELECT conv_id, turn, role, text, count(*) OVER b AS n, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER b, '') AS l FROM conversations WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, md5(CASE WHEN {any_in("lower(text)", analyze.REFERENCES)} AND n >= 2 AND l <> '' THEN 'Previous question was: ''' || l || '''. Now answering: ' || text ELSE text END) AS md5 FROM w WHERE role = 'user'"""
DEPARTMENTS = f"""
WITH a AS (SELECT conv_id, {_pick(("physics department people", "who works in CSA or cds", "neuroscience labs", "nothing here"), "conv_id % 4")} AS query FROM conversations WHERE turn = 0)
SELECT conv_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(query), {q(chr(92) + 'b(?:' + '|'.join([k, *v]) + ')' + chr(92) + 'b')}) THEN {q(k)} END" for k, v in EXAMPLE.departments.items())}], lambda x: x IS NOT NULL), ',') AS departments FROM a"""
_KW = f"list_filter(regexp_extract_all(lower(text), '{_W}'), lambda w: w NOT IN {_STOP} AND length(w) > 2)"
QUERY_KEYWORDS = f"SELECT conv_id, turn, md5(array_to_string({_KW}, ',')) AS md5, len({_KW})::INT AS n FROM conversations WHERE role = 'user'"

_TITLE = "substr(q, 1, 50) || CASE WHEN length(q) > 50 THEN '...' ELSE '' END"
_TH0 = f"t0 AS (SELECT conv_id AS thread_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS q, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY 1), t AS (SELECT thread_id, {_TITLE} AS title, message_count, last_turn * 1000 + thread_id % 97 AS updated_at, CASE WHEN thread_id % 5 = 0 THEN 'archived' ELSE 'active' END AS status FROM t0)"
THREAD_LIST = f"WITH {_TH0} SELECT * FROM t WHERE status = 'active' ORDER BY updated_at DESC, thread_id LIMIT 50"
THREAD_SEARCH = f"WITH {_TH0} SELECT thread_id, title, updated_at FROM t WHERE title ILIKE '%ION_R%' OR thread_id IN (SELECT conv_id FROM conversations WHERE text ILIKE '%ION_R%') ORDER BY updated_at DESC, thread_id LIMIT 20"
THREAD_MESSAGES = "SELECT conv_id || '-' || turn AS message_id, role, turn AS created_at FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 20"
THREAD_DELETE = "SELECT (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 5 <> 0) AS threads, (SELECT count(*) FROM conversations WHERE conv_id % 5 <> 0) AS messages, (SELECT count(*) FROM conversations WHERE conv_id % 5 <> 0) AS contexts"
HISTORY = "WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) SELECT conv_id, md5(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn)) AS md5 FROM l GROUP BY 1"
RUNNING = "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS message_count FROM conversations"
SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS events FROM s GROUP BY user_id, k"""
RESUME = "SELECT CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'p' || doc_id END AS page_id, 'u' || doc_id AS url FROM documents WHERE doc_id % 3 <> 0"
INCREMENTAL = "SELECT DISTINCT regexp_extract(url, 'https?://([^/]+)', 1) AS url FROM pages EXCEPT SELECT regexp_extract(url, 'https?://([^/]+)', 1) FROM pages WHERE page_id % 10 = 0"
EVENT_COUNTERS = "SELECT event_type, count(*) AS total, round(avg(value), 6) AS mean_value, max(value) AS largest FROM events GROUP BY 1"
CONTEXT_PACK = f"""
WITH w AS (SELECT doc_id % 20 AS query_id, doc_id, text, {words("text")} AS w FROM documents), b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY query_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before FROM w)
SELECT query_id, doc_id, words_before, md5(CASE WHEN words_before + len(w) > 2000 THEN array_to_string(w[1 : 2000 - words_before], ' ') ELSE text END) AS md5 FROM b WHERE words_before < 2000"""
SOURCES = f"WITH {_PH} SELECT query_id, rank::INT AS rank, title, source AS url, page_type, format('{{:.3f}}', round(score, 6)) AS relevance_score FROM h WHERE rank <= 5"
