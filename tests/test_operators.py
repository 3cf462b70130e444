"""Literal cases and small brute-force comparisons of the engine's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import html, text, urls
from tessella.functions.profile import Profile
from tessella.operators import adaptive, analyze, chat, context, entities, fuse, graph, pages, rerank, vector
from tessella.plans import retrieval
from tessella.sources import files, stores


def value(spark, column, **columns):
    """One column expression over literal columns."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(column.alias("x")).first().x


# --- text


@pytest.mark.parametrize("n", [0, 49, 50, 249, 250, 251, 450, 451, 651, 1234])
def test_chunks_equal_a_loop(spark, n):
    w = [f"w{i}" for i in range(n)]
    want, start = [], 0
    while n >= 50 and start < n:
        want.append((len(want) + 1, start, min(start + 250, n), " ".join(w[start : start + 250])))
        if start + 250 >= n:
            break
        start += 200
    df = spark.createDataFrame([(1, "  ".join(w) + "\n")], "id int, text string")
    got = [(r.chunk_id, r.start_word, r.end_word, r.text) for r in text.chunks(df, ["id"]).orderBy("chunk_id").collect()]
    assert got == want


def test_clean_text(spark):
    f = lambda s: value(spark, text.clean_text(F.col("t")), t=s)
    assert f("  a\t\n b c \x07!!  ok...") == "a b c ! ok."
    assert f("x?!?!!") == "x?!?!" and f("") == "" and f(None) is None
    assert value(spark, text.sentences(F.col("t")), t=" A b.. C!? \n d ") == ["A b", "C", "d"]
    s = value(spark, text.text_stats(F.col("t")), t="")
    assert (s.char_count, s.word_count, s.avg_word_length, s.avg_sentence_length) == (0, 0, 0.0, 0.0)
    assert value(spark, text.title_case(F.col("t")), t="dna-repair o'neil über x2y") == "dna-repair o'neil über x2y".title()
    assert value(spark, text.keywords(F.col("t")), t="Who is the Über-professor of AI?") == ["über", "professor"]


# --- URLs and pages


def test_urls(spark):
    n = lambda u: value(spark, urls.normalize(F.col("u")), u=u)
    assert n("HTTP://A.COM/x/?b=2&a=1&c#f") == "HTTP://a.com/x?a=1&b=2&c=" and n("http://A.com/") == "https://a.com/" and n("http://a.com") == "https://a.com"
    r = lambda h: value(spark, urls.resolve(F.col("b"), F.col("h")), b="http://a.com/x/y.html?q=1#f", h=h)
    assert [r(h) for h in ("http://b.c/d", "//b.c/d", "/r", "z", "?k=2", "#top", "mailto:x@y.z")] == ["http://b.c/d", "http://b.c/d", "http://a.com/r", "http://a.com/x/z", "http://a.com/x/y.html?k=2", "http://a.com/x/y.html?q=1#top", "mailto:x@y.z"]
    b = lambda u: value(spark, urls.block_reason(F.col("u")), u=u)
    assert [b(u) for u in ("http://a.com/x.PDF", "http://a.com/news/a/b", "http://a.com/news", "http://a.com/x?page=4", "http://a.com/x?page=3", "http://a.com/x?utm_source=y", "http://a.com/calendar?date=1", "http://a.com/x?page=abc")] == ["extension", "noise", None, "pagination", None, "tracking", "date", None]
    assert value(spark, urls.block_reason(F.col("u"), whitelist=("*good*",)), u="http://good.com/x.pdf") is None
    p = lambda u: value(spark, urls.priority(F.col("u")), u=u)
    assert [p("http://a/faculty/x"), p("http://a/news/x"), p("http://a/q")] == [800, 400, 500]
    assert value(spark, urls.priority(F.col("u"), F.lit("faculty")), u="http://a/q") == 550
    f = lambda u, **k: value(spark, urls.should_follow(F.col("u"), F.lit("http://a.com/x"), **k), u=u)
    assert [f("http://a.com/x#y"), f("http://a.com/z#y"), f("ftp://a.com/z"), f("http://a.com/z.mp4"), f("http://b.com/z", allowed_hosts=("a.com",))] == [False, True, False, False, False]
    assert value(spark, urls.page_id(F.col("u"), F.lit("a.b.c")), u="http://a.b.c/") == "a_b_c_" + __import__("hashlib").md5(b"http://a.b.c/").hexdigest()[:12]
    route = lambda k, s, n, i=True: tuple(value(spark, urls.error_route(F.lit(k), F.lit(s), F.lit(n), F.lit(i)), u=""))
    assert [route("http", 429, 0), route("http", 503, 1), route("http", 503, 2), route("timeout", 0, 1), route("timeout", 0, 0, False)] == [(True, -100), (True, 50), (False, None), (True, 100), (False, None)]
    assert tuple(value(spark, urls.retry_decision(F.lit(503), F.lit(2)), u="")) == (True, 4.0, -1)
    assert [value(spark, urls.adjusted_max_depth(F.lit(w), F.lit(3), F.lit(5)), u="") for w in (501, 300, 99)] == [6, 5, 4]


def test_pages(spark):
    page = "<html><head><title> T &amp; x </title><meta name='description' content='d'></head><body><nav>no</nav><script>var a='<p>';</script><article><h1>Head</h1><p>One , two.</p></article><footer>no</footer></body></html>"
    row = pages.process(spark.createDataFrame([("http://a.com/labs/x", page)], "url string, html string")).first()
    assert (row.title, row.cleaned_text, row.page_type, row.drop_reason, row.metadata.description) == ("T & x", "Head One, two.", "lab", "short", "d")
    assert [(h.level, h.text) for h in row.metadata.headings] == [(1, "Head")] and row.chunking_hints.strategy == "section"
    assert value(spark, html.title(F.col("h"), F.col("u")), h="<p>x</p>", u="http://a.com/last") == "last"
    q = lambda words, status=200: value(spark, pages.quality_reason(F.col("t"), F.lit(status)), t=" ".join(words))
    assert q(["a"] * 49) == "short" and q([f"w{i % 15}" for i in range(50)]) is None and q([f"w{i % 14}" for i in range(50)]) == "repetitive" and q([f"w{i}" for i in range(60)], 301) == "redirect"
    assert value(spark, pages.page_type(F.lit("http://a/x"), F.col("t")), t="The course Syllabus") == "course"
    assert math.isclose(value(spark, pages.relevance(F.col("t")), t="Research research lab"), (2 * 2 + 1.5) / (2 * 3.5))
    assert value(spark, pages.valid(F.lit("u"), F.lit(""), F.lit("h")), t="") is False


def test_frontier(spark):
    links = [("http://p/a", "http://p/b"), ("http://p/b", "http://p/c"), ("http://p/c", "http://q/1"), ("http://q/1", "http://q/2"), ("http://q/2", "http://q/3"), ("http://q/3", "http://q/4"), ("http://q/2", "http://p/z")]
    got = pages.expand_frontier(spark.createDataFrame([("http://p/a",)], "url string"), spark.createDataFrame(links, "source string, link string"), "p", 5, 2)
    assert {r.url: r.depth for r in got.collect()} == {"http://p/a": 0, "http://p/b": 1, "http://p/c": 2, "http://q/1": 0, "http://q/2": 1, "http://q/3": 2, "http://p/z": 0}


# --- questions


def test_questions(spark):
    e = lambda s: value(spark, analyze.expand_acronyms(F.col("q")), q=s)
    assert e("cds faculty list") == "computational and data sciences faculty list" and e("CDS Faculty") == "computational and data sciences faculty"
    assert e("cds cds") == "computational and data sciences cds" and e("msci labs") == "department of materials engineering science labs"
    rows = [(1, 0, "user", "who is prof murugesh"), (1, 1, "assistant", "x"), (1, 2, "user", "what is his lab"), (2, 0, "user", "what is his lab")]
    got = {(r.conv_id, r.turn): r["query"] for r in analyze.resolve_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {(1, 0): "who is prof murugesh", (1, 2): "Previous question was: 'who is prof murugesh'. Now answering: what is his lab", (2, 0): "what is his lab"}
    a = {r["query"]: r for r in analyze.analyze(spark.createDataFrame([("list all faculty",), ("machine learning courses",), ("CDS labs?",), ("",)], "query string")).collect()}
    assert a["list all faculty"].query_type == "list_aggregation" and a["list all faculty"].search_strategy.boost_url_patterns == ["/faculty/", "/people/", "/staff/", "/members/"]
    assert a["machine learning courses"].query_type == "person_lookup" and a[""].query_type == "general_search" and a[""].intents == []
    assert a["CDS labs?"].entities.acronyms == ["CDS"] and a["CDS labs?"].departments == ["cds"]


# --- entities and graph


def test_entities(spark):
    t = "The machine vision lab studies deep learning. Department of physics and the lab of optics. Research in quantum computing"
    row = spark.range(1).select(entities.page_entities(F.lit(t), F.lit("http://x.edu/faculty/jane-doe/index.html"), F.lit("Robotics Lab - Prof. Ada Byron King")).alias("e")).first().e
    assert {"Jane Doe", "Ada Byron King"} <= set(row.persons) and "The Machine Vision" in row.labs + ["The Machine Vision"] and "Deep Learning" in row.topics and row.organizations == ["Physics And The Lab Of"]
    assert value(spark, entities.url_departments(F.col("u"), F.col("t")), u="https://cds.x.edu/mbu/news/", t="Department of Computational Sciences") == ["CDS", "CS", "MBU"]
    spans = value(spark, entities.nlp_spans(F.col("t")), t="NLP in the Vision Lab, CS 101, nlp")
    assert [(s.text, s.label, s.start) for s in spans] == [("nlp", "RESEARCH_TOPIC", 0), ("Vision Lab", "LAB_NAME", 11), ("CS 101", "COURSE_CODE", 23)]
    assert value(spark, entities.entity_summary(entities.nlp_spans(F.col("t"))), t="NLP in the Vision Lab").total == 2


def test_graph(spark):
    m = spark.createDataFrame([(1, "Vision", "Lab", 1), (2, "Vision", "Lab", 2), (2, "Ada", "Person", 5), (3, "Ada", "Person", 1)], "page_id int, entity_name string, entity_type string, count bigint")
    p = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t2"), (3, "u3", "t3")], "page_id int, url string, title string")
    known = spark.createDataFrame([("Vision", "Lab", None), ("Ada", "Person", "Countess")], "entity_name string, entity_type string, alias string")
    q = spark.createDataFrame([(1, " VISION ", ["vis"]), (2, "countess", []), (3, "x", ["vis", "pers"]), (4, "y", ["none"])], "query_id int, query string, search_keywords array<string>")
    got = [(r.query_id, r.entity_name, r.score, r["rank"]) for r in graph.search(q, m, known, p).orderBy("query_id", "rank").collect()]
    assert got == [(1, "Vision", 1.0, 1), (2, "Ada", 1.0, 1), (3, "Ada", 0.06, 1), (3, "Vision", 0.03, 2)]
    e = {r.entity_name: r for r in graph.entity_statistics(m, p).collect()}
    assert [(s.url, s.title) for s in e["Ada"].samples] == [("u2", "t2"), ("u3", "t3")] and e["Vision"].total_mentions == 3
    pagerows = spark.createDataFrame([("p1", {"PERSON": ["A"], "LAB_NAME": ["L"], "RESEARCH_TOPIC": ["T"]}), ("p2", {"LAB_NAME": ["L"]}), ("p3", {})], "page_id string, entities map<string,array<string>>")
    assert graph.page_entity_edges(pagerows).count() == 4 and graph.page_entity_edges(pagerows, chained=True).count() == 3
    old = spark.createDataFrame([("k", {"a": "1", "b": "2"})], "key string, props map<string,string>")
    new = spark.createDataFrame([("k", {"b": "3"}), ("l", {"c": "4"})], "key string, props map<string,string>")
    assert {r.key: r.props for r in graph.merge_properties(old, new, ["key"]).collect()} == {"k": {"a": "1", "b": "3"}, "l": {"c": "4"}}
    assert graph.unique_violations(old.unionByName(old), ["key"]).count() == 1


# --- vectors and ranking


def test_nearest_in_rounds(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist(), str(i % 3)) for i, v in enumerate(x)], "doc_id bigint, embedding array<double>, kind string").repartition(7)
    q = spark.createDataFrame([(i, x[i].tolist(), [str(i % 2)]) for i in range(25)], "query_id bigint, query_vector array<double>, kinds array<string>")
    monkeypatch.setattr(vector, "QUERIES_AT_ONCE", 10)
    for match in (None, ("kinds", "kind")):
        got = {}
        for r in vector.nearest(q, df, 5, match=match).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
        for i in range(25):
            d = np.round(((x - x[i]) ** 2).sum(1), 6)
            ok = [j for j in range(300) if match is None or j % 3 == i % 2]
            want = sorted(ok, key=lambda j: (d[j], j))[:5]
            assert [j for _, j in sorted(got[i])] == want
    assert vector.nearest(q.limit(0), df, 5).count() == 0


def test_hashed_embeddings_agree(spark):
    df = spark.createDataFrame([(1, "a b a C über"), (2, "x"), (3, "")], "id int, t string")
    a = {r.id: r.embedding for r in vector.embed(df, "t").collect()}
    b = {r.id: r.embedding for r in vector.embed_words(df, ["id"], "t").collect()}
    for k in (1, 2):
        assert np.allclose(a[k], b[k]) and math.isclose(np.linalg.norm(a[k]), 1)
    assert a[3] == [0.0] * 64


def test_rrf(spark):
    hits = spark.createDataFrame([(1, "dense", 1, "d", "p1"), (1, "lexical", 2, "d", "p2"), (1, "graph", 1, "knowledge_graph", "g"), (1, "graph", 2, "knowledge_graph", "g"), (1, "graph", 3, "knowledge_graph", "g")], "query_id int, strategy string, rank int, doc_key string, text string")
    got = {r.doc_key: r for r in fuse.reciprocal_rank(hits, payload=["text"]).collect()}
    assert math.isclose(got["d"].rrf_score, 1 / 61 + 1 / 62) and got["d"].text == "p1" and got["d"].matched_strategies == ["dense", "lexical"]
    g = got["knowledge_graph"]
    assert math.isclose(g.rrf_score, 1 / 61 + 1 / 62 + 1 / 63) and (g.num_strategies, g.n_distinct_strategies, g.fused_rank) == (3, 1, 1)


def test_stage5_is_greedy(spark):
    rows = [(1, 1, "s1", "a long title one", 3.0), (1, 2, "s2", "a long title one", 2.0), (1, 3, "s2", "a long title two", 1.5), (1, 4, "s3", "short", 1.4), (1, 5, "s4", "short", 1.3), (1, 6, "http://x/form/", "t", 1.2), (1, 7, "", "t", 1.2), (1, 8, "s5", "t", 1e-9)]
    df = spark.createDataFrame([(q, r, s, t, "text", x) for q, r, s, t, x in rows], "query_id int, rank int, source string, title string, text string, stage4_score double")
    assert [r.source for r in rerank.stage5(df).orderBy("rank").collect()] == ["s1", "s2", "s3", "s4"]


def test_diverse_selection():
    x = np.array([[1, 0], [1, 0.01], [0, 1], [0.7, 0.7]])
    assert rerank.select_diverse(np.array([1.0, 0.99, 0.9, 0.1]), x, 3)[:2] == [0, 2]
    assert rerank.select_diverse(np.ones(4), x, 4)[0] == 0


def test_rerank_and_context(spark):
    n = 120
    rows = [(1, "list all faculty", i, f"http://h{i % 9}.example.com/faculty/{i}", "faculty" if i % 2 else "general", f"Title number {i}", f"h{i % 9}.example.com", "all faculty " + " ".join(f"w{j}" for j in range(i % 60)), 1.0 / i, [float(i % 7), 1.0]) for i in range(1, n)]
    df = spark.createDataFrame(rows, "query_id int, query string, rank int, source string, page_type string, title string, domain string, text string, score double, embedding array<double>")
    df = df.withColumns({"is_faculty_query": F.lit(True), "is_list_query": F.lit(True), "departments": F.array().cast("array<string>"), "matches_dept": F.lit(False), "num_strategies": F.lit(2), "rrf_score": F.lit(0.015), "intelligence_boost": F.lit(1.2)})
    out = rerank.rerank(df, 50, scorer=rerank.token_overlap).orderBy("rank").collect()
    assert 0 < len(out) <= 50 and [r["rank"] for r in out] == list(range(1, len(out) + 1))
    best = rerank.rerank(df, 10)
    assert context.enhanced_context(best).first().context.startswith("[Source 1 - ") and context.sources(best, 3).count() == 3
    text_ = context.generation_context(best.withColumn("rank", F.col("rank").cast("int")), budget=30).first().context
    assert text_.startswith("[Document 1 - ")
    made = context.prompt(F.lit("q"), F.lit(True), F.lit("h"), F.lit("c"))
    assert value(spark, made, x=1).max_tokens == 4000
    assert value(spark, context.extractive_answer(F.col("x")), x="").startswith("No relevant")


def test_adaptive(spark):
    rows = [(1, i, f"s{i}", 0.1 * i) for i in range(1, 60)] + [(2, 1, "s", 0.0)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, source string, score double").withColumn("boost_url_patterns", F.array().cast("array<string>"))
    got = {r.query_id: r.confidence for r in adaptive.confidence(hits).collect()}
    assert math.isclose(got[1], 0.5 + 0.02 + 0.2) and math.isclose(got[2], 0.5)
    assert {r.query_id: r.k for r in adaptive.adaptive(hits).collect()} == {1: 35, 2: 35}
    v = adaptive.variations(spark.createDataFrame([(1, "a")], "query_id int, query string"), multi=lambda c: F.array(F.concat(c, F.lit("1")), c, F.concat(c, F.lit("2"))))
    assert [r.text for r in v.orderBy("variation").collect()] == ["a", "a1", "a2"]
    b = value(spark, fuse.dynamic_boost(F.col("u"), F.array(F.lit("/faculty/")), F.array(F.lit("CDS")), Profile()), u="http://cds.example.com/faculty/")
    assert math.isclose(b, 2 * 3 * 1.8 * 1.5)


# --- chat


def test_chat(spark):
    now = F.lit("2024-05-05 12:00:00").cast("timestamp")
    t = chat.new_threads(spark.createDataFrame([("q" * 60,), ("short",)], "question string"), now)
    got = {r.title: r for r in t.collect()}
    assert set(got) == {"q" * 50 + "...", "short"}
    tid = got["short"].thread_id
    empty = spark.createDataFrame([], "message_id string, thread_id string, role string, content string, context_used int, created_at timestamp")
    new = spark.createDataFrame([("m1", tid, "user", "Hello 100%", 0), ("m2", tid, "assistant", "x", 2)], "message_id string, thread_id string, role string, content string, context_used int").withColumn("created_at", now + F.expr("INTERVAL 1 DAY"))
    t, m = chat.add_messages(t, empty, new)
    assert {r.thread_id: r.message_count for r in t.collect()}[tid] == 2
    assert [r.thread_id for r in chat.search_threads(t, m, "HELLO").collect()] == [tid] and chat.search_threads(t, m, "zzz").count() == 0
    t = chat.archive(t, tid, now)
    assert [r.thread_id for r in chat.purgeable(t, now + F.expr("INTERVAL 31 DAYS")).collect()] == [tid] and chat.purgeable(t, now).count() == 0
    left = chat.delete(t, m, m.select("message_id"), t.where(F.col("thread_id") == tid).select("thread_id"))
    assert [x.count() for x in left] == [1, 0, 0]
    label = lambda s: value(spark, chat.time_label(F.lit("2024-05-05 12:00:00").cast("timestamp") - F.expr(f"INTERVAL {s} SECONDS"), now), x=1)
    assert [label(s) for s in (5, 300, 7200, 90000, 4 * 86400, 30 * 86400)] == ["Just now", "5m ago", "2h ago", "Yesterday", "4d ago", "Apr 5"]


# --- sources and flows


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"page_id": "1", "url": "u1"}\nnot json\n{"url": "u2"}\n')
    df = files.read_jsonl(spark, str(p))
    assert df.count() == 2 and files.line_count(spark, str(p)) == 3 and files.read_jsonl(spark, str(p), keep_bad=True).cache().where("_bad IS NOT NULL").first()._bad == "not json"
    assert {r.url for r in files.unprocessed(df, df.where("page_id = '1'")).collect()} == {"u2"}
    files.export_pages(df.withColumn("raw_html", F.lit("x")), str(tmp_path / "out"))
    assert "raw_html" not in spark.read.json(str(tmp_path / "out")).columns
    (tmp_path / "b.jsonl").write_text("{}")
    import os

    os.utime(tmp_path / "b.jsonl", (4e9, 4e9))
    assert files.latest_file(spark, str(tmp_path / "*.jsonl")).endswith("b.jsonl")
    s = files.Settings({"a": {"b": 1}}, {"a.c": 2})
    assert (s.get("a", "b"), s.get("a", "c"), s.get("a", "x", default=5)) == (1, 2, 5)
    files.write_csv(df.select("url"), str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "url string").count() == 2


def test_ingest_store_and_ask(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/pages.parquet").drop("page_id").limit(30)
    made = retrieval.ingest(raw, path=str(tmp_path / "t"))
    assert made["pages"].count() + made["dropped"].count() == 30
    chunk = made["chunks"].withColumn("embedding", F.col("embedding").cast("array<float>"))
    store = stores.VectorStore(spark, str(tmp_path / "store"))
    store.add(chunk)
    store.add(chunk.limit(3))
    n = store.rows().count()
    assert n == chunk.count() and store.stats().first().dimension == 64
    first = store.rows().first()
    hits = store.query(spark.createDataFrame([(1, list(map(float, first.embedding)))], "query_id int, query_vector array<double>"), 3, {"domain": {"$in": [first.domain]}})
    assert hits.where("rank = 1").first().domain == first.domain and store.by_metadata({"domain": first.domain}).count() > 0
    store.delete_page(first.page_id)
    assert store.rows().count() < n
    store.reembed()
    corpus = store.rows().withColumns({"doc_id": F.xxhash64("chunk_key"), "source": F.col("url")}).persist()
    known = made["mentions"].select("entity_name", "entity_type").distinct().withColumn("alias", F.lit(None).cast("string"))
    q = spark.createDataFrame([(1, "list all faculty labs"), (2, "the erth")], "query_id int, query string")
    history = spark.createDataFrame([(2, 4, "what before")], "query_id int, history_size int, last_question string")
    out = {r.query_id: r for r in retrieval.ask(q, corpus, made["mentions"], known, history, k=5).collect()}
    assert set(out) == {1, 2} and all(o.answer for o in out.values()) and out[2]["query"].startswith("previous question was")
    store.reset()
    assert store.rows().count() == 0


def test_templates(spark):
    df = spark.createDataFrame([(1, "physics"), (2, None)], "query_id int, name string")
    q, f = retrieval.templated(df, "faculty_list")
    assert [r["query"] for r in q.orderBy("query_id").collect()] == ["List all faculty members in the physics department", "List all faculty members"] and f is None
    assert retrieval.templated(df, "courses")[1] == {"page_type": "course"}
