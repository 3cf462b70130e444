"""The vector index, postings, dictionary, keywords and adaptive rounds against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import adaptive, analyze, dictionary, postings, statistical_keywords, vector
from tessella.operators.vector_index import VectorIndex

# --- vector index


def clustered(n=6000, dim=32, centers=120, seed=5):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centers, dim))
    x = c[rnd.integers(0, centers, n)] + 0.35 * rnd.normal(size=(n, dim))
    return [(i, v.tolist(), "k") for i, v in enumerate(x)]


ROWS = "doc_id bigint, embedding array<double>, label string"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = clustered()
    rows += [(10_000 + i, rows[3][1], "same") for i in range(2000)]  # a third of another row's copies
    rows += [(20_000, None, "k"), (20_001, [1.0], "k"), (20_002, [float("nan")] * 32, "k")]
    df = spark.createDataFrame(rows, ROWS).repartition(6).cache()
    path = str(tmp_path_factory.mktemp("index"))
    return df, VectorIndex.build(df, path, cells=100), path


def asked(df):
    return df.where("doc_id % 60 = 7 AND size(embedding) = 32").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def test_index_recall_and_share(spark, indexed):
    """At least 0.95 of the true ten nearest, with a tenth of the rows; only probed cells are in the scan."""
    df, index, path = indexed
    good = df.where("size(embedding) = 32 AND NOT isnan(embedding[0])")
    truth, got = defaultdict(set), defaultdict(set)
    for r in vector.nearest(asked(df), good, 10).collect():
        truth[r.query_id].add(r.doc_id)
    found = index.search(asked(df), 10, probes=6)
    for r in found.collect():
        got[r.query_id].add(r.doc_id)
    assert np.mean([len(truth[q] & got[q]) / len(truth[q]) for q in truth]) >= 0.95
    plain = asked(df).where("query_id < 10000")
    one = plain.limit(1)
    assert index.share_read(plain.where("query_id > 100"), 6) < 0.35
    plan = index.search(one, 10, probes=6)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    files = {re.search(r"cell=(\d+)", f).group(1) for f in index.rows().where(F.col("cell").isin(1, 2)).inputFiles()}
    assert files  # the table is one folder a cell
    assert VectorIndex(spark, path).search(one, 10, probes=6).count() == 10


def test_index_exact_search_equals_scan(spark, indexed):
    df, index, _ = indexed
    good = df.where("size(embedding) = 32 AND NOT isnan(embedding[0])")
    key = lambda d: sorted((r.query_id, r.rank, r.doc_id, round(r.distance, 5)) for r in d.collect())
    assert key(index.search_exact(asked(df), 7, probes=2)) == key(vector.nearest(asked(df), good, 7))


def test_index_takes_new_rows(spark, tmp_path):
    rows = clustered(500)
    df = spark.createDataFrame([(f"k{i}", v, y) for i, v, y in rows], "key string, v array<float>, label string")
    index = VectorIndex.build(df.limit(400), str(tmp_path / "i"), cells=9, doc_id="key", vector="v")
    before = {f for f in index.rows().inputFiles()}
    left = df.join(index.rows().select("key"), "key", "left_anti")
    index.add(left)
    assert before <= set(index.rows().inputFiles()) and index.rows().count() == 500
    q = df.select(F.xxhash64("key").alias("query_id"), F.col("v").alias("query_vector"), "key")
    first = index.search(q, 1, probes=3).where("rank = 1").join(q.select("query_id", "key"), "query_id")
    assert first.where("doc_id = key").count() == 500
    empty = VectorIndex.build(df.limit(0), str(tmp_path / "e"), doc_id="key", vector="v")
    assert empty.search(q, 3).count() == 0 and empty.search_exact(q, 3).count() == 0


def test_nearest_in_blocks_and_with_string_ids(spark, monkeypatch):
    rows = clustered(300, 8, 10)
    df = spark.createDataFrame([(f"k{i:04d}", v, y) for i, v, y in rows] + [("k0001", rows[5][1], "k")], "doc_id string, embedding array<double>, label string").repartition(3)
    numbered = spark.createDataFrame(rows + [(1, rows[5][1], "k")], ROWS)
    q = asked(spark.createDataFrame(rows, ROWS).where("doc_id < 0")).unionByName(numbered.where("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector")))
    want = sorted((r.query_id, r.rank, f"k{r.doc_id:04d}", r.distance) for r in vector.nearest(q, numbered, 5).collect())
    monkeypatch.setattr(vector, "QUERIES_AT_ONCE", 10)
    assert sorted((r.query_id, r.rank, r.doc_id, r.distance) for r in vector.nearest(q, df, 5).collect()) == want


# --- postings


@pytest.mark.parametrize(("tokens", "terms"), [(2_000_000, 200_000), (300, 5)])
def test_postings_equal_bm25(spark, tmp_path, monkeypatch, tokens, terms):
    monkeypatch.setattr(postings, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(postings, "TERMS_AT_ONCE", terms)
    monkeypatch.setattr(postings, "BLOCK", 4)
    rnd = random.Random(3)
    rare = [f"w{i}" for i in range(200)]
    texts = [" ".join(rnd.choices(["the", "a", "und"], k=rnd.randint(0, 60)) + rnd.choices(rare, k=rnd.randint(0, 30))) for _ in range(400)] + ["", None, "The THE the", "ünïcode Wörter w1"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1000, texts[0])], "doc_id bigint, text string").repartition(4)
    asked = [(q, rnd.sample(rare, 3) + ["the"] + (["nowhere"] if q % 3 == 0 else []) + (["a", "und"] if q % 2 else [])) for q in range(25)] + [(50, []), (51, ["the"]), (52, ["absent"]), (53, ["wörter", "wörter"])]
    queries = spark.createDataFrame(asked, "query_id bigint, terms array<string>")
    index = postings.build(docs, str(tmp_path / "p"))
    key = lambda d: {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in d.collect()}
    got, want = key(index.search(queries, 10)), key(vector.bm25(queries, docs, 10))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=2e-6)
    assert postings.PostingsIndex(spark, str(tmp_path / "p")).postings().where("term = 'the'").agg(F.sum(F.size("docs"))).first()[0] > 300


def test_frequent_terms_are_only_looked_up():
    """With a rare and a frequent term, the frequent one's weights are worked out for the candidates alone."""
    n = 20_000
    frequent = postings._List(np.arange(n), np.ones(n, int), np.full(n, 50), np.ones(n // 128 + 1, int), np.full(n // 128 + 1, 50), 0.01, 1.2, 0.75, 50.0)
    rare = postings._List(np.arange(0, n, 500), np.full(40, 3), np.full(40, 50), np.array([3]), np.array([50]), 5.0, 1.2, 0.75, 50.0)
    docs, score = postings.best([frequent, rare], 10, 6)
    assert frequent._weights is None and docs.tolist() == list(range(0, 5000, 500)) and len(set(score)) == 1
    assert score[0] == pytest.approx(rare.weights[0] + 0.01, abs=1e-6)


# --- dictionary


@pytest.mark.parametrize("chars", [4_000_000, 30])
def test_names_in_texts(spark, monkeypatch, chars):
    monkeypatch.setattr(dictionary, "BLOCK_CHARS", chars)
    names = ["the lab", "lab", "Vision Lab", "c++", "Ökologie", "", None, "a", "lab", "x_y"]
    texts = [(1, "The lab of the vision lab; labs, C++ and c++."), (2, None), (3, ""), (4, "ÖKOLOGIE ökologien a-b x_y x_yz c++x"), (5, "lab lab lab")]
    df = spark.createDataFrame([(*t, "n") for t in texts], "doc_id bigint, text string, name string")
    got = {(r.doc_id, r.name): (r["count"], r["first"]) for r in dictionary.occurrences(df, spark.createDataFrame([(n, 1) for n in names], "name string, doc_id int"), ["doc_id"]).collect()}
    want = {}
    for d, t in texts:
        for n in {n.lower() for n in names if n}:
            edge = lambda c, s: s if re.match(r"\w", c) else ""
            at = [m.start() for m in re.finditer("(?=" + edge(n[0], r"(?<!\w)") + re.escape(n) + edge(n[-1], r"(?!\w)") + ")", (t or "").lower())]
            if at:
                want[d, n] = (len(at), at[0])
    assert got == want
    known = spark.createDataFrame([("Vision Lab", "Lab", "lab"), ("Cpp", "Topic", "c++"), ("Cpp", "Person", None)], "entity_name string, entity_type string, alias string")
    found = {(r.page_id, r.entity_name, r.entity_type): r["count"] for r in dictionary.name_mentions(df.withColumnRenamed("doc_id", "page_id"), known).collect()}
    assert found == {(1, "Vision Lab", "Lab"): 3, (1, "Cpp", "Topic"): 2, (4, "Cpp", "Topic"): 1, (5, "Vision Lab", "Lab"): 3}


def test_terms_inside_texts(spark):
    terms = spark.createDataFrame([("ab",), ("b",), ("",), (None,), ("zz",), ("ab",)], "term string")
    texts = spark.createDataFrame([("xABy", "q"), ("a", "b"), ("a", "b"), (None, "zz"), ("", "")], "entity_name string, entity_type string")
    got = Counter(tuple(r) for r in dictionary.containing(terms, texts, ["entity_name", "entity_type"]).collect())
    assert got == Counter([("ab", "xABy", "q"), ("b", "xABy", "q"), ("b", "a", "b"), ("zz", None, "zz")])


# --- keywords from statistics


def plain_keywords(text, stop):
    """The same definitions, straight from the formulas."""
    sentences = [s for s in re.split(r"[.!?]+", text) if re.search(r"\w", s)]
    tokens = []  # sentence, run, term, kind
    for si, s in enumerate(sentences):
        first = True
        for ri, part in enumerate(re.split(r"[^\w\s'-]+", s)):
            for w in (x.strip("'-") for x in re.findall(r"[\w'-]+", part)):
                if w:
                    kind = "x" if not re.sub("['-]", "", w).isalpha() else "a" if w.isupper() and len(w) > 1 else "n" if w[0].isupper() and not first else "p"
                    tokens.append((si, (si, ri), w.lower(), kind))
                    first = False
    near = [(a[2], b[2]) for a, b in zip(tokens, tokens[1:], strict=False) if a[1] == b[1] and "x" not in (a[3], b[3])]
    count = Counter(t[2] for t in tokens)
    terms = [t for t in count if t not in stop and len(t) >= 3 and not any(x[2] == t and x[3] == "x" for x in tokens)]
    if not terms:
        return []
    tf = [count[t] for t in terms]
    mean = sum(tf) / len(tf)
    usual = mean + math.sqrt(sum((x - mean) ** 2 for x in tf) / len(tf))
    s = {}
    for t in terms:
        own = [x for x in tokens if x[2] == t]
        left, right = [a for a, b in near if b == t], [b for a, b in near if a == t]
        case = max(sum(x[3] == "a" for x in own), sum(x[3] == "n" for x in own)) / (1 + math.log(count[t]))
        rel = 1 + (sum(len(set(v)) / len(v) for v in (left, right) if v)) * count[t] / max(count.values())
        s[t] = rel * math.log(math.log(3 + float(np.median([x[0] for x in own])))) / (case + (count[t] / usual + len({x[0] for x in own}) / len(sentences)) / rel)
    grams = Counter(tuple(x[2] for x in tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1) if len({x[1] for x in tokens[i : i + n]}) == 1 and all(x[3] != "x" for x in tokens[i : i + n]) and tokens[i][2] in s and tokens[i + n - 1][2] in s)
    score = {}
    for g, n in grams.items():
        prod, total = 1.0, 0.0
        for i, t in enumerate(g):
            if t in s:
                prod, total = prod * s[t], total + s[t]
            else:
                p = near.count((g[i - 1], t)) / sum(a == g[i - 1] for a, _ in near) * near.count((t, g[i + 1])) / sum(b == g[i + 1] for _, b in near)
                prod, total = prod * (2 - p), total - (1 - p)
        score[" ".join(g)] = prod / (n * (1 + total))
    out = []
    for w, k in sorted((round(w, 9), k) for k, w in score.items()):
        if len(out) < 10 and all(SequenceMatcher(None, k, o, autojunk=False).ratio() <= 0.9 for o, _ in out):
            out.append((k, w))
    return out


def test_statistical_keywords(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    texts += ["Deep Learning in the Vision Lab. The Vision Lab of NASA studies deep learning, and the learning of deep networks! Networks? Vision 3D.", "", None, "the and of", "one", "x1 22 3.4", "Word " * 300, "a-b 'quoted' don't -- stop. Don't!"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, keyword string").repartition(3)
    got = defaultdict(list)
    for r in sorted(statistical_keywords.keywords(df).collect(), key=lambda r: (r.doc_id, r["rank"])):
        got[r.doc_id].append((r.keyword, r.score))
    stop = set(statistical_keywords.STOP_WORDS)
    for i, t in enumerate(texts):
        want = plain_keywords(t or "", stop)
        assert [k for k, _ in got[i]] == [k for k, _ in want], t
        assert [w for _, w in got[i]] == pytest.approx([w for _, w in want], abs=2e-9)
    assert "vision lab" in [k for k, _ in got[60]]
    assert statistical_keywords.keywords(df.limit(0)).count() == 0


# --- adaptive rounds


def test_adaptive_rounds(spark):
    """Queries leave when they are good; k grows; a poor round turns to the graph; the best round's hits stay."""
    questions = spark.createDataFrame([(1, "list all faculty"), (2, "weather"), (3, "nothing at all")], "query_id bigint, query string")
    asked = analyze.analyze(questions)
    calls = []

    def search(left, k):
        rows = {r.query_id: r.search_strategy for r in left.select("query_id", "search_strategy").collect()}
        calls.append((k, sorted(rows)))
        hits = []
        for q, s in rows.items():
            if q == 1:
                hits += [(q, f"https://x/faculty/{i}", 0.9 - i / 100, i + 1) for i in range(10)]
            if q == 2:  # one source; better when the graph takes part
                hits += [(q, "u" if k < 75 else f"u{i}", 0.5, i + 1) for i in range(k)]
        return spark.createDataFrame(hits, "query_id bigint, source string, score double, rank int") if hits else spark.createDataFrame([], "query_id bigint, source string, score double, rank int")

    out = adaptive.adaptive_retrieve(asked, search, good=0.71).collect()
    assert calls == [(35, [1, 2, 3]), (55, [2, 3]), (75, [2, 3])]
    by = defaultdict(list)
    for r in out:
        by[r.query_id].append(r)
    assert set(by) == {1, 2}
    assert len(by[1]) == 10 and by[1][0].rounds == 1 and by[1][0].k == 35 and by[1][0].graph_weight == 2.0
    assert len(by[2]) == 75 and by[2][0].k == 75 and by[2][0].rounds == 3 and by[2][0].confidence == pytest.approx(0.7)
    assert not by[2][0].use_entity_aggregation  # 0.6 and 0.7 aren't poor


def test_adaptive_strategy_turns_to_the_graph(spark):
    asked = analyze.analyze(spark.createDataFrame([(3, "nothing at all")], "query_id bigint, query string"))
    seen = []

    def search(left, k):
        s = left.first().search_strategy
        seen.append((k, s.graph_weight, s.use_entity_aggregation))
        hits = [(3, "u", 0.1, 1)] if len(seen) == 3 else []
        return spark.createDataFrame(hits, "query_id bigint, source string, score double, rank int")

    out = adaptive.adaptive_retrieve(asked, search).collect()
    assert seen == [(35, 1.0, False), (55, 1.5, True), (75, 2.25, True)] and len(out) == 1 and out[0].rounds == 3


def test_knowledge_search(spark):
    corpus = spark.createDataFrame([(i, f"https://x/{'faculty' if i % 2 else 'news'}/{i}", f"t{i}", text, "") for i, text in enumerate(["vision lab members", "robotics", "professor of vision", "sports", "staff of the vision lab"])], "doc_id bigint, source string, title string, text string, e string")
    corpus = vector.embed(corpus.drop("e"), "text")
    mentions = spark.createDataFrame([("p1", "Vision Lab", "Lab", 9), ("p2", "Vision Lab", "Lab", 1), ("p1", "Ada Vision", "Person", 4), ("p2", "Bob", "Person", 8)], "page_id string, entity_name string, entity_type string, count bigint")
    pages = spark.createDataFrame([("p1", "https://x/a", "A"), ("p2", "https://x/b", "B")], "page_id string, url string, title string")
    asked = analyze.analyze(spark.createDataFrame([(1, "vision research"), (2, "list all faculty Vision")], "query_id bigint, query string"))
    out = adaptive.adaptive_retrieve(asked, adaptive.knowledge_search(corpus, mentions, pages), first_k=10).collect()
    of = lambda q, kind: [(r.text, r.source, round(r.score, 3)) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q and r.source_type == kind]
    assert of(1, "graph") == [("Entity: Vision Lab (Lab)", "https://x/a", 0.1), ("Entity: Ada Vision (Person)", "https://x/a", 0.04)]
    assert len(of(1, "vector")) == 5
    assert of(2, "graph_entity") == [("Ada Vision (Person) - Mentioned 4 times", "https://x/a", 0.08)]


# --- tf-idf in rounds


@pytest.mark.parametrize(("first", "held", "known"), [(4, 4_000_000, 300_000), (1, 50, 30), (2, 50, 0)])
def test_tfidf_in_rounds_equals_the_plain_form(spark, sf, monkeypatch, first, held, known):
    from tessella.operators import entities, tfidf

    monkeypatch.setattr(tfidf, "FIRST", first)
    monkeypatch.setattr(tfidf, "HELD", held)
    monkeypatch.setattr(tfidf.most_frequent, "__defaults__", (known,))
    rnd = random.Random(9)
    words = [f"w{i:03d}" for i in range(300)]
    texts = [" ".join(rnd.choices(words[:20], k=rnd.randint(0, 80)) + rnd.sample(words, rnd.randint(0, 60))) for _ in range(150)] + ["", None, "the and of", "alpha", "Alpha beta ALPHA beta", "common words here"] + ["common words here and there"] * 40
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, keyword string").repartition(4)
    key = lambda d: {(r.doc_id, r["rank"]): (r.keyword, round(r.score, 6)) for r in d.collect()}
    assert key(tfidf.keywords(docs, 5)) == key(entities.tfidf_keywords(docs, 5))
    assert tfidf.keywords(docs.limit(0), 5).count() == 0
