"""Ledgers and the stores on them: replays, crashes, conflicts, compaction, and bytes in proportion to what is added."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.sources import ledger, stores

SCHEMA = "k string, n bigint"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def read(book):
    return Counter((r.k, r.n, r._seq) for r in book.read("t", SCHEMA).collect())


def test_ledger_adds_replays_and_replaces(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    assert read(book) == Counter() and book.state() == (0, {}, {})
    assert book.add({"t": (rows(spark, ("a", 1)), SCHEMA)}, ("s", 0))
    assert book.add({"t": (rows(spark, ("a", 2), ("b", 2)), SCHEMA), "u": (rows(spark, ("x", 9)), SCHEMA)}, ("s", 1))
    assert not book.add({"t": (rows(spark, ("c", 3)), SCHEMA)}, ("s", 1)) and not book.add({"t": (rows(spark, ("c", 3)), SCHEMA)}, ("s", 0))
    want = Counter([("a", 1, 1), ("a", 2, 2), ("b", 2, 2)])
    assert read(book) == want and read(ledger.Ledger(spark, str(tmp_path / "l"))) == want
    assert [(r.k, r.n) for r in book.read("t", SCHEMA, at=1).collect()] == [("a", 1)]
    # Another table stays when one is replaced; sources are remembered, and earlier states readable until the vacuum.
    book.replace({"t": (rows(spark, ("z", 0)), SCHEMA)})
    assert read(book) == Counter([("z", 0, 3)]) and book.read("u", SCHEMA).count() == 1 and book.seen("s", 1) and not book.seen("s", 2)
    assert book.read("t", SCHEMA, at=2).count() == 3 and book.vacuum() == 2 and read(book) == Counter([("z", 0, 3)])


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    book.add({"t": (rows(spark, ("a", 1)), SCHEMA)})
    before = read(book)
    bad = F.udf(lambda k: 1 // 0, "bigint")
    with pytest.raises(Exception, match="division"):
        book.add({"t": (rows(spark, ("b", 1)), SCHEMA), "u": (rows(spark, ("x", 1)).select("k", bad("k").alias("n")), SCHEMA)})
    assert read(book) == before  # the first table was written, nothing committed
    monkeypatch.setattr(book, "_put", lambda number, said: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        book.add({"t": (rows(spark, ("b", 1)), SCHEMA)})
    monkeypatch.undo()
    assert read(book) == before
    # A commit file that its writer left empty takes a number and says nothing.
    book._fs.create(book._at(f"commits/{2:012d}"), False).close()
    assert read(book) == before and book.add({"t": (rows(spark, ("c", 1)), SCHEMA)}) and read(book) == before + Counter([("c", 1, 3)])
    assert book.vacuum() == 2


def test_conflicts(spark, tmp_path, monkeypatch):
    a, b = (ledger.Ledger(spark, str(tmp_path / "l")) for _ in range(2))
    a.add({"t": (rows(spark, ("a", 1)), SCHEMA)})
    base = a.state()[0]
    b.add({"t": (rows(spark, ("b", 1)), SCHEMA)})
    with pytest.raises(ledger.Conflict):
        a.replace({"t": (rows(spark, ("z", 0)), SCHEMA)}, base)
    # Two adds that see the same last number: the second takes the next one.
    seen = a._numbers()
    calls = iter([seen[:-1]])
    real = a._numbers
    monkeypatch.setattr(a, "_numbers", lambda: next(calls, None) or real())
    assert a.add({"t": (rows(spark, ("c", 1)), SCHEMA)}) and a.state()[0] == 3
    assert {k for k, _, _ in read(b)} == {"a", "b", "c"}


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def chunks(spark, ids, text="t"):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("i")).select(
        F.format_string("p%d_0", "i").alias("chunk_key"), F.format_string("p%d", "i").alias("page_id"), F.lit(0).alias("chunk_id"), F.lit(text).alias("text"), F.lit(1).alias("word_count"), F.lit(0).alias("start_word"), F.lit(1).alias("end_word"),
        F.lit("u").alias("url"), F.lit("d").alias("domain"), F.lit("x").alias("page_type"), F.lit("t").alias("title"), F.array([F.sin(F.col("i") * 7 + j).cast("float") for j in range(8)]).alias("embedding"))


def test_vector_store_by_increments(spark, tmp_path):
    path = str(tmp_path / "v")
    store = stores.VectorStore(spark, path)
    store.add(chunks(spark, range(3000)).repartition(2))
    large = size_of(path)
    store.add(chunks(spark, [5], "new").coalesce(1))
    assert size_of(path) - large < large / 10  # one row writes one row
    assert store.rows().count() == 3000 and store.rows().where("page_id = 'p5'").first().text == "new"
    assert store.rows(1).where("page_id = 'p5'").first().text == "t"
    assert store.add(chunks(spark, [6], "once"), ("job", 1)) and not store.add(chunks(spark, [6], "twice"), ("job", 1))
    store.delete_page("p7")
    got = {r.page_id: r.text for r in store.rows().collect()}
    assert len(got) == 2999 and "p7" not in got and got["p6"] == "once"
    q = chunks(spark, [5, 9]).select(F.regexp_extract("page_id", r"\d+", 0).cast("int").alias("query_id"), F.col("embedding").alias("query_vector"))
    key = lambda d: {(r.query_id, r["rank"]): (r.chunk_key, r.text, round(r.score, 6)) for r in d.collect()}
    exact = key(store.query(q, 3))
    assert exact[5, 1][:2] == ("p5_0", "new") and exact[9, 1][0] == "p9_0"
    assert key(store.query(q, 3, probes=1000)) == exact  # through the index, all cells
    store.compact()
    assert store.ledger.batches("chunks") == 1 and {r.page_id: r.text for r in store.rows().collect()} == got and key(store.query(q, 3, probes=1000)) == exact
    store.add(chunks(spark, [7], "back"))
    assert store.rows().where("page_id = 'p7'").first().text == "back"
    store.reset()
    assert store.rows().count() == 0


def test_graph_store_by_increments(spark, tmp_path):
    store = stores.GraphStore(spark, str(tmp_path / "g"))
    node = lambda *r: spark.createDataFrame(list(r), stores.graph.NODES)
    edge = lambda *r: spark.createDataFrame(list(r), stores.graph.EDGES)
    store.add_nodes(node(("Lab", "k", "old", "t", "al", {"a": "1", "b": "1"}), ("Lab", "m", "m", "t", None, None)))
    store.add_edges(edge(("Lab", "k", "HAS", "Lab", "m", 2, {"since": "1"})))
    assert store.add(node(("Lab", "k", "new", "t", None, {"b": "2", "c": "3"})), edge(("Lab", "k", "HAS", "Lab", "m", 3, {"to": "2"}), ("Lab", "m", "HAS", "Lab", "k", 1, None)), ("s", 4))
    assert not store.add(node(("Lab", "k", "never", "t", None, {})), None, ("s", 4))
    for _ in range(2):
        nodes = {(r.label, r.key): (r.name, r.alias, r.props) for r in store.nodes().collect()}
        assert nodes == {("Lab", "k"): ("new", None, {"a": "1", "b": "2", "c": "3"}), ("Lab", "m"): ("m", None, {})}
        edges = {(r.src_key, r.dst_key): (r["count"], r.props) for r in store.edges().collect()}
        assert edges == {("k", "m"): (5, {"since": "1", "to": "2"}), ("m", "k"): (1, {})}
        store.compact()
    store.clear()
    assert store.nodes().count() == store.edges().count() == 0


def test_chat_store_in_one_commit(spark, tmp_path):
    store = stores.ChatStore(spark, str(tmp_path / "c"))
    now = F.lit("2024-05-05 12:00:00").cast("timestamp")
    made = store.create(spark.createDataFrame([("what is a lab",), ("other",)], "question string"), now).orderBy("title").collect()
    tid = made[1].thread_id
    said = spark.createDataFrame([("m1", tid, "user", "a", 0), ("m2", tid, "assistant", "b", 1), ("m3", "nowhere", "user", "c", 0)], "message_id string, thread_id string, role string, content string, context_used int").withColumn("created_at", now + F.expr("INTERVAL 1 DAY"))
    used = spark.createDataFrame([("m2", "x" * 2000, "u1", 0.5), ("m2", "y", "u2", 0.25)], "message_id string, chunk_text string, source string, score double")
    before = store.ledger.state()[0]
    store.add(said, used)
    assert store.ledger.state()[0] == before + 1
    for _ in range(2):
        threads = {r.thread_id: r for r in store.threads().collect()}
        assert set(threads) == {m.thread_id for m in made} and threads[tid].message_count == 2 and threads[tid].title == "what is a lab" and str(threads[tid].updated_at) == "2024-05-06 12:00:00"
        assert [(r.chunk_url, len(r.chunk_text), r.relevance_score, str(r.created_at)) for r in store.contexts().orderBy("chunk_url").collect()] == [("u1", 1000, 0.5, "2024-05-06 12:00:00"), ("u2", 1, 0.25, "2024-05-06 12:00:00")]
        store.compact()
    store.archive(tid, now + F.expr("INTERVAL 2 DAYS"))
    assert {r.thread_id: r.status for r in store.threads().collect()}[tid] == "archived"
    assert store.purge(now + F.expr("INTERVAL 31 DAYS")) == 0 and store.purge(now + F.expr("INTERVAL 40 DAYS")) == 1
    assert store.threads().count() == 1 and store.contexts().count() == 0 and [r.message_id for r in store.messages().collect()] == ["m3"]


def test_knowledge_base_in_parts(spark, tmp_path):
    base = stores.KnowledgeBase(spark, str(tmp_path / "k"))
    pages = spark.createDataFrame([(f"p{i}", f"u{i}", "t", "d", "x", "text", 1, 0.5, 200, 10) for i in range(50)], stores.PAGE_ROWS)
    mentions = spark.createDataFrame([(f"p{i}", f"e{i % 3}", "Lab", i) for i in range(50)], "page_id string, entity_name string, entity_type string, count bigint")
    n = base.load_in_parts(pages, chunks(spark, range(50)), mentions, "nightly", flush=20)
    assert n == 3 and base.load_in_parts(pages, chunks(spark, range(50)), mentions, "nightly", flush=20) == 0
    assert base.pages().count() == 50 and base.vectors.rows().count() == 50 and base.graph.edges().agg(F.sum("count")).first()[0] == sum(range(50))
    assert Counter(r.label for r in base.graph.nodes().collect()) == {"Page": 50, "Lab": 3}
