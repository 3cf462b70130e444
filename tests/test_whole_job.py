"""Registered queries over whole texts, against brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessella.functions.text import STOP_WORDS
from tessella.plans import queries as plans

QUERIES = __spark_entry__.queries()


def rows(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


# --- keywords


def test_keywords_of_whole_texts(spark, sf):
    """Terms, tf and df come from all of each text, also past the 10,000th character."""
    texts = rows(spark, sf, "documents", "doc_id", "text")
    assert any(len(x or "") > 10_000 for _, x in texts)
    tf = {}
    for d, x in texts:
        w = [w for w in re.findall(r"\w+", (x or "").lower()) if len(w) > 2 and w not in STOP_WORDS]
        tf[d] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    df = Counter(k for c in tf.values() for k in c)
    want = {}
    for d, c in tf.items():
        best = sorted(((round(n * math.log((1 + len(texts)) / (1 + df[k])), 6), k) for k, n in c.items()), key=lambda s: (-s[0], s[1]))[:5]
        want |= {(d, rank): s for rank, s in enumerate(best, 1)}
    got = {(r["doc_id"], r["rank"]): (r["score"], r["keyword"]) for r in QUERIES["keywords_tfidf"](spark, sf).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()}, abs=2e-6)


# --- entities


def found(text, patterns, longer_than=3, without=()):
    out = set()
    for p in patterns:
        out |= {m.strip() for m in re.findall(p.replace(r"[\p{L}\p{N}_]", r"\w"), text.lower(), re.ASCII if text.isascii() else 0)}
    return "|".join(sorted(x for x in out if len(x) > longer_than and x not in without))


def test_entities_of_whole_texts(spark, sf, tmp_path):
    """In every language, wherever they stand; the table's own texts hold none of the patterns' words, so some are added."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    said = " The robotics lab works on deep learning. Department of physics. School of design, research in quantum computing!"
    added = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(said))).otherwise(F.col("text"))
    docs.withColumn("text", added).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["entity_patterns"](spark, str(tmp_path)).collect()}
    every = rows(spark, tmp_path, "documents", "doc_id", "text", "lang")
    assert len(got) == len(every) and len({lang for _, _, lang in every}) > 1
    e = plans.entities
    for d, x, _ in every:
        listed = ("(" + "|".join(w.replace(" ", r"\s+") for w in e.TOPICS) + ")",)
        assert got[d].labs == found(x or "", e.LAB_PATTERNS, without=e.NOT_LABS)
        assert got[d].topics == found(x or "", e.TOPIC_PATTERNS + listed)
        assert got[d].organizations == found(x or "", e.ORG_PATTERNS)
        assert d % 3 or "physics" in got[d].organizations.split("|") and "deep learning" in got[d].topics and got[d].labs


def test_entities_of_pages(spark, tmp_path):
    body = "<p>" + "plain words of no lab at all " * 300 + "</p><p>The robotics lab of the department of physics.</p>"
    page = (1, "https://cs.example.com/people/ada-byron/x", f"<html><title>Vision Lab - Dr. Ada Byron</title><body>{body}</body></html>")
    spark.createDataFrame([page], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    r = QUERIES["page_entities"](spark, str(tmp_path)).first()
    assert "Ada Byron" in r.persons and {"Vision", "The Robotics"} & set(r.labs) and any("Physics" in o for o in r.organizations)


# --- questions


def test_questions_are_whole(spark, sf):
    """What hybrid_retrieval and graph_search ask is the whole text of each first turn."""
    turns = rows(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    assert any(len(x or "") > 60 for _, _, _, x in turns)
    got = {r["query_id"]: r["query"] for r in plans._questions(spark, sf).collect()}
    assert got == {c: "list all faculty " + x for c, turn, role, x in turns if role == "user" and turn == 0}


def test_analysis_of_whole_questions(spark, tmp_path):
    """Acronyms, proper nouns, keywords and the intent behind the 30th character."""
    long = "weather in some far away place, " + "then " * 30 + "CDS and the laboratory of Byron with CSA"
    spark.createDataFrame([(6, 0, "user", long)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = QUERIES["query_analysis"](spark, str(tmp_path)).first()
    w = ("weather " + long).split()
    assert "lab_query" in r["intents"] and r["acronyms"] == "CDS,CSA"
    assert r["proper_nouns"] == sum(x[0].isupper() for x in w[1:])
    assert r["keywords"] == sum(len(x) > 2 and x.lower() not in ("the", "and", "for", "are", "with", "this", "that") for x in w)


# --- lexical search


def test_bm25_with_whole_passages(spark, sf):
    """All terms of each passage take part."""
    tokens = lambda x: re.findall(r"\w+", (x or "").lower())
    docs = {d: Counter(tokens(x)) for d, x in rows(spark, sf, "documents", "doc_id", "text")}
    size = {d: sum(c.values()) for d, c in docs.items()}
    mean = sum(size.values()) / len(docs)
    want = {}
    for i, x in rows(spark, sf, "benchmark", "item_id", "text"):
        if i % 100 == 0:
            scores = Counter()
            for term in set(tokens(x)):
                df = sum(term in c for c in docs.values())
                for d, c in docs.items():
                    if term in c:
                        scores[d] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * size[d] / mean))
            best = sorted(((round(v, 6), d) for d, v in scores.items()), key=lambda s: (-s[0], s[1]))[:10]
            want |= {(i, rank): s for rank, s in enumerate(best, 1)}
    got = {(r["query_id"], r["rank"]): (r["score"], r["doc_id"]) for r in QUERIES["bm25"](spark, sf).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()}, abs=2e-6)
