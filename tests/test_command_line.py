"""The command line from raw pages to a conversation; names that clash; the crawl's relevance gate."""

import json

import pytest
from pyspark.sql import functions as F

from tessella import __main__ as cli
from tessella.operators import entities, pages
from tessella.sources import files, stores


def test_from_pages_to_answers(spark, sf, tmp_path, capsys, monkeypatch):
    raw = spark.read.parquet(f"{sf}/pages.parquet").drop("page_id").limit(24)
    raw = raw.withColumn("html", F.replace("html", F.lit("</article>"), F.lit(" The robotics lab works on deep learning.</article>")))
    raw.limit(10).write.parquet(str(tmp_path / "some"))
    raw.write.parquet(str(tmp_path / "all"))
    tables, base = str(tmp_path / "t"), str(tmp_path / "kb")
    cli.main(["process", str(tmp_path / "some"), tables])
    cli.main(["pipeline", str(tmp_path / "all"), tables, base, "--resume"])
    urls = raw.select("url").distinct().count()
    assert spark.read.parquet(f"{tables}/pages").select("url").distinct().count() == urls
    kb = stores.KnowledgeBase(spark, base)
    kept = spark.read.parquet(f"{tables}/pages").where("drop_reason IS NULL").select("page_id").distinct().count()
    assert kb.pages().count() == kept > 0 and kb.vectors.rows().count() and kb.graph.edges().count()
    version = kb.ledger.state()[0]
    cli.main(["import", tables, base])
    assert kb.ledger.state()[0] == version and "0 commits" in capsys.readouterr().out
    cli.main(["ask", base, "who works in the robotics lab", "-k", "5", "--debug"])
    said = capsys.readouterr().out
    assert "hits (" in said and "dense" in said
    monkeypatch.setattr("sys.stdin", iter(["who works in the robotics lab\n", "what is their topic\n", "quit\n", "never\n"]))
    cli.main(["chat", base, "-k", "5"])
    said = capsys.readouterr().out
    assert "who works in the robotics lab" in said and "previous question was" in said.lower() and "never" not in said
    cli.main(["stats", base])
    assert "chunks" in capsys.readouterr().out


def test_clashing_columns(spark, sf):
    raw = spark.read.parquet(f"{sf}/pages.parquet").limit(5).withColumns({"title": F.lit("mine"), "__low": F.lit(1), "own_low": F.lit(2), "own_words": F.lit(3), "__w": F.lit(4)})
    out = pages.process(raw)
    assert len(set(out.columns)) == len(out.columns) and out.where("title = 'mine'").count() == 0
    r = out.first()
    assert (r["__low"], r.own_low, r.own_words, r["__w"]) == (1, 2, 3, 4)
    plain = pages.process(raw.select("url", "html")).select("url", "page_id", "title", "word_count", "relevance_score")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, out.select(plain.columns).collect()))
    rows = spark.createDataFrame([("1", "u1", 7), ("2", "u2", 8)], "page_id string, url string, __id int")
    left = files.unprocessed(rows, rows.where("page_id = '1'")).first()
    assert left["__id"] == 8


def test_crawl_follows_relevant_pages(spark):
    links = spark.createDataFrame([("https://a.org/1", "https://a.org/2", 0.5), ("https://a.org/2", "https://a.org/3", 0.2), ("https://a.org/1", "https://a.org/4", 0.5), ("https://a.org/4", "https://a.org/5", None)], "source string, link string, relevance double")
    seeds = spark.createDataFrame([("https://a.org/1",)], "url string")
    got = {r.url: r.depth for r in pages.expand_frontier(seeds, links, "a.org").collect()}
    assert got == {"https://a.org/1": 0, "https://a.org/2": 1, "https://a.org/4": 1}
    got = {r.url for r in pages.expand_frontier(seeds, links.drop("relevance"), "a.org").collect()}
    assert got == {f"https://a.org/{i}" for i in range(1, 6)}


def test_broken_settings_are_an_error(tmp_path):
    (tmp_path / "s.yaml").write_text("a: [1, 2\nb: {")
    with pytest.raises(Exception):  # noqa: B017  the YAML reader's own error, or a ValueError without one
        files.Settings(str(tmp_path / "s.yaml"))


def test_entity_rules_from_a_file(spark, tmp_path):
    """Patterns and topics of an institution replace the built-in ones, type by type."""
    (tmp_path / "rules.json").write_text(json.dumps({"extraction_patterns": {"Research_Topic": [r"topic\s+(\w+)"], "lab": [r"(\w+)\s+workshop"]}, "topics": ["glass blowing"]}))
    rules = entities.Rules.of(files.Settings(str(tmp_path / "rules.json")))
    text = "The Küche workshop has topic ätzen; glass   blowing, machine learning. The robotics lab. Department of physics."
    e = spark.createDataFrame([(text,)], "t string").select(entities.page_entities(F.col("t"), F.lit(""), F.lit(""), rules=rules).alias("e")).first().e
    assert (e.labs, e.topics) == (["Küche"], ["Glass   Blowing", "Ätzen"]) and any("Physics" in o for o in e.organizations)
    with pytest.raises(ValueError, match="one group"):
        entities.Rules.of(files.Settings({"extraction_patterns": {"lab": ["no group"]}}))
    assert entities.Rules.of(files.Settings({})) == entities.Rules()
