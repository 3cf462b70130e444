"""python -m tessella process|import|pipeline|ask|chat|stats: raw pages to tables, tables to a knowledge base, questions to answers, counts of what is there."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .plans import retrieval
from .sources import files, stores


def process(spark: SparkSession, pages: str, tables: str, resume: bool = False) -> int:
    """Raw pages (url, html; Parquet or JSON lines) to pages, chunks and mentions. ``resume``: only pages whose URL isn't there yet, beside what is. Gives the pages made."""
    raw = spark.read.schema("url string, html string").json(pages) if pages.endswith((".jsonl", ".json")) else spark.read.parquet(pages).select("url", "html")
    done = resume and _there(spark, f"{tables}/pages")
    if done:
        raw = files.unseen(raw, spark.read.parquet(f"{tables}/pages"))
    made = retrieval.ingest(raw)
    try:
        mode = "append" if done else "overwrite"
        made["all"].write.mode(mode).parquet(f"{tables}/pages")
        for name in ("chunks", "mentions"):
            made[name].write.mode(mode).parquet(f"{tables}/{name}")
        return made["pages"].count()
    finally:
        made["all"].unpersist()


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, tables: str, base: str, source: str | None = None, flush: int = 10_000, chunks: bool = True, mentions: bool = True) -> int:
    """Processed tables into a knowledge base, ``flush`` pages a commit; parts that were loaded from ``source`` before are left out. Gives the commits made."""
    made = {t: spark.read.parquet(f"{tables}/{t}") for t in ("pages", "chunks", "mentions")}
    kept = made["pages"].where("drop_reason IS NULL")
    cut = made["chunks"].withColumn("embedding", F.col("embedding").cast("array<float>"))
    return stores.KnowledgeBase(spark, base).load_in_parts(kept, cut if chunks else cut.limit(0), made["mentions"] if mentions else made["mentions"].limit(0), source or tables, flush)


def knowledge(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus, mentions and known entities of a knowledge base."""
    kb = stores.KnowledgeBase(spark, base)
    corpus = kb.vectors.rows().withColumns({"doc_id": F.col("chunk_key"), "source": F.col("url")})
    mentions = kb.graph.edges().where("rel = 'MENTIONS'").select(F.col("src_key").alias("page_id"), F.col("dst_key").alias("entity_name"), F.col("dst_label").alias("entity_type"), "count")
    return corpus, mentions, mentions.select("entity_name", "entity_type").distinct().withColumn("alias", F.lit(None).cast("string"))


def answers(spark: SparkSession, base: str, questions: list[str], k: int = 50, debug: bool = False, history: list[str] | None = None) -> list:
    """Answers in the order of the questions; ``history``: what was asked before, in a conversation."""
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
    earlier = spark.createDataFrame([(0, 2 * len(history), history[-1])], "query_id long, history_size int, last_question string") if history else None
    return sorted(retrieval.ask(asked, *knowledge(spark, base), earlier, k, debug=debug).collect(), key=lambda r: r.query_id)


def _show(r, debug: bool) -> None:
    print(f"{r['query']}\n{r.answer}\n" + "\n".join(f"- {s.title} {s.url} ({s.relevance_score})" for s in r.sources or []))
    if debug and r.debug:
        found = ", ".join(f"{s.hits} {s.strategy}" for s in r.debug.strategies)
        print(f"{r.debug.hits} hits ({found}; {r.debug.by_several} by several)\n" + "\n".join(f"  {b.rank}. {b.source} {b.final_score:.4f}" for b in r.debug.best))
    print()


def chat(spark: SparkSession, base: str, lines, k: int = 50, debug: bool = False) -> None:
    """A conversation: each line is a question; later ones can refer to the one before. Ends at an empty line, quit or exit."""
    history: list[str] = []
    for line in lines:
        question = line.strip()
        if question.lower() in ("", "quit", "exit"):
            return
        _show(answers(spark, base, [question], k, debug, history)[0], debug)
        history.append(question)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("process", help="raw pages (url, html) to pages, chunks and mentions")
    c.add_argument("pages")
    c.add_argument("tables")
    c.add_argument("--resume", action="store_true", help="leave out pages that are there")
    c = sub.add_parser("import", help="processed tables into a knowledge base")
    c.add_argument("tables")
    c.add_argument("base")
    c.add_argument("--batch-size", type=int, default=10_000, help="pages of a commit")
    c.add_argument("--skip-vectors", action="store_true")
    c.add_argument("--skip-graph", action="store_true")
    c = sub.add_parser("pipeline", help="process and import")
    c.add_argument("pages")
    c.add_argument("tables")
    c.add_argument("base")
    c.add_argument("--resume", action="store_true")
    c.add_argument("--skip-process", action="store_true")
    c.add_argument("--skip-import", action="store_true")
    for name, text in (("ask", "answers questions"), ("chat", "answers lines of a conversation from the standard input")):
        c = sub.add_parser(name, help=text)
        c.add_argument("base")
        if name == "ask":
            c.add_argument("question", nargs="+")
        c.add_argument("-k", type=int, default=50)
        c.add_argument("--debug", action="store_true", help="show strategies and best hits")
    c = sub.add_parser("stats", help="counts of a knowledge base")
    c.add_argument("base")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if a.command == "process" or a.command == "pipeline" and not a.skip_process:
        print(f"{process(spark, a.pages, a.tables, a.resume)} pages")
    if a.command == "import" or a.command == "pipeline" and not a.skip_import:
        skip = a.command == "import"
        print(f"{load(spark, a.tables, a.base, flush=a.batch_size if skip else 10_000, chunks=not (skip and a.skip_vectors), mentions=not (skip and a.skip_graph))} commits")
    if a.command == "ask":
        for r in answers(spark, a.base, a.question, a.k, a.debug):
            _show(r, a.debug)
    if a.command == "chat":
        chat(spark, a.base, sys.stdin, a.k, a.debug)
    if a.command == "stats":
        kb = stores.KnowledgeBase(spark, a.base)
        _, mentions, known = knowledge(spark, a.base)
        graph.stats(kb.pages(), known, mentions, kb.vectors.rows()).show(truncate=False)


if __name__ == "__main__":
    main()
