import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token bigint, node string, row int, digest string, toxicity string, n int, v string, key string, block int"


def nasty():
    """Documents with nulls, empty, blank and very long texts, repeated rows, near copies, marks and odd characters."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    base = [word() for _ in range(120)]
    texts = [None, "", "   \n\t ", "one", "One", "two words", "a b c d e", "A B C D E", "a b c d e f"]
    texts += [" ".join(base)] * 3
    for k in range(40):  # near copies of one text, more than a rare token may have
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    passage = " ".join(base[:30])
    for _ in range(25):  # a passage that many texts share
        texts.append(" ".join(word() for _ in range(rnd.randint(10, 200))) + " " + passage)
    texts += [" ".join(word() for _ in range(20_000)), "x" * 50_000, "it's we'll  two  spaces\n\nlines. Ünïcode — 日本語 <|endoftext|> \x00\x01 end ", "émile zola " * 30]
    texts += [" ".join(base[:60] + [word() for _ in range(rnd.randint(0, 30))]) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(7, texts[7]), (12, texts[12]), (None, "no id"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(d, t, "en", "s", len(t or ""), 1, "x", 2, "y", "z", 3, None, None, 4) for d, t in nasty()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
