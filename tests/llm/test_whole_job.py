"""Training-data operators against brute force, where a bound or a short cut could hide a loss."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, packing, url_filter

# --- URL filter


@pytest.mark.parametrize("bound", [300_000, 2000, 0])
def test_url_counts_grow_with_the_input(spark, monkeypatch, bound):
    """Against counts of the grams themselves, with more of them than a table of 32,768 slots has; broadcast, in part and shuffled."""
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", bound, raising=False)
    rnd, order = random.Random(8), url_filter.ORDER
    rows = [(f"h{i % 9}.com", "/" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.randint(0, 300))), i % 3 == 0) for i in range(400)]
    counts = Counter()
    windows = lambda h, p: [t[i - order : i + 1] for t in ["^" * order + h + p + "$"] for i in range(order, len(t))]
    for h, p, bad in rows:
        for w in windows(h, p):
            for k in range(order + 1):
                counts[2 * k, w[order - k : order], bad] += 1
                counts[2 * k + 1, w[order - k :], bad] += 1
    model = url_filter.train(spark.createDataFrame(rows, "host string, path string, rejected boolean")).persist()
    assert model.count() == len({key[:2] for key in counts}) > 100_000
    assert model.where("slot = 9").count() > 32_768

    def log(w, bad):
        p = 1 / url_filter.ALPHABET
        for k in range(order + 1):
            p = (counts[2 * k + 1, w[order - k :], bad] + url_filter.MIX * p) / (counts[2 * k, w[order - k : order], bad] + url_filter.MIX)
        return math.log(p)

    asked = [(n, h, p) for n, (h, p, _) in enumerate(rows[:40])] + [(100, "h1.com", "/unseen~ÄÖ" * 40), (101, "", "")]
    got = {r.n: r.score for r in url_filter.scored(spark.createDataFrame(asked, "n int, host string, path string"), ["n", "host", "path"], model).collect()}
    want = {n: sum(log(w, True) - log(w, False) for w in windows(h, p)) / len(windows(h, p)) for n, h, p in asked}
    assert got == pytest.approx(want, abs=1e-9)


# --- chat


def test_loss_texts_are_what_the_spans_cover(spark):
    """Cut by start and length: they equal the assistant's texts with right spans and show wrong ones."""
    said = [("user", "a\\<b"), ("assistant", "x\\<y> 日本😀 \\\\<"), ("user", "😀"), ("assistant", ""), ("assistant", "the end\n</turn>\n")]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "conv_id int, turn int, role string, text string")
    out = chat_format.formatted(chat_format.table_turns(rows))
    assert chat_format.parsed(out).first().loss_texts == [t for r, t in said if r == "assistant"]
    off = out.withColumn("loss_spans", F.transform("loss_spans", lambda s: s.withField("start", s["start"] + 1).withField("length", s["length"] - 1)))
    assert chat_format.parsed(off.select("*")).first().loss_texts[2] == "he end\n</turn>\n"


# --- packing


def test_search_ends_where_no_step_is_left():
    """A pair sum above the 64 smallest is found; random bins end where no move or exchange raises the squares."""
    x = np.array([2, 4, 8, 16, 26, 42, 62, 90, 132, 162, 194, 246, 439, 584])
    assert sorted(x[b].sum() for b in packing.local_search([list(range(12)), [12, 13]], x, 1024)) == [983, 1024]
    rnd = random.Random(4)
    for _ in range(30):
        n = np.array([rnd.randint(1, 40) for _ in range(40)])
        bins: list[list[int]] = []
        for d in range(40):
            bins = bins if bins and n[bins[-1]].sum() + n[d] <= 100 else [*bins, []]
            bins[-1].append(d)
        bins = [b for b in bins if n[b].sum() < 100]
        out = packing.local_search(bins, n, 100)
        assert sorted(d for b in out for d in b) == sorted(d for b in bins for d in b)
        for a in out:
            for b in out:
                fa, fb = n[a].sum(), n[b].sum()
                if a is not b and fb < 100:
                    sums = [n[i] for i in a] + [n[i] - n[k] for i in a for k in b] + [n[i] + n[j] - n[k] for i in a for j in a if i < j for k in b]
                    assert not any(0 < net <= 100 - fb and fb - fa + net > 0 for net in sums)
