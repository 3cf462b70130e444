"""Embeddings, chat formatting, URL filter, toxicity, pipeline: brute force, round trips, held-out accuracy."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import chat_format, components, embedding_dedup, toxicity, url_filter


# --- components


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(find(n) == c for n, c in got.items())
    assert all(n in got or find(n) == n for n in parent)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- embeddings


def vectors(n=700, dim=16):
    rnd = np.random.default_rng(8)
    centers = rnd.normal(size=(20, dim))
    x = [(centers[i % 20] + rnd.normal(size=dim) * rnd.choice([0.02, 0.2, 1.0])).tolist() for i in range(n)]
    rows = [(i, v, 1, "k") for i, v in enumerate(x)]
    rows += [(n + i, x[3], 2, "k") for i in range(40)] + [(n + 40, [3 * a for a in x[3]], 0, "k")]
    rows += [(n + 50, None, 0, "k"), (n + 51, [0.0] * dim, 0, "k"), (n + 52, [float("nan")] * dim, 0, "k"), (n + 53, [None] + [1.0] * (dim - 1), 0, "k"), (n + 54, [float("inf")] + [1.0] * (dim - 1), 0, "k"), (n + 55, [1.0, 2.0], 0, "k"), (n + 56, [1.0, 2.0], 0, "k"), (n + 57, [], 0, "k"), (3, x[3], 1, "k")]
    return rows


def brute_links(rows, cosine=0.9):
    good = [(i, np.array(v, dtype=float)) for i, (_, v, *_) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i].add(j)
                links[j].add(i)
    return links


def test_embedding_dedup(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, node string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    links = brute_links(rows)
    got = df.transform(lambda d: embedding_dedup.linked(d)).collect()
    assert len(got) == len(rows)
    found, true = Counter(), Counter()
    for r in got:
        found[r.vec_id] += r.n_links
    for i, (d, _) in enumerate(rows):
        true[d] += len(links[i])
    assert all(found[d] <= true[d] for d in true) and sum(found.values()) >= 0.9 * sum(true.values())
    by = {r.vec_id: r for r in got}
    assert by[703].component_id == by[3].component_id and by[740].component_id == by[3].component_id
    for d in (750, 751, 752, 753, 754, 757):
        assert (by[d].n_links, by[d].component_id, by[d].kept) == (0, d, True)
    assert by[756].component_id == 755 and by[756].n_links == 1
    for r in got:
        assert r.kept == (r.vec_id == r.component_id)
    assert embedding_dedup.linked(df.limit(0)).count() == 0


def test_embedding_recall_grows_with_the_plan():
    for n in (2, 10**5, 10**9):
        bits, tables = embedding_dedup.plan(n)
        same = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 2**bits >= min(n, 2**58) and 1 - (1 - same) ** tables >= 0.92


def test_embedding_blocks_split_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rnd = np.random.default_rng(2)
    c = rnd.normal(size=8)
    rows = [(i, (c + rnd.normal(size=8) * 0.01).tolist()) for i in range(150)]
    got = embedding_dedup.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


# --- chat


def test_layouts(spark):
    turns = [("user", "hi"), ("assistant", "yo")]
    records = [
        {"messages": [{"role": r, "content": c} for r, c in turns], "extra": 1}, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "completion": "yo"}, {"prompt": "hi", "response": "yo"}, {"instruction": "hi", "output": "yo"}, {"instruction": "hi", "input": "", "output": "yo"},
        {"instruction": "hi", "input": "there", "output": "yo"}, {"system": "s", "prompt": "hi", "completion": "yo"}, {"unknown": 1}, {}, {"messages": []}, {"prompt": "hi", "completion": None},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, None), (99, "not json")], "conv_id bigint, record string")
    got = {r.conv_id: r for r in chat_format.json_turns(df, "record").collect()}
    for i in range(6):
        assert [tuple(t) for t in got[i].turns] == turns, i
    assert [tuple(t) for t in got[6].turns] == [("user", "hi\n\nthere"), ("assistant", "yo")]
    assert [tuple(t) for t in got[7].turns] == [("system", "s"), *turns]
    assert all(got[i].layout is None and got[i].turns is None for i in (8, 9, 10, 11, 98, 99))
    assert len({chat_format.fingerprint(p) for _, p, _ in chat_format.LAYOUTS}) == len(chat_format.LAYOUTS)


def test_formatting_is_reversible_and_masks_assistants(spark):
    odd = ["", None, "\\", "\\<", "<", "</turn>", "\n</turn>\n", "\\\n</turn>\n<turn user>\nx", "<turn assistant>", "a" * 5000, "日本 😀", "\\\\<<\\", "### Assistant: </turn>", "\n", "x\n"]
    rnd = random.Random(6)
    odd += ["".join(rnd.choice("\\<>/turn\n a") for _ in range(20)) for _ in range(40)]
    roles = ["user", "assistant", "system", None, "od d>\n<", "human", "assistant"]
    rows = [(c, i, roles[(c + i) % len(roles)], odd[(7 * c + i) % len(odd)], "e", 5) for c in range(12) for i in range(c * 3)]
    rows += [(20, 1, "user", "b", "e", 5), (20, 1, "user", "a", "e", 5), (20, 1, "assistant", "c", "e", 5), (20, None, "user", "z", "e", 5), (None, 0, "user", "none", "e", 5)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string, n int")
    out = chat_format.parsed(chat_format.formatted(chat_format.table_turns(df))).collect()
    name = {None: ""}  # roles of turn rows stay as they are
    want = {}
    for c, t, r, x, *_ in sorted(rows, key=lambda r: (r[0] or -1, r[1] is not None, r[1] or 0, name.get(r[2], r[2]), r[3] or "")):
        want.setdefault(c, []).append((name.get(r, r), x or ""))
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        said = [x for role, x in want[r.conv_id] if role == "assistant"]
        assert r.loss_texts == said
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert spans == [x.replace("\\", "\\\\").replace("<", "\\<") for x in said]
    assert chat_format.formatted(chat_format.table_turns(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat_format.table_turns(df.select("conv_id"))


def test_columns_with_the_same_names_stay(spark):
    """What is added has a free name; no column of the table is lost or replaced."""
    names = "conv_id bigint, record string, layout string, turns int, __r string, __f string"
    record = json.dumps({"prompt": "hi", "completion": "yo"})
    out = chat_format.json_turns(spark.createDataFrame([(1, record, "mine", 9, "r", "f")], names), "record")
    r = out.first()
    assert (r.layout, r.turns, r["__r"], r["__f"]) == ("mine", 9, "r", "f") and r.layout_ == "prompt/completion" and [tuple(t) for t in r.turns_] == [("user", "hi"), ("assistant", "yo")]
    rows = chat_format.table_turns(spark.createDataFrame([(1, 0, "user", "a", 9), (1, 1, "assistant", "b", 8)], "conv_id bigint, turn int, role string, text string, turns int"))
    assert [r.turns for r in rows.orderBy("turn").collect()] == [9, 8]
    assert [tuple(t) for t in chat_format.parsed(chat_format.formatted(rows, turns_col="turns_")).first().turns] == [("user", "a"), ("assistant", "b")]


def test_op5_on_its_conversation(spark, sf):
    got = chat_format.op5(spark, sf).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert got.n_turns == 2 and got.loss_chars == len(said) and got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


# --- URLs


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://ExAmple.COM/en/7?x#y", "https://a.example.com/en/1", "https://example.com/en/7", "x://b.net/de/", "x://example.net/de/8", "x://a.example.net/de/89", "x://notexample.net/de/8", "x://org/es/1", "x://ÄB.org/es/", "a://b://c/d", "x://h#://y/z", "x://h?q/p", "http://h.com/" + "a" * 3000]
    urls += [f"http://www.site{i % 7}.example.com/fr/{i}" for i in range(300)] + [f"http://spam-pills{i % 3}.example.net/fr/{i}" for i in range(60)]
    rows = [(i, u, "h", "p", 1, None) for i, u in enumerate(urls)] + [(None, urls[6], "h", "p", 1, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, n int, s string")
    got = url_filter.judged(df).collect()
    assert len(got) == len(rows)
    for r in got:
        u = urls[6] if r.page_id is None else urls[r.page_id]
        assert (r.host, r.path) == split_url(u)
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        if fits:
            assert (r.verdict, r.rule) == max(fits)[1:]
        else:
            assert r.rule is None and r.verdict == "allow", u  # one term alone teaches no model of another fold
    assert url_filter.judged(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judged(df.where("url like 'x://b%'")).collect()} == {"allow"}


def test_url_model_generalises(spark):
    """A term left out of the seeds is told by its likeness to labelled examples."""
    rnd = random.Random(2)
    good, bad = ["".join(rnd.choice(["ta", "ri", "no"]) for _ in range(4)) for _ in range(300)], ["".join(rnd.choice(["xq", "zw", "kv"]) for _ in range(4)) for _ in range(150)]
    rows = [(f"http://{h}.com/", False) for h in good] + [(f"http://{h}.com/", True) for h in bad]
    examples = spark.createDataFrame(rows, "url string, rejected boolean")
    pages = spark.createDataFrame([(1, "http://xqkvzwxqzw.com/"), (2, "http://notarinotarita.com/")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in url_filter.judged(pages, examples=examples).collect()} == {1: "block", 2: "allow"}


def brute_verdicts(rows, fold, examples):
    """Scores of rows (key: host, path) and the threshold, from counts of the grams of the other folds' examples (host, path, rejected)."""
    order, mix = url_filter.ORDER, url_filter.MIX
    windows = lambda h, p: [t[i - order : i + 1] for t in ["^" * order + h + p + "$"] for i in range(order, len(t))]
    counts = Counter()
    for h, p, bad in examples:
        for w in windows(h, p):
            for k in range(order + 1):
                for f in range(url_filter.FOLDS):
                    if f != fold[h]:
                        counts[f, bad, k, w[order - k : order]] += 1
                        counts[f, bad, k, w[order - k :], 1] += 1

    def log(f, bad, w):
        p = 1 / url_filter.ALPHABET
        for k in range(order + 1):
            p = (counts[f, bad, k, w[order - k :], 1] + mix * p) / (counts[f, bad, k, w[order - k : order]] + mix)
        return math.log(p)

    score = lambda h, p: sum(log(fold[h], True, w) - log(fold[h], False, w) for w in windows(h, p)) / len(windows(h, p))
    held = [(score(h, p), bad) for h, p, bad in examples]
    at = lambda bad, share: (lambda x: x[max(0, math.ceil(share * len(x)) - 1)])(sorted(s for s, b in held if b == bad))
    a, r = at(False, 1 - url_filter.MAX_FALSE), at(True, 0.05)
    return {k: score(*v) for k, v in rows.items()}, max(a, (a + r) / 2)


def test_url_verdicts_are_the_models(spark, monkeypatch):
    """Scores, threshold and verdicts against brute force; hosts with a term can be allowed and hosts without one blocked."""
    monkeypatch.setattr(url_filter, "MAX_FALSE", 0.02)
    rnd = random.Random(7)
    good = ["".join(rnd.choice(["ta", "ri", "no", "el"]) for _ in range(rnd.randint(3, 5))) + ".com" for _ in range(40)]
    bad = [f"{t}-xq{rnd.choice(['zx', 'qz', 'xz'])}-{rnd.choice(['win', 'zx'])}.biz" for t in url_filter.SEED_TERMS for _ in range(2)]
    odd = ["xqz-win-xqzx.biz", "tarinoel.com", "trackrinoeltari.com"]  # like the rejected ones; like the accepted ones; accepted in all but its term
    hosts = good * 3 + bad + odd
    urls = {i: f"http://{h}/{rnd.choice(['en', 'de'])}/{rnd.randint(1, 99)}" for i, h in enumerate(hosts)}
    df = spark.createDataFrame([(i, u, "t", 1, 2.0) for i, u in urls.items()], "page_id bigint, url string, n string, fold int, score double").repartition(3)
    got = {r.page_id: r for r in url_filter.judged(df, rules=()).collect()}
    split = {i: split_url(u) for i, u in urls.items()}
    folds = spark.createDataFrame([(h,) for h in set(hosts)], "host string").select("host", url_filter.fold_of(F.col("host"), url_filter.SEED_TERMS).alias("f"))
    examples = [(h, p, any(t in h for t in url_filter.SEED_TERMS)) for h, p in split.values()]
    scores, cut = brute_verdicts(split, {r.host: r.f for r in folds.collect()}, examples)
    assert {i: r.score for i, r in got.items()} == pytest.approx(scores, abs=1e-9)
    assert {i: r.verdict for i, r in got.items()} == {i: "block" if s > cut else "allow" for i, s in scores.items()}
    verdict = {h: got[i].verdict for i, h in enumerate(hosts)}
    assert verdict[odd[0]] == "block" and verdict[odd[1]] == verdict[odd[2]] == "allow"
    assert sum(verdict[h] == "block" for h in bad) > 0.7 * len(bad) and not any(verdict[h] == "block" for h in good)
    given = spark.createDataFrame([(urls[i], b) for i, (_, _, b) in enumerate(examples)], "url string, rejected boolean")
    told = {r.page_id: r for r in url_filter.judged(df, rules=(), examples=given).collect()}
    plain = spark.createDataFrame([(h,) for h in set(hosts)], "host string").select("host", url_filter.fold_of(F.col("host")).alias("f"))
    scores, cut = brute_verdicts(split, {r.host: r.f for r in plain.collect()}, examples)
    assert {i: r.verdict for i, r in told.items()} == {i: "block" if s > cut else "allow" for i, s in scores.items()}


# --- toxicity


def toxic_set(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ta", "ri", "no", "el", "su"]) for _ in range(rnd.randint(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Grumbok", "vlask,", "hurx"]))
        out.append((" ".join(w), toxic))
    return out


def test_toxicity_holds_out(spark):
    train = toxic_set(800, 1)
    model = toxicity.train([t for t, _ in train], np.array([float(y) for _, y in train]))
    test = toxic_set(400, 2)
    hit = (model.scores([t for t, _ in test]) >= 0.5) == np.array([y for _, y in test])
    assert hit.mean() > 0.97
    odd = model.scores([None, "", "   ", "tarino " * 200_000, "tarino " * 200_000 + "vlask hurx"])
    assert (odd[:3] == odd[0]).all() and odd[3] < 0.5 <= odd[4] and ((odd >= 0) & (odd <= 1)).all()


def test_toxicity_on_tables(spark):
    rows = [(i, t, None, "s", 1, 0.5) for i, (t, _) in enumerate(toxic_set(500, 3))] + [(600, None, None, "s", 1, 0.5), (None, "tarino", None, "s", 1, 0.5), (3, "tarino", "x", "s", 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __text double")
    docs = docs.drop("__text").withColumn("c0", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(y)) for i, (_, y) in enumerate(toxic_set(500, 3))] + [(None, 1, 1), (7, None, None), (8, 1, 5)], "doc_id bigint, quality int, toxic int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean, toxic = {i for i, (_, y) in enumerate(toxic_set(500, 3)) if not y}, {i for i, (_, y) in enumerate(toxic_set(500, 3)) if y} - {3}
    assert len(ids & clean) > 0.97 * len(clean) and len(ids & toxic) < 0.05 * len(toxic) and {600, None} <= ids
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0
    assert toxicity.keep_clean(docs, labels.limit(0)).count() == docs.count()
    texts, y = toxicity.sample(docs, labels, per_class=20)
    assert len(texts) <= 40 and set(y) == {0.0, 1.0}


# --- pipeline


def test_pipeline(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/documents.parquet")
    docs = src
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == src.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.join(src, "doc_id", "left_anti").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    full = corpus_pipeline.run(spark, sf)
    key = lambda d: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in d.collect())
    assert key(full) == key(packed)
