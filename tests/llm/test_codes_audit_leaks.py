"""Vector codes, the filter audit and decontamination against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import decontamination, filter_audit, vector_codes

from .conftest import nasty

# --- vector codes


def lloyd(rows, entries, rounds=4):
    """vec_id, label, code and error by comparing every part with every entry, in Python's integers."""
    good = [(i, v, y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(good[0][1]) if good else 0
    good = [r for r in good if len(r[1]) == dims]
    most = vector_codes.bound(dims)
    whole = [[max(-most, min(most, math.floor(1024 * x))) for x in v] for _, v, _ in good]
    digits, error, books = [[] for _ in good], [0] * len(good), []
    for p in range(4):
        parts = [v[p * dims // 4 : (p + 1) * dims // 4] for v in whole]
        book = [list(x) for x in parts[:entries]]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            groups = {}
            for x in parts:
                groups.setdefault(near(x)[1], []).append(x)
            for k, xs in groups.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        for i, x in enumerate(parts):
            d, k = near(x)
            digits[i].append(f"{k:02x}")
            error[i] += d
        books += [c for e in book for c in e]
    sums = Counter()
    for (_, _, y), e in zip(good, error, strict=True):
        sums[y] += e
    return Counter((i, y, "".join(d), e, sums[y]) for (i, _, y), d, e in zip(good, digits, error, strict=True)), hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def some_vectors(dims, n=400):
    rnd = np.random.default_rng(dims)
    x = rnd.normal(size=(n, dims)) * rnd.choice([0.001, 0.1, 1.0], size=(n, 1))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(n + i, x[5].tolist(), None) for i in range(150)]  # one vector a third of the time
    rows += [(n + 200 + i, [float(i % 3 - 1)] * dims, 1) for i in range(60)]  # ties between entries
    bad = [None, [], [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1), [1.0] * (dims + 1)]
    return rows + [(n + 300 + i, v, 2) for i, v in enumerate(bad)] + [rows[7], rows[7], (None, x[9].tolist(), 2)]


CODES = "vec_id bigint, embedding array<double>, label int, code string, v int, `of` string, error int"


@pytest.mark.parametrize(("dims", "entries", "block", "parts"), [(16, 12, 64, 3), (64, 256, 2048, 2), (6, 5, 100, 1), (3, 4, 50, 2)])
def test_codes_equal_lloyd(spark, monkeypatch, dims, entries, block, parts):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = some_vectors(dims)
    df = spark.createDataFrame([(*r, "c", 1, "x", 2) for r in rows], CODES).repartition(parts)
    out, books = vector_codes.compressed(df, entries=entries)
    want, digest = lloyd(rows, entries)
    assert vector_codes.digest(books) == digest
    assert Counter((r.vec_id, r.label, r.code, r.error, r.label_error) for r in out.collect()) == want
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_codes_of_large_few_and_no_vectors(spark):
    rows = [(1, [1e30, -1e30, 5e4, 0.0], None), (2, [3e4, 0.5, 0.25, -0.1], None), (3, [0.0] * 4, 1)]
    df = spark.createDataFrame([(*r, "c", 1, "x", 2) for r in rows], CODES)
    out, books = vector_codes.compressed(df)
    want, digest = lloyd(rows, 256)
    assert vector_codes.digest(books) == digest and Counter((r.vec_id, r.label, r.code, r.error, r.label_error) for r in out.collect()) == want
    out, books = vector_codes.compressed(df.limit(0))
    assert out.count() == 0 and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert vector_codes.compressed(df.selectExpr("vec_id", "cast(null as array<double>) AS embedding", "label"))[0].count() == 0


def test_walk_gives_whole_subtrees():
    """Points far apart are assigned above the leaves, and sums, counts and codes are those of all points."""
    rnd = np.random.default_rng(1)
    centers = rnd.integers(-500, 500, size=(8, 4)) * 2
    x = (centers[rnd.integers(0, 8, 3000)] + rnd.integers(-2, 3, size=(3000, 4))).astype(float)
    tree = vector_codes.build(x)
    looked = []
    plain = np.bincount

    def counted(a, **k):
        looked.append(len(a))
        return plain(a, **k)

    np.bincount = counted
    try:
        total, count, codes = vector_codes.walk(tree, centers, codes=True)
    finally:
        np.bincount = plain
    want = ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
    assert (codes == want).all() and (count == plain(want, minlength=8)).all()
    assert all((total[k] == x[want == k].sum(0)).all() for k in range(8))
    assert sum(looked) < 0.4 * len(x)


# --- filter audit


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def audit(docs, labels):
    first, said, out = {}, {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        a = said.setdefault(i, [0, 0])
        a[0], a[1] = a[0] or q == 1, a[1] or x == 1
    parts = {}
    for i, t, p in docs:
        bits = [*failures(t or ""), i is not None and i > first[t or ""]]
        parts.setdefault(p or "", []).append((bits, *(said.get(i, (0, 0)) if i is not None else (0, 0))))
    for p, rows in parts.items():
        shapley = Counter()
        for order in itertools.permutations(range(5)):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                fails = sum(r[0][f] for r in rows)
                key = p, "".join("ABCDE"[k] for k in order), step
                out[key] = [len(left), len(gone), fails - len(gone), sum(r[0][f] and sum(r[0]) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for key in [k for k in out if k[0] == p]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(int(x) for x in v) for k, v in out.items()}


@pytest.mark.parametrize("local", [1 << 24, 500])
def test_audit_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(filter_audit, "LOCAL", local)
    if local == 500:  # beyond the bounds of broadcasts
        monkeypatch.setattr(filter_audit, "BROADCAST_IDS", 0)
    rnd = random.Random(4)
    docs = [(i, t, rnd.choice(["en", "de", "", None])) for i, t in nasty()]
    docs += [(1000 - i, "many copies of $ this " * 40, rnd.choice(["en", "fr"])) for i in range(300)] + [(900, "many copies of $ this " * 40, "en"), (701, "many copies of $ this " * 40, "es")] * 3
    docs += [(None, "many copies of $ this " * 40, "en")] * 5 + [(2000, "GROSS UND LAUT und klein " * 30, "de"), (2001, "a b\x1cc\x85d" * 30, "de"), (2002, " ".join(f"w{i}" for i in range(100)), "de"), (2003, " ".join(f"W{i % 80}" for i in range(100)), "de")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 1100, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "m", 2, "k") for d in docs], "doc_id bigint, text string, lang string, n bigint, mask string, key int, part string").repartition(6)
    said = spark.createDataFrame([(*x, 9) for x in labels], "doc_id bigint, quality int, toxic int, n int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(df, said).collect()}
    assert got == audit(docs, labels)
    assert filter_audit.audit(df.limit(0), said).count() == 0
    bare = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(df, said.limit(0)).collect()}
    assert bare == audit(docs, [])


def test_equal_fingerprints_are_no_copies():
    """Two texts behind one hash stay apart, before and after the shuffle."""
    rows = [(7, 1, b"1", "one"), (7, 2, b"2", "two"), (7, 4, b"1", "one"), (7, 3, b"1", "one"), (7, 3, b"1", "one"), (7, 1, b"1", "one")]
    sent = list(filter_audit._before(rows[:3])) + list(filter_audit._before(rows[3:]))
    assert sorted((d, bytes(x)) for d, x in filter_audit._after(v for v in sent)) == [(3, b"1"), (4, b"1")]
    assert sum(v[2] is not None for _, v in sent) == 3  # a copy of the same run sends no text


# --- decontamination


def leaks(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return Counter(out)


def some_leaks():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdé1") for _ in range(rnd.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(10, 60)))) for i in range(25)] + [(30, "One, two; THREE"), (31, "solo"), (32, None), (33, "..."), (34, "é" * 3 + " ÉÉ x1"), (None, "no id has this item of words")]
    items += [(100 + i, "shared beginning " * 6 + word()) for i in range(12)] + [(5, "a second text of item five with more than ten words in all of it"), (25, items[3][1]), (3, items[3][1])]
    docs = list(nasty())
    for i in range(150):
        w = [word() for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            t = rnd.choice(items)[1] or ""
            part = t.split()
            part = part[rnd.randint(0, 3) :] if rnd.random() < 0.5 else part[: rnd.randint(0, 12)]
            at = rnd.randint(0, len(w))
            w[at:at] = part
        docs.append((500 + i, rnd.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 == 0 else " ".join(w)))
    docs += [(800 + i, items[0][1] + " tail") for i in range(60)] + [(801, items[0][1] + " tail"), (None, items[1][1]), (900, "shared beginning " * 300), (901, (items[2][1] + " ") * 20)]
    return docs, items


@pytest.mark.parametrize(("block", "few"), [(1_000_000, 100_000), (40, 0)])
def test_leaks_equal_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", few)
    docs, items = some_leaks()
    df = spark.createDataFrame([(i, t, "w", 1, "h", 2, "m") for i, t in docs], "doc_id bigint, text string, w string, place int, h string, start int, mark string").repartition(4)
    bench = spark.createDataFrame([(i, t, "w", 3, "x") for i, t in items], "item_id bigint, text string, w string, wid int, item string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in decontamination.contaminated(df, bench).collect())
    want = leaks(docs, items)
    assert got == want
    if few:
        assert decontamination.contaminated(df.limit(0), bench).count() == 0
        none = decontamination.contaminated(df, bench.limit(0)).collect()
        assert len(none) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in none)
        clean = decontamination.keep_clean(df, bench)
        assert clean.columns == df.columns
        assert Counter(r.doc_id for r in clean.collect()) == Counter(i for (i, *_, bad), n in want.items() for _ in range(n) if not bad)
