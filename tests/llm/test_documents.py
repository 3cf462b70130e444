"""Packing, joins, deduplication, token work on texts: compared with brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessella.llm import exact_dedup, ngram_join, packing, sentence_pieces, token_counts, token_files, words
from tessella.llm.common import shared_dir
from tessella.llm.pieces import load, words_of
from tessella.llm.tokenize import CachedEncoder

PIECES = P.path("piece_bpe_32k.model")


def plain(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


ODD = [
    "", " ", "\n", "  Hello  wörld\n\tx €😀 ab", " lead", "trail ", "日本語 漢字", "\x00\x01 z", "x" * 300, "it's we'll 'tis don't.", "a\n\nb c\n d\ne", "ẞ İstanbul ŉ ª º µ ſ",
    "J̌ ǰ Å Å", "<|endoftext|> a <|startoftext|>", "a.b c,d e.\nF g\n", "ΣΑΣ Σ", " x y  z", "café,\nNaïve Été.", "ab́ cd", "1st 22nd A1. b2,", "... !!! ?! a.. b,. (x)", "Ž.ž Ĳ ǅ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_equals_the_library(name):
    enc, want = CachedEncoder(P.path(name), cache_size=50), plain(name)
    for _ in range(2):
        for text, got in zip(ODD, enc.encode(ODD), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == want(text), text
    assert enc.encode([None]) == [b""]


def test_packing(docs, no_docs):
    want = plain("byte_bpe_50k.json")
    rows = packing.packed(docs, P.path("byte_bpe_50k.json"), block=30).collect()
    by_row, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_row[r.row].append(r)
        by_bin[r.sequence_id].append(r)
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    texts = Counter((d, tuple(want(t or "") + [2])) for d, t in docs.select("doc_id", "text").collect())
    sizes = Counter((d, len(ids)) for (d, ids), n in texts.items() for _ in range(n))
    assert Counter((p[0].doc_id, sum(r.length for r in p)) for p in by_row.values()) == sizes
    ids_of = {d: ids for (d, ids) in texts if d is not None}
    for p in by_row.values():
        p.sort(key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p))) and all(r.length == 1024 for r in p[1:])
        if p[0].doc_id is not None and p[0].doc_id not in (7, 12):
            for r in p:
                assert r.ids_crc32 == zlib.crc32(np.array(ids_of[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    assert packing.packed(no_docs, P.path("byte_bpe_50k.json")).count() == 0


def test_local_search_empties_bins_and_keeps_documents():
    rnd = np.random.default_rng(3)
    for n in (1, 5, 300):
        lengths = rnd.integers(1, 1024, n)
        worst = [[i] for i in range(n)]
        out = packing.local_search(worst, lengths, 1024)
        assert sorted(d for b in out for d in b) == list(range(n)) and all(lengths[b].sum() <= 1024 for b in out)
        squares = lambda bins: sum(int(lengths[b].sum()) ** 2 for b in bins)
        assert squares(out) >= squares(worst)
        assert len(packing.pack(lengths, 1024)) <= len(worst)
    fits = np.array([512, 512, 300, 724, 100, 200, 724])
    assert len(packing.pack(fits, 1024)) == 3
    assert len(packing.local_search([[0, 2], [1, 4], [3], [5, 6]], fits, 1024)) == 3
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(0) == [(0, 0)]


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("few,block,frequent", [(16, 256, 500_000), (3, 8, 500_000), (3, 8, 5), (16, 256, 0)])
def test_ngram_join(docs, no_docs, monkeypatch, few, block, frequent):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    most = ngram_join.frequent_tokens
    monkeypatch.setattr(ngram_join, "frequent_tokens", lambda nodes: most(nodes, frequent))
    rows = docs.select("doc_id", "text").distinct().collect()
    sets = {r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}
    want = brute_components(sets)
    got = ngram_join.joined(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r
    assert len({c for c in want.values()}) < len(want) - 30
    if few == 16:
        assert ngram_join.joined(no_docs).count() == 0


def test_ngram_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    want = brute_components({r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None})
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, c in want.items() if d == c} | {None}


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["aa", "B", "ç€", "日本", "x" * 40]) for _ in range(rnd.randint(0, 400))) for _ in range(30)] + [None, "", "y" * 5000, "z" * 300 + " " + "y" * 900]
    whole, begin = words.word_hashes(texts)
    monkeypatch.setattr(words, "BLOCK", 256)
    again, begin2 = words.word_hashes(texts)
    assert (whole == again).all() and (begin == begin2).all()
    split = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert np.diff(begin).tolist() == [len(s) for s in split]
    assert len(set(whole.tolist())) == len({w for s in split for w in s})


@pytest.mark.parametrize("least", [1, 2, 64])
def test_exact_dedup(docs, no_docs, least):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    low = lambda d: (d is not None, d or 0)
    got = exact_dedup.exact_groups(docs, least=least).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).digest(): (t, ids) for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        t, ids = by[bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == max(ids, key=low)
        kept[t] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_exact_keep_one(docs):
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    rows = Counter(r.text or "" for r in out.collect())
    assert set(rows.values()) == {1} and set(rows) == {r.text or "" for r in docs.collect()}


def test_token_files(spark, docs, no_docs):
    want, path = plain("word_bpe_49k.json"), P.path("word_bpe_49k.json")
    files = token_files.write_shards(docs, path, f"{shared_dir(spark)}/records")
    got = sorted(token_files.read_shards(spark, files).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    at = 0
    left = defaultdict(list)
    for d, t in rows:
        left[d].append(zlib.crc32(np.array(want(t or "") + [1], dtype="<u4").tobytes()))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        left[r.doc_id].remove(r.ids_crc32)
    f = files.orderBy("shard").first()
    first = list(token_files.read_file(f.file))
    for k in random.Random(2).sample(range(f.records), min(5, f.records)):
        d, ids = token_files.read_record(f.file, k)
        assert d == first[k][0] and (ids == first[k][1]).all()
    empty = token_files.write_shards(no_docs, path, f"{shared_dir(spark)}/records")
    assert token_files.read_shards(spark, empty).count() == 0


def test_records_detect_damage():
    raw = token_files.record(-5, np.array([1, 70_000, 3], dtype=np.uint32))
    assert token_files.parse(raw)[0] == -5 and token_files.parse(raw)[1].tolist() == [1, 70_000, 3]
    assert token_files.parse(token_files.record(None, np.array([], dtype=np.uint32)))[0] is None
    for i in (0, 9, 14, len(raw) - 1):
        bad = bytearray(raw)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_files.parse(bytes(bad))


def test_sentence_pieces_equal_the_library_word_by_word():
    import sentencepiece

    pieces, _ = load(PIECES)
    lib = sentencepiece.SentencePieceProcessor(model_proto=pieces.unigram_model())
    codec = sentence_pieces.codec(PIECES)
    texts = [t for t in ODD if "▁" not in t] + ["naïveté", "ᚠᛇᚻ", "http://example.com/a?b=c", "🧑‍🚀"]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == lib.encode(t), t
        assert codec.decode(ids) == t
    rnd = random.Random(4)
    some = ["".join(rnd.choice("etaoinshrdluéß日😀.-") for _ in range(rnd.randint(1, 30))) for _ in range(2000)]
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in codec.encode(some)] == lib.encode(some)


def test_token_counts_equal_encoding(docs, no_docs):
    counts = Counter((r.doc_id, r.n_tokens) for r in token_counts.counted(docs, PIECES).collect())
    trips = sentence_pieces.round_trips(docs, PIECES).collect()
    assert counts == Counter((r.doc_id, r.n_tokens) for r in trips)
    assert all(r.lossless for r in trips)
    enc = sentence_pieces.encoded(docs, PIECES)
    assert Counter(r.text for r in sentence_pieces.decoded(enc, PIECES).collect()) == Counter(r.text or "" for r in docs.collect())
    assert token_counts.counted(no_docs, PIECES).count() == 0 and sentence_pieces.round_trips(no_docs, PIECES).count() == 0


def test_token_counts_on_words():
    rnd = random.Random(9)
    some = list({"".join(rnd.choice("abcé日😀") for _ in range(rnd.randint(1, 12))) for _ in range(3000)})
    ids = sentence_pieces.codec(PIECES).viterbi(["▁" + w for w in some])
    assert token_counts.counts_of(["▁" + w for w in some], PIECES).tolist() == [len(i) for i in ids]
    assert words_of(None) == [] and words_of(" ") == ["▁▁"] and words_of("a  b ") == ["▁a", "▁▁b", "▁"]


def test_heavy_digests_with_empty_partitions(spark):
    """Of 300 shuffle partitions most are empty, and stay so without adaptive execution."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 300)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        docs = spark.createDataFrame([(i, "same" if i % 2 else str(i)) for i in range(40)], "doc_id bigint, text string")
        top = exact_dedup.frequent(exact_dedup.digests(docs), 4, 64)
        assert max(r.n for r in top.collect()) == 20
        assert exact_dedup.frequent(exact_dedup.digests(docs.limit(0)), 4, 64).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
