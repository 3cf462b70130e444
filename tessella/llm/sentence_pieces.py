"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, many words at a time.

The path with the highest sum of log scores wins, ties going to the longer last piece. A character
that no piece of one character covers is unknown and falls back to one piece for each of its
UTF-8 bytes. Spaces become whitespace marks, one mark stands in front of a text; decoding turns marks
into spaces, takes the first away and puts bytes together. Texts are read whole; words are cached up to
CACHE entries, then the cache starts anew. Null counts as empty and gives no pieces.

A text that holds the mark character itself is decoded with a space in its place, as the library does
(``lossless`` is then false). Repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MARK, codes, load, words_of
from .words import BLOCK, slices

CACHE, LONG = 600_000, 64


class Codec:
    def __init__(self, path: str):
        self.pieces, self.trie = load(path)
        self.ids: dict[str, bytes] = {}
        self.bytes = np.array([t.encode() for t in self.pieces.text], dtype=object)
        for b, i in self.pieces.byte.items():
            self.bytes[i] = bytes([b])

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word; the words' lattices advance together, one start position at a time."""
        p, t = self.pieces, self.trie
        points, code, begin = codes(words, t)
        size = np.diff(begin)
        off = begin[:-1] + np.arange(len(words))  # a word has one more place than characters
        best = np.full(len(points) + len(words), -np.inf, dtype=np.float32)
        back = np.zeros(len(best), dtype=np.int32)
        took = np.zeros(len(best), dtype=np.int32)
        best[off] = 0
        by_size = np.argsort(-size, kind="stable")
        sorted_size = -size[by_size]
        for s in range(int(size.max(initial=0))):
            live = by_size[: np.searchsorted(sorted_size, -s)]  # words of more than s characters
            char, place, left = begin[live] + s, off[live] + s, size[live] - s
            score = best[place]
            state = np.zeros(len(live), dtype=np.int32)
            known = np.zeros(len(live), dtype=bool)
            own = np.arange(len(live))
            for d in range(min(p.longest, int(size.max()) - s)):
                on = left[own] > d
                own, state = own[on], state[on]
                state = t.step(state, code[char[own] + d])
                on = state >= 0
                own, state = own[on], state[on]
                if not len(own):
                    break
                value = t.value[state]
                end = np.flatnonzero(value >= 0)
                if d == 0:
                    known[own[end]] = True
                to = place[own[end]] + d + 1
                new = score[own[end]] + p.score[value[end]]
                up = new > best[to]
                best[to[up]], back[to[up]], took[to[up]] = new[up], d + 1, value[end][up]
            to = place[~known] + 1
            new = score[~known] + p.unknown_score
            up = new > best[to]
            best[to[up]], back[to[up]], took[to[up]] = new[up], 1, p.unknown
        return self._paths(words, points, begin, off, back, took)

    def _paths(self, words, points, begin, off, back, took) -> list[np.ndarray]:
        size = np.diff(begin)
        at, live = off + size, np.flatnonzero(size > 0)
        who, what, where = [], [], []
        while len(live):
            who.append(live)
            what.append(took[at[live]])
            where.append(at[live])
            at[live] -= back[at[live]]
            live = live[at[live] > off[live]]
        if not who:
            return [np.zeros(0, dtype="<u4")] * len(words)
        who, what, where = (np.concatenate(x) for x in (who, what, where))
        order = np.argsort(where, kind="stable")
        who, what, where = who[order], what[order].astype("<u4"), where[order]
        cut = np.searchsorted(who, np.arange(len(words) + 1))
        out = [what[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        odd = np.flatnonzero(what == self.pieces.unknown)
        for w in np.unique(who[odd]):
            ids = []
            for i in range(cut[w], cut[w + 1]):
                if what[i] == self.pieces.unknown:
                    ids += [self.pieces.byte[b] for b in chr(points[where[i] - w - 1]).encode("utf-8", "replace")]
                else:
                    ids.append(int(what[i]))
            out[w] = np.array(ids, dtype="<u4")
        return out

    def _learn(self, words: list[str]) -> None:
        for part in ([w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]):
            for i in range(0, len(part), 50_000):
                some = part[i : i + 50_000]
                self.ids.update(zip(some, [x.tobytes() for x in self.viterbi(some)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.ids) > CACHE:
            self.ids.clear()
        cut = [words_of(t) for t in texts]
        new = set().union(*cut)
        new.difference_update(self.ids)
        self._learn(list(new))
        get = self.ids.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        for w in new:
            if len(w) > 4 * LONG:
                del self.ids[w]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(self.bytes[np.frombuffer(ids, dtype="<u4")]).decode("utf-8", "replace").replace(MARK, " ")
        return raw[1:] if raw[:1] == " " else raw




_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, a binary of little-endian unsigned 32-bit piece ids."""

    def run(batches):
        c = codec(path)
        for b in batches:
            for i, j, texts in slices(b.column(1), 16 * BLOCK):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(c.encode(texts), pa.binary())], names=["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id bigint, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and lossless: each text encoded, decoded and compared."""

    def run(batches):
        c = codec(path)
        for b in batches:
            doc = b.column(0)
            for i, j, texts in slices(b.column(1), 16 * BLOCK):
                ids = c.encode(texts)
                back = [c.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    doc.slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()), pa.array([t == (x or "") for t, x in zip(back, texts, strict=True)], pa.bool_()),
                ], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean")


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
