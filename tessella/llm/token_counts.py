"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a block of texts, in order, form a trie. Level by level, every trie node
gets the best unigram score of its prefix and the number of tokens on that path, from the nodes
up to the longest piece above it: each shared prefix is scored once. Nodes that end a pre-token
store its count; a text's count is the sum over its pre-tokens. The piece trie's states travel down with
the nodes, so that a step costs one lookup for each open piece.

Same pieces, scores, ties, byte fallback and treatment of nulls as ``sentence_pieces``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import codes, load, words_of
from .words import BLOCK, slices

CACHE, LONG = 1_000_000, 64


def counts_of(words: list[str], path: str) -> np.ndarray:
    """Tokens of each of the distinct words."""
    p, t = load(path)
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in order]
    points, code, begin = codes(words, t)
    size = np.diff(begin)
    shared = _shared(points, begin, size)
    k, width = p.longest, len(words)
    node_of = np.zeros(width, dtype=np.int64)  # the node of each word's prefix at the level above
    state = np.zeros((1, 0), dtype=np.int32)  # a column for each start above, the nearest first
    best = np.zeros((1, 1), dtype=np.float32)  # of the node itself and of those above it
    count = np.zeros((1, 1), dtype=np.int32)
    out = np.zeros(width, dtype=np.int64)
    rows = np.flatnonzero(size > 0)
    for d in range(1, int(size.max(initial=0)) + 1):
        rows = rows[size[rows] >= d]
        new = shared[rows] < d
        new[0] = True
        first = rows[new]
        above = node_of[first]
        char = code[begin[first] + d - 1]
        old = np.concatenate([np.zeros((len(first), 1), dtype=np.int32), state[above]], 1)[:, :k]
        state = np.where(old >= 0, t.step(np.maximum(old, 0), np.broadcast_to(char[:, None], old.shape)), -1)
        value = np.where(state >= 0, t.value[state], -1)
        up_best, up_count = best[above][:, : state.shape[1]], count[above][:, : state.shape[1]]
        score = np.where(value >= 0, up_best + p.score[value], np.float32(-np.inf))
        lost = value[:, 0] < 0
        score[lost, 0] = up_best[lost, 0] + p.unknown_score
        pick = score.shape[1] - 1 - score[:, ::-1].argmax(1)  # the longest piece among equals
        at = np.arange(len(first))
        size_of = np.ones(len(first), dtype=np.int32)
        raw = lost & (pick == 0)
        point = points[begin[first] + d - 1]
        size_of[raw] = (1 + (point > 0x7F).astype(np.int32) + (point > 0x7FF) + (point > 0xFFFF))[raw]
        best = np.concatenate([score[at, pick][:, None], best[above]], 1)[:, :k]
        count = np.concatenate([(up_count[at, pick] + size_of)[:, None], count[above]], 1)[:, :k]
        node_of[rows] = np.cumsum(new) - 1
        done = rows[size[rows] == d]
        out[done] = count[node_of[done], 0]
    back = np.zeros(width, dtype=np.int64)
    back[order] = out
    return back


def _shared(points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Characters that each word shares with the one before."""
    out = np.zeros(len(size), dtype=np.int64)
    live = np.flatnonzero(np.minimum(size[1:], size[:-1]) > 0) + 1
    d = 0
    while len(live):
        live = live[points[begin[live] + d] == points[begin[live - 1] + d]]
        d += 1
        out[live] = d
        live = live[np.minimum(size[live], size[live - 1]) > d]
    return out


class Counter:
    def __init__(self, path: str):
        self.path, self.known = path, {}

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        if len(self.known) > CACHE:
            self.known.clear()
        cut = [words_of(t) for t in texts]
        new = set().union(*cut)
        new.difference_update(self.known)
        for part in ([w for w in new if len(w) <= LONG], [w for w in new if len(w) > LONG]):
            for i in range(0, len(part), 100_000):
                some = part[i : i + 100_000]
                self.known.update(zip(some, counts_of(some, self.path).tolist(), strict=True))
        get = self.known.__getitem__
        out = [sum(map(get, words)) for words in cut]
        for w in new:
            if len(w) > 4 * LONG:
                del self.known[w]
        return out, [len(words) for words in cut]


_counters: dict[str, Counter] = {}


def counted(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_pretokens."""

    def run(batches):
        c = _counters.setdefault(path, Counter(path))
        for b in batches:
            doc = b.column(0)
            for i, j, texts in slices(b.column(1), 16 * BLOCK):
                n, words = c.count(texts)
                yield pa.RecordBatch.from_arrays([doc.slice(i, j - i), pa.array(n, pa.int64()), pa.array(words, pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_pretokens bigint")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
