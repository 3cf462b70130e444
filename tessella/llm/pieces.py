"""Unigram pieces of a SentencePiece model file: log scores, and a double-array trie over their characters.

The file at hand ranks its pieces for merging and holds no probabilities, and tokenizers are
not trained here. The log score of a piece is therefore set by rule: Zipf's law over the rank,
-log(1 + rank) - log(H), rank by the file's own score, then id. ``unigram_model`` writes the same
pieces and scores as a unigram model file, so that the sentencepiece library can be asked for comparison.
"""

from __future__ import annotations

import struct

import numpy as np

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"  # stands for a space


def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    """(number, wire type, begin of the field, begin and end of its value) of a serialized message."""
    i = 0
    while i < len(b):
        at = i
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 2:
            n, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(kind, 0) or _varint(b, i)[1] - i
        yield tag >> 3, kind, at, i, i + n
        i += n


class Pieces:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.raw = f.read()
        self.text: list[str] = []
        merge, self.kind = [], []
        for number, _, _, i, j in _fields(self.raw):
            if number != 1:
                continue
            body, text, score, kind = self.raw[i:j], "", 0.0, NORMAL
            for n, _, _, x, y in _fields(body):
                if n == 1:
                    text = body[x:y].decode()
                elif n == 2:
                    score = struct.unpack("<f", body[x:y])[0]
                elif n == 3:
                    kind = _varint(body, x)[0]
            self.text.append(text)
            merge.append(score)
            self.kind.append(kind)
        own = [i for i, k in enumerate(self.kind) if k in (NORMAL, USER, UNUSED)]
        own.sort(key=lambda i: (-merge[i], i))
        total = np.log(np.sum(1 / np.arange(1, len(own) + 1)))
        self.score = np.zeros(len(self.text), dtype=np.float32)
        self.score[own] = (-np.log(np.arange(1, len(own) + 1)) - total).astype(np.float32)
        self.in_trie = sorted(own)
        self.unknown = next(i for i, k in enumerate(self.kind) if k == UNKNOWN)
        self.unknown_score = np.float32(self.score[own].min() - np.float32(10))
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.longest = max(len(self.text[i]) for i in self.in_trie)

    def unigram_model(self) -> bytes:
        out = []
        n = 0
        for number, _, at, i, j in _fields(self.raw):
            if number == 1:
                body = b""
                for k, _, x, y, z in _fields(self.raw[i:j]):
                    part = self.raw[i + x : i + z]
                    body += b"" if k == 2 else part
                body += b"\x15" + struct.pack("<f", float(self.score[n]))
                out.append(b"\x0a" + bytes([len(body)]) + body if len(body) < 128 else b"\x0a" + bytes([len(body) & 127 | 128, len(body) >> 7]) + body)
                n += 1
            elif number == 2:
                body = b"".join(b"\x18\x01" if k == 3 else self.raw[i + x : i + z] for k, _, x, _, z in _fields(self.raw[i:j]))
                size = bytes([len(body)]) if len(body) < 128 else bytes([len(body) & 127 | 128, len(body) >> 7])
                out.append(b"\x12" + size + body)
            else:
                out.append(self.raw[at:j])
        return b"".join(out)


class DoubleArray:
    """base and check arrays; ``value`` has the piece id at nodes that end a piece, else -1. Root: 0."""

    def __init__(self, pieces: Pieces):
        chars = sorted({c for i in pieces.in_trie for c in pieces.text[i]})
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i in pieces.in_trie:
            node = 0
            for c in pieces.text[i]:
                k = int(self.code[ord(c)])
                if k not in tree[node]:
                    tree[node][k] = len(tree)
                    tree.append({})
                node = tree[node][k]
            ends[node] = i
        self._place(tree, ends, len(chars))

    def _place(self, tree: list[dict[int, int]], ends: dict[int, int], chars: int) -> None:
        """Nodes with many children first, each at the first base where all its children fit; those with one fill the gaps."""
        size = 2 * len(tree) + 4 * chars + 4096
        used = np.zeros(size, dtype=bool)
        used[0] = True
        base = np.zeros(len(tree), dtype=np.int64)
        where = np.zeros(len(tree), dtype=np.int64)
        inner = sorted((i for i in range(len(tree)) if tree[i]), key=lambda i: -len(tree[i]))
        low = 1
        for node in (i for i in inner if len(tree[i]) > 1):
            kids = np.sort(np.fromiter(tree[node], dtype=np.int64))
            begin, span = low, 2048
            while True:
                if begin + span + chars >= len(used):
                    used = np.pad(used, (0, len(used)))
                free = np.flatnonzero(~used[begin : begin + span]) + begin
                if begin == low and len(free) < span // 20:
                    low += span
                b = free[free > kids[0]] - kids[0]
                fit = np.flatnonzero(~used[b[:, None] + kids].any(1))
                if len(fit):
                    break
                begin, span = begin + span, span * 2
            base[node] = b[fit[0]]
            used[base[node] + kids] = True
            where[[tree[node][int(k)] for k in kids]] = base[node] + kids
        single = [i for i in inner if len(tree[i]) == 1]
        used = np.pad(used, (0, len(single) + chars))
        free = np.flatnonzero(~used[chars + 1 :])[: len(single)] + chars + 1
        used[free] = True
        for node, p in zip(single, free.tolist(), strict=True):
            ((k, child),) = tree[node].items()
            base[node], where[child] = p - k, p
        last = int(np.flatnonzero(used).max()) + chars + 2
        self.base, self.check, self.value = np.zeros(last, dtype=np.int32), np.full(last, -1, dtype=np.int32), np.full(last, -1, dtype=np.int32)
        self.base[where] = base
        for node in inner:
            self.check[where[list(tree[node].values())]] = where[node]
        self.value[where[list(ends)]] = list(ends.values())

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none; states must be nodes."""
        to = self.base[state] + code
        return np.where((code > 0) & (self.check[to] == state) & (to > 0), to, -1)


_loaded: dict[str, tuple[Pieces, DoubleArray]] = {}


def load(path: str) -> tuple[Pieces, DoubleArray]:
    """One for each Python worker."""
    if path not in _loaded:
        pieces = Pieces(path)
        _loaded[path] = pieces, DoubleArray(pieces)
    return _loaded[path]


def words_of(text: str | None) -> list[str]:
    """Pre-tokens, each with its marks in front: no piece has a mark behind another character, so none crosses their borders."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return [MARK + w for w in text.split(" ")]
    out: list[str] = []
    marks = MARK
    for w in text.replace(MARK, " ").split(" "):
        if w:
            out.append(marks + w)
            marks = MARK
        else:
            marks += MARK
    if len(marks) > 1 or not out:
        out.append(marks[:-1] or MARK)
    return out


def codes(words: list[str], trie: DoubleArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and trie codes of all words' characters, and the words' offsets."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))])
    return points, trie.code[points], begin
