"""Words of many texts at once as 64-bit hashes, with array operations over their bytes.

A word is a run of bytes that are not separators, with A-Z lower-cased. Its hash is a sum of
byte values from a fixed random table, weighted by powers of an odd number modulo 2**64, and
finally mixed; it depends on the word alone, so that words hash alike in every task. Texts are
taken in blocks of about BLOCK bytes cut at separators: memory follows the block, not the text.
Null counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes; a worker keeps two tables of as many 8-byte powers, and works with arrays of that size.
BLOCK = 1 << 19
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = SPACE.copy()  # any ASCII character but letters and digits
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LTABLE = _TABLE[_LOWER]
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _hash_block(block: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block that begins and ends at separators, and where they start."""
    sep = separators[block]
    edge = np.diff(np.concatenate(([True], sep, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    up, down = _power(len(block))
    total = np.zeros(len(block) + 1, dtype=np.uint64)
    np.cumsum(_LTABLE[block] * up[: len(block)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _blocks(texts: list[str | None], separators: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, bool]]:
    """(bytes, starts of the texts that begin in them); a text longer than BLOCK is spread over several."""
    parts: list[bytes] = []
    starts: list[int] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if size and size + len(raw) > BLOCK:
            yield b"".join(parts), np.asarray(starts, dtype=np.int64)
            parts, starts, size = [], [], 0
        starts.append(size)
        while len(raw) > BLOCK:
            cut = np.flatnonzero(separators[np.frombuffer(raw, dtype=np.uint8, count=BLOCK)])
            if not len(cut):  # one word beyond a block
                rest = np.flatnonzero(separators[np.frombuffer(raw, dtype=np.uint8)])
                cut = rest[:1] if len(rest) else [len(raw) - 1]
            at = int(cut[-1]) + 1
            yield b"".join([*parts, raw[:at]]), np.asarray(starts, dtype=np.int64)
            parts, starts, size, raw = [], [], 0, raw[at:]
        parts += [raw, b" "]
        size += len(raw) + 1
    if parts or starts:
        yield b"".join(parts), np.asarray(starts, dtype=np.int64)


def word_hashes(texts: list[str | None], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """All words in order, and for each text where its words start, with the total at the end."""
    found, begins, so_far = [], [], 0
    for raw, starts in _blocks(texts, separators):
        h, at = _hash_block(np.frombuffer(raw, dtype=np.uint8), separators) if raw else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        begins.append(np.searchsorted(at, starts) + so_far)
        found.append(h)
        so_far += len(h)
    return np.concatenate([*found, np.zeros(0, dtype=np.uint64)]), np.concatenate([*begins, [so_far]]).astype(np.int64)


def slices(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, list[str | None]]]:
    """(begin, end, texts) of a column's ranges with about ``size`` bytes each; only one range is in Python's hands at a time."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin = 0
    while begin < len(column):
        before = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + size, side="right")))
        yield begin, end, column.slice(begin, end - begin).to_pylist()
        begin = end


def trim() -> None:
    """Gives freed memory back, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
