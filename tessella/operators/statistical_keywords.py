"""Keywords from the statistics of a single text (casing, position, frequency, relatedness, dispersion), after the published YAKE method.

A term's weight is small when it is important:

    S = relatedness * position / (casing + frequency / relatedness + dispersion / relatedness)

* casing: the larger of its counts as an acronym and as a capitalised word inside a sentence, over 1 + ln(count);
* position: ln(ln(3 + the median number of the sentences it stands in));
* frequency: count over mean plus standard deviation of the counts of terms that are no stop words;
* relatedness: 1 + (different left neighbours / all left neighbours + the same to the right) * count / largest count;
* dispersion: the share of sentences it stands in.

A keyword of up to three terms has the product of its terms' weights over its count times 1 + their sum; a stop word inside it counts by how
often its neighbours follow each other through it. The k keywords of least weight are taken in turn, without those that are too like one taken
before (edit similarity above 0.9). Each text is worked out by itself, in the task that reads it; nothing is shuffled.

Sentences end at .!? marks; other punctuation ends a run of neighbours. Numbers and words with other characters inside take no part in keywords.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STOP_WORDS

LONGEST, ALIKE, K, SHORT = 3, 0.9, 10, 3
_SENTENCE, _RUN, _TOKEN = re.compile(r"[.!?]+"), re.compile(r"[^\w\s'-]+"), re.compile(r"[\w'-]+")


@lru_cache(100_000)
def _kinds(w: str) -> tuple[tuple[str, str], tuple[str, str]] | None:
    """(term, kind) inside a sentence and at its start; nothing without letters or digits."""
    w = w.strip("'-")
    if not w:
        return None
    kind = "x" if not w.replace("-", "").replace("'", "").isalpha() else "a" if len(w) > 1 and w.isupper() else "n" if w[0].isupper() else "p"
    return (w.lower(), kind), (w.lower(), "p" if kind == "n" else kind)


def runs(text: str) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(number of the sentence, [(term, kind)]) for each run without punctuation. Kinds: a acronym, n capitalised inside a sentence, p plain, x neither."""
    number = 0
    for sentence in _SENTENCE.split(text):
        first, seen = True, False
        for part in _RUN.split(sentence):
            run = []
            for w in _TOKEN.findall(part):
                plain = _kinds(w)
                if plain is None:
                    continue
                run.append(plain[first])
                first, seen = False, True
            if run:
                yield number, run
        number += seen


def term_weights(found: list[tuple[int, list[tuple[str, str]]]], stop: frozenset[str]) -> tuple[dict[str, float], Counter]:
    """Weights of terms that are no stop words, and counts of neighbours (left, right)."""
    cased, places, pairs = Counter(), defaultdict(list), Counter()
    for number, run in found:
        cased.update(run)
        for t, _ in run:
            places[t].append(number)
        pairs.update([(a, b) for (a, x), (b, y) in zip(run, run[1:], strict=False) if x != "x" and y != "x"])
    count = {t: len(p) for t, p in places.items()}
    left, right, lefts, rights = Counter(), Counter(), Counter(), Counter()  # all and different neighbours
    for (a, b), n in pairs.items():
        left[b] += n
        lefts[b] += 1
        right[a] += n
        rights[a] += 1
    terms = [t for t in count if t not in stop and len(t) >= SHORT and not cased[t, "x"]]
    if not terms:
        return {}, pairs
    tf = np.array([count[t] for t in terms], dtype=float)
    usual, most, sentences = tf.mean() + tf.std(), max(count.values()), max(n for n, _ in found) + 1
    share = lambda different, every: different / every if every else 0.0
    out = {}
    for t in terms:
        case = max(cased[t, "a"], cased[t, "n"]) / (1 + math.log(count[t]))
        p = places[t]  # ascending
        position = math.log(math.log(3 + (p[(len(p) - 1) // 2] + p[len(p) // 2]) / 2))
        related = 1 + (share(lefts[t], left[t]) + share(rights[t], right[t])) * count[t] / most
        out[t] = related * position / (case + count[t] / usual / related + len(set(places[t])) / sentences / related)
    return out, pairs


def keyword_weights(text: str, stop: frozenset[str], longest: int = LONGEST) -> dict[str, float]:
    """keyword: weight, lower is better."""
    found = list(runs(text))
    weight, pairs = term_weights(found, stop)
    if not weight:
        return {}
    after, before = Counter(), Counter()
    for (a, b), n in pairs.items():
        after[a] += n
        before[b] += n
    count = Counter()
    for _, run in found:
        terms, ends = tuple(t for t, _ in run), [k != "x" and t in weight for t, k in run]
        stops = [k == "x" for _, k in run]
        for i, begins in enumerate(ends):
            if begins:
                for j in range(i, min(i + longest, len(run))):
                    if stops[j]:
                        break
                    if ends[j]:
                        count[terms[i : j + 1]] += 1
    out = {}
    for words, n in count.items():
        product, total = 1.0, 0.0
        for i, t in enumerate(words):
            if t in weight:
                product *= weight[t]
                total += weight[t]
            else:  # inside, as both ends have weights
                through = pairs[words[i - 1], t] / after[words[i - 1]] * pairs[t, words[i + 1]] / before[words[i + 1]]
                product *= 1 + (1 - through)
                total -= 1 - through
        out[" ".join(words)] = product / (n * (1 + total)) if total != -1 else product
    return out


def _alike(a: str, b: str, alike: float) -> bool:
    """Whether the edit similarity is above ``alike``; its bounds, which cost less, come first."""
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() > alike and m.quick_ratio() > alike and m.ratio() > alike


def _in_order(weights: dict[str, float], digits: int) -> Iterator[tuple[float, str]]:
    """By rounded weight, then name. Rounding keeps the order, so only what is taken is rounded."""
    for w, equal in groupby(sorted(weights.items(), key=itemgetter(1)), lambda x: round(x[1], digits)):
        yield from ((w, name) for name in sorted(name for name, _ in equal))


def top_keywords(text: str, stop: frozenset[str], k: int = K, longest: int = LONGEST, alike: float = ALIKE, digits: int = 9) -> list[tuple[str, float]]:
    taken: list[tuple[str, float]] = []
    for w, name in _in_order(keyword_weights(text, stop, longest), digits):
        if len(taken) == k:
            break
        if not any(_alike(name, other, alike) for other, _ in taken):
            taken.append((name, w))
    return taken


def keywords(docs: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", stop=STOP_WORDS, longest: int = LONGEST, alike: float = ALIKE) -> DataFrame:
    """doc_id, keyword, score (lower is better), rank: the best keywords of each text. Null and empty texts have none."""
    words = frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [(i, name, w, r) for i, t in enumerate(b.column(1)) for r, (name, w) in enumerate(top_keywords(t.as_py(), words, k, longest, alike), 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], names=[doc_id, "keyword", "score", "rank"])

    rows = docs.select(doc_id, F.col(text).alias("_text")).where("_text IS NOT NULL")
    return rows.mapInArrow(run, T.StructType([docs.schema[doc_id], T.StructField("keyword", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
