"""Toxicity: a convolutional text classifier in numpy, scored over whole texts.

Words (runs of letters, digits and non-ASCII characters, lower-cased) have hashed embeddings:
the sum of a row from each of two tables, so that two words rarely share both. Filters of
widths 1, 2 and 3 run over them, each filter keeps its maximum over the text, and a logistic layer
joins the maxima. Training is stochastic gradient descent (Adagrad) on the driver over a
bounded sample: at most ``per_class`` rows of each label, those with the smallest hash of their id, of
texts up to ``max_chars`` characters. One embedding coordinate starts from the words' smoothed log odds;
words of fewer than MIN_TEXTS texts of the sample, or whose share among toxic texts is within MIN_Z standard
errors of their share overall, keep a zero embedding (told by a hashed gate), so that no single text is learnt
by heart and rare words of long texts do not pass for others.

Thresholds are calibrated by language on held-back rows of that sample. The language of a text is told
from its own function words, so that a score depends on the text alone; the score is the logistic
function of the margin over the language's threshold, hence 0.5 is the cut for every language.

Null and empty texts have no words and get the score of the bias alone. Without labelled rows of both
classes every score is 0. Repeated rows are scored alike. Rows with a null id are scored, never learnt from, and not
held out. Extra columns are ignored, and kept by ``keep_clean`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, free, small_batches, written
from .words import PUNCTUATION, slices, trim, word_hashes

ROWS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
PER_CLASS, MAX_CHARS, EPOCHS, BATCH, RATE, L2, MIN_TEXTS = 4000, 20_000, 8, 32, 0.08, 1e-4, 5
GATE, MIN_Z = 1 << 22, 3.5
#: Frequent function words of each language, for telling a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or by not but what all were when we there can an your which their if will one",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ses mais comme ou si leur y dont elle deux",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son",
}
LANGS = [*FUNCTION_WORDS]


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and the weight of each for each language (a word of several languages counts less)."""
    lists = [v.split() for v in FUNCTION_WORDS.values()]
    words = sorted({w for v in lists for w in v})
    h, _ = word_hashes(words, PUNCTUATION)
    weight = np.array([[(w in v) / sum(w in u for u in lists) for v in lists] for w in words], dtype=np.float32)
    order = np.argsort(h)
    return h[order], weight[order]


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = [rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32) for _ in range(2)]
        self.w = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.v = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        self.c = np.zeros(1, dtype=np.float32)
        self.cut = np.zeros(len(LANGS) + 1)
        self.known, self.weights = _language_table()
        self.gate = np.zeros(GATE, dtype=bool)

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        """Rows of both tables; row 0, which stays zero, for words that the sample's texts don't share."""
        own = self.gate[h % np.uint64(GATE)]
        return [np.where(own, 1 + (h >> np.uint64(k)) % np.uint64(ROWS - 1), 0).astype(np.int32) for k in (11, 37)]

    def language(self, h: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Index into LANGS for each text, len(LANGS) where no function word occurs."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[at] == h
        text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[hit]
        votes = np.stack([np.bincount(text, self.weights[at[hit], k], len(begin) - 1) for k in range(len(LANGS))], 1) if len(begin) > 1 else np.zeros((0, len(LANGS)))
        return np.where(votes.max(1, initial=0) > 0, votes.argmax(1), len(LANGS))

    def pooled(self, s: list[np.ndarray], begin: np.ndarray, where: bool = False):
        """Maxima (at least 0) of all filters for each text, and the positions of the maxima if asked for."""
        x = self.e[0][s[0]] + self.e[1][s[1]]
        n, texts = len(x), len(begin) - 1
        out = np.zeros((texts, len(self.b)), dtype=np.float32)
        at = np.full((texts, len(self.b)), -1, dtype=np.int64)
        ends = begin[1:]
        for j, k in enumerate(WIDTHS):
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            y = x @ self.w[j][0]
            for i in range(1, k):
                y[: n - i] += x[i:] @ self.w[j][i]
            for i in range(1, k):  # windows over the end of a text
                y[np.maximum(ends - i, 0)[np.diff(begin) >= i]] = -np.inf
            some = np.flatnonzero(np.diff(begin) >= k)
            if not len(some):
                continue
            top = np.maximum.reduceat(y, begin[some], axis=0)
            out[some, cols] = np.maximum(top + self.b[cols], 0)
            if where:
                for d in some:
                    at[d, cols] = begin[d] + y[begin[d] : begin[d + 1]].argmax(0)
        return (out, at) if where else out

    def logits(self, h: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.full(len(begin) - 1, float(self.c[0]))
        return self.pooled(self.slots(h), begin) @ self.v + self.c[0]

    def scores(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j, some in slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            h, begin = word_hashes(some, PUNCTUATION)
            margin = self.logits(h, begin).astype(np.float64) - self.cut[self.language(h, begin)]
            out[i:j] = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return out


def _start(m: Model, docs: list[np.ndarray], y: np.ndarray) -> None:
    """Opens the gate for words that tell the classes apart; sets the first coordinate to the log odds."""
    n = np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    each = [np.unique(h) for h in docs]
    words, inv = np.unique(np.concatenate(each), return_inverse=True)
    bad = np.bincount(inv, np.repeat(y, [len(h) for h in each]), len(words))
    count = np.bincount(inv, minlength=len(words))
    share = count / n.sum()
    z = (bad - n[1] * share) / np.sqrt(np.maximum(n[1] * share * (1 - share) * n[0] / n.sum(), 1e-9))
    m.gate[words[(count >= MIN_TEXTS) & (np.abs(z) >= MIN_Z)] % np.uint64(GATE)] = True
    for t in range(2):
        count = np.zeros((2, ROWS))
        for h, label in zip(docs, y, strict=True):
            count[int(label), np.unique(m.slots(h)[t])] += 1
        odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
        m.e[t][:, 0] = np.clip(odds, -4, 4) * 0.25
        m.e[t][0] = 0
    m.w[0][0, 0, :2] = 1.0
    m.v[:2] = 1.0
    m.b[:2] = -0.5


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """labels: 0 or 1. Every fifth text, by its place, is held back for the thresholds."""
    m = Model(seed)
    if not len(labels) or labels.min() == labels.max():
        m.v[:], m.c[:], m.cut[:] = 0, -40, 0
        return m
    h, begin = word_hashes(texts, PUNCTUATION)
    docs = [h[i:j] for i, j in zip(begin, begin[1:], strict=False)]
    back = np.arange(len(docs)) % 5 == 4
    fit = np.flatnonzero(~back)
    _start(m, [docs[i] for i in fit], labels[fit])
    params = [*m.w, m.b, m.v, m.c]
    memory = [np.full_like(p, 1e-2) for p in params]
    seen = [np.full((ROWS, DIM), 1e-2, dtype=np.float32) for _ in m.e]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            part = fit[i : i + BATCH]
            hs = np.concatenate([docs[d] for d in part])
            if not len(hs):
                continue
            b = np.concatenate([[0], np.cumsum([len(docs[d]) for d in part])])
            s = m.slots(hs)
            pool, at = m.pooled(s, b, where=True)
            p = 1 / (1 + np.exp(-np.clip(pool @ m.v + m.c[0], -30, 30)))
            g = ((p - labels[part]) / len(part)).astype(np.float32)
            up = np.where((pool > 0) & (at >= 0), g[:, None] * m.v, 0).astype(np.float32)
            grads = [np.zeros_like(w) for w in m.w] + [up.sum(0), pool.T @ g + L2 * m.v, np.array([g.sum()], dtype=np.float32)]
            rows, moves = [], []
            for j, k in enumerate(WIDTHS):
                d, f = np.nonzero(up[:, j * FILTERS : (j + 1) * FILTERS])
                pos, gain = at[d, j * FILTERS + f], up[d, j * FILTERS + f]
                for o in range(k):
                    x = m.e[0][s[0][pos + o]] + m.e[1][s[1][pos + o]]
                    np.add.at(grads[j][o].T, f, gain[:, None] * x)
                    rows.append(pos + o)
                    moves.append(gain[:, None] * m.w[j][o][:, f].T)
            for x, old, dx in zip(params, memory, grads, strict=True):
                old += dx * dx
                x -= RATE * dx / np.sqrt(old)
            if rows:
                at_, move = np.concatenate(rows), np.concatenate(moves)
                for t in range(2):
                    own, inv = np.unique(s[t][at_], return_inverse=True)
                    total = np.zeros((len(own), DIM), dtype=np.float32)
                    np.add.at(total, inv, move)
                    total[own == 0] = 0
                    seen[t][own] += total * total
                    m.e[t][own] -= RATE * total / np.sqrt(seen[t][own])
    _calibrate(m, [docs[i] for i in np.flatnonzero(back)], labels[back])
    del h, docs, seen
    trim()  # the driver goes on without what training took
    return m


def _calibrate(m: Model, docs: list[np.ndarray], y: np.ndarray) -> None:
    """The cut with the best F1 on held-back rows of a language, in the middle of the gap that gives it; all rows' cut for a language with few."""
    if not len(docs):
        return
    h, begin = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    z, lang = m.logits(h, begin).astype(np.float64), m.language(h, begin)

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-z, kind="stable")
        zs, hits = z[order], np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
        k = int(f1.argmax())
        return float((zs[k] + (zs[k + 1] if k + 1 < len(zs) else zs[k] - 1)) / 2)

    m.cut[:] = best(z, y) if y.any() else 0
    for k in range(len(LANGS)):
        own = lang == k
        if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10:
            m.cut[k] = best(z[own], y[own])


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray]:
    """At most 2 * per_class labelled texts whose crc32(id) is not divisible by 5; labels must be 0 or 1."""
    key = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (key % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    part = [known.where(F.col("__toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    own = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(part[0].unionAll(part[1])), "doc_id")
    rows = own.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class).select("text", F.col("__toxic").alias("y")).toPandas()
    return rows["text"].tolist(), rows["y"].to_numpy(dtype=np.float64)


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score: str = "toxicity") -> DataFrame:
    """The columns in ``keep`` and one named by ``score`` (double), which no column in keep may be named."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 8 MB, whatever the input
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for b in batches:
            s = shared.value.scores(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names[:-1], "score"])
        trim()

    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1])] + ["score double"])
    return rows.mapInArrow(run, schema).toDF(*keep, score)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows scored below 0.5, with their columns, whatever these are named. Rows go through once, so the session's Arrow batches stay at TEXTS rows."""
    columns, score = docs.columns, free("toxicity", docs.columns)
    small_batches(docs.sparkSession)
    return scored(docs, train(*sample(docs, labels)), score=score).where(F.col(score) < 0.5).select(*[f"`{c}`" for c in columns])


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = written(scored(docs.select("doc_id", "text"), model, keep=["doc_id"]), "scores", TEXTS)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
