"""Random-indexing word vectors pooled per document, and a two-layer numpy network with a calibrated temperature.

Used by the quality classifier and by the soft memberships of mixing. Fitting takes a bounded sample of labelled
rows (``max_rows``); applying the model is a scalar Arrow UDF over every whole text.
"""

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, forget, remembered, saved

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SHAPES = ("<lower>", "<Title>", "<UPPER>", "<miXed>", "<digits>", "<symbols>")
#: Rows per block when partial sums of word vectors are merged.
BLOCK = 1024


def shape_of(token: str) -> int:
    c = token[0]
    if not c.isalpha():
        return 4 if c.isdigit() else 5
    if token.islower():
        return 0
    if token.isupper() and len(token) > 1:
        return 2
    return 1 if token.istitle() else 3


class Lookup:
    """Rows of a text's tokens; unknown tokens share the row of their shape.

    No token reaches across white space, so a text's rows are those of its words, in order. The first words seen are
    remembered with their rows, up to a bound.
    """

    def __init__(self, words: list[str], room: int = 200_000):
        cells = np.arange(len(SHAPES) + len(words), dtype=np.int32).tobytes()
        cells = [cells[i : i + 4] for i in range(0, len(cells), 4)]
        self.shapes, self.known = cells[: len(SHAPES)], dict(zip(words, cells[len(SHAPES) :]))
        self.seen: dict[str, bytes] = {}
        self.room = room

    def word(self, word: str) -> bytes:
        out = self.known.get(word) if word.isalpha() else b"".join([self.known.get(t) or self.shapes[shape_of(t)] for t in TOKEN.findall(word)])
        out = out or self.shapes[shape_of(word)]
        if self.room and len(word) <= 64:
            self.room -= 1
            self.seen[word] = out
        return out

    def rows(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        got = list(map(self.seen.get, words))
        if None in got:
            got = [self.word(w) if g is None else g for w, g in zip(words, got)]
        return np.frombuffer(b"".join(got), np.int32)


def lookup_of(words: list[str], key: int) -> Lookup:
    """The worker's lookup for the words that key stands for."""
    return remembered(("lookup", key), lambda: Lookup(words))


def index_vectors(n: int, dim: int, seed: int = 20) -> np.ndarray:
    """Sparse ternary index vectors: eight entries of +1 or -1 a row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.float32)
    for _ in range(8):
        out[np.arange(n), rng.integers(0, dim, n)] += rng.choice(np.float32([-1, 1]), n)
    return out


def pool(vectors: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean word vector, and mean weighted towards rarer words; long documents are summed in slices.

    A document without tokens gets zeros.
    """
    dim = vectors.shape[1]
    total, mass = np.zeros(2 * dim), 1e-9
    for i in range(0, len(rows), 1 << 15):
        part = rows[i : i + (1 << 15)]
        v, w = vectors[part], weights[part]
        total[:dim] += v.sum(axis=0)
        total[dim:] += w @ v
        mass += float(w.sum())
    total[:dim] /= max(1, len(rows))
    total[dim:] /= mass
    return total.astype(np.float32)


def context_sums(index: np.ndarray, rows: np.ndarray, sums: np.ndarray, window: int = 2) -> None:
    """Add to each word's row the index vectors of itself and of the words up to ``window`` away."""
    for i in range(0, len(rows), 1 << 15):
        part = rows[max(0, i - window) : i + (1 << 15) + window]
        own = index[part]
        around = own.copy()
        for k in range(1, window + 1):
            around[k:] += own[:-k] if k < len(own) else 0
            around[:-k] += own[k:] if k < len(own) else 0
        lo, hi = min(i, window), min(len(rows), i + (1 << 15)) - max(0, i - window)
        part, around = part[lo:hi], around[lo:hi]
        order = np.argsort(part, kind="stable")
        words, starts = np.unique(part[order], return_index=True)
        sums[words] += np.add.reduceat(around[order], starts, axis=0)


@dataclass
class Network:
    """Two-layer network over standardised features; probabilities are divided by a temperature fitted on a held fold."""

    mean: np.ndarray
    std: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.std) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x).astype(np.float64) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_network(x: np.ndarray, y: np.ndarray, classes: int, hidden: int = 32, epochs: int = 60, seed: int = 2) -> Network:
    """Adam on mini-batches of four fifths of the rows; the last fifth sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x.mean(0), x.std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, classes)), np.zeros(classes))
    names = ("w1", "b1", "w2", "b2")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            z = (x[batch] - net.mean) / net.std
            h = np.tanh(z @ net.w1 + net.b1)
            p = h @ net.w2 + net.b2
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            dh = (p @ net.w2.T) * (1 - h * h)
            grads = {"w1": z.T @ dh + 1e-4 * net.w1, "b1": dh.sum(0), "w2": h.T @ p + 1e-4 * net.w2, "b2": p.sum(0)}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(net, k, getattr(net, k) - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    if len(held):
        z, best = net.logits(x[held]), np.inf
        for t in np.geomspace(0.25, 8, 61):
            s = z / t
            nll = float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(held)), y[held]]))
            if nll < best:
                best, net.temperature = nll, float(t)
    return net


@dataclass
class TextModel:
    """Word rows, word vectors and network; ``constant`` replaces them where the sample has fewer than two classes."""

    classes: list
    constant: list | None
    words: list[str] | None = None
    vectors: np.ndarray | None = None
    weights: np.ndarray | None = None
    network: Network | None = None


def fit(sample: DataFrame, *, vocabulary: int = 8192, dim: int = 64, parts: int = 16) -> TextModel:
    """Fit on a sample (text, y) whose row count the caller bounds; y is a string or an integer, null rows are ignored.

    Word counts and context sums are gathered on executors. What reaches the driver is bounded: ``vocabulary`` word
    vectors and one pooled vector for each sample row.
    """
    spark = sample.sparkSession
    bound_batches(spark)
    sample = saved(sample.where("y is not null").select("text", "y").repartition(parts), "fit-sample")
    counts = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    classes = sorted(counts)
    if len(classes) < 2 or sum(counts.values()) < 20:
        total = sum(counts.values())
        return TextModel(classes, [counts[c] / total for c in classes])

    def count_words(batches):
        from collections import Counter

        seen: Counter = Counter()
        for b in batches:
            for text in b.text:
                seen.update((text or "").split())
        words, seen = seen, Counter()
        for word, n in words.items():
            for token in TOKEN.findall(word):
                seen[token] += n
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    top = sample.select("text").mapInPandas(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3 and length(word) <= 40")
    best = top.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    words = [r.word for r in best]
    share = np.array([r.n for r in best], np.float64) / max(1, sum(r.n for r in best))
    weights = np.concatenate([np.full(len(SHAPES), 0.01), 1e-3 / (1e-3 + share)]).astype(np.float32)
    rows = len(SHAPES) + len(words)
    shared = spark.sparkContext.broadcast(words)
    key = uuid.uuid4().int

    def sum_contexts(batches):
        lookup, index = lookup_of(shared.value, key), index_vectors(rows, dim)
        sums = np.zeros((rows, dim), np.float32)
        for b in batches:
            for text in b.text:
                context_sums(index, lookup.rows(text), sums)
        yield pd.DataFrame([{"block": i, "data": sums[i : i + BLOCK].tobytes()} for i in range(0, rows, BLOCK)])

    def merge(block):
        total = sum(np.frombuffer(x, np.float32) for x in block.data)
        return pd.DataFrame({"block": block.block.iloc[:1], "data": [total.tobytes()]})

    blocks = sample.select("text").mapInPandas(sum_contexts, "block int, data binary").groupBy("block").applyInPandas(merge, "block int, data binary")
    sums = np.concatenate([np.frombuffer(r.data, np.float32).reshape(-1, dim) for r in blocks.orderBy("block").collect()])
    unit = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-6)
    unit = unit - unit.mean(0)
    own = index_vectors(rows, dim)
    vectors = (unit / (np.linalg.norm(unit, axis=1, keepdims=True) + 1e-6) + own / np.linalg.norm(own, axis=1, keepdims=True).clip(1e-6)).astype(np.float32)
    known = spark.sparkContext.broadcast(vectors)

    def pooled(batches):
        lookup = lookup_of(shared.value, key)
        for b in batches:
            yield pd.DataFrame({"x": [pool(known.value, weights, lookup.rows(t)).tobytes() for t in b.text], "y": b.y.astype(str)})

    got = sample.mapInPandas(pooled, "x binary, y string").collect()
    shared.destroy()
    known.destroy()
    forget(sample)
    got.sort(key=lambda r: bytes(r.x))
    names = {str(c): i for i, c in enumerate(classes)}
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(np.float64)
    return TextModel(classes, None, words, vectors, weights, fit_network(x, np.array([names[r.y] for r in got]), len(classes)))


def scorer(model: TextModel, spark):
    """A UDF from text to (n_tokens, probabilities in the order of model.classes)."""
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().int
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(schema)
    def score(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        if m.constant is not None:
            return pd.DataFrame({"n_tokens": [len(TOKEN.findall(t or "")) for t in texts], "p": [m.constant] * len(texts)})
        lookup = lookup_of(m.words, key)
        rows = [lookup.rows(t) for t in texts]
        p = m.network.probabilities(np.stack([pool(m.vectors, m.weights, r) for r in rows]).astype(np.float64))
        return pd.DataFrame({"n_tokens": [len(r) for r in rows], "p": list(p)})

    return score
