"""Quality classifier: random-indexing word vectors, pooled per document, and a calibrated two-layer network."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_text, small_batches

#: Rows of the word table (words are hashed to rows) and the length of a vector.
ROWS, DIM = 1 << 15, 32
#: Places of an index vector that are not zero, and how far a word's context reaches.
NONZERO, WINDOW = 4, 2
#: Words whose rows a task remembers; words of a text that are looked up at a time.
MEMO, BLOCK = 300_000, 1 << 16
HIDDEN = 24
THRESHOLD = 0.3

# ASCII classes of a word's shape; longer characters count as lower-case letters.
_CLASS = bytes(120 if c >= 128 or 97 <= c <= 122 else 88 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class Words:
    """Rows of a text's words, and of their shapes (case, digits and marks, runs as one)."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}  # the row, then the shape's row, as one number

    def rows(self, words: list[bytes]) -> np.ndarray:
        try:
            both = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in set(words) if w not in self.memo]
            if len(new) + len(self.memo) > MEMO:
                self.memo.clear()
                new = set(words)
            h = xxhash.xxh64_intdigest
            for w in new:
                shape = _RUN.sub(rb"\1", w[:64].translate(_CLASS))
                self.memo[w] = h(w.lower(), 1) % ROWS * ROWS + h(shape, 2) % ROWS
            both = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return np.stack([both // ROWS, both % ROWS], axis=1)


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's sparse random vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))


class Sums:
    """For each row of the word table the sum of its neighbours' index vectors, over all texts added; whole numbers."""

    def __init__(self):
        self.places, self.signs = index_vectors()
        self.total, self.know = np.zeros(ROWS * DIM), Words()
        self.word, self.near, self.held = [], [], 0

    def add(self, text: str | None) -> None:
        words = (text or "").encode("utf-8", "replace").split()
        for at in range(0, len(words), BLOCK):
            ids = self.know.rows(words[at : at + BLOCK + WINDOW])[:, 0]  # the next block's first words are neighbours too
            for k in range(1, WINDOW + 1):
                a = ids[: min(BLOCK, max(0, len(ids) - k))]
                b = ids[k : k + len(a)]
                self.word += [a, b]
                self.near += [b, a]
            self.held += len(ids)
            if self.held >= 4 * BLOCK:
                self.flush()

    def flush(self) -> None:
        if self.word:
            word, near = np.concatenate(self.word) * DIM, np.concatenate(self.near)
            for k in range(NONZERO):
                self.total += np.bincount(word + self.places[near, k], self.signs[near, k], ROWS * DIM)
        self.word, self.near, self.held = [], [], 0


def corpus_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The sums over all whole documents, labelled or not: each task sends its rows once, and they are added up by row."""
    names = [f"v{k}" for k in range(DIM)]
    small_batches(docs.sparkSession)

    def run(batches):
        sums = Sums()
        for b in batches:
            for t in b.column(0).to_pylist():
                sums.add(t)
        sums.flush()
        total = sums.total.astype(np.int64).reshape(ROWS, DIM)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, k]) for k in range(DIM)]], names=["row", *names])

    parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, ", ".join(f"{n} long" for n in ["row", *names]))
    found = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    total = np.zeros((ROWS, DIM))
    total[found.column("row").to_numpy()] = np.stack([found.column(n).to_numpy() for n in names], axis=1)
    return total


class Vectors:
    """A word's vector is the sum of the index vectors of its neighbours, at unit length; rare ones are shorter."""

    def __init__(self, words: np.ndarray, index: np.ndarray):
        self.words, self.index = words, index

    @classmethod
    def of(cls, total: np.ndarray) -> Vectors:
        """total: the sums of `Sums`, over all documents."""
        places, signs = index_vectors()
        each = (np.arange(ROWS)[:, None] * DIM + places).ravel()
        index = np.bincount(each, signs.ravel(), ROWS * DIM).reshape(ROWS, DIM)
        return cls((total / (np.linalg.norm(total, axis=1, keepdims=True) + 4)).astype(np.float32), (index / np.sqrt(NONZERO)).astype(np.float32))

    def pool(self, text: str | None, know: Words) -> np.ndarray:
        """Means of word vectors and of shape index vectors, and how concentrated the words are; zeros for no words."""
        words = (text or "").encode("utf-8", "replace").split()
        n = len(words)
        if not n:
            return np.zeros(2 * DIM + 4, np.float32)
        mean, shape, own = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
        for at in range(0, n, BLOCK):
            rows = know.rows(words[at : at + BLOCK])
            mean += self.words[rows[:, 0]].sum(axis=0, dtype=np.float64)
            own += self.index[rows[:, 0]].sum(axis=0, dtype=np.float64)
            shape += self.index[rows[:, 1]].sum(axis=0, dtype=np.float64)
        lines = [x for x in (text or "").split("\n") if x]
        rest = [np.log1p(n) / 8, len(set(words)) / n, float(np.linalg.norm(own) / n), len(set(lines)) / max(1, len(lines))]
        return np.concatenate([mean / n, shape / n, rest]).astype(np.float32)


class Network:
    """tanh layer and a logistic output; the logit is divided by a temperature that left-out rows chose."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 40, rate: float = 0.003, decay: float = 1e-4) -> Network:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        apart, train = order[: len(x) // 6], order[len(x) // 6 :]
        mean, scale = x[train].mean(0), x[train].std(0) + 1e-3
        z = (x - mean) / scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            rng.shuffle(train)
            for i in range(0, len(train), 64):
                a, b = z[train[i : i + 64]], y[train[i : i + 64]]
                h = np.tanh(a @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b) / len(a)
                back = d[:, None] * p[2] * (1 - h * h)
                t += 1
                for k, g in enumerate((a.T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        net = cls(mean, scale, *p, 1.0)
        if len(apart):
            logit = net.logit(x[apart])
            cost = lambda T: np.mean(np.logaddexp(0, logit / T) - y[apart] * logit / T)
            net.temperature = float(min(np.geomspace(0.5, 8, 60), key=cost))
        return net

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


class Model:
    """With fewer than two classes among the labels, every score is the share of label 1 (a half for no labels)."""

    def __init__(self, vectors: Vectors | None, network: Network | None, prior: float):
        self.vectors, self.network, self.prior = vectors, network, prior

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], sums: Callable[[], np.ndarray]) -> Model:
        """`sums` gives the corpus's sums; it is asked only if there are two classes to tell apart."""
        y = np.array([b for _, b in sample], float)
        if len(set(y.tolist())) < 2:
            return cls(None, None, float(y.mean()) if len(y) else 0.5)
        vectors, know = Vectors.of(sums()), Words()
        x = np.stack([vectors.pool(t, know) for t, _ in sample]).astype(float)
        return cls(vectors, Network.fit(x, y), float(y.mean()))

    def scores(self, texts: list[str | None], know: Words) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.prior)
        return self.network.score(np.stack([self.vectors.pool(t, know) for t in texts]).astype(float))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] = (5, 0)) -> Model:
    """Word vectors from all documents; the network from a sample of the labelled ones."""
    return Model.fit(labelled_sample(docs, labels, label_col, *held_out, id_col=id_col, text_col=text_col), lambda: corpus_sums(docs, text_col))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, score (probability of label 1) and predicted. Null and empty texts are scored as texts without words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two tables of ROWS vectors

    def start():
        m, know = sent.value, Words()
        return lambda texts: [pa.array(m.scores(texts, know).astype(np.float64))]

    return map_text(docs, [id_col], text_col, start, "score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
