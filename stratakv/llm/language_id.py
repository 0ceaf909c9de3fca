"""Language ID by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, remainder

#: The classifiers are fitted on about this many labelled rows a language, chosen by hash, of at most so many bytes each;
#: on fewer a language, but no less than LEAST_PER_LANGUAGE, where there are more languages than make SAMPLE_ROWS in all.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, LEAST_PER_LANGUAGE = 600, 6000, 20
SAMPLE_TEXT_BYTES = 100_000
BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20
#: Best and second-best codeword closer than this, as a share of the two: ambiguous.
MARGIN = 0.2
LETTER = regex.compile(r"\p{L}")

#: ASCII letters lower-cased, all other ASCII to a space; bytes of longer characters stay.
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
_SPACES = regex.compile(rb" {2,}")


def grams(text: str):
    """Bucket numbers of a text's n-grams, block by block."""
    raw = b" " + _SPACES.sub(b" ", text.lower().encode("utf-8", "replace").translate(_FOLD)) + b" "
    for at in range(0, len(raw), BLOCK):
        a = np.frombuffer(raw[at : at + BLOCK + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        for n in ORDERS:
            most = min(len(a) - n + 1, BLOCK)
            if most > 0:
                h = np.full(most, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ a[k : k + most]) * np.uint32(0x01000193)
                yield (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def frequencies(text: str) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.float32)
    for h in grams(text):
        counts += np.bincount(h, minlength=BUCKETS)
    return counts / max(1.0, float(counts.sum()))


def codebook(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of k classes, a row each, of -1 and 1: every split for few classes, else well-spread random ones."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        rest = [c for n in range(k - 1) for c in combinations(range(1, k), n)]
        return np.array([[1 if i == 0 or i in c else -1 for c in rest] for i in range(k)], np.int8)
    bits, rng, best = int(np.ceil(12 * np.log2(k))), np.random.default_rng(seed), None
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        near = (m.astype(int) @ m.T.astype(int) + np.eye(k, dtype=int) * -2 * bits).max()
        if np.abs(m.sum(0)).max() < k and (best is None or near < best[0]):
            best = (near, m)
    return best[1] if best else m


class Model:
    """A logistic classifier a bit of the codewords; `weights` of bits come from rows that were left out of the fit.

    `limit` is how far from its nearest codeword the farthest labelled text is, short stretches included.
    """

    def __init__(self, languages: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray, weights: np.ndarray, limit: float = np.inf):
        self.languages, self.code, self.w, self.b, self.weights, self.limit = languages, code, w, b, weights, limit

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], seed: int = 11, epochs: int = 12, rate: float = 0.5) -> Model:
        """Whole texts, and of each a short stretch too, so that short texts are learned as well."""
        names = sorted(set(langs))
        code = codebook(len(names))
        if len(names) < 2:
            return cls(names, code, np.zeros((BUCKETS, 1), np.float32), np.ones(1, np.float32), np.ones(1))
        rng = np.random.default_rng(seed)
        x, y = np.empty((2 * len(texts), BUCKETS), np.float32), []  # filled in place: it is the driver's largest array
        for t, g in zip(texts, langs, strict=True):
            n = int(rng.integers(12, 90))
            at = int(rng.integers(0, max(1, len(t) - n)))
            for s in (t, t[at : at + n]):
                if LETTER.search(s):
                    np.sqrt(frequencies(s), out=x[len(y)])
                    y.append(names.index(g))
        x, y = x[: len(y)], code[np.array(y, int)].astype(np.float32)
        apart = rng.random(len(x)) < 0.1
        w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        g2 = np.full_like(w, 1e-6)
        train = np.flatnonzero(~apart)
        for _ in range(epochs):
            rng.shuffle(train)
            for i in range(0, len(train), 128):
                xs, ys = x[train[i : i + 128]], y[train[i : i + 128]]
                grad = -ys / (1 + np.exp(np.clip(ys * (xs @ w + b), -30, 30))) / len(xs)
                step = xs.T @ grad + 1e-6 * w
                g2 += step * step
                w -= rate * step / np.sqrt(g2)
                b -= 0.05 * grad.sum(0)
        if apart.any():
            right = np.mean((x[apart] @ w + b) * y[apart] > 0, axis=0)
            weights = np.maximum(right - 0.5, 0.02)
        else:
            weights = np.ones(code.shape[1])
        out = cls(names, code, w, b, weights / weights.sum())
        out.limit = max((float(out.losses(a).min()) for a in x), default=np.inf)
        return out

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Distance of a text, as roots of its frequencies, from each codeword."""
        return np.logaddexp(0, -(x @ self.w + self.b)[None, :] * self.code) @ self.weights

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the two nearest codewords are about as near."""
        return self.judge(text)[:3]

    def judge(self, text: str | None) -> tuple[str, float, bool, bool]:
        """Also whether the text is accepted: it has a letter, and is no farther from a codeword than what was learned from."""
        if not text or not LETTER.search(text):
            return "und", 0.0, False, False
        if not self.languages:
            return "und", 0.0, False, True
        loss = self.losses(np.sqrt(frequencies(text)))
        p = np.exp(-(loss - loss.min()) * 4)
        p /= p.sum()
        best = int(np.argmin(loss))
        if len(loss) == 1:
            return self.languages[0], 1.0, False, True
        first, second = np.partition(loss, 1)[:2]
        return self.languages[best], float(p[best]), bool(second - first < MARGIN * (first + second)), bool(first <= self.limit * (1 + 1e-5))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (4, 2)) -> Model:
    """Fits on a sample of rows with a language whose crc32 remainder is not the held-out one; one scan, texts of the sample alone are shuffled.

    A row is in the sample by the hash of its id and text; rows equal in both count once. Every language is learned. The
    sample is bounded by the number of languages, and so are the rows that reach the driver.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("g"))
    rows = rows.where(remainder("id", held_out[0]) != held_out[1]).where("g is not null and t is not null")
    rows = rows.where(F.octet_length("t") <= SAMPLE_TEXT_BYTES)
    counts = rows.groupBy("g").count()
    known = counts.count()
    if not known:
        return Model([], codebook(0), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    each = max(LEAST_PER_LANGUAGE, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // known))
    shares = F.broadcast(counts.select(F.col("g").alias("of"), (F.lit(float(each)) / F.col("count")).alias("share")))
    place = F.pmod(F.xxhash64("id", "t"), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(shares, F.col("g") == F.col("of")).where(place < F.col("share")).select("id", "t", "g").distinct().collect()
    sample.sort(key=lambda r: (r["g"], r["id"] or "", r["t"]))
    return Model.fit([r["t"] for r in sample], [r["g"] for r in sample])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id (and the columns of `keep`, which must have other names), lang_pred, score, ambiguous, accepted.

    Texts that are null or have no letter are `und` with score 0; so is all if nothing was learned. Accepted is a text
    with a letter that is not too far from all codewords; where nothing was learned, any text with a letter. Long texts
    are read whole; repeated rows and rows without an id are judged each. No rows in, no rows out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a float a bit

    def start():
        m = sent.value

        def run(texts):
            out = [m.judge(t) for t in texts]
            return [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_()), pa.array([o[3] for o in out], pa.bool_())]

        return run

    return map_text(docs, [id_col, *keep], text_col, start, "lang_pred string, score double, ambiguous boolean, accepted boolean")
