"""Toxicity by weak supervision: lexicon and pattern voters, a generative model of their accuracies and correlations that
sees no labels, and a linear classifier on its posterior labels.

Labels propose voters: words and stems that go with label 1 in a bounded sample are dealt out to lexicons, beside a
written one. How good the voters are is then estimated from their votes alone, over all training documents, labelled or
not. The votes of a document are a few bits, so the corpus comes down to at most 2**VOTERS counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_text, remainder

#: The written lexicon.
SEED_WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: Lengths of the stems that stand beside whole words, and features of the classifier, at most.
STEMS = (4, 5, 6)
FEATURES = 1500
LEAST_DOCS, LEAST_CHI2 = 4, 20.0
#: Lexicons of proposed words and of proposed stems of VOTER_STEM letters. A key is proposed if at least LEAST_SHARE of
#: the documents with it have label 1.
WORD_LEXICONS, STEM_LEXICONS, VOTER_STEM, LEAST_SHARE = 6, 3, 5, 0.9
#: Voters: the written lexicon, those lexicons, and three patterns: several listed keys, many exclamation marks, capitals.
#: Prior belief in a lexicon's votes, as a multiple of their number.
TRUST = 0.5
LEXICONS = 1 + WORD_LEXICONS + STEM_LEXICONS
VOTERS = LEXICONS + 3
#: Words whose features a task remembers.
MEMO = 400_000
THRESHOLD = 0.3

# All ASCII but letters to a space, letters lower-cased.
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def word_set(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split())


def keys_of(word: bytes) -> list[bytes]:
    """The word and its stems; a stem is marked with a trailing star."""
    s = word.decode("utf-8", "replace")
    return [word, *(s[:n].encode() + b"*" for n in STEMS if len(s) >= n)]


def chi2(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Of presence in a of n1 toxic and b of n0 other documents; signed, positive for toxic."""
    n = n1 + n0
    e = (a + b) * n1 / n
    d = a - e
    var = (a + b) * (1 - (a + b) / n) * n1 * n0 / n**2
    return np.sign(d) * d * d / np.maximum(var, 1e-9)


class LabelModel:
    """What each voter does given the true class, by EM over patterns of votes, and the posterior of every pattern.

    votes: a row a pattern, a column a voter, 1 where it votes toxic; n: documents with the pattern. Voters whose votes stay
    correlated given the class share their weight. EM starts from whether any lexicon votes, and believes beforehand, as
    firmly as TRUST times its votes, that LEAST_SHARE of them are right: without that, voters that never meet in one text
    could not be told from chance. Of the labels it is only given their share of toxic ones.
    """

    def __init__(self, votes: np.ndarray, n: np.ndarray, prior: float, rounds: int = 60):
        total = max(float(n.sum()), 1.0)
        self.prior, self.posterior = float(np.clip(prior, 0.01, 0.5)), np.where(votes[:, :LEXICONS].any(axis=1), 0.9, 0.02)
        for _ in range(rounds):
            p = self.posterior
            right, cast = votes.T @ (n * p), votes.T @ n
            right[:LEXICONS] = (right[:LEXICONS] + TRUST * LEAST_SHARE * cast[:LEXICONS]) / (1 + TRUST)
            self.given = np.stack([np.minimum((v + 0.5) / ((n * q).sum() + 1), 0.999) for v, q in ((cast - right, 1 - p), (right, p))])  # class, voter
            left = votes - ((1 - p)[:, None] * self.given[0] + p[:, None] * self.given[1])
            cov = left.T @ (left * n[:, None]) / total
            size = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            self.correlation = cov / size[:, None] / size[None, :]
            tied = np.maximum(self.correlation - np.eye(len(size)), 0)
            self.weight = 1 / (1 + np.where(tied > 0.1, tied, 0).sum(axis=1))
            odds = votes * np.log(self.given[1] / self.given[0]) + (1 - votes) * np.log((1 - self.given[1]) / (1 - self.given[0]))
            self.posterior = 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + odds @ self.weight, -30, 30)))


class Sample:
    """The labelled texts with their sets of words, and of words and stems as numbers in `names`."""

    def __init__(self, texts: list[str]):
        self.texts, self.words = texts, [word_set(t) for t in texts]
        number: dict[bytes, int] = {}
        own: dict[bytes, list[int]] = {}
        self.keys = []
        for s in self.words:
            for w in [w for w in s if w not in own]:
                own[w] = [number.setdefault(k, len(number)) for k in keys_of(w)]
            self.keys.append(np.unique(np.array([k for w in s for k in own[w]], np.int64)))
        self.names = list(number)

    def ranked(self, y: np.ndarray) -> list[tuple[int, float]]:
        """Keys by association with the class, strongest first; ties in order of the name."""
        flat, each = np.concatenate(self.keys), np.repeat(y, [len(k) for k in self.keys])
        n = np.bincount(flat, minlength=len(self.names)).astype(float)
        a = np.bincount(flat, each, minlength=len(self.names))
        c = chi2(a, n - a, float(y.sum()), float(len(y) - y.sum()))
        good = np.flatnonzero((n >= LEAST_DOCS) & (np.abs(c) >= LEAST_CHI2)).tolist()
        return sorted(((k, float(c[k])) for k in good), key=lambda r: (-abs(r[1]), self.names[r[0]]))

    def proposed(self, y: np.ndarray) -> list[list[bytes]]:
        """Keys of each proposed lexicon: words and stems that go with label 1, strongest first, dealt out in turn."""
        flat, each = np.concatenate(self.keys), np.repeat(y, [len(k) for k in self.keys])
        share = np.bincount(flat, each, minlength=len(self.names)) / np.maximum(np.bincount(flat, minlength=len(self.names)), 1)
        good = [self.names[k] for k, c in self.ranked(y) if c > 0 and share[k] >= LEAST_SHARE and self.names[k].decode("utf-8", "replace") not in SEED_WORDS]
        words = [k for k in good if not k.endswith(b"*")]
        stems = [k for k in good if k.endswith(b"*") and len(k.decode("utf-8", "replace")) == VOTER_STEM + 1]
        return [words[i::WORD_LEXICONS] for i in range(WORD_LEXICONS)] + [stems[i::STEM_LEXICONS] for i in range(STEM_LEXICONS)]

    def presence(self, chosen: list[int]) -> np.ndarray:
        at = np.full(len(self.names), -1)
        at[chosen] = np.arange(len(chosen))
        x = np.zeros((len(self.keys), len(chosen)), np.float32)
        for i, k in enumerate(self.keys):
            j = at[k]
            x[i, j[j >= 0]] = 1
        return x


class Voters:
    """Votes of a text as the bits of a number. A word speaks through the lexicon that lists it, else through that of its stem."""

    def __init__(self, lexicons: list[list[bytes]]):
        self.of = {k: i for i, keys in enumerate([[w.encode() for w in SEED_WORDS], *lexicons]) for k in keys}

    def lexicon(self, word: bytes) -> int | None:
        if word in self.of:
            return self.of[word]
        s = word.decode("utf-8", "replace")
        return self.of.get(s[:VOTER_STEM].encode() + b"*") if len(s) >= VOTER_STEM else None

    def vote(self, text: str, lexicons: list[int]) -> int:
        """`lexicons` has one for each different word that is listed."""
        out = 0
        for i in lexicons:
            out |= 1 << i
        out |= (len(lexicons) > 1) << LEXICONS
        out |= (text.count("!") > len(text) / 40) << LEXICONS + 1
        return out | (2 * sum(map(str.isupper, text)) > len(text)) << LEXICONS + 2


def bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS) & 1).astype(float)


class Memo:
    """Remembers what `find` says of a word, and forgets all when it holds MEMO words."""

    def __init__(self, find: Callable[[bytes], object]):
        self.find, self.known, self.found = find, set(), {}

    def among(self, words: set[bytes]) -> list:
        """What `find` says of those that it has something for."""
        new = words - self.known
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            self.found.clear()
            new = words
        for w in new:
            if (got := self.find(w)) is not None:
                self.found[w] = got
        self.known.update(new)
        return [self.found[w] for w in words if w in self.found]


class Model:
    """A logistic model over words, stems and votes. Without two classes among the labels all scores are their share."""

    def __init__(self, weights: dict[bytes, float], voters: Voters, by_vote: np.ndarray, bias: float, prior: float | None = None):
        self.weights, self.voters, self.by_vote, self.bias, self.prior = weights, voters, by_vote, bias, prior

    def scorer(self):
        listed = Memo(self.voters.lexicon)
        hot = Memo(lambda w: [k for k in keys_of(w) if k in self.weights] or None)
        of_bits = bits(np.arange(1 << VOTERS)) @ self.by_vote

        def score(texts: list[str | None]) -> np.ndarray:
            if self.prior is not None:
                return np.full(len(texts), self.prior)
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                t = t or ""
                words = word_set(t)
                found = {k for keys in hot.among(words) for k in keys}
                out[i] = self.bias + sum(self.weights[k] for k in sorted(found)) + of_bits[self.voters.vote(t, listed.among(words))]
            return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

        return score


def vote_counts(docs: DataFrame, voters: Voters, held_out: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> dict[int, int]:
    """Training documents by their votes: one scan of all whole texts, at most 2**VOTERS counts."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def start():
        v = sent.value
        listed = Memo(v.lexicon)
        return lambda texts: [pa.array([v.vote(t or "", listed.among(word_set(t))) for t in texts], pa.int32())]

    rows = docs.where(remainder(id_col, held_out[0]) != held_out[1])
    return {r["votes"]: r["count"] for r in map_text(rows, [], text_col, start, "votes int").groupBy("votes").count().collect()}


def fit(sample: list[tuple[str, int]], counts: Callable[[Voters], dict[int, int]], rounds: int = 200) -> Model:
    """`counts` gives the training documents by their votes. The linear model learns from the posteriors of the sample's texts."""
    y = np.array([b for _, b in sample], float)
    if len(set(y.tolist())) < 2:
        return Model({}, Voters([]), np.zeros(VOTERS), 0.0, float(y.mean()) if len(y) else 0.5)
    texts = Sample([t for t, _ in sample])
    voters = Voters(texts.proposed(y))
    counted = sorted(counts(voters).items())
    patterns = np.array([v for v, _ in counted])
    labels = LabelModel(bits(patterns), np.array([float(n) for _, n in counted]), float(y.mean()))
    posterior_of = dict(zip(patterns.tolist(), labels.posterior.tolist(), strict=True))
    own = [voters.vote(t, [i for w in s if (i := voters.lexicon(w)) is not None]) for t, s in zip(texts.texts, texts.words, strict=True)]
    posterior = np.array([posterior_of[v] for v in own])
    picked = [k for k, _ in texts.ranked(posterior)][:FEATURES]
    number = {name: k for k, name in enumerate(texts.names)}
    picked = list(dict.fromkeys([number[w.encode()] for w in SEED_WORDS if w.encode() in number] + picked))
    x = np.hstack([texts.presence(picked), bits(np.array(own)).astype(np.float32)])
    w, b, m, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30))) - posterior) / len(x)
        g = np.append(d.astype(np.float32) @ x + 1e-4 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    n = len(picked)
    return Model({texts.names[k]: float(c) for k, c in zip(picked, w[:n], strict=True) if abs(c) > 0.05}, voters, w[n:], float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (4, 2)) -> Model:
    """Voters and the linear model come from at most SAMPLE_ROWS labelled rows, the voters' accuracies from all training documents."""
    sample = labelled_sample(docs, labels, label_col, *held_out, id_col=id_col, text_col=text_col)
    return fit(sample, lambda voters: vote_counts(docs, voters, held_out, id_col, text_col))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, score (probability of label 1) and predicted.

    Null and empty texts are scored as texts without words, long ones whole; repeated rows and rows without an id are
    scored each. No rows in, no rows out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and the lexicons, which the sample bounds

    def start():
        score = sent.value.scorer()
        return lambda texts: [pa.array(score(texts))]

    return map_text(docs, [id_col], text_col, start, "score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
