"""Language-model scoring: a hierarchical Pitman-Yor model with Chinese-restaurant seating sampled by Gibbs.

A token's context is the word before it, as one of 65536 classes that a hash of the whole word gives. Restaurants of
these send their tables as customers to those of the word's last byte, and these to the root: a longer context backs
off to a shorter one. Within one dish two preceding words rarely share a class, so its counts are in effect those of
word pairs, at two bytes a pair. Texts are read once. A
task turns its documents into blocks of bounded size: the tokens as numbers of (word, context) pairs, and the distinct
words with their counts by context, packed by bucket of the word's hash. Only these are dealt out. In a bucket a word's
counts from all blocks and contexts meet, so a dish has all its seatings in one place; a sweep draws the tables of every
dish in every restaurant given all others, and the restaurants' sizes are summed between sweeps. The averaged
predictive probability of each pair goes back to the blocks that asked for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, remainder, small_batches

#: Contexts: ten bits of the hash of the word before, and the low bits of its last byte without closing punctuation,
#: which alone are the parent's context; 0 at the start of a text.
CONTEXTS, PARENTS = 1 << 16, 1 << 6
#: A block ends with the document that brings it to so many tokens or distinct words.
BLOCK_TOKENS, BLOCK_WORDS = 3_000_000, 350_000
#: Sweeps of the chain, and how many seatings at its end predictions are averaged over.
SWEEPS, SAMPLES = 3, 2
STRENGTH = 1.0
#: Logarithms of predictions go back to the blocks as whole numbers of steps, so one is off by at most 1 / (2 * LOG_STEPS).
LOG_STEPS = 4096
#: Customers of a dish up to which the number of its tables is drawn by going through all numbers.
EXACT = 48
#: Bytes of text a bucket of words; a bucket's words are in one task's memory together. And bytes of text a task.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS, TASK_BYTES = 16 << 20, 64, 1 << 18, 64 << 20

#: Words are known by their XXH64; two of V words share one with probability V^2 / 2^65. No word holds a line feed.
END = xxhash.xxh64_intdigest(b"\n", 0)
_DOCS = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))


def context_of(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word, 0) % (CONTEXTS // PARENTS) * PARENTS + (word.rstrip(b".,;:!?") or word)[-1] % PARENTS


class Block:
    """Documents of a task as numbers. Words get their place in order of arrival, the end of a text comes first."""

    def __init__(self):
        self.place: dict[bytes, int] = {b"\n": 0}
        self.docs: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.train: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: str | None, held_out: bool) -> None:
        words = (text or "").encode("utf-8", "replace").lower().split()
        place = self.place
        for w in set(words):
            if w not in place:
                place[w] = len(place)
        ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        self.tokens.append(np.append(ids, 0))
        self.docs.append((doc_id, len(words) + 1, held_out))
        self.size += len(words) + 1

    def full(self) -> bool:
        return self.size >= BLOCK_TOKENS or len(self.place) >= BLOCK_WORDS

    def rows(self, number: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """Its words by bucket, with their counts by context in training documents, then its documents and tokens."""
        words = list(self.place)
        cls = np.fromiter(map(context_of, words), np.int64, len(words))
        lens = np.array([n for _, n, _ in self.docs])
        ids = np.concatenate(self.tokens)
        before = np.empty_like(ids)
        before[1:] = cls[ids[:-1]]
        before[np.concatenate([[0], np.cumsum(lens)[:-1]])] = 0
        codes, pair = np.unique(ids * CONTEXTS + before, return_inverse=True)
        pair = pair.ravel()
        train = np.repeat(np.array([not h for _, _, h in self.docs]), lens)
        counts = np.bincount(pair[train], minlength=len(codes))
        asked = np.bincount(codes // CONTEXTS, minlength=len(words))
        hashes = np.array([END, *(xxhash.xxh64_intdigest(w, 0) for w in words[1:])], np.uint64)
        bucket = hashes % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        data = [pack(hashes[o], o, asked[o], codes[at := spread(asked, o)] % CONTEXTS, counts[at]) for o in np.split(order, cuts)]
        which = bucket[order][np.concatenate([[0], cuts])].astype(np.int32)
        yield _batch(np.full(len(which), number, np.int64), which, data, [None] * len(which))
        # A score is a sum over a document's pairs, so they are kept in order, as the steps from one to the next.
        doc = np.repeat(np.arange(len(lens)), lens)
        pair = np.sort(doc * len(codes) + pair) - doc * len(codes)
        steps = np.diff(pair, prepend=0)
        first = np.cumsum(lens) - lens
        steps[first] = pair[first]
        yield _batch(np.array([number]), np.array([-1], np.int32), [pack(asked, steps)], [[{"id": d, "n": n} for d, n, _ in self.docs]])


BLOCK_ROWS = "block long, bucket int, data binary, docs array<struct<id: long, n: long>>"


def _batch(block: np.ndarray, bucket: np.ndarray, data: list[bytes], docs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block), pa.array(bucket), pa.array(data, pa.binary()), pa.array(docs, _DOCS)], names=["block", "bucket", "data", "docs"])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed binary, each after its kind and length: whole numbers in as few bytes as they need, and
    the first bytes of all items, then the second ones, and so on, which compress better."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu":
            top = int(a.max()) if len(a) else 0
            a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
        out += [a.dtype.str.encode(), len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 3].decode()), int.from_bytes(raw[at + 3 : at + 11], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 11).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 11 + n * kind.itemsize
    return out


def spread(lens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the items of the runs `order`, where run k has lens[k] items and runs lie one after another."""
    starts = np.cumsum(lens) - lens
    own = lens[order]
    return np.repeat(starts[order] - (np.cumsum(own) - own), own) + np.arange(own.sum())


def blocks(docs: DataFrame, id_col: str, text_col: str, held_out: tuple[int, int], buckets: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), (remainder(id_col, held_out[0]) == held_out[1]).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 24, Block()
        for b in batches:
            for doc_id, text, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block.add(doc_id, text, held)
                if block.full():
                    yield from block.rows(number, buckets)
                    number, block = number + 1, Block()
        if block.docs:
            yield from block.rows(number, buckets)

    return rows.mapInArrow(run, BLOCK_ROWS)


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each key and step, the same in every run (the splitmix64 finish)."""
    with np.errstate(over="ignore"):
        z = key + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


@lru_cache(maxsize=8)
def table_ratios(d: float) -> tuple[np.ndarray, np.ndarray]:
    """From the weight S[c, t] of all ways to seat c customers at t tables (generalised Stirling numbers):
    S[c, t + 1] / S[c, t], and S[c - 1, t - 1] / S[c, t], the chance that a customer is alone at a table."""
    s = np.zeros((EXACT + 1, EXACT + 2))
    s[0, 0] = 1
    for c in range(EXACT):
        s[c + 1, 1:-1] = s[c, :-2] + np.maximum(c - np.arange(1, EXACT + 1) * d, 0) * s[c, 1:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        more, alone = s[:, 1:] / s[:, :-1], np.zeros_like(s)
        alone[1:, 1:] = s[:-1, :-1] / s[1:, 1:]
        return np.nan_to_num(more, posinf=0.0), np.nan_to_num(alone, posinf=0.0)


def alone(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The chance that one of c customers at t tables is alone; for many, between its limits for few and for all tables."""
    share = t / np.maximum(c, 1)
    few = table_ratios(d)[1][np.minimum(c, EXACT).astype(np.int64), np.minimum(t, EXACT).astype(np.int64)]
    return np.where(c <= EXACT, few, np.maximum(t - 1, 0) / np.maximum(c, 1) * (d + (1 - d) * share))


def many_tables(x: np.ndarray, c: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """For many customers: the number of tables t whose saddle point is 1 - x, and the weight of t + 1 tables against t."""
    f = (1 - x**d) / d
    t = c * f * x ** (1 - d) / (1 - x)
    return t, f / t


def seat(c: np.ndarray, tables: np.ndarray, d: float, above: np.ndarray, below: np.ndarray, up: np.ndarray, down: int, key: np.ndarray, step: int) -> np.ndarray:
    """The number of tables that c customers of a dish take, drawn from its distribution given all else.

    tables: those of the restaurant's other dishes. A table more is worth the chance that the parent serves the dish,
    (above + up t) / (below + down t) after t customers, and strength plus discount for every table there is by then.
    For many customers the distribution is summed over 64 points instead of all numbers.
    """
    t = np.minimum(c, 1).astype(float)

    def worth(at: np.ndarray, k) -> np.ndarray:
        return (STRENGTH + d * (tables[at] + k)) * (above[at] + up[at] * k) / (below[at] + down * k)

    live, k, ratios = np.flatnonzero((c > 1) & (c <= EXACT)), 1, table_ratios(d)[0]
    weight, total = np.ones(len(live)), np.ones(len(live))
    while len(live):
        weight = weight * ratios[c[live], k] * worth(live, k)
        total = total + weight
        t[live[uniform(key[live], step << 8 | k) * total < weight]] = k + 1
        k += 1
        left = c[live] > k
        live, weight, total = live[left], weight[left], total[left]

    big = np.flatnonzero(c > EXACT)
    if len(big):
        n, at = c[big].astype(float)[:, None], big[:, None]
        low, high = np.full((len(big), 1), -80.0), np.full((len(big), 1), -1e-6)
        for _ in range(40):
            y = (low + high) / 2
            less = many_tables(np.exp(y), n, d)[0] < 0.5
            low, high = np.where(less, y, low), np.where(less, high, y)
        high = np.full((len(big), 1), -1e-6)
        grid, row = np.linspace(0, 1, 65)[None, :], np.arange(len(big))
        for _ in range(4):  # each time on the stretch that held nearly all of it
            y = low + (high - low) * grid
            many, more = many_tables(np.exp(y), n, d)
            gain = np.log(more * worth(at, np.maximum(many, 1)))
            log = np.hstack([np.zeros_like(n), np.cumsum((gain[:, 1:] + gain[:, :-1]) / 2 * np.diff(many), axis=1)])
            log -= log.max(axis=1, keepdims=True)
            kept = log > -12
            first, last = kept.argmax(axis=1), 64 - kept[:, ::-1].argmax(axis=1)
            low, high = y[row, np.maximum(first - 1, 0)][:, None], y[row, np.minimum(last + 1, 64)][:, None]
        mass = np.cumsum((np.exp(log[:, 1:]) + np.exp(log[:, :-1])) / 2 * np.diff(many), axis=1)
        point = uniform(key[big], step << 8 | 255) * mass[:, -1]
        k = np.minimum((mass < point[:, None]).sum(axis=1), 63)
        before = np.where(k > 0, mass[row, k - 1], 0)
        part = (point - before) / np.maximum(mass[row, k] - before, 1e-300)
        t[big] = np.clip(np.floor(many[row, k] + part * (many[row, k + 1] - many[row, k]) + 1), 1, c[big])
    return t


class Sizes:
    """The restaurants' customers and tables, level by level: two-byte contexts, one-byte contexts, the root. Distinct words."""

    def __init__(self, customers: np.ndarray, tables: list[np.ndarray], words: float, discounts: tuple[float, float, float]):
        self.tables, self.words, self.discounts = tables, words, discounts
        by_last = tables[0].reshape(-1, PARENTS).sum(axis=0)
        self.customers = [customers, by_last, np.array([tables[1].sum()])]

    def chance(self, level: int, place: np.ndarray, c: np.ndarray, t: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Of a dish with c customers at t tables of the restaurants `place`, when the level above serves it with chance `base`."""
        d = self.discounts[level]
        return (np.maximum(c - d * t, 0) + (STRENGTH + d * self.tables[level][place]) * base) / (STRENGTH + self.customers[level][place])


class Words:
    """Counts of a bucket's words by context, from all blocks, and the pairs that each block asks for."""

    def __init__(self, packed: list[bytes]):
        parts = [unpack(x) for x in packed]
        word, self.place, self.asked, u, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.asked, self.rows = self.asked.astype(np.int64), np.array([len(x[0]) for x in parts])
        self.names, self.of_row = np.unique(word.astype(np.uint64), return_inverse=True)
        self.of_row = self.of_row.ravel()
        codes, self.pair = np.unique(np.repeat(self.of_row, self.asked) * CONTEXTS + u, return_inverse=True)
        self.pair = self.pair.ravel()
        self.of, self.u = codes // CONTEXTS, codes % CONTEXTS
        self.n = np.bincount(self.pair, n, len(codes)).astype(np.int64)
        self.total = np.bincount(self.of, self.n, len(self.names)).astype(np.int64)
        short, self.up = np.unique(self.of * PARENTS + self.u % PARENTS, return_inverse=True)
        self.up = self.up.ravel()
        self.up_of, self.up_u = short // PARENTS, short % PARENTS
        with np.errstate(over="ignore"):
            mix = lambda of, u: self.names[of] ^ (u.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            self.keys = mix(self.of, self.u), mix(self.up_of, self.up_u + CONTEXTS), self.names

    def sent(self, t: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers of each dish one level up and at the root: the tables of the level below."""
        return np.bincount(self.up, t, len(self.up_of)), np.bincount(self.up_of, t1, len(self.names))

    def start(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = np.where(self.n > EXACT, np.floor(np.sqrt(self.n)), np.minimum(self.n, 1))
        t1 = np.minimum(np.bincount(self.up, t, len(self.up_of)), 1)
        return t, t1, np.minimum(self.total, 1).astype(float)

    def sweep(self, seated: tuple[np.ndarray, ...], s: Sizes, k: int) -> tuple[np.ndarray, ...]:
        """Draws the tables of every dish in every restaurant given all others, in the restaurants' sizes `s`.

        Contexts of one dish are done in two halves, so that the second sees what the first has drawn.
        """
        t, t1, t0 = (x.copy() for x in seated)
        d, zero = s.discounts, np.zeros(len(self.names), np.int64)
        base = 1 / (s.words + 1)

        def parent(c, own, served, level, place, rest):
            """Numerator and denominator of the chance that the parent serves the dish, without `own` customers of it."""
            others = c - own
            lone = alone(c, served, d[level])  # so many tables leave with each customer, and come back
            above = others - d[level] * np.maximum(np.minimum(served - own * lone, others), 1) + (STRENGTH + d[level] * s.tables[level][place]) * rest
            grow = 1 - d[level] * lone
            return np.maximum(above, -0.999 * grow), STRENGTH + np.maximum(s.customers[level][place] - own, 0), grow

        for half in (0, 1):
            n1, n0 = self.sent(t, t1)
            root = s.chance(2, zero, n0, t0, base)
            at = np.flatnonzero((self.n > 1) & (self.keys[0] & np.uint64(1) == half))
            up, own = self.up[at], t[at]
            above, below, grow = parent(n1[up], own, t1[up], 1, self.up_u[up], root[self.of[at]])
            t[at] = seat(self.n[at], np.maximum(s.tables[0][self.u[at]] - own, 0), d[0], above, below, grow, 1, self.keys[0][at], 4 * k + half)
        for half in (0, 1):
            n1, n0 = self.sent(t, t1)
            at = np.flatnonzero(self.keys[1] & np.uint64(1) == half)
            w, own = self.up_of[at], t1[at]
            above, below, grow = parent(n0[w], own, t0[w], 2, zero[w], base)
            t1[at] = seat(n1[at].astype(np.int64), np.maximum(s.tables[1][self.up_u[at]] - own, 0), d[1], above, below, grow, 1, self.keys[1][at], 4 * k + 2)
        n0 = self.sent(t, t1)[1].astype(np.int64)
        t0 = seat(n0, np.maximum(s.tables[2][zero] - t0, 0), d[2], np.full(len(n0), base), np.ones(len(n0)), np.zeros(len(n0)), 0, self.keys[2], 4 * k + 3)
        return t, t1, t0

    def chain(self, sizes: list[Sizes]) -> Iterator[tuple[np.ndarray, ...]]:
        """The seatings of one chain, sweep after sweep; the k-th sweep is made in the k-th sizes. The same in every run."""
        seated = self.start()
        for k, s in enumerate(sizes):
            seated = self.sweep(seated, s, k)
            yield seated

    def predicted(self, seated: tuple[np.ndarray, ...], s: Sizes) -> np.ndarray:
        """The chance of each pair's word in its context."""
        t, t1, t0 = seated
        n1, n0 = self.sent(t, t1)
        root = s.chance(2, np.zeros(len(n0), np.int64), n0, t0, 1 / (s.words + 1))
        short = s.chance(1, self.up_u, n1, t1, root[self.up_of])
        return s.chance(0, self.u, self.n, t, short[self.up])

    def totals(self, seated: tuple[np.ndarray, ...]) -> np.ndarray:
        """Tables by restaurant, all levels in one vector."""
        return np.concatenate([np.bincount(self.u, seated[0], CONTEXTS), np.bincount(self.up_u, seated[1], PARENTS), [seated[2].sum()]])


def _over_words(rows: DataFrame, work: Callable[[Words, list[int]], pa.RecordBatch | None], schema: str, done: Callable[[], list[pa.RecordBatch]] = lambda: []) -> DataFrame:
    """`work` on a bucket's words and the numbers of their blocks; rows must be dealt out and sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, own in groupby(rows, key=lambda r: r[0]):
            _, block, data = zip(*own, strict=True)
            out = work(Words(list(data)), list(block))
            if out is not None:
                yield out
        yield from done()

    return rows.mapInArrow(run, schema)


def _totals(rows: DataFrame, values: Callable[[Words], np.ndarray], size: int) -> np.ndarray:
    """The sum of a vector of `size` over all words; tasks send what is not zero, and the sums come to the driver."""
    sums: list[np.ndarray] = []

    def work(w: Words, blocks_: list[int]) -> None:
        own = values(w)
        if sums:
            sums[0] += own
        else:
            sums.append(own)

    def done() -> list[pa.RecordBatch]:
        v = sums.pop() if sums else np.zeros(0)
        at = np.flatnonzero(v)
        return [pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(v[at].astype(float))], names=["i", "v"])]

    out = np.zeros(size)
    for r in _over_words(rows, work, "i int, v double", done).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (7, 2)) -> DataFrame:
    """One row a document: id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from all documents whose crc32 remainder is not the held-out one. A null text is an empty one:
    its only token is the end. Words that training never saw share the root's chance of a new word as one more word.
    If there is nothing to learn from, all scores are 0. Repeated rows are scored each. No rows in, no rows out.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = min(max(size // BUCKET_BYTES, LEAST_BUCKETS), MOST_BUCKETS)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    made = Table(blocks(docs, id_col, text_col, held_out, buckets), "lm-blocks").df
    words = made.where("bucket >= 0").select("bucket", "block", "data")
    # One row group a file: no bucket is ever read by two tasks, and later passes need no shuffle.
    words = Table(words.repartition(tasks, "bucket").sortWithinPartitions("bucket", "block"), "lm-words", {"parquet.block.size": str(1 << 30)}).df

    def first(w: Words) -> np.ndarray:
        seated = w.start()
        n1, n0 = w.sent(*seated[:2])
        facts = [w.total.sum(), (w.total > 0).sum(), *((x == k).sum() for x in (w.n, n1, n0) for k in (1, 2))]
        return np.concatenate([np.bincount(w.u, w.n, CONTEXTS), w.totals(seated), facts])

    def split(v: np.ndarray) -> list[np.ndarray]:
        return [v[:CONTEXTS], v[CONTEXTS : CONTEXTS + PARENTS], v[CONTEXTS + PARENTS :]]

    each = CONTEXTS + PARENTS + 1
    v = _totals(words, first, CONTEXTS + each + 8)
    customers, (tokens, types, *few) = v[:CONTEXTS], v[CONTEXTS + each :]
    discounts = tuple(float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95)) for a, b in zip(few[::2], few[1::2], strict=True))
    sizes = [Sizes(customers, split(v[CONTEXTS : CONTEXTS + each]), types, discounts)]
    for _ in range(SWEEPS if tokens else 0):
        now = list(sizes)
        v = _totals(words, lambda w: w.totals(list(w.chain(now))[-1]), each)  # noqa: B023
        sizes.append(Sizes(customers, split(v), types, discounts))

    def answer(w: Words, blocks_: list[int]) -> pa.RecordBatch:
        seatings = list(w.chain(sizes[:-1]))[-SAMPLES:] or [w.start()]
        p = sum(w.predicted(x, s) for x, s in zip(seatings, sizes[-len(seatings) :], strict=True)) / len(seatings)
        logs = np.minimum(np.round(np.log10(np.maximum(p, 1e-300)) * -LOG_STEPS), 65535).astype("<u2")[w.pair]
        ends = np.cumsum(w.rows)[:-1]
        pairs = np.cumsum(np.add.reduceat(w.asked, np.concatenate([[0], ends])))[:-1]
        parts = zip(np.split(w.place, ends), np.split(w.total[w.of_row], ends), np.split(logs, pairs), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), pa.array([pack(*x) for x in parts], pa.binary())], names=["block", "data"])

    answers = _over_words(words, answer, "block long, data binary")
    answers = answers.repartition(tasks, "block")
    texts = made.where("bucket < 0").select("block", "data", "docs").repartition(tasks, "block")
    least = float(np.log10(tokens + types + 1))

    def scored(text: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        asked, steps = unpack(text["data"].iloc[0])
        asked = asked.astype(np.int64)
        place, count, log = (np.concatenate(x) for x in zip(*map(unpack, found["data"]), strict=True))
        place = place.astype(np.int64)
        logs, n = np.empty(len(log)), np.empty(len(place))
        logs[spread(asked, place)] = log / -LOG_STEPS
        n[place] = count
        word = np.repeat(np.arange(len(asked)), asked)
        own = text["docs"].iloc[0]
        lens = np.array([d["n"] for d in own])
        at = np.cumsum(lens) - lens
        run = np.cumsum(steps.astype(np.int64))
        token = run - np.repeat(run[at] - steps[at].astype(np.int64), lens)
        add = lambda x: np.add.reduceat(x[token], at)
        total = add(logs)
        return pd.DataFrame({
            "doc_id": pd.array([d["id"] for d in own], "Int64"), "n_tokens": lens, "n_known": add((n > 0).astype(np.int64)[word]),
            "base_score": add((np.log10(n + 1.0) - least)[word]), "score": total, "perplexity": 10 ** (-total / lens),
        })

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, schema)
    return out.select(F.col("doc_id").alias(id_col), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
