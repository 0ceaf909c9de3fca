import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratakv.llm import language_model as lm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def check(rows, got):
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w, r = tokens(t), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] <= 1e-9 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(w)), rel=1e-6)


def test_base_and_edge_rows(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, {r["doc_id"]: r for r in lm.score(docs).collect()})
    assert lm.score(docs.limit(0)).count() == 0


def test_blocks_and_partitions_do_not_change_scores_and_context_helps(spark, monkeypatch):
    rng = np.random.default_rng(4)
    kinds = [[f"{k}{j}" + e for j in range(60) for e in (k + k,)] for k in "abcd"]
    rows = []
    for i in range(300):
        own = kinds[i % 4]
        rows.append((i, " ".join(own[min(int(x), 59)] for x in rng.exponential(12, 60))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r for r in lm.score(df.repartition(1)).collect()}
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    many = {r["doc_id"]: r for r in lm.score(df.repartition(5)).collect()}
    check(rows, many)
    for i in one:
        assert one[i]["score"] == pytest.approx(many[i]["score"], rel=1e-5)
    out = [i for i in one if held(i)]
    assert sum(one[i]["score"] for i in out) > sum(one[i]["base_score"] for i in out) * 0.9


def bucket(counts):
    """All words of a corpus, given as {(word, context): count}, in one bucket."""
    words = sorted({w for w, _ in counts})
    pairs = [sorted((u, n) for (v, u), n in counts.items() if v == w) for w in words]
    names = np.array([lm.xxhash.xxh64_intdigest(str(w)) for w in words], np.uint64)
    flat = np.array([x for own in pairs for x in own]).reshape(-1, 2)
    return lm.Words([lm.pack(names, np.arange(len(words)), np.array([len(own) for own in pairs]), flat[:, 0], flat[:, 1])])


def sized(w, seated, d):
    v = w.totals(seated)
    tables = [v[: lm.CONTEXTS], v[lm.CONTEXTS : -1], v[-1:]]
    return lm.Sizes(np.bincount(w.u, w.n, lm.CONTEXTS), tables, int((w.total > 0).sum()), d)


def test_predictions_sum_to_one():
    """Over all words and the one new word, in every context, for any seating."""
    rng, contexts, d = np.random.default_rng(2), [0, 3, lm.PARENTS + 3, 2 * lm.PARENTS + 4, 7], (0.7, 0.6, 0.5)
    w = bucket({(i, u): int(rng.poisson(0.8)) + (u == 0) for i in range(40) for u in contexts})
    seated = w.start()
    for k in range(3):
        seated = w.sweep(seated, sized(w, seated, d), k)
        n1, n0 = w.sent(*seated[:2])
        for c, t in ((w.n, seated[0]), (n1, seated[1]), (n0, seated[2])):
            assert (t <= c).all() and ((t >= 1) == (c >= 1)).all()
        s = sized(w, seated, d)
        p, zero, none = w.predicted(seated, s), np.zeros(1, int), np.zeros(1)
        new = s.chance(2, zero, none, none, 1 / 41)
        for u in contexts:
            last = s.chance(0, np.array([u]), none, none, s.chance(1, np.array([u % lm.PARENTS]), none, none, new))
            assert p[w.u == u].sum() + last[0] == pytest.approx(1)


def one_by_one(counts, d, sweeps, rng):
    """The same model with every customer at a table of its own record, removed and seated again one after another."""
    words = sorted({w for w, _ in counts})
    base = 1 / (len(words) + 1)
    tables = {}  # (level, restaurant) -> word -> sizes
    up = lambda r: (1, r[1] % lm.PARENTS) if r[0] == 0 else (2, 0)

    def chance(r, w):
        mine = tables.setdefault(r, {})
        c, t, of = sum(sum(x) for x in mine.values()), sum(len(x) for x in mine.values()), mine.get(w, [])
        rest = base if r[0] == 2 else chance(up(r), w)
        return (sum(of) - d[r[0]] * len(of) + (lm.STRENGTH + d[r[0]] * t) * rest) / (lm.STRENGTH + c)

    def add(r, w):
        mine = tables.setdefault(r, {})
        of, t = mine.setdefault(w, []), sum(len(x) for x in mine.values())
        rest = base if r[0] == 2 else chance(up(r), w)
        odds = [n - d[r[0]] for n in of] + [(lm.STRENGTH + d[r[0]] * t) * rest]
        k = rng.choice(len(odds), p=np.array(odds) / sum(odds))
        if k < len(of):
            of[k] += 1
        else:
            of.append(1)
            if r[0] < 2:
                add(up(r), w)

    def remove(r, w):
        of = tables[r][w]
        k = rng.choice(len(of), p=np.array(of) / sum(of))
        of[k] -= 1
        if not of[k]:
            of.pop(k)
            if r[0] < 2:
                remove(up(r), w)

    every = [((0, u), w) for (w, u), n in counts.items() for _ in range(n)]
    for r, w in every:
        add(r, w)
    mean = dict.fromkeys(counts, 0.0)
    for k in range(sweeps + 20):
        for r, w in every:
            remove(r, w)
            add(r, w)
        if k >= 20:
            for w, u in counts:
                mean[w, u] += chance((0, u), w) / sweeps
    return mean


def test_the_chain_agrees_with_customers_seated_one_by_one():
    rng, d = np.random.default_rng(6), (0.6, 0.5, 0.4)
    counts = {(w, u): int(rng.integers(0, 6)) + 60 * (w == 0 and u == 3) for w in range(5) for u in (3, lm.PARENTS + 3, 4)}
    want = one_by_one(counts, d, 400, rng)
    w = bucket(counts)
    seated, mean, n = w.start(), 0, 1500
    for k in range(n + 20):
        seated = w.sweep(seated, sized(w, seated, d), k)
        if k >= 20:
            mean = mean + w.predicted(seated, sized(w, seated, d)) / n
    got = dict(zip(((int(np.flatnonzero(w.names == np.uint64(lm.xxhash.xxh64_intdigest(str(v))))[0]), u) for v, u in counts), counts, strict=True))
    assert {got[int(o), int(u)]: float(m) for o, u, m in zip(w.of, w.u, mean, strict=True)} == pytest.approx(want, rel=0.06)


def test_many_customers_are_seated_as_exact_numbers_say(monkeypatch):
    """The saddle point against the exact distribution, which goes through all numbers of tables."""
    n, d = 4000, 0.6
    key = np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64)
    full = lambda x: np.full(n, x)
    draw = lambda: lm.seat(full(120), full(40.0), d, full(0.3), full(30.0), full(0.9), 1, key, 3)
    fast = draw()
    monkeypatch.setattr(lm, "EXACT", 130)
    lm.table_ratios.cache_clear()
    slow = draw()
    lm.table_ratios.cache_clear()
    assert fast.mean() == pytest.approx(slow.mean(), rel=0.06) and fast.std() == pytest.approx(slow.std(), rel=0.15)


def test_a_text_that_occurs_twice_is_told_apart(spark):
    """Word contexts: all words are as frequent in single texts as in double ones, only what follows them is not."""
    rng = np.random.default_rng(8)
    rows, i = [], 0
    while len(rows) < 400:
        text = " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, 80))
        for _ in range(1 + (i % 2)):
            rows.append((len(rows), text, i % 2))
        i += 1
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, twice int").drop("twice")).collect()}
    seen = {t: [i for i, u, _ in rows if u == t and not held(i)] for _, t, _ in rows}
    twice = [got[i] for i, t, _ in rows if len(seen[t]) == 2 and not held(i)]
    once = [got[i] for i, t, _ in rows if len(seen[t]) == 1 and not held(i)]
    assert np.quantile(twice, 0.05) > np.quantile(once, 0.95)
