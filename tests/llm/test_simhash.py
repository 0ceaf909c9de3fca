import random
import re

import pytest
import xxhash

from stratakv.llm import simhash
from stratakv.llm.components import connected_components


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: id -> fingerprint."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def check(spark, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    comp = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}
    return comp


def test_whole_texts_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "delta", "ÉTÉ", "omega"]) + str(rng.randrange(50))
    texts = [None, "", " \n", "a", "A b", "a b c d", "a b c d"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    comp = check(spark, docs)
    assert len(set(comp.values())) < len(comp)


def test_edge_rows(spark, docs):
    check(spark, docs)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [3, 5, 6, 7])
def test_every_design_finds_all_pairs(n):
    rng = random.Random(n)
    masks = simhash.variants(n)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(5)):
            y ^= 1 << b
        assert any((x ^ y) & m == 0 for m in masks)


@pytest.mark.parametrize("most", [2, 24])
def test_dense_groups_and_chains(spark, monkeypatch, most):
    """Many fingerprints round one centre, and chains of them, against brute force; with and without stars."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", most)
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(40):
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << b
            fps.add(y)
            if rng.random() < 0.1:
                x = y
    fps |= {rng.getrandbits(64) for _ in range(100)} | {0}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df, len(fps))).collect()}
    want = brute_components({signed(f): f for f in fps})
    group = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert group({f: roots.get(f, f) for f in want}) == group(want)


def test_components_of_a_long_path(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("n", [3, 5, 6, 7, 8])
def test_near_fingerprints_of_a_bucket_agree_in_a_piece(n):
    rng = random.Random(n)
    masks = simhash.variants(n)
    assert len(masks) < simhash.TAGS
    for m in rng.sample(masks, 60):
        cut = simhash.pieces(m)
        assert sum(cut) == ~m & ((1 << 64) - 1) and len(cut) == 5
        x = y = rng.getrandbits(64)
        for b in rng.sample([b for b in range(64) if not m >> b & 1], 4):
            y ^= 1 << b
        assert any((x ^ y) & p == 0 for p in cut)


def crowded_bucket(n=600, near=40):
    """Fingerprints alike in their first segment and else at random, so that each is a component, and some near ones."""
    rng = random.Random(8)
    low = rng.getrandbits(21)
    fps = [low | rng.getrandbits(43) << 21 for _ in range(n)]
    for x in fps[:near]:
        for b in rng.sample(range(21, 64), 4):
            x ^= 1 << b
        fps.append(x)
    return {f - (1 << 64) if f >> 63 else f: f for f in fps}


def test_a_crowded_bucket_does_not_meet_all_pairs(spark, monkeypatch):
    """Pairs that come to be compared, counted by letting all of them pass: 1 in 10 of the bucket's at most."""
    near = simhash._near
    monkeypatch.setattr(simhash, "_near", lambda a, b: near(a, b) if b == "least" else simhash.F.lit(True))
    fps = crowded_bucket()
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert simhash.links(df, len(fps)).distinct().count() < len(fps) * (len(fps) - 1) / 20


@pytest.mark.parametrize("strays, part", [(256, 2000), (0, 7)])
def test_crowded_buckets_against_brute_force(spark, monkeypatch, strays, part):
    monkeypatch.setattr(simhash, "STRAYS_UP_TO", strays)
    monkeypatch.setattr(simhash, "PART", part)
    fps = crowded_bucket()
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df, len(fps))).collect()}
    want = brute_components(fps)
    group = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert group({f: roots.get(f, f) for f in want}) == group(want)
