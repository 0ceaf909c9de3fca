import hashlib
import re

from stratakv.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check(docs, **options):
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(docs, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    want = []
    for i, t in rows:
        group = [j for j, u in rows if u == t]
        want.append((i, min(group), len(group), i == min(group), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def test_edge_rows(spark, docs):
    check(docs)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_hot_copies_ties_and_small_buckets(spark):
    texts = ["same  text"] * 400 + ["same\ttext"] * 100 + [f"t{i % 60}" for i in range(200)] + [None, "", " "]
    df = spark.createDataFrame([(i // 2 if i > 690 else i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, sha int").repartition(5)
    check(df, capacity=4)
    kept = exact_dedup.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(t) for t in texts})


def test_directory_splits_overfull_buckets():
    counts = {0: 90, 1: 5, 2: 5, 3: 5, 7: 5}
    out = exact_dedup.directory(counts, 3, 10)
    assert len(out) == 8
    full = [sum(counts.get(p, 0) for p in range(8) if out[p] == b) for b in set(out)]
    assert max(x for x in full if x != 90) <= 10 and out == sorted(out)
    assert exact_dedup.directory({}, 3, 10) == [0]


def test_collisions_are_chained_and_rows_go_through_the_directory(spark, monkeypatch):
    """With a key of two bits nearly all texts collide; a wrong directory loses the copies."""
    texts = [f"text number {i % 40}" for i in range(130)] + ["x"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(df, capacity=3)
    few = lambda c: exact_dedup.F.pmod(exact_dedup.F.hash(c), exact_dedup.F.lit(4)).cast("long") * (1 << 61)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c, *more: few(c))
    sigs, index = exact_dedup.build_index(df, capacity=3)
    monkeypatch.undo()
    entries = index.entries.collect()
    assert len(entries) == 41 and sum(r["group_size"] for r in entries) == 180
    chains = {}
    for r in entries:
        chains.setdefault((r["bucket"], r["key"]), []).append(r["chain"])
    assert len(chains) <= 4 and all(sorted(c) == list(range(len(c))) for c in chains.values())
    found = index.find(sigs, 180)
    assert sorted(r["group_size"] for r in found.collect()) == sorted(texts.count(t) for t in texts)
    wrong = exact_dedup.Index(index.entries, [p + 1 for p in index.pointers])
    assert wrong.find(sigs, 180).where("group_size is not null").count() == 0


def test_skewed_keys_split_their_bucket():
    counts = {p: 1 for p in range(256)} | {7: 500}
    out = exact_dedup.directory(counts, 8, 40)
    assert len(out) == 256 and out.count(out[7]) == 1 and out.count(out[255]) > 8
