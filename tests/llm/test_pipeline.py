import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stratakv.llm import queries
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, docs):
    """Each stage is held to its own input, which it reads back from a file."""
    before, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, None).cache()
        rows, kept = before.collect(), after.collect()
        if name != "BPE":
            assert after.columns == docs.columns
            assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}
        if name == "language ID":
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")}
        elif name == "exact dedup":
            assert {r["doc_id"] for r in kept} == {min(x["doc_id"] for x in rows if norm(x["text"]) == norm(r["text"])) for r in rows}
        elif name == "near dedup":
            comp = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in rows})
            assert {r["doc_id"] for r in kept} == set(comp.values())
        elif name == "BPE":
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) for r in rows}
            assert {r["doc_id"]: r["n_tokens"] for r in kept} == want
        before = after


def test_empty_table(spark, docs):
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, None)
        assert out.count() == 0


def test_queries_are_named_by_their_number():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
