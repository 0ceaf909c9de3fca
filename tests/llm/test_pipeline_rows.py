"""Rows that stages of the pipeline must keep or drop, where ids and languages do not help."""

import random

import pytest

import corpus_pipeline
from stratakv.llm import mixing, simhash
from tests.llm.test_classifiers import text


def test_without_languages_all_texts_with_letters_stay(spark, docs):
    df = docs.withColumn("lang", mixing.F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_identified(spark, df, None).collect()}
    assert kept == {r["doc_id"] for r in df.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_texts_far_from_all_codewords_go(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang := rng.choice(["en", "fr", "de"])), lang) for i in range(600)]
    rows += [(1000 + i, "".join(rng.choice("αβγδεζηθικλμν ") for _ in range(200)), None) for i in range(5)]
    kept = {r["doc_id"] for r in corpus_pipeline.keep_identified(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), None).collect()}
    assert len(kept & set(range(600))) >= 598 and not kept & set(range(1000, 1005))


def test_mix_takes_rows_without_an_id(spark):
    rows = [(None if i % 2 else i // 4, f"w{i} " * 5, "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(str, mixing.mixed_documents(df).collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("unique", [5, 1])
def test_near_dedup_keeps_another_text_of_the_same_id(spark, unique):
    copy = " ".join(f"word{k}" for k in range(300))
    other = " ".join(f"else{k}" for k in range(300))
    df = spark.createDataFrame([(1, copy), (5, copy), (unique, other), (None, other + " x")], "doc_id long, text string")
    assert {tuple(r) for r in simhash.kept_documents(df).collect()} == {(1, copy), (unique, other), (None, other + " x")}
