"""Statistics that must come from all documents of a group or of the corpus."""

import numpy as np

from stratakv.llm import quality_classifier, quality_rules


def test_fences_come_from_the_group_alone(spark):
    """A third of the lines are copies: out of place where the group has none, in place where a tenth has them."""
    rows = []
    for i in range(400):
        lines = [" ".join(f"word{1000 + (i * 60 + k * 20 + j) % 9000}" for j in range(20)) for k in range(3)]
        if i == 7 or i % 20 == 0:
            lines = [x for line in lines for x in ("menumenu", line)]
        rows.append((i, "\n".join(lines), "en", "often" if i % 2 == 0 else "never"))
    got = {r["doc_id"]: (r["kept"], r["failed"]) for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, (kept, _) in got.items() if not kept} == {7} and got[7][1] == ["dup_lines"]


def test_word_vectors_come_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "BLOCK", 7)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta"], rng.integers(0, 40))) for _ in range(60)] + [None, "", "alone", "unseen words only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    rows, (places, signs) = quality_classifier.Words(), quality_classifier.index_vectors()
    want = np.zeros((quality_classifier.ROWS, quality_classifier.DIM))
    for t in texts:
        ids = [rows.rows([w.encode()])[0, 0] for w in (t or "").split()]
        for i, w in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    np.add.at(want[w], places[ids[j]], signs[ids[j]])
    assert (quality_classifier.corpus_sums(docs) == want).all()
    model = quality_classifier.train(docs, labels)
    assert np.abs(model.vectors.words[rows.rows([b"unseen"])[0, 0]]).max() > 0
