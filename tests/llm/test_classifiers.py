import random

import numpy as np
import pytest

from stratakv.llm import language_id, quality_classifier, toxicity

WORDS = {"en": "the of and to in that was with for this ing tion".split(), "fr": "le la les des une est que pour dans ment eau eux".split(), "de": "der die und das nicht ein ich mit ung keit sch ver".split()}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.choice([1, 1, 2]))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Labelled documents; doc_id, lang and labels tell nothing but through the text."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(900):
        lang = rng.choice(list(WORDS))
        words = text(rng, lang).split()
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            words[rng.randrange(40)] = rng.choice(["idiot", "zorkla", "zorkle", "zorkmo"])
        if not good:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_language_id(spark, corpus, docs, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANGUAGE", 150)
    df, _ = corpus
    model = language_id.train(df)
    got = language_id.identify(df, model).join(df, "doc_id").where("pmod(crc32(cast(doc_id as string)), 4) = 2")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    edge = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [edge[i]["lang_pred"] for i in (0, 1, 2, 7, 10)] == ["und"] * 5
    assert all(0 <= r["score"] <= 1 for r in edge.values()) and edge[4]["lang_pred"] in WORDS
    assert language_id.identify(docs.limit(0), model).count() == 0
    nothing = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    alone = language_id.Model.fit(["hello there"], ["en"])
    assert alone.predict("hi") == ("en", 1.0, False)


@pytest.mark.parametrize("k", [2, 3, 4, 5, 12])
def test_codewords_are_apart(k):
    code = language_id.codebook(k).astype(int)
    apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
    assert apart >= max(1, 2 ** (k - 2) if k <= 5 else 8)


def test_grams_of_blocks(monkeypatch):
    t = "Some TEXT, with ünïcode 123 and more of it " * 20
    whole = language_id.frequencies(t)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    assert np.allclose(language_id.frequencies(t), whole, atol=1e-3)


@pytest.mark.parametrize(("module", "column", "mod", "out"), [(quality_classifier, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifiers_on_held_out_rows(spark, corpus, docs, module, column, mod, out):
    df, labels = corpus
    model = module.train(df, labels)
    got = module.classify(df, model).join(labels, "doc_id").where(f"pmod(crc32(cast(doc_id as string)), {mod}) = {out}")
    assert got.where(f"predicted = {column}").count() / got.count() > 0.95
    edge = module.classify(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in edge)
    assert {r["score"] for r in module.classify(docs, module.train(df, labels.limit(0))).collect()} == {0.5}
    assert module.classify(docs.limit(0), model).count() == 0


def patterns(votes):
    rows, n = np.unique(votes, axis=0, return_counts=True)
    return rows.astype(float), n.astype(float)


def test_correlated_voters_share_their_weight():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(float)
    vote = lambda q, p=0.02: (rng.random(4000) < np.where(y == 1, q, p)).astype(int)
    same = vote(0.6)
    model = toxicity.LabelModel(*patterns(np.column_stack([vote(0.6), vote(0.7), vote(0.5), same, same, same])), 0.3)
    assert model.weight[:3].min() > 0.7 and model.weight[3:6].max() < 0.5
    assert np.abs(model.given[1, :6] - [0.6, 0.7, 0.5, 0.6, 0.6, 0.6]).max() < 0.06


def test_posteriors_come_from_votes_and_not_from_labels(spark):
    """A few labels are wrong. The posteriors follow the words; labels only propose the voters."""
    rng, rows, truth = random.Random(3), [], []
    bad = ["idiot", "zorkla", "zorkmo", "vermpa", "vermto", "scum"]
    for i in range(1200):
        words = text(rng, "en").split()
        truth.append(int(rng.random() < 0.2))
        for w in rng.sample(bad, 3) if truth[-1] else ():
            words[rng.randrange(40)] = w
        rows.append((i, " ".join(words)))
    labels = [(i, 1 - t if rng.random() < 0.04 else t) for i, t in enumerate(truth)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given = {}
    counts = lambda v: given.setdefault("n", toxicity.vote_counts(docs, v, (4, 2)))
    model = toxicity.fit([(t, y) for (_, t), (_, y) in zip(rows, labels, strict=True)], counts)
    assert sum(given["n"].values()) == docs.where("crc32(cast(doc_id as string)) % 4 <> 2").count()
    got = model.scorer()([t for _, t in rows]) >= 0.5
    said = np.array([y for _, y in labels])
    assert np.mean(got == np.array(truth)) > 0.97 and (got != said).sum() > 25
