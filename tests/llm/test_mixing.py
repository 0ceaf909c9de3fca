import re

import pytest

from stratakv.llm import mixing


def shares(sizes, weights, epochs):
    """Targets by sharing again and again until none is above its cap."""
    total, out, open_ = sum(sizes), [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}
    left = total
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level > epochs * sizes[i]}
        if not over:
            for i in open_:
                out[i] = weights[i] * level
            break
        for i in over:
            out[i] = epochs * sizes[i]
            left -= out[i]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[100, 1, 1, 50, 7], [5, 5, 5], [1000, 0, 3], [0, 0], [40]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s, 1) for i, s in enumerate(sizes)], "source string, source_size long, n long")
    got = [r["target"] for r in mixing.targets(df, (1, 2, 3), 3).orderBy("source").collect()]
    assert got == pytest.approx(shares(sizes, [i % 3 + 1 for i in range(len(sizes))], 3))


@pytest.mark.parametrize("slice_rows", [3, 20_000])
def test_budgets_are_met_exactly(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    sources = ["b", "a", None, "ñ", "hot"]
    rows = [(i, " ".join(["w"] * (i % 17)), sources[i % 5] if i < 100 else "hot") for i in range(400)] + [(7, "w w", "a"), (7, "w w", "a"), (999, None, "only null")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("x"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    order = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    size = {s: sum(len(re.findall(r"\S+", t or "")) for _, t, u in rows if u == s) for s in order}
    want = dict(zip(order, shares([size[s] for s in order], [i % 3 + 1 for i in range(len(order))], 3), strict=True))
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]} and own[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)


def test_documents_are_repeated_whole(spark, docs):
    df = docs.where("text is not null")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and set(out.select("text").collect()) <= set(df.select("text").collect())
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
