import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratakv.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from(["a", "b", "A", " ", "\n", "\t", "é#", "\x0b", "\x85", "　", "a b c\n", "|"]), max_size=60).map("".join)))
def test_measures(text):
    assert quality_rules.measure(text)[:5] == brute(text)


def test_sketch_quantiles(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(0, 2, 5000))
    df = spark.createDataFrame([(str(i % 2), float(v)) for i, v in enumerate(x)], "g string, x double")
    parts = quality_rules.sketch(df, ["g"])
    both = quality_rules.quantiles(quality_rules.merged(parts, []), [], {"a": 0.25, "b": 0.75}).first()
    assert both["docs"] == 5000
    for name, q in (("a", 0.25), ("b", 0.75)):
        want = np.sort(x)[int(np.ceil(q * 5000)) - 1]
        assert abs(both[name] - want) <= 0.011 * want


def test_outliers_of_a_group_go_and_clean_rows_stay(spark, docs):
    rows = []
    for i in range(300):
        words = [f"word{1000 + (i * 70 + k) % 5000}" for k in range(70)]
        if i % 20 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else None, f"s{i % 2}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", quality_rules.F.lit(1))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df).collect()}
    assert got == {i: i % 20 != 0 for i in range(300)}
    edge = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for d in docs.collect():
        r = edge[d["doc_id"]]
        if len(d["text"] or "") < 1000:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(d["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_verdicts_equal_those_of_brute_force(spark):
    """Groups of all sizes, null ones too, against quantiles taken one by one over the weighted bucket middles."""
    rng, rows = np.random.default_rng(5), []
    for i in range(500):
        lang, source = [("en", "a"), ("en", "b"), ("de", "a"), (None, "c"), ("de", None)][min(int(rng.exponential(1.2)), 4)]
        n = int(rng.integers(52, 120))
        words = ["".join(rng.choice(list("abcdefgh"), max(1, int(rng.normal(5 if lang == "en" else 8, 2))))) + "#" * (rng.random() < (0.3 if source == "b" else 0.004)) for _ in range(n)]
        if i % 37 == 0:
            words = [w + "##" for w in words]
        lines = [" ".join(words[k : k + 10]) for k in range(0, n, 10)]
        if rng.random() < 0.04:
            lines = [x for x in lines for _ in (0, 1)] if i % 5 else [*lines, lines[0]]
        rows.append((i, "\n".join(lines), lang, source))
    base = 1.01 / 0.99
    found = {i: quality_rules.measure(t) for i, t, _, _ in rows}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    passed = [r for r in rows if found[r[0]][0] >= 50 and 100 * found[r[0]][4] <= 50 * found[r[0]][0]]
    middle = lambda x: 0.0 if x <= 0 else base ** np.ceil(np.log(x) / np.log(base)) * 2 / (1 + base)

    def quantile(weighted, q):
        total, below = sum(w for _, w in weighted), 0.0
        for x, w in sorted(weighted):
            below += w
            if below >= q * total - 1e-6:
                return x

    gone = {}
    for name, (a, b, low, high) in quality_rules.RATIOS.items():
        value = {i: found[i][names.index(a)] / max(1, found[i][names.index(b)]) for i in found}
        own = lambda ok: [(middle(value[r[0]]), 1.0) for r in passed if ok(r)]
        light = lambda rows_: [(x, w * quality_rules.PRIOR_DOCS / sum(v for _, v in rows_)) for x, w in rows_]
        for lang, source in {r[2:] for r in passed}:
            whole = own(lambda s: s[2:] == (lang, source)) + light(own(lambda s: s[2] == lang) + light(own(lambda s: True)))  # noqa: B023
            m = quantile(whole, 0.5)
            fence = lambda q: (1 + quality_rules.SPREAD) * quantile(whole, q) - quality_rules.SPREAD * m  # noqa: B023, E731
            least, most = fence(low) * (1 - quality_rules.GUARD) if low is not None else 0, fence(high) * (1 + quality_rules.GUARD)
            for r in passed:
                x, y = found[r[0]][names.index(a)], found[r[0]][names.index(b)]
                if r[2:] == (lang, source) and (x + 1 < least * y or x - 1 > most * y):
                    gone.setdefault(r[0], []).append(name)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert {i: r["failed"] for i, r in got.items() if r["failed"]} == gone and len(gone) > 5
    assert {i for i, r in got.items() if r["kept"]} == {r[0] for r in passed} - set(gone)
    limits = {(r["of_lang"], r["of_source"]): r["symbols_high"] for r in quality_rules.fences(quality_rules.measures(df, "doc_id", "text", "lang", "source")).collect()}
    assert limits["en", "b"] > 2 * limits["en", "a"]
