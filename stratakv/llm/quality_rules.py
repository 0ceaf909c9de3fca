"""Quality rules whose cutoffs are quantiles, from mergeable sketches, of a document's own language and source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, bounded, map_text

# The symbols, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # bytes split at space and 9-13 only
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    if n > 3:
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        a = np.fromiter(map(number.__getitem__, words), np.int64, n)
        pair = np.unique(a[:-1] * len(number) + a[1:], return_inverse=True)[1].ravel()
        _, same, count = np.unique(pair[:-1] * len(number) + a[2:], return_inverse=True, return_counts=True)
        again = count[same.ravel()] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= again
        repeated = int(hit.sum())
    chars = len(text) - sum(map(text.count, BLANKS))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


#: Relative error of a sketch's quantiles; its buckets are powers of (1 + e) / (1 - e).
SKETCH_ERROR = 0.01
_BASE = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)
_ZERO = -1_000_000
#: Measures by name: numerator, denominator, and the quantiles of the lower and the upper tail. Up to a tenth of a group
#: may be made of symbols, or of the long words that symbols make.
RATIOS = {
    "word_length": ("word_chars", "n_words", 0.05, 0.9),
    "symbols": ("n_symbols", "n_words", None, 0.9),
    "dup_lines": ("n_dup_lines", "n_lines", None, 0.98),
    "repeats": ("n_repeat_words", "n_words", None, 0.98),
}
#: A fence stands this many times the distance from the median to the tail's quantile beyond that quantile.
SPREAD = 2.0
#: A fence's share that is left for the sketch's error.
GUARD = 2 * SKETCH_ERROR
#: Weight, in documents, at which a language's sketch is merged into those of its sources, and that of all into it.
PRIOR_DOCS = 30


def sketch(values: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Quantile sketches, a row a bucket: keys, bucket, n. Merging sketches is adding n by bucket."""
    bucket = F.when(F.col(value) <= 0, F.lit(_ZERO)).otherwise(F.ceil(F.log(F.col(value)) / float(np.log(_BASE)))).cast("int")
    return values.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def shrunk(own: DataFrame, parent: DataFrame, keys: list[str], shared: list[str], weight: float = PRIOR_DOCS) -> DataFrame:
    """Sketches by `keys`, each merged with the sketch of its `shared` keys, which counts as `weight` documents."""
    share = F.lit(weight) * F.col("n") / F.sum("n").over(Window.partitionBy(*shared))
    prior = parent.select(*[F.col(c).alias(f"of_{c}") for c in shared], F.col("bucket"), share.alias("n"))
    met = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in shared]
    given = own.select(*keys).distinct().join(prior, met).select(*keys, "bucket", "n")
    return merged(own.select(*keys, "bucket", F.col("n").cast("double").alias("n")).unionByName(given), keys)


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, docs, and a column for each quantile of `at`: the middle of the first bucket that reaches it."""
    w = Window.partitionBy(*keys)
    below = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    t = sketches.withColumn("below", below).withColumn("docs", F.sum("n").over(w))
    middle = F.when(F.col("bucket") == _ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(_BASE), F.col("bucket")) * (2 / (1 + _BASE)))
    return t.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.min(F.when(F.col("below") >= F.col("docs") * q - 1e-6, middle)).alias(name) for name, q in at.items()])


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """doc_id, lang, source, the counts of `measure` and base_failed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))

    def start():
        def run(texts):
            a = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(names))
            return [pa.array(a[:, k]) for k in range(len(names))]

        return run

    out = map_text(rows, ["doc_id", "lang", "source"], "text", start, ", ".join(f"{n} long" for n in names))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratio(name: str) -> Column:
    a, b = RATIOS[name][:2]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def fences(found: DataFrame) -> DataFrame:
    """(of_lang, of_source, and a lower and an upper fence for each measure), from sketches over all that pass the base rule."""
    passed = found.where("not base_failed")
    values = passed.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("what"), _ratio(n).alias("x")) for n in RATIOS])).alias("v")).select("lang", "source", "v.*")
    own = Table(sketch(values, ["lang", "source", "what"]), "sketches").df
    by_lang = shrunk(merged(own, ["lang", "what"]), merged(own, ["what"]), ["lang", "what"], ["what"])
    full = shrunk(own, by_lang, ["lang", "source", "what"], ["lang", "what"])
    at = {"median": 0.5} | {f"q{round(1000 * q)}": q for r in RATIOS.values() for q in r[2:] if q is not None}
    t = quantiles(full, ["lang", "source", "what"], at)
    pick = lambda k: F.coalesce(*[F.when(F.col("what") == n, F.col(f"q{round(1000 * r[k])}") if r[k] is not None else F.lit(None)) for n, r in RATIOS.items()])
    beyond = lambda tail: (1 + SPREAD) * tail - SPREAD * F.col("median")
    t = t.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "what", (beyond(pick(2)) * (1 - GUARD)).alias("low"), (beyond(pick(3)) * (1 + GUARD)).alias("high"))
    of = lambda n, c: F.max(F.when(F.col("what") == n, F.col(c))).alias(f"{n}_{c}")
    return t.groupBy("of_lang", "of_source").agg(*[of(n, c) for n in RATIOS for c in ("low", "high")])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, kept.

    `failed` names the measures outside their fences, by more than one count: a single symbol, line or word is no
    outlier, however clean the group. A document is kept if it passes the base rule and all measures. A group's own
    sketch outweighs its language's from PRIOR_DOCS documents on, and there is no other fence than its quantiles give.
    Null languages and sources are groups of their own; a null text has no words and fails the base rule, as all short
    ones do. No rows in, no rows out.
    """
    found = Table(measures(docs, id_col, text_col, lang_col, source_col), "measures").df
    limits = bounded(Table(fences(found), "fences").df)
    t = found.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    out = [F.when((F.col(a) + 1 < F.col(f"{n}_low") * F.col(b)) | (F.col(a) - 1 > F.col(f"{n}_high") * F.col(b)), F.lit(n)) for n, (a, b, *_) in RATIOS.items()]
    t = t.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*out))))
    return t.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
    )
