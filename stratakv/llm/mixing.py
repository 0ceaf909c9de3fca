"""Mixing sources to target weights: hash-random order, range slices, prefix sums, exact cuts. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Table, bounded, text_hash

#: Rows that a range slice of a source holds on average; only a source's cut slice is sorted.
SLICE_ROWS = 20_000
#: A table with a row for each source is broadcast up to this many rows, and shuffled beyond.
BROADCAST_SOURCES = 10_000
#: Bits of the random key.
KEY_BITS = 60


def words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: str, seed: str) -> Column:
    """The same for every run: the first 15 hex digits of an md5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """Budget of each source: sizes (source, source_size, n) with rank and target added.

    Sources in code-point order, null last, weigh `weights`, repeating, and share the sum of all sizes; a target stops
    at `epochs` times its source's size and the rest is shared again by weight. In the order of cap over weight the
    capped sources come first, so the common level is the largest that one of the running remainders allows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumn("rank", rank).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    left = F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))
    share = F.col("weights") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    t = t.withColumn("level", left.cast("double") / share.cast("double"))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    return t.select("source", "rank", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: str = "mix", whole: bool = False, hashed: bool = False) -> DataFrame:
    """One row a document: id, size, source, source_size, target, taken (words the mix takes, repeats counted); if `hashed`, text_hash.

    A budget of e whole epochs and a rest takes each document e times and, in the order of the random key, once more
    while the rest lasts; the document at the cut gives just the words that are left. With `whole` it counts in full
    if at least half of it fits, else not at all. Rows without words take nothing; ties of the key fall to id, then
    size. A null source is a source of its own. No rows in, no rows out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), *[text_hash(text_col).alias("text_hash")] * hashed)
    rows = Table(rows.withColumn("key", random_key("doc_id", seed)), "mix-rows").df
    plan = Table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, epochs), "mix-sources").df
    few = plan.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    plan = plan.withColumn("budget", F.floor("target")).withColumn("turns", F.expr("if(source_size = 0, 0L, budget div source_size)"))
    plan = plan.withColumn("rest", F.expr("budget - turns * source_size"))
    plan = plan.withColumn("width", F.lit(1 << KEY_BITS) / (F.floor(F.col("n") / SLICE_ROWS) + 1)).withColumnRenamed("source", "of")

    sliced = rows.join(small(plan), F.col("source").eqNullSafe(F.col("of"))).withColumn("slice", F.floor(F.col("key") / F.col("width")).cast("long"))
    sums = sliced.groupBy("rank", "rest", "slice").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    cut = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    cut = cut.groupBy(F.col("rank").alias("cut_rank")).agg(F.min("slice").alias("cut_slice"), F.min("before").alias("before"))
    cut = Table(cut, "mix-cuts").df

    placed = sliced.join(small(cut), F.col("rank") == F.col("cut_rank"), "left")
    out = ["doc_id", "size", "source", "source_size", "target", *["text_hash"] * hashed]
    outside = placed.where(~F.col("slice").eqNullSafe(F.col("cut_slice")))
    outside = outside.select(*out, (F.col("turns") * F.col("size") + F.when(F.col("slice") < F.col("cut_slice"), F.col("size")).otherwise(0)).alias("taken"))
    inside = placed.where(F.col("slice") == F.col("cut_slice"))
    order = Window.partitionBy("rank").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))
    if whole:
        part = F.when((F.col("size") > 0) & (2 * F.col("left") >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    inside = inside.withColumn("left", left).select(*out, (F.col("turns") * F.col("size") + part).alias("taken"))
    return outside.unionByName(inside).withColumnsRenamed({"doc_id": id_col, "source": source_col})


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, whole, and as many times as it takes them; rows of one id, source and text alike."""
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, whole=True, hashed=True, **options).where("taken > 0")
    keys = [F.col(id_col).alias("taken_id"), F.col(source_col).alias("taken_source"), F.col("text_hash").alias("taken_hash")]
    times = taken.groupBy(*keys).agg(F.max(F.floor(F.col("taken") / F.col("size"))).cast("int").alias("times_"))
    times = bounded(Table(times, "mix-times").df)
    same = docs[id_col].eqNullSafe(F.col("taken_id")) & docs[source_col].cast("string").eqNullSafe(F.col("taken_source")) & (text_hash(docs[text_col]) == F.col("taken_hash"))
    joined = docs.join(times, same)
    return joined.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_")))).select(*[docs[c] for c in docs.columns])
