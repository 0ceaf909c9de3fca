"""Reads over a versioned log (k, ts, op, values): newest versions, points, ranges, snapshots, overlays and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounds import between
from ..schema import DELETE


def newest(log: DataFrame, at: int | None = None, key: str = "k", order: str = "ts", partition: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key, tombstones included, as of `at`.

    max_by is combined before the shuffle, so a key with any share of the log sends one row a task.
    """
    rows = log if at is None else log.where(F.col(order) <= F.lit(at))
    keys = [*partition, key]
    rest = [c for c in rows.columns if c not in (*keys, order)]
    out = rows.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])
    return out.select(*rows.columns)


def retained(log: DataFrame, oldest: int | None = None) -> DataFrame:
    """What compaction keeps: the newest version of each key as of `oldest`, the oldest read point in use, and all later ones."""
    if oldest is None:
        return newest(log)
    return newest(log, oldest).unionByName(log.where(F.col("ts") > F.lit(oldest)))


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("op") != DELETE).drop("op")


def scan(log: DataFrame, where: Column | None = None, at: int | None = None) -> DataFrame:
    """Live keys as of `at`. Only key predicates may come first; they reach the file scan."""
    return live(newest(log if where is None else log.where(where), at))


def point_get(log: DataFrame, key: str, at: int | None = None) -> DataFrame:
    return scan(log, F.col("k") == key, at)


def multi_get(log: DataFrame, keys: Sequence[str], at: int | None = None) -> DataFrame:
    """A row for every key asked for; the version of a missing or deleted key is null."""
    asked = log.sparkSession.createDataFrame([(k,) for k in keys], "asked string")
    found = scan(log, F.col("k").isin(list(keys)), at)
    return asked.join(found, F.col("asked") == F.col("k"), "left").drop("k").withColumnRenamed("asked", "k")


def range_scan(log: DataFrame, low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = True, at: int | None = None) -> DataFrame:
    return scan(log, between(F.col("k"), low, high, low_inclusive, high_inclusive), at)


def prefix_scan(log: DataFrame, prefix: str, at: int | None = None) -> DataFrame:
    return scan(log, F.col("k").startswith(prefix), at)


def by_priority(sources: Sequence[DataFrame], key: str = "k") -> DataFrame:
    """The row of each key from the first source that has it; within a source the newest."""
    tagged = [s.withColumn("layer_rank", F.lit(n)) for n, s in enumerate(sources)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t)
    return by_layer(merged, key)


def by_layer(rows: DataFrame, key: str = "k") -> DataFrame:
    """The row of each key from the lowest layer_rank, and there the newest; tombstones hide what lies below."""
    place = F.struct(-F.col("layer_rank"), F.col("ts"))
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(*[F.max_by(c, place).alias(c) for c in rest]).select(*rows.columns)


def two_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sources of one row a key each, the left one first."""
    names = [c for c in left.columns if c != "k"]
    l, r = (d.select("k", F.struct(*names).alias(n)) for d, n in ((left, "l"), (right, "r")))
    return l.join(r, "k", "full_outer").select("k", F.coalesce("l", "r").alias("x")).select("k", *[F.col(f"x.{c}").alias(c) for c in names])


def versions(log: DataFrame) -> DataFrame:
    """All versions with the interval [ts, next_ts) in which each is the newest."""
    return log.withColumn("next_ts", F.lead("ts").over(Window.partitionBy("k").orderBy("ts")))


def as_of(asks: DataFrame, log: DataFrame, ask_at: str, log_at: str, values: Sequence[str], by: Sequence[str] = (), width: int = 1 << 12, strict: bool = False) -> DataFrame:
    """Each ask with the values of the last log row at or before it (before it, if strict) of the same `by`.

    Time is cut into bins of `width`. Windows run within a bin, and over one row a bin to carry the last value on, so
    neither a long log nor a hot key meets in one task. The binned columns are longs.
    """
    bin_ = lambda c: F.floor(F.col(c) / width).cast("long")
    keys = [f"by{i}" for i in range(len(by))]
    a = asks.select(F.struct("*").alias("ask"), *[F.col(c).alias(n) for c, n in zip(by, keys, strict=True)], F.col(ask_at).cast("long").alias("at"), bin_(ask_at).alias("bin"))
    b = log.select(F.struct(F.col(log_at).alias("at_"), *values).alias("hit"), *[F.col(c).alias(n) for c, n in zip(by, keys, strict=True)], F.col(log_at).cast("long").alias("at"), bin_(log_at).alias("bin"))
    last = b.groupBy(*keys, "bin").agg(F.max_by("hit", "at").alias("carry"))
    marks = last.unionByName(a.select(*keys, "bin").distinct().withColumn("carry", F.lit(None).cast(last.schema["carry"].dataType)))
    marks = marks.groupBy(*keys, "bin").agg(F.first("carry", ignorenulls=True).alias("carry"))
    marks = _carried(marks, keys)
    side = F.lit(1 if strict else -1)
    both = a.withColumn("hit", F.lit(None).cast(b.schema["hit"].dataType)).withColumn("side", F.lit(0)).unionByName(
        b.withColumn("ask", F.lit(None).cast(a.schema["ask"].dataType)).withColumn("side", side)
    )
    up_to = Window.partitionBy(*keys, "bin").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("hit", F.last("hit", ignorenulls=True).over(up_to)).where("ask is not null")
    joined = both.join(marks, [*keys, "bin"], "left").withColumn("hit", F.coalesce("hit", "carry"))
    return joined.select("ask.*", *[F.col(f"hit.{v}").alias(v) for v in values])


#: Bins that meet in one window; above them one row stands for so many.
_FANOUT = 1 << 12


def _carried(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`carry` of each bin replaced by the last one before it, in two steps, so that not all bins meet in one task."""
    far = [f"{k}_far" for k in keys]
    marks = marks.withColumn("wide", F.floor(F.col("bin") / _FANOUT).cast("long"))
    tops = marks.groupBy(*[F.col(k).alias(f) for k, f in zip(keys, far, strict=True)], F.col("wide").alias("wide_far")).agg(F.max_by("carry", F.when(F.col("carry").isNotNull(), F.col("bin"))).alias("top"))
    over = Window.partitionBy(*far).orderBy("wide_far").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("top", F.last("top", ignorenulls=True).over(over))
    near = Window.partitionBy(*keys, "wide").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("carry", F.last("carry", ignorenulls=True).over(near))
    same = [F.col(k).eqNullSafe(F.col(f)) for k, f in zip([*keys, "wide"], [*far, "wide_far"], strict=True)]
    return marks.join(tops, same, "left").select(*keys, "bin", F.coalesce("carry", "top").alias("carry"))


def running_sum(rows: DataFrame, order: str, value: str, name: str, width: int = 1 << 12) -> DataFrame:
    """`name`: the sum of `value` up to each row in the order of a unique long: within bins, over bins, and over groups of bins."""
    binned = rows.withColumn("bin_", F.floor(F.col(order) / width).cast("long"))
    sums = binned.groupBy(F.col("bin_").alias("of_bin")).agg(F.sum(value).alias("s")).withColumn("wide", F.floor(F.col("of_bin") / _FANOUT).cast("long"))
    upto = Window.orderBy("of_wide").rowsBetween(Window.unboundedPreceding, -1)
    far = sums.groupBy(F.col("wide").alias("of_wide")).agg(F.sum("s").alias("far")).withColumn("far", F.coalesce(F.sum("far").over(upto), F.lit(0)))
    near = F.sum("s").over(Window.partitionBy("wide").orderBy("of_bin").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("near", F.coalesce(near, F.lit(0))).join(far, F.col("wide") == F.col("of_wide")).select("of_bin", (F.col("near") + F.col("far")).alias("before"))
    own = F.sum(value).over(Window.partitionBy("bin_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return binned.join(sums, F.col("bin_") == F.col("of_bin")).withColumn(name, own + F.col("before")).drop("bin_", "of_bin", "before")
