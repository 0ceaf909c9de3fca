"""Manifest replay, and compaction: what to merge, what overlaps, and the merge itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import L0_TRIGGER, LAST_LEVEL, LEVEL_BASE_BYTES, LEVEL_FACTOR
from .intervals import meet
from .reads import by_layer


def replay(manifest: DataFrame) -> DataFrame:
    """Live files: added and not removed since, at the place of the first addition that is left."""
    rows = manifest.where(F.col("kind") != "WAL")
    gone = F.max(F.when(F.col("kind") == "DEL", F.col("seq")))
    last = rows.groupBy("level", "id").agg(gone.alias("gone"), F.max(F.when(F.col("kind") == "SST", F.col("seq"))).alias("added"))
    return last.where("added is not null and (gone is null or added > gone)").select("level", "id", F.col("added").alias("seq"))


def next_ids(manifest: DataFrame) -> DataFrame:
    top = lambda kind: (F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("id"))), F.lit(0)) + 1).alias(f"next_{kind.lower()}_id")
    return manifest.agg(top("SST"), top("WAL"))


def pick_compaction(files: DataFrame) -> DataFrame:
    """(level, output_level) to compact next, none if all is well: L0 with enough files first, else the lowest full level."""
    counts = files.groupBy("level").agg(F.count("*").alias("n"))
    full = (F.col("level") > 0) & (F.col("level") < LAST_LEVEL) & (F.col("n") * LEVEL_BASE_BYTES > LEVEL_BASE_BYTES * F.pow(F.lit(LEVEL_FACTOR), F.col("level")))
    due = counts.where(((F.col("level") == 0) & (F.col("n") >= L0_TRIGGER)) | full)
    return due.agg(F.min("level").alias("level")).where("level is not null").select("level", (F.col("level") + 1).alias("output_level"))


def overlapping(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of files whose closed key ranges overlap: (sst_id, other_id). Keys are longs."""
    side = lambda d, p: d.select(F.col("sst_id").alias(f"{p}id"), F.col("min_key").alias(f"{p}lo"), F.col("max_key").alias(f"{p}hi"))
    return meet(side(upper, "a_"), side(lower, "b_")).select(F.col("a_id").alias("sst_id"), F.col("b_id").alias("other_id"))


def compaction_inputs(files: DataFrame) -> DataFrame:
    """(level, id, output_level) of the files that the next compaction reads; none if all is well.

    files: level, id, min_key, max_key (longs). All of L0 and L1 if L0 is due; else the first file by id of the level
    and the files of the level below that overlap it.
    """
    due = pick_compaction(files).first()
    if due is None:
        return files.select("level", "id", F.lit(1).alias("output_level")).limit(0)
    level, below = due["level"], files.where(F.col("level") == due["output_level"])
    if level == 0:
        return files.where("level <= 1").select("level", "id", F.lit(1).alias("output_level"))
    first = files.where(F.col("level") == level).agg(*[F.min_by(c, "id").alias(c) for c in ("level", "min_key", "max_key")], F.min("id").alias("id")).select("level", "id", "min_key", "max_key")
    named = lambda d: d.withColumnRenamed("id", "sst_id")
    under = overlapping(named(first), named(below)).select(F.lit(level + 1).alias("level"), F.col("other_id").alias("id"))
    return first.select("level", "id").unionByName(under).withColumn("output_level", F.lit(level + 1))


def compact(rows: DataFrame) -> DataFrame:
    """One version a key, from the newest layer; tombstones are kept, as older levels may hold the key."""
    return by_layer(rows)
