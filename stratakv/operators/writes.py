"""Write batches and write sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE


def stamp(batch: DataFrame, base: int) -> DataFrame:
    """A batch's rows with ts = base + place in order of pos, so that a later op on a key wins. pos counts from 0."""
    return batch.select("k", (F.lit(base) + F.col("pos")).alias("ts"), "op", "v")


def fold_write_set(ops: DataFrame) -> DataFrame:
    """The last op of each transaction and key: a put clears a delete before it, and the reverse."""
    rest = [c for c in ops.columns if c not in ("txn_id", "k", "pos")]
    return ops.groupBy("txn_id", "k").agg(F.max("pos").alias("pos"), *[F.max_by(c, "pos").alias(c) for c in rest])


def batch_stats(batch: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Number of ops and deletes, and the batch's size: bytes of keys and values."""
    size = F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
    return batch.agg(F.count("*").alias("n_ops"), F.count_if(F.col("op") == DELETE).alias("n_deletes"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("approximate_size"))
