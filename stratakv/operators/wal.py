"""Write-ahead log: greedy segments, archiving, replay and point-in-time recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEEP_SEGMENTS
from .packing import packed
from .reads import newest


def pack_segments(log: DataFrame, limit: int, order: str = "ts", size: str = "size") -> DataFrame:
    """Segments of a greedy packing: segment_id (from 1), n_records, n_bytes, first, last.

    A segment ends before the record that would take it beyond `limit`; one longer record has a segment of its own.
    """
    placed = packed(log, limit, order, size, overfull=False)
    return placed.groupBy((F.col("run") + 1).alias("segment_id")).agg(F.count("*").alias("n_records"), F.sum(size).alias("n_bytes"), F.min(order).alias("first"), F.max(order).alias("last"))


def archive_list(segments: DataFrame, keep: int = KEEP_SEGMENTS) -> DataFrame:
    """Segments to archive: all but the newest and `keep` before it."""
    top = segments.agg(F.max("segment_id").alias("top"))
    return segments.join(F.broadcast(top), F.col("segment_id") < F.col("top") - keep).drop("top")


def recover_from(log: DataFrame, least_ts: int) -> DataFrame:
    return newest(log.where(F.col("ts") >= least_ts))


def recover_point_in_time(live: DataFrame, archive: DataFrame, target: int) -> DataFrame:
    """State at `target` from both places; a segment that is in both is read from the archive."""
    archived = archive.select("segment_id").distinct()
    rows = archive.unionByName(live.join(archived, "segment_id", "left_anti").select(*archive.columns))
    return newest(rows.drop("segment_id"), target)
