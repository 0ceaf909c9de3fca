"""Flush runs, block zone maps, bloom filters and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCK_BYTES, BLOOM_BITS_PER_KEY, BLOOM_PROBES
from .packing import packed
from .reads import as_of


def flush_runs(log: DataFrame, threshold: int, size: str = "size") -> DataFrame:
    """The log in runs, each ended by the record that brings it to `threshold` bytes: run, rows, bytes, first and last ts."""
    placed = packed(log, threshold, "ts", size, overfull=True)
    return placed.groupBy("run").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def zone_map(rows: DataFrame, order: str, key: str = "k", size: str = "size", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of sorted entries, each ended by the entry that brings it to `block_bytes`: block_id, least and greatest key,
    entries and bytes. Keys are in the order of `order`, so a block's first and last entries have its least and greatest."""
    placed = packed(rows, block_bytes, order, size, overfull=True)
    blocks = placed.groupBy(F.col("run").alias("block_id")).agg(F.count("*").alias("n_entries"), F.sum(size).alias("n_bytes"), F.min(order).alias("min_at"), F.max(order).alias("max_at"))
    of = lambda name, at: rows.select(F.col(key).alias(name), F.col(order).alias(at))
    return blocks.join(of("min_key", "min_at"), "min_at").join(of("max_key", "max_at"), "max_at").select("block_id", "min_key", "max_key", "n_entries", "n_bytes", "min_at", "max_at")


def prune(probes: DataFrame, zones: DataFrame, at: str) -> DataFrame:
    """Each probe with the one block whose key range holds it, if any: blocks are sorted and apart."""
    found = as_of(probes, zones, at, "min_at", ["block_id", "max_at"])
    return found.where(F.col("max_at") >= F.col(at)).drop("max_at")


class Bloom:
    """A bloom filter, built and probed with column functions. Its bits travel as one binary literal."""

    #: Bits at most, 8 MB. A filter for more keys than that is good for lets more rows through, never fewer.
    MOST_BITS = 1 << 26

    def __init__(self, data: bytes, probes: int):
        self.data, self.bits, self.probes = data, 8 * len(data), probes

    @staticmethod
    def places(key: str, bits: int, probes: int) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(probes)])

    @classmethod
    def build(cls, rows: DataFrame, key: str, bits: int | None = None, probes: int = BLOOM_PROBES) -> Bloom:
        """Sized for the number of rows, unless `bits` says otherwise. bits/64 words at most come to the driver."""
        if bits is None:
            bits = 1 << min(max(10, (rows.count() * BLOOM_BITS_PER_KEY - 1).bit_length()), cls.MOST_BITS.bit_length() - 1)
        at = rows.select(F.explode(cls.places(key, bits, probes)).alias("at"))
        words = at.groupBy(F.expr("cast(at div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("w"))
        out = bytearray(bits // 8)
        for r in words.collect():
            out[8 * r["word"] : 8 * r["word"] + 8] = r["w"].to_bytes(8, "little", signed=True)
        return cls(bytes(out), probes)

    def may_contain(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows that the filter lets through: all that it was built with, and about one in a hundred others."""
        hit = F.lit(True)
        for i in range(self.probes):
            place = F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(self.bits))
            byte = F.conv(F.hex(F.substring(F.lit(self.data), F.shiftright(place, 3).cast("int") + 1, 1)), 16, 10).cast("int")
            hit = hit & (F.call_function("shiftright", byte, place.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1)
        return rows.where(hit)


def checksums(rows: DataFrame, id_col: str, payload: str) -> DataFrame:
    return rows.select(id_col, F.crc32(F.col(payload).cast("binary")).alias("crc"), F.octet_length(payload).cast("long").alias("n_bytes"))


def audit(rows: DataFrame, stored: DataFrame, id_col: str, payload: str) -> DataFrame:
    """Rows whose payload does not have its stored checksum, missing ones included."""
    now, then = checksums(rows, id_col, payload), stored.select(F.col(id_col).alias("of"), F.col("crc").alias("stored_crc"))
    return now.join(then, F.col(id_col) == F.col("of"), "left").where(~F.col("crc").eqNullSafe(F.col("stored_crc"))).drop("of")
