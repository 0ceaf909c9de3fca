"""Exact dedup with an extendible-hash index on shared files. DataFrame operations only.

The directory maps the leading bits of a text's 64-bit key to a bucket; an overfull bucket is split on its next bit, and
the directory doubles when it has no such bit yet. Every bucket has one owner task: it receives the texts of its key
range, compares those of one key byte by byte, and chains the different ones. Rows find their entry through the
directory again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BLANK, Table, bounded, lookup

#: Entries (distinct texts) that a bucket holds before the directory splits it.
BUCKET_ENTRIES = 50_000
#: Prefixes in the histogram that the directory is built from, as a multiple of the buckets that even keys would need.
PREFIXES_A_BUCKET = 16
#: Owner tasks at most; with more buckets, each owns several.
OWNERS = 4096
#: A text that many rows hold is combined to so many rows before it goes to its owner.
COMBINE = 64


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANK, " ")


def directory(counts: dict[int, int], depth: int, capacity: int = BUCKET_ENTRIES) -> list[int]:
    """Bucket of each of the 2**d prefixes, d <= depth being the global depth that doubling ends at.

    counts: entries by prefix of `depth` bits. One bucket covers all at first; while one holds more than `capacity`
    it is split on its next bit, and the directory doubles when that bit is beyond the global depth.
    """
    full = [0]
    for p in range(1 << depth):
        full.append(full[-1] + counts.get(p, 0))
    buckets, todo, reached = [], [(0, 0)], 0
    while todo:
        prefix, local = todo.pop()
        width = depth - local
        if full[(prefix + 1) << width] - full[prefix << width] > capacity and local < depth:
            todo += [(prefix * 2 + 1, local + 1), (prefix * 2, local + 1)]
            reached = max(reached, local + 1)
        else:
            buckets.append((prefix, local))
    out: list[int] = []
    for b, (_, local) in enumerate(buckets):
        out += [b] * (1 << (reached - local))
    return out


class Index:
    """Bucket files and their directory. entries: bucket, key, chain, sha, keep_id, group_size, a row a distinct text.

    The files are sorted by bucket and key, so that a reader of few buckets opens few of them.
    """

    def __init__(self, entries: DataFrame, pointers: list[int]):
        self.entries, self.pointers = entries, pointers

    def bucket(self, key: str = "key") -> Column:
        return bucket_of(key, self.pointers)

    def find(self, rows: DataFrame, total: int) -> DataFrame:
        """rows (key, sha and more) with keep_id and group_size of their entry, null where the text has no copy."""
        copies = self.entries.where("group_size > 1").select("bucket", "key", "sha", "keep_id", "group_size")
        placed = rows.withColumn("bucket", self.bucket())
        return lookup(placed, copies, ["bucket", "key", "sha"], "group_size", total).drop("bucket")


def bucket_of(key: str, pointers: list[int]) -> Column:
    depth = (len(pointers) - 1).bit_length()
    at = F.shiftrightunsigned(F.col(key), 64 - depth).cast("int") if depth else F.lit(0)
    return F.element_at(F.lit(pointers).cast("array<int>"), at + 1)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> tuple[DataFrame, Index]:
    """(signatures of all rows: doc_id, key, sha; the index).

    A key that one row has needs no comparison. The texts of all others go to the owner of their bucket, after equal ones
    were combined where they are read, and again over COMBINE parts, so that a text which a third of the rows hold
    reaches its owner in few rows. The driver gets a histogram of the keys, of at most 2 * OWNERS * PREFIXES_A_BUCKET
    counts; buckets grow beyond `capacity` rather than outnumber OWNERS by much.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn("key", F.xxhash64("norm"))
    sigs = Table(rows.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-sigs").df
    keys = Table(sigs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), F.min("sha").alias("sha")), "dedup-keys").df

    n = keys.count()
    capacity = max(capacity, n // OWNERS)
    depth = max(1, (n * PREFIXES_A_BUCKET // capacity).bit_length())
    found = keys.groupBy(F.shiftrightunsigned("key", 64 - depth).cast("int").alias("p")).count().collect()
    pointers = directory({r[0]: r[1] for r in found}, depth, capacity)
    buckets = max(pointers) + 1

    repeated = bounded(Table(keys.where("n > 1").select(F.col("key").alias("again")), "dedup-again").df)
    least = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    part = F.pmod(F.spark_partition_id(), F.lit(COMBINE))
    combined = rows.join(repeated, F.col("key") == F.col("again"), "left_semi").groupBy("key", "norm", part.alias("part")).agg(*least)
    dealt = combined.withColumn("bucket", bucket_of("key", pointers))
    dealt = dealt.repartition(min(buckets, OWNERS), "bucket") if buckets > 1 else dealt.coalesce(1)
    compared = dealt.groupBy("bucket", "key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("norm")) - 1
    chained = compared.select("bucket", "key", chain.alias("chain"), F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    alone = keys.where("n = 1").select(bucket_of("key", pointers).alias("bucket"), "key", F.lit(0).alias("chain"), "sha", "keep_id", F.lit(1).cast("long").alias("group_size"))
    entries = alone.unionByName(Table(chained, "dedup-chains").df)
    owned = entries.repartitionByRange(min(buckets, OWNERS), "bucket", "key") if buckets > 1 else entries.coalesce(1)
    return sigs, Index(Table(owned.sortWithinPartitions("bucket", "key", "chain"), "dedup-index").df, pointers)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row a document: id, keep_id (smallest id of its group), group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space has become one space; a null text is an
    empty one. Of rows that share id and text, all are kept or none. A row with a null id stays only if its group has
    no other. No rows in, no rows out.
    """
    sigs, index = build_index(docs, id_col, text_col, capacity)
    out = index.find(sigs, sigs.count())
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("doc_id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Of rows that share id and text one stays; rows without an id stay."""
    found = Table(exact_dedup(docs, id_col, text_col), "dedup-found").df
    own = (docs[id_col] == F.col("id_")) & (F.sha2(normalised(text_col), 256) == F.col("sha_"))
    keys = [F.col(id_col).alias("id_"), F.col("text_sha256").alias("sha_")]
    gone = found.where("not kept").select(*keys).distinct()
    out = docs.join(bounded(Table(gone, "dedup-gone").df), own, "left_anti")
    twice = Table(found.where("kept").groupBy(*keys).count().where("count > 1 and id_ is not null").select("id_", "sha_"), "dedup-twice").df
    if twice.isEmpty():
        return out
    again = out.join(twice, own, "left_semi").withColumn("sha_", F.sha2(normalised(text_col), 256)).dropDuplicates([id_col, "sha_"]).drop("sha_")
    return out.join(twice, own, "left_anti").unionByName(again)
