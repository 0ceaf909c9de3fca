"""SimHash near-dedup: one-wildcard variants of few segments are the keys of an equality join, and links are verified."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded, lookup, map_text, text_hash
from .components import connected_components

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: Buckets of up to so many fingerprints give all their pairs; larger ones first link to their least member.
PAIRS_UP_TO = 24
#: Strays of an open bucket (members outside its largest component) that all its members are compared with; a bucket of
#: more is cut up first. About where the rows of the pieces cost as much as the comparisons they save.
STRAYS_UP_TO = 256
#: Fingerprints of one piece that are compared with as many others in one group of rows.
PART = 2000
#: A key's low bits are the number of its variant; no design has so many.
TAGS = 1 << 12
#: Shingles that are hashed before their bits are summed.
BLOCK = 1 << 14


def fingerprint(text: str | None) -> int:
    """Of the XXH64 hashes of all shingles, repeats included, the bits that over half have."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and space and 9-13 only
    if not words:
        return 0
    line, n = b" ".join(words), len(words) - SHINGLE + 1
    h = xxhash.xxh64_intdigest
    if n <= 1:
        return h(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[SHINGLE - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        block = zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)
        a = np.array([h(line[s:e], SEED) for s, e in block], np.uint64)
        ones += np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep`, fp): the fingerprint of every whole text as a signed long."""

    def start():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))]

    return map_text(docs, [id_col, *keep], text_col, start, "fp long").withColumnRenamed(id_col, "doc_id")


def segments(n: int) -> list[int]:
    """The 64 bits cut into n masks of nearly equal length."""
    edges = [round(BITS * k / n) for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def variants(n: int) -> list[int]:
    """Masks of the one-wildcard variants for n segments; two fingerprints within DISTANCE bits agree under at least one.

    Of 3 segments one differs in at most one bit (4 differences cannot give each of three two). Of n > 3 segments at
    least n - 4 are alike, so some n - 3 together differ in at most one bit. A variant leaves one bit out.
    """
    take = 1 if n == 3 else n - 3
    masks = [sum(c) for c in combinations(segments(n), take)]
    return sorted({m & ~(1 << b) for m in masks for b in range(BITS) if m >> b & 1})


def choose_segments(rows: int) -> int:
    """The number of segments with the least work: rows of the index, and pairs that agree in a variant by chance."""
    def work(n: int) -> float:
        masks = variants(n)
        return rows * len(masks) * 20 + sum(rows**2 / 2 ** (1 + m.bit_count()) for m in masks)

    return min((3, 5, 6, 7, 8), key=work)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def links(fps: DataFrame, count: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within DISTANCE bits.

    A bucket is what agrees in a variant. Small buckets give all their near pairs. The members of a large one link
    to its least member where that is near; of the pairs left, only those whose ends are not yet connected can
    matter. Those are all compared, but in buckets of many strays only where they agree in a piece as well.
    """
    masks = variants(choose_segments(count))
    each = fps.select("fp", F.posexplode(F.lit([_signed(m) for m in masks])).alias("tag", "mask"))
    hashed = F.xxhash64("tag", F.col("fp").bitwiseAND(F.col("mask")))
    keyed = each.select("fp", hashed.bitwiseAND(F.lit(-TAGS)).bitwiseOR(F.col("tag").cast("long")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    sizes = Table(sizes, "bucket-sizes").df
    buckets = Table(lookup(keyed, sizes, ["key"], "n", count * len(masks)).where("n > 1"), "buckets").df
    few = buckets.where(F.col("n") <= PAIRS_UP_TO).select("fp", "key")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _near("x.fp", "y.fp"))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = buckets.where(F.col("n") > PAIRS_UP_TO)
    stars = many.where((F.col("fp") != F.col("least")) & _near("fp", "least")).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    found = Table(pairs.unionByName(stars).distinct(), "links").df
    if many.isEmpty():
        return found
    roots = connected_components(found)
    own = many.select("fp", "key").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "key", F.coalesce("root", "fp").alias("root"))
    own = Table(own, "bucket-roots").df
    # In a bucket of several components only those besides its largest, which are few as a rule, are met with all the rest.
    shares = own.groupBy("key", "root").agg(F.count("*").alias("rows"))
    split = shares.groupBy("key").agg(F.max_by("root", "rows").alias("largest"), (F.sum("rows") - F.max("rows")).alias("strays"))
    split = bounded(Table(split.where("strays > 0"), "open-keys").df)
    opened = own.join(split, "key")
    strays = Table(opened.where((F.col("root") != F.col("largest")) & (F.col("strays") <= STRAYS_UP_TO)).select("fp", "key", "root"), "strays").df
    if not strays.isEmpty():
        rest = own.alias("y").join(bounded(strays).alias("x"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _near("x.fp", "y.fp"))
        found = found.unionByName(_ends(rest))
    crowded = opened.where(F.col("strays") > STRAYS_UP_TO)
    return found if crowded.isEmpty() else found.unionByName(_ends(_by_pieces(crowded, masks)))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def pieces(mask: int) -> list[int]:
    """The bits that a variant leaves open, cut into DISTANCE + 1 masks; of two near fingerprints of its bucket one is alike."""
    left = [b for b in range(BITS) if not mask >> b & 1]
    edges = [round(len(left) * k / (DISTANCE + 1)) for k in range(DISTANCE + 2)]
    return [sum(1 << b for b in left[i:j]) for i, j in zip(edges, edges[1:], strict=False)]


def _by_pieces(members: DataFrame, masks: list[int]) -> DataFrame:
    """Near pairs x, y of different components in a bucket, x a stray: compared where they agree in a piece, in squares of parts."""
    cuts = [(tag, k, _signed(p)) for tag, m in enumerate(masks) for k, p in enumerate(pieces(m))]
    cuts = members.sparkSession.createDataFrame(cuts, "tag long, piece int, bits long")
    fine = members.join(F.broadcast(cuts), F.col("key").bitwiseAND(F.lit(TAGS - 1)) == F.col("tag"))
    piece = F.xxhash64("key", "piece", F.col("fp").bitwiseAND(F.col("bits")))
    fine = Table(fine.select("fp", "root", (F.col("root") != F.col("largest")).alias("stray"), piece.alias("key")), "pieces").df
    parts = fine.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    parts = Table(parts.where("r0 <> r1").select("key", "parts"), "piece-parts").df
    dealt = lookup(fine, parts, ["key"], "parts", fine.count() // PART).where("parts is not null")
    dealt = Table(dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")), "pieces-dealt").df
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = dealt.where("stray").select("fp", "root", "key", F.col("part").alias("row"), every.alias("col"))
    y = dealt.select("fp", "root", "stray", "key", every.alias("row"), F.col("part").alias("col"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "row", "col")]
    once = ~F.col("y.stray") | (F.col("x.fp") < F.col("y.fp"))
    return x.alias("x").join(y.alias("y"), [*same, once, F.col("x.root") != F.col("y.root"), _near("x.fp", "y.fp")])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links), and `keep`.

    Texts without words, and null ones, have fingerprint zero, and link like any other. Fewer words than a shingle
    make one shingle. Rows with equal fingerprints are one node, however many; a null id is never a component's id
    unless its component has no other. No rows in, no rows out.
    """
    found = Table(fingerprints(docs, id_col, text_col, keep), "fingerprints").df
    nodes = Table(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes").df
    total, count = found.count(), nodes.count()
    roots = Table(connected_components(links(nodes, count)), "roots").df
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(roots.select(F.col("root").alias("linked")).distinct(), F.col("root") == F.col("linked"), "left_semi")
    least = linked.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("least"))
    placed = rooted.join(least, F.col("root") == F.col("of"), "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    placed = Table(placed, "placed").df
    out = lookup(found, placed, ["fp"], "n", total)
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, with all its columns; rows of one id are told apart by their texts, rows without one stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("gone_hash"))
    found = near_duplicates(rows, keep=("gone_hash",))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_"), "gone_hash").distinct()
    return docs.join(bounded(Table(gone, "near-gone").df), (docs[id_col] == F.col("gone_")) & (text_hash(docs[text_col]) == F.col("gone_hash")), "left_anti")
