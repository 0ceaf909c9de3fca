"""Key and range locks as relations: compatibility, conflicts, upgrades, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounds import contains, overlap
from ..schema import COMPATIBLE, ESCALATE_LOCKS, FORCE_LOCKS, MODES, UPGRADES, WARN_LOCKS
from ..plans.cut import written
from .intervals import filled, meet


def compatible(a: Column, b: Column) -> Column:
    """Whether two modes go together; a test of nine constant pairs, so no join."""
    return F.concat_ws(",", a, b).isin([f"{x},{y}" for x, y in COMPATIBLE])


def matrix(spark: SparkSession) -> DataFrame:
    rows = [(a, b) for a in MODES for b in MODES]
    return spark.createDataFrame(rows, "held string, requested string").withColumn("compatible", compatible(F.col("held"), F.col("requested")))


def conflicts(requests: DataFrame) -> DataFrame:
    """(k, txn_id, mode, other_id, other_mode): pairs of transactions that cannot both hold the key, smaller id first."""
    r = requests.select("txn_id", "k", "mode").distinct()
    o = r.select(F.col("txn_id").alias("other_id"), F.col("k").alias("ok"), F.col("mode").alias("other_mode"))
    met = (F.col("k") == F.col("ok")) & (F.col("txn_id") < F.col("other_id")) & ~compatible(F.col("mode"), F.col("other_mode"))
    return r.join(o, met).select("k", "txn_id", "mode", "other_id", "other_mode")


def upgrades(steps: DataFrame) -> DataFrame:
    """held, requested and what becomes of it: same, ok or invalid."""
    legal = F.concat_ws(",", "held", "requested").isin([f"{a},{b}" for a, b in UPGRADES])
    return steps.withColumn("outcome", F.when(F.col("held") == F.col("requested"), "same").when(legal, "ok").otherwise("invalid"))


def holders(requests: DataFrame) -> DataFrame:
    """Per key: transactions, requests, and whether any wants it alone."""
    each = requests.groupBy("k", "txn_id").agg(F.count("*").alias("n"), F.max((F.col("mode") == "X").cast("int")).alias("x"))
    return each.groupBy("k").agg(F.count("txn_id").alias("n_holders"), F.sum("n").alias("n_requests"), F.max("x").alias("exclusive"))


def _ends(ranges: DataFrame, points: DataFrame | None = None) -> tuple[int, int]:
    """The least and the greatest key in sight; open ends reach so far."""
    keys = ranges.select(F.explode(F.array("lo", "hi")).alias("k"))
    if points is not None:
        keys = keys.unionByName(points.select("k"))
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    return low or 0, high or 0


def _clash(mode: Column) -> Column:
    """The modes that do not go with one, as bits in the order of MODES; the last bit stands for modes not among them."""
    bits = [F.when(compatible(mode, F.lit(m)), 0).otherwise(1 << i) for i, m in enumerate(MODES)]
    return sum(bits, F.lit(1 << len(MODES)))


def _bit(mode: Column) -> Column:
    at = F.lit(1 << len(MODES))
    for i, m in enumerate(MODES):
        at = F.when(mode == m, 1 << i).otherwise(at)
    return at


def range_point_conflicts(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """(k, txn_id, range_txn_id): a request for a key in another's range, in a mode that does not go with the range's.

    Ranges meet the distinct keys, and then the requests of a key, one row for all modes of a transaction. Where each
    transaction has one range, the result comes out once by itself; only with more ranges it is shuffled.
    """
    q = requests.groupBy("k", "txn_id").agg(F.bit_or(_clash(F.col("mode"))).alias("clash"))
    r = written(ranges.select(F.col("txn_id").alias("range_txn_id"), _bit(F.col("mode")).alias("bit"), "lo", "lo_inc", "hi", "hi_inc"), "ranges")
    keys = written(requests.select("k").distinct().select(F.col("k").alias("key"), F.col("k").cast("long").alias("a_lo")), "keys")
    met = contains(F.col("key"), F.col("lo"), F.col("lo_inc"), F.col("hi"), F.col("hi_inc"))
    spans = filled(r, "lo", "hi", *_ends(r, keys.select(F.col("key").alias("k"))), "b_")
    held = meet(keys.withColumn("a_hi", F.col("a_lo")), spans, where=met).select("key", "range_txn_id", "bit")
    clash = (F.col("txn_id") != F.col("range_txn_id")) & (F.col("clash").bitwiseAND(F.col("bit")) != 0)
    found = q.join(held, (F.col("k") == F.col("key")) & clash).select("k", "txn_id", "range_txn_id")
    return found if r.groupBy("range_txn_id").count().where("count > 1").isEmpty() else found.distinct()


def range_overlaps(ranges: DataFrame) -> DataFrame:
    """(txn_id, other_id), smaller first: ranges that share a point; a null end is open."""
    ends = _ends(ranges)
    names = ("txn_id", "lo", "lo_inc", "hi", "hi_inc")
    side = lambda p: filled(ranges.select(*[F.col(c).alias(f"{p}of_{c}") for c in names]), f"{p}of_lo", f"{p}of_hi", *ends, p)
    shared = overlap(*[F.col(f"{p}of_{c}") for p in ("a_", "b_") for c in names[1:]])
    pairs = meet(side("a_"), side("b_")).where((F.col("a_of_txn_id") < F.col("b_of_txn_id")) & shared)
    return pairs.select(F.col("a_of_txn_id").alias("txn_id"), F.col("b_of_txn_id").alias("other_id"))


def escalation(requests: DataFrame, warn: int = WARN_LOCKS, escalate: int = ESCALATE_LOCKS, force: int = FORCE_LOCKS) -> DataFrame:
    """Per transaction: locks, what to do about them, and the range that would take their place."""
    n = F.col("n_locks")
    action = F.when(n >= force, "ForceEscalate").when(n >= escalate, "Escalate").when(n >= warn, "Warn").otherwise("None")
    return requests.groupBy("txn_id").agg(F.count("*").alias("n_locks"), F.min("k").alias("lo"), F.max("k").alias("hi")).withColumn("action", action)
