"""Relations of the key-value model over star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETE, PUT


#: Digits of a number as a key: as many as a long has, since padding to fewer would cut keys short and merge them.
KEY_WIDTH = 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(col: str, width: int) -> Column:
    return F.lpad(F.col(col).cast("string"), width, "0")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return table(spark, sf_dir, "events").select(padded("user_id", KEY_WIDTH).alias("k"), (F.col("event_id") + 1).alias("ts"), op.alias("op"), F.col("value").alias("v"))


def half_way(spark: SparkSession, sf_dir: str) -> int:
    """A read point in the middle of the log: one number on the driver, so that it is pushed down as a literal."""
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return (top or 0) // 2


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in four layers by age, 0 the newest."""
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    rank = F.expr(f"3 - least(3, (4 * (ts - 1)) div {top + 1})").cast("int")
    return kv_log(spark, sf_dir).withColumn("layer_rank", rank)


def kv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("k"), F.col("p_partkey").alias("ts"), F.lit(PUT).alias("op"), F.col("p_retailprice").alias("v"))


def kv_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version a key, with the bytes that a stored entry takes."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", padded("o_orderkey", KEY_WIDTH).alias("k"), (F.length("o_orderpriority") + 18).cast("long").alias("size"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered write batch over keys of the log."""
    c = table(spark, sf_dir, "customer")
    op = F.when(F.col("c_acctbal") < 0, DELETE).otherwise(PUT)
    return c.select(F.col("c_custkey").alias("pos"), F.lpad((F.col("c_custkey") % 170).cast("string"), KEY_WIDTH, "0").alias("k"), op.alias("op"), F.col("c_acctbal").alias("v"))


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    level = F.when(F.col("o_orderpriority") == "5-LOW", "SerializableReadOnly").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Serializable").otherwise("Snapshot")
    return o.select(F.col("o_orderkey").alias("txn_id"), day.alias("start_ts"), (day + 30).alias("commit_ts"), level.alias("isolation"))


def txn_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "N", "R").otherwise("W")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("k"), op.alias("op")).distinct()


def lock_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    mode = F.when(flag == "R", "X").when(flag == "A", F.when(status == "F", "S").otherwise("IS")).otherwise(F.when(status == "F", "IX").otherwise("SIX"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("k"), mode.alias("mode"), "l_linenumber").distinct()


def range_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction's range: from its least key, as many keys on as it has lines. Odd ones leave their end out, and a
    range that would pass the last key is open."""
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txn_id")).agg(F.min("l_partkey").alias("lo"), F.count("*").alias("n"))
    hi = F.col("lo") + F.col("n")
    mode = F.when(F.col("txn_id") % 3 == 0, "X").otherwise("S")
    return lines.select("txn_id", mode.alias("mode"), "lo", F.lit(True).alias("lo_inc"), F.when(hi <= last, hi).alias("hi"), (F.col("txn_id") % 2 == 0).alias("hi_inc"))


def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "signup", "WAL").otherwise("SST")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("user_id") % 7).cast("int").alias("level"), F.expr("event_id div 4").alias("id"))
