"""What the training-data operators share: reading tables, shared-folder tables, Arrow mapping and splits."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this subpackage, as a Java, Python and RE2 pattern.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch between the JVM and Python; texts may be very long, so batches hold few of them.
BATCH_ROWS = 500

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it. Only a local session may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "/tmp/checkpoints/stratakv"
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is then left to the cluster's own clean-up
        pass


@atexit.register
def _delete_all() -> None:
    while _written:
        _delete(*_written.pop())


class Table:
    """A table written to the shared folder: it cuts lineage, and survives lost executors."""

    def __init__(self, df: DataFrame, tag: str, options: dict[str, str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/stratakv-{tag}-{uuid.uuid4().hex}"
        df.write.options(**(options or {})).parquet(self.path)
        _written.append((self.spark, self.path))
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; for tables that no later step reads."""
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))
        _delete(self.spark, self.path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return Table(df, tag).df


def text_hash(text: str | Column) -> Column:
    """Tells rows of one id apart; never null."""
    return F.xxhash64((F.col(text) if isinstance(text, str) else text).cast("string"))


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; -1 for a null id, which so counts as a training row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod, F.lit(-1))


def map_text(
    docs: DataFrame,
    keep: Sequence[str],
    text_col: str,
    start: Callable[[], Callable[[list[str | None]], list]],
    fields: str,
) -> DataFrame:
    """Rows of `keep` columns plus `fields` (DDL), computed from whole texts in Arrow batches.

    `start` runs once a task and returns the function that maps a list of texts to a list of columns.
    Only `keep` and the text column are read, so extra columns of `docs`, whatever their names, play no part.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("t"))
    small_batches(docs.sparkSession)
    schema = rows.select(*names).schema
    for f in docs.sparkSession.createDataFrame([], fields).schema.fields:
        schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for b in batches:
            out = f(b.column(len(names)).to_pylist())
            cols = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + cols, names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def small_batches(spark: SparkSession) -> None:
    """Bounds a Python worker's memory: a batch never holds more than BATCH_ROWS texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Rows of ids that a join may broadcast, a few tens of MB; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


def bounded(ids: DataFrame) -> DataFrame:
    """A written table of ids and a number or two, marked for broadcast if it is counted as small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def lookup(rows: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, total: int, parts: int = 1000) -> DataFrame:
    """`rows` left-joined with `small`, which is unique by `keys`, when a key may hold any share of the rows.

    Keys with at least total/parts rows (`weight` says how many a key has) are at most `parts`, so they are
    broadcast; the rows of those keys are dealt at random in the shuffle of the rest, where they find no partner.
    """
    values = [c for c in small.columns if c not in keys]
    most = max(2, -(-total // parts))
    hot = small.where(F.col(weight) >= most).select(*[F.col(k).alias(f"hot_{k}") for k in keys], *[F.col(v).alias(f"hot_{v}") for v in values])
    cold = small.where(F.col(weight) < most).select(*[F.col(k).alias(f"cold_{k}") for k in keys], *[F.col(v).alias(f"cold_{v}") for v in values])
    first = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"hot_{k}") for k in keys], "left")
    is_hot = F.col(f"hot_{weight}").isNotNull()
    spread = F.xxhash64(*rows.columns)
    first = first.withColumn("spread_", F.when(is_hot, spread).otherwise(F.lit(0)))
    cold = cold.withColumn("cold_spread", F.lit(0).cast("long"))
    second = first.join(cold, [*[F.col(k) == F.col(f"cold_{k}") for k in keys], F.col("spread_") == F.col("cold_spread")], "left")
    return second.select(*rows.columns, *[F.coalesce(F.col(f"hot_{v}"), F.col(f"cold_{v}")).alias(v) for v in values])


#: Labelled rows that a classifier is fitted on at most, and the longest text among them in bytes.
SAMPLE_ROWS = 5000
SAMPLE_TEXT_BYTES = 100_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, out: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """(text, label) of at most `rows` labelled documents, in the order of a hash of their ids.

    Rows whose crc32 remainder by `mod` is `out` are held out. Null ids, texts and labels are passed over, and so are
    texts beyond SAMPLE_TEXT_BYTES. An id that is labelled twice counts with its greatest label; of documents that share
    an id the one with the least hash of its text is taken. The ids are thinned out by their hash before they are
    ordered, so that few of each partition reach the driver; they are broadcast, and only their texts are shuffled.
    """
    own = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    own = own.where(remainder("id", mod) != out).withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    share = min(1.0, 1.3 * rows / max(1, own.count()))
    own = own.where(F.col("place") <= int(share * (1 << 40))).groupBy("place", "id").agg(F.max("y").alias("y")).orderBy("place", "id").limit(rows).select("id", "y")
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).where(F.octet_length("t") <= SAMPLE_TEXT_BYTES)
    found = texts.join(F.broadcast(own), "id").groupBy("id", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).collect()
    return [(r["t"], int(r["y"] > 0)) for r in sorted(found, key=lambda r: r["id"])]
