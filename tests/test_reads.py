"""Scenarios of versioned reads, with the properties that get, scan and replay must share."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratakv.functions.bounds import between, contains, overlap, prefix_successor
from stratakv.operators import manifest, reads, segments, wal, writes
from stratakv.schema import KV_LOG

LOG = [("a", 1, "PUT", 1.0), ("a", 5, "PUT", 2.0), ("a", 8, "DELETE", None), ("b", 3, "PUT", 3.0), ("c", 4, "PUT", 0.0)]


def state(rows, at=None, keep_deleted=False):
    out = {}
    for k, ts, op, v in sorted(rows, key=lambda r: r[1]):
        if at is None or ts <= at:
            out[k] = (ts, op, v)
    return {k: x for k, x in out.items() if keep_deleted or x[1] == "PUT"}


@pytest.mark.parametrize("at", [0, 3, 4, 5, 7, 8, None])
def test_snapshots(spark, at):
    log = spark.createDataFrame(LOG, KV_LOG)
    want = {k: x[2] for k, x in state(LOG, at).items()}
    assert {r["k"]: r["v"] for r in reads.scan(log, at=at).collect()} == want
    for k in "abcz":
        row = reads.point_get(log, k, at).first()
        assert (row["v"] if row else None) == want.get(k)


def test_zero_is_not_a_tombstone_and_misses_show(spark):
    log = spark.createDataFrame(LOG, KV_LOG)
    assert {r["k"]: r["v"] for r in reads.multi_get(log, ["a", "b", "c", "z"]).collect()} == {"a": None, "b": 3.0, "c": 0.0, "z": None}


@pytest.mark.parametrize("low_inc", [True, False])
@pytest.mark.parametrize("high_inc", [True, False])
@pytest.mark.parametrize("low", [None, "b", "d"])
@pytest.mark.parametrize("high", [None, "b", "d"])
def test_bounds(spark, low, high, low_inc, high_inc):
    df = spark.createDataFrame([(c,) for c in "abcde"], "k string")
    got = {r[0] for r in df.where(between(F.col("k"), low, high, low_inc, high_inc)).collect()}
    ok = lambda c: (low is None or c > low or (low_inc and c == low)) and (high is None or c < high or (high_inc and c == high))
    assert got == {c for c in "abcde" if ok(c)}


def test_prefix_successor():
    assert prefix_successor(b"ab") == b"ac"
    assert prefix_successor(b"a\xff\xff") == b"b"
    assert prefix_successor(b"\xff") is None and prefix_successor(b"") is None


def test_layers_newest_first_and_tombstones_hide(spark):
    rows = spark.createDataFrame([(0, "k", 9, "DELETE", None), (1, "k", 5, "PUT", 5.0), (2, "k", 1, "PUT", 1.0), (1, "m", 2, "PUT", 2.0), (2, "m", 7, "PUT", 7.0)], "layer_rank int, k string, ts long, op string, v double")
    assert {r["k"]: r["v"] for r in reads.live(reads.by_layer(rows)).collect()} == {"m": 2.0}
    assert {r["k"]: r["op"] for r in manifest.compact(rows).collect()} == {"k": "DELETE", "m": "PUT"}


def test_two_way_left_wins(spark):
    l, r = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {x["k"]: x["v"] for x in reads.two_way(l, r).collect()} == {"a": 1, "b": 2, "c": 4}


def test_batch_later_op_wins(spark):
    ops = spark.createDataFrame([(0, "PUT", "a", 1.0), (1, "DELETE", "a", None), (2, "PUT", "b", 2.0), (3, "PUT", "b", 3.0)], "pos long, op string, k string, v double")
    assert {r["k"]: r["v"] for r in reads.scan(writes.stamp(ops, 10)).collect()} == {"b": 3.0}


ASKS = st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 50)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(ASKS, ASKS, st.booleans())
def test_as_of(spark, asks, log, strict):
    log = list({x for x in log})
    a = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(asks)], "i int, k int, t long")
    b = spark.createDataFrame(log, "k int, t long").withColumn("hit_t", F.col("t"))
    got = {r["i"]: r["hit_t"] for r in reads.as_of(a, b, "t", "t", ["hit_t"], by=["k"], width=7, strict=strict).collect()}
    assert got == {i: max((u for j, u in log if j == k and (u < t if strict else u <= t)), default=None) for i, (k, t) in enumerate(asks)}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 150), max_size=25))
def test_greedy_segments(spark, sizes):
    want, used = [], 0
    for s in sizes:
        if not want or used + s > 100:
            want.append(0)
            used = 0
        want[-1] += 1
        used += s
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "ts long, size long")
    got = [r["n_records"] for r in wal.pack_segments(df, 100).orderBy("segment_id").collect()]
    assert got == want


def test_flush_runs_end_with_the_record_that_fills_them(spark):
    sizes = [(i * 37) % 90 + 1 for i in range(60)] + [500, 1, 1]
    want, used = [0], 0
    for s in sizes:
        if used >= 100:
            want.append(0)
            used = 0
        want[-1] += 1
        used += s
    df = spark.createDataFrame([(i + 1, s, f"{i:04d}") for i, s in enumerate(sizes)], "ts long, size long, k string")
    assert [r["n_rows"] for r in segments.flush_runs(df, 100).orderBy("run").collect()] == want
    zones = segments.zone_map(df, "ts", block_bytes=100).orderBy("block_id").collect()
    assert [r["n_entries"] for r in zones] == want
    assert [r["min_key"] for r in zones] == [f"{sum(want[:i]):04d}" for i in range(len(want))] and zones[-1]["max_key"] == f"{len(sizes) - 1:04d}"


def test_point_in_time_archive_wins(spark):
    schema = "segment_id long, " + KV_LOG
    live = spark.createDataFrame([(1, "a", 1, "PUT", 1.0), (2, "a", 5, "PUT", 5.0)], schema)
    archive = spark.createDataFrame([(1, "a", 1, "PUT", 9.0)], schema)
    assert [r["v"] for r in wal.recover_point_in_time(live, archive, 4).collect()] == [9.0]
    assert [r["v"] for r in wal.recover_point_in_time(live, archive, 5).collect()] == [5.0]


def test_ranges(spark):
    one = lambda lo, li, hi, hi_i: [F.lit(lo), F.lit(li), F.lit(hi), F.lit(hi_i)]
    base = one("d", True, "h", False)
    cases = [(one("a", True, "e", True), True), (one("f", True, "z", True), True), (one("a", True, "d", False), False), (one("h", True, "z", True), False), ([F.lit(None).cast("string"), F.lit(True), F.lit(None).cast("string"), F.lit(True)], True)]
    row = spark.range(1).select(*[overlap(*base, *c).alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]
    inside = spark.createDataFrame([("a", True), ("m", True), ("z", False), ("0", False)], "k string, want boolean")
    assert all(r[0] == r[1] for r in inside.select(contains(F.col("k"), F.lit("a"), F.lit(True), F.lit("z"), F.lit(False)), "want").collect())


def test_bloom_has_no_false_negatives(spark):
    have = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    bloom = segments.Bloom.build(have, "k", bits=1 << 15)
    passed = {r[0] for r in bloom.may_contain(spark.range(3000).withColumnRenamed("id", "k"), "k").collect()}
    assert set(range(0, 3000, 3)) <= passed and len(passed) < 1200


def test_bloom_is_sized_for_its_keys(spark):
    have = spark.range(4000).withColumnRenamed("id", "k")
    bloom = segments.Bloom.build(have, "k")
    assert bloom.bits == 1 << 16
    others = spark.range(10_000, 30_000).withColumnRenamed("id", "k")
    assert bloom.may_contain(have, "k").count() == 4000 and bloom.may_contain(others, "k").count() < 20_000 * 0.02


def test_checksums(spark):
    df = spark.createDataFrame([(1, "123456789"), (2, "x"), (3, None)], "id long, t string")
    stored = segments.checksums(df, "id", "t")
    assert {r["id"]: r["crc"] for r in stored.collect()}[1] == 3421780262
    assert segments.audit(df, stored, "id", "t").count() == 0
    bad = stored.withColumn("crc", F.when(F.col("id") == 2, 1).otherwise(F.col("crc")))
    assert [r["id"] for r in segments.audit(df, bad, "id", "t").collect()] == [2]
