"""Jobs on pairs write and shuffle no more than their input or result needs."""

import random

from stratakv.operators import deadlock, locks, packing, transactions
from stratakv.plans import catalog
from stratakv.schema import TXN_OPS, TXNS
from tests.test_whole_tables import cycles


def counted(monkeypatch, module):
    """Rows of each table that the module writes from now on."""
    sizes, write = [], module.written

    def noted(df, tag):
        out = write(df, tag)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(module, "written", noted)
    return sizes


def test_waits_of_a_hot_key_are_not_written_to_find_cycles(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = list({(t, rng.choice([0, 0, rng.randrange(60)]), rng.randrange(7)) for t in range(100) for _ in range(3)})
    spark.createDataFrame([(t, k, n, "R", "F") for t, k, n in rows], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    waits = {(a, b) for a, k, n in rows for b, j, m in rows if k == j and m < n and a != b}
    sizes = counted(monkeypatch, deadlock)
    assert {r["txn_id"]: r["component"] for r in catalog.QUERIES["deadlock_components"](spark, str(tmp_path)).collect()} == cycles(waits)
    assert max(sizes) <= len(rows) < len(waits) / 5


def history(spark):
    """Transactions that all overlap in time, of which half read one wide range and half write keys in it."""
    txns = spark.createDataFrame([(i, 0, 100 + i, "Serializable") for i in range(40)], TXNS)
    ops = spark.createDataFrame([(i, (7 * i + j) % 50, "W") for i in range(20) for j in range(5)], TXN_OPS)
    ranges = spark.createDataFrame([(i, 3, i % 2 == 0, 40, True) for i in range(20, 40)], "txn_id long, lo long, lo_inc boolean, hi long, hi_inc boolean")
    return txns, ops, ranges


def aggregates(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")


def test_phantoms_come_out_once_without_a_shuffle_of_pairs(spark):
    txns, ops, ranges = history(spark)
    found = transactions.phantoms(ranges, ops, txns)
    keys = {i: {(7 * i + j) % 50 for j in range(5)} for i in range(20)}
    want = sorted((i, o) for i in range(20, 40) for o in keys if any(3 + i % 2 <= k <= 40 for k in keys[o]))
    assert sorted(map(tuple, found.collect())) == want and aggregates(found) == 0
    twice = transactions.phantoms(ranges.unionByName(ranges), ops, txns)
    assert sorted(map(tuple, twice.collect())) == want


def test_verdicts_of_ranges_write_no_pairs(spark, monkeypatch):
    txns, ops, ranges = history(spark)
    edges = transactions.inbound_edges(ops, txns), transactions.outbound_edges(ops, txns)
    want = sorted(map(tuple, transactions.verdicts(txns, *edges, transactions.phantoms(ranges, ops, txns)).collect()))
    sizes = counted(monkeypatch, transactions)
    assert sorted(map(tuple, transactions.verdicts_of_ranges(txns, *edges, ranges, ops).collect())) == want
    assert max(sizes) <= ops.count() and sum(v == "Phantom" for _, v in want) == 20


def test_conflicts_of_ranges_come_out_once_without_a_shuffle_of_pairs(spark):
    requests = spark.createDataFrame([(t, t % 9, m, n) for t in range(30) for n, m in enumerate(("S", "X"))], "txn_id long, k long, mode string, l_linenumber int")
    ranges = spark.createDataFrame([(t, "SX"[t % 2], t % 5, True, None if t % 7 == 0 else t % 5 + 3, t % 3 == 0) for t in range(30)], "txn_id long, mode string, lo long, lo_inc boolean, hi long, hi_inc boolean")
    inside = lambda k, r: k >= r[2] and (r[4] is None or k < r[4] or (k == r[4] and r[5]))
    rows = [tuple(r) for r in ranges.collect()]
    want = sorted({(t % 9, t, r[0]) for t in range(30) for r in rows if r[0] != t and inside(t % 9, r)})  # X goes with no mode
    found = locks.range_point_conflicts(ranges, requests)
    assert sorted(map(tuple, found.collect())) == want and aggregates(found) == 1  # of the requests
    assert sorted(map(tuple, locks.range_point_conflicts(ranges.unionByName(ranges), requests).collect())) == want


def test_waits_come_out_once_without_a_shuffle_of_pairs(spark, monkeypatch):
    rng = random.Random(6)
    rows = list({(t, rng.randrange(6), rng.randrange(4)) for t in range(30) for _ in range(t % 5 + 1)})
    requests = spark.createDataFrame(rows, "txn_id long, k long, l_linenumber int")
    want = sorted({(a, b) for a, k, n in rows for b, j, m in rows if k == j and m < n and a != b})
    found = deadlock.wait_edges(requests)
    assert sorted(map(tuple, found.collect())) == want and aggregates(found) == 0
    monkeypatch.setattr(deadlock, "_FEW", 2)
    assert sorted(map(tuple, deadlock.wait_edges(requests).collect())) == want


def test_holders_count_without_an_expansion(spark):
    rows = [(1, 5, "S", 1), (1, 5, "X", 2), (2, 5, "S", 1), (2, 6, "S", 2), (None, 6, "S", 1)]
    found = locks.holders(spark.createDataFrame(rows, "txn_id long, k long, mode string, l_linenumber int"))
    assert sorted(map(tuple, found.select("k", "n_holders", "n_requests", "exclusive").collect())) == [(5, 2, 3, 1), (6, 1, 2, 0)]


def test_packing_tables_shrink(spark, monkeypatch):
    rng = random.Random(2)
    sizes = [rng.choice([1, 2, 3, 9, 40]) for _ in range(400)]
    log = spark.createDataFrame(list(enumerate(sizes)), "ts long, size long").repartition(3)
    monkeypatch.setattr(packing, "_LAST", 20)
    for overfull in (True, False):
        want, run, held = {}, 0, 0
        for i, n in enumerate(sizes):
            if held and (held >= 20 if overfull else held + n > 20):
                run, held = run + 1, 0
            want[i], held = run, held + n
        with monkeypatch.context() as m:
            written = counted(m, packing)
            assert {r["ts"]: r["run"] for r in packing.packed(log, 20, "ts", "size", overfull).collect()} == want
        assert sum(written) < 6 * len(sizes)
