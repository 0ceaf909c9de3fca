"""Registered queries without SQL, against brute force over whole tables."""

import random
from collections import defaultdict

import pytest

from stratakv.operators import deadlock, intervals, locks, manifest, reads
from stratakv.plans import catalog
from stratakv.sources import adapters
from tests.test_catalog import SF


def test_verdicts_see_the_ranges_of_all_transactions(spark):
    at = {r["txn_id"]: (r["start_ts"], r["commit_ts"]) for r in adapters.txns(spark, SF).where("isolation = 'Serializable'").collect()}
    of = {op: defaultdict(set) for op in "RW"}
    for r in adapters.txn_ops(spark, SF).collect():
        of[r["op"]][r["txn_id"]].add(r["k"])
    want, committed = {}, []
    for me in sorted(at, key=lambda t: (at[t][1], t)):
        start, end = at[me]
        over = [o for o in committed if at[o][1] > start and at[o][0] < end]
        read, wrote = of["R"][me], of["W"][me]
        peers_in = {o for o in over if of["W"][o] & read}
        peers_out = {o for o in committed if start < at[o][1] < end and of["R"][o] & wrote}
        ghost = read and any(min(read) <= k < max(read) for o in over for k in of["W"][o])
        want[me] = "Phantom" if ghost else "DangerousStructure" if peers_in and peers_out and not peers_in & peers_out else "WriteSkew" if peers_in else "Committed"
        if want[me] == "Committed":
            committed.append(me)
    assert {r["txn_id"]: r["verdict"] for r in catalog.QUERIES["ssi_verdicts"](spark, SF).collect()} == want
    assert sum(v == "Phantom" for v in want.values()) > 10


def cycles(edges):
    """Component of each node in a cycle, by depth-first search on the graph and on its reverse."""
    out, back = defaultdict(list), defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        back[b].append(a)
    seen, order = set(), []
    for start in sorted({x for e in edges for x in e}):
        todo = [(start, False)]
        while todo:
            node, done = todo.pop()
            if done:
                order.append(node)
            elif node not in seen:
                seen.add(node)
                todo += [(node, True), *((n, False) for n in out[node] if n not in seen)]
    found, placed = {}, set()
    for start in reversed(order):
        if start not in placed:
            own, todo = [], [start]
            placed.add(start)
            while todo:
                node = todo.pop()
                own.append(node)
                fresh = [n for n in back[node] if n not in placed]
                placed.update(fresh)
                todo += fresh
            if len(own) > 1:
                found |= dict.fromkeys(own, min(own))
    return found


@pytest.mark.parametrize(("nodes", "n"), [(40, 50), (60, 75), (12, 40)])
def test_components_of_random_graphs(spark, nodes, n):
    rng = random.Random(nodes)
    edges = list({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)})
    edges = [(a, b) for a, b in edges if a != b]
    got = deadlock.components(spark.createDataFrame(edges, "waiter long, holder long").repartition(3))
    assert {r["txn_id"]: r["component"] for r in got.collect()} == cycles(edges)


def test_deadlocks_of_all_transactions(spark):
    rows = adapters.lock_requests(spark, SF).collect()
    of_key = defaultdict(list)
    for r in rows:
        of_key[r["k"]].append((r["l_linenumber"], r["txn_id"]))
    waits = {(w, h) for group in of_key.values() for n, w in group for m, h in group if m < n and w != h}
    want = cycles(waits)
    assert {r["txn_id"]: r["component"] for r in catalog.QUERIES["deadlock_components"](spark, SF).collect()} == want
    start = {r["txn_id"]: r["start_ts"] for r in adapters.txns(spark, SF).collect()}
    held = defaultdict(int)
    for r in rows:
        held[r["txn_id"]] += 1
    groups = defaultdict(list)
    for t, c in want.items():
        groups[c].append((t % 3, start[t], -held[t], t))
    assert {r["component"]: r["txn_id"] for r in catalog.QUERIES["deadlock_victims"](spark, SF).collect()} == {c: max(g)[3] for c, g in groups.items()}


def test_ranges_meet_once_whatever_their_widths(spark):
    rng = random.Random(5)
    make = lambda n: [(i, lo := rng.randrange(-50, 300), lo + rng.choice([-1, 0, 0, 1, 5, 64, 400])) for i in range(n)]
    a, b = make(80), make(90)
    side = lambda rows, p: spark.createDataFrame(rows, f"{p}id long, {p}lo long, {p}hi long").repartition(3)
    got = sorted((r["a_id"], r["b_id"]) for r in intervals.meet(side(a, "a_"), side(b, "b_")).collect())
    assert got == sorted((i, j) for i, l, h in a for j, m, g in b if l <= h and m <= g and l <= g and m <= h)


def test_open_ranges(spark):
    rows = [(1, 5, True, 9, False), (2, 9, True, None, True), (3, None, True, 5, False), (4, 9, True, 9, True), (5, 0, True, 5, True)]
    got = locks.range_overlaps(spark.createDataFrame(rows, "txn_id long, lo long, lo_inc boolean, hi long, hi_inc boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 5), (2, 4), (3, 5)]


def test_compaction_takes_the_files_below_that_overlap(spark):
    rows = [(1, i, i * 10, i * 10 + 5) for i in range(1, 12)] + [(2, 50, 0, 12), (2, 51, 16, 40), (2, 52, 14, 15)]
    files = spark.createDataFrame(rows, "level int, id long, min_key long, max_key long")
    assert sorted(map(tuple, manifest.compaction_inputs(files).collect())) == [(1, 1, 2), (2, 50, 2), (2, 52, 2)]
    young = spark.createDataFrame([(0, i, 0, 9) for i in range(4)] + rows, files.schema)
    assert {r["level"] for r in manifest.compaction_inputs(young).collect()} == {0, 1}
    assert manifest.compaction_inputs(files.where("level = 2")).count() == 0


def test_sums_and_carries_over_far_bins(spark, monkeypatch):
    """With few bins to a group, so that all three steps take part."""
    monkeypatch.setattr(reads, "_FANOUT", 3)
    at = sorted(random.Random(3).sample(range(-500, 5000), 300))
    df = spark.createDataFrame([(t, t % 7) for t in at], "t long, v long").repartition(4)
    want, total = {}, 0
    for t in at:
        total += t % 7
        want[t] = total
    assert {r["t"]: r["s"] for r in reads.running_sum(df, "t", "v", "s", width=16).collect()} == want
    some = df.where("v = 0 and t > 100").withColumn("hit", df["t"])
    got = {r["t"]: r["hit"] for r in reads.as_of(df.select("t"), some, "t", "t", ["hit"], width=16).collect()}
    zeros = [t for t in at if t % 7 == 0 and t > 100]
    assert got == {t: max((z for z in zeros if z <= t), default=None) for t in at}
