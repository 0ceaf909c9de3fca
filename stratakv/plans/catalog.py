"""The registered queries over star-schema tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bounds, clock
from ..operators import deadlock, locks, manifest, reads, segments, transactions, wal, writes
from ..schema import DELETE, PUT, KEEP_SEGMENTS
from ..sources import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Parameters of the queries.
WIDTH = a.KEY_WIDTH
KEY, LOW, HIGH = (str(n).zfill(WIDTH) for n in (42, 20, 60))
PREFIX, NAME_PREFIX = "0" * (WIDTH - 2), "blue"
KEYS = tuple(str(n).zfill(WIDTH) for n in (3, 17, 42, 99, 149, 99999999))
ROOM = 4000  # bytes of a flush run and of a log segment



def _greedy(source: str, order: str, limit: int) -> str:
    """Tables up to placed(place, size, run): runs ended by the record that brings them to `limit` bytes."""
    return f"""summed as (select {order} as place, size, sum(size) over (order by {order}) as upto from {source}),
hops as materialized (select s.place as start, n.place as next_start from (select place, upto - size + {limit} as target from summed) s asof left join (select place, upto - size as before from summed) n on s.target <= n.before),
starts as (select min(place) as start from summed union all select h.next_start from starts s join hops h on s.start = h.start where h.next_start is not null),
placed as (select place, size, count(start) over (order by place) - 1 as run from summed left join starts on place = start)"""


CTES = {
    "kv": f"kv as (select lpad(cast(user_id as varchar), {WIDTH}, '0') as k, event_id + 1 as ts, case when event_type = 'error' then 'DELETE' else 'PUT' end as op, value as v from events)",
    "half": "half as (select max(event_id) // 2 as s from events)",
    "batch": f"batch as (select c_custkey as pos, lpad(cast(c_custkey % 170 as varchar), {WIDTH}, '0') as k, case when c_acctbal < 0 then 'DELETE' else 'PUT' end as op, c_acctbal as v from customer)",
    "layers": "layers as (select kv.*, cast(3 - least(3, (4 * (ts - 1)) // (select max(event_id) + 1 from events)) as integer) as layer_rank from kv)",
    "txns": "txns as (select o_orderkey as txn_id, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as start_ts, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) + 30 as commit_ts, case when o_orderpriority = '5-LOW' then 'SerializableReadOnly' when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Serializable' else 'Snapshot' end as isolation from orders)",
    "ops": "ops as (select distinct l_orderkey as txn_id, l_partkey as k, case when l_returnflag = 'N' then 'R' else 'W' end as op from lineitem)",
    "ser": "ser as (select * from txns where isolation = 'Serializable')",
    "seen": "seen as (select o.txn_id, o.k, o.op, t.start_ts, t.commit_ts from ops o join ser t using (txn_id))",
    "inb": "inb as (select distinct m.txn_id, o.txn_id as other_id from seen m join seen o on m.k = o.k and m.op = 'R' and o.op = 'W' and m.txn_id <> o.txn_id and (o.commit_ts, o.txn_id) < (m.commit_ts, m.txn_id) and o.commit_ts > m.start_ts and o.start_ts < m.commit_ts)",
    "outb": "outb as (select distinct m.txn_id, o.txn_id as other_id from seen m join seen o on m.k = o.k and m.op = 'W' and o.op = 'R' and m.txn_id <> o.txn_id and o.commit_ts > m.start_ts and o.commit_ts < m.commit_ts)",
    "dang": "dang as (select distinct txn_id from inb where txn_id in (select txn_id from outb) and txn_id not in (select i.txn_id from inb i join outb o on i.txn_id = o.txn_id and i.other_id = o.other_id))",
    "locks": "locks as (select distinct l_orderkey as txn_id, l_partkey as k, case when l_returnflag = 'R' then 'X' when l_returnflag = 'A' then case when l_linestatus = 'F' then 'S' else 'IS' end when l_linestatus = 'F' then 'IX' else 'SIX' end as mode, l_linenumber from lineitem)",
    "compat": "compat as (select * from (values ('S','S'),('S','IS'),('IS','S'),('IS','IS'),('IS','IX'),('IS','SIX'),('IX','IS'),('IX','IX'),('SIX','IS')) t(x, y))",
    "ranges": "ranges as (select l_orderkey as txn_id, case when l_orderkey % 3 = 0 then 'X' else 'S' end as mode, min(l_partkey) as lo, true as lo_inc, case when min(l_partkey) + count(*) <= (select max(p_partkey) from part) then min(l_partkey) + count(*) end as hi, l_orderkey % 2 = 0 as hi_inc from lineitem group by l_orderkey)",
    "man": "man as (select event_id as seq, case when event_type = 'error' then 'DEL' when event_type = 'signup' then 'WAL' else 'SST' end as kind, cast(user_id % 7 as integer) as level, event_id // 4 as id from events)",
    "files": "files as (select level, id from man where kind <> 'WAL' group by level, id having max(case when kind = 'SST' then seq end) > coalesce(max(case when kind = 'DEL' then seq end), -1))",
    "static": f"static as (select o_orderkey, lpad(cast(o_orderkey as varchar), {WIDTH}, '0') as k, length(o_orderpriority) + 18 as size from orders)",
    "zones": f"{_greedy('static', 'o_orderkey', 4096)}, zones as (select p.run as block_id, min(k) as min_key, max(k) as max_key, count(*) as n_entries, cast(sum(p.size) as bigint) as n_bytes, min(place) as min_at, max(place) as max_at from placed p join static on place = o_orderkey group by p.run)",
    "sized": "sized as (select ts, 13 + length(k) + case when op = 'PUT' then 12 else 0 end as size from kv)",
    "wals": "wals as (select kv.*, (ts - 1) // 1000 as segment_id from kv)",
}


def _sql(names: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}" + ",\n".join(CTES[n] for n in names.split()) + "\n" + body


def _newest(source: str, where: str = "true", columns: str = "k, ts, v", alive: bool = True) -> str:
    return f"select {columns} from (select *, row_number() over (partition by k order by ts desc) as rn from {source} where {where}) where rn = 1" + " and op = 'PUT'" * alive


def query(name: str, names: str | None = None, body: str = "", recursive: bool = False):
    """Registers a query under a name, and its SQL: the named common tables, then the body."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if names is not None:
            ORACLES[name] = _sql(names, body, recursive) if names else body
        return f

    return add


# Reads.


@query("point_get", "kv", _newest("kv", f"k = '{KEY}'"))
def _(spark, d):
    return reads.point_get(a.kv_log(spark, d), KEY)


@query("multi_get", "kv", f"select a.k, r.ts, r.v from (select unnest([{', '.join(map(repr, KEYS))}]) as k) a left join ({_newest('kv')}) r on a.k = r.k")
def _(spark, d):
    return reads.multi_get(a.kv_log(spark, d), KEYS)


@query("full_scan", "kv", _newest("kv"))
def _(spark, d):
    return reads.scan(a.kv_log(spark, d))


for _kind, _low, _high in (("ii", ">=", "<="), ("ie", ">=", "<"), ("ei", ">", "<="), ("ee", ">", "<")):
    query(f"range_scan_{_kind}", "kv", _newest("kv", f"k {_low} '{LOW}' and k {_high} '{HIGH}'"))(
        lambda spark, d, kind=_kind: reads.range_scan(a.kv_log(spark, d), LOW, HIGH, kind[0] == "i", kind[1] == "i")
    )


@query("range_scan_unbounded", "kv", _newest("kv", f"k > '{HIGH}'"))
def _(spark, d):
    return reads.range_scan(a.kv_log(spark, d), HIGH, None, low_inclusive=False)


@query("range_scan_inverted", "kv", _newest("kv", f"k >= '{HIGH}' and k <= '{LOW}'"))
def _(spark, d):
    return reads.range_scan(a.kv_log(spark, d), HIGH, LOW)


_PARTS = "(select p_name as k, p_partkey as ts, 'PUT' as op, p_retailprice as v from part)"


@query("prefix_scan", "", _newest(_PARTS, f"starts_with(k, '{NAME_PREFIX}')"))
def _(spark, d):
    return reads.prefix_scan(a.kv_names(spark, d), NAME_PREFIX)


@query("prefix_scan_successor", "", _newest(_PARTS, f"starts_with(k, '{NAME_PREFIX}')"))
def _(spark, d):
    return reads.scan(a.kv_names(spark, d), bounds.prefix_range(F.col("k"), NAME_PREFIX))


_AT = "ts <= (select s from half)"


@query("snapshot_get", "kv half", _newest("kv", f"k = '{KEY}' and {_AT}"))
def _(spark, d):
    return reads.point_get(a.kv_log(spark, d), KEY, a.half_way(spark, d))


@query("snapshot_scan", "kv half", _newest("kv", _AT))
def _(spark, d):
    return reads.scan(a.kv_log(spark, d), at=a.half_way(spark, d))


@query("snapshot_range", "kv half", _newest("kv", f"k >= '{LOW}' and k < '{HIGH}' and {_AT}"))
def _(spark, d):
    return reads.range_scan(a.kv_log(spark, d), LOW, HIGH, high_inclusive=False, at=a.half_way(spark, d))


@query("snapshot_prefix_scan", "kv half", _newest("kv", f"starts_with(k, '{PREFIX}') and {_AT}"))
def _(spark, d):
    return reads.prefix_scan(a.kv_log(spark, d), PREFIX, a.half_way(spark, d))


@query("multi_snapshot_read", "kv", f"""select o_orderkey as req_id, q.k, q.at, r.ts, r.op, r.v
from (select o_orderkey, lpad(cast(o_custkey % 150 as varchar), {WIDTH}, '0') as k, o_orderkey % 9000 as at from orders) q asof left join kv r on q.k = r.k and q.at >= r.ts""")
def _(spark, d):
    asks = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("req_id"), F.lpad((F.col("o_custkey") % 150).cast("string"), WIDTH, "0").alias("k"), (F.col("o_orderkey") % 9000).alias("at"))
    return reads.as_of(asks, a.kv_log(spark, d), "at", "ts", ["ts", "op", "v"], by=["k"])


@query("tombstones", "kv", _newest("kv", columns="k, ts", alive=False) + " and op = 'DELETE'")
def _(spark, d):
    return reads.newest(a.kv_log(spark, d)).where(F.col("op") == DELETE).select("k", "ts")


@query("version_history", "kv", "select k, ts, op, v, lead(ts) over (partition by k order by ts) as next_ts from kv")
def _(spark, d):
    return reads.versions(a.kv_log(spark, d))


@query("current_ts", "kv", "select max(ts) as snapshot_ts, max(ts) + 1 as next_ts from kv")
def _(spark, d):
    return a.kv_log(spark, d).agg(F.max("ts").alias("snapshot_ts"), (F.max("ts") + 1).alias("next_ts"))


# Writes, layers and merges.


@query("own_writes_overlay", "kv batch", "select k, v from (select *, row_number() over (partition by k order by p, ts desc) as rn from (select 0 as p, k, pos as ts, op, v from batch union all select 1, k, ts, op, v from kv)) where rn = 1 and op = 'PUT'")
def _(spark, d):
    own = a.batch(spark, d).withColumnRenamed("pos", "ts").select("k", "ts", "op", "v")
    return reads.live(reads.by_priority([own, a.kv_log(spark, d)])).select("k", "v")


@query("batch_apply", "kv batch", _newest("(select k, ts, op, v from kv union all select k, (select max(ts) + 1 from kv) + pos, op, v from batch)"))
def _(spark, d):
    log = a.kv_log(spark, d)
    base = (log.agg(F.max("ts")).first()[0] or 0) + 1
    return reads.scan(log.unionByName(writes.stamp(a.batch(spark, d), base)))


@query("batch_stats", "", "select count(*) as n_ops, count(*) filter (role = 'system') as n_deletes, cast(sum(octet_length(encode(cast(conv_id as varchar))) + coalesce(octet_length(encode(text)), 0)) as bigint) as approximate_size from conversations")
def _(spark, d):
    c = a.table(spark, d, "conversations")
    return writes.batch_stats(c.select(F.col("conv_id").cast("string").alias("k"), F.when(F.col("role") == "system", DELETE).otherwise(PUT).alias("op"), F.col("text").alias("v")))


@query("write_set_fold", "", "select l_orderkey as txn_id, l_partkey as k, max(l_linenumber) as pos, arg_max(case when l_returnflag = 'N' then 'DELETE' else 'PUT' end, l_linenumber * 1000000 + l_suppkey * 10 + case when l_returnflag = 'N' then 1 else 0 end) as op from lineitem group by all")
def _(spark, d):
    l = a.table(spark, d, "lineitem")
    op = F.when(F.col("l_returnflag") == "N", DELETE).otherwise(PUT)
    tie = F.col("l_linenumber") * 1000000 + F.col("l_suppkey") * 10 + F.when(F.col("l_returnflag") == "N", 1).otherwise(0)
    ops = l.select(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("k"), tie.alias("pos"), op.alias("op"), F.col("l_linenumber").alias("line"))
    return writes.fold_write_set(ops).select("txn_id", "k", F.col("line").alias("pos"), "op")


_LAYERED = "select {} from (select *, row_number() over (partition by k order by layer_rank, ts desc) as rn from layers) where rn = 1"


@query("layered_lookup", "kv layers", _LAYERED.format("k, layer_rank, ts, v") + " and op = 'PUT'")
def _(spark, d):
    return reads.live(reads.by_layer(a.layers(spark, d))).select("k", "layer_rank", "ts", "v")


@query("k_way_merge", "kv layers", _LAYERED.format("k, ts, op, v"))
def _(spark, d):
    rows = a.layers(spark, d)
    return reads.by_priority([rows.where(F.col("layer_rank") == n).drop("layer_rank") for n in range(4)]).drop("layer_rank")


@query("two_way_merge", "kv batch", f"select coalesce(b.k, r.k) as k, case when b.k is null then r.op else b.op end as op, case when b.k is null then r.v else b.v end as v from ({_newest('(select k, pos as ts, op, v from batch)', columns='k, op, v', alive=False)}) b full outer join ({_newest('kv', columns='k, op, v', alive=False)}) r on b.k = r.k")
def _(spark, d):
    one = lambda rows: reads.newest(rows).select("k", "op", "v")
    return reads.two_way(one(a.batch(spark, d).withColumnRenamed("pos", "ts")), one(a.kv_log(spark, d)))


# Segments.


def _sized(spark, d):
    log = a.kv_log(spark, d)
    return log.withColumn("size", (13 + F.length("k") + F.when(F.col("op") == PUT, 12).otherwise(0)).cast("long"))


@query("memtable_flush_runs", "kv sized", f", {_greedy('sized', 'ts', ROOM)} select run, count(*) as n_rows, cast(sum(size) as bigint) as n_bytes, min(place) as first_ts, max(place) as last_ts from placed group by run", recursive=True)
def _(spark, d):
    return segments.flush_runs(_sized(spark, d), ROOM)


@query("block_zone_map", "static zones", "select block_id, min_key, max_key, n_entries, n_bytes from zones", recursive=True)
def _(spark, d):
    return segments.zone_map(a.kv_static(spark, d), "o_orderkey").drop("min_at", "max_at")


@query("zone_map_prune", "static zones", "select c_custkey * 11 as probe, block_id from customer join zones on c_custkey * 11 between min_at and max_at", recursive=True)
def _(spark, d):
    probes = a.table(spark, d, "customer").select((F.col("c_custkey") * 11).alias("probe"))
    return segments.prune(probes, segments.zone_map(a.kv_static(spark, d), "o_orderkey"), "probe")


@query("bloom_prefilter", "", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def _(spark, d):
    rich = a.table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey")
    orders = a.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    passed = segments.Bloom.build(rich, "c_custkey").may_contain(orders, "o_custkey")
    return passed.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("checksum_audit")
def _(spark, d):
    docs = a.table(spark, d, "documents")
    stored = segments.checksums(docs, "doc_id", "text").withColumn("crc", F.when(F.col("doc_id") % 97 == 0, F.col("crc") + 1).otherwise(F.col("crc")))
    return segments.audit(docs, stored, "doc_id", "text")


# Write-ahead log.

_PACK = f"""summed as (select ts, size, sum(size) over (order by ts) as upto from sized),
hops as materialized (select s.ts as start, n.ts as next_start from (select ts, upto - size + greatest({ROOM}, size) as target from summed) s asof left join summed n on s.target < n.upto),
starts as (select min(ts) as start from summed union all select h.next_start from starts s join hops h on s.start = h.start where h.next_start is not null),
numbered as (select ts, size, count(start) over (order by ts) as segment_id from summed left join starts on ts = start),
segs as (select segment_id, count(*) as n_records, cast(sum(size) as bigint) as n_bytes, min(ts) as first, max(ts) as last from numbered group by segment_id)"""


def _packed(spark, d):
    return wal.pack_segments(_sized(spark, d), ROOM)


@query("wal_segments", "kv sized", f", {_PACK} select * from segs", recursive=True)
def _(spark, d):
    return _packed(spark, d)


@query("wal_archive_list", "kv sized", f", {_PACK} select * from segs where segment_id < (select max(segment_id) from segs) - {KEEP_SEGMENTS}", recursive=True)
def _(spark, d):
    return wal.archive_list(_packed(spark, d))


@query("wal_segment_bounds", "kv wals", "select min(segment_id) as first_segment, max(segment_id) as current_segment, count(distinct segment_id) as n_segments from wals")
def _(spark, d):
    rows = a.kv_log(spark, d).select(F.expr("(ts - 1) div 1000").alias("segment_id"))
    return rows.agg(F.min("segment_id").alias("first_segment"), F.max("segment_id").alias("current_segment"), F.countDistinct("segment_id").alias("n_segments"))


@query("wal_record_sizes", "kv sized", "select size, count(*) as n from sized group by size")
def _(spark, d):
    return _sized(spark, d).groupBy("size").agg(F.count("*").alias("n"))


@query("wal_recover_from", "kv half", _newest("kv", "ts >= (select s from half)", "k, ts, op, v", alive=False))
def _(spark, d):
    return wal.recover_from(a.kv_log(spark, d), a.half_way(spark, d))


@query("wal_recover_pitr", "kv half wals", _newest("(select k, ts, op, v + 1 as v from wals where segment_id <= 5 union all select k, ts, op, v from wals where segment_id >= 3 and segment_id not in (select segment_id from wals where segment_id <= 5))", _AT, "k, ts, op, v", alive=False))
def _(spark, d):
    rows = a.kv_log(spark, d).withColumn("segment_id", F.expr("(ts - 1) div 1000"))
    archive = rows.where("segment_id <= 5").withColumn("v", F.col("v") + 1)  # told apart from the live copy
    return wal.recover_point_in_time(rows.where("segment_id >= 3"), archive, a.half_way(spark, d))


# Manifest and compaction.


@query("manifest_replay", "man files", "select level, id from files")
def _(spark, d):
    return manifest.replay(a.manifest_log(spark, d)).select("level", "id")


@query("manifest_next_ids", "man", "select coalesce(max(id) filter (kind = 'SST'), 0) + 1 as next_sst_id, coalesce(max(id) filter (kind = 'WAL'), 0) + 1 as next_wal_id from man")
def _(spark, d):
    return manifest.next_ids(a.manifest_log(spark, d))


@query("compaction_pick", "man files", "select min(level) as level, min(level) + 1 as output_level from (select level, count(*) as n from files group by level) where (level = 0 and n >= 4) or (level between 1 and 5 and n > power(10, level)) having min(level) is not null")
def _(spark, d):
    return manifest.pick_compaction(manifest.replay(a.manifest_log(spark, d)))


_SPANS = "spans as (select level, id, id % 1000 as min_key, id % 1000 + level * 20 + 30 as max_key from files)"


@query("compaction_inputs", "man files", f", {_SPANS}, due as (select min(level) as level from (select level, count(*) as n from files group by level) where (level = 0 and n >= 4) or (level between 1 and 5 and n > power(10, level))), head as (select s.* from spans s, due where s.level = due.level order by id limit 1) select cast(s.level as integer) as level, s.id, cast(due.level + 1 as integer) as output_level from spans s, due where (due.level = 0 and s.level <= 1) or (due.level > 0 and ((s.level, s.id) in (select level, id from head) or (s.level = due.level + 1 and exists (select 1 from head h where h.max_key >= s.min_key and s.max_key >= h.min_key))))")
def _(spark, d):
    files = manifest.replay(a.manifest_log(spark, d)).withColumn("min_key", F.col("id") % 1000)
    return manifest.compaction_inputs(files.withColumn("max_key", F.col("min_key") + F.col("level") * 20 + 30))


_FILES = "f as (select l_orderkey // 100 as sst_id, min(l_partkey) as min_key, min(l_partkey) + (l_orderkey // 100) % 40 as max_key from lineitem group by l_orderkey // 100)"


@query("compaction_overlap", "", f"with {_FILES} select x.sst_id, y.sst_id as other_id from f x join f y on x.sst_id % 2 = 0 and y.sst_id % 2 = 1 and x.max_key >= y.min_key and y.max_key >= x.min_key")
def _(spark, d):
    f = a.table(spark, d, "lineitem").groupBy(F.expr("l_orderkey div 100").alias("sst_id")).agg(F.min("l_partkey").alias("min_key")).withColumn("max_key", F.col("min_key") + F.col("sst_id") % 40)
    return manifest.overlapping(f.where("sst_id % 2 = 0"), f.where("sst_id % 2 = 1"))


@query("compaction_merge", "kv layers", _LAYERED.format("k, ts, op, v"))
def _(spark, d):
    return manifest.compact(a.layers(spark, d)).drop("layer_rank")


# Clock, transactions.


@query("hybrid_ts_decode", "", "select event_id, ((1700000000000 + event_id * 7) << 18) | (user_id & 262143) as hts, 1700000000000 + event_id * 7 as millis, user_id & 262143 as counter from events")
def _(spark, d):
    e = a.table(spark, d, "events").select("event_id", clock.compose(F.lit(1700000000000) + F.col("event_id") * 7, F.col("user_id")).alias("hts"))
    return e.select("event_id", "hts", clock.physical(F.col("hts")).alias("millis"), clock.logical(F.col("hts")).alias("counter"))


@query("occ_conflicts", "txns ops", "select distinct m.txn_id, o.txn_id as other_id from (ops join txns using (txn_id)) m join (ops join txns using (txn_id)) o on m.k = o.k and m.op = 'R' and o.op = 'W' and m.txn_id <> o.txn_id and o.commit_ts > m.start_ts and o.start_ts < m.commit_ts")
def _(spark, d):
    return transactions.occ_conflicts(a.txn_ops(spark, d), a.txns(spark, d))


def _serializable(spark, d):
    return a.txn_ops(spark, d), a.txns(spark, d).where(F.col("isolation") == "Serializable")


@query("ssi_inbound_edges", "txns ops ser seen inb", "select * from inb")
def _(spark, d):
    return transactions.inbound_edges(*_serializable(spark, d))


@query("ssi_outbound_edges", "txns ops ser seen outb", "select * from outb")
def _(spark, d):
    return transactions.outbound_edges(*_serializable(spark, d))


def _read_ranges(spark, d):
    own = a.txn_ops(spark, d).where(F.col("op") == "R").groupBy("txn_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    return own.withColumn("lo_inc", F.lit(True)).withColumn("hi_inc", F.lit(False))


@query("ssi_phantoms", "txns ops ser seen", "select distinct r.txn_id, o.txn_id as other_id from (select txn_id, min(k) as lo, max(k) as hi from ops where op = 'R' group by txn_id) r join ser m using (txn_id) join seen o on o.op = 'W' and o.k >= r.lo and o.k < r.hi and r.txn_id <> o.txn_id and (o.commit_ts, o.txn_id) < (m.commit_ts, m.txn_id) and o.commit_ts > m.start_ts and o.start_ts < m.commit_ts")
def _(spark, d):
    ops, txns = _serializable(spark, d)
    return transactions.phantoms(_read_ranges(spark, d), ops, txns)


@query("ssi_dangerous", "txns ops ser seen inb outb dang", "select txn_id from dang")
def _(spark, d):
    ops, txns = _serializable(spark, d)
    return transactions.dangerous(transactions.inbound_edges(ops, txns), transactions.outbound_edges(ops, txns))


@query("ssi_stats", "txns ops ser seen inb outb dang", "select case when txn_id in (select txn_id from dang) then 'DangerousStructure' when txn_id in (select txn_id from inb) then 'WriteSkew' else 'Committed' end as verdict, count(*) as n from ser group by 1")
def _(spark, d):
    ops, txns = _serializable(spark, d)
    return transactions.verdict_counts(transactions.static_verdicts(txns, transactions.inbound_edges(ops, txns), transactions.outbound_edges(ops, txns)))


@query("ssi_verdicts")
def _(spark, d):
    ops, txns = _serializable(spark, d)
    edges = transactions.inbound_edges(ops, txns), transactions.outbound_edges(ops, txns)
    return transactions.verdicts_of_ranges(txns, *edges, _read_ranges(spark, d), ops)


_NOW = 10400  # days


@query("safe_snapshot", "txns", f"select cast(coalesce(min(start_ts) filter (start_ts <= {_NOW} and commit_ts > {_NOW} and isolation not in ('SerializableReadOnly', 'SerializableDeferrable')), {_NOW}) as bigint) as safe_ts, count(*) filter (start_ts <= {_NOW} and commit_ts > {_NOW} and isolation not in ('SerializableReadOnly', 'SerializableDeferrable')) as n_active from txns")
def _(spark, d):
    return transactions.safe_snapshot(a.txns(spark, d), _NOW)


@query("watermark_prune", "txns", f"select * from txns where commit_ts >= {_NOW}")
def _(spark, d):
    return transactions.prune(a.txns(spark, d), _NOW)


@query("isolation_counts", "txns", "select isolation, count(*) as n from txns group by isolation")
def _(spark, d):
    return a.txns(spark, d).groupBy("isolation").agg(F.count("*").alias("n"))


# Locks.


@query("lock_compat_matrix", "compat", "select h.m as held, r.m as requested, exists (select 1 from compat where x = h.m and y = r.m) as compatible from (select unnest(['S','X','IS','IX','SIX']) as m) h, (select unnest(['S','X','IS','IX','SIX']) as m) r")
def _(spark, d):
    return locks.matrix(spark)


@query("lock_conflicts", "locks compat", "select distinct x.k, x.txn_id, x.mode, y.txn_id as other_id, y.mode as other_mode from locks x join locks y on x.k = y.k and x.txn_id < y.txn_id where not exists (select 1 from compat c where c.x = x.mode and c.y = y.mode)")
def _(spark, d):
    return locks.conflicts(a.lock_requests(spark, d))


@query("lock_upgrades", "locks", "select held, requested, case when held = requested then 'same' when (held, requested) in (('S','X'),('S','SIX'),('IS','S'),('IS','X'),('IS','IX'),('IS','SIX'),('IX','X'),('IX','SIX')) then 'ok' else 'invalid' end as outcome, count(*) as n from (select x.mode as held, y.mode as requested from locks x join locks y on x.txn_id = y.txn_id and y.l_linenumber = x.l_linenumber + 1) group by all")
def _(spark, d):
    r = a.lock_requests(spark, d)
    nxt = r.select(F.col("txn_id").alias("t"), (F.col("l_linenumber") - 1).alias("n"), F.col("mode").alias("requested"))
    steps = r.join(nxt, (F.col("txn_id") == F.col("t")) & (F.col("l_linenumber") == F.col("n"))).select(F.col("mode").alias("held"), "requested")
    return locks.upgrades(steps).groupBy("held", "requested", "outcome").agg(F.count("*").alias("n"))


@query("lock_holders", "locks", "select k, count(distinct txn_id) as n_holders, count(*) as n_requests, max(cast(mode = 'X' as integer)) as exclusive from locks group by k")
def _(spark, d):
    return locks.holders(a.lock_requests(spark, d))


@query("range_point_conflicts", "locks compat ranges", "select distinct l.k, l.txn_id, r.txn_id as range_txn_id from locks l join ranges r on l.txn_id <> r.txn_id and l.k >= r.lo and (r.hi is null or l.k < r.hi or (l.k = r.hi and r.hi_inc)) where not exists (select 1 from compat c where c.x = l.mode and c.y = r.mode)")
def _(spark, d):
    return locks.range_point_conflicts(a.range_locks(spark, d), a.lock_requests(spark, d))


@query("range_overlaps", "ranges", "select x.txn_id, y.txn_id as other_id from ranges x join ranges y on x.txn_id < y.txn_id and (x.hi is null or x.hi > y.lo or (x.hi = y.lo and x.hi_inc)) and (y.hi is null or y.hi > x.lo or (y.hi = x.lo and y.hi_inc))")
def _(spark, d):
    return locks.range_overlaps(a.range_locks(spark, d))


@query("lock_escalation", "locks", "select txn_id, count(*) as n_locks, min(k) as lo, max(k) as hi, case when count(*) >= 7 then 'ForceEscalate' when count(*) >= 5 then 'Escalate' when count(*) >= 3 then 'Warn' else 'None' end as action from locks group by txn_id")
def _(spark, d):
    return locks.escalation(a.lock_requests(spark, d), 3, 5, 7)


_WAITS = "waits as (select distinct x.txn_id as waiter, y.txn_id as holder from locks x join locks y on x.k = y.k and y.l_linenumber < x.l_linenumber and x.txn_id <> y.txn_id)"


@query("wait_edges", "locks", f", {_WAITS} select * from waits")
def _(spark, d):
    return deadlock.wait_edges(a.lock_requests(spark, d))


# A closure in SQL holds all pairs of transactions, so the next two have none; tests hold them against another algorithm.


@query("deadlock_components")
def _(spark, d):
    return deadlock.deadlocked(a.lock_requests(spark, d))


@query("deadlock_victims")
def _(spark, d):
    n = a.lock_requests(spark, d).groupBy("txn_id").agg(F.count("*").alias("lock_count"))
    info = a.txns(spark, d).select("txn_id", "start_ts", (F.col("txn_id") % 3).alias("priority")).join(n, "txn_id")
    return deadlock.victims(deadlock.deadlocked(a.lock_requests(spark, d)), info)
