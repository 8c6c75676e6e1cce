"""The registered queries of the engine's own operators, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import render as R
from ..operators import gc, graph, refs, stats, store, tree
from ..session import cut, ensure_checkpoint_dir, table
from . import derived as D
from . import native

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}
_SQL: dict[str, str] = {}

GIT_KEY = "sha1(encode('blob ' || octet_length(encode(text))::varchar) || '\\x00'::blob || encode(text)) || '000000000000000000000060'"
HORIZON = "1998-10-01"


def query(sql: str | None = None):
    """Register a query by its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _FOUND[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _rel(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return D.relation(spark, d, sql)


@query(
    f"with o as (select source, {GIT_KEY} as k, octet_length(encode(text)) as size from documents), p as (select source, k, count(*) as n, max(size) as size from o group by all)"
    " select source, sum(n)::bigint as chunks, count(*)::bigint as distinct_chunks, sum(n * size)::bigint as logical_bytes, sum(size)::bigint as unique_bytes from p group by source"
)
def dedup_stats(spark, d):
    """What storing every text once saves, per source."""
    docs = table(spark, d, "documents").select("source", K.git_blob_key(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("size"))
    return store.chunk_dedup(docs, "source")


@query(f"select doc_id, {GIT_KEY} as key, 6 as type, octet_length(encode(text))::bigint as size from documents")
def git_blob_keys(spark, d):
    docs = table(spark, d, "documents").withColumn("_k", K.git_blob_key(F.col("text")))
    return docs.select("doc_id", K.hex_key(F.col("_k")).alias("key"), K.key_type(F.col("_k")).alias("type"), F.octet_length("text").cast("long").alias("size"))


@query("""
with h as (select doc_id, sha256(text) as s, octet_length(encode(text)) as n from documents),
z as (select *, case when n < 256 then 1 when n < 65536 then 2 when n < 16777216 then 3 else 4 end as ls from h),
p as (select *, lpad(to_hex(n), 2 * ls, '0') as be from z)
select doc_id, array_to_string(list_reverse([s[2*i-1:2*i] for i in range(1, 32 - ls)]), '') || lower(array_to_string(list_reverse([be[2*i-1:2*i] for i in range(1, ls + 1)]), '')) || '0' || (ls - 1)::varchar as key,
0 as type, ls::int as length_size, n::decimal(20,0) as length, s[1:2*(31-ls)] as hash, null::varchar as error from p""")
def key_fields(spark, d):
    """Assembled keys taken apart again (SHA-256 stands in for the digest, so that SQL can follow)."""
    k = F.col("_k")
    docs = table(spark, d, "documents").withColumn("_k", K.key_from_hash(K.BLOB, F.octet_length("text").cast("long"), F.unhex(F.sha2("text", 256))))
    return docs.select("doc_id", K.hex_key(k).alias("key"), K.key_type(k).alias("type"), K.length_size(k).alias("length_size"), K.key_length(k).alias("length"), F.lower(F.hex(K.key_hash(k))).alias("hash"), K.key_error(k).alias("error"))


@query("""
with l as (select lang, md5(t) as k, octet_length(encode(t))::bigint as size from (select lang, unnest(string_split(text, chr(10))) as t from documents)),
p as (select lang, k, count(*) as n, max(size) as size from l group by all)
select lang, sum(n)::bigint as chunks, count(*)::bigint as distinct_chunks, sum(n * size)::bigint as logical_bytes, sum(size)::bigint as unique_bytes from p group by lang""")
def line_chunk_dedup(spark, d):
    lines = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("t"))
    return store.chunk_dedup(lines.select("lang", F.md5("t").alias("key"), F.octet_length("t").cast("long").alias("size")), "lang")


@query(f"""
with b as (select doc_id as pos, source, {GIT_KEY} as k, octet_length(encode(text)) as size from documents),
s as (select distinct {GIT_KEY} as k from documents where doc_id in (select doc_id from labels)),
c as (select *, row_number() over (partition by k order by pos) = 1 and k not in (select k from s) as n from b)
select source, count_if(n)::bigint as stored, count_if(not n)::bigint as deduped, coalesce(sum(size) filter (n), 0)::bigint as bytes_stored from c group by source""")
def write_batch_stats(spark, d):
    """All documents written to a store that has the labelled ones."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "source", K.hex_key(K.git_blob_key(F.col("text"))).alias("key"), F.octet_length("text").cast("long").alias("size"))
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("pos"))
    return store.write_stats(store.classify_batch(docs, docs.join(labelled, "pos", "left_semi")), "source")


@query(f"select pos, key from {D.duck(D.ASKED)} a where exists (select 1 from {D.duck(D.STORED)} s where s.key = a.key)")
def has(spark, d):
    return store.has(_rel(spark, d, D.ASKED), _rel(spark, d, D.STORED))


@query(f"select pos, key from {D.duck(D.ASKED)} a where not exists (select 1 from {D.duck(D.STORED)} s where s.key = a.key)")
def missing(spark, d):
    return store.missing(_rel(spark, d, D.ASKED), _rel(spark, d, D.STORED))


@query(f"with i as (select *, row_number() over (partition by key order by seg_id desc, off desc) as k from {D.duck(D.INDEX)}) select p_partkey, seg_id, off, slen from part join i on i.key = concat('p', p_partkey) and k = 1")
def get_newest(spark, d):
    """Each part's record in its newest segment."""
    asked = table(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("key"))
    return store.get(asked, _rel(spark, d, D.INDEX)).select("p_partkey", "seg_id", "off", "slen")


@query(f"select pos, a.key, max(s.slen) as stored_size from {D.duck(D.ASKED)} a left join {D.duck(D.STORED)} s on s.key = a.key group by pos, a.key, a.ctid".replace(", a.ctid", ""))
def stored_size(spark, d):
    return store.stored_size(_rel(spark, d, D.ASKED).distinct(), _rel(spark, d, D.STORED)).select("pos", "key", "stored_size")


@query(f"select distinct seg_id, key from {D.duck(D.INDEX)} a where exists (select 1 from {D.duck(D.INDEX)} b where b.key = a.key and b.seg_id <> a.seg_id)")
def has_outside(spark, d):
    index = _rel(spark, d, D.INDEX)
    return store.has_outside(index.select("seg_id", "key").distinct(), index).select("seg_id", "key")


@query(f"select pos, a.key, seg_id, off from {D.duck(D.ASKED)} a left join {D.duck(D.STORED)} s on s.key = a.key")
def sort_by_location(spark, d):
    return store.sort_by_location(_rel(spark, d, D.ASKED), _rel(spark, d, D.STORED)).select("pos", "key", "seg_id", "off")


@query(f"select seg_id, max(sealed_at) as sealed_at, sum(46 + slen)::bigint as body_bytes, count(*)::bigint as n_keys from {D.duck(D.INDEX)} group by seg_id")
def segments(spark, d):
    return store.segments(_rel(spark, d, D.INDEX))


@query(f"with p as (select seg_id, substring(md5(key), 1, 2) as first_byte, count(*) as n from {D.duck(D.INDEX)} group by all) select seg_id, first_byte, n, (sum(n) over (partition by seg_id order by first_byte))::bigint as upto from p")
def index_fanout(spark, d):
    """Per segment, entries by first key byte and the running count (keys hashed, so that they spread)."""
    return store.index_section(_rel(spark, d, D.INDEX).withColumn("key", F.md5("key")))


@query("select source as seg_id, count(*)::bigint as n_records, count_if(length(text) <> n_chars or text like '%!!%')::bigint as n_bad from documents group by source")
def verify_records(spark, d):
    docs = table(spark, d, "documents")
    return store.verify(docs.withColumn("seg_id", F.col("source")), (F.length("text") == F.col("n_chars")) & ~F.contains("text", F.lit("!!")))


@query(
    "select doc_id % 7 as seg_id, concat('d', doc_id) as key, doc_id as off, case when lang <> 'fr' then 'not indexed' else 'no record' end as fault from documents where (lang <> 'fr') <> (doc_id in (select doc_id from labels))"
)
def index_faults(spark, d):
    records = table(spark, d, "documents").filter("lang <> 'fr'").selectExpr("doc_id % 7 as seg_id", "concat('d', doc_id) as key", "doc_id as off")
    return store.index_faults(_rel(spark, d, D.STORED), records)


@query("select distinct concat('u', user_id) as key from events where event_id >= 5000 or event_type = 'click'")
def grey_set(spark, d):
    """Keys touched since a cycle began (dedup hits count as well as writes)."""
    touched = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("key"), F.when(F.col("event_type") == "click", 5000).otherwise(F.col("event_id")).alias("epoch"))
    return store.grey_set(touched, F.lit(5000))


@query(f"with r as (select dir, name, doc_id, row_number() over (partition by dir order by name) as k, count(*) over (partition by dir) as n from {D.duck(D.ENTRIES)} where name > 'f000000050') select dir, name, doc_id, k::int as rank, n > 5 as more from r where k <= 5")
def list_entries(spark, d):
    """The first five names beyond a mark in every directory, with whether more follow."""
    return tree.list_entries(_rel(spark, d, D.ENTRIES), F.lit("f000000050"), 5).select("dir", "name", "doc_id", "rank", "more")


@query(f"select x.doc_id, e.size from (select distinct doc_id from labels) x join documents d using (doc_id) join {D.duck(D.ENTRIES)} e on e.dir = concat(d.source, '/', d.lang) and e.name = concat('f', lpad(cast(x.doc_id as varchar), 9, '0'))")
def lookup_entry(spark, d):
    labelled = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    asked = labelled.select(F.concat("source", F.lit("/"), "lang").alias("dir"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"))
    return tree.lookup_entry(asked, _rel(spark, d, D.ENTRIES)).select("doc_id", "size")


@query("""
with p as (select dir, (pos // 8)::bigint as run, max(name) as sep from (select concat(source, '/', lang) as dir, doc_id as name, row_number() over (partition by concat(source, '/', lang) order by doc_id) - 1 as pos from documents) group by all)
select l.doc_id, min_by(p.run, p.sep) as run from labels l join documents x using (doc_id) left join p on p.dir = concat(x.source, '/', x.lang) and p.sep >= l.doc_id group by l.doc_id""")
def separator_lookup(spark, d):
    """Which leaf of eight entries holds a name: the first separator not below it."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang").alias("dir"), F.col("doc_id").alias("name"))
    placed = docs.withColumn("run", F.floor((F.row_number().over(Window.partitionBy("dir").orderBy("name")) - 1) / 8))
    pairs = placed.groupBy("dir", "run").agg(F.max("name").alias("sep")).withColumnRenamed("run", "child")
    asked = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("name")).distinct(), "name")
    return tree.separator_lookup(asked.select("dir", "name"), pairs).select(F.col("name").alias("doc_id"), F.col("child").cast("long").alias("run"))


_STEPS = "select distinct '' as dir, source as name, source as child from {documents} union all select distinct source, lang, concat(source, '/', lang) from {documents}"


@query(f"""
with a as (select doc_id as id, concat(source, case when doc_id % 3 = 0 then '//./' else '/' end, case when doc_id % 5 = 0 then 'zz' else lang end) as path from documents), e as {D.duck(_STEPS)},
n as (select id, replace(path, '//./', '/') as p from a)
select id, e2.child as target from n left join e e1 on e1.dir = '' and e1.name = split_part(p, '/', 1) left join e e2 on e2.dir = e1.child and e2.name = split_part(p, '/', 2)""")
def resolve_path(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "//./").otherwise("/"), F.when(F.col("doc_id") % 5 == 0, "zz").otherwise(F.col("lang")))
    return tree.resolve_path(docs.select(F.col("doc_id").alias("id"), F.lit("").alias("root"), path.alias("path")), _rel(spark, d, _STEPS), 2).select("id", "target")


@query(f"select top, dir, count(*)::bigint as n_entries, sum(size)::bigint as bytes from {D.duck(D.ENTRIES)} group by rollup(top, dir)")
def disk_usage(spark, d):
    return tree.disk_usage(_rel(spark, d, D.ENTRIES))


@query("""
select doc_id, (case when m & 16384 <> 0 then 'd' else '-' end) || (case when m & 256 <> 0 then 'r' else '-' end) || (case when m & 128 <> 0 then 'w' else '-' end)
|| (case when m & 64 <> 0 and m & 2048 <> 0 then 's' when m & 2048 <> 0 then 'S' when m & 64 <> 0 then 'x' else '-' end) || (case when m & 32 <> 0 then 'r' else '-' end) || (case when m & 16 <> 0 then 'w' else '-' end)
|| (case when m & 8 <> 0 and m & 1024 <> 0 then 's' when m & 1024 <> 0 then 'S' when m & 8 <> 0 then 'x' else '-' end) || (case when m & 4 <> 0 then 'r' else '-' end) || (case when m & 2 <> 0 then 'w' else '-' end)
|| (case when m & 1 <> 0 and m & 512 <> 0 then 't' when m & 512 <> 0 then 'T' when m & 1 <> 0 then 'x' else '-' end) as mode, lpad(n_chars::varchar, (max(length(n_chars::varchar)) over (partition by source))::int, ' ') as size
from (select *, (case when doc_id % 2 = 0 then 16384 else 32768 end + doc_id % 4096)::int as m from documents)""")
def render_listing(spark, d):
    """Mode strings and right-aligned sizes."""
    mode = (F.when(F.col("doc_id") % 2 == 0, 0o040000).otherwise(0o100000) + F.col("doc_id") % 4096).cast("int")
    docs = table(spark, d, "documents").select("doc_id", "source", R.mode_string(mode).alias("mode"), F.col("n_chars").cast("string").alias("size"))
    return tree.aligned(docs, "size", "source").select("doc_id", "mode", "size")


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as utc, strftime(o_orderdate + to_minutes((o_custkey % 600 - 300)::int), '%Y-%m-%dT%H:%M:%S') ||
case when o_custkey % 600 = 300 then 'Z' else (case when o_custkey % 600 < 300 then '-' else '+' end) || lpad((abs(o_custkey % 600 - 300) // 60)::varchar, 2, '0') || ':' || lpad((abs(o_custkey % 600 - 300) % 60)::varchar, 2, '0') end as local,
epoch_us(o_orderdate) * 1000 as parsed_ns from orders""")
def render_times(spark, d):
    """Instants as RFC 3339, in UTC and at an offset, and read back."""
    orders = table(spark, d, "orders").withColumn("ns", F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).withColumn("tz", (F.col("o_custkey") % 600 - 300).cast("int"))
    return orders.select("o_orderkey", R.rfc3339_utc(F.col("ns")).alias("utc"), R.rfc3339_at(F.col("ns"), F.col("tz")).alias("local"), R.parse_rfc3339(R.rfc3339_at(F.col("ns"), F.col("tz"))).ns.alias("parsed_ns"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'at sign' when c_custkey % 3 = 1 then 'control character' end as name_error from customer")
def ref_names(spark, d):
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "@").when(F.col("c_custkey") % 3 == 1, "\t").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", R.ref_name_error(name).alias("name_error"))


_REACH = f"with recursive e as {D.duck(D.EDGES)}, x(key) as (select concat('r', r_regionkey) from region where r_regionkey in (1, 3) union select e.child from x join e on e.parent = x.key)"


def _roots(spark, d):
    return table(spark, d, "region").filter("r_regionkey in (1, 3)").select(F.concat(F.lit("r"), "r_regionkey").alias("key"))


@query(f"{_REACH} select key from x")
def reachable_keys(spark, d):
    return graph.reachable_keys(_rel(spark, d, D.EDGES), _roots(spark, d))


@query(f"{_REACH} select key, case substring(key, 1, 1) when 'r' then 0 when 'n' then 1 when 'c' then 2 when 'o' then 3 else 4 end::bigint as depth from x where key not in (select key from {D.duck(D.PRESENT)})")
def check_complete(spark, d):
    """Reachable keys that the store lacks."""
    return graph.incomplete(_rel(spark, d, D.EDGES), _roots(spark, d), _rel(spark, d, D.PRESENT))


@query(f"""
select distinct concat('ref-', lower(r_name)) as name from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where l_partkey in (7, 19)""")
def why(spark, d):
    """The references that reach two parts."""
    keys = spark.sql("select inline(array(struct('p7' as key), struct('p19' as key)))")
    return graph.why(_rel(spark, d, D.EDGES), _rel(spark, d, D.REFS), keys)


@query(f"{_REACH} select s_suppkey as pos, concat('s', s_suppkey) as key from supplier where concat('s', s_suppkey) not in (select key from x) union all select 100000 + c_custkey, concat('c', c_custkey) from customer where concat('c', c_custkey) not in (select key from x)")
def unreachable_from(spark, d):
    asked = table(spark, d, "supplier").selectExpr("s_suppkey as pos", "concat('s', s_suppkey) as key").unionByName(table(spark, d, "customer").selectExpr("100000 + c_custkey as pos", "concat('c', c_custkey) as key"))
    return graph.unreachable_from(_rel(spark, d, D.EDGES), _roots(spark, d), asked)


@query("select substring(k, 1, 1) as kind, count(*)::bigint as marked from (select concat('r', r_regionkey) as k from region union select concat('n', n_nationkey) from nation union select concat('c', c_custkey) from customer union select concat('o', o_orderkey) from orders union select concat('p', l_partkey) from lineitem union select concat('s', l_suppkey) from lineitem) group by all")
def mark_live(spark, d):
    """Marked keys per kind, from all references."""
    return graph.mark_live(_rel(spark, d, D.EDGES), _rel(spark, d, D.REFS)).groupBy(F.substring("key", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("marked"))


@query(f"select seg_id, count(distinct off)::bigint as marked from {D.duck(D.INDEX)} where key in (select key from {D.duck(D.LIVE)}) group by seg_id")
def mark_bitmap(spark, d):
    return graph.mark_bitmap(_rel(spark, d, D.INDEX), _rel(spark, d, D.LIVE)).groupBy("seg_id").agg(F.sum("marked").alias("marked"))


_LIVENESS = f"""l as (select i.*, i.key in (select key from {D.duck(D.LIVE)}) as live from {D.duck(D.INDEX)} i),
s as (select seg_id, count_if(live)::bigint as live_keys, count_if(not live)::bigint as dead_keys, coalesce(sum(slen + 46) filter (live), 0)::bigint as live_bytes, coalesce(sum(slen + 46) filter (not live), 0)::bigint as dead_bytes, max(sealed_at) as sealed_at from l group by seg_id)"""


@query(f"with {_LIVENESS} select * from s")
def liveness(spark, d):
    return gc.liveness(_rel(spark, d, D.INDEX), _rel(spark, d, D.LIVE))


@query(
    f"with {_LIVENESS} select seg_id, sum(live_bytes + dead_bytes)::bigint as body_bytes, sum(live_keys + dead_keys)::bigint as n_keys, sum(live_keys)::bigint as live_keys, count_if(sealed_at < timestamp '{HORIZON}')::bigint as eligible, sum(dead_bytes)::double / sum(live_bytes + dead_bytes)::double as garbage from s group by rollup(seg_id)"
)
def gc_status(spark, d):
    return gc.status(_rel(spark, d, D.INDEX), _rel(spark, d, D.LIVE), F.to_timestamp(F.lit(HORIZON)))


_VICTIMS = f"""{_LIVENESS},
c as (select seg_id, live_bytes, row_number() over (order by seg_id) as n from s where dead_keys > 0 and dead_bytes >= 0.4 * (live_bytes + dead_bytes)),
f(n, rest, seg_id, live_bytes, taken) as (select 0::bigint, (select sum(live_bytes) // 3 from s)::bigint, null::bigint, null::bigint, false union all
  select c.n, case when c.live_bytes <= f.rest then f.rest - c.live_bytes else f.rest end, c.seg_id, c.live_bytes, c.live_bytes <= f.rest from f join c on c.n = f.n + 1)"""


@query(f"with recursive {_VICTIMS} select seg_id, live_bytes, taken from f where n > 0")
def select_victims(spark, d):
    """Packs worth copying, greedily under a budget of a third of all live bytes."""
    scores = cut(gc.liveness(_rel(spark, d, D.INDEX), _rel(spark, d, D.LIVE)))
    budget = scores.agg(F.sum("live_bytes")).first()[0] or 0
    return gc.select_victims(scores, None, 0.4, budget // 3)


@query(f"""
with recursive {_VICTIMS}, v as (select seg_id from f where taken), stay as (select seg_id, key, slen, sealed_at from l where seg_id not in (select seg_id from v)),
moved as (select 1000::bigint as seg_id, key, min(slen) as slen, max(sealed_at) as sealed_at from l where seg_id in (select seg_id from v) and live and key not in (select key from stay) group by key),
o as (select * from stay union all select * from moved)
select seg_id, count(*)::bigint as n_keys, sum(slen)::bigint as bytes, max(sealed_at) as sealed_at from o group by seg_id""")
def compact(spark, d):
    """The segments after compaction."""
    index, live = _rel(spark, d, D.INDEX), _rel(spark, d, D.LIVE)
    scores = cut(gc.liveness(index, live))
    budget = scores.agg(F.sum("live_bytes")).first()[0] or 0
    after = gc.compact(index, live, gc.select_victims(scores, None, 0.4, budget // 3), 1000)
    return after.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("slen").alias("bytes"), F.max("sealed_at").alias("sealed_at"))


@query(f"with u as (select *, row_number() over (partition by name order by pos desc) as k from {D.duck(D.UPDATES)}) select name, key, \"user\", created_at_ns from u where k = 1")
def refs_put_batch(spark, d):
    """References after a batch of updates: the last record of a name wins."""
    return refs.last_wins(_rel(spark, d, D.UPDATES)).orderBy("name")


@query("""
with now as (select c_custkey, concat('k', c_nationkey) as now from customer where c_acctbal > 0)
select e.c_custkey, concat('k', case when c_mktsegment = 'BUILDING' then 99 else e.c_nationkey end) is not distinct from now as ok, now from customer e left join now using (c_custkey)""")
def refs_check(spark, d):
    """Expectations of a compare-and-swap batch against what is there."""
    c = table(spark, d, "customer")
    now = c.filter("c_acctbal > 0").selectExpr("c_custkey as name", "concat('k', c_nationkey) as key")
    asked = c.selectExpr("c_custkey as name", "concat('k', case when c_mktsegment = 'BUILDING' then 99 else c_nationkey end) as old")
    return refs.check(now, asked).select(F.col("name").alias("c_custkey"), "ok", "now")


@query("""
select concat('n', n_nationkey) as name, concat('k', case when n_nationkey < 5 then 100 else 0 end + n_regionkey) as key from nation where n_nationkey < 5 or n_nationkey >= 10""")
def refs_update_batch(spark, d):
    """Five references swapped and five withdrawn, all checks passing."""
    n = table(spark, d, "nation")
    now = n.selectExpr("concat('n', n_nationkey) as name", "concat('k', n_regionkey) as key")
    records = n.filter("n_nationkey < 5").selectExpr("concat('n', n_nationkey) as name", "concat('k', 100 + n_regionkey) as key", "concat('k', n_regionkey) as old")
    withdrawn = n.filter("n_nationkey between 5 and 9").selectExpr("concat('n', n_nationkey) as name", "concat('k', n_regionkey) as old")
    return refs.update_batch(now, records, withdrawn)[0]


@query("select concat('n', n_nationkey) as name, concat('k', case when n_nationkey = 3 then 300 else n_regionkey end) as key from nation where n_nationkey <> 4 union all select 'new', 'k0'")
def refs_table(spark, d):
    """References on disk after a batch, a swap, a late swap (refused), a creation and a deletion."""
    ensure_checkpoint_dir(spark)
    kept = refs.RefTable(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/refs-{uuid.uuid4().hex}")
    kept.put_batch(table(spark, d, "nation").selectExpr("concat('n', n_nationkey) as name", "concat('k', n_regionkey) as key", "'' as user", "0L as created_at_ns", "1 as pos"))
    old = kept.get("n3")
    kept.compare_and_swap("n3", old, "k300")
    try:
        kept.compare_and_swap("n3", old, "late")
    except refs.Conflict:
        kept.create("new", "k0")
    kept.compare_and_delete("n4", kept.get("n4"))
    return kept.all().select("name", "key")


@query("""
with v as (select event_type, list_sort(list(value)) as x from events group by event_type)
select event_type, x[least(len(x), (len(x) * 0.5)::decimal(18,3)::bigint + 1)] as median, x[least(len(x), floor(len(x) * 0.9)::bigint + 1)] as p90, x[len(x)] as most from v""".replace("(len(x) * 0.5)::decimal(18,3)::bigint", "floor(len(x) * 0.5)::bigint"))
def bench_quantiles(spark, d):
    """Quantiles by position (no interpolation) and maxima of a measure per class."""
    return stats.quantiles(table(spark, d, "events"), "event_type", "value", {"median": 0.5, "p90": 0.9}).withColumnRenamed("max", "most")


@query("select role, count(*)::bigint as files, sum(octet_length(encode(text)))::bigint as bytes from conversations group by role")
def scan_sizes(spark, d):
    """Count and bytes, as the sizing pass of an ingest."""
    return stats.scan(table(spark, d, "conversations").select("role", F.octet_length("text").cast("long").alias("size")), "role")


@query("""
with b as (select event_id % 10 as root, md5(props) as body, event_id from events), f as (select root, body, min(event_id) as first, count(*) as n from b group by all)
select root, count(*)::bigint as accepted, sum(n - 1)::bigint as duplicates from f group by root""")
def inbox_batch(spark, d):
    """Bodies taken in once each per root (the stream's result, as a batch)."""
    e = table(spark, d, "events").select((F.col("event_id") % 10).alias("root"), F.md5("props").alias("body"))
    per = e.groupBy("root", "body").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("root").agg(F.count(F.lit(1)).alias("accepted"), F.sum(F.col("n") - 1).alias("duplicates"))


@query("select * from (select conv_id as dir, turn as pos, text as name, lag(text) over (partition by conv_id order by turn) as before from conversations) where name <= before".replace("select * from", "select dir, pos, name from"))
def order_faults(spark, d):
    """Entries whose name does not exceed the one before it (a conversation as a directory, its texts as names)."""
    return tree.order_faults(table(spark, d, "conversations").selectExpr("conv_id as dir", "turn as pos", "text as name"))


@query(f"select pos, key from {D.duck(D.ASKED)} a where exists (select 1 from {D.duck(D.STORED)} s where s.key = a.key and s.slen >= 1000)")
def has_durably(spark, d):
    """Asked keys with a copy in durable storage (here: records of 1000 bytes or more)."""
    return store.has_durably(_rel(spark, d, D.ASKED), _rel(spark, d, D.STORED).withColumn("durable", F.col("slen") >= 1000))


@query(f"with i as {D.duck(D.INDEX)}, v as (select seg_id from i group by seg_id having count(*) > (select count(*) / 32.0 from i)) select distinct key from i a where seg_id in (select seg_id from v) and exists (select 1 from i b where b.key = a.key and b.slen > 100 and b.seg_id not in (select seg_id from v))")
def good_survivors(spark, d):
    """Keys of the larger packs that have a good copy in a smaller one."""
    index = _rel(spark, d, D.INDEX)
    sizes = cut(index.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n")))
    victims = sizes.filter(F.col("n") > (sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / 32.0)).select("seg_id")
    return store.good_survivors(index.join(victims, "seg_id", "left_semi"), index, victims, F.col("slen") > 100).select("key").distinct()


@query("select distinct concat('c', o_custkey) as key from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where s_acctbal < 0")
def reaches(spark, d):
    """Customers that reach a supplier in debt."""
    roots = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"))
    keys = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("key"))
    return graph.reaches(_rel(spark, d, D.EDGES), roots, keys)


@query("select p_partkey, (p_size * 3600 + p_partkey % 60 * 60)::bigint * 1000000000 + 250000000 as ns, case when p_brand is null then null else p_brand end as name, concat(lower(p_type), '@x.org') as email from part")
def parsed_texts(spark, d):
    """Durations and identities read back from text."""
    p = table(spark, d, "part")
    who = R.parse_identity(F.concat("p_brand", F.lit(" <"), F.lower("p_type"), F.lit("@x.org>")))
    return p.select("p_partkey", R.parse_duration(F.concat(F.col("p_size").cast("string"), F.lit("h"), (F.col("p_partkey") % 60).cast("string"), F.lit("m250ms"))).alias("ns"), who["name"].alias("name"), who["email"].alias("email"))


def queries() -> dict[str, Query]:
    return {**_FOUND, **native.queries()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
