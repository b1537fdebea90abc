"""Registered queries of the storage operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import storage as S
from ..session import cut, deal, parts
from ..sources import model as M
from .catalogue import INDEXED, PREFIXES, _events, _indexed, _prefixes, query


@query("S07_chunk_round_trip", "select doc_id, octet_length(encode(text))::bigint as text_bytes, octet_length(encode(source))::bigint as source_bytes, true as intact, false as damaged_intact from documents")
def _(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", "text", "source", S.encode_chunk(F.create_map(F.lit("text"), F.col("text").cast("binary"), F.lit("source"), F.col("source").cast("binary"))).alias("file"))
    back = docs.withColumn("r", S.decode_chunk(F.col("file"))).withColumn("bad", S.decode_chunk(F.concat(F.substring("file", F.lit(1), F.octet_length("file") - 1), F.lit(b"\xff"))))
    intact = (F.col("r")["text"] == F.col("text").cast("binary")) & (F.col("r")["source"] == F.col("source").cast("binary"))
    return back.select("doc_id", F.octet_length(F.col("r")["text"]).cast("long").alias("text_bytes"), F.octet_length(F.col("r")["source"]).cast("long").alias("source_bytes"), F.coalesce(intact, F.lit(False)).alias("intact"), F.col("bad").isNotNull().alias("damaged_intact"))


PAYLOADS = f"{INDEXED}, pl as (select p_partkey as part, sha256(p_name || p_partkey) as chunk, p_name || p_partkey || case when p_partkey % 100 = 3 then '!' else '' end as content from part where p_partkey % 100 <> 7)"


def _restored(spark, d):
    part = M.table(spark, d, "part")
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    payloads = part.where("p_partkey % 100 <> 7").select(F.sha2(name, 256).alias("chunk"), F.concat(name, F.when(F.col("p_partkey") % 100 == 3, "!").otherwise("")).cast("binary").alias("content"))
    names = part.select(F.col("p_partkey").alias("chunk"), F.sha2(name, 256).alias("sha"))
    refs = _indexed(spark, d).join(names, "chunk").select("digest", "idx", F.col("sha").alias("chunk"))
    return S.restore(refs, payloads)


@query("S09_restore", f"with {PAYLOADS} select digest, bool_and(content is not null and sha256(content) = pl.chunk) as ok, count(*) as chunks, case when bool_and(content is not null and sha256(content) = pl.chunk) then sha256(string_agg(content, '' order by idx)) end as payload from ix left join pl on ix.chunk = pl.part group by digest")
def _(spark, d):
    return _restored(spark, d).withColumn("payload", F.sha2("payload", 256))


@query("Z01_integrity_sweep", f"with {PAYLOADS}, r as (select digest, bool_and(content is not null and sha256(content) = pl.chunk) as ok from ix left join pl on ix.chunk = pl.part group by digest) select digest from r where ok and digest % 3 <> 0 union select digest from r where digest % 50 = 0")
def _(spark, d):
    restored = _restored(spark, d)
    return S.sweep(restored.where("digest % 3 <> 0").select("digest"), restored, restored.where("digest % 50 = 0"))


@query("S16_smart_counters", "select event_id, (event_id * 1000003 + 7)::varchar as units from events")
def _(spark, d):
    n = F.lpad(F.hex(F.col("event_id") * 1_000_003 + 7), 32, "0")
    page = F.unhex(F.concat(*(F.substring(n, 31 - 2 * i, 2) for i in range(16))))
    pages = M.table(spark, d, "events").select("event_id", page.alias("page"))
    return pages.select("event_id", hashing.little_endian(F.col("page"), 0, 16).cast("string").alias("units"))


@query("S17_metric_sums", "select 'hits' as name, (sum(event_id) filter (event_type = 'click'))::double as value from events")
def _(spark, d):
    line = F.concat(F.lit('hits{kind="'), F.col("event_type"), F.lit('"} '), F.when(F.col("event_type") == "click", F.col("event_id")).otherwise(0).cast("string"))
    pages = M.table(spark, d, "events").select(F.concat(F.lit("# HELP hits n\n"), line, F.lit("\n")).alias("text"))
    return pages.select(F.explode(hashing.metric_samples(F.col("text"))).alias("x")).groupBy("x.name").agg(F.sum("x.value").alias("value"))


FILES = "f as (select source, 'f' || lpad(doc_id::varchar, 8, '0') as path, octet_length(encode(text))::bigint as bytes, sha256(text) as sha256 from documents)"


def _files(spark, d):
    return M.table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("S20_tree_digest", f"with {FILES}, b as (select source, md5(path)[1:3] as block, count(*) as files, sum(bytes)::bigint as bytes, sha256(string_agg(path || ':' || sha256, chr(10) order by path)) as digest from f group by 1, 2) select source, sum(files)::bigint as files, sum(bytes)::bigint as bytes, sha256(string_agg(block || ':' || digest, chr(10) order by block)) as tree from b group by source")
def _(spark, d):
    return S.tree_digest(_files(spark, d), "source")


@query("J16_compare_inventories", "with f as (select 'f' || lpad(doc_id::varchar, 8, '0') as path, doc_id % 11 as k, sha256(text) <> sha256(replace(text, 'zz', '?')) as changed from documents), s as (select path, case when k = 0 then 'missing' when k = 1 then 'extra' when changed then 'different' end as state from f) select * from s where state is not null")
def _(spark, d):
    files = _files(spark, d)
    k = F.col("doc_id") % 11
    now = M.table(spark, d, "documents").select("doc_id", F.sha2(F.replace("text", F.lit("zz"), F.lit("?")), 256).alias("now"))
    return S.compare_inventories(files.where(k != 0), files.join(now, "doc_id").where(k != 1).withColumn("sha256", F.col("now")))


@query("K13_clear_once", "select user_id as token, min(event_id) as seq from events where user_id % 3 <> 0 group by user_id")
def _(spark, d):
    requests = _events(spark, d).select(F.col("user_id").alias("token"), F.col("event_id").alias("seq"))
    return S.clear_once(requests, requests.where("token % 3 = 0").select("token").distinct())


@query("J02_shareable_flight", f"with {PREFIXES}, fl as (select span, digest, min(request) as flight from p where request % 4 = 0 group by span, digest) select request, max(span) as span, max_by(flight, span::bigint * 1000000000 + flight) as flight from p join fl using (span, digest) where request % 4 <> 0 group by request")
def _(spark, d):
    rows = cut(_prefixes(spark, d))  # every boundary of the whole texts
    flights = rows.where("request % 4 = 0").groupBy("span", "digest").agg(F.min("request").alias("flight"))
    return S.shareable_flight(rows.where("request % 4 <> 0"), flights)


@query("L03_shareable_prefixes", "select l_orderkey as flight, l_partkey as span from (select *, row_number() over (partition by l_orderkey order by l_partkey desc) as n from (select distinct l_orderkey, l_partkey from lineitem)) where n <= 3")
def _(spark, d):
    rows = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flight"), F.col("l_partkey").alias("span")).distinct()
    return S.shareable_prefixes(rows, 3)


USES = "u as (select event_type as cache, user_id as item, event_id as seq, floor(value * 10)::bigint as bytes from events), la as (select cache, item, max(seq) as seq, max_by(bytes, seq) as bytes from u group by cache, item)"


def _uses(spark, d):
    return M.table(spark, d, "events").select(F.col("event_type").alias("cache"), F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 10).cast("long").alias("bytes"))


@query("Z24_recent_by_bytes", f"with {USES} select cache, item, seq, bytes from (select *, sum(bytes) over (partition by cache order by seq desc) as r from la where bytes <= 3000) where r <= 3000")
def _(spark, d):
    return S.recent_by_bytes(_uses(spark, d), 3000)


@query("L06_recent_items", f"with {USES} select cache, item, seq from (select *, row_number() over (partition by cache order by seq desc) as n from la) where n <= 10")
def _(spark, d):
    return S.recent_items(_uses(spark, d), 10)


@query("J14_acknowledged_jobs", "select l_orderkey as job from lineitem group by l_orderkey having count(distinct l_suppkey % 3) >= 3")
def _(spark, d):
    return S.acknowledged(M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), (F.col("l_suppkey") % 3).alias("rank")), 3)


@query("J09_invalid_blocks", "select l_orderkey as request from lineitem group by l_orderkey having bool_or(l_partkey % 97 = 5 and l_partkey < 98)")
def _(spark, d):
    requests = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(F.collect_set("l_partkey").alias("blocks"))
    return S.hit_by_invalid_blocks(requests, F.array(F.lit(5).cast("long"))).select("request")


@query("Z07_shared_root_check", f"with {INDEXED}, n as (select digest, count(*) as n from ix group by digest) select digest as pair, not (digest % 6 = 0 and n > 1) and digest % 5 <> 0 as strict_prefix from n")
def _(spark, d):
    rows = _indexed(spark, d).withColumnRenamed("digest", "pair").withColumn("n", F.count("*").over(Window.partitionBy("pair")))
    prefix = rows.where((F.col("idx") < F.col("n") - 1) | (F.col("pair") % 5 == 0)).withColumn("chunk", F.when((F.col("pair") % 6 == 0) & (F.col("idx") == 0), -1).otherwise(F.col("chunk")))
    return S.shared_root_check(prefix.drop("n"), rows.drop("n"))


@query("T08_gather_records", "select o_orderkey as request, 1::int as ordinal, o_custkey as slot, c_name as record from orders left join customer on c_custkey = o_custkey")
def _(spark, d):
    rows = M.table(spark, d, "customer").select(F.col("c_custkey").alias("slot"), F.col("c_name").alias("record"))
    return S.gather(rows, M.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.lit(1).alias("ordinal"), F.col("o_custkey").alias("slot")))


@query("K16_gauges", "select unnest(['store_roots', 'store_kilobytes']) as metric, unnest([count(*)::double, sum(1000 + o_orderkey % 97)::double * 0.001]) as value from orders")
def _(spark, d):
    stats = M.roots(spark, d).agg(F.count("*").alias("n"), F.sum("manifest_bytes").alias("b"))
    return S.gauges(stats, {"n": ("store_roots", 1.0), "b": ("store_kilobytes", 0.001)})


@query("P22_access_modes", "with m as (select event_id, case event_id % 5 when 0 then 'read_write' when 1 then 'read_only' when 2 then 'write_only' when 3 then 'off' else 'odd' end as mode from events) select event_id, case when mode <> 'odd' then mode in ('read_write', 'write_only') end as store, case when mode <> 'odd' then mode in ('read_write', 'read_only') end as restore from m")
def _(spark, d):
    mode = F.element_at(F.array(*map(F.lit, ("read_write", "read_only", "write_only", "off", "odd"))), (F.col("event_id") % 5 + 1).cast("int"))
    return M.table(spark, d, "events").select("event_id", S.access_mode(mode).alias("m")).select("event_id", "m.store", "m.restore")


@query("R18_restore_phases", "with f as (select user_id as restore, event_type as phase, min_by(floor(value)::bigint, event_id) as ms from events group by 1, 2) select restore, coalesce(sum(ms) filter (phase = 'click'), 0)::bigint as click_ms, coalesce(sum(ms) filter (phase = 'view'), 0)::bigint as view_ms, coalesce(sum(ms) filter (phase in ('click', 'view')), 0)::bigint as service_ms from f group by restore")
def _(spark, d):
    phases = _events(spark, d).select(F.col("user_id").alias("restore"), F.col("event_type").alias("phase"), F.col("event_id").alias("seq"), F.col("v").alias("ms"))
    return S.restore_phases(phases, ["click", "view"])


@query("Z08_read_cohorts", "with n as (select event_id as load, user_id as evidence, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events) select load, evidence, n // 16 as cohort, case when n % 16 = 0 then 'leader' else 'member' end as role from n")
def _(spark, d):
    return S.cohorts(M.table(spark, d, "events").select(F.col("event_id").alias("load"), F.col("user_id").alias("evidence"), F.col("ts").alias("arrival")))


@query("E09_ordered_dedup", "with e as (select user_id, event_type, min(event_id) as i from events group by 1, 2) select user_id, string_agg(event_type, ',' order by i) as kinds from e group by user_id")
def _(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return M.table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(listed), ",").alias("kinds"))


@query("W02_removal_order", "select o_orderkey as digest, row_number() over (order by case when o_orderkey % 50 = 0 then 0 else 1 end, o_orderdate, o_orderkey) as ord from orders where not (o_orderkey % 50 <> 0 and o_orderkey % 41 = 0)")
def _(spark, d):
    from ..operators import eviction

    return eviction.removal_order(M.roots(spark, d), 0, 0).select("digest", "ord")


@query("A17_trace_report")
def _(spark, d):
    from .catalogue import QUERIES

    r = F.col("reason")
    return QUERIES["R07_shadow_admission"](spark, d).groupBy("cache").agg(F.count("*").alias("requests"), F.count_if(r == "window_hit").alias("window_hits"), F.count_if(r == "main_hit").alias("main_hits"), F.count_if(r.isin("spare", "win")).alias("admitted"), F.count_if(r == "loss").alias("rejected"))


@query("A14_attribution_totals")
def _(spark, d):
    from .catalogue import QUERIES

    last = QUERIES["R05_attribution"](spark, d).groupBy("request").agg(F.max_by(F.struct("local_reused", "external_reused", "computed", "complete"), "seq").alias("x"))
    return last.agg(F.count("*").alias("requests"), F.sum("x.local_reused").alias("local_reused"), F.sum("x.external_reused").alias("external_reused"), F.sum("x.computed").alias("computed"), F.count_if("x.complete").alias("complete"))


def _machine(name: str, key: str, sql: str | None = None):
    """Registers a replayed machine over the events that the function makes; most such state has no plain SQL."""

    def put(f):
        def run(spark, d):
            from ..streaming import replay

            # each user is a key of its own, whose events count from 0
            n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
            events, machine = f(_events(spark, d).withColumn("event_id", n.cast("long")))
            return replay.replay(events, key, machine)

        query(name, sql)(run)
        return f

    return put


@_machine("R08_chunk_ledger", "store")
def _(events):
    from ..streaming import machines

    chunks = F.array(F.col("v") % 20, F.col("user_id") % 7 + 100)
    return events.select(F.col("user_id").alias("store"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "remove").otherwise("publish").alias("event"), F.floor(F.col("event_id") / 8).cast("long").alias("context"), chunks.alias("chunks"), F.transform(chunks, lambda c: c * 10 + 1).alias("bytes")), machines.LEDGER


@_machine("R12_replica_receiver", "peer")
def _(events):
    from ..streaming import machines

    k = F.col("event_id") % 4
    what = F.when(k == 0, "begin").when(k == 3, "commit").otherwise("put")
    return events.select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), what.alias("event"), F.floor(F.col("event_id") / 4).cast("long").alias("transaction"), F.lit(1).cast("long").alias("generation"), F.col("event_id").alias("at"), F.when(k == 3, 2).otherwise(k - 1).cast("long").alias("frame"), F.col("event_type").alias("digest"), (F.col("v") % 9 != 0).alias("intact")), machines.RECEIVER


@_machine("W07_cohort_admission", "host")
def _(events):
    from ..streaming import machines

    return events.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "finish").otherwise("load").alias("event"), F.col("event_id").alias("load"), (F.col("v") % 12).cast("string").alias("evidence"), (F.col("v") % 50).alias("bytes")), machines.cohort_machine(4, 4, 120)


@query("A11_probe_cells", "with r as (select l_returnflag as mode, l_linenumber as depth, l_suppkey % 4 as rank, (l_partkey % 50)::bigint as blocks, l_quantity as p95 from lineitem) select mode, depth, count(*) as records, sum(blocks)::bigint as blocks, max(p95) as p95, count(distinct rank) = 4 and count(*) = 4 as complete from r group by mode, depth")
def _(spark, d):
    from ..operators import gates

    records = M.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("depth"), (F.col("l_suppkey") % 4).alias("rank"), (F.col("l_partkey") % 50).alias("blocks"), F.col("l_quantity").alias("p95"))
    return gates.probe_cells(records)


@query("P19_group_topology", """with g as (select l_orderkey as layout, l_suppkey % 3 as grp, count(distinct l_returnflag) as k, min(l_returnflag) as policy, count(*) as layers from lineitem group by 1, 2)
select layout, sha256('[' || string_agg('{"grp":' || grp || ',"layers":' || layers || ',"policy":"' || policy || '"}', ',' order by grp) || ']') as topology, bool_and(k = 1) as uniform from g group by layout""")
def _(spark, d):
    from ..operators import gates

    return gates.group_topology(M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("layout"), (F.col("l_suppkey") % 3).alias("grp"), F.col("l_returnflag").alias("policy")))


@query("H25_profile_alias", "select c_custkey, case c_mktsegment when 'BUILDING' then 'base' when 'MACHINERY' then 'large' else c_mktsegment end as profile from customer")
def _(spark, d):
    from ..operators import gates

    return M.table(spark, d, "customer").select("c_custkey", gates.resolve_alias(F.col("c_mktsegment"), {"BUILDING": "base", "MACHINERY": "large"}).alias("profile"))


@_machine("E03_revisioned_set", "owner")
def _(events):
    from ..streaming import machines

    kind = F.element_at(F.array(*map(F.lit, ("union", "union", "difference", "symmetric"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), kind.alias("event"), F.array(F.col("v") % 30, F.col("user_id") % 30).alias("items")), machines.REVISIONS


@_machine("R13_replica_sender", "peer")
def _(events):
    from ..streaming import machines

    kind = F.when(F.col("event_id") % 97 == 0, "lost").when(F.col("event_id") % 97 == 5, "joined").when(F.col("event_id") % 3 == 0, "credit").otherwise("send")
    return events.select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), kind.alias("event"), F.when(kind == "credit", F.floor(F.col("event_id") / 6)).otherwise(F.col("v") * 1000).cast("long").alias("n")), machines.SENDER


@_machine("R14_timed_leases", "host", "with e as (select user_id as host, row_number() over (partition by user_id order by event_id) - 1 as seq, floor(value)::bigint % 20 as digest from events), x as (select *, seq % 9 = 0 as release, lag(seq) over w as before, lag(seq % 9 = 0) over w as released from e window w as (partition by host, digest order by seq)), k as (select *, coalesce(not released and seq - before < 25, false) as known from x) select host, seq, digest, case when release then case when known then 'released' else 'unknown' end when known then 'follower' else 'leader' end as role from k")
def _(events):
    from ..streaming import machines

    return events.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 9 == 0, "release").otherwise("request").alias("event"), (F.col("v") % 20).alias("digest")), machines.lease_machine(25)


@query("H15_packed_positions", "with p as (select o_orderkey, range(o_orderkey % 4, o_orderkey % 23, 4) as p from orders) select o_orderkey, array_to_string(list_transform(p, lambda x: printf('%02x%02x0000', x & 255, x >> 8)), '') as packed, true as same from p")
def _(spark, d):
    from ..operators import pages

    key = F.col("o_orderkey")
    rows = M.table(spark, d, "orders").select("o_orderkey", pages.owned_positions(key % 23, 4, key % 4).alias("p")).withColumn("b", hashing.packed_positions(F.col("p")))
    return rows.select("o_orderkey", F.lower(F.hex("b")).alias("packed"), (hashing.unpacked_positions(F.col("b")) == F.col("p")).alias("same"))


@query("H06_scope_fingerprints", "select doc_id, case when doc_id % 5 = 0 then sha256('null') else sha256('\"' || source || '\"') end as fingerprint, sha256(sha256(text) || ':' || n_chars) as token from documents")
def _(spark, d):
    value = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    return M.table(spark, d, "documents").select("doc_id", hashing.scope_fingerprint(value).alias("fingerprint"), hashing.boundary_token(F.sha2("text", 256), F.col("n_chars")).alias("token"))


@query("H09_self_checksums", "select c_custkey, c_custkey % 7 <> 0 as ok from customer")
def _(spark, d):
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    pair = F.concat(F.lit('"checksum":"'), F.sha2(F.col("body").cast("binary"), 256), F.lit('"'))
    at = F.col("c_custkey") % 3  # the first, a middle or the last field
    sealed = F.when(at == 0, F.concat(F.lit("{"), pair, F.lit(","), F.expr("substring(body, 2)"))).when(at == 1, F.replace("body", F.lit(',"name"'), F.concat(F.lit(","), pair, F.lit(',"name"')))).otherwise(F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(","), pair, F.lit("}")))
    rows = M.table(spark, d, "customer").withColumn("body", body).withColumn("doc", sealed)
    damaged = F.when(F.col("c_custkey") % 7 == 0, F.regexp_replace("doc", '"name":"', '"name":"x')).otherwise(F.col("doc"))
    return rows.select("c_custkey", hashing.self_checksum_ok(damaged).alias("ok"))


@query("K15_event_json", """select event_id, '{"at_ns":' || at_ns || ',"key":' || key || ',"kind":"' || kind || '","staged":' || staged || '}' as json from writes""", "writes")
def _(spark, d):
    return M.writes(spark, d).select("event_id", F.to_json(F.struct("at_ns", "key", "kind", "staged")).alias("json"))


@query("S13_snapshot_plan", 'with g as (select l_orderkey as layout, l_suppkey % 3 as grp, l_partkey as layer, sum(l_quantity * 4096)::bigint as bytes from lineitem group by 1, 2, 3) select layout, grp, layer, bytes, (sum(bytes) over (partition by layout order by grp, layer) - bytes)::bigint as "offset" from g')
def _(spark, d):
    layers = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("layout"), (F.col("l_suppkey") % 3).alias("grp"), F.col("l_partkey").alias("layer")).agg(F.sum(F.col("l_quantity") * 4096).cast("long").alias("bytes"))
    over = Window.partitionBy("layout").orderBy("grp", "layer").rowsBetween(Window.unboundedPreceding, 0)
    return layers.withColumn("offset", F.sum("bytes").over(over) - F.col("bytes"))


@query("T14_prompt_cohort", "select c_custkey as prompt, sha256(repeat('token ' || c_custkey || ' ', 64)) as digest, length(repeat('token ' || c_custkey || ' ', 64)) as chars from customer")
def _(spark, d):
    text = F.expr("repeat(concat('token ', c_custkey, ' '), 64)")
    return M.table(spark, d, "customer").select(F.col("c_custkey").alias("prompt"), F.sha2(text.cast("binary"), 256).alias("digest"), F.length(text).cast("long").alias("chars"))


@query("E05_finished_unleased", "select distinct l_orderkey as request from lineitem where l_linestatus = 'F' except select l_orderkey from lineitem where l_linestatus = 'O'")
def _(spark, d):
    rows = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), "l_linestatus")
    return rows.where("l_linestatus = 'F'").select("request").subtract(rows.where("l_linestatus = 'O'").select("request"))


@query("Z22_range_blocks", "with r as (select o_orderkey as request, o_orderkey % 5 * 100 as a, o_orderkey % 5 * 100 + 256 as b from orders) select request, array_to_string(list_transform(range(a // 64, (b + 63) // 64), lambda i: request % 10 + i * 2), ',') as blocks from r")
def _(spark, d):
    from ..operators import pages

    key, start = F.col("o_orderkey"), F.col("o_orderkey") % 5 * 100
    table = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: key % 10 + i * 2)
    return M.table(spark, d, "orders").select(key.alias("request"), F.array_join(pages.range_blocks(table, start, start + 256, 64).cast("array<string>"), ",").alias("blocks"))


@_machine("S15_frame_decoder", "link", "with e as (select user_id as link, row_number() over (partition by user_id order by event_id) - 1 as n, floor(value)::bigint % 20 as size from events) select link, n * 2 + 1 as seq, '{\"id\":' || n || '}' as header, size as payload_bytes from e")
def _(events):
    from ..streaming import machines

    frame = hashing.encode_frame(F.struct(F.col("event_id").alias("id")), F.repeat(F.lit("x"), (F.col("v") % 20).cast("int")).cast("binary"))
    text = F.lower(F.hex(frame))
    halves = F.array(F.substring(text, 1, 14), F.substring(text, F.lit(15), F.length(text)))
    pieces = events.select(F.col("user_id").alias("link"), "event_id", F.posexplode(halves).alias("half", "piece"))
    return pieces.select("link", (F.col("event_id") * 2 + F.col("half")).alias("seq"), "piece"), machines.FRAMES


@query("S12_materialise_snapshot", "with s as (select root, layer, stage, \"start\" as a, least(\"end\", coalesce(min(\"start\") over (partition by root, layer order by stage rows between 1 following and unbounded following), \"end\")) as live, \"end\" as e from st), p as (select *, unnest(range(a, e)) as page from s) select root, layer, page, stage * 1000 + page as payload from p where page < live".replace("with s as", "with st as (select l_orderkey as root, l_suppkey % 3 as layer, row_number() over (partition by l_orderkey, l_suppkey % 3 order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_shipdate) as stage, (l_partkey % 40)::bigint as \"start\", (l_partkey % 40 + l_quantity)::bigint as \"end\" from lineitem), s as"))
def _(spark, d):
    from ..operators import structures
    from .catalogue import _stages

    stages = _stages(spark, d)
    # dealt by stage before the pages are made, which then stay where they are
    pieces = deal(stages.where("`end` > start"), parts(stages), "root", "layer", "stage").select("root", "layer", "stage", F.explode(F.sequence("start", F.col("end") - 1)).alias("page")).withColumn("payload", F.col("stage") * 1000 + F.col("page"))
    return S.materialise(deal(structures.overlay(stages), parts(stages), "root", "layer", "stage"), pieces)


@query("Z12_finish_stores", "with r as (select event_id as digest, case event_id % 3 when 0 then 'committed' when 1 then 'evicted' else 'error' end as outcome from events), h as (select o_orderkey as digest from orders) select digest from (select digest from h union select digest from r where outcome = 'committed') where digest not in (select digest from r where outcome <> 'committed')")
def _(spark, d):
    outcome = F.element_at(F.array(*map(F.lit, ("committed", "evicted", "error"))), (F.col("event_id") % 3 + 1).cast("int"))
    return S.finish_stores(M.table(spark, d, "events").select(F.col("event_id").alias("digest"), outcome.alias("outcome")), M.roots(spark, d))


@query("Z14_startup_quorum", "select distinct (l_suppkey % 5)::int as rank, l_orderkey as digest from lineitem where l_suppkey % 5 = l_partkey % 5 and l_suppkey % 5 < 4")
def _(spark, d):
    reports = M.table(spark, d, "lineitem").select((F.col("l_partkey") % 5).cast("int").alias("transport"), (F.col("l_suppkey") % 5).cast("int").alias("rank"), F.col("l_orderkey").alias("digest"))
    return S.startup_quorum(reports, 4)


@query("R11_report_pages", 'with d as (select distinct rank, digest from held), n as (select *, row_number() over (partition by rank order by digest) - 1 as n, count(*) over (partition by rank) as held from d) select rank, n // 64 as page, held, count(*) as digests, min(digest) as first, (held + 63) // 64 as pages from n group by rank, n // 64, held', "held")
def _(spark, d):
    return S.report_pages(M.held(spark, d))


@query("T13_capture_plan", "with s as (select l_orderkey as capture, l_suppkey % 3 as grp, l_partkey as source, max(l_quantity)::bigint as pages, min(l_quantity)::bigint // 2 as reused from lineitem group by 1, 2, 3), z as (select *, ((pages - reused) * 100 + 63) // 64 * 64 as size from s) select capture, grp, source, (sum(size) over (partition by capture order by grp, source) - size)::bigint as begin, size from z")
def _(spark, d):
    rows = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("capture"), (F.col("l_suppkey") % 3).alias("grp"), F.col("l_partkey").alias("source")).agg(F.max("l_quantity").cast("long").alias("pages"), F.floor(F.min("l_quantity") / 2).cast("long").alias("reused"))
    return S.capture_plan(rows.withColumn("bytes_per_page", F.lit(100)), 64)
