"""Registered queries of operators that other queries use as a step: each shows one step's result on its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import catalogue as C
from ..operators import deltas as D
from ..operators import eviction, gates, ledger, pages, quorum, structures, timeseries
from ..operators import storage as S
from ..operators import validators as V
from ..session import deal, parts
from ..sources import model as M
from .catalogue import ALIASES, ATTEMPTS, BASE_TAIL, EVICT, INDEXED, NOW_NS, PAGES, STAGES, YEAR_NS, _aliases, _indexed, _limits, _pages, _receipts, _stages, query
from .deltas import LAYERS, _layouts

# lookups and publication


@query("S06_alias_fallback", f"with {ALIASES}, q as (select storage_key, digest from aliases union select storage_key, digest + 7 from aliases) select q.storage_key, q.digest, coalesce(a.valid, false) as is_hit, case when a.valid is null then 'absent' when a.valid then 'hit' else 'corrupt' end as reason, case when a.valid is null then 'none' else 'alias' end as root_kind from q left join aliases a using (storage_key, digest)", "roots")
def _(spark, d):
    aliases = _aliases(M.roots(spark, d))
    asked = aliases.select("storage_key", "digest").union(aliases.select("storage_key", F.col("digest") + 7)).distinct()
    return C.lookup(asked, M.roots(spark, d).where("false"), aliases)


@query("Z02_reusable", f"with {ALIASES}, q as (select storage_key, digest from aliases) select q.storage_key, q.digest, coalesce(r.valid, a.valid) as by_rows, coalesce(r.valid, false) as by_pages from q left join roots r using (storage_key, digest) left join aliases a using (storage_key, digest)", "roots")
def _(spark, d):
    roots = M.roots(spark, d)
    aliases = _aliases(roots)
    asked = aliases.select("storage_key", "digest")
    rows = C.lookup(asked, roots, aliases).select("storage_key", "digest", F.col("is_hit").alias("by_rows"))
    whole = C.lookup(asked, roots, aliases.where("false")).select("storage_key", "digest", F.col("is_hit").alias("by_pages"))  # other storage modes have no aliases
    return rows.join(whole, ["storage_key", "digest"])


@query("Z03_invalidate_kind", f"with {ALIASES}, a as (select storage_key, digest, 'manifest' as root_kind from roots union all select storage_key, digest, 'prefix_alias' from aliases) select storage_key, digest, root_kind from a where not (digest % 5 = 0 and root_kind = 'prefix_alias')", "roots")
def _(spark, d):
    roots = M.roots(spark, d)
    both = roots.select("storage_key", "digest", F.lit("manifest").alias("root_kind")).union(_aliases(roots).select("storage_key", "digest", F.lit("prefix_alias")))
    return C.invalidate(both, both.where("digest % 5 = 0 and root_kind = 'prefix_alias'"))


@query("S08_verified_chunks", "select sha256(p_name || p_partkey) as chunk, p_partkey % 100 <> 3 as ok from part")
def _(spark, d):
    part = M.table(spark, d, "part")
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    payloads = part.select(F.sha2(name, 256).alias("chunk"), F.concat(name, F.when(F.col("p_partkey") % 100 == 3, "!").otherwise("")).cast("binary").alias("content"))
    refs = part.select(F.sha2(name, 256).alias("chunk"), F.lit(0).alias("idx")).withColumn("digest", F.col("chunk"))
    return S.restore(refs, payloads).select(F.col("digest").alias("chunk"), "ok")


@query("K01_chunk_headers", """with h as (select doc_id, '[{"name":"source","offset":0,"size":' || octet_length(encode(source)) || ',"sha256":"' || sha256(source) || '"},{"name":"text","offset":' || octet_length(encode(source)) || ',"size":' || octet_length(encode(text)) || ',"sha256":"' || sha256(text) || '"}]' as h, source || text as body from documents) select doc_id, sha256('QLC1' || lpad(printf('%x', length(h)), 8, '0') || h || body) as file from h""")
def _(spark, d):
    records = F.create_map(F.lit("text"), F.col("text").cast("binary"), F.lit("source"), F.col("source").cast("binary"))
    return M.table(spark, d, "documents").select("doc_id", F.sha2(S.encode_chunk(records), 256).alias("file"))


@query("K02_write_once", "with i as (select p_partkey % 50 as chunk, p_size::bigint as bytes from part), g as (select chunk, count(distinct bytes) as n, min(bytes) as bytes from i group by chunk) select chunk, bytes, case when n > 1 then 'conflict' else 'published' end as outcome from g")
def _(spark, d):
    offered = M.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("chunk"), F.col("p_size").cast("long").alias("bytes"))
    return C.publish(M.objects(spark, d).where("false"), offered)


# pages and layouts


@query("P07_page_counts", "with s as (select doc_id, n_chars as span, case doc_id % 3 when 0 then 'full' when 1 then 'sliding' else 'recurrent' end as policy from documents) select policy, sum(case policy when 'full' then (span + 255) // 256 when 'sliding' then (span + 255) // 256 - greatest((span - 1024) // 256, 0) else least((span + 255) // 256, 1) end)::bigint as pages from s group by policy")
def _(spark, d):
    policy = F.when(F.col("doc_id") % 3 == 0, "full").when(F.col("doc_id") % 3 == 1, "sliding").otherwise("recurrent")
    windows = M.table(spark, d, "documents").select(policy.alias("policy"), pages.page_window(F.col("n_chars"), policy, F.lit(256), F.lit(1024)).alias("w"))
    return windows.groupBy("policy").agg(F.sum("w.count").alias("pages"))


@query("P12_complete_chunks", "with k as (select l_orderkey as layout, count(distinct l_suppkey % 5) filter (l_suppkey % 5 < 2) as n from lineitem group by l_orderkey) select layout, n = 2 as complete from k")
def _(spark, d):
    layers = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("layout"), F.concat(F.lit("k"), F.col("l_suppkey") % 5).alias("kind"))
    return pages.missing_kinds(layers, ["k0", "k1"]).select("layout", (F.col("missing") == "").alias("complete"))


@query("E06_missing_records", "with w as (select l_orderkey as layout, bool_or(l_returnflag = 'A') as a, bool_or(l_returnflag = 'R') as r from lineitem group by l_orderkey) select layout, concat_ws(',', case when not a then 'A' end, case when not r then 'R' end) as missing from w")
def _(spark, d):
    return pages.missing_kinds(M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("layout"), F.col("l_returnflag").alias("kind")), ["A", "R"])


@query("P21_one_policy", "select l_orderkey, l_suppkey % 3 as grp, count(distinct l_returnflag) = 1 and count(l_returnflag) = count(*) as l_returnflag_common from lineitem group by 1, 2")
def _(spark, d):
    return gates.common_values(M.table(spark, d, "lineitem").withColumn("grp", F.col("l_suppkey") % 3), ["l_orderkey", "grp"], ["l_returnflag"])


@query("Z27_homogeneous_cluster", "with r as (select n_regionkey as cluster, n_nationkey % 5 as rank, n_regionkey % 2 as image from nation) select cluster, count(distinct image) = 1 as image_common, count(distinct rank) = 5 and count(*) = 5 and min(rank) = 0 and max(rank) = 4 as ranks_once from r group by cluster")
def _(spark, d):
    rows = M.table(spark, d, "nation").select(F.col("n_regionkey").alias("cluster"), (F.col("n_nationkey") % 5).alias("rank"), (F.col("n_regionkey") % 2).alias("image"))
    once = rows.groupBy("cluster").agg(((F.count_distinct("rank") == 5) & (F.count("*") == 5) & (F.min("rank") == 0) & (F.max("rank") == 4)).alias("ranks_once"))
    return gates.common_values(rows, ["cluster"], ["image"]).join(once, "cluster")


@query("H10_chunk_counts", "select doc_id as digest, count(*) as chunks, max(e) as tokens from (select doc_id, unnest(list_transform(range((n_chars + 99) // 100), lambda i: least((i + 1) * 100, n_chars))) as e from documents) group by doc_id")
def _(spark, d):
    spans = pages.chunk_spans(M.table(spark, d, "documents").select(F.col("doc_id").alias("digest"), F.col("n_chars").alias("tokens")), 100)
    return spans.groupBy("digest").agg(F.count("*").alias("chunks"), F.max("end").alias("tokens"))


@query("H17_stages", 'with k as (select o_orderkey as digest, unnest(range((o_orderkey % 9 * 1000 + 1023) // 1024)) as idx, o_orderkey % 9 * 1000 as bytes from orders) select digest, idx, idx * 1024 as begin, least((idx + 1) * 1024, bytes) as "end" from k')
def _(spark, d):
    return pages.split_extents(M.table(spark, d, "orders").select(F.col("o_orderkey").alias("digest"), (F.col("o_orderkey") % 9 * 1000).alias("bytes")), 1024)


@query("Z05_rank_chunks", "with c as (select o_orderkey as digest, o_orderkey % 700 as tokens from orders), k as (select digest, tokens, unnest(range((tokens + 255) // 256)) as idx from c) select digest, idx, len(range(idx * 256 + (digest % 4 - idx * 256 % 4 + 4) % 4, least((idx + 1) * 256, tokens), 4)) as owned from k")
def _(spark, d):
    spans = pages.chunk_spans(M.table(spark, d, "orders").select(F.col("o_orderkey").alias("digest"), (F.col("o_orderkey") % 700).alias("tokens")), 256)
    owned = pages.owned_positions(F.col("end"), 4, F.col("digest") % 4)
    return spans.select("digest", "idx", F.size(F.filter(owned, lambda p: p >= F.col("start"))).cast("long").alias("owned"))


@query("H12_quanta", "select o_orderkey, case when o_totalprice > 0 then (floor(o_totalprice)::bigint - 1) // 120 * 120 else 0 end as span from orders")
def _(spark, d):
    return M.table(spark, d, "orders").select("o_orderkey", pages.aligned_span(F.floor("o_totalprice").cast("long"), [8, 60, 24]).alias("span"))


@query("H21_layer_names", "select p_partkey, case when contains(lower(p_name), 'a') then 'attention' else 'other' end as kind from part")
def _(spark, d):
    return M.table(spark, d, "part").select("p_partkey", pages.layer_kind(F.col("p_name"), [("a", "attention")], "other").alias("kind"))


# chains, deltas, ranges


@query("J03_base_join", f"with {BASE_TAIL} select digest, max(\"end\") as base_tokens, max(\"end\") // 256 * 256 as kept_tokens, count(*) filter (\"end\" <= whole) as kept from base join bt using (digest) where digest in (select digest from lg) group by digest")
def _(spark, d):
    base, tail = _extension(spark, d)
    merged = structures.extend(base, tail, 256)
    kept = merged.groupBy("digest").agg(F.count_if(F.col("part") == "base").alias("kept"))
    tokens = base.groupBy("digest").agg(F.max("end").alias("base_tokens"))
    return kept.join(tokens, "digest").select("digest", "base_tokens", (F.floor(F.col("base_tokens") / 256) * 256).alias("kept_tokens"), "kept")


def _extension(spark, d):
    n = F.count("*").over(Window.partitionBy("digest"))
    idx = F.col("idx").cast("long")
    rows = _indexed(spark, d).withColumn("n", n).select("digest", "chunk", "n", (idx * 256).alias("start"), F.least((idx + 1) * 256, F.col("n") * 256 - F.col("digest") % 3 * 50).alias("end"))
    tail = rows.where("digest % 7 <> 0").select("digest", (F.col("start") + (F.col("n") - 1) * 256).alias("start"), (F.col("end") + (F.col("n") - 1) * 256 + F.col("digest") % 5).alias("end"), (F.col("chunk") + 1_000_000).alias("chunk"))
    return rows.drop("n"), tail


@query("E07_ordered_union", f'with {BASE_TAIL}, m as (select base.digest, base."start", base.chunk from base join bt using (digest) where "end" <= whole union all select tail.digest, tail."start", tail.chunk from tail join bt using (digest) where "start" >= whole) select digest, string_agg(chunk, \',\' order by "start", chunk) as chunks from m where digest in (select digest from lg) group by digest')
def _(spark, d):
    merged = structures.extend(*_extension(spark, d), 256)
    return merged.groupBy("digest").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk"))), lambda x: x["chunk"].cast("string")), ",").alias("chunks"))


@query("J10_equal_pages", f"with {PAGES} select root, grp, count(*) filter (b.payload = n.payload) as same, count(*) as pages from bs b join nw n using (root, grp, layer, page) group by root, grp")
def _(spark, d):
    base, new = _pages(spark, d)
    both = base.withColumnRenamed("payload", "old").join(new, ["root", "grp", "layer", "page"])
    return both.groupBy("root", "grp").agg(F.count_if(F.col("old") == F.col("payload")).alias("same"), F.count("*").alias("pages"))


@query("T05_captured_tails", "with s as (select l_orderkey as capture, l_suppkey % 3 as grp, l_partkey as source, max(l_quantity)::bigint as pages, min(l_quantity)::bigint // 2 as reused from lineitem group by 1, 2, 3) select capture, sum((pages - reused) * 100)::bigint as tail_bytes, count(*) as sources from s group by capture")
def _(spark, d):
    rows = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("capture"), (F.col("l_suppkey") % 3).alias("grp"), F.col("l_partkey").alias("source")).agg(F.max("l_quantity").cast("long").alias("pages"), F.floor(F.min("l_quantity") / 2).cast("long").alias("reused"))
    return S.capture_plan(rows.withColumn("bytes_per_page", F.lit(100))).groupBy("capture").agg(F.sum("size").alias("tail_bytes"), F.count("*").alias("sources"))


@query("T07_live_tails", f'with {STAGES}, x as (select *, least("end", coalesce(min("start") over (partition by root, layer order by stage rows between 1 following and unbounded following), "end")) as live_end from st) select root, count(distinct stage) as live_stages, sum(live_end - "start")::bigint as live_pages from x where live_end > "start" group by root')
def _(spark, d):
    return structures.overlay(_stages(spark, d)).groupBy("root").agg(F.count_distinct("stage").alias("live_stages"), F.sum(F.col("live_end") - F.col("start")).alias("live_pages"))


@query("T09_extended_capture", f"with {PAGES}, r as (select root, grp, coalesce(min(b.page) filter (b.payload is distinct from n.payload), max(b.page) + 1) as reused from bs b join nw n using (root, grp, layer, page) group by root, grp) select root, grp, count(*) filter (page < reused) as from_base, count(*) filter (page >= reused) as from_tail from nw join r using (root, grp) group by root, grp")
def _(spark, d):
    base, new = _pages(spark, d)
    reused = structures.reusable_pages(base, new)
    complete = structures.apply_delta(base, new, reused).join(reused, ["root", "grp"])
    return complete.groupBy("root", "grp").agg(F.count_if(F.col("page") < F.col("reused")).alias("from_base"), F.count_if(F.col("page") >= F.col("reused")).alias("from_tail"))


@query("J11_zipped_tails", f'with {STAGES}, x as (select *, least("end", coalesce(min("start") over (partition by root, layer order by stage rows between 1 following and unbounded following), "end")) as live_end from st) select root, layer, sum(live_end - "start")::bigint as pages from x where live_end > "start" group by root, layer')
def _(spark, d):
    stages = _stages(spark, d)
    pieces = deal(stages, parts(stages), "root", "layer", "stage").select("root", "layer", "stage", F.explode(F.sequence("start", F.col("end") - 1)).alias("page")).withColumn("payload", F.col("page"))
    return S.materialise(deal(structures.overlay(stages), parts(stages), "root", "layer", "stage"), pieces).groupBy("root", "layer").agg(F.count("*").alias("pages"))


@query("J12_overlapping_extents", f'with {INDEXED}, ex as (select digest, idx, (sum(bytes) over w - bytes)::bigint as s, (sum(bytes) over w)::bigint as e from ix join objects using (chunk) window w as (partition by digest order by idx)) select o_orderkey as request, count(*) as pieces, sum(least(30000, e) - greatest(10000, s))::bigint as bytes from orders join ex on digest = o_orderkey where s < 30000 and e > 10000 group by o_orderkey', "objects")
def _(spark, d):
    extents = C.extent_offsets(_indexed(spark, d).join(M.objects(spark, d), "chunk"))
    requests = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("digest"), F.lit(10_000).alias("lo"), F.lit(30_000).alias("hi"))
    return structures.read_ranges(extents, requests).groupBy("request").agg(F.count("*").alias("pieces"), F.sum("length").alias("bytes"))


# accounts and reports


@query("A08_context_reports", "with live as (select distinct digest, chunk from refs semi join (select digest from roots where valid) v using (digest)), c as (select chunk, count(*) as n from live group by chunk) select count(distinct digest) as contexts, sum(bytes) filter (n > 1)::bigint as shared_bytes, sum(bytes)::bigint as encoded_bytes from live join c using (chunk) join objects using (chunk)", "roots", "refs", "objects")
def _(spark, d):
    reports = ledger.shared_bytes(M.roots(spark, d), M.refs(spark, d), M.objects(spark, d)).join(M.roots(spark, d).select("digest", "manifest_bytes"), "digest")
    return reports.agg(F.count("*").alias("contexts"), F.sum("shared_bytes").alias("shared_bytes"), F.sum(F.col("encoded_bytes") - F.col("manifest_bytes")).alias("encoded_bytes"))


@query("A18_allocated_bytes", "select sum((bytes + 511) // 512 * 512)::bigint as allocated_bytes, count(*) as files from (select manifest_bytes as bytes from roots union all select bytes from objects)", "roots", "objects")
def _(spark, d):
    return C.store_bytes(M.roots(spark, d), M.objects(spark, d), 512).select("allocated_bytes", "files")


@query("H11_blocks", "select chunk, (bytes + 4095) // 4096 as blocks from objects", "objects")
def _(spark, d):
    one = M.objects(spark, d)
    return one.select("chunk", F.ceil(F.col("bytes") / 4096).alias("blocks"))


@query("A20_checkpoint_totals", "select lang, count(*) as files, sum(octet_length(encode(text)))::bigint as bytes from documents group by lang")
def _(spark, d):
    files = M.table(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return S.tree_digest(files, "lang").select("lang", "files", "bytes")


@query("Z26_attempt_counters", f"with {ATTEMPTS} select outcome, count(*) as attempts, sum(payload_bytes + 512)::bigint as staged_bytes, sum(unique_bytes)::bigint as unique_bytes, sum(payload_bytes + 512 + unique_bytes) > 0 as active from att group by outcome")
def _(spark, d):
    totals = ledger.receipt_totals(_receipts(spark, d))
    return totals.select("outcome", "attempts", "staged_bytes", "unique_bytes", (F.col("staged_bytes") + F.col("unique_bytes") > 0).alias("active"))


@query("Z28_interference", "with e as (select user_id % 2 = 0 as loaded, value as elapsed, event_type <> 'error' as ok from events) select loaded, count(*) as requests, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed, min(elapsed) filter (ok) as min, quantile_disc(elapsed, 0.5) filter (ok) as p50, quantile_disc(elapsed, 0.95) filter (ok) as p95, max(elapsed) filter (ok) as max from e group by loaded")
def _(spark, d):
    return timeseries.latency_summary(M.table(spark, d, "events").select((F.col("user_id") % 2 == 0).alias("loaded"), F.col("value").alias("elapsed"), (F.col("event_type") != "error").alias("ok")), "loaded")


@query("J15_device_deltas", "with s as (select user_id as device, event_id as n, event_id // 3 as units from events), x as (select device, n, units - lag(units) over (partition by device order by n) as d from s) select device, sum(d)::bigint as units, count(d) as samples from x group by device having count(d) > 0")
def _(spark, d):
    samples = M.table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("sample_id"), F.col("event_id").alias("at_ns"), F.floor(F.col("event_id") / 3).alias("units"))
    return timeseries.counter_deltas(samples, 1).groupBy("device").agg(F.sum("bytes").alias("units"), F.count("*").alias("samples"))


@query("H23_window_bounds", "select at_ns // 3600000000000 * 3600000000000 as window_ns, strftime(make_timestamp(at_ns // 3600000000000 * 3600000000), '%Y-%m-%dT%H:%M:%SZ') as begins, count(*) as events from writes group by at_ns // 3600000000000", "writes")
def _(spark, d):
    windows = timeseries.write_windows(M.writes(spark, d))
    return windows.select("window_ns", F.date_format(F.timestamp_seconds(F.col("window_ns") / 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("begins"), "events")


@query("H14_saturated_heat", "with k as (select user_id as key, count(*) as n from events group by user_id) select key, least(n, 255) as heat from k")
def _(spark, d):
    trace = M.table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("n"))
    return timeseries.heat(trace, window=1 << 40)  # never halved


@query("R17_first_marks", "with f as (select user_id as request, event_id % 14 as stage, min(epoch_us(ts) * 1000) as at_ns from events group by 1, 2) select request, count(*) as stages, count(*) = 14 as complete from f group by request")
def _(spark, d):
    marks = M.table(spark, d, "events").select(F.col("user_id").alias("request"), (F.col("event_id") % 14).alias("stage"), M.nanos("ts").alias("at_ns"))
    return timeseries.stage_timings(marks).groupBy("request").agg(F.count("*").alias("stages"), (F.count("*") == 14).alias("complete"))


@query("R16_released_captures", "select l_partkey as job, count(distinct l_suppkey % 4) as acknowledged from lineitem group by l_partkey having count(distinct l_suppkey % 4) >= 4")
def _(spark, d):
    acks = M.table(spark, d, "lineitem").select(F.col("l_partkey").alias("job"), (F.col("l_suppkey") % 4).alias("rank"))
    return S.acknowledged(acks, 4).join(acks.groupBy("job").agg(F.count_distinct("rank").alias("acknowledged")), "job")


@query("H24_phase_map", "with f as (select user_id as restore, event_type as phase, min_by(floor(value)::bigint, event_id) as ms from events group by 1, 2) select restore, string_agg(phase || '=' || ms, ',' order by phase) as phases from f group by restore")
def _(spark, d):
    first = M.table(spark, d, "events").groupBy(F.col("user_id").alias("restore"), F.col("event_type").alias("phase")).agg(F.min_by(F.floor("value").cast("long"), "event_id").alias("ms"))
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "ms"))))
    return first.groupBy("restore").agg(F.array_join(F.transform(F.map_entries(listed), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("phases"))


# orders and limits


@query("L02_last_boundaries", "with c as (select doc_id as digest, length(text) * 400 as tokens from documents), k as (select digest, (tokens - 1) // 4096 as n from c) select digest, least(n, 64)::bigint as kept, n * 4096 as last from k where n >= 1")
def _(spark, d):
    found = C.alias_boundaries(M.table(spark, d, "documents").select(F.col("doc_id").alias("digest"), (F.length("text").cast("long") * 400).alias("tokens")))
    return found.groupBy("digest").agg(F.count("*").alias("kept"), F.max("boundary").alias("last"))


@query("L04_evicted_roots", f"with {EVICT} select digest, ord from ev where evicted", "roots", "refs", "objects")
def _(spark, d):
    return eviction.maintain(M.roots(spark, d), M.refs(spark, d), M.objects(spark, d), **_limits(spark, d)).where("evicted").select("digest", "ord")


@query("L08_deterministic_order", f"select digest, row_number() over (order by case when not valid or {NOW_NS} - mtime_ns >= {3 * YEAR_NS} then 0 else 1 end, mtime_ns, digest) as ord from roots where not (valid and protected)", "roots")
def _(spark, d):
    return eviction.removal_order(M.roots(spark, d), NOW_NS, 3 * YEAR_NS).select("digest", "ord")


@query("L07_page_cursor", "with d as (select distinct rank, digest from held), p as (select rank, (count(*) + 63) // 64 as pages from d group by rank), r as (select event_id as report, (user_id % 4)::int as rank, row_number() over (partition by user_id % 4 order by event_id) - 1 as n from events) select report, r.rank, (n % pages)::bigint as page from r join p on p.rank = r.rank", "held")
def _(spark, d):
    totals = S.report_pages(M.held(spark, d)).groupBy("rank").agg(F.max("pages").alias("pages"))
    from ..operators.ordering import in_group

    reports = in_group(M.table(spark, d, "events").select(F.col("event_id").alias("report"), (F.col("user_id") % 4).cast("int").alias("rank")), ["rank"], "report")
    return reports.join(totals, "rank").select("report", "rank", ((F.col("n") - 1) % F.col("pages")).alias("page"))


# digests and text


@query("W05_boundary_digests", "with t as (select doc_id as request, text, (length(text) - 1) // 512 * 512 as span from documents where length(text) > 512) select request, span, sha256(unhex('7300' || array_to_string(list_transform(string_split(text[1:span], ''), lambda c: printf('%02x%02x%02x00', ascii(c) & 255, (ascii(c) >> 8) & 255, (ascii(c) >> 16) & 255)), ''))::blob) as digest from t")
def _(spark, d):
    found = quorum.prefix_digests(M.table(spark, d, "documents").select(F.col("doc_id").alias("request"), "text"), 512)
    return found.groupBy("request").agg(F.max_by(F.struct("span", "digest"), "span").alias("x")).select("request", "x.*")


@query("H01_context_digests", "with t as (select c_custkey, list_transform(range(1 + c_custkey % 20), lambda i: c_custkey * 7 + i) as tokens from customer) select c_custkey, sha256(unhex(hex(encode(c_mktsegment)) || '00' || array_to_string(list_transform(tokens, lambda x: printf('%02x%02x%02x%02x', x & 255, (x >> 8) & 255, (x >> 16) & 255, (x >> 24) & 255)), ''))) as digest from t join customer using (c_custkey)")
def _(spark, d):
    tokens = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 20), lambda i: F.col("c_custkey") * 7 + i)
    return M.table(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.col("c_mktsegment").cast("binary"), F.lit(b"\x00"), hashing.packed_positions(tokens)), 256).alias("digest"))


@query("Z04_scoped_digests", "select event_id, sha256(user_id || ':' || sha256(event_type)) as digest from events")
def _(spark, d):
    return M.table(spark, d, "events").select("event_id", gates.scope_binding(F.col("user_id").cast("string"), F.sha2("event_type", 256)).alias("digest"))


@query("H18_canonical_json", """select event_id, sha256('{"a":' || event_id || ',"b":"' || event_type || '"}') as digest, event_id % 3 <> 0 as exact from events""")
def _(spark, d):
    document = F.struct(F.col("event_id").alias("a"), F.col("event_type").alias("b"))
    text = F.to_json(F.struct(F.col("event_id").alias("a"), F.col("event_type").alias("b"), F.when(F.col("event_id") % 3 == 0, 1).alias("c")))
    return M.table(spark, d, "events").select("event_id", hashing.canonical_digest(document).alias("digest"), (F.array_sort(F.json_object_keys(text)) == F.array(F.lit("a"), F.lit("b"))).alias("exact"))


@query("H20_valid_names", "select c_custkey, c_custkey % 2 = 0 as valid from customer")
def _(spark, d):
    name = F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256)
    return M.table(spark, d, "customer").select("c_custkey", gates.valid_digest(F.when(F.col("c_custkey") % 2 == 0, name).otherwise(F.upper(name))).alias("valid"))


@query("H16_packed_records", "select l_orderkey, l_linenumber, l_partkey * 3 as first, l_suppkey as second from lineitem")
def _(spark, d):
    records = F.create_map(F.lit("a"), hashing.packed_positions(F.array(F.col("l_partkey") * 3)), F.lit("b"), hashing.packed_positions(F.array("l_suppkey")))
    # a column for each step: nested, the plan would hold the whole encoder again at each place that the decoder reads
    back = M.table(spark, d, "lineitem").withColumn("file", S.encode_chunk(records)).withColumn("back", S.decode_chunk(F.col("file")))
    back = back.withColumns({name: F.col("back")[name] for name in ("a", "b")})
    first = lambda name: F.get(hashing.unpacked_positions(F.col(name)), 0)
    return back.select("l_orderkey", "l_linenumber", first("a").alias("first"), first("b").alias("second"))


@query("H08_checksums", "select c_custkey, true as same, c_custkey % 3 <> 0 as unchanged from customer")
def _(spark, d):
    content = F.col("c_name").cast("binary")
    stored = F.when(F.col("c_custkey") % 3 == 0, F.concat(content, F.lit(b"."))).otherwise(content)
    nothing = F.lit(None).cast("string")
    return M.table(spark, d, "customer").select("c_custkey", hashing.payload_matches(content, nothing, F.crc32(content)).alias("same"), hashing.payload_matches(stored, nothing, F.crc32(content)).alias("unchanged"))


# hand-offs


@query("Z10_commit_handoff", "with r as (select event_id as digest, case event_id % 3 when 0 then 'committed' when 1 then 'evicted' else 'error' end as outcome, event_id * 100 as allocated, event_id % 7 <> 0 as ok from events) select outcome, count(*) filter (ok) as accepted, count(*) filter (not ok) as rejected, coalesce(sum(allocated) filter (ok and outcome = 'committed'), 0)::bigint as allocated_bytes from r group by outcome")
def _(spark, d):
    k = F.col("event_id")
    outcome = F.element_at(F.array(*map(F.lit, ("committed", "evicted", "error"))), (k % 3 + 1).cast("int"))
    receipts = M.table(spark, d, "events").select(k.alias("digest"), outcome.alias("outcome"), F.when(k % 7 == 0, -1).otherwise(k * 100).alias("allocated_bytes"))
    return S.handed_off(receipts)


@query("Z25_clear_tokens", "with r as (select user_id as token, event_id as seq, event_id % 4 <> 0 as ok from events) select token, min(seq) filter (ok) as seq, count(*) filter (not ok) as malformed from r group by token having count(*) filter (ok) > 0")
def _(spark, d):
    rows = M.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit("?")).otherwise(F.lpad(F.hex("user_id"), 32, "0")).alias("token"), F.col("event_id").alias("seq"), "user_id")
    good = rows.where(F.col("token").rlike("^[0-9A-F]{32}$"))
    first = S.clear_once(good.select("token", "seq"), good.select("token").where("false")).select(F.conv("token", 16, 10).cast("long").alias("token"), "seq")
    malformed = rows.groupBy(F.col("user_id").alias("token")).agg(F.count_if(F.col("event_id") % 4 == 0).alias("malformed"))
    return first.join(malformed, "token")


# snapshots read back


@query("S13_decoded_snapshots", f"with {LAYERS} select root, layer::varchar as name, grp, pages * page_bytes as bytes, sha256(repeat(chr((65 + layer % 26)::int), (pages * page_bytes)::int)) as sha256 from ly join g using (root, grp)")
def _(spark, d):
    layouts = _layouts(spark, d)
    counts = F.transform(F.array_sort(F.map_entries("result_counts")), lambda e: e["value"])
    payload = F.array_join(F.transform("layers", lambda v: F.repeat(F.chr(65 + v["name"].cast("long") % 26), (F.element_at("result_counts", v["grp"]) * v["page_bytes"]).cast("int"))), "").cast("binary")
    x = layouts.withColumn("head", D.snapshot_header(F.col("layout_sha256"), counts)).withColumn("file", F.concat("head", payload))
    x = x.withColumn("prefix", D.header_prefix(F.col("file"), D.SNAPSHOT_MAGIC)).withColumn("e", F.explode(D.extents(F.col("layers"), F.col("result_counts"), F.octet_length("prefix"))))
    part = F.substring("file", (F.col("e.source_start") + 1).cast("int"), (F.col("e.source_end") - F.col("e.source_start")).cast("int"))
    return x.select("root", "e.name", "e.grp", (F.col("e.source_end") - F.col("e.source_start")).alias("bytes"), F.sha2(part, 256).alias("sha256"))


@query("S10_object_batches", "select doc_id as digest, greatest((octet_length(encode(text)) + 99) // 100, 0)::bigint as objects, sha256(text) as payload from documents where octet_length(encode(text)) > 0")
def _(spark, d):
    docs = M.table(spark, d, "documents").select(F.col("doc_id").alias("digest"), F.col("text").cast("binary").alias("content"))
    cuts = pages.split_extents(docs.select("digest", F.octet_length("content").cast("long").alias("bytes")), 100).join(docs, "digest")
    part = F.substring("content", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    objects = cuts.select("digest", "idx", part.alias("content"), F.sha2(part, 256).alias("chunk"))
    back = S.restore(objects.select("digest", "idx", "chunk"), objects.select("chunk", "content").distinct())
    return back.where("ok").select("digest", F.col("chunks").alias("objects"), F.sha2("payload", 256).alias("payload"))


@query("S12_every_root_kind", f'with {STAGES}, a as (select root, layer, 0 as stage, 0::bigint as "start", 10 + root % 50 as "end" from (select distinct root, layer from st) union all select * from st where root % 2 = 0), x as (select *, least("end", coalesce(min("start") over (partition by root, layer order by stage rows between 1 following and unbounded following), "end")) as live from a), p as (select root, layer, stage, unnest(range("start", live)) as page from x where live > "start") select root, layer, page, stage * 1000 + page as payload from p')
def _(spark, d):
    stages = _stages(spark, d)
    base = stages.select("root", "layer").distinct().select("root", "layer", F.lit(0).alias("stage"), F.lit(0).cast("long").alias("start"), (10 + F.col("root") % 50).alias("end"))
    every = base.unionByName(stages.where("root % 2 = 0"))  # odd roots are snapshots, even ones deltas over theirs
    pieces = deal(every, parts(every), "root", "layer", "stage").select("root", "layer", "stage", F.explode(F.sequence("start", F.col("end") - 1)).alias("page")).withColumn("payload", F.col("stage") * 1000 + F.col("page"))
    return S.materialise(deal(structures.overlay(every), parts(every), "root", "layer", "stage"), pieces)


@query("S21_inspections", "select c_custkey, case when c_custkey % 3 <> 2 then c_name end as name from customer")
def _(spark, d):
    one = F.struct(F.col("c_name").alias("Name"))
    k = F.col("c_custkey") % 3
    document = F.when(k == 0, F.to_json(one)).when(k == 1, F.to_json(F.array(one))).otherwise(F.to_json(F.array(one, one)))
    return M.table(spark, d, "customer").select("c_custkey", F.get_json_object(V.single_inspection(F.concat(F.when(k == 0, F.lit("\ufeff")).otherwise(F.lit("")), document)), "$.Name").alias("name"))


@query("S02_inventory", "with f as (select o_orderkey as k, 'store/' || case o_orderkey % 6 when 0 then 'roots/k1/a.json' when 1 then 'aliases/k1/a.json' when 2 then 'segments/a.json' when 3 then 'chunks/a.chunk' when 4 then 'chunks/a.chunk.tmp' else 'other/x' end as path, 100 + o_orderkey % 13 as bytes from orders) select case k % 6 when 0 then 'root' when 1 then 'alias' when 2 then 'segment' when 3 then 'chunk' else 'debris' end as kind, count(*) as files, sum(bytes)::bigint as bytes from f group by 1")
def _(spark, d):
    k = F.col("o_orderkey")
    path = F.element_at(F.array(*map(F.lit, ("roots/k1/a.json", "aliases/k1/a.json", "segments/a.json", "chunks/a.chunk", "chunks/a.chunk.tmp", "other/x"))), (k % 6 + 1).cast("int"))
    return C.inventory_totals(M.table(spark, d, "orders").select(F.concat(F.lit("store/"), path).alias("path"), (100 + k % 13).alias("bytes")))


@query("A04_reduced_ranks", "with r as (select user_id % 16 as rank, count(*) as hits, sum(event_id % 5)::bigint as misses, max(floor(value)::bigint) as oldest, count(*) > 3 as enabled, count(*) filter (event_type = 'error' and event_id % 7 = 0) as failures, sum(event_id * 100000)::bigint as stored from events group by 1) select count(*) as ranks, sum(hits)::bigint as hits, sum(misses)::bigint as misses, max(oldest) as most_oldest, bool_and(enabled) as all_enabled, nullif(count(*) filter (failures > 0), 0) as ranks_failures, round_even(sum(stored) / 1073741824.0::double, 1) as stored_gib from r")
def _(spark, d):
    stats = M.table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("rank")).agg(F.count("*").alias("hits"), F.sum(F.col("event_id") % 5).alias("misses"), F.max(F.floor("value")).alias("oldest"), (F.count("*") > 3).alias("enabled"), F.count_if((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)).alias("failures"), F.sum(F.col("event_id") * 100_000).alias("stored"))
    return ledger.reduce_ranks(stats, ["hits", "misses"], ["oldest"], ["enabled"], ["failures"], ["stored"])
