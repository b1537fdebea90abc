"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import eviction, gates, ledger, pages, quorum, structures, timeseries
from ..session import cut, deal, parts
from ..sources import model as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "L01_longest_quorum_prefix"


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a function; ``tables`` are the model tables that its SQL uses."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = M.with_model(sql, *tables) if tables else sql.strip()
        return f

    return put


#: Time of the maintenance queries, and their limits: fixed inputs.
NOW_NS = 996_600_000 * 10**9
YEAR_NS = 365 * 86400 * 10**9


# prefixes and quorum

PREFIXES = """
t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
b as (select doc_id, text, unnest(range(256, (greatest(n - 1, 0) // 256) * 256 + 1, 256)) as span from t),
p as (select doc_id as request, span, sha256(unhex('7300' || array_to_string(list_transform(string_split(text[1:span], ''), lambda c: printf('%02x%02x%02x00', ascii(c) & 255, (ascii(c) >> 8) & 255, (ascii(c) >> 16) & 255)), ''))::blob) as digest from b)
"""


def _prefixes(spark, d):
    return quorum.prefix_digests(M.table(spark, d, "documents").select(F.col("doc_id").alias("request"), "text"), 256)


@query("H02_prefix_digests", f"with {PREFIXES} select request, span, digest from p")
def _(spark, d):
    return _prefixes(spark, d)


def _held_prefixes(prefixes):
    return prefixes.select("digest", F.pmod("request", F.lit(2)).cast("int").alias("rank"))


@query(
    "L01_longest_quorum_prefix",
    f"""with {PREFIXES}, q as (select digest from p group by digest having count(distinct request % 2) = 2)
    select request, max(span) as span, max_by(digest, span) as digest from p where digest in (select digest from q) group by request""",
)
def _(spark, d):
    prefixes = cut(_prefixes(spark, d))  # candidates and holdings are the same digests
    return quorum.longest_prefix(prefixes, _held_prefixes(prefixes), 2)


@query(
    "J17_publication_base",
    f"""with {PREFIXES}, q as (select digest from p group by digest having count(distinct request % 2) = 2), m as (select request, max(span) as s from p group by request)
    select request, max(span) as span, max_by(digest, span) as digest from p join m using (request) where span < s and digest in (select digest from q) group by request""",
)
def _(spark, d):
    prefixes = cut(_prefixes(spark, d))
    spans = prefixes.groupBy("request").agg(F.max("span").alias("publish_span"))
    return quorum.publication_base(prefixes, _held_prefixes(prefixes), 2, spans)


@query("A01_full_quorum", "select digest from held where rank between 0 and 3 group by digest having count(distinct rank) = 4", "held")
def _(spark, d):
    return quorum.full_quorum(M.held(spark, d), 4)


@query("J01_candidates_in_quorum", "select storage_key as request, digest, digest % 1000 as span from roots where digest in (select digest from held group by digest having count(distinct rank) = 4)", "roots", "held")
def _(spark, d):
    candidates = M.roots(spark, d).select(F.col("storage_key").alias("request"), "digest", (F.col("digest") % 1000).alias("span"))
    return quorum.candidates_in_quorum(candidates, M.held(spark, d), 4).select("request", "digest", "span")


OLD_NEW = "with o as (select distinct rank, digest from held where digest % 5 <> 0), n as (select distinct rank, digest from held where digest % 3 <> 0)"


def _reports(spark, d):
    held = M.held(spark, d)
    return held.where("digest % 5 <> 0"), held.where("digest % 3 <> 0")


@query("E01_held_delta", f"{OLD_NEW} select rank, digest, 'added' as change from (select * from n except select * from o) union all select rank, digest, 'removed' from (select * from o except select * from n)", "held")
def _(spark, d):
    return quorum.held_delta(*_reports(spark, d))


@query("E02_apply_delta", "select distinct rank, digest from held where digest % 3 <> 0", "held")
def _(spark, d):
    old, new = _reports(spark, d)
    return quorum.apply_delta(old, quorum.held_delta(old, new))


@query("E04_survivors_in_held", "select digest from roots where valid intersect select digest from held", "roots", "held")
def _(spark, d):
    return M.roots(spark, d).where("valid").select("digest").intersect(M.held(spark, d).select("digest"))


@query("J13_last_report", "select user_id % 8 as rank, max_by(event_type, event_id) as kind, max(event_id) as sequence from events group by 1")
def _(spark, d):
    reports = M.table(spark, d, "events").select((F.col("user_id") % 8).alias("rank"), F.col("event_type").alias("kind"), F.col("event_id").alias("sequence"))
    return quorum.last_report(reports, "sequence")


@query("S19_startup_batches", "select rank, digest, (n - 1) // 64 as page from (select *, row_number() over (partition by rank order by digest) as n from (select distinct rank, digest from held)) where n <= 512", "held")
def _(spark, d):
    return quorum.startup_batches(M.held(spark, d))


ROLES = "r as (select event_id as request, user_id as digest, case when n = 1 then 'leader' when n <= 17 then 'follower' else 'overflow' end as role from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events))"


def _roles(spark, d):
    return quorum.flights(M.table(spark, d, "events").select(F.col("event_id").alias("request"), F.col("user_id").alias("digest"), F.col("ts").alias("arrival")))


@query("W06_flight_roles", f"with {ROLES} select request, digest, role from r")
def _(spark, d):
    return _roles(spark, d)


@query("A16_flight_summary", f"with {ROLES} select digest, count(*) filter (role <> 'overflow') as participants, count(*) filter (role <> 'follower') as physical_reads, count(*) filter (role = 'follower') as avoided_reads from r group by digest")
def _(spark, d):
    return quorum.flight_summary(_roles(spark, d))


# roots, references, objects

LIVE = "live as (select distinct digest, chunk from refs semi join (select digest from roots where valid) v using (digest))"


@query("A02_reference_counts", f"with {LIVE} select chunk, count(*) as refcount from live group by chunk", "roots", "refs")
def _(spark, d):
    return C.reference_counts(M.roots(spark, d), M.refs(spark, d))


@query("A03_store_bytes", "with s as (select manifest_bytes as b from roots union all select bytes from objects) select count(*) as files, sum(b)::bigint as logical_bytes, sum(((b + 4095) // 4096) * 4096)::bigint as allocated_bytes from s", "roots", "objects")
def _(spark, d):
    return C.store_bytes(M.roots(spark, d), M.objects(spark, d))


@query("J06_orphans", "with r as (select digest from roots where valid), o as (select * from objects union all select chunk + 1000000000, bytes from objects where chunk % 10 = 0) select chunk, bytes from o where chunk not in (select chunk from refs where digest in (select digest from r))", "roots", "refs", "objects")
def _(spark, d):
    objects = M.objects(spark, d)
    stray = objects.where("chunk % 10 = 0").select((F.col("chunk") + 1_000_000_000).alias("chunk"), "bytes")  # no root lists these
    return C.orphans(M.roots(spark, d), M.refs(spark, d), objects.union(stray))


ALIASES = "aliases as (select storage_key, digest + case when digest % 6 = 0 then 1000000000 else 0 end as digest, digest % 7 <> 0 as valid from roots where digest % 3 = 0)"


def _aliases(roots):
    return roots.where("digest % 3 = 0").select("storage_key", (F.col("digest") + F.when(F.col("digest") % 6 == 0, 1_000_000_000).otherwise(0)).alias("digest"), (F.col("digest") % 7 != 0).alias("valid"))


@query("J07_unshadowed_aliases", f"with {ALIASES} select storage_key, digest, valid from aliases anti join roots using (storage_key, digest)", "roots")
def _(spark, d):
    roots = M.roots(spark, d)
    return C.unshadowed(_aliases(roots), roots)


@query("S01_discover", f"with {ALIASES}, e as (select storage_key, valid from roots union all select storage_key, valid from aliases anti join roots using (storage_key, digest)) select storage_key, count(*) as checked, count(*) filter (valid) as offered, count(*) filter (not valid) as rejected from e group by storage_key", "roots")
def _(spark, d):
    roots = M.roots(spark, d)
    return C.discover(roots, _aliases(roots))


@query(
    "S05_lookup",
    f"""with {ALIASES}, q as (select storage_key, digest from roots where digest % 4 = 0 union select storage_key, digest + 1000000000 from roots where digest % 8 = 0 union select storage_key, digest from aliases)
    select q.storage_key, q.digest, coalesce(r.valid, a.valid, false) as is_hit, case when coalesce(r.valid, a.valid) is null then 'absent' when coalesce(r.valid, a.valid) then 'hit' else 'corrupt' end as reason,
    case when r.valid is not null then 'exact' when a.valid is not null then 'alias' else 'none' end as root_kind from q left join roots r using (storage_key, digest) left join aliases a using (storage_key, digest)""",
    "roots",
)
def _(spark, d):
    roots = M.roots(spark, d)
    aliases = _aliases(roots)
    asked = roots.where("digest % 4 = 0").select("storage_key", "digest").union(roots.where("digest % 8 = 0").select("storage_key", F.col("digest") + 1_000_000_000)).union(aliases.select("storage_key", "digest")).distinct()
    return C.lookup(asked, roots, aliases)


@query("J05_survivors", f"with {LIVE}, o as (select * from objects where chunk % 100 <> 3) select storage_key, digest from roots where valid and digest not in (select digest from live anti join o using (chunk))", "roots", "refs", "objects")
def _(spark, d):
    return C.survivors(M.roots(spark, d), M.refs(spark, d), M.objects(spark, d).where("chunk % 100 <> 3"))


@query("J08_evictable", "select storage_key, digest from roots where not (valid and protected)", "roots")
def _(spark, d):
    return C.evictable(M.roots(spark, d)).select("storage_key", "digest")


@query("K11_touch", f"select storage_key, digest, case when {NOW_NS} - mtime_ns >= 60000000000 then {NOW_NS} else mtime_ns end as mtime_ns, {NOW_NS} - mtime_ns >= 60000000000 as touched from roots", "roots")
def _(spark, d):
    return C.touched(M.roots(spark, d), F.lit(NOW_NS))


@query("K12_invalidate", "select storage_key, digest, manifest_bytes from roots anti join (select storage_key, digest from roots where not valid) x using (storage_key, digest)", "roots")
def _(spark, d):
    roots = M.roots(spark, d)
    return C.invalidate(roots, roots.where("not valid").select("storage_key", "digest")).select("storage_key", "digest", "manifest_bytes")


@query(
    "K03_publish_batch",
    """with s as (select chunk, bytes from objects where chunk % 2 = 0), i as (select chunk, bytes + case when chunk % 10 = 0 then 1 else 0 end as bytes from objects where chunk % 3 <> 0 union select chunk, bytes + 5 from objects where chunk % 25 = 1),
    g as (select chunk, count(*) as n, min(bytes) as bytes from i group by chunk) select chunk, g.bytes, case when n > 1 then 'conflict' when s.bytes is null then 'published' when s.bytes = g.bytes then 'duplicate' else 'conflict' end as outcome from g left join s using (chunk)""",
    "objects",
)
def _(spark, d):
    objects = M.objects(spark, d)
    incoming = objects.where("chunk % 3 <> 0").select("chunk", (F.col("bytes") + F.when(F.col("chunk") % 10 == 0, 1).otherwise(0)).alias("bytes"))
    incoming = incoming.union(objects.where("chunk % 25 = 1").select("chunk", F.col("bytes") + 5)).union(incoming)
    return C.publish(objects.where("chunk % 2 = 0"), incoming)


@query("K06_alias_boundaries", "with c as (select doc_id as digest, length(text) * 40 as tokens from documents), k as (select digest, unnest(range(greatest((tokens - 1) // 4096 - 63, 1), (tokens - 1) // 4096 + 1)) as k from c) select digest, k * 4096 as boundary, k * 16 as chunk_count from k")
def _(spark, d):
    return C.alias_boundaries(M.table(spark, d, "documents").select(F.col("doc_id").alias("digest"), (F.length("text").cast("long") * 40).alias("tokens")))


INDEXED = "ix as (select l_orderkey as digest, l_partkey as chunk, row_number() over (partition by l_orderkey order by l_partkey) - 1 as idx from (select distinct l_orderkey, l_partkey from lineitem))"


def _indexed(spark, d):
    order = Window.partitionBy("digest").orderBy("chunk")
    refs = M.refs(spark, d)
    return deal(refs, parts(refs), "digest").distinct().withColumn("idx", F.row_number().over(order) - 1)


@query("W10_extent_offsets", f"with {INDEXED} select digest, idx, (sum(bytes) over w - bytes)::bigint as encoded_start, (sum(bytes) over w)::bigint as encoded_end from ix join objects using (chunk) window w as (partition by digest order by idx)", "objects")
def _(spark, d):
    return C.extent_offsets(_indexed(spark, d).join(M.objects(spark, d), "chunk")).select("digest", "idx", "encoded_start", "encoded_end")


SPANS = f"{INDEXED}, sp as (select digest, idx, idx * 256 + case when digest % 9 = 0 and idx = 2 then 1 else 0 end as \"start\", (idx + 1) * 256 as \"end\" from ix)"


@query("W01_contiguity", f"with {SPANS}, c as (select *, lag(\"end\", 1, 0) over (partition by digest order by idx) = \"start\" and \"end\" > \"start\" as ok from sp) select digest, bool_and(ok) as contiguous, max(\"end\") as tokens, count(*) as chunks from c group by digest")
def _(spark, d):
    gap = F.when((F.col("digest") % 9 == 0) & (F.col("idx") == 2), 1).otherwise(0)
    spans = _indexed(spark, d).select("digest", "idx", (F.col("idx").cast("long") * 256 + gap).alias("start"), ((F.col("idx").cast("long") + 1) * 256).alias("end"))
    return C.contiguous(spans)


# eviction


def _limits(spark, d):
    total = C.store_bytes(M.roots(spark, d), M.objects(spark, d)).first().logical_bytes
    return {"now_ns": NOW_NS, "ttl_ns": 6 * YEAR_NS, "max_bytes": total * 9 // 10, "low_bytes": total * 6 // 10}


EVICT = f"""{LIVE},
t as (select (select sum(manifest_bytes) from roots) + (select sum(bytes) from objects) as total),
ph as (select *, case when not valid or {NOW_NS} - mtime_ns >= {6 * YEAR_NS} then 0 else 1 end as phase from roots where not (valid and protected)),
od as (select *, row_number() over (order by phase, mtime_ns, digest) as ord from ph),
fr as (select chunk, max(ord) as ord from live left join od using (digest) group by chunk having not bool_or(ord is null)),
cb as (select ord, sum(bytes) as cb from fr join objects using (chunk) group by ord),
fd as (select ord, digest, phase, (manifest_bytes + coalesce(cb, 0))::bigint as freed from od left join cb using (ord)),
orp as (select coalesce(sum(bytes), 0) as ob, count(*) as n_orphans from objects where chunk not in (select chunk from live)),
bf as (select *, (total - ob - (sum(freed) over (order by ord) - freed))::bigint as before from fd, t, orp),
ev as (select ord, digest, phase, freed, before, phase = 0 or (total > (total * 9)::bigint // 10 and before > (total * 6)::bigint // 10) as evicted, n_orphans from bf)"""


@query("W03_evict_to_watermark", f"with {EVICT} select ord, digest, phase, freed, before, evicted from ev", "roots", "refs", "objects")
def _(spark, d):
    return eviction.maintain(M.roots(spark, d), M.refs(spark, d), M.objects(spark, d), **_limits(spark, d))


@query("L05_evict_with_budget", f"with {EVICT} select digest from ev where evicted and n_orphans = 0 and ord <= 100", "roots", "refs", "objects")
def _(spark, d):
    return eviction.maintain(M.roots(spark, d), M.refs(spark, d), M.objects(spark, d), **_limits(spark, d), budget=100).where("evicted").select("digest")


@query("A15_maintenance_report", f"with {EVICT} select count(*) as candidates, count(*) filter (evicted) as removed, count(*) filter (evicted and phase = 0) as removed_first, coalesce(sum(freed) filter (evicted), 0)::bigint as freed_bytes from ev", "roots", "refs", "objects")
def _(spark, d):
    return eviction.report(eviction.maintain(M.roots(spark, d), M.refs(spark, d), M.objects(spark, d), **_limits(spark, d)))


@query("A15_maintenance_totals", f"with {EVICT}, q as (select total, ob, (select count(*) from objects where chunk not in (select chunk from live)) as orphan_chunks, (select coalesce(sum(freed) filter (evicted), 0) from ev) as f, (select count(*) from roots where valid and digest not in (select digest from ev where evicted)) as surviving from t, orp) select total::bigint as bytes_before, (f + ob)::bigint as bytes_reclaimed, (total - f - ob)::bigint as bytes_after, orphan_chunks, total - f - ob <= (total * 9)::bigint // 10 as satisfied, surviving from q", "roots", "refs", "objects")
def _(spark, d):
    limits = _limits(spark, d)
    roots, refs, objects = M.roots(spark, d), M.refs(spark, d), M.objects(spark, d)
    return eviction.totals(cut(eviction.maintain(roots, refs, objects, **limits)), roots, refs, objects, limits["max_bytes"])


@query("P09_expired", f"select storage_key, digest from roots where {NOW_NS} - mtime_ns >= {5 * YEAR_NS}", "roots")
def _(spark, d):
    roots = M.roots(spark, d)
    return roots.where(C.expired(roots, NOW_NS, 5 * YEAR_NS)).select("storage_key", "digest")


# byte accounting


@query(
    "A07_shared_bytes",
    f"""with {LIVE}, c as (select chunk, count(*) as n from live group by chunk) select digest, count(*) as chunks, count(*) filter (n > 1) as shared_chunks, coalesce(sum(bytes) filter (n > 1), 0)::bigint as shared_bytes,
    (coalesce(sum(bytes) filter (n = 1), 0) + any_value(manifest_bytes))::bigint as marginal_bytes, (sum(bytes) + any_value(manifest_bytes))::bigint as encoded_bytes from live join c using (chunk) join objects using (chunk) join roots using (digest) group by digest""",
    "roots", "refs", "objects",
)
def _(spark, d):
    return ledger.shared_bytes(M.roots(spark, d), M.refs(spark, d), M.objects(spark, d))


ATTEMPTS = "att as (select doc_id, case doc_id % 7 when 0 then 'aborted' when 1 then 'conflict' else 'committed' end as outcome, octet_length(encode(text)) as payload_bytes, case when row_number() over (partition by text order by doc_id) = 1 then octet_length(encode(text)) else 0 end as unique_bytes from documents)"
RECEIPTS = f"{ATTEMPTS}, rc as (select *, payload_bytes + 512 as staged_bytes, case when outcome = 'committed' then payload_bytes else 0 end as logical_bytes, case when outcome = 'committed' then greatest(payload_bytes - unique_bytes, 0) else 0 end as reused_bytes from att)"


def _receipts(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("payload_bytes"), F.sha2("text", 256).alias("sha"))
    first = F.row_number().over(Window.partitionBy("sha").orderBy("doc_id")) == 1
    outcome = F.when(F.col("doc_id") % 7 == 0, "aborted").when(F.col("doc_id") % 7 == 1, "conflict").otherwise("committed")
    attempts = docs.select("doc_id", outcome.alias("outcome"), "payload_bytes", F.when(first, F.col("payload_bytes")).otherwise(0).alias("unique_bytes"), (F.col("payload_bytes") + 512).alias("staged_bytes"))
    return ledger.receipt(attempts)


@query("A06_receipts", f"with {RECEIPTS} select doc_id, outcome, payload_bytes, unique_bytes, staged_bytes, logical_bytes, reused_bytes from rc")
def _(spark, d):
    return _receipts(spark, d)


@query("A05_receipt_totals", f"with {RECEIPTS} select outcome, count(*) as attempts, sum(logical_bytes)::bigint as logical_bytes, sum(reused_bytes)::bigint as reused_bytes, sum(unique_bytes)::bigint as unique_bytes, sum(staged_bytes)::bigint as staged_bytes from rc group by outcome")
def _(spark, d):
    return ledger.receipt_totals(_receipts(spark, d))


@query("A13_write_amplification", 'with s as (select key, sum(staged)::bigint as staged, sum("unique")::bigint as "unique" from writes group by key) select key, staged, "unique", case when "unique" = 0 then null else staged * 1000 // "unique" end as staged_per_unique, case when staged = 0 then null else "unique" * 1000 // staged end as unique_per_staged from s', "writes")
def _(spark, d):
    return ledger.write_amplification(M.writes(spark, d).groupBy("key").agg(F.sum("staged").alias("staged"), F.sum("unique").alias("unique")))


@query("A04_rank_statistics", "with r as (select user_id % 8 as rank, count(*) as entries, (sum(floor(value * 100)))::bigint as bytes, count(*) > 10 as healthy, count(*) filter (event_type = 'error') as alerts from events group by 1) select count(*) as ranks, sum(entries)::bigint as entries, max(bytes) as most_bytes, bool_and(healthy) as healthy, nullif(sum(alerts), 0)::bigint as alerts from r")
def _(spark, d):
    stats = M.table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("rank")).agg(F.count("*").alias("entries"), F.sum(F.floor(F.col("value") * 100)).cast("long").alias("bytes"), (F.count("*") > 10).alias("healthy"), F.count_if(F.col("event_type") == "error").alias("alerts"))
    return ledger.rank_statistics(stats)


@query("A09_recomputation_avoided", "select doc_id, (n_chars // 256) * 256 as avoided from documents")
def _(spark, d):
    docs = M.table(spark, d, "documents")
    return docs.select("doc_id", ledger.recomputation_avoided(F.col("n_chars"), F.col("n_chars") % 256).alias("avoided"))


# time series

WINDOWS = 'select {w} * (at_ns // {w}) as window_ns, count(*) as events, sum("unique")::bigint as unique_bytes, sum(staged)::bigint as staged_bytes, {e} as exceeded, {o} as over_bytes from writes group by 1'


@query("R09_hourly_writes", WINDOWS.format(w=3_600_000_000_000, e="sum(staged) > 20000", o="greatest(sum(staged) - 20000, 0)::bigint"), "writes")
def _(spark, d):
    return timeseries.write_windows(M.writes(spark, d), limit=20_000)


@query("R09_daily_writes", WINDOWS.format(w=86_400_000_000_000, e="null::boolean", o="null::bigint"), "writes")
def _(spark, d):
    return timeseries.write_windows(M.writes(spark, d), 24 * timeseries.HOUR_NS)


@query("P16_invalid_writes", "with w as (select event_id, kind not in ('click', 'view', 'purchase') as bad from writes) select event_id, 'kind' as reasons from w where bad", "writes")
def _(spark, d):
    return timeseries.invalid_writes(M.writes(spark, d), ["click", "view", "purchase"])


@query(
    "W09_counter_deltas",
    """with s as (select user_id as device, event_id as sample_id, epoch_us(ts) * 1000 as at_ns, event_id // 3 + case when event_id % 50 = 0 then 100 else 0 end as units from events), x as (select *, units - lag(units) over w as du, at_ns - lag(at_ns) over w as dt from s window w as (partition by device order by at_ns, sample_id))
    select device, sample_id, case when r = 'ok' then du * 512000 end as bytes, case when r = 'ok' and dt // 1000000 <> 0 then du * 512000 * 1000 // (dt // 1000000) end as bytes_a_second, r as reason from (select *, case when du < 0 then 'decreasing' when dt = 0 and du <> 0 then 'same_time' else 'ok' end as r from x where du is not null)""",
)
def _(spark, d):
    units = F.floor(F.col("event_id") / 3) + F.when(F.col("event_id") % 50 == 0, 100).otherwise(0)
    return timeseries.counter_deltas(M.table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("sample_id"), M.nanos("ts").alias("at_ns"), units.alias("units")))


@query("A10_latency_summary", "with e as (select event_type as arm, value as elapsed, event_id % 10 <> 0 as ok from events) select arm, count(*) as requests, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed, min(elapsed) filter (ok) as min, quantile_disc(elapsed, 0.5) filter (ok) as p50, quantile_disc(elapsed, 0.95) filter (ok) as p95, max(elapsed) filter (ok) as max from e group by arm")
def _(spark, d):
    return timeseries.latency_summary(M.table(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("value").alias("elapsed"), (F.col("event_id") % 10 != 0).alias("ok")), "arm")


@query("W08_stage_timings", "with f as (select user_id as request, event_id % 14 as stage, min(epoch_us(ts) * 1000) as at_ns from events group by 1, 2) select request, stage, max(at_ns) over w - first_value(at_ns) over w as since_first_ns from f window w as (partition by request order by stage)")
def _(spark, d):
    return timeseries.stage_timings(M.table(spark, d, "events").select(F.col("user_id").alias("request"), (F.col("event_id") % 14).alias("stage"), M.nanos("ts").alias("at_ns")))


def _trace(spark, d):
    # event_id counts the trace from 0 without gaps
    return M.table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("n"))


@query(
    "R06_heat",
    """with recursive e as (select user_id as key, event_id // 512 as epoch, count(*) as hits from events group by 1, 2), l as (select (max(event_id) + 1) // 512 as now from events), k as (select distinct key from e),
    f as (select key, 0::bigint as epoch, least(255, coalesce((select hits from e where e.key = k.key and e.epoch = 0), 0))::bigint as c from k union all select f.key, f.epoch + 1, least(255, f.c // 2 + coalesce(e.hits, 0))::bigint from f left join e on e.key = f.key and e.epoch = f.epoch + 1, l where f.epoch < l.now) select key, c as heat from f, l where epoch = now""",
)
def _(spark, d):
    return timeseries.heat(_trace(spark, d), window=512)


# structures


@query("K10_chain_segments", f"with {INDEXED} select digest, digest || '/' || idx // 2 as segment, case when idx // 2 > 0 then digest || '/' || (idx // 2 - 1) end as parent, (idx // 2 * 2)::int as first_index, array_to_string(list(chunk order by idx), ',') as chunks from ix group by digest, idx // 2")
def _(spark, d):
    return structures.chain_segments(_indexed(spark, d), 2).withColumn("chunks", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ","))


@query("J04_walk_chains", f"with {INDEXED}, t as (select digest, max(idx // 2) as top from ix group by digest) select digest as root, digest || '/' || (top - s) as segment, s::int as steps from (select *, unnest(range(top + 1)) as s from t)")
def _(spark, d):
    segments = structures.chain_segments(_indexed(spark, d), 2)
    tails = segments.groupBy("digest").agg(F.max_by("segment", "first_index").alias("segment")).select(F.col("digest").alias("root"), "segment")
    return structures.walk_chains(segments, tails)


BASE_TAIL = f"""{INDEXED}, n as (select digest, count(*) as n from ix group by digest), al as (select digest, idx, chunk, idx * 256 as "start", least((idx + 1) * 256, n * 256 - digest % 3 * 50) as "end", n from ix join n using (digest)),
base as (select digest, "start", "end", chunk, 'base' as part from al), tail as (select digest, "start" + (n - 1) * 256 as "start", "end" + (n - 1) * 256 + digest % 5 as "end", chunk + 1000000 as chunk, 'tail' as part from al where digest % 7 <> 0),
bt as (select digest, max("end") as b, max("end") // 256 * 256 as whole from base group by digest), lg as (select digest from tail join bt using (digest) group by digest having max("end") > max(b))"""


@query("K07_extend", f'with {BASE_TAIL} select digest, "start", "end", chunk, part from (select base.* from base join bt using (digest) where "end" <= whole union all select tail.* from tail join bt using (digest) where "start" >= whole) where digest in (select digest from lg)')
def _(spark, d):
    n = F.count("*").over(Window.partitionBy("digest"))
    idx = F.col("idx").cast("long")
    rows = _indexed(spark, d).withColumn("n", n).select("digest", "chunk", "n", (idx * 256).alias("start"), F.least((idx + 1) * 256, F.col("n") * 256 - F.col("digest") % 3 * 50).alias("end"))
    # every seventh root has no extension
    tail = rows.where("digest % 7 <> 0").select("digest", (F.col("start") + (F.col("n") - 1) * 256).alias("start"), (F.col("end") + (F.col("n") - 1) * 256 + F.col("digest") % 5).alias("end"), (F.col("chunk") + 1_000_000).alias("chunk"))
    return structures.extend(rows.drop("n"), tail, 256)


STAGES = "st as (select l_orderkey as root, l_suppkey % 3 as layer, row_number() over (partition by l_orderkey, l_suppkey % 3 order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_shipdate) as stage, (l_partkey % 40)::bigint as \"start\", (l_partkey % 40 + l_quantity)::bigint as \"end\" from lineitem)"


def _stages(spark, d):
    by = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("root"), (F.col("l_suppkey") % 3).alias("layer"), "l_quantity", *by)
    lines = deal(lines, parts(lines), "root", "layer").withColumn("stage", F.row_number().over(Window.partitionBy("root", "layer").orderBy(*by)))
    return lines.select("root", "layer", "stage", (F.col("l_partkey") % 40).alias("start"), (F.col("l_partkey") % 40 + F.col("l_quantity")).cast("long").alias("end"))


@query("W04_overlay", f'with {STAGES}, x as (select *, least("end", coalesce(min("start") over (partition by root, layer order by stage rows between 1 following and unbounded following), "end")) as live_end from st) select root, layer, stage, "start", live_end from x where live_end > "start"')
def _(spark, d):
    return structures.overlay(_stages(spark, d))


PAGES = "g as (select doc_id as root, lang as grp, source as layer, unnest(range(greatest(n_chars // 500, 1))) as page, text from documents), bs as (select root, grp, layer, page, md5(text[page * 500 + 1:page * 500 + 500]) as payload from g), nw as (select root, grp, layer, page, case when page >= 2 + root % 3 then md5(payload) else payload end as payload from bs)"


def _pages(spark, d):
    docs = M.table(spark, d, "documents").select(F.col("doc_id").alias("root"), F.col("lang").alias("grp"), F.col("source").alias("layer"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(F.col("n_chars") / 500), F.lit(1).cast("long")) - 1)).alias("page"))
    base = docs.select("root", "grp", "layer", "page", F.md5(F.substring("text", F.col("page").cast("int") * 500 + 1, F.lit(500)).cast("binary")).alias("payload"))
    return base, base.withColumn("payload", F.when(F.col("page") >= 2 + F.col("root") % 3, F.md5(F.col("payload").cast("binary"))).otherwise(F.col("payload")))


@query("T04_reusable_pages", f"with {PAGES} select root, grp, coalesce(min(b.page) filter (b.payload is distinct from n.payload), max(b.page) + 1) as reused from bs b join nw n using (root, grp, layer, page) group by root, grp")
def _(spark, d):
    return structures.reusable_pages(*_pages(spark, d))


@query("T06_apply_delta", f"with {PAGES} select root, grp, layer, page, payload from nw")
def _(spark, d):
    base, new = _pages(spark, d)
    reused = structures.reusable_pages(base, new)
    return structures.apply_delta(base, new, reused).select("root", "grp", "layer", "page", "payload")


@query("T11_first_mismatch", f"with {PAGES}, a as (select grp as kind, root * 1000 + page as pos, payload as value from bs), b as (select grp as kind, root * 1000 + page as pos, payload as value from nw) select kind, min(pos) filter (a.value is distinct from b.value) as first_mismatch, count(*) as compared from a full join b using (kind, pos) group by kind")
def _(spark, d):
    streams = [x.select(F.col("grp").alias("kind"), (F.col("root") * 1000 + F.col("page")).alias("pos"), F.col("payload").alias("value")) for x in _pages(spark, d)]
    return structures.first_mismatch(*streams)


EXTENTS = f"{INDEXED}, ex as (select digest, idx, (sum(bytes) over w - bytes)::bigint as s, (sum(bytes) over w)::bigint as e from ix join objects using (chunk) window w as (partition by digest order by idx)), rq as (select o_orderkey as request, o_orderkey as digest, o_orderkey % 7 * 5000 as lo, o_orderkey % 7 * 5000 + 20000 as hi from orders)"


@query("S11_read_ranges", f'with {EXTENTS} select request, digest, idx, greatest(lo, s) - s as "offset", least(hi, e) - greatest(lo, s) as length from rq join ex using (digest) where s < hi and e > lo', "objects")
def _(spark, d):
    extents = C.extent_offsets(_indexed(spark, d).join(M.objects(spark, d), "chunk"))
    lo = F.col("o_orderkey") % 7 * 5000
    requests = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("digest"), lo.alias("lo"), (lo + 20_000).alias("hi"))
    return structures.read_ranges(extents, requests)


# pages and shards


@query("P01_owned_positions", "with s as (select o_orderkey as request, o_orderkey % 4 as rank, o_orderkey % 23 as span from orders) select request, len(range(rank, span, 4)) as owned, coalesce(list_sum(range(rank, span, 4)), 0)::bigint as total from s")
def _(spark, d):
    orders = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), pages.owned_positions(F.col("o_orderkey") % 23, 4, F.col("o_orderkey") % 4).alias("p"))
    return orders.select("request", F.size("p").cast("long").alias("owned"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("P02_slots", "with s as (select o_orderkey as request, unnest(range(o_orderkey % 2, o_orderkey % 23, 2)) as p from orders) select request, p, (3 + request % 5 + p // 2 // 4 * 2) * 4 + p // 2 % 4 as slot from s")
def _(spark, d):
    key = F.col("o_orderkey")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (3 + key % 5 + i * 2).cast("long"))
    p = pages.owned_positions(key % 23, 2, key % 2)
    return M.table(spark, d, "orders").select(key.alias("request"), F.explode(F.arrays_zip(p.alias("p"), pages.slots(p, blocks, 4, 2).alias("slot"))).alias("x")).select("request", "x.p", "x.slot")


@query("P03_aligned_span", "select doc_id, case when n_chars > 0 then (n_chars - 1) // 192 * 192 else 0 end as span from documents")
def _(spark, d):
    return M.table(spark, d, "documents").select("doc_id", pages.aligned_span(F.col("n_chars"), [64, 48, 32]).alias("span"))


@query("P04_layer_kinds", "select p_partkey, case when contains(lower(p_type), 'steel') then 'target' when contains(lower(p_type), 'brass') then 'draft' when contains(lower(p_type), 'e') then 'index' else 'other' end as kind from part")
def _(spark, d):
    return M.table(spark, d, "part").select("p_partkey", pages.layer_kind(F.col("p_type"), [("steel", "target"), ("brass", "draft"), ("e", "index")], "other").alias("kind"))


@query("P05_missing_kinds", "with k as (select l_orderkey as layout, 'k' || l_suppkey % 5 as kind from lineitem), w as (select distinct layout, unnest(['k0', 'k1', 'k2', 'k3']) as kind from k) select layout, coalesce(string_agg(w.kind, ',' order by w.kind) filter (k.kind is null), '') as missing from w left join (select distinct * from k) k using (layout, kind) group by layout")
def _(spark, d):
    layers = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("layout"), F.concat(F.lit("k"), F.col("l_suppkey") % 5).alias("kind"))
    return pages.missing_kinds(layers, ["k0", "k1", "k2", "k3"])


@query("P06_page_windows", "with s as (select doc_id, n_chars as span, case doc_id % 3 when 0 then 'full' when 1 then 'sliding' else 'recurrent' end as policy from documents), f as (select *, (span + 255) // 256 as n, case policy when 'sliding' then greatest((span - 1024) // 256, 0) when 'recurrent' then greatest((span + 255) // 256 - 1, 0) else 0 end as first from s) select doc_id, first, n - first as count from f")
def _(spark, d):
    policy = F.when(F.col("doc_id") % 3 == 0, "full").when(F.col("doc_id") % 3 == 1, "sliding").otherwise("recurrent")
    return M.table(spark, d, "documents").select("doc_id", pages.page_window(F.col("n_chars"), policy, F.lit(256), F.lit(1024)).alias("w")).select("doc_id", "w.first", "w.count")


@query("P08_extension_pages", "with c as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn, role, text rows unbounded preceding) as span, length(text) as n from conversations) select conv_id, turn, span::bigint as span, ((span - n) // 64)::bigint as first, ((span + 63) // 64 - (span - n) // 64)::bigint as count from c")
def _(spark, d):
    over = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = M.table(spark, d, "conversations").withColumn("n", F.length("text")).withColumn("span", F.sum("n").over(over))
    return turns.select("conv_id", "turn", "span", pages.extension_pages(F.col("span") - F.col("n"), F.col("span"), F.lit(64)).alias("w")).select("conv_id", "turn", "span", "w.first", "w.count")


@query("T01_snapshot_size", "select l_orderkey as layout, sum((l_partkey % 9) * (1 + l_suppkey % 4) * 4096)::bigint as encoded_bytes, count(*) as layers from lineitem group by l_orderkey")
def _(spark, d):
    return pages.snapshot_size(M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("layout"), (F.col("l_partkey") % 9).alias("page_count"), ((1 + F.col("l_suppkey") % 4) * 4096).alias("bytes_per_page")))


@query("A19_aligned_offsets", f'with {INDEXED}, k as (select digest as layout, idx, chunk::varchar as kind, (p_size * 37)::bigint as bytes from ix join part on p_partkey = chunk) select layout, kind, coalesce(sum((bytes + 255) // 256 * 256) over (partition by layout order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from k')
def _(spark, d):
    kinds = _indexed(spark, d).join(M.table(spark, d, "part"), F.col("chunk") == F.col("p_partkey")).select(F.col("digest").alias("layout"), F.col("idx").alias("ordinal"), F.col("chunk").cast("string").alias("kind"), (F.col("p_size").cast("long") * 37).alias("bytes"))
    return pages.aligned_offsets(kinds)


@query("K08_split_extents", 'with s as (select doc_id as digest, octet_length(encode(text))::bigint as bytes from documents), k as (select *, unnest(range((bytes + 1023) // 1024)) as idx from s) select digest, idx, idx * 1024 as begin, least((idx + 1) * 1024, bytes) as "end" from k')
def _(spark, d):
    return pages.split_extents(M.table(spark, d, "documents").select(F.col("doc_id").alias("digest"), F.octet_length("text").cast("long").alias("bytes")), 1024)


@query("T12_chunk_spans", 'with k as (select doc_id as digest, n_chars, unnest(range((n_chars + 255) // 256)) as idx from documents) select digest, idx, idx * 256 as "start", least((idx + 1) * 256, n_chars) as "end" from k')
def _(spark, d):
    return pages.chunk_spans(M.table(spark, d, "documents").select(F.col("doc_id").alias("digest"), F.col("n_chars").alias("tokens")), 256)


# gates


@query("P20_rule_gate", "select event_id, concat_ws(',', case when value > 90 then 'slow' end, case when event_type = 'error' then 'error' end, case when user_id % 10 = 0 then 'reserved' end) as reasons from events")
def _(spark, d):
    rules = {"slow": F.col("value") > 90, "error": F.col("event_type") == "error", "reserved": F.col("user_id") % 10 == 0}
    return M.table(spark, d, "events").select("event_id", gates.reasons(rules).alias("reasons"))


@query("P14_disjoint_ranges", f'with {INDEXED}, f as (select digest as request, idx, idx * 10 + case when digest % 11 = 0 then -3 * idx else 0 end as "offset", 10 as size, 40 as tokens from ix), c as (select *, lag("offset" + size, 1, 0) over (partition by request order by idx) <= "offset" and "offset" + size <= tokens as ok from f) select request, bool_and(ok) as valid, count(*) as features from c group by request')
def _(spark, d):
    shift = F.when(F.col("digest") % 11 == 0, -3 * F.col("idx")).otherwise(0)
    features = _indexed(spark, d).select(F.col("digest").alias("request"), F.col("idx").alias("ordinal"), (F.col("idx") * 10 + shift).alias("offset"), F.lit(10).alias("size"), F.lit(40).alias("tokens"))
    return gates.disjoint_ranges(features)


@query("P15_scope_binding", "select doc_id, sha256(source || ':' || sha256(text)) as binding, regexp_matches(sha256(text), '^[0-9a-f]{64}$') as valid from documents")
def _(spark, d):
    digest = F.sha2("text", 256)
    return M.table(spark, d, "documents").select("doc_id", gates.scope_binding(F.col("source"), digest).alias("binding"), gates.valid_digest(digest).alias("valid"))


@query("A12_common_values", "select l_orderkey, count(distinct l_returnflag) = 1 and count(l_returnflag) = count(*) as l_returnflag_common, count(distinct l_linestatus) = 1 and count(l_linestatus) = count(*) as l_linestatus_common from lineitem group by l_orderkey")
def _(spark, d):
    return gates.common_values(M.table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("E08_completeness", "with s as (select user_id % 40 as k, event_type as kind, count(*) as n from events group by 1, 2), w as (select k, kind from range(45) t(k), (select distinct event_type as kind from events) x where k <> 7) select coalesce(s.k, w.k) as k, coalesce(s.kind, w.kind) as kind, case when n is null then 'missing' when w.k is null then 'extra' else 'repeated' end as state from s full join w on s.k = w.k and s.kind = w.kind where n is null or w.k is null or n > 1")
def _(spark, d):
    events = M.table(spark, d, "events").select((F.col("user_id") % 40).alias("k"), F.col("event_type").alias("kind"))
    kinds = F.collect_set("kind").alias("kinds")  # the handful of event types
    expected = events.agg(kinds).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(44).cast("long"))).alias("k"), "kinds").where("k <> 7").select("k", F.explode("kinds").alias("kind"))
    return gates.completeness(events, expected)


@query("P17_idle", "with m as (select user_id, event_type as name, sum(event_id % 3)::bigint as v from events where event_type in ('click', 'view') group by 1, 2) select user_id, case when count(*) = 2 then bool_and(v = 0) end as idle from m group by user_id")
def _(spark, d):
    metrics = M.table(spark, d, "events").select("user_id", F.col("event_type").alias("name"), (F.col("event_id") % 3).alias("value"))
    return gates.idle(metrics, ["click", "view"], "user_id")


# session state machines, replayed in order


def _events(spark, d):
    return M.table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").cast("long").alias("v"))


@query("R05_attribution")
def _(spark, d):
    from ..streaming import machines, replay

    k = F.col("seq") % 4
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    events = _events(spark, d).withColumn("seq", n.cast("long")).select(
        F.col("user_id").alias("request"), "seq", F.lit(1024).cast("long").alias("prompt_tokens"), F.floor(F.col("seq") / 4).cast("long").alias("preemptions"),
        F.when(k == 0, "admitted").when(k == 1, "restore_finalized").when(k == 2, "prompt_step_completed").otherwise("preempted").alias("event"),
        (F.col("v") % 3 * 64).alias("local_tokens"), F.lit(256).cast("long").alias("external_tokens"), (F.col("v") % 3 * 64 + 256).alias("valid_prefix_tokens"),
        F.lit(128).cast("long").alias("start_token"), F.lit(1024).cast("long").alias("end_token"), F.lit(True).alias("success"), F.lit(False).alias("stale"),
    ).withColumn("preemptions", F.when(F.col("event") == "preempted", F.col("preemptions") + 1).otherwise(F.col("preemptions")))
    return replay.replay(events, "request", machines.ATTRIBUTION)


@query("R01_snapshot_planner")
def _(spark, d):
    from ..streaming import machines, replay

    k = F.col("event_id") % 5
    what = F.when(k == 0, "begin").when(k < 3, "offer").when(k == 3, "written").otherwise("commit")
    events = _events(spark, d).select((F.col("user_id") % 16).alias("worker"), F.col("event_id").alias("seq"), what.alias("event"), F.col("user_id").alias("request"), F.concat(F.lit("d"), F.col("user_id")).alias("digest"), F.when(k == 0, 8192).otherwise(F.col("event_id") % 3 * 4096).cast("long").alias("tokens"), F.lit(0).cast("long").alias("batch"))
    return replay.replay(events, "worker", machines.PLANNER)


@query("R07_shadow_admission")
def _(spark, d):
    from ..streaming import machines, replay

    trace = _events(spark, d).select(F.lit(0).cast("long").alias("cache"), F.col("event_id").alias("seq"), F.col("user_id").alias("item"))
    return replay.replay(trace, "cache", machines.admission_machine(8, 40, 512))


@query("R10_rank_reports")
def _(spark, d):
    from ..streaming import machines, replay

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    late = F.when(n % 10 == 0, n + 1).when((n % 10 == 1) & (n > 1), n - 1).otherwise(n)
    events = _events(spark, d).select(F.col("user_id").alias("rank"), n.cast("long").alias("sequence"), late.cast("long").alias("seq"), F.lit("g").alias("generation"), F.array(F.col("v")).alias("added"), F.array(F.col("v") - 5).alias("removed"))
    return replay.replay(events, "rank", machines.REPORTS)


@query("R04_block_leases")
def _(spark, d):
    from ..streaming import machines, replay

    events = _events(spark, d).select(F.col("user_id").alias("pool"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "release").otherwise("reserve").alias("event"), F.floor(F.col("v") / 20).cast("long").alias("lease"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("v") + i).alias("blocks"))
    return replay.replay(events, "pool", machines.LEASES)


@query("H07_heat_slots")
def _(spark, d):
    from ..functions import hashing

    return M.roots(spark, d).select("storage_key", "digest", hashing.heat_slot(F.col("storage_key"), F.col("digest"), 4096).alias("slot"))


@query("H04_storage_keys", """select c_custkey, sha256('{"chunk_tokens":' || (c_custkey % 4 * 256)::varchar || ',"target":"' || c_mktsegment || '","tp_degree":' || (c_nationkey % 4)::varchar || '}') as storage_key from customer""")
def _(spark, d):
    from ..functions import hashing

    fields = F.struct((F.col("c_custkey") % 4 * 256).alias("chunk_tokens"), F.col("c_mktsegment").alias("target"), (F.col("c_nationkey") % 4).alias("tp_degree"))
    return M.table(spark, d, "customer").select("c_custkey", hashing.canonical_digest(fields).alias("storage_key"))


@query("H22_human_bytes", "with s as (select doc_id, n_chars * (1 + doc_id % 40 * 700) as b from documents) select doc_id, case when b >= 1073741824 then round_even(b / 1073741824.0::double, 1) || ' GiB' when b >= 1048576 then round_even(b / 1048576.0::double, 1) || ' MiB' when b >= 1024 then round_even(b / 1024.0::double, 1) || ' KiB' else b || ' B' end as text from s")
def _(spark, d):
    from ..functions import hashing

    docs = M.table(spark, d, "documents").select("doc_id", (F.col("n_chars") * (1 + F.col("doc_id") % 40 * 700)).alias("b"))
    return docs.select("doc_id", hashing.human_bytes(F.col("b")).alias("text"))


@query("P13_payload_integrity", "select doc_id, case doc_id % 4 when 0 then not contains(text, 'th') when 1 then not contains(text, 'an') when 2 then not contains(text, 'er') else true end as ok from documents")
def _(spark, d):
    from ..functions import hashing

    k, content = F.col("doc_id") % 4, F.col("text").cast("binary")
    changed = lambda what: F.replace("text", F.lit(what), F.lit("?")).cast("binary")
    sha = F.when(k == 0, F.sha2(changed("th"), 256)).when(k == 1, F.sha2(changed("an"), 256))
    crc = F.when(k == 2, F.crc32(changed("er")))
    return M.table(spark, d, "documents").select("doc_id", hashing.payload_matches(content, sha, crc).alias("ok"))
