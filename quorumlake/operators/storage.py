"""Reading and writing stored objects: chunk files, restores, inventories, sweeps, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import let
from ..session import deal, parts
from .ordering import in_group

MAGIC = b"QLC1"
#: Parts that a cache's items are pruned in before they meet.
PARTS = 1024


def encode_chunk(records: Column) -> Column:
    """A chunk file: magic, eight hex digits of the header's length, a JSON header, the records by name.

    ``records`` is a map from name to bytes. The header lists name, offset, size and digest in the order of names.
    """
    entries = F.sort_array(F.map_entries(records))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<name:string,offset:bigint,size:bigint,sha256:string>>").alias("h"), F.lit(b"").alias("b"))
    size = lambda x: F.octet_length(x["value"]).cast("long")
    item = lambda a, x: F.struct(x["key"].alias("name"), a["at"].alias("offset"), size(x).alias("size"), F.sha2(x["value"], 256).alias("sha256"))
    folded = F.aggregate(entries, zero, lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["h"], F.array(item(a, x))).alias("h"), F.concat(a["b"], x["value"]).alias("b")))
    whole = lambda header, body: F.concat(F.lit(MAGIC), F.lower(F.lpad(F.hex(F.octet_length(header)), 8, "0")).cast("binary"), header, body)
    return let(folded, lambda f: let(F.to_json(f["h"]).cast("binary"), lambda header: whole(header, f["b"])))


def decode_chunk(content: Column) -> Column:
    """Map from name to bytes of a chunk file; null where the magic, the header or a record's digest is wrong."""
    # each step is the variable of a lambda, so that it is read once and not again for each record
    kind = "array<struct<name:string,offset:bigint,size:bigint,sha256:string>>"

    def records(n: Column) -> Column:
        header = F.from_json(F.substring(content, F.lit(13), n).cast("string"), kind)
        cut = F.transform(header, lambda x: F.struct(x["name"].alias("name"), F.substring(content, (n + 13 + x["offset"]).cast("int"), x["size"].cast("int")).alias("value"), x["sha256"].alias("sha256")))
        return let(cut, lambda found: F.when(F.forall(found, lambda x: F.sha2(x["value"], 256) == x["sha256"]), F.map_from_entries(F.transform(found, lambda x: F.struct(x["name"], x["value"])))))

    n = F.conv(F.substring(content, 5, 8).cast("string"), 16, 10).cast("int")
    return F.when(F.substring(content, 1, 4) == F.lit(MAGIC), let(n, records))


def restore(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each root's verified payloads joined in order, or a miss if one is absent or doesn't match its digest.

    refs (digest, idx, chunk), payloads (chunk, content), where a chunk's name is its content's SHA-256.
    """
    # names go as bytes, half their size; what isn't a digest in hex is the name of no content
    n = parts(refs, payloads)
    key = F.when(F.col("chunk").rlike("^[0-9a-f]{64}$"), F.unhex("chunk")).alias("key")
    checked = payloads.select(key, F.when(F.sha2("content", 256) == F.col("chunk"), F.col("content")).alias("content"))
    found = deal(refs.select("digest", "idx", key), n, "key").join(deal(checked, n, "key"), "key", "left").select("digest", "idx", "content")
    rows = deal(found, n, "digest").groupBy("digest").agg(F.bool_and(F.col("content").isNotNull()).alias("ok"), F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("c"))
    whole = F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["content"]))
    return rows.select("digest", "ok", "chunks", F.when(F.col("ok"), whole).alias("payload"))


def sweep(held: DataFrame, restored: DataFrame, published: DataFrame) -> DataFrame:
    """What stays held after a sweep: verified entries, and what was published meanwhile."""
    good = held.select("digest").distinct().join(restored.where("ok"), "digest", "left_semi")
    return good.union(published.select("digest")).distinct()


def tree_digest(files: DataFrame, by: str) -> DataFrame:
    """Files, bytes and one digest over a tree's (path, sha256).

    Paths fall into 4,096 blocks by their own digest; a block's listing is in the order of its paths, and the tree's digest is over the blocks'. So no
    task lists a whole tree, however many files it has.
    """
    lines = lambda a, b: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda x: F.concat(x[a], F.lit(":"), x[b])), "\n").cast("binary")
    blocks = files.withColumn("block", F.substring(F.md5(F.col("path").cast("binary")), 1, 3)).groupBy(by, "block").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(lines("path", "sha256"), 256).alias("digest"))
    return blocks.groupBy(by).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(lines("block", "digest"), 256).alias("tree"))


def compare_inventories(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paths that are missing, extra or different."""
    both = found.select("path", F.col("sha256").alias("a")).join(wanted.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") != F.col("b"), "different")
    return both.withColumn("state", state).where("state is not null").select("path", "state")


def clear_once(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Purge requests whose token hasn't been carried out; a token counts once."""
    return requests.join(done, "token", "left_anti").groupBy("token").agg(F.min("seq").alias("seq"))


def shareable_flight(requests: DataFrame, flights: DataFrame) -> DataFrame:
    """For each request the flight with the longest common prefix digest (span, digest)."""
    met = requests.join(flights, ["span", "digest"]).groupBy("request")
    return met.agg(F.max("span").alias("span"), F.max_by("flight", F.struct("span", "flight")).alias("flight"))


def shareable_prefixes(prefixes: DataFrame, most: int = 64) -> DataFrame:
    """The longest ``most`` prefixes of each flight."""
    order = F.row_number().over(Window.partitionBy("flight").orderBy(F.desc("span")))
    return prefixes.withColumn("n", order).where(F.col("n") <= most).drop("n")


def recent_by_bytes(uses: DataFrame, cap: int) -> DataFrame:
    """Items of each cache that a byte-capped store keeps: the most recent whose running bytes fit; larger ones never stay."""
    last = uses.groupBy("cache", "item").agg(F.max("seq").alias("seq"), F.max_by("bytes", "seq").alias("bytes")).where(F.col("bytes") <= cap)
    running = lambda *by: F.sum("bytes").over(Window.partitionBy(*by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    # what doesn't fit among a part of the items doesn't fit among all; few are left of each part
    few = last.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))).withColumn("running", running("cache", "part")).where(F.col("running") <= cap)
    return few.withColumn("running", running("cache")).where(F.col("running") <= cap).select("cache", "item", "seq", "bytes")


def recent_items(uses: DataFrame, most: int) -> DataFrame:
    """The ``most`` items of each cache that were used last."""
    last = uses.groupBy("cache", "item").agg(F.max("seq").alias("seq"))
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seq")))
    few = last.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))).withColumn("n", order("cache", "part")).where(F.col("n") <= most)
    return few.withColumn("n", order("cache")).where(F.col("n") <= most).select("cache", "item", "seq")


def acknowledged(acks: DataFrame, ranks: int) -> DataFrame:
    """Jobs that every rank has acknowledged; repeats don't count."""
    return acks.groupBy("job").agg(F.count_distinct("rank").alias("ranks")).where(F.col("ranks") >= ranks).select("job")


def hit_by_invalid_blocks(requests: DataFrame, invalid: Column) -> DataFrame:
    """Requests whose blocks meet the invalid ones."""
    return requests.where(F.arrays_overlap("blocks", invalid))


def shared_root_check(prefix: DataFrame, whole: DataFrame) -> DataFrame:
    """Whether a prefix root's references are, place by place, the start of a longer root's (pair, idx, chunk)."""
    both = prefix.select("pair", "idx", F.col("chunk").alias("a")).join(whole.select("pair", "idx", F.col("chunk").alias("b")), ["pair", "idx"], "full_outer")
    return both.groupBy("pair").agg((F.bool_and(F.col("a").isNull() | F.col("a").eqNullSafe(F.col("b"))) & (F.count("a") < F.count("b"))).alias("strict_prefix"))


def gather(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Records of the asked slots in the asked order."""
    return slots.join(rows, "slot", "left").select("request", "ordinal", "slot", "record")


#: A worker statistic, the gauge that shows it, and its scale.
GAUGES = {
    **{k: (f"quorumlake_{k}", 1.0) for k in ("publication_pending_rank_slots", "maintenance_active_ranks", "maintenance_deletion_attempts", "maintenance_budget_exhausted", "maintenance_skipped_cooldown", "capture_delayed_requests", "capture_delayed_rank_slots", "capture_retained_pages", "capture_uncertain_ranks")},
    "publication_oldest_pending_ms": ("quorumlake_publication_oldest_pending_seconds", 0.001),
    "capture_oldest_delayed_ms": ("quorumlake_capture_oldest_delayed_seconds", 0.001),
    **{f"counter_{k}": (f"quorumlake_{k}", 1.0) for k in ("restore_hit", "restore_skip_local_prefix", "restore_skip_oversize", "restore_skip_backlog", "quorum_incomplete", "multimodal_bypass", "store_skipped_delayed_limit", "load_verified", "load_failed", "attribution_requests_complete", "attribution_requests_incomplete")},
}


def gauges(stats: DataFrame, scales: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value) of a one-row statistic, each under its name and scale."""
    pairs = [x for column, (name, scale) in scales.items() for x in (F.lit(name), F.col(column).cast("double") * scale)]
    return stats.select(F.explode(F.create_map(*pairs)).alias("metric", "value"))


def access_mode(mode: Column) -> Column:
    """(store, restore) of an access mode; null for an unknown one."""
    known = mode.isin("read_write", "read_only", "write_only", "off")
    return F.when(known, F.struct(mode.isin("read_write", "write_only").alias("store"), mode.isin("read_write", "read_only").alias("restore")))


def restore_phases(phases: DataFrame, names: list[str]) -> DataFrame:
    """A restore's milliseconds by phase, missing ones zero, with their sum; the first entry of a phase counts."""
    first = phases.groupBy("restore", "phase").agg(F.min_by("ms", "seq").alias("ms"))
    wide = first.groupBy("restore").agg(*(F.coalesce(F.sum(F.when(F.col("phase") == n, F.col("ms"))), F.lit(0)).alias(f"{n}_ms") for n in names))
    total = sum((F.col(f"{n}_ms") for n in names), F.lit(0))
    return wide.withColumn("service_ms", total)


def cohorts(loads: DataFrame, members: int = 16) -> DataFrame:
    """Role of each load in its evidence's cohort, and the cohort's number where one is full."""
    n = F.row_number().over(Window.partitionBy("evidence").orderBy("arrival", "load")) - 1
    return loads.withColumn("n", n).select("load", "evidence", F.floor(F.col("n") / members).cast("long").alias("cohort"), F.when(F.col("n") % members == 0, "leader").otherwise("member").alias("role"))


def materialise(live: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pages of a snapshot from the live ranges of its stages; rows (root, layer, stage, page, payload)."""
    # the ranges are hashed and the pages streamed: a sort would hold, and spill, every page
    return pieces.join(live.hint("shuffle_hash"), ["root", "layer", "stage"]).where((F.col("page") >= F.col("start")) & (F.col("page") < F.col("live_end"))).select("root", "layer", "page", "payload")


def finish_stores(results: DataFrame, held: DataFrame) -> DataFrame:
    """Held after store results: committed ones are added, evicted and failed ones are not held."""
    gone = results.where("outcome <> 'committed'").select("digest")
    return held.select("digest").union(results.where("outcome = 'committed'").select("digest")).distinct().join(gone, "digest", "left_anti")


def handed_off(receipts: DataFrame) -> DataFrame:
    """Receipts (outcome, allocated_bytes) that a commit hands over: negative or missing sizes are rejected, only committed bytes count."""
    ok = F.coalesce(F.col("allocated_bytes") >= 0, F.lit(False))
    return receipts.groupBy("outcome").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.coalesce(F.sum(F.when(ok & (F.col("outcome") == "committed"), F.col("allocated_bytes"))), F.lit(0)).alias("allocated_bytes"))


def startup_quorum(reports: DataFrame, ranks: int) -> DataFrame:
    """Handshake rows (transport, rank, digest) that count: the transport's rank is the reported one and is in range."""
    return reports.where((F.col("transport") == F.col("rank")) & F.col("rank").between(0, ranks - 1)).select("rank", "digest").distinct()


def surviving_aliases(aliases: DataFrame, stored: DataFrame) -> DataFrame:
    """Aliases whose key is still stored."""
    return aliases.join(stored, ["storage_key", "digest"], "left_semi")


def report_pages(held: DataFrame, page: int = 64) -> DataFrame:
    """A rank's checkpoint in pages of ``page`` digests, with the count of pages and of digests."""
    n = in_group(held.select("rank", "digest").distinct(), ["rank"], "digest")
    pages = n.groupBy("rank", F.floor((F.col("n") - 1) / page).cast("long").alias("page")).agg(F.count("*").alias("digests"), F.min("digest").alias("first"))
    total = held.select("rank", "digest").distinct().groupBy("rank").agg(F.count("*").alias("held"))
    return pages.join(total, "rank").select("rank", "page", "held", "digests", "first", F.ceil(F.col("held") / page).alias("pages"))


def capture_plan(sources: DataFrame, align: int = 1) -> DataFrame:
    """Offsets of each source's pages in a capture, by group and source; tails begin after the reused pages."""
    size = (F.col("pages") - F.col("reused")) * F.col("bytes_per_page")
    over = Window.partitionBy("capture").orderBy("grp", "source").rowsBetween(Window.unboundedPreceding, 0)
    return sources.withColumn("size", F.ceil(size / align) * align).withColumn("begin", F.sum("size").over(over) - F.col("size")).select("capture", "grp", "source", "begin", "size")
