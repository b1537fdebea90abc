"""Page snapshots and deltas: headers, plans, publication under a stage limit, reconstruction.

A layout is an array of (grp, name, page_bytes) in the order of groups and layers; a count of pages goes with each group.
Every check gives a reason instead of an error; null is a good row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import let
from ..session import deal, parts

#: Fixed values of the stored format.
SNAPSHOT_MAGIC, DELTA_MAGIC = b"QLSNP1", b"QLDLT1"
PREFIX_BYTES = 10
OBJECT_BYTES = 4 << 20
STAGE_LIMIT, CHAIN_LIMIT = 64, 8
#: Fixed values of the deterministic sources: a byte's steps by kind, layer, row and place, and a slot's start, steps and prime.
BYTE_STEPS = (71, 43, 17, 29)
SLOT_START, SLOT_RANK, SLOT_ROW, SLOT_PRIME = 11, 53, 37, 2039


def le32(n: Column) -> Column:
    """A count as four bytes, the low one first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, at, 2) for at in (7, 5, 3, 1))))


def read_le32(content: Column, at: int) -> Column:
    return F.conv(F.concat(*(F.hex(F.substring(content, at + i, 1)) for i in (4, 3, 2, 1))), 16, 10).cast("long")


def header(magic: bytes, document: Column) -> Column:
    """Magic, the document's length, the JSON document."""
    return let(F.to_json(document).cast("binary"), lambda body: F.concat(F.lit(magic), le32(F.octet_length(body)), body))


def snapshot_header(layout_sha256: Column, counts: Column) -> Column:
    """The header of a snapshot of ``counts`` pages for each group."""
    return header(SNAPSHOT_MAGIC, F.struct(counts.alias("block_counts"), layout_sha256.alias("layout_sha256")))


def header_prefix(content: Column, magic: bytes = DELTA_MAGIC) -> Column:
    """The header that an encoded delta begins with; null if it is cut off or has another magic."""
    size = read_le32(content, len(magic))
    whole = F.substring(content, F.lit(1), (size + PREFIX_BYTES).cast("int"))
    good = (F.octet_length(content) >= PREFIX_BYTES) & (F.substring(content, 1, len(magic)) == F.lit(magic)) & (size > 0) & (F.octet_length(whole) == size + PREFIX_BYTES)
    return F.when(good, whole)


def authenticated_header(content: Column, header_sha256: Column, object_sha256: Column) -> Column:
    """(header, reason) of a delta's first object: bound by the header's own digest if the root names one, else by the object's."""
    wrong = lambda found: F.when(header_sha256.isNotNull(), F.sha2(found, 256) != header_sha256).otherwise(F.sha2(content, 256) != object_sha256)
    bad = lambda found: F.when(content.isNull(), "unavailable").when(found.isNull(), "truncated").when(wrong(found), "digest")
    return let(header_prefix(content), lambda found: let(bad(found), lambda reason: F.struct(F.when(reason.isNull(), found).alias("header"), reason.alias("reason"))))


def payload_ok(integrity: Column, content: Column, sha256: Column, crc32: Column) -> Column:
    """Whether a payload passes under a mode of integrity: sha256, fast (CRC-32) or none; null for another mode."""
    return F.when(integrity == "sha256", F.coalesce(F.sha2(content, 256) == sha256, F.lit(False))).when(integrity == "fast", F.coalesce(F.crc32(content) == crc32, F.lit(False))).when(integrity == "none", True)


def extents(layers: Column, pages: Column, begin: Column) -> Column:
    """(grp, name, source_start, source_end) of each layer, where ``pages`` maps a group to its stored pages."""
    size = lambda x: F.element_at(pages, x["grp"]) * x["page_bytes"]
    kind = "array<struct<grp:bigint,name:string,source_start:bigint,source_end:bigint>>"
    zero = F.struct(begin.cast("long").alias("at"), F.array().cast(kind).alias("out"))
    item = lambda a, x: F.struct(x["grp"].alias("grp"), x["name"].alias("name"), a["at"].alias("source_start"), (a["at"] + size(x)).alias("source_end"))
    return F.aggregate(layers, zero, lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["out"], F.array(item(a, x))).alias("out")))["out"]


DELTA_DOCUMENT = "struct<layout_sha256:string,base_counts:map<string,bigint>,result_counts:map<string,bigint>,base_tokens:bigint,result_tokens:bigint,reused:map<string,bigint>,tails:array<struct<name:string,bytes:bigint,sha256:string>>>"


def plan_delta(deltas: DataFrame) -> DataFrame:
    """A delta's header against what the catalogue expects: reason, header_bytes, and the tails' extents.

    Rows have prefix (at least the header's bytes), total_bytes, layers, layout_sha256, base_counts, result_counts (maps by
    group), base_tokens and result_tokens. Checks stand in the order in which a reader meets them; a bad header has no tails.
    """
    x = deltas.withColumn("head", header_prefix(F.col("prefix"))).withColumn("h", F.from_json(F.substring("head", F.lit(PREFIX_BYTES + 1), F.octet_length("head")).cast("string"), DELTA_DOCUMENT))
    by_group = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].cast("long").alias("key"), e["value"].alias("value"))))  # noqa: E731  JSON names are text
    x = x.withColumn("h", F.when(F.col("h").isNotNull(), F.struct(F.col("h.layout_sha256").alias("layout_sha256"), *(by_group(F.col(f"h.{n}")).alias(n) for n in ("base_counts", "result_counts", "reused")), F.col("h.base_tokens").alias("base_tokens"), F.col("h.result_tokens").alias("result_tokens"), F.col("h.tails").alias("tails"))))
    x = x.withColumn("header_bytes", F.octet_length("head").cast("long"))
    x = x.withColumn("groups", F.sort_array(F.array_distinct(F.transform("layers", lambda v: v["grp"]))))
    groups = F.col("groups")
    same = lambda a, b: F.sort_array(F.map_entries(a)) == F.sort_array(F.map_entries(b))
    grows = F.forall(groups, lambda g: (F.element_at("base_counts", g) > 0) & (F.element_at("result_counts", g) >= F.element_at("base_counts", g)))
    bound = (F.col("h.layout_sha256") == F.col("layout_sha256")) & same(F.col("h.base_counts"), F.col("base_counts")) & same(F.col("h.result_counts"), F.col("result_counts")) & (F.col("h.base_tokens") == F.col("base_tokens")) & (F.col("h.result_tokens") == F.col("result_tokens"))
    reuse = F.forall(groups, lambda g: F.element_at("h.reused", g).between(0, F.element_at("base_counts", g)))
    stored = F.map_from_arrays(groups, F.transform(groups, lambda g: F.element_at("result_counts", g) - F.element_at("h.reused", g)))
    x = x.withColumn("stored", stored)  # a column: inside the fold it would be made again for each layer
    x = x.withColumn("tails", extents(F.col("layers"), F.col("stored"), F.col("header_bytes")))
    listed = F.transform("h.tails", lambda t: F.struct(t["name"].alias("name"), t["bytes"].alias("bytes")))
    wanted = F.transform("tails", lambda t: F.struct(t["name"].alias("name"), (t["source_end"] - t["source_start"]).alias("bytes")))
    end = F.element_at("tails", -1)["source_end"]
    rule = lambda ok: ~F.coalesce(ok, F.lit(False))
    reason = F.when(F.col("head").isNull(), "prefix").when(F.col("h").isNull(), "header").when(rule(grows), "counts").when(rule(bound), "identity").when(rule(reuse), "reuse").when(rule(listed == wanted), "descriptor").when(end > F.col("total_bytes"), "truncated").when(end < F.col("total_bytes"), "trailing")
    x = x.withColumn("reason", reason)
    destination = lambda t: F.element_at("h.reused", t["grp"]) * F.filter("layers", lambda v: v["name"] == t["name"])[0]["page_bytes"]
    tails = F.transform("tails", lambda t: F.struct(t["grp"].alias("grp"), t["name"].alias("name"), t["source_start"].alias("source_start"), t["source_end"].alias("source_end"), destination(t).alias("destination")))
    return x.withColumn("tails", F.when(F.col("reason").isNull(), tails)).drop("head", "h", "groups", "stored")


def publish_extension(extensions: DataFrame, roots: DataFrame, stage_limit: int = STAGE_LIMIT, chain_limit: int = CHAIN_LIMIT) -> DataFrame:
    """The root that each extension publishes over its base.

    extensions (digest, base, base_tokens, tokens, delta_bytes, snapshot_bytes, flat), roots (digest, valid, tokens, kind, stages
    (array of digests), chain (count of nested deltas), terminal (digest below them)). A flat root keeps one list of stages: at the limit the
    complete result is published as a snapshot of its own. A nested root at its limit is based on its terminal root anew.
    Gives outcome (snapshot, delta, rebased, or a reason), the result's base and stages, and its objects and bytes.
    """
    base = roots.select(F.col("digest").alias("base"), "valid", F.col("tokens").alias("held_tokens"), "kind", "stages", "chain", "terminal")
    x = extensions.join(base, "base", "left")
    compact = F.col("flat") & (F.size("stages") >= stage_limit)
    rebase = ~F.col("flat") & (F.col("chain") >= chain_limit)
    outcome = F.when(F.col("valid").isNull(), "absent").when(~F.col("valid"), "corrupt").when(F.col("held_tokens") != F.col("base_tokens"), "boundary").when(F.col("tokens") <= F.col("base_tokens"), "not_longer").when(compact, "snapshot").when(rebase, "rebased").otherwise("delta")
    x = x.withColumn("outcome", outcome)
    published = F.col("outcome").isin("snapshot", "delta", "rebased")
    flat_base = F.when(F.col("kind") == "page_delta", F.col("terminal")).otherwise(F.col("base"))
    under = F.when(F.col("outcome") == "rebased", F.col("terminal")).when(F.col("outcome") == "delta", F.when(F.col("flat"), flat_base).otherwise(F.col("base")))
    stages = F.when(F.col("outcome") == "delta", F.when(F.col("flat"), F.concat("stages", F.array("digest"))).otherwise(F.array("digest"))).when(F.col("outcome") == "rebased", F.array("digest")).when(F.col("outcome") == "snapshot", F.array().cast("array<bigint>"))
    size = F.when(F.col("outcome") == "snapshot", F.col("snapshot_bytes")).when(published, F.col("delta_bytes"))
    last = size - (F.ceil(size / OBJECT_BYTES) - 1) * OBJECT_BYTES
    allocated = (F.ceil(size / OBJECT_BYTES) - 1) * OBJECT_BYTES + F.ceil(last / 4096) * 4096
    return x.select("digest", "outcome", under.alias("under"), F.size(stages).alias("n_stages"), F.element_at(stages, 1).alias("first_stage"), F.ceil(size / OBJECT_BYTES).alias("objects"), size.alias("encoded_bytes"), allocated.alias("allocated_bytes"))


def reconstruct(stages: DataFrame) -> DataFrame:
    """Whether a history of stages (root, stage, base_pages, pages, reused, ok) can be rebuilt one after the other.

    Stricter than reading what is live: each stage must begin where the one before ended and all tails must be intact, even those that a
    later stage replaces. Gives root, ok, reason of the first bad stage, the stage, and the pages at the end.
    """
    over = Window.partitionBy("root").orderBy("stage")
    before = F.lag("pages").over(over)
    bad = F.when(before.isNotNull() & (before != F.col("base_pages")), "boundary").when(~F.col("reused").between(0, F.col("base_pages")) | (F.col("pages") < F.col("base_pages")), "counts").when(~F.col("ok"), "checksum")
    x = stages.withColumn("bad", bad)
    first = F.min_by(F.struct(F.col("stage"), F.col("bad")), F.when(F.col("bad").isNotNull(), F.col("stage")))
    out = x.groupBy("root").agg(F.bool_and(F.col("bad").isNull()).alias("ok"), first.alias("first"), F.max_by("pages", "stage").alias("pages"))
    return out.select("root", "ok", F.when(~F.col("ok"), F.col("first.bad")).alias("reason"), F.when(~F.col("ok"), F.col("first.stage")).alias("stage"), F.when(F.col("ok"), F.col("pages")).alias("pages"))


def split_range(ranges: DataFrame, objects: DataFrame) -> DataFrame:
    """Pieces of each logical range (range, source, start, end, destination) in the objects (source, object, encoded_start, encoded_end) that hold it, and whether they cover it."""
    x = ranges.join(objects, "source").where((F.col("encoded_start") < F.col("end")) & (F.col("encoded_end") > F.col("start")))
    begin, end = F.greatest("start", "encoded_start"), F.least("end", "encoded_end")
    cut = x.select("range", "object", (begin - F.col("encoded_start")).alias("object_offset"), (F.col("destination") + begin - F.col("start")).alias("destination"), (end - begin).alias("bytes"), (F.col("end") - F.col("start")).alias("asked"))
    return deal(cut, parts(cut), "range").withColumn("covered", F.sum("bytes").over(Window.partitionBy("range")) == F.col("asked")).drop("asked")


def base_evidence(roots: DataFrame) -> DataFrame:
    """The key under which restores may share a base: only of valid delta roots whose geometry agrees with their base's."""
    good = F.col("valid") & (F.col("kind") == "page_delta") & (F.col("base_tokens") < F.col("tokens")) & (F.col("base_bytes") == F.col("geometry_bytes"))
    evidence = F.sha2(F.concat_ws(":", "storage_key", "base", "layout", F.col("base_tokens").cast("string"), F.col("base_bytes").cast("string")).cast("binary"), 256)
    return roots.select("digest", F.when(good, evidence).alias("evidence"), F.when(~F.coalesce(good, F.lit(False)), F.when(~F.col("valid") | (F.col("kind") != "page_delta"), "not_a_delta").otherwise("geometry")).alias("reason"))


def gather_records(sources: DataFrame, slots: DataFrame, align: int = 256) -> DataFrame:
    """Where a gather puts each source's bytes: kinds in order, each at an aligned offset, layers of a kind after one another.

    sources (fixture, kind, layer, row_bytes), slots (fixture, rows); gives kind's offset, length and mask bit, and the source's base.
    """
    kinds = sources.groupBy("fixture", "kind").agg(F.count("*").alias("layers"), F.max("row_bytes").alias("row_bytes")).join(slots, "fixture")
    size = F.col("layers") * F.col("row_bytes") * F.col("rows")
    over = Window.partitionBy("fixture").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("length", size).withColumn("offset", F.coalesce(F.sum(F.ceil(F.col("length") / align) * align).over(over), F.lit(0)))
    found = sources.select("fixture", "kind", "layer").join(placed, ["fixture", "kind"])
    return found.select("fixture", "kind", "layer", "offset", "length", F.pow(F.lit(2), F.col("kind")).cast("long").alias("mask"), (F.col("offset") + F.col("layer") * F.col("rows") * F.col("row_bytes")).alias("base"))


def source_byte(kind: Column, layer: Column, row: Column, at: Column) -> Column:
    """Byte of a deterministic source row: neighbouring kinds, layers, rows and places differ."""
    return F.pmod(sum((x * step for x, step in zip((kind, layer, row, at), BYTE_STEPS, strict=True)), F.lit(0)), F.lit(256))


def source_slot(rank: Column, row: Column) -> Column:
    """A rank's permutation of the rows below a prime."""
    return F.pmod(SLOT_START + rank * SLOT_RANK + row * SLOT_ROW, F.lit(SLOT_PRIME))
