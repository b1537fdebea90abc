"""Validity of each kind of stored root, of frames, probes, profiles and requests, as rule tables: a row's reasons, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates


def _not(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def alias_reasons() -> Column:
    """A prefix alias (storage_key, digest, boundary, chunk_count, chunk_tokens, every, checksum_ok)."""
    return gates.reasons({
        "digest": _not(gates.valid_digest(F.col("digest"))),
        "boundary": _not((F.col("boundary") > 0) & (F.col("boundary") % (F.col("chunk_tokens") * F.col("every")) == 0)),
        "chunk_count": _not(F.col("chunk_count") * F.col("chunk_tokens") == F.col("boundary")),
        "checksum": _not(F.col("checksum_ok")),
    })


def segment_reasons(per_segment: int) -> Column:
    """A segment (digest, first_index, chunks, parent, checksum_ok): whole steps, a parent unless it is the first."""
    return gates.reasons({
        "digest": _not(gates.valid_digest(F.col("digest"))),
        "first_index": _not((F.col("first_index") >= 0) & (F.col("first_index") % per_segment == 0)),
        "chunks": _not(F.size("chunks").between(1, per_segment)),
        "parent": _not((F.col("first_index") == 0) == F.col("parent").isNull()),
        "checksum": _not(F.col("checksum_ok")),
    })


def tail_reasons() -> Column:
    """A tail root (digest, tokens, base_tokens, base, chunk_tokens, checksum_ok): longer than its base, which ends with a chunk."""
    return gates.reasons({
        "digest": _not(gates.valid_digest(F.col("digest"))),
        "base": _not(gates.valid_digest(F.col("base")) & (F.col("base") != F.col("digest"))),
        "boundary": _not((F.col("base_tokens") > 0) & (F.col("base_tokens") < F.col("tokens")) & (F.col("base_tokens") % F.col("chunk_tokens") == 0)),
        "checksum": _not(F.col("checksum_ok")),
    })


def page_root_reasons() -> Column:
    """A page snapshot or delta (kind, digest, tokens, base_tokens, counts, base_counts, encoded_bytes, objects, object_bytes, checksum_ok)."""
    delta = F.col("kind") == "page_delta"
    grows = F.forall(F.arrays_zip("base_counts", "counts"), lambda x: (x["base_counts"] > 0) & (x["counts"] >= x["base_counts"]))
    return gates.reasons({
        "digest": _not(gates.valid_digest(F.col("digest"))),
        "counts": _not(F.forall("counts", lambda x: x > 0)),
        "base": delta & _not((F.size("base_counts") == F.size("counts")) & grows & (F.col("base_tokens") < F.col("tokens"))),
        "objects": _not((F.col("encoded_bytes") > 0) & (F.col("objects") == F.ceil(F.col("encoded_bytes") / F.col("object_bytes")))),
        "checksum": _not(F.col("checksum_ok")),
    })


def manifest_reasons(spans: DataFrame) -> DataFrame:
    """P10: reasons of each root's metadata from its rows (digest, idx, start, end, chunk, bytes, tokens): I2's checks, contiguity among them."""
    over = Window.partitionBy("digest").orderBy("idx")
    follows = (F.lag("end", 1, 0).over(over) == F.col("start")) & (F.col("end") > F.col("start"))
    sizes = spans.groupBy("digest", "chunk").agg((F.count_distinct("bytes") > 1).alias("two")).groupBy("digest").agg(F.bool_or("two").alias("two_sizes"))
    x = spans.withColumn("follows", follows).groupBy("digest").agg(F.bool_and("follows").alias("follows"), F.max("end").alias("last"), F.max("tokens").alias("tokens"), F.bool_and(F.col("bytes") > 0).alias("sized"))
    rules = {"range": _not(F.col("follows")), "tokens": _not(F.col("last") == F.col("tokens")), "bytes": _not(F.col("sized")), "chunk": F.col("two_sizes")}
    return x.join(sizes, "digest").select("digest", gates.reasons(rules).alias("reasons"))


def parse_aliases(aliases: DataFrame, chains: DataFrame) -> DataFrame:
    """Aliases (storage_key, digest, boundary, chunk_count, segment) with the chunks that their segments' chain lists.

    chains (segment, first_index, chunk, bytes) has every listing of the chain that ends in a segment. The alias is valid if the chain gives
    ``chunk_count`` listings, without a gap, and one size for each chunk; else it refers to nothing. A segment is resolved once, however many aliases end in it.
    """
    sizes = chains.groupBy("segment", "chunk").agg(F.count_distinct("bytes").alias("k"), F.max("bytes").alias("bytes"), F.count("*").alias("n"))
    whole = sizes.groupBy("segment").agg(F.sum("n").alias("listed"), F.bool_and(F.col("k") == 1).alias("one_size"), F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))
    span = chains.groupBy("segment").agg((F.max("first_index") + 1 == F.count_distinct("first_index")).alias("no_gap"))
    x = aliases.join(whole.join(span, "segment"), "segment", "left")
    valid = F.coalesce((F.col("listed") == F.col("chunk_count")) & F.col("one_size") & F.col("no_gap"), F.lit(False))
    return x.select("storage_key", "digest", valid.alias("valid"), F.when(valid, F.col("chunks")).otherwise(0).alias("chunks"), F.when(valid, F.col("bytes")).otherwise(0).alias("bytes"))


def lookup_verified(requests: DataFrame, roots: DataFrame, refs: DataFrame, objects: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Reason of each request at the three levels of verification: the root alone, its chunks' sizes, its chunks' bytes.

    roots (storage_key, digest, valid, schema_ok), refs (digest, chunk, bytes), objects (chunk, bytes, intact), aliases (storage_key, digest, valid). A root of
    another schema is incompatible. Aliases are asked only where no exact root exists, and only if given.
    """
    key = ["storage_key", "digest"]
    found = refs.join(objects.select("chunk", F.col("bytes").alias("stored"), "intact"), "chunk", "left")
    state = found.groupBy("digest").agg(F.bool_and(F.coalesce(F.col("stored") == F.col("bytes"), F.lit(False))).alias("sized"), F.bool_and(F.coalesce((F.col("stored") == F.col("bytes")) & F.col("intact"), F.lit(False))).alias("intact"))
    x = requests.join(roots.select(*key, "valid", "schema_ok"), key, "left").join(state, "digest", "left")
    x = x.join(aliases.select(*key, F.col("valid").alias("alias")), key, "left") if aliases is not None else x.withColumn("alias", F.lit(None).cast("boolean"))
    absent = F.when(F.col("alias").isNull(), "absent").when(F.col("alias"), "hit").otherwise("corrupt")
    level = lambda ok: F.when(F.col("valid").isNull(), absent).when(~F.col("schema_ok"), "incompatible").when(F.col("valid") & ok, "hit").otherwise("corrupt")
    return x.select(*requests.columns, level(F.lit(True)).alias("root"), level(F.coalesce("sized", F.lit(True))).alias("sizes"), level(F.coalesce("intact", F.lit(True))).alias("payloads"))


def bad_chunks(damaged: DataFrame, refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """Chunks that an invalidation deletes: those of the damaged exact roots whose stored bytes don't match; shared good ones stay."""
    asked = refs.join(damaged.select("digest"), "digest", "left_semi").select("chunk").distinct()
    return payloads.join(asked, "chunk", "left_semi").where(F.sha2("content", 256) != F.col("chunk")).select("chunk")


#: A frame's kinds, and the fields that each has beside the common ones.
FRAME_FIELDS = {"BEGIN": ("context_digest", "identity_digest"), "PUT_CHUNK": ("chunk_index", "chunk_digest"), "COMMIT": ("manifest_digest", "chunk_count"), "ABORT": ("reason",), "ACK": ("ack_sequence", "status"), "CREDIT": ("available_bytes", "available_frames")}
COMMON_FIELDS = ("transaction_id", "generation", "sequence")
ACK_STATUSES = ("ok", "duplicate", "rejected")


def frame_reasons(kind: Column, document: Column) -> Column:
    """What is wrong with a frame's JSON header."""
    text = lambda name: F.get_json_object(document, f"$.{name}")
    count = lambda name: text(name).rlike(r"^\d+$")
    wanted = F.element_at(F.create_map(*(x for k, v in FRAME_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted([*COMMON_FIELDS, *v])))))), kind)
    of = lambda name, broken: (kind == name) & broken
    return gates.reasons({
        "kind": _not(kind.isin(*FRAME_FIELDS)),
        "fields": wanted.isNotNull() & _not(F.array_sort(F.json_object_keys(document)) == wanted),
        "transaction_id": _not(text("transaction_id").rlike("^[0-9a-f]{32}$")),
        "generation": _not(count("generation")),
        "sequence": _not(count("sequence")),
        "digest": of("BEGIN", _not(gates.valid_digest(text("context_digest")) & gates.valid_digest(text("identity_digest")))) | of("PUT_CHUNK", _not(gates.valid_digest(text("chunk_digest")))) | of("COMMIT", _not(gates.valid_digest(text("manifest_digest")))),
        "count": of("PUT_CHUNK", _not(count("chunk_index"))) | of("COMMIT", _not(count("chunk_count") & (text("chunk_count") != "0"))) | of("CREDIT", _not(count("available_bytes") & count("available_frames"))) | of("ACK", _not(count("ack_sequence"))),
        "status": of("ACK", _not(text("status").isin(*ACK_STATUSES))),
        "reason": of("ABORT", _not(F.octet_length(text("reason")) <= 256)),
    })


def encode_commit(transaction: Column, generation: Column, digest: Column, chunks: Column) -> Column:
    """A commit record as JSON with its fields in order; null without chunks or with a malformed name."""
    good = (F.size(chunks) > 0) & F.forall(chunks, lambda x: x.rlike("^[0-9a-f]{64}$")) & transaction.rlike("^[0-9a-f]{32}$") & gates.valid_digest(digest) & (generation >= 0)
    return F.when(good, F.to_json(F.struct(chunks.alias("chunk_digests"), digest.alias("context_digest"), generation.alias("generation"), transaction.alias("transaction_id"))))


def decode_commit(document: Column) -> Column:
    """The record's struct; null unless encoding it anew gives the same text."""
    found = F.from_json(document, "struct<chunk_digests:array<string>,context_digest:string,generation:bigint,transaction_id:string>")
    again = encode_commit(found["transaction_id"], found["generation"], found["context_digest"], found["chunk_digests"])
    return F.when(F.coalesce(again == document, F.lit(False)), found)


#: Fixed values of a probe: its cells and its least numbers.
PROBE = {"modes": ("managed", "pinned"), "depths": (2, 3), "ranks": (0, 1, 2, 3), "saturation": 100, "checks": 8}


def probe_reasons() -> Column:
    """What contradicts itself in a probe record: its cell, and the equalities between its populations."""
    c = F.col
    return gates.reasons({
        "cell": _not(c("mode").isin(*PROBE["modes"]) & c("depth").isin(*PROBE["depths"]) & c("rank").isin(*PROBE["ranks"])),
        "failed": _not(c("passed") & c("error").isNull()),
        "saturation": _not((c("cycles") >= PROBE["saturation"]) & (c("intentional") == c("cycles")) & (c("unexpected") == 0) & (c("outstanding") == c("depth"))),
        "stats": _not((c("submissions") == c("iterations")) & (c("claims") == c("iterations")) & (c("releases") == c("iterations")) & (c("submitted_bytes") == c("payload_bytes") * c("iterations"))),
        "mismatches": _not(c("mismatches") == 0),
        "checks": _not((c("checks") >= PROBE["checks"]) & (c("warm_passes") == c("checks"))),
        "consume": _not(c("consume_passes").between(c("checks"), c("checks") + c("overlap")) & (c("overlap") <= c("consume_passes"))),
        "latency": _not((c("samples") == c("iterations")) & c("p50").isNotNull() & c("p95").isNotNull() & c("p99").isNotNull()),
        "memory": _not((c("free") <= c("total")) & (c("total") > 0) & (c("arena_bytes") == c("depth") * c("slot_bytes"))),
    })


def profile_reasons() -> Column:
    """Why a profile (chunk_tokens, degree, block_size, min_span, restore, page_layout, page_restore, kinds, most_kinds) can't be deployed."""
    c = F.col
    return gates.reasons({
        "degree": _not(c("degree") > 0),
        "rows": (c("degree") > 0) & (c("chunk_tokens") % c("degree") != 0),
        "block_size": _not((c("block_size") > 0) & ((c("chunk_tokens") % c("block_size") == 0) | (c("block_size") % c("chunk_tokens") == 0))),
        "min_span": _not(c("min_span") >= c("chunk_tokens")),
        "layout": c("restore") & c("page_layout") & ~c("page_restore"),
        "kinds": c("restore") & ~c("page_layout") & (c("kinds") > c("most_kinds")),
    })


def record_kinds(required: Column, optional: Column, colocated: Column, live: Column) -> Column:
    """(persisted, may_miss, expects_draft) of a profile's record kinds under its policies for draft and boundary records."""
    persisted = F.array_except(required, F.array_compact(F.array(F.when(colocated, "draft"), F.when(live, "boundary"))))
    return F.struct(F.array_sort(persisted).alias("persisted"), F.array_sort(F.array_union(optional, F.array_except(required, persisted))).alias("may_miss"), (~colocated & F.array_contains(required, "draft")).alias("expects_draft"))


def media_features(features: Column, tokens: Column, hashes: Column) -> Column:
    """The features of a request; null, which means to bypass, where they can't be proved: hashes alone, or ranges that overlap or leave the request."""
    whole = F.forall(features, lambda x: (x["offset"] >= 0) & (x["length"] > 0) & (x["offset"] + x["length"] <= tokens) & (x["identifier"] != "") & (x["modality"] != ""))
    apart = F.forall(F.sequence(F.lit(0), F.size(features) - 1), lambda i: (i == 0) | (F.get(features, i - 1)["offset"] + F.get(features, i - 1)["length"] <= F.get(features, i)["offset"]))
    none = F.coalesce(F.size(features), F.lit(0)) <= 0
    return F.when(none & (F.coalesce(F.size(hashes), F.lit(0)) > 0), None).when(none, F.slice(F.coalesce(features, F.array().cast("array<struct<offset:bigint,length:bigint,identifier:string,modality:string>>")), 1, 0)).when(whole & apart, features)


def boundary_blocks(entries: DataFrame, groups: list[int]) -> DataFrame:
    """The blocks (request, grp, block) that hold a request's store boundary, or the reason why none can be used.

    entries (request, boundary, grp, block, at): older entries are passed over; one ahead of the plan, a repeated group, an unknown
    group, block zero or a group that is missing poisons the request.
    """
    known = F.col("grp").isin(*groups)
    per = entries.groupBy("request").agg(
        F.bool_or(~known).alias("unknown"), F.bool_or(F.col("block") <= 0).alias("zero"), F.bool_or(F.col("at") > F.col("boundary")).alias("ahead"),
        F.count_if(F.col("at") == F.col("boundary")).alias("n"), F.count_distinct(F.when(F.col("at") == F.col("boundary"), F.col("grp"))).alias("k"),
        F.array_sort(F.collect_set(F.when(F.col("at") == F.col("boundary"), F.struct("grp", "block")))).alias("blocks"),
    )
    reason = F.when(F.col("unknown"), "group").when(F.col("zero"), "block").when(F.col("ahead"), "ahead").when(F.col("n") == 0, "pending").when(F.col("n") != F.col("k"), "repeated").when(F.col("k") != len(groups), "missing")
    return per.select("request", reason.alias("reason"), F.when(reason.isNull(), F.col("blocks")).alias("blocks"))


def recurrent_boundaries(requests: DataFrame, unit: int, least: int, most: int) -> DataFrame:
    """The boundary that a request proposes: its aligned span, if that is within the limits."""
    span = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / unit) * unit
    return requests.select("request", F.when(span.between(least, most), span).alias("boundary"))


def environment(values: Column) -> Column:
    """NAME=VALUE entries as a map; null where one has no name or no sign, or a name stands twice."""
    names = F.transform(values, lambda x: F.substring_index(x, "=", 1))
    good = F.forall(values, lambda x: F.instr(x, "=") > 1) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(good, F.map_from_arrays(names, F.transform(values, lambda x: F.regexp_replace(x, r"^[^=]*=", ""))))


def single_inspection(document: Column) -> Column:
    """The one object of an inspection, which may stand in a list of one and after a byte order mark; null otherwise."""
    text = F.regexp_replace(document, "^\ufeff", "")
    listed = F.json_array_length(text)
    return F.when(listed == 1, F.get_json_object(text, "$[0]")).when(listed.isNull() & F.json_object_keys(text).isNotNull(), text)


def completion(document: Column) -> Column:
    """(body, content, finish_reason) of a chat response: reasoning before the answer, outer white space cut; null without a message."""
    at = lambda name: F.get_json_object(document, f"$.choices[0].message.{name}")
    body = F.concat(*(F.coalesce(at(x), F.lit("")) for x in ("reasoning", "reasoning_content", "content")))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(F.get_json_object(document, "$.choices[0].message").isNotNull(), F.struct(trim(body).alias("body"), trim(F.coalesce(at("content"), F.lit(""))).alias("content"), F.get_json_object(document, "$.choices[0].finish_reason").alias("finish_reason")))


def semantic_match(found: Column, wanted: Column) -> Column:
    """Exact if a finished answer is the wanted one, suffix if it ends with it, else none."""
    done = F.coalesce(found["finish_reason"] == "stop", F.lit(False))
    return F.when(done & (found["content"] == wanted), "exact").when(done & found["content"].endswith(wanted), "suffix").otherwise("none")


def long_prompt(records: Column) -> Column:
    """A prompt of numbered records, two of which hold values; the question stands last."""
    alpha, omega, width = F.floor(records * 17 / 384), F.floor(records * 311 / 384), F.greatest(F.lit(4), F.length((records - 1).cast("string")))
    text = lambda i: F.when(i == alpha, "the first marker has value 3719").when(i == omega, "the last marker has value 5821").otherwise("this record has no value")
    line = lambda i: F.concat(F.lit("Record "), F.lpad(i.cast("string"), width, "0"), F.lit(": "), text(i), F.lit("."))
    return F.concat(F.lit("Read the records below.\n\n"), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), records - 1), line), "\n"), F.lit("\n\nAdd the two values."))


def phase_totals(phases: DataFrame) -> DataFrame:
    """Hashed, read and written bytes of each phase of a restore benchmark, and bytes read for each byte of result."""
    out = phases.groupBy("arm", "phase").agg(F.sum("hashed").alias("hashed"), F.sum("read").alias("read"), F.sum("written").alias("written"), F.sum("result").alias("result"))
    return out.withColumn("read_milli", F.when(F.col("result") > 0, F.floor(F.col("read") * 1000 / F.col("result"))))


def corrupted(payloads: DataFrame, at: Column, chosen: Column) -> DataFrame:
    """Payloads (chunk, content) with one byte of the chosen rows changed: what a qualification must detect."""
    content = F.col("content")
    flipped = F.concat(F.substring(content, F.lit(1), at), F.unhex(F.lpad(F.hex((F.conv(F.hex(F.substring(content, at + 1, F.lit(1))), 16, 10).cast("long") + 1) % 256), 2, "0")), F.substring(content, at + 2, F.octet_length(content)))
    return payloads.withColumn("content", F.when(chosen & (F.octet_length(content) > at), flipped).otherwise(content))


def worker_report(stats: DataFrame, counters: DataFrame) -> DataFrame:
    """One row for each rank: what it holds, its pending publication work and its counters as a sorted JSON object."""
    named = counters.groupBy("rank", "name").agg(F.sum("value").alias("value"))
    wide = named.groupBy("rank").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("counters"))
    return stats.join(wide, "rank", "left").select("rank", "held_count", "pending", F.when(F.col("pending") > 0, F.col("oldest_ms")).otherwise(0).alias("oldest_pending_ms"), F.coalesce("counters", F.lit("{}")).alias("counters"))
