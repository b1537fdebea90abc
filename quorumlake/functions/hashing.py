"""Digests over packed fields that Spark has no function for, and binary parsers."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def canonical_digest(struct: Column) -> Column:
    """SHA-256 of a struct's compact JSON; its fields must be in sorted order and set."""
    return F.sha2(F.to_json(struct).cast("binary"), 256)


def heat_slot(storage_key: Column, digest: Column, capacity: int) -> Column:
    """Slot of a key in a ring of a power-of-two capacity, from an 8-byte BLAKE2b."""

    @F.pandas_udf("long")
    def slot(key: pd.Series, digest: pd.Series) -> pd.Series:
        from hashlib import blake2b

        return pd.Series([int.from_bytes(blake2b(f"{k}\x00{d}".encode(), digest_size=8).digest(), "little") & (capacity - 1) for k, d in zip(key, digest, strict=True)])

    return slot(storage_key.cast("string"), digest.cast("string"))


def payload_matches(content: Column, sha256: Column, crc32: Column) -> Column:
    """Whether a payload has the digest that its descriptor names, or its checksum; without either it passes."""
    return F.when(sha256.isNotNull(), F.sha2(content, 256) == sha256).when(crc32.isNotNull(), F.crc32(content) == crc32).otherwise(F.lit(True))


def little_endian(content: Column, at: int, size: int) -> Column:
    """An unsigned little-endian integer of up to 16 bytes, as a decimal of 38 digits; larger values and missing bytes are null.

    The bytes are turned as hex digits and read in halves of 8. ``content`` stands once for each byte, so it should be a plain column.
    """
    half = lambda a, b: F.conv(F.concat(*(F.hex(F.substring(content, at + i + 1, 1)) for i in reversed(range(a, b)))), 16, 10).cast("decimal(20,0)")
    whole = half(0, min(size, 8))
    if size > 8:
        whole = F.try_add(F.try_multiply(half(8, size), F.lit(Decimal(1 << 64))), whole)
    return F.when(F.octet_length(content) >= at + size, whole.cast("decimal(38,0)"))


def smart_page(page: Column) -> Column:
    """A 512-byte health log page: warning, temperature, spare and its threshold, percentage used, units read and written; null for another size."""
    small = lambda at, size: little_endian(page, at, size).cast("int")
    written = little_endian(page, 0x30, 16)
    fields = F.struct(small(0, 1).alias("warning"), small(2, 2).alias("kelvin"), small(4, 1).alias("spare"), small(5, 1).alias("threshold"), small(6, 1).alias("used"), little_endian(page, 0x20, 16).alias("read_units"), written.alias("written_units"), (written != 0).alias("written_reported"))
    return F.when(F.octet_length(page) == 512, fields)


def metric_samples(text: Column) -> Column:
    """(name, value) of each sample line of a Prometheus text page."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^([a-zA-Z_:][\w:]*(?:\{[^}]*\})?\s+\S+)$"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^([\w:]+)", 1).alias("name"), F.regexp_extract(x, r"(\S+)$", 1).cast("double").alias("value")))


def human_bytes(n: Column) -> Column:
    """Bytes in the largest binary unit that leaves one or more, with one decimal, rounded half to even."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << 10 * k, F.concat(F.bround(n / float(1 << 10 * k), 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def swapped32(x: Column) -> Column:
    """An unsigned 32-bit integer with its bytes turned; ``x`` should be a plain column or variable."""
    byte = lambda at: F.shiftright(x, at).bitwiseAND(255)
    return F.shiftleft(byte(0), 24) + F.shiftleft(byte(8), 16) + F.shiftleft(byte(16), 8) + byte(24)


def packed_positions(positions: Column) -> Column:
    """Positions as unsigned 32-bit little-endian integers; null if one is out of range."""
    fits = F.forall(positions, lambda x: (x >= 0) & (x < 1 << 32))
    return F.when(fits, F.unhex(F.array_join(F.transform(positions, lambda x: F.lpad(F.hex(swapped32(x.cast("long"))), 8, "0")), "")))


def unpacked_positions(content: Column) -> Column:
    """The inverse of ``packed_positions``; null unless the bytes are whole integers."""
    n = F.octet_length(content)
    read = F.transform(F.sequence(F.lit(0), F.floor(n / 4).cast("int") - 1), lambda i: F.conv(F.hex(F.substring(content, 4 * i + 1, F.lit(4))), 16, 10).cast("long"))
    whole = F.when(n > 0, F.transform(read, swapped32)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n % 4 == 0, whole)


def scope_fingerprint(value: Column) -> Column:
    """SHA-256 of a value's JSON; null and the string "null" differ."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.sha2(F.when(value.isNull(), "null").otherwise(quoted).cast("binary"), 256)


def boundary_token(digest: Column, boundary: Column) -> Column:
    """Name that a digest and a boundary give together."""
    return F.sha2(F.concat_ws(":", digest, boundary.cast("string")).cast("binary"), 256)


def derived_name(storage_key: Column, digest: Column, kind: Column, index: Column, nonce: Column) -> Column:
    """Name of an object whose bytes don't name it: its root, its kind and place, and a nonce."""
    return F.sha2(F.concat_ws(":", storage_key, digest, kind, index.cast("string"), nonce).cast("binary"), 256)


def packed_media(features: Column, tokens: Column, domain: bytes) -> Column:
    """What the ordered media features that begin before ``tokens`` add to a context's bytes: nothing without any.

    The domain, their count as 4 bytes, and each one's offset (8 bytes), length, size of modality and of identifier (4 bytes each), modality and
    identifier; integers are little-endian.
    """
    used = F.filter(features, lambda x: x["offset"] < tokens)
    turned = lambda n, size: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n.cast("long")), 2 * size, "0"), F.lit("(..)"), F.lit(1))), ""))
    size = lambda x: turned(F.octet_length(x), 4)
    one = lambda x: F.concat(turned(x["offset"], 8), turned(x["length"], 4), size(x["modality"]), size(x["identifier"]), x["modality"].cast("binary"), x["identifier"].cast("binary"))
    return F.when(F.size(used) > 0, F.aggregate(F.transform(used, one), F.concat(F.lit(domain), turned(F.size(used), 4)), lambda a, x: F.concat(a, x))).otherwise(F.lit(b""))


def self_checksum_ok(document: Column, field: str = "checksum") -> Column:
    """Whether a JSON object's checksum, wherever it stands among the fields, is the SHA-256 of the object without it."""
    told = F.get_json_object(document, f"$.{field}")
    pair = F.concat(F.lit(f'"{field}":"'), told, F.lit('"'))
    middle = F.replace(document, F.concat(F.lit(","), pair), F.lit(""))
    rest = F.when(middle != document, middle).otherwise(F.replace(document, F.concat(pair, F.lit(",")), F.lit("")))
    return F.coalesce(told.rlike("^[0-9a-f]{64}$") & (F.sha2(rest.cast("binary"), 256) == told), F.lit(False))


def media_identity(features: Column, tokens: Column) -> Column:
    """Digest of the ordered media features (modality, identifier, offset, length) that begin before ``tokens``."""
    used = F.filter(features, lambda x: x["offset"] < tokens)
    return F.sha2(F.to_json(F.transform(used, lambda x: F.struct(x["identifier"].alias("identifier"), x["length"].alias("length"), x["modality"].alias("modality"), x["offset"].alias("offset")))).cast("binary"), 256)


def dotted(document: Column, path: str) -> Column:
    """The text at a dotted path of a JSON document; a missing one is null."""
    return F.get_json_object(document, f"$.{path}")


def rounded(value: Column, digits: int) -> Column:
    """Half to even, as reports round."""
    return F.bround(value, digits)


def encode_frame(header: Column, payload: Column) -> Column:
    """Eight hex digits of the header's and of the payload's length, the JSON header, the payload."""
    head = F.to_json(header).cast("binary")
    size = lambda x: F.lower(F.lpad(F.hex(F.octet_length(x)), 8, "0")).cast("binary")
    return F.concat(size(head), size(payload), head, payload)
