"""Operator 7: SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints within 3 bits differ in 3 of their 8 bytes at most, so they share 5
positional bytes at least. The index posts a fingerprint under sets of four positional bytes, chosen so that any
five shared positions contain one of the sets: pairs below the minimum rarely meet, and no
list is as long as that of a single byte. Pairs that meet are tallied by shared
positional bytes, those that reach the minimum are verified by their differing bits. Equal
fingerprints are one entry; only links that connect are kept of a long list. A crowded list is posted
anew under each byte that it leaves open, of which linked pairs share one at least; so no task holds one whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, free, join_hot, numbered, pieces, shuffle_width
from .components import components

BITS = 3
SHARED = 5
#: Fingerprints of a list that are tallied pair by pair at once; a longer list is searched from each one found, with the same tally.
SMALL = 64
#: Beyond this a list is posted anew under one more byte, or, with five bytes fixed, each neighbour is looked up.
CROWDED = 20_000


def covering() -> list[tuple[int, ...]]:
    """Sets of 4 of the 8 positions such that every 5 positions contain one, chosen greedily."""
    left, out = set(combinations(range(8), SHARED)), []
    while left:
        best = max(combinations(range(8), 4), key=lambda s: sum(set(s) <= set(x) for x in left))
        out.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return out


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the lower-cased words' shingles, repeats included, by XXH64 with seed 42; no words give 0."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, white space as in the contract
    if not words:
        return 0
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(x + 1 for x in ends[: n - 1])]
    digest = xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        raw = b"".join([digest(line[a:b], 42) for a, b in zip(starts[i : i + (1 << 14)], ends[min(len(words), shingle) - 1 :][i : i + (1 << 14)], strict=False)])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row, doc_id, fp (the fingerprint's bits as a signed long) of every whole text; null counts as empty."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches):
            found = np.array([fingerprint(x) for x in column_bytes(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(found.view(np.int64))], names=["row", "doc_id", "fp"])

    row = F.col(f"`{row_col}`") if row_col else F.lit(0).cast("long")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), row.alias("row"))
    return source.mapInArrow(run, "row long, doc_id long, fp long")


def near(a, b):
    """Which pairs share enough positional bytes and then differ in few enough bits; and the mask of shared bytes."""
    import numpy as np

    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0)
    tallied = shared.sum(axis=1) >= SHARED
    return tallied & (np.bitwise_count(differ) <= BITS), np.packbits(shared, axis=1, bitorder="little")[:, 0]


def spanning(fps) -> list[tuple[int, int]]:
    """Index pairs of links that connect what the list's links connect; ``fps`` are distinct."""
    import numpy as np

    if len(fps) > CROWDED:  # five bytes are fixed: at most 2 ** 24 fingerprints
        raw = fps.view(np.uint8).reshape(-1, 8)
        order = np.argsort(fps)
        ordered = fps[order]
        bits = [8 * p + b for p in range(8) if (raw[:, p] != raw[0, p]).any() for b in range(8)]
        out = []
        for k in range(1, BITS + 1):
            for chosen in combinations(bits, k):
                wanted = fps ^ np.uint64(sum(1 << b for b in chosen))
                at = np.minimum(np.searchsorted(ordered, wanted), len(fps) - 1)
                hit = np.flatnonzero((ordered[at] == wanted) & (fps < wanted))
                hit = hit[near(fps[hit], wanted[hit])[0]]
                out += zip(hit.tolist(), order[at[hit]].tolist(), strict=True)
        return out
    out, left = [], np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit, _ = near(fps[left], np.full(len(left), fps[one]))
            found, left = left[hit], left[~hit]
            out += [(one, x) for x in found]
            queue.extend(found)
    return out


def links(classes: DataFrame) -> DataFrame:
    """a, b: links between the classes (fp, rep) of equal fingerprints that give the same components as all links."""
    sets = covering()
    masks = [sum(0xFF << 8 * p for p in s) for s in sets]
    first = [next((i for i, s in enumerate(sets) if all(m >> p & 1 for p in s)), -1) for m in range(256)]

    def search(again: bool):
        """Of lists sorted by slot and key: kind 0, links (x, y); kind 1, entries (fp, rep) of a crowded list, unless posted ``again``."""

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            table = np.array(first)

            def out(kind, slot, x, y):
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(slot), pa.array(x), pa.array(y)], names=["kind", "slot", "x", "y"])

            def work(slot, key, fp, rep):
                """Whole lists."""
                new = np.concatenate(([True], (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])))
                begin = np.flatnonzero(new)
                sizes = np.diff(np.append(begin, len(fp)))
                group = np.repeat(np.arange(len(begin)), sizes)
                size = sizes[group]
                found = []
                for lag in range(1, min(SMALL, int(sizes.max(initial=0)))):
                    at = np.flatnonzero((group[lag:] == group[:-lag]) & (size[lag:] <= SMALL))
                    if len(at):
                        ok, shared = near(fp[at], fp[at + lag])
                        if not again:
                            ok &= table[shared] == slot[at]  # a pair meets under several sets; the first one tells
                        found.append((rep[at[ok]], rep[at[ok] + lag]))
                for g in np.flatnonzero(sizes > SMALL):
                    part = slice(begin[g], begin[g] + sizes[g])
                    pairs = np.array(spanning(fp[part]), np.int64).reshape(-1, 2)
                    found.append((rep[part][pairs[:, 0]], rep[part][pairs[:, 1]]))
                a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
                return out(0, np.zeros(len(a), np.int32), a, b)

            held, crowd = None, None  # entries not worked off; slot and key of the crowded list that goes on
            for batch in batches:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                if crowd is not None:
                    on = (now[0] == crowd[0]) & (now[1] == crowd[1])
                    end = int(on.sum())  # sorted: the list's rest stands first
                    if end:
                        yield out(1, now[0][:end], now[2][:end], now[3][:end])
                        now = [x[end:] for x in now]
                    if not len(now[0]):
                        continue
                    crowd = None
                now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
                if not len(now[0]):
                    continue
                last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
                end = int(last[-1]) + 1 if len(last) else 0  # the last list may go on
                held = [x[end:] for x in now]
                if end:
                    yield work(now[0][:end], now[1][:end], now[2][:end].view(np.uint64), now[3][:end])
                if not again and len(held[0]) > CROWDED:
                    crowd = held[0][0], held[1][0]
                    yield out(1, held[0], held[2], held[3])
                    held = None
            if held is not None and len(held[0]):
                yield work(held[0], held[1], held[2].view(np.uint64), held[3])

        return run

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    part = lambda m: F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))
    width = shuffle_width(classes.sparkSession)
    sorted_ = lambda df: df.repartition(width, "slot", "key").sortWithinPartitions("slot", "key", "fp")
    columns = "kind int, slot int, x long, y long"
    posted = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), part(m).alias("key")) for i, m in enumerate(masks))))
    index = classes.select("fp", "rep", posted.alias("post")).select("post.slot", "post.key", "fp", "rep")
    found = cut(sorted_(index).mapInArrow(search(False), columns))
    open_ = [[(F.lit(8 * i + p), part(m | 0xFF << 8 * p)) for p in range(8) if not m >> 8 * p & 1] for i, m in enumerate(masks)]
    wider = F.array(*(F.array(*(F.struct(s.alias("slot"), k.alias("key")) for s, k in x)) for x in open_))
    crowded = found.where("kind = 1").select("slot", F.col("x").alias("fp"), F.col("y").alias("rep"))
    reposted = crowded.select("fp", "rep", F.explode(F.get(wider, F.col("slot"))).alias("post")).select("post.slot", "post.key", "fp", "rep")
    more = sorted_(reposted).mapInArrow(search(True), columns)
    return found.where("kind = 0").union(more).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _components(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """row, doc_id, fp, component_id of every row."""
    found = cut(fingerprints(docs, id_col, text_col, row_col))
    classes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    reached = components(links(classes.where("rep is not null"))).withColumnRenamed("node", "rep")
    named = cut(classes.join(reached, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n"))
    return join_hot(found, named, ["fp"], ["row", "doc_id"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach) for every row.

    A null or empty text has fingerprint zero and links like any other; repeated rows give a row each in
    the same component; a null id names a component only where no row of its fingerprint has another; an
    empty table gives an empty one; other columns are left out.
    """
    found = _components(docs, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row of each component: that of the least id, of repeated rows the first. Null ids stay."""
    table, name = numbered(docs)
    found = _components(table, id_col, text_col, name)
    least = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("row")).select("row")
    row = free(table.columns, "stays__")
    stays = least.union(found.where("doc_id is null").select("row")).withColumnRenamed("row", row)
    return table.join(stays.hint("shuffle_hash"), F.col(name) == F.col(row), "left_semi").drop(name)
