"""Operator 6: repeated byte strings by suffix arrays with two-stage sorting.

A suffix array over all bytes would move every text many times. So each task first picks, in every window of
``length`` bytes, the k-byte string of least hash: equal windows pick the same one, wherever they
stand. The windows in a row that pick one place make a context of up to 2 * length - k bytes. Hashes only bring
together what may be equal: contexts that look alike are linked to the first of them, within each task before anything is
shuffled, and the links in a row make extents of two texts; contexts that share the picked string but look different meet
under it. The bytes of both kinds are brought together; pieces that are the same byte for byte are merged, and all
others go into suffix arrays: the suffixes smaller than their successors are sorted directly,
scanning the buckets induces the rest, and adjacent common prefixes of ``length`` bytes tell which
windows are equal. What meets in more bytes than one array takes is sorted in parts; of what each part leaves,
equal windows meet again in further arrays, until one array holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, pieces, shuffle_width, small_batches, stored

K = 32
#: Bytes that one suffix array takes: places and ranks must fit 21 bits.
ARRAY_BYTES = 1 << 20
#: Bytes of texts that are hashed together, and of the texts of one such part: places must fit 24 bits.
TOGETHER, PART_BYTES = 1 << 20, 1 << 20
#: Contexts of a task that are merged at once.
MERGED = 1_000_000
#: Bytes of copies, and of their source, that are compared in one block.
BLOCK_BYTES = 256 << 10
#: Odd multipliers of the two polynomial hashes, modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Stands for a null id: smaller than all others.
NO_ID = -(1 << 63)


class Hashes:
    """Polynomial hashes modulo 2 ** 64 of any substring of a buffer, mixed."""

    def __init__(self, base: int, size: int):
        import numpy as np

        inverse = pow(base, -1, 1 << 64)
        powers = lambda b: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))))
        self.up, self.down = powers(base), powers(inverse)

    def prefix(self, data):
        import numpy as np

        out, terms = np.zeros(len(data) + 1, np.uint64), data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.up[: len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def of(self, prefix, begin, end):
        import numpy as np

        h = (prefix[end] - prefix[begin]) * self.down[begin]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def contexts(data, stops, length: int, k: int, hashes):
    """For texts laid end to end: the picked hash, the context's hash, its first window, and its windows less one."""
    import numpy as np

    n = len(data)
    width = length - k + 1  # k-byte strings of a window
    prefix = [h.prefix(data) for h in hashes]
    grams = hashes[0].of(prefix[0], slice(0, n - k + 1), slice(k, n + 1))
    least = grams & ~np.uint64(0xFFFFFF)
    least |= np.arange(n - k + 1, dtype=np.uint64)  # of equal ones the first
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    picked = (least & np.uint64(0xFFFFFF)).astype(np.int32)  # of the window at each place
    del least
    begins = np.concatenate(([0], stops[:-1]))
    inside = np.zeros(n + 1, np.int32)
    long = stops - begins >= length
    inside[begins[long]] += 1
    inside[stops[long] - length + 1] -= 1
    window = np.flatnonzero(np.cumsum(inside)[: len(picked)] > 0)
    if not len(window):
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    place = picked[window]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1))))
    low, high = window[first], window[np.append(first[1:], len(window)) - 1]
    whole = hashes[1].of(prefix[1], low, high + length) ^ ((high - low).astype(np.uint64) << np.uint64(56))
    return grams[place[first]], whole, low, high - low


def _named(keys, bits: int):
    """Dense ranks of uint64 keys of 64 - ``bits`` bits; ``bits`` hold a place."""
    import numpy as np

    order = np.sort(keys << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
    key = order >> np.uint64(bits)
    rank, new = np.empty(len(keys), np.uint32), np.concatenate(([False], key[1:] != key[:-1]))
    del key
    order &= np.uint64((1 << bits) - 1)
    rank[order.view(np.int64)] = np.cumsum(new, dtype=np.uint32)
    return rank


def names(data, depth: int):
    """For a text of less than 2 ** 21 bytes: ranks of the 20 bytes from each place on, with ``depth`` zeros behind the end."""
    import numpy as np

    n = len(data)
    padded = np.concatenate((data, np.zeros(5, np.uint8)))
    keys = np.zeros(n, np.uint64)
    for i in range(5):
        keys <<= np.uint64(8)
        keys |= padded[i : i + n]
    rank = _named(keys, 21)
    for span in (5, 10):
        keys[:] = rank
        keys <<= np.uint64(21)
        keys[: max(0, n - span)] |= rank[span:] + np.uint32(1)
        rank = _named(keys, 21)
    return np.concatenate((rank, np.zeros(depth, np.uint32)))


def suffix_array(data, depth: int, name):
    """Places in the order of their next ``depth`` bytes, by two-stage sorting.

    A suffix of kind B is smaller than its successor; those are sorted directly, by the names of 20 bytes at a time. Within
    the bucket of a first byte those of kind A come before. Scanning the array from the left, a suffix
    whose predecessor in the text is of kind A puts that at the front of its bucket's free places.
    """
    import numpy as np

    n = len(data)
    runs = np.flatnonzero(np.append(data[1:] != data[:-1], True)).astype(np.int32)  # ends of runs of one byte
    sizes = np.diff(runs, prepend=np.int32(-1))
    begin = np.repeat(runs - sizes + np.int32(1), sizes)
    smaller = np.repeat(data[runs] < data[np.minimum(runs + 1, n - 1)], sizes) | (data == 0)  # byte 0 ends a piece
    del runs, sizes

    place = np.uint64((1 << 21) - 1)
    direct = np.flatnonzero(smaller)
    order = name[direct].astype(np.uint64)
    order <<= np.uint64(21)
    order |= direct.view(np.uint64)
    order.sort()
    key, direct = order >> np.uint64(21), (order & place).astype(np.int32)
    del order
    for at in range(20, depth, 20):
        first = np.concatenate(([True], key[1:] != key[:-1]))
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            break
        group = (np.cumsum(first) - 1)[tied].astype(np.uint64)
        part = np.sort(group << np.uint64(42) | name[direct[tied] + at].astype(np.uint64) << np.uint64(21) | direct[tied].astype(np.uint64))
        direct[tied] = (part & place).astype(np.int32)
        key = np.arange(n, n + len(direct), dtype=np.uint64) << np.uint64(1)  # others stay apart
        head = np.concatenate(([True], part[1:] >> np.uint64(21) != part[:-1] >> np.uint64(21)))
        key[tied] = (tied[np.flatnonzero(head)[np.cumsum(head) - 1]].astype(np.uint64) << np.uint64(1)) | np.uint64(1)

    key = None
    cuts = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        kind_b = direct[cuts[c] : cuts[c + 1]]
        kind_a = np.concatenate(waiting[c]) if waiting[c] else kind_b[:0]
        if not len(kind_a) and not len(kind_b):
            continue
        left = kind_a - begin[kind_a]  # each is followed by its predecessors in its run, nearest first, those of all in turn
        if left.any():
            back = np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left) + 1
            before = np.repeat(kind_a, left) - back.astype(np.int32)
            kind_a = np.concatenate((kind_a, before[np.argsort(back, kind="stable")]))
        bucket = np.concatenate((kind_a, kind_b))
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (data[before] > c)]
        byte = data[before]
        turn = np.argsort(byte, kind="stable")
        before, byte = before[turn], byte[turn]
        heads = np.flatnonzero(np.diff(byte, prepend=np.int64(-1)))
        for a, b in zip(heads, np.append(heads[1:], len(byte)), strict=False):
            waiting[byte[a]].append(before[a:b])
    return np.concatenate(out)


def repeated_windows(blobs: list[bytes], length: int):
    """(piece, offset, class) of the windows of ``length`` bytes that occur more than once in the pieces."""
    import numpy as np

    data = np.frombuffer(b"\xff".join([*blobs, b""]), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: it becomes the 0 that ends a piece
    sizes = np.array([len(x) + 1 for x in blobs])
    stops = np.cumsum(sizes)
    name = names(data, length)
    order = suffix_array(data, length, name)
    order = order[(np.arange(len(data), dtype=np.int32) < np.repeat((stops - length).astype(np.int32), sizes))[order]]  # suffixes that hold a window; others don't stand between equal windows
    same = np.zeros(len(order), bool)  # whether the common prefix with the one before reaches the length
    maybe = np.arange(1, len(order), dtype=np.int32)
    for at in [*range(0, length - 20, 20), length - 20]:
        maybe = maybe[name[order[maybe] + at] == name[order[maybe - 1] + at]]
    same[maybe] = True
    several = same | np.append(same[1:], False)
    order, group = order[several], np.cumsum(~same, dtype=np.int32)[several]
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    return piece, order - (stops - sizes)[piece], group


def _line(rows, length: int):
    """Pieces (doc, row, begin, bytes) on one line in order of doc, row, begin: each one's place there, and the row, begin and place of each run of overlapping pieces.

    Windows of different runs are never next to each other on the line.
    """
    import numpy as np

    doc, row, begin = (np.array([x[i] for x in rows], np.int64) for i in range(3))
    order = np.lexsort((begin, row, doc))
    doc, row, begin = doc[order], row[order], begin[order]
    end = begin + np.array([len(x[3]) for x in rows], np.int64)[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]))))
    text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + text * far) - text * far  # of the pieces of the text so far
    starts = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (begin[1:] >= reach[:-1]))))
    sizes = np.maximum.reduceat(end, starts) - begin[starts]
    at = np.cumsum(sizes) - sizes
    place = np.empty(len(rows), np.int64)
    place[order] = begin + np.repeat(at - begin[starts], np.diff(np.append(starts, len(row))))
    return place, row[starts], begin[starts], at


def linked(row, begin, size, source, source_begin):
    """Extents of links (in order of row, source, begin) that go on in both texts: their row, begin, end, source, source_begin."""
    import numpy as np

    end = begin + size
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (begin[1:] - source_begin[1:] != begin[:-1] - source_begin[:-1]) | (begin[1:] > end[:-1])))) if len(row) else np.zeros(0, np.int64)
    last = np.maximum.reduceat(end, first) if len(first) else end
    return row[first], begin[first], last, source[first], source_begin[first]


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text) of the table; (row, begin, end) of bytes to remove, which may overlap."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    table, name = numbered(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")))
    table = table.select(F.col(name).alias("row"), "doc_id", "text")

    def pick(batches: Iterator) -> Iterator:
        """Kind 1: of alike contexts of the task the first (gram, whole, doc, row, at). Kind 0: extents of the others (-, source, source begin, row, begin, size)."""
        import numpy as np
        import pyarrow as pa

        def batch_of(kind, *columns):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(x) for x in columns)], names=["kind", "gram", "whole", "doc_id", "row", "at", "size"])

        def merged(parts):
            columns = [np.concatenate([x[i] for x in parts]) for i in range(5)]
            parts.clear()
            order = np.lexsort(columns[::-1])
            for i in range(5):  # one at a time: the unsorted one goes
                columns[i] = columns[i][order]
            gram, whole, doc, row, at = columns
            first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])))
            rep, rest = np.flatnonzero(first)[np.cumsum(first) - 1][~first], ~first
            by = np.lexsort((at[rest], row[rep], row[rest]))
            r, b, e, src, src_b = linked(row[rest][by], (at[rest] >> 8)[by], ((at[rest] & 255) + length)[by], row[rep][by], (at[rep] >> 8)[by])
            del order, rep, rest, by
            first = np.flatnonzero(first)
            for i in range(0, len(first), 100_000):
                part = first[i : i + 100_000]
                yield batch_of(1, gram[part], whole[part], doc[part], row[part], at[part], part * 0)
            for i in range(0, len(r), 100_000):
                x, y, z = (v[i : i + 100_000] for v in (r, b, e))
                yield batch_of(0, x * 0x9E3779B97F4A7C1 + y, src[i : i + 100_000], src_b[i : i + 100_000], x, y, z - y)

        size, hashes, held, n_held = 0, None, [], 0
        for batch in pieces(batches, TOGETHER):
            texts = [(i, x) for i, x in enumerate(batch.column(2).to_pylist()) if len(x) >= length]
            docs_, rows = batch.column(1).fill_null(NO_ID).to_numpy(), batch.column(0).to_numpy()
            while texts:
                n = 1
                total = len(texts[0][1])
                while n < len(texts) and total + len(texts[n][1]) <= PART_BYTES:
                    total += len(texts[n][1])
                    n += 1
                part, texts = texts[:n], texts[n:]
                data = np.frombuffer(b"".join([x for _, x in part]), np.uint8)
                ends = np.cumsum([len(x) for _, x in part])
                for begun in range(0, max(1, len(data) - length + 1), PART_BYTES):  # one step, but for one text beyond the part's bytes
                    piece = data[begun : begun + PART_BYTES + length - 1]
                    if len(piece) > size:
                        size = len(piece)
                        hashes = [Hashes(x, size + 1) for x in BASES]
                    stops = np.array([len(piece)]) if len(ends) == 1 else ends
                    gram, whole, low, more = contexts(piece, stops, length, K, hashes)
                    which = np.searchsorted(stops, low, "right")
                    at = low - (stops - np.diff(np.concatenate(([0], stops))))[which] + begun
                    where = np.array([i for i, _ in part])[which]
                    held.append((gram.view(np.int64), whole.view(np.int64), docs_[where], rows[where], at << 8 | more))
                    n_held += len(low)
                    if n_held >= MERGED:
                        yield from merged(held)
                        n_held = 0
        if n_held:
            yield from merged(held)

    def meet(batches: Iterator) -> Iterator:
        """Sorted by kind, gram, whole, doc_id, row, at: contexts like one before become links (kind 0) to it; the first is asked for (kind 1) if its gram has others."""
        import numpy as np
        import pyarrow as pa

        def out(kind, row, begin, size, key, source_begin):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (row, begin, size, key, source_begin))], names=["kind", "row", "begin", "size", "key", "source_begin"])

        held = None  # the last class's first entry: gram, whole, row, at, whether it was asked for
        for batch in batches:
            kind = batch.column(0).to_numpy()
            gram, whole, doc, row, at, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
            ready = kind == 0
            if ready.any():
                yield out(0, row[ready], at[ready], size[ready], whole[ready], doc[ready])
                gram, whole, row, at = (x[~ready] for x in (gram, whole, row, at))
            if not len(gram):
                continue
            before = held or (0, 0, 0, 0, True)
            same_gram = np.concatenate(([held is not None and held[0] == gram[0]], gram[1:] == gram[:-1]))
            same = same_gram & np.concatenate(([held is not None and held[1] == whole[0]], whole[1:] == whole[:-1]))
            index = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))[same]  # the class's first entry, -1 is the one held
            first_row, first_at = np.append(row, before[2])[index], np.append(at, before[3])[index]
            yield out(0, row[same], at[same] >> 8, (at[same] & 255) + length, first_row, first_at >> 8)
            first = np.flatnonzero(~same)
            if len(first):
                joins = same_gram[first]  # another class with this gram stands before
                asked = joins | np.append(joins[1:], False)
                if joins[0] and not held[4]:
                    yield out(1, [before[2]], [before[3] >> 8], [(before[3] & 255) + length], [before[0]], [0])
                chosen = first[asked]
                yield out(1, row[chosen], at[chosen] >> 8, (at[chosen] & 255) + length, gram[chosen], chosen * 0)
                last = first[-1]
                held = (gram[last], whole[last], row[last], at[last], bool(asked[-1]))

    def block(batches: Iterator) -> Iterator:
        """Links in order of row, source, begin: requests for the bytes of blocks, each of one source and its copies."""
        import pyarrow as pa
        from pyspark import TaskContext

        blocks: dict[int, list] = {}  # of a source: block, bytes, low, high, blocks before
        n, out = TaskContext.get().partitionId() << 40, []

        def close(source):
            b, _, low, high, slot = blocks[source]
            out.append((source, slot, b, low, high - low))

        def ready():
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(5)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["row", "slot", "key", "begin", "size"])

        for batch in batches:
            found = linked(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)))
            for row, begin, end, source, at in zip(*(x.tolist() for x in found), strict=True):
                for b in range(begin, end - length + 1, BLOCK_BYTES):  # a long extent in steps that share length - 1 bytes
                    e = min(end, b + BLOCK_BYTES + length - 1)
                    low, high = at + b - begin, at + e - begin
                    now = blocks.get(source)
                    if now is not None and (now[1] + e - b > BLOCK_BYTES or max(high, now[3]) - min(low, now[2]) > BLOCK_BYTES + 2 * length):
                        close(source)
                        now = [None, 0, low, high, now[4]]
                    if now is None or now[0] is None:
                        n += 1
                        now = blocks[source] = [n, 0, low, high, 0 if now is None else now[4] + 1]
                    now[1], now[2], now[3] = now[1] + e - b, min(now[2], low), max(now[3], high)
                    out.append((row, 0, now[0], b, e - b))
            if len(blocks) > 100_000:
                for source in blocks:
                    close(source)
                blocks.clear()
            if len(out) >= 20_000:
                yield ready()
        for source in blocks:
            close(source)
        yield ready()

    def fetch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names_ = ["key", "doc_id", "row", "begin", "bytes"]
        for batch in pieces(batches, 4 << 20):
            for row, doc, text, keys, begins, sizes in zip(*(batch.column(i) for i in range(6)), strict=True):
                row, doc, text = row.as_py(), doc.as_py(), text.as_py()
                out, total = [], 0
                for key, begin, size in zip(keys.as_py(), begins.as_py(), sizes.as_py(), strict=True):
                    out.append((key, begin, text[begin : begin + size]))
                    total += size
                    if total > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([doc] * len(out), pa.int64()), pa.array([row] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=names_)
                        out, total = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([doc] * len(out), pa.int64()), pa.array([row] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=names_)

    def sort(batches: Iterator) -> Iterator:
        """Sorted by key: suffix arrays over whole groups; kind 0 spans to remove. Of groups beyond one array, kind 1 the windows that a part leaves, by their hash."""
        import numpy as np
        import pyarrow as pa

        hashes = []

        def out(kind, key, row, begin, end):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (key, row, begin, end))], names=["kind", "key", "row", "begin", "end"])

        def arrays(rows, part: bool = False):
            """rows: (doc, row, begin, bytes). Windows that an earlier one in the array equals go."""
            piece, offset, group = repeated_windows([x[3] for x in rows], length)
            place, row_of, begin_of, starts = _line(rows, length)
            order = group.astype(np.uint64) << np.uint64(42) | (place[piece] + offset).astype(np.uint64) << np.uint64(21) | np.arange(len(piece), dtype=np.uint64)
            order.sort()
            low = np.uint64((1 << 21) - 1)
            group, at, order = order >> np.uint64(42), (order >> np.uint64(21) & low).astype(np.int32), (order & low).astype(np.int32)
            same = np.concatenate(([False], group[1:] == group[:-1])) if len(group) else np.zeros(0, bool)
            twice = same & np.concatenate(([False], at[1:] == at[:-1])) if len(group) else same  # one place may be in two pieces
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(group) else same  # the class's first place
            later = same & (at != at[head]) if len(group) else same
            run = np.unique(at[later])
            first = np.flatnonzero(np.diff(run, prepend=np.int32(-2)) > 1)
            last = np.append(first[1:], len(run))[: len(first)] - 1
            which = np.searchsorted(starts, run[first], "right") - 1
            a, b = row_of[which], begin_of[which] + run[first] - starts[which]
            yield out(0, a * 0, a, b, b + run[last] - run[first] + length)
            if part:
                if not hashes:
                    hashes.append(Hashes(BASES[0], 2 * ARRAY_BYTES))
                data = np.frombuffer(b"".join([x[3] for x in rows]), np.uint8)
                sizes = np.array([len(x[3]) for x in rows], np.int64)
                n = sizes - length + 1
                stays = np.ones(int(n.sum()), bool)
                gone = order[later | twice]
                stays[(np.cumsum(n) - n)[piece[gone]] + offset[gone]] = False
                which = np.repeat(np.arange(len(rows)), n)[stays]
                offset = (np.arange(len(stays)) - np.repeat(np.cumsum(n) - n, n))[stays]
                at = (np.cumsum(sizes) - sizes)[which] + offset
                h = hashes[0].of(hashes[0].prefix(data), at, at + length).view(np.int64)
                row, begin = (np.array([x[i] for x in rows], np.int64) for i in (1, 2))
                for i in range(0, len(h), 100_000):
                    r, b = row[which[i : i + 100_000]], begin[which[i : i + 100_000]] + offset[i : i + 100_000]
                    yield out(1, h[i : i + 100_000], r, b, b + length)

        gone: list = []  # places of pieces that are, byte for byte, copies of an earlier piece

        def merge(held, blob, place) -> int:
            """Keeps of equal pieces the earliest, all of whose copies go; the bytes that ``held`` grows by."""
            first = held.setdefault(blob, place)
            if first[1:] != place[1:]:
                held[blob] = min(first, place)
                gone.append((*max(first, place)[1:], len(blob)))
                return 0
            return len(blob) if first is place else 0

        def copies():
            row, begin, size = (np.array([x[i] for x in gone], np.int64) for i in range(3))
            gone.clear()
            return out(0, row * 0, row, begin, begin + size)

        ready, ready_bytes, group, group_bytes, now, crowded = {}, 0, {}, 0, None, False
        rows_of = lambda held: [(*place, blob) for blob, place in held.items()]
        for batch in pieces(batches, 4 << 20):
            keys, docs_, rows, begins = (batch.column(i) for i in range(4))
            for key, doc, row, begin, blob in zip(keys.to_pylist(), docs_.fill_null(NO_ID).to_pylist(), rows.to_pylist(), begins.to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key != now:
                    if crowded:
                        yield from arrays(rows_of(group), True)
                    else:
                        if ready and ready_bytes + group_bytes > ARRAY_BYTES:
                            yield from arrays(rows_of(ready))
                            ready, ready_bytes = {}, 0
                        for piece, place in group.items():
                            ready_bytes += merge(ready, piece, place)
                    group, group_bytes, now, crowded = {}, 0, key, False
                if group and group_bytes + len(blob) > ARRAY_BYTES and blob not in group:
                    yield from arrays(rows_of(group), True)
                    group, group_bytes, crowded = {}, 0, True
                group_bytes += merge(group, blob, (doc, row, begin))
            yield copies()
        if ready and (crowded or ready_bytes + group_bytes > ARRAY_BYTES):
            yield from arrays(rows_of(ready))
            ready = {}
        if crowded:
            yield from arrays(rows_of(group), True)
        else:
            for piece, place in group.items():
                merge(ready, piece, place)
            if ready:
                yield from arrays(rows_of(ready))
        yield copies()

    def decided(requests: DataFrame) -> DataFrame:
        """kind, key, row, begin, end from requests for bytes (row, slot, key, begin, size)."""
        by_row = requests.groupBy("row", "slot").agg(F.collect_list(F.struct("key", "begin", "size")).alias("x")).select("row", "x")
        joined = table.join(by_row.hint("shuffle_hash"), "row").select("row", "doc_id", "text", "x.key", "x.begin", "x.size")
        fetched = joined.mapInArrow(fetch, "key long, doc_id long, row long, begin long, bytes binary")
        with small_batches(spark):
            return stored(fetched.repartition(width, "key").sortWithinPartitions("key").mapInArrow(sort, "kind int, key long, row long, begin long, end long"))

    picked = table.mapInArrow(pick, "kind int, gram long, whole long, doc_id long, row long, at long, size long")
    order = ["kind", "gram", "whole", "doc_id", "row", "at"]
    with small_batches(spark):
        met = stored(picked.repartition(width, "gram").sortWithinPartitions(*order).mapInArrow(meet, "kind int, row long, begin long, size long, key long, source_begin long"))
    links = met.where("kind = 0").select("row", "begin", "size", F.col("key").alias("source"), "source_begin")
    blocks = links.repartition(width, "row").sortWithinPartitions("row", "source", "begin").mapInArrow(block, "row long, slot long, key long, begin long, size long")
    blocks = blocks.withColumn("slot", F.floor(F.col("slot") / 64).cast("long"))  # one source's requests of many blocks are fetched in several rows
    asked = met.where("kind = 1").select("row", F.lit(0).cast("long").alias("slot"), "key", "begin", "size")
    found = decided(blocks.unionAll(asked))
    spans = found.where("kind = 0").select("row", "begin", "end")
    while not (crowds := found.where("kind = 1")).isEmpty():
        again = crowds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        found = decided(crowds.join(again, "key").select("row", F.lit(0).cast("long").alias("slot"), "key", "begin", (F.col("end") - F.col("begin")).alias("size")))
        spans = spans.unionAll(found.where("kind = 0").select("row", "begin", "end"))
    return table, spans


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (array of (begin, end)) and kept (the bytes that stay) for every row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller id, or earlier in the
    same text; of rows with one id the first in the table is earlier; a null id is smallest. A null text counts as
    empty; shorter texts keep all; an empty table gives an empty one; other columns are left out.
    """
    table, spans = repeated_spans(docs, length, id_col, text_col)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches, 4 << 20):
            removed, kept, sizes = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                text, runs, left, at = text.as_py(), [], [], 0
                for b, e in sorted((x["begin"], x["end"]) for x in spans.as_py() or ()):
                    if runs and b <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([b, e])
                for b, e in runs:
                    left.append(text[at:b])
                    at = e
                kept.append(b"".join([*left, text[at:]]))
                sizes.append(len(text))
                removed.append([{"begin": b, "end": e} for b, e in runs])
            gone = [a - len(b) for a, b in zip(sizes, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    return table.join(by_row.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<begin:long,end:long>>, kept binary")
