"""Operator 8: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pending merges of a pre-token lie in one bucket per merge rank; a bucket holds
positions of a linked list of parts. Three levels of 64-bit words say which buckets are
filled, so the lowest rank is found by three find-first-set steps, whatever the length
of the pre-token. Entries whose part has merged meanwhile are stale and skipped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import column_bytes, pieces, texts

#: Pre-tokens whose ids a task remembers; the memory starts anew when it is full.
REMEMBERED = 250_000
#: A longer pre-token is encoded anew in each batch that has it.
REMEMBERED_CHARS = 64
#: Bytes of text that are split and encoded together.
TOGETHER = 3 << 20


def read_ranks(path: str) -> bytes:
    """The rank file as it is (under 1 MB): it is sent to executors, which may not see the path."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def pair_table(ranks: dict[bytes, int]):
    """Sorted keys (left id << 32 | right id) of all pairs of pieces that make a piece, and the rank of each."""
    import numpy as np

    keys, made = [], []
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                made.append(rank)
    keys, made = np.array([*keys, 1 << 62], np.int64), np.array([*made, -1], np.int32)
    order = np.argsort(keys)
    return keys[order], made[order]


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap, which gives the lowest filled bucket."""

    def __init__(self, n_ranks: int):
        top = (n_ranks >> 12) + 1
        self.low, self.mid, self.top = [0] * (top << 6), [0] * top, 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, positions) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def lowest(self) -> int:
        """The lowest rank with an entry, -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) | ((word & -word).bit_length() - 1)
        word = self.low[b]
        return (b << 6) | ((word & -word).bit_length() - 1)

    def take(self, rank: int) -> list:
        """Empties a bucket."""
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << ((rank >> 6) & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        return self.buckets.pop(rank)


class Encoder:
    """Byte-level BPE over a rank table. ``encode`` and ``decode`` are exact inverses on UTF-8 text.

    One queue serves all new pre-tokens of a batch: their parts form one linked list with
    breaks between pre-tokens, and a bucket's merges are done together. Pre-tokens don't
    touch each other, so each still merges its lowest rank first.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs):
        import numpy as np
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.keys, self.made = pairs
        self.piece = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.piece[i] = piece
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, left, right):
        """Rank of the piece that two ids make together, -1 where they make none."""
        import numpy as np

        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.made[at], np.int32(-1))

    def merge(self, words: list[bytes], one_by_one: bool = False) -> list[bytes]:
        """Ids of each pre-token, packed as little-endian unsigned 32-bit integers.

        Merges the adjacent pair of lowest rank, the leftmost first, until none is left. Doing
        a bucket's merges at once gives the same, unless one of them makes a pair of lower
        rank in a pre-token that has more of them; such pre-tokens are done again with
        ``one_by_one``, which merges the leftmost entry only and puts the others back.
        """
        import numpy as np

        whole = [self.ranks.get(x) for x in words]
        out = [b"" if i is None else i.to_bytes(4, "little") for i in whole]
        rest = [k for k, i in enumerate(whole) if i is None and words[k]]
        if not rest:
            return out
        sizes = np.array([len(words[k]) for k in rest])
        stops = np.cumsum(sizes)
        n = int(stops[-1])
        ids = np.empty(n + 1, np.int32)
        ids[:n] = self.single[np.frombuffer(b"".join([words[k] for k in rest]), np.uint8)]
        ids[n] = -1  # position n stands for no neighbour
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[stops - 1] = n
        before[stops - sizes] = n
        pending = np.full(n + 1, -1, np.int32)  # rank of the pair that begins here
        pending[: n - 1] = self.pair_ranks(ids[: n - 1], ids[1:n])
        pending[stops - 1] = -1
        odd: set[int] = set()
        queue = self.queue

        def push(at, ranks) -> None:
            there = ranks >= 0
            at, ranks = at[there], ranks[there]
            if len(at) == 1:
                queue.push(int(ranks[0]), at)
            elif len(at):
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
                for a, b, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist(), strict=False):
                    queue.push(rank, at[a:b])

        push(np.arange(n), pending[:n])
        while (rank := queue.lowest()) >= 0:
            taken = queue.take(rank)
            at = taken[0] if len(taken) == 1 else np.concatenate(taken)
            at = at[pending[at] == rank]  # the others are stale
            if len(at) > 1 and (at[1:] <= at[:-1]).any():
                at = np.unique(at)
            if not len(at):
                continue
            if one_by_one and len(at) > 1:
                queue.push(rank, at[1:])
                at = at[:1]
            right = after[at]
            if len(at) > 1 and (joined := right[:-1] == at[1:]).any():  # as in "aaa": every second one, from the left
                place = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(np.concatenate(([False], joined)), 0, place))
                keep = (place - begin) % 2 == 0
                at, right = at[keep], right[keep]
            next_ = after[right]
            if not one_by_one and len(at) > 1 and len(meets := np.flatnonzero(next_[:-1] == at[1:])):
                # one after the other, a merge would meet its right neighbour as it is now
                made = self.pair_ranks(np.full(len(meets), rank, np.int32), ids[next_[meets]])
                if (early := (made >= 0) & (made < rank)).any():
                    odd.update(np.searchsorted(stops, at[meets[early]], "right").tolist())
            ids[at], ids[right], pending[right] = rank, -1, -1
            after[at], before[next_] = next_, at
            previous = before[at]
            forward = np.where(next_ < n, self.pair_ranks(ids[at], ids[next_]), np.int32(-1))
            back = np.where(previous < n, self.pair_ranks(ids[previous], ids[at]), np.int32(-1))
            pending[at] = forward
            pending[previous] = back
            pending[n] = -1
            both, made = np.concatenate((at, previous)), np.concatenate((forward, back))
            if not one_by_one and len(at) > 1 and (early := (made >= 0) & (made < rank)).any():
                odd.update(np.searchsorted(stops, both[early], "right").tolist())
            push(both, made)
        left = ids[:n] >= 0
        ends = (np.cumsum(left)[stops - 1] * 4).tolist()
        packed = ids[:n][left].astype("<u4").tobytes()
        begin = 0
        for k, end in zip(rest, ends, strict=True):
            out[k] = packed[begin:end]
            begin = end
        for k in odd:
            out[rest[k]] = self.merge([words[rest[k]]], one_by_one=True)[0]
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text."""
        found = [self.find(x) for x in texts]
        new = set().union(*found) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known.clear()
            new = set().union(*found)
        fresh = list(new)
        self.known.update(zip(fresh, self.merge([x.encode() for x in fresh]), strict=True))
        known = self.known.__getitem__
        for x in found:
            yield b"".join(map(known, x))
        for x in fresh:
            if len(x) > REMEMBERED_CHARS:
                del self.known[x]

    def encode(self, text: str) -> bytes:
        return next(self.encode_batch([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def encode_documents(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary) of every text.

    A null text counts as empty and has no ids; each row gives one row, repeated rows too;
    an empty table gives an empty one; other columns are left out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks_file, pair_table(parse_ranks(ranks_file))))  # of the vocabulary's size: about 3 MB

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(parse_ranks(shared.value[0]), pattern, shared.value[1])
        for batch in pieces(batches, TOGETHER):
            packed = list(encoder.encode_batch(batch.column(1).to_pylist()))
            ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in packed)]).astype("int32"), pa.array(np.frombuffer(b"".join(packed), "<u4").astype("int32")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([encoder.decode(x) for x in packed], pa.binary())], names=["doc_id", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 as ``encode_documents`` gives them, digested where they are made.

    Same rules for nulls, repeated rows and empty tables.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks_file, pair_table(parse_ranks(ranks_file))))  # of the vocabulary's size: about 3 MB

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(parse_ranks(shared.value[0]), pattern, shared.value[1])
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in pieces(batches, TOGETHER):
            counts, ids, decoded = [], [], []
            for packed in encoder.encode_batch(batch.column(1).to_pylist()):
                counts.append(len(packed) // 4)
                ids.append(digest(packed))
                decoded.append(digest(encoder.decode(packed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
