"""Operator 10: exact duplicates by Patricia tries that own the texts.

Each task first merges the equal texts among its own rows in a trie, so that a group of copies, however
large, is shuffled as one text from each task. Length and content hash then choose the partition,
where the full byte strings go into a compressed radix trie; the terminal node of a string holds
the identifier that stays, the number of rows and the entries that asked. A trie beyond its
memory writes subtrees to temporary files of its task, which are worked off one after the other; a task that is run
again writes its own.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, shuffle_width, stored, texts

#: Bytes of distinct texts that a task holds in a trie before it writes subtrees to files.
TRIE_BYTES = 64 << 20
#: Rows that a task merges before it passes them on.
HELD_ROWS = 200_000


class Node:
    """An edge's bytes and what follows them; ``file`` takes all keys from here on once the subtree was written out."""

    __slots__ = ("label", "children", "value", "file")

    def __init__(self, label: bytes, value=None, file=None):
        self.label, self.children, self.value, self.file = label, {}, value, file


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A compressed radix trie; values merge at the terminal node of an equal key. ``size`` counts its bytes."""

    def __init__(self, merge, limit: int | None = None):
        self.merge, self.limit = merge, limit
        self.root, self.size, self.files = Node(b""), 0, []

    def insert(self, key: bytes, value) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], value)
                self.size += end - at + 250
                self._spill()
                return
            label = child.label
            if not key.startswith(label, at):
                n = common_prefix(label, key[at : at + len(label)])
                split = Node(label[:n])
                child.label = label[n:]
                split.children[child.label[0]] = child
                node.children[key[at]] = child = split
                self.size += 250
            at += len(child.label)
            node = child
            if node.file is not None:
                pickle.dump((key, value), node.file)
                return
        node.value = value if node.value is None else self.merge(node.value, value)
        self.size += 8

    def _walk(self, node: Node, before: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.value is not None:
                yield key, node.value
            stack += [(x, key) for x in node.children.values()]

    def _sizes(self) -> dict[int, int]:
        """Bytes of each node's subtree, by the node's identity."""
        order, stack = [], [self.root]
        while stack:
            order.append(node := stack.pop())
            stack += node.children.values()
        out = {}
        for node in reversed(order):
            out[id(node)] = len(node.label) + 250 + sum(out[id(x)] for x in node.children.values())
        return out

    def _spill(self) -> None:
        """Writes subtrees to files while the trie is over its limit: children of the deepest fork that holds half of it.

        Only a fork's child goes, so the keys of its file share more bytes than all keys here do, and
        working the file off ends. A single key, however long, is never written.
        """
        while self.limit is not None and self.size > self.limit:
            sizes = self._sizes()
            node, before, fork = self.root, b"", None
            while True:
                before += node.label
                live = [x for x in node.children.values() if x.file is None]
                if live and (len(node.children) > 1 or node.value is not None):
                    fork = node, before
                heaviest = max(live, key=lambda x: sizes[id(x)], default=None)
                if heaviest is None or fork and 2 * sizes[id(heaviest)] < sizes[id(self.root)]:
                    break
                node = heaviest
            if fork is None:
                return
            node, before = fork
            for child in sorted((x for x in node.children.values() if x.file is None), key=lambda x: -sizes[id(x)]):
                file = tempfile.TemporaryFile()
                for item in self._walk(child, before):
                    pickle.dump(item, file)
                stack = [child]
                while stack:  # files below join this one
                    inner = stack.pop()
                    stack += inner.children.values()
                    if inner.file is not None:
                        inner.file.seek(0)
                        shutil.copyfileobj(inner.file, file)
                        self.files.remove(inner.file)
                        inner.file.close()
                node.children[child.label[0]] = Node(child.label[:1], file=file)
                self.files.append(file)
                self.size -= sizes[id(child)] - 250
                if 2 * self.size < self.limit:
                    return

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Keys and values, those of the files too; empties the trie."""
        yield from self._walk(self.root, b"")
        self.root, left = Node(b""), self.files
        while left:
            inner = Trie(self.merge, self.limit)
            with left.pop() as file:
                file.seek(0)
                while True:
                    try:
                        inner.insert(*pickle.load(file))
                    except EOFError:
                        break
            yield from inner._walk(inner.root, b"")
            left += inner.files


def _merge(a, b):
    """(owner id, owner row, rows, entries): the largest id owns, of repeated rows the first."""
    owner = a if (a[0], -a[1]) >= (b[0], -b[1]) else b
    a[3].extend(b[3])
    return owner[0], owner[1], a[2] + b[2], a[3]


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when the same after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest id stays; of repeated rows with that id, one. An empty table gives an empty one; a null id
    counts as smaller than all others; other columns are left out. A text of any length is taken whole.
    The table is read once; what both later steps need is written to the shared folder.
    """

    def local(batches: Iterator) -> Iterator:
        """Kind 0: a row and the entry that its task merged it into. Kind 1: an entry with its text."""
        from array import array

        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        kinds = (pa.int32(), *[pa.int64()] * 7, pa.binary(), pa.binary())

        def out(*columns):
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["kind", "doc_id", "row", "entry", "owner", "n", "n_bytes", "hash", "sha", "text"])

        def flush(trie, held):
            entry, part, size = {}, [], 0

            def texts_of(part):
                n, nothing = len(part), [None] * len(part)
                digest = [held[v[3][0] - first][2] for _, v in part]
                return out([1] * n, nothing, [v[1] for _, v in part], [v[3][0] for _, v in part], [v[0] for _, v in part], [v[2] for _, v in part], [len(k) for k, _ in part], [int.from_bytes(d[:8], "big", signed=True) for d in digest], nothing, [k for k, _ in part])

            first = held[0][1] if held else 0
            for key, v in trie.items():
                for x in v[3]:
                    entry[x] = v[3][0]
                part.append((key, v))
                size += len(key)
                if size > 8 << 20 or len(part) >= 5000:
                    yield texts_of(part)
                    part, size = [], 0
            if part:
                yield texts_of(part)
            for at in range(0, len(held), 20_000):
                rows = held[at : at + 20_000]
                nothing = [None] * len(rows)
                yield out([0] * len(rows), [x[0] for x in rows], [x[1] for x in rows], [entry[x[1]] for x in rows], nothing, nothing, nothing, nothing, [x[2] for x in rows], nothing)

        trie, held = Trie(_merge), []
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py().encode().lower()  # bytes: A-Z only
                trie.insert(text, (-(1 << 63) if doc_id is None else doc_id, row, 1, array("q", [row])))
                held.append((doc_id, row, hashlib.sha256(text).digest()))
                row += 1
                if trie.size > TRIE_BYTES or len(held) >= HELD_ROWS:
                    yield from flush(trie, held)
                    trie, held = Trie(_merge), []
        yield from flush(trie, held)

    def merged(batches: Iterator) -> Iterator:
        from array import array

        import pyarrow as pa

        trie = Trie(_merge, TRIE_BYTES)
        for batch in pieces(batches):
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for entry, owner, owner_row, n, text in zip(*columns, batch.column(6), strict=True):
                trie.insert(text.as_py(), (owner, owner_row, n, array("q", [entry])))
        out = ([], [], [], [])
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["entry", "keep_id", "keep_row", "group_size"])
        for _, (owner, owner_row, n, entries) in trie.items():
            for entry in entries:
                for column, x in zip(out, (entry, owner, owner_row, n), strict=True):
                    column.append(x)
                if len(out[0]) >= 20_000:
                    yield rows()
                    out = ([], [], [], [])
        yield rows()

    found = stored(texts(docs, id_col, text_col).mapInArrow(local, "kind int, doc_id long, row long, entry long, owner long, n long, n_bytes long, hash long, sha binary, text binary"))
    entries = found.where("kind = 1").select("entry", "owner", F.col("row").alias("owner_row"), "n", "n_bytes", "hash", "text")
    owned = entries.repartition(shuffle_width(docs.sparkSession), "n_bytes", "hash").mapInArrow(merged, "entry long, keep_id long, keep_row long, group_size long")
    members = found.where("kind = 0").select("doc_id", "row", "entry", "sha")
    keep = F.when(F.col("keep_id") > F.lit(-(1 << 63)), F.col("keep_id"))
    return members.join(owned, "entry").select("doc_id", keep.alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


#: The same rows over the table, for DuckDB.
OWNERS_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256 from d window w as (partition by t)
"""
