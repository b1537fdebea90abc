"""Operator 4: repeated line runs by a suffix array over line IDs, built by distributed prefix doubling.

Lines that occur once end every repeated run, so only the others get an ID and a place in the array. Each round
ranks all suffixes by twice as many lines: a range-partitioned sort of the distinct pairs of
ranks names the pairs in order. A suffix's ranks by 1, 2, 4, ... lines are its key: sorting by them gives the suffix array,
and the levels at which neighbours agree tell their common prefix. A run counts from ``min_words`` words on, so each
suffix needs a number of lines, and neighbours whose common prefix has as many lie in one interval. Of an interval all but
the earliest copy are deleted, and overlapping deletions make up the maximal runs. Rounds stop when
ranks reach the longest run needed: deeper ranks can't change a deletion.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free, join_hot, numbered, pieces, shuffle_width


def lines(rows: DataFrame) -> DataFrame:
    """row, doc_id, idx, h1, h2 (128 bits of a line's hash), words; from (row, doc_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in pieces(batches, 4 << 20):
            found = [t.as_py().encode().split(b"\n") for t in batch.column(2)]
            sizes = np.array([len(x) for x in found], np.int64)
            owner = np.repeat(np.arange(len(found)), sizes)
            flat = [x for xs in found for x in xs]
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in flat]), ">i8").astype(np.int64).reshape(-1, 2)
            idx = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(idx.astype(np.int32)), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array([len(x.split()) for x in flat], pa.int32())], names=["row", "doc_id", "idx", "h1", "h2", "words"])

    return rows.mapInArrow(run, "row long, doc_id long, idx int, h1 long, h2 long, words int")


def needed(idx, words, min_words: int):
    """Lines that a run from each position needs for ``min_words`` words; 0 where its segment ends before."""
    import numpy as np

    n = len(idx)
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(total, total[:-1] + min_words, "left")  # first end with enough words
    breaks = np.flatnonzero(np.diff(idx) != 1) + 1
    stop = np.append(breaks, n)[np.searchsorted(breaks, np.arange(n), "right")]  # end of the position's segment
    end = np.maximum(end, np.arange(n) + 1)
    return np.where(end <= stop, end - np.arange(n), 0), stop


def repeated_runs(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """The numbered table; (row, runs array of (idx, m lines)) of the later copies; the row number's name."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    table, name = numbered(docs)
    source = table.select(F.col(name).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = lines(source)
    repeated = cut(found.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")).withColumn("id", F.monotonically_increasing_id())
    sequence = F.array_sort(F.collect_list(F.struct("idx", "id", "words")))
    state = join_hot(found, repeated, ["h1", "h2"], ["row", "idx"]).groupBy("row").agg(F.first("doc_id").alias("doc_id"), sequence.alias("s")).select("row", "doc_id", F.col("s.idx").alias("idx"), F.col("s.words").alias("words"), F.col("s.id").alias("l0"))

    def longest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches, 2 << 20):
            out = [int(needed(np.array(i), np.array(w), min_words)[0].max(initial=0)) for i, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=["row", "doc_id", "idx", "words", "l0", "need"])

    state = cut(state.mapInArrow(longest, "row long, doc_id long, idx array<int>, words array<int>, l0 array<long>, need int").where("need > 0"))
    most = state.agg(F.max("need")).first()[0] or 0
    level = 0
    while 2 << level <= most:
        span = 1 << level

        def pairs(batches: Iterator, span=span) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in pieces(batches, 2 << 20):
                for row, idx, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    idx, rank = np.array(idx), np.array(rank, np.int64)
                    after = np.full(len(idx), -1, np.int64)
                    if len(idx) > span:
                        after[:-span] = np.where(idx[span:] - idx[:-span] == span, rank[span:], -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), row)), pa.array(np.arange(len(idx), dtype=np.int32)), pa.array(rank), pa.array(after)], names=["row", "p", "r", "after"])

        pair = state.where(F.col("need") >= 2 * span).select("row", "idx", f"l{level}").mapInArrow(pairs, "row long, p int, r long, after long")
        distinct = pair.groupBy("r", "after").agg(F.count("*").alias("n"))
        named = cut(distinct.repartitionByRange(width, "r", "after").sortWithinPartitions("r", "after").withColumn("rank", F.monotonically_increasing_id()))
        level += 1
        ranked = join_hot(pair, named, ["r", "after"], ["row", "p"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", "rank"))).alias("x")).select("row", F.col("x.rank").alias(f"l{level}"))
        state = cut(state.join(ranked, "row", "left"))

    def starts(batches: Iterator) -> Iterator:
        """Of each suffix that a run may begin at its ranks by 1, 2, 4, ... lines within the lines it needs, and the rank that ends with them."""
        import numpy as np
        import pyarrow as pa

        for batch in pieces(batches, 2 << 20):
            for row in batch.to_pylist():
                idx = np.array(row["idx"])
                need, _ = needed(idx, np.array(row["words"]), min_words)
                at = np.flatnonzero(need)
                m = need[at]
                power = np.frexp(m)[1] - 1  # of the last power of two up to m
                sizes = power + 2
                begin = np.concatenate(([0], np.cumsum(sizes)))
                key = np.zeros(begin[-1], np.int64)
                for t in range(int(power.max(initial=-1)) + 1):
                    rank, which = np.array(row[f"l{t}"], np.int64), power >= t
                    key[begin[:-1][which] + t] = rank[at[which]]
                    last = power == t
                    key[begin[1:][last] - 1] = rank[at[last] + m[last] - (1 << t)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(key)), pa.array(np.full(len(at), row["row"])), pa.array([row["doc_id"]] * len(at), pa.int64()), pa.array(idx[at].astype(np.int32)), pa.array(m.astype(np.int32))], names=["key", "row", "doc_id", "idx", "m"])

    place = ["key", "m", "doc_id", "row", "idx"]
    run = cut(state.mapInArrow(starts, "key array<long>, row long, doc_id long, idx int, m int"))
    array = cut(run.repartitionByRange(width, *place).sortWithinPartitions(*place))

    def final(batches: Iterator) -> Iterator:
        """The last suffix of each part of the array."""
        import pyarrow as pa
        from pyspark import TaskContext

        last = None
        for batch in batches:
            if batch.num_rows:
                last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), last.column(0), last.column(4)], names=["part", "key", "m"])

    # one row for each part, whose number is the shuffle's
    before = {r.part: (list(r.key), r.m) for r in array.mapInArrow(final, "part int, key array<long>, m int").collect()}

    def intervals(batches: Iterator) -> Iterator:
        """The suffixes whose common prefix with the one before them has the lines that they need: later copies."""
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key, m = before[max(x for x in before if x < part)] if any(x < part for x in before) else ([], 0)
        for batch in pieces(batches, 4 << 20):
            n = batch.num_rows
            if not n:
                continue
            column, need = batch.column(0), batch.column(4).to_numpy()
            ends = np.cumsum(np.concatenate(([len(key)], column.value_lengths().to_numpy())))
            flat = np.concatenate((np.array(key, np.int64), column.flatten().to_numpy()))
            need_before = np.concatenate(([m], need[:-1]))
            size = np.diff(ends)
            size_before = np.concatenate(([len(key)], size[:-1]))
            same = (need == need_before) & (size == size_before)  # a shorter key is a prefix that needs fewer lines
            at = np.flatnonzero(same)
            for t in range(int(size.max())):  # level by level, down to the rank that ends with the last line needed
                open_ = at[size[at] > t]
                differ = open_[flat[ends[open_] + t] != flat[ends[open_] - size_before[open_] + t]]
                same[differ] = False
                at = at[same[at]]
            key, m = flat[ends[-2] :].tolist(), int(need[-1])
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(same)) for i in (1, 3, 4)], names=["row", "idx", "m"])

    later = array.select("key", "row", "doc_id", "idx", "m").mapInArrow(intervals, "row long, idx int, m int")
    return table, later.groupBy("row").agg(F.collect_list(F.struct("idx", "m")).alias("runs")), name


def dedup_lines(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the table, the text without later copies of repeated runs, and last ``dedup__`` (n_lines, n_deleted, n_runs).

    Lines end at line feeds. Of equal runs the one in the smallest id stays, of these the first row's, of these the
    first in the text; a null id counts as smallest. A null text has no lines and stays null; an
    empty text is one empty line; repeated rows are copies of each other; an empty table gives an empty one. If a column
    has the name ``dedup__``, the added one gets another underscore.
    """
    table, runs, name = repeated_runs(docs, min_words, id_col, text_col)
    run_row, run_list = free(table.columns, "run_row__"), free(table.columns, "runs__")
    runs = runs.select(F.col("row").alias(run_row), F.col("runs").alias(run_list))
    joined = table.join(runs.hint("shuffle_hash"), F.col(name) == F.col(run_row), "left")
    place = docs.columns.index(text_col)
    width = len(docs.columns)
    added = free(docs.columns, "dedup__")

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches, 4 << 20):
            out = []
            for text, found in zip(batch.column(place), batch.column(width), strict=True):
                text, found = text.as_py(), found.as_py()
                if text is None:
                    out.append((None, 0, 0, 0))
                    continue
                parts = text.split("\n")
                if not found:
                    out.append((text, len(parts), 0, 0))
                    continue
                drop = {i for x in found for i in range(x["idx"], x["idx"] + x["m"])}
                left = "\n".join([x for i, x in enumerate(parts) if i not in drop])
                out.append((left, len(parts), len(drop), sum(i - 1 not in drop for i in drop)))
            columns = batch.columns[:width]
            columns[place] = pa.array([x[0] for x in out], columns[place].type)
            counts = pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.int32()) for k in (1, 2, 3)], names=["n_lines", "n_deleted", "n_runs"])
            yield pa.RecordBatch.from_arrays([*columns, counts], names=[*docs_columns, added])

    docs_columns = docs.columns
    counts = T.StructType.fromDDL("n_lines int, n_deleted int, n_runs int")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField(added, counts)])
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(run_list)).mapInArrow(apply, schema)


def drop_copies(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``dedup_lines`` without the added column and without those of which deletions left no word; all text that is left stays."""
    done = dedup_lines(docs, min_words, id_col, text_col)
    added = done.columns[-1]
    left = (F.col(f"{added}.n_deleted") == 0) | F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"\S")
    return done.where(left).drop(added)
