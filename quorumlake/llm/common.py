"""What several operators share: column picking, Arrow helpers, the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an Arrow batch may hold; a single longer text is a batch of its own.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table; a null text is the empty text. Other columns are not read."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


#: Paths of the intermediate tables that this process wrote; ``discard`` deletes them.
MADE: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster shares. A local one is made only where none is named and the driver runs the tasks itself."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quorumlake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    MADE.append(path := f"{shared_base(spark)}/q-{uuid.uuid4().hex}")
    return path


def discard(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the intermediate tables but for the first ``keep``; what still reads them must have been stored before."""
    jvm = spark.sparkContext._jvm
    while len(MADE) > keep:
        path = jvm.org.apache.hadoop.fs.Path(MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder, with the lineage cut: survives the loss of any executor."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from Parquet files in the shared folder: columns that a reader doesn't need aren't read."""
    df.write.parquet(path := shared_folder(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(columns: list[str], name: str) -> str:
    """``name``, with closing underscores until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with a row number, and that column's name, which is free.

    It is written once, so each reader sees the same numbers, however the tasks of a later scan are cut.
    """
    name = free(docs.columns, "row__")
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Inner join with a ``right`` (cut or stored) of one row for each key, whose column ``n`` counts the key's rows in ``left``.

    A key with more than a quarter of a task's even share is dealt over several tasks by the columns ``spread``,
    and its right row goes to each of them. There are at most four such keys for each task: that bounds the broadcast.
    """
    tasks = shuffle_width(right.sparkSession)
    total = right.agg(F.sum("n")).first()[0] or 0
    share = max(64, total // (4 * tasks))
    parts, part = free([*left.columns, *right.columns], "parts__"), free([*left.columns, *right.columns], "part__")
    hot = right.where(F.col("n") > share).select(*keys, F.least(F.ceil(F.col("n") / share), F.lit(4 * tasks)).cast("int").alias(parts))
    if hot.isEmpty():
        return left.join(right.drop("n"), keys)
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*spread), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    copies = right.join(F.broadcast(hot), keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts, "n")
    return dealt.join(copies, [*keys, part]).drop(part)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches, size: int = BATCH_BYTES):
    """Arrow batches cut so that each has about ``size`` bytes at most: what a task holds at once stays bounded."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20):
    """What is run meanwhile gets Arrow batches of about ``size`` bytes, not 64 MB, which the executor and its Python workers would hold at once.

    A single longer row is a batch of its own. The session's own setting comes back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def column_bytes(batch, name: str) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [x or b"" for x in column.to_pylist()]
