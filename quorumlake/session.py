"""Session settings that every query assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings of a session made here; a session made elsewhere keeps its own sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster, submit with the same settings instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quorumlake").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df):
    """The same rows from files in the checkpoint folder; a local folder is set only where none is named and the master is local."""
    import tempfile

    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quorumlake-"))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares."""
    import uuid

    cut(spark.range(0))  # sees to it that there is a shared folder
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/t-{uuid.uuid4().hex}"


#: Bytes of stored tables for each partition of a large shuffle.
PART_BYTES = 8 << 20


def parts(*frames) -> int:
    """Partitions for a shuffle of what frames read of stored tables, by the files' bytes; 0 where the cores are as many.

    Adaptive execution joins partitions until there is one for each core, so what a task sorts and hashes would grow with the tables.
    """
    found = {}
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for leaf in map(leaves.apply, range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRelation":
                found[leaf.relation().toString() + leaf.relation().location().rootPaths().toString()] = int(leaf.relation().sizeInBytes())
    n = -(-sum(found.values()) // PART_BYTES)
    return n if n > frames[0].sparkSession.sparkContext.defaultParallelism else 0


def deal(df, n: int, *keys):
    """Rows hashed by keys to n partitions; 0 leaves their number to the session."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)
