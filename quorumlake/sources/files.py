"""Reading and writing a catalogue's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, bytes and modification time of every file below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("modified_us"))


def entries(files: DataFrame, path: str) -> DataFrame:
    """Name, bytes and last modification of what lies directly in the scanned folder: a file, or a folder with all files below it."""
    spark = files.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    depth = root.getFileSystem(spark._jsc.sc().hadoopConfiguration()).makeQualified(root).depth()
    inner = F.split(F.regexp_replace("path", r"^[^:/]+:(//[^/]*)?(?=/)", ""), "/")
    return files.groupBy(F.element_at(inner, depth + 2).alias("name")).agg(F.sum("bytes").alias("bytes"), F.max("modified_us").alias("modified_us"))


def read_chunks(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(chunk, content) of stored chunk files, named by their digest; only the wanted names if given."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = found.select(F.regexp_extract("path", r"([0-9a-f]{64})\.[^/]*$", 1).alias("chunk"), "content").where("chunk <> ''")
    return named if wanted is None else named.join(wanted.select("chunk").distinct(), "chunk", "left_semi")


def read_strict_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a closed schema; a malformed line or an unknown or missing field fails the read."""
    return strict_json(spark.read.text(path), schema)


def strict_json(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The same of a table of lines (value)."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in want]
    lines = lines.where(F.length(F.trim("value")) > 0)
    keys = F.array_sort(F.json_object_keys("value"))
    checked = lines.withColumn("value", F.when(keys == F.array(*map(F.lit, sorted(names))), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("fields differ: "), F.col("value")))))
    return checked.select(F.from_json("value", want, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def parse_roots(manifests: DataFrame) -> DataFrame:
    """One row for each manifest (path, text, modified_ns): key, size, references and whether it is valid.

    A root whose JSON doesn't parse, whose chunks aren't contiguous, or which gives one chunk two sizes is invalid
    and has no references.
    """
    shape = "struct<storage_key:string,context_digest:string,committed_tokens:bigint,chunks:array<struct<sha256:string,bytes:bigint,logical_start:bigint,logical_end:bigint>>>"
    x = manifests.withColumn("m", F.from_json("text", shape))
    chunks = F.col("m.chunks")
    follows = F.forall(F.transform(chunks, lambda c, i: c["logical_start"] == F.when(i == 0, 0).otherwise(F.get(chunks, i - 1)["logical_end"])), lambda ok: ok)
    one_size = F.size(F.array_distinct(F.transform(chunks, lambda c: c["sha256"]))) == F.size(F.array_distinct(F.transform(chunks, lambda c: F.struct(c["sha256"], c["bytes"]))))
    ends = F.element_at(chunks, -1)["logical_end"] == F.col("m.committed_tokens")
    valid = F.coalesce((F.size(chunks) > 0) & follows & one_size & ends & F.col("m.context_digest").rlike("^[0-9a-f]{64}$"), F.lit(False))
    refs = F.when(valid, F.array_distinct(F.transform(chunks, lambda c: F.struct(c["sha256"].alias("chunk"), c["bytes"].alias("bytes"))))).otherwise(F.array().cast("array<struct<chunk:string,bytes:bigint>>"))
    return x.select("path", F.col("m.storage_key").alias("storage_key"), F.col("m.context_digest").alias("digest"), F.octet_length("text").cast("long").alias("manifest_bytes"), F.col("modified_ns").alias("mtime_ns"), valid.alias("valid"), refs.alias("refs"))


def write_roots(roots: DataFrame, path: str) -> None:
    """Appends roots, a folder for each namespace, so that a scan of one namespace reads its folder only."""
    roots.write.mode("append").partitionBy("storage_key").parquet(path)
