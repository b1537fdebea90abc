"""The catalogue's tables as views of the driver's tables, for Spark and for DuckDB.

roots from orders, references from lineitem, objects from part, rank reports from lineitem's
suppliers, write events from events. Money columns become integers before any sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(column: str):
    """Nanoseconds of a zone-less timestamp taken as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("storage_key"),
        F.col("o_orderkey").alias("digest"),
        (1000 + F.col("o_orderkey") % 97).alias("manifest_bytes"),
        nanos("o_orderdate").alias("mtime_ns"),
        (F.col("o_orderkey") % 50 != 0).alias("valid"),
        (F.col("o_orderkey") % 41 == 0).alias("protected"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing of a chunk by a root; a chunk may be listed more than once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("digest"), F.col("l_partkey").alias("chunk"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"), (F.col("p_size").cast("long") * 1000).alias("bytes"))


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("digest"), (F.col("l_suppkey") % 4).cast("int").alias("rank"))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select("event_id", nanos("ts").alias("at_ns"), F.col("event_type").alias("kind"), F.col("user_id").alias("key"), staged.alias("staged"), F.floor(staged * (F.col("event_id") % 5) / 5).cast("long").alias("unique"))


#: The same for DuckDB, as common table expressions.
SQL = {
    "roots": "roots as (select o_custkey as storage_key, o_orderkey as digest, 1000 + o_orderkey % 97 as manifest_bytes, epoch_us(o_orderdate) * 1000 as mtime_ns, o_orderkey % 50 <> 0 as valid, o_orderkey % 41 = 0 as protected from orders)",
    "refs": "refs as (select l_orderkey as digest, l_partkey as chunk from lineitem)",
    "objects": "objects as (select p_partkey as chunk, p_size::bigint * 1000 as bytes from part)",
    "held": "held as (select l_orderkey as digest, (l_suppkey % 4)::int as rank from lineitem)",
    "writes": 'writes as (select event_id, epoch_us(ts) * 1000 as at_ns, event_type as kind, user_id as key, floor(value * 100)::bigint as staged, floor(floor(value * 100)::bigint * (event_id % 5) / 5)::bigint as "unique" from events)',
}


def with_model(sql: str, *names: str) -> str:
    return f"with {', '.join(SQL[n] for n in names)}{', ' if sql.lstrip().startswith('with ') else ' '}{sql.strip().removeprefix('with ')}"
