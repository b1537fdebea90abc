"""What grows faster than the input, or costs more than it need: plans that repeat a step, tasks that hold more as tables grow."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from quorumlake.functions import hashing
from quorumlake.plans import catalogue, deltas, details, storage  # noqa: F401  the others register their queries


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_health_pages_are_encoded_once(spark, sf_dir):
    plan = optimized(catalogue.QUERIES["S16_smart_pages"](spark, sf_dir))
    assert plan.count("unhex(") == 1 and plan.count("conv(") <= 40


def test_little_endian_integers(spark):
    values = [0, 1, 258, (1 << 64) - 1, 1 << 64, 10**38 - 1, 10**38, (1 << 128) - 1]
    pages = spark.createDataFrame([(k, bytearray(b"x" + v.to_bytes(16, "little"))) for k, v in enumerate(values)] + [(len(values), bytearray(b"x" + b"\1" * 15))], "k int, b binary")
    found = pages.select("k", hashing.little_endian(F.col("b"), 1, 16).alias("v"), hashing.little_endian(F.col("b"), 1, 2).alias("two"), hashing.little_endian(F.col("b"), 1, 8).alias("eight")).orderBy("k").collect()
    assert [None if r.v is None else int(r.v) for r in found] == [*values[:6], None, None, None]
    assert [int(r.two) for r in found[:8]] == [v & 0xFFFF for v in values]
    assert [int(r.eight) for r in found[:8]] == [v & (1 << 64) - 1 for v in values]


def test_a_table_in_parts_is_one_entry(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "all" / "parts.parquet"))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "all" / "single.parquet")
    for path in (tmp_path / "all", f"file:{tmp_path}/all/"):
        found = catalogue.QUERIES["S02_scan_files"](spark, str(path)).orderBy("name").collect()
        assert [tuple(r) for r in found] == [("parts.parquet", True, True), ("single.parquet", True, True)]


def test_shuffles_grow_with_the_tables(spark, sf_dir, monkeypatch):
    from quorumlake import session

    by = lambda name: [int(x) for x in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", optimized(catalogue.QUERIES[name](spark, sf_dir)))]
    names = ["A02_reference_counts", "J06_orphans", "A07_shared_bytes", "Z32_split_ranges", "S12_materialise_snapshot", "J11_zipped_tails"]
    size = Path(f"{sf_dir}/lineitem.parquet").stat().st_size
    monkeypatch.setattr(session, "PART_BYTES", size // 40)
    for name in names:
        assert by(name) and min(by(name)) >= 40, name
    monkeypatch.setattr(session, "PART_BYTES", size)
    for name in names:
        assert not by(name), name  # small tables leave the number to the session


def test_pages_are_not_sorted(spark, sf_dir):
    for name in ("S12_materialise_snapshot", "S12_every_root_kind", "J11_zipped_tails"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan, name


def test_headers_and_records_are_read_once(spark, sf_dir):
    for name, step, most in (("S14_delta_headers", "conv(", 8), ("T03_delta_plans", "conv(", 8), ("T03_delta_plans", "StructsToJsonEvaluator", 1), ("H16_packed_records", "from_json", 1), ("H16_packed_records", "conv(", 4)):
        assert 1 <= optimized(catalogue.QUERIES[name](spark, sf_dir)).count(step) <= most, (name, step)


def test_restore_joins_by_bytes_and_misses_what_is_no_digest(spark):
    from hashlib import sha256

    from quorumlake.operators import storage as S

    good, bad = sha256(b"a").hexdigest(), sha256(b"b").hexdigest()
    refs = spark.createDataFrame([(1, 0, good), (1, 1, good), (2, 0, good.upper()), (3, 0, "x"), (4, 0, bad), (5, 0, "0" * 64)], "digest int, idx int, chunk string")
    payloads = spark.createDataFrame([(good, bytearray(b"a")), (bad, bytearray(b"c")), ("x", bytearray(b"x"))], "chunk string, content binary")
    found = S.restore(refs, payloads)
    assert [(r.digest, r.ok, r.chunks, r.payload and bytes(r.payload)) for r in found.orderBy("digest").collect()] == [(1, True, 2, b"aa"), (2, False, 1, None), (3, False, 1, None), (4, False, 1, None), (5, False, 1, None)]
    assert "unhex" in optimized(found)
