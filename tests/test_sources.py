"""Files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import gates, storage
from quorumlake.sources import files
from quorumlake.streaming.publish import publish_stream


def test_strict_json(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text('{"a": 1, "b": "x"}\n\n{"b": "y", "a": 2}\n')
    bad.write_text('{"a": 1, "b": "x", "c": 0}\n')
    assert [tuple(r) for r in files.read_strict_json(spark, str(good), "a long, b string").orderBy("a").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="fields differ"):
        files.read_strict_json(spark, str(bad), "a long, b string").collect()


def test_roots_are_checked(spark):
    chunk = lambda c, size, a, b: {"sha256": c, "bytes": size, "logical_start": a, "logical_end": b}
    root = lambda tokens, *chunks: json.dumps({"storage_key": "k", "context_digest": "a" * 64, "committed_tokens": tokens, "chunks": chunks})
    rows = [("good", root(512, chunk("x", 1, 0, 256), chunk("x", 1, 256, 512))), ("gap", root(512, chunk("x", 1, 0, 256), chunk("y", 1, 300, 512))), ("sizes", root(512, chunk("x", 1, 0, 256), chunk("x", 2, 256, 512))), ("short", root(600, chunk("x", 1, 0, 256))), ("junk", "{")]
    found = {r.path: (r.valid, len(r.refs)) for r in files.parse_roots(spark.createDataFrame(rows, "path string, text string").withColumn("modified_ns", F.lit(0))).collect()}
    assert found == {"good": (True, 1), "gap": (False, 0), "sizes": (False, 0), "short": (False, 0), "junk": (False, 0)}


def test_chunk_files_round_trip(spark, tmp_path):
    import hashlib

    for content in (b"one", b"two"):
        (tmp_path / f"{hashlib.sha256(content).hexdigest()}.chunk").write_bytes(content)
    found = files.read_chunks(spark, str(tmp_path))
    assert {bytes(r.content) for r in found.collect()} == {b"one", b"two"}
    refs = found.select(F.lit("r").alias("digest"), F.when(F.col("content") == F.lit(b"one"), 0).otherwise(1).alias("idx"), "chunk")
    restored = storage.restore(refs, found).first()
    assert restored.ok and bytes(restored.payload) == b"onetwo"
    assert files.scan_files(spark, str(tmp_path), "*.chunk").count() == 2


def test_stream_is_published_once(spark, tmp_path):
    schema = "digest string, chunk string, bytes long, manifest_bytes long"
    for i in range(2):
        spark.createDataFrame([(f"r{i}", "c0", 5, 10), (f"r{i}", f"c{i}", 5, 10)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        publish_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.digest for r in spark.read.parquet(str(tmp_path / "out/roots")).collect()) == ["r0", "r1"]


def test_matrix_decision(spark):
    cells = [("managed", 2, 0.02, 80.0), ("managed", 3, 0.01, 70.0), ("pinned", 2, 0.004, 100.0), ("pinned", 3, 0.0, 60.0)]
    found = gates.matrix_decision(spark.createDataFrame(cells, "mode string, depth int, block_rate double, p95 double")).first()
    assert tuple(found) == (3, 2, "managed")
