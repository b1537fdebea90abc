"""Operators on small fixtures whose results are known."""

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import catalogue, eviction, gates, ledger, pages, quorum, structures, timeseries


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_quorum_needs_every_rank_and_the_longest_prefix_wins(spark):
    held = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1), ("c", 1), ("b", 7)], "digest string, rank int")
    assert rows(quorum.full_quorum(held, 2), "digest") == [("a",), ("c",)]
    candidates = spark.createDataFrame([(1, 256, "a"), (1, 512, "c"), (1, 768, "b"), (2, 256, "b")], "request long, span long, digest string")
    assert rows(quorum.longest_prefix(candidates, held, 2), "request") == [(1, 512, "c")]
    spans = spark.createDataFrame([(1, 512)], "request long, publish_span long")
    assert rows(quorum.publication_base(candidates, held, 2, spans), "request") == [(1, 256, "a")]


def test_prefix_digests_leave_one_token(spark):
    import hashlib

    found = rows(quorum.prefix_digests(spark.createDataFrame([(1, "ab" * 4), (2, None), (3, "é中abc")], "request long, text string"), 4), "request", "span")
    digest = lambda s: hashlib.sha256(b"s\x00" + s.encode("utf-32-le")).hexdigest()
    assert found == [(1, 4, digest("abab")), (3, 4, digest("é中ab"))]


def test_capacity_gate_keeps_the_newest(spark):
    mb = 1 << 20
    roots = spark.createDataFrame([("k", str(i), 100, i, True, False) for i in (1, 2, 3)], "storage_key string, digest string, manifest_bytes long, mtime_ns long, valid boolean, protected boolean")
    refs = spark.createDataFrame([(str(i), f"c{i}") for i in (1, 2, 3)], "digest string, chunk string")
    objects = spark.createDataFrame([(f"c{i}", 2 * mb) for i in (1, 2, 3)], "chunk string, bytes long")
    done = eviction.maintain(roots, refs, objects, now_ns=10, ttl_ns=0, max_bytes=5 * mb, low_bytes=3 * mb)
    assert [r.evicted for r in done.orderBy("ord").collect()] == [True, True, False]


def test_eviction_matches_a_loop(spark):
    import random

    rnd = random.Random(5)
    for _ in range(3):
        n = 12
        roots = [("k", i, rnd.randrange(1, 9), rnd.randrange(6), rnd.random() > 0.2, rnd.random() > 0.8) for i in range(n)]
        refs = [(rnd.randrange(n), rnd.randrange(8)) for _ in range(25)]
        sizes = {c: rnd.randrange(1, 50) for c in range(10)}
        live = {(d, c) for d, c in refs if roots[d][4]}
        count = {c: sum(x == c for _, x in live) for c in sizes}
        before = sum(r[2] for r in roots) + sum(sizes.values())
        left, gone = before - sum(sizes[c] for c in sizes if not count[c]), []
        high, low = before * 8 // 10, before // 2
        phase = lambda r: 0 if not r[4] or 5 - r[3] >= 4 else 1
        for r in sorted((r for r in roots if not (r[4] and r[5])), key=lambda r: (phase(r), r[3], r[1])):
            if phase(r) == 0 or (before > high and left > low):
                gone.append(r[1])
                left -= r[2]
                for c in {c for d, c in live if d == r[1]}:
                    count[c] -= 1
                    left -= 0 if count[c] else sizes[c]
        done = eviction.maintain(
            spark.createDataFrame(roots, "storage_key string, digest int, manifest_bytes long, mtime_ns long, valid boolean, protected boolean"),
            spark.createDataFrame(refs, "digest int, chunk int"), spark.createDataFrame(list(sizes.items()), "chunk int, bytes long"),
            now_ns=5, ttl_ns=4, max_bytes=high, low_bytes=low,
        )
        assert [r.digest for r in done.where("evicted").orderBy("ord").collect()] == gone


def test_corrupt_exact_root_shadows_its_alias(spark):
    schema = "storage_key string, digest string, valid boolean"
    roots = spark.createDataFrame([("k", "a", False), ("k", "b", True)], schema)
    aliases = spark.createDataFrame([("k", "a", True), ("k", "c", True)], schema)
    asked = spark.createDataFrame([("k", x) for x in "abcd"], "storage_key string, digest string")
    assert rows(catalogue.lookup(asked, roots, aliases), "digest") == [("k", "a", False, "corrupt", "exact"), ("k", "b", True, "hit", "exact"), ("k", "c", True, "hit", "alias"), ("k", "d", False, "absent", "none")]


def test_shared_and_marginal_bytes(spark):
    roots = spark.createDataFrame([("one", 10, True), ("two", 11, True)], "digest string, manifest_bytes long, valid boolean")
    refs = spark.createDataFrame([("one", "d"), ("one", "e"), ("two", "d"), ("two", "0"), ("two", "0")], "digest string, chunk string")
    objects = spark.createDataFrame([("d", 100), ("e", 200), ("0", 300)], "chunk string, bytes long")
    assert rows(ledger.shared_bytes(roots, refs, objects), "digest") == [("one", 2, 1, 100, 210, 310), ("two", 2, 1, 100, 311, 411)]


def test_write_windows_judge_strictly(spark):
    writes = spark.createDataFrame([(0, 60, 120), (timeseries.HOUR_NS, 10, 100)], "at_ns long, unique long, staged long")
    found = timeseries.write_windows(writes, limit=100).orderBy("window_ns").collect()
    assert [(r.exceeded, r.over_bytes) for r in found] == [(True, 20), (False, 0)]
    assert [r.exceeded for r in timeseries.write_windows(writes, 24 * timeseries.HOUR_NS).collect()] == [None]


def test_nearest_rank_percentiles(spark):
    found = timeseries.latency_summary(spark.createDataFrame([(0.541123, True), (0.737336, True), (9.0, False)], "elapsed double, ok boolean")).first()
    assert (found.requests, found.succeeded, found.failed, found.p50, found.p95) == (3, 2, 1, 0.541123, 0.737336)


def test_heat_matches_a_loop(spark):
    import random

    rnd, window = random.Random(2), 16
    trace = [rnd.choice("aabbbc") for _ in range(100)]
    heat = {}
    for n, key in enumerate(trace, 1):
        heat[key] = min(5, heat.get(key, 0) + 1)
        if n % window == 0:
            heat = {k: v >> 1 for k, v in heat.items()}
    found = timeseries.heat(spark.createDataFrame([(k, n) for n, k in enumerate(trace, 1)], "key string, n long"), window, cap=5)
    assert dict(rows(found, "key")) == heat


def test_extension_replaces_a_partial_chunk(spark):
    base = spark.createDataFrame([("r", 0, 256, "a"), ("r", 256, 300, "b")], "digest string, start long, end long, chunk string")
    tail = spark.createDataFrame([("r", 256, 512, "c")], "digest string, start long, end long, chunk string")
    assert rows(structures.extend(base, tail, 256), "start") == [("r", 0, 256, "a", "base"), ("r", 256, 512, "c", "tail")]


def test_overlay_keeps_the_newest(spark):
    stages = spark.createDataFrame([("r", "l", 1, 0, 8), ("r", "l", 2, 4, 10), ("r", "l", 3, 4, 12)], "root string, layer string, stage int, start long, end long")
    assert rows(structures.overlay(stages), "stage") == [("r", "l", 1, 0, 4), ("r", "l", 3, 4, 12)]


def test_chain_walk_ends_at_a_missing_parent(spark):
    descriptors = spark.createDataFrame([("r", i, f"c{i}") for i in range(5)], "digest string, idx int, chunk string")
    segments = structures.chain_segments(descriptors, 2)
    tail = spark.createDataFrame([("r", "r/2")], "root string, segment string")
    assert rows(structures.walk_chains(segments, tail), "steps") == [("r", "r/2", 0), ("r", "r/1", 1), ("r", "r/0", 2)]


def test_chain_walk_has_no_depth_limit_and_ends_cycles(spark):
    links = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(150)] + [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")]
    segments = spark.createDataFrame(links, "segment string, parent string")
    tails = spark.createDataFrame([("long", "s149"), ("ring", "a"), ("two", "s1"), ("two", "s0"), ("none", "x")], "root string, segment string")
    found = rows(structures.walk_chains(segments, tails), "root", "steps", "segment")
    want = [("long", f"s{149 - k}", k) for k in range(150)] + [("ring", x, k) for k, x in enumerate("abcd")]
    assert found == [*want, ("two", "s0", 0), ("two", "s1", 0), ("two", "s0", 1)]


@pytest.mark.parametrize("degree", [1, 2, 4])
def test_shards_partition_positions(spark, degree):
    ranks = spark.range(degree).select(pages.owned_positions(F.lit(10), degree, F.col("id")).alias("p"))
    assert sorted(x for r in ranks.collect() for x in r.p) == list(range(10))
    assert spark.range(1).select(pages.owned_positions(F.lit(2), 4, F.lit(3)).alias("p")).first().p == []


def test_slots_follow_the_block_table(spark):
    found = spark.range(1).select(pages.slots(F.array(*map(F.lit, [0, 2, 4])), F.array(*map(F.lit, [3, 0, 5, 1])), 1, 2).alias("s")).first().s
    assert found == [3, 0, 5]


def test_rules_and_completeness(spark):
    df = spark.createDataFrame([(1, None), (5, True)], "x int, y boolean")
    assert [r[0] for r in df.orderBy("x").select(gates.reasons({"big": F.col("x") > 3, "flag": F.col("y")})).collect()] == ["", "big,flag"]
    seen = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    want = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(gates.completeness(seen, want), "k") == [("a", "repeated"), ("b", "missing"), ("z", "extra")]
