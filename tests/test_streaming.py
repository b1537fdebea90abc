"""State machines: known scenarios, and a stream gives what the batch replay gives."""

import pytest

from quorumlake.streaming import machines, runtime
from quorumlake.streaming.replay import replay, stream


def play(step, events, **fixed):
    state, out = {}, []
    for seq, event in enumerate(events):
        out += step(state, {"seq": seq, **fixed, **event})
    return out


def test_planner_emits_contiguous_batches():
    events = [{"event": "begin", "digest": "d", "tokens": 8192}, {"event": "offer", "tokens": 4096}, {"event": "offer", "tokens": 8192}, {"event": "written", "batch": 0}, {"event": "written", "batch": 1}, {"event": "commit"}]
    found = play(machines.planner, events, request=1)
    assert [(x["what"], x["token_start"], x["token_end"]) for x in found] == [("admitted", None, None), ("batch", 0, 4096), ("batch", 4096, 8192), ("ready", None, None), ("committed", None, None)]


def test_planner_refuses_duplicates_and_backpressure():
    events = [{"event": "begin", "request": 1, "digest": "d", "tokens": 1 << 15}, {"event": "begin", "request": 2, "digest": "d", "tokens": 256}, {"event": "offer", "request": 1, "tokens": 1 << 15}]
    assert [x["what"] for x in play(machines.planner, events)] == ["admitted", "duplicate", "backpressure"]


def test_attribution_counts_a_verified_restore():
    none = dict.fromkeys(("local_tokens", "external_tokens", "valid_prefix_tokens", "start_token", "end_token", "success", "stale"))
    events = [{"event": "admitted", "local_tokens": 128, "external_tokens": 256}, {"event": "restore_finalized", "valid_prefix_tokens": 384, "success": True}, {"event": "prompt_step_completed", "start_token": 384, "end_token": 512}]
    found = play(machines.attribution, [none | e for e in events], prompt_tokens=512, preemptions=0)
    assert found[-1] == {"seq": 2, "local_reused": 128, "external_reused": 256, "computed": 128, "complete": True}


def test_rank_reports_withdraw_over_a_gap():
    events = [{"sequence": 1, "added": ["a"], "removed": []}, {"sequence": 3, "added": ["c"], "removed": ["a"]}, {"sequence": 2, "added": ["b"], "removed": []}]
    assert [(x["in_step"], x["n_held"]) for x in play(machines.rank_reports, events, generation="g")] == [(True, 1), (False, 0), (True, 2)]


def test_leases_never_overlap():
    events = [{"event": "reserve", "lease": 1, "blocks": [1, 2]}, {"event": "reserve", "lease": 2, "blocks": [2, 3]}, {"event": "release", "lease": 1}, {"event": "reserve", "lease": 2, "blocks": [2, 3]}]
    assert [x["what"] for x in play(machines.block_leases, events)] == ["reserved", "overlap", "released", "reserved"]


def _leases(rnd, i):
    return i % 3, i, "reserve" if rnd.random() < 0.7 else "release", rnd.randrange(9), [rnd.randrange(20)]


def _ledger(rnd, i):
    chunks = rnd.sample(range(8), 2)
    return i % 3, i, "publish" if rnd.random() < 0.7 else "remove", rnd.randrange(9), chunks, [10 * c + rnd.randrange(5) // 4 for c in chunks]


def _receiver(rnd, i):
    return i % 3, i, rnd.choice(["begin", "put", "put", "commit"]), rnd.randrange(4), i // 40, 2 * i, rnd.randrange(2), "x", rnd.random() < 0.9


def _reports(rnd, i):
    return i % 3, i, rnd.choice(["change", "report"]), [rnd.randrange(300) for _ in range(40)], [rnd.randrange(300) for _ in range(9)]


STREAMS = {
    "leases": (machines.LEASES, "seq long, event string, lease long, blocks array<long>", _leases),
    "ledger": (machines.LEDGER, "seq long, event string, context long, chunks array<long>, bytes array<long>", _ledger),
    "receiver": (machines.RECEIVER, "seq long, event string, transaction long, generation long, at long, frame long, digest string, intact boolean", _receiver),
    "reports": (runtime.BUILDER, "seq long, event string, added array<long>, removed array<long>", _reports),
    "timed": (machines.lease_machine(9), "seq long, event string, at long, digest long", lambda rnd, i: (i % 3, i, rnd.choice(["request", "request", "release"]), i, rnd.randrange(4))),
}


@pytest.mark.parametrize("name", STREAMS)
def test_stream_equals_replay(spark, tmp_path, name):
    import random

    machine, schema, make = STREAMS[name]
    rnd, schema = random.Random(3), f"pool long, {schema}"
    data = [make(rnd, i) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(data[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    want = sorted(map(str, replay(table, "pool", machine).collect()))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream(source, "pool", machine).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(str, spark.table(name).collect())) == want


def test_ledger_rejects_a_conflict_as_a_whole():
    events = [
        {"event": "publish", "context": 1, "chunks": ["d", "e"], "bytes": [100, 200]},
        {"event": "publish", "context": 2, "chunks": ["e", "d"], "bytes": [50, 999]},
        {"event": "publish", "context": 3, "chunks": ["d", "0"], "bytes": [100, 300]},
        {"event": "remove", "context": 3},
    ]
    found = [(x["what"], x["marginal_bytes"], x["total_bytes"]) for x in play(machines.chunk_ledger, events)]
    assert found == [("published", 300, 300), ("rejected", None, 300), ("published", 300, 600), ("removed", None, 300)]


def test_receiver_handles_duplicates_staleness_and_expiry():
    put = {"event": "put", "digest": "x", "intact": True}
    events = [
        {"event": "begin", "at": 0, "generation": 2}, put | {"at": 1, "frame": 0, "generation": 2}, put | {"at": 2, "frame": 0, "generation": 2}, {"event": "begin", "at": 3, "generation": 1},
        put | {"at": 4, "frame": 1, "generation": 2}, {"event": "commit", "at": 5, "frame": 2, "generation": 2}, {"event": "begin", "at": 6, "generation": 3}, {"event": "commit", "at": 60, "frame": 0, "generation": 3},
    ]
    assert [x["what"] for x in play(machines.receiver, events, transaction=1)] == ["ok", "ok", "duplicate", "stale", "ok", "committed", "ok", "expired", "rejected"]


def test_cohorts_respect_their_caps():
    events = [{"event": "load", "load": i, "evidence": e, "bytes": 10} for i, e in enumerate("aabca")] + [{"event": "finish", "load": 9, "evidence": "a"}, {"event": "load", "load": 10, "evidence": "c", "bytes": 10}]
    assert [x["what"] for x in play(machines.cohort_admission(2, 2, 100), events)] == ["leader", "member", "leader", "independent", "independent", "finished", "leader"]


def test_runtime_hands_batches_over_in_order():
    event = lambda e, batch=None: {"event": e, "batch": batch}
    found = play(runtime.snapshot_runtime, [event("begin", 2), event("accept", 1), event("accept", 0), event("accept", 1), event("written", 1), event("commit"), event("written", 0), event("commit")])
    assert [(x["what"], x["batch"]) for x in found] == [("begun", None), ("out_of_order", 1), ("accepted", 0), ("accepted", 1), ("not_ready", None), ("handed", 0), ("handed", 1), ("committed", None)]
    found = play(runtime.snapshot_runtime, [event("begin", 3), event("accept", 0), event("accept", 1), event("failed", 0), event("accept", 2), event("written", 1), event("begin", 1)])
    assert [x["what"] for x in found] == ["begun", "accepted", "accepted", "aborted", "aborted", "drained", "begun"]


def test_journal_is_contiguous_and_bounded():
    event = lambda e, start=None, end=None: {"event": e, "start": start, "end": end}
    found = play(runtime.journal, [event("append", 0, 4), event("append", 8, 9), event("append", 0, 4), event("finish"), event("flushed"), event("finish"), event("append", 4, 5)])
    assert [x["what"] for x in found] == ["pending", "gap", "duplicate", "unfinished", "object", "manifest", "closed"]
    found = play(runtime.journal, [event("append", i, i + 1) for i in range(9)])
    assert [x["what"] for x in found] == ["pending"] * 8 + ["wait"]


def test_reports_take_turns():
    change = lambda added, removed=(): {"event": "change", "added": list(added), "removed": list(removed)}
    report = {"event": "report", "added": [], "removed": []}
    found = play(runtime.report_builder, [change(range(60)), change(range(60, 130)), change([], [1]), report, report, report, report])
    assert [(x["page"], x["pages"], x["n_held"], x["on_page"], x["delta"]) for x in found] == [(0, 3, 129, 64, 1), (1, 3, 129, 64, 3), (2, 3, 129, 1, 1), (0, 3, 129, 64, 3)]


def test_maintenance_waits_and_tries_again():
    step = runtime.maintenance(100, 40, 10, retries=1, budget=50)
    stored, at = lambda n: {"event": "stored", "bytes": n, "at": 0}, lambda e, t: {"event": e, "at": t, "bytes": 0}
    found = play(step, [at("tick", 0), stored(150), at("busy", 1), at("tick", 2), at("tick", 3), at("tick", 4), at("tick", 5), stored(200), at("tick", 6), at("busy", 20), at("busy", 21), at("tick", 22)])
    assert [(x["what"], x["freed"]) for x in found] == [("idle", 0), ("retry", 0), ("pending", 50), ("pending", 50), ("satisfied", 10), ("idle", 0), ("cooldown", 0), ("retry", 0), ("gave_up", 0), ("cooldown", 0)]


def test_ring_drops_instead_of_waiting():
    event = lambda e, context=None, slot=0: {"event": e, "context": context, "slot": slot}
    found = play(runtime.ring, [event("submit", c) for c in (1, 2, 3, 4)] + [event("claim"), event("complete"), event("claim"), event("abandon", 1), event("release"), event("abandon", 2), event("complete", slot=1), event("submit", 5)])
    assert [x["what"] for x in found] == ["submitted"] * 3 + ["would_block", "refused", "ready", "claimed", "abandoned", "released", "abandoned", "dropped", "submitted"]


def test_revisions_grow_only_with_a_change():
    events = [{"event": "union", "items": [1, 2]}, {"event": "union", "items": [2]}, {"event": "difference", "items": [3]}, {"event": "symmetric", "items": [2, 5]}, {"event": "intersection", "items": [5]}]
    assert [(x["revision"], x["n_held"]) for x in play(machines.revisions, events)] == [(1, 2), (1, 2), (1, 2), (2, 2), (3, 1)]


def test_timed_leases_expire_in_order():
    at = lambda t, d, e="request": {"event": e, "at": t, "digest": d}
    found = play(machines.timed_leases(10), [at(0, 1), at(5, 2), at(6, 1), at(12, 1), at(15, 2), at(16, 2, "release"), at(17, 2, "release")])
    assert [x["role"] for x in found] == ["leader", "leader", "follower", "follower", "leader", "released", "unknown"]
