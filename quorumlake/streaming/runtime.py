"""State machines of the write side: snapshot runtime, journal, rank report builder, capacity maintenance, snapshot ring."""

from __future__ import annotations

from .replay import Machine

#: What a journal, a report and a ring hold at most.
JOURNAL = {"pending": 8, "batch_tokens": 4096}
REPORT = {"page": 64, "history": 64}
RING_SLOTS = 3


def snapshot_runtime(state: dict, event: dict) -> list[dict]:
    """A context's batches, accepted and written in order; it commits only when all are written.

    Events: begin (batches), accept (batch), written (batch), failed (batch), commit, abort, drain. A batch is handed over only after the one before it;
    a failure or an abort is terminal: what is still open is drained once, and nothing is published.
    """
    say = lambda what, batch=None: {"seq": event["seq"], "what": what, "batch": batch}
    kind, batch = event["event"], event["batch"]
    if kind == "begin":
        if state.get("phase") in ("open", "aborting"):
            return [say("busy")]
        state.update(phase="open", batches=batch, accepted=0, handed=0, ready=[])
        return [say("begun")]
    if state.get("phase") == "aborting":
        if kind not in ("written", "failed", "drain"):
            return [say("aborted")]
        state["inflight"] = max(0, state["inflight"] - 1) if kind != "drain" else 0
        if state["inflight"]:
            return []
        state["phase"] = "idle"
        return [say("drained")]
    if state.get("phase") != "open":
        return [say("unknown")]
    if kind == "accept":
        if batch != state["accepted"] or batch >= state["batches"]:
            return [say("out_of_order", batch)]
        state["accepted"] += 1
        return [say("accepted", batch)]
    if kind == "written":
        if not state["handed"] <= batch < state["accepted"] or batch in state["ready"]:
            return [say("error", batch)]
        state["ready"].append(batch)
        out = []
        while state["handed"] in state["ready"]:  # batch n + 1 never before batch n
            state["ready"].remove(state["handed"])
            out.append(say("handed", state["handed"]))
            state["handed"] += 1
        return out
    if kind == "commit":
        if state["handed"] < state["batches"]:
            return [say("not_ready")]
        state["phase"] = "idle"
        return [say("committed")]
    inflight = state["accepted"] - state["handed"] - len(state["ready"])
    if kind == "failed":
        inflight -= 1
    if kind in ("failed", "abort"):
        if inflight <= 0:
            state["phase"] = "idle"
            return [say("aborted"), say("drained")]
        state.update(phase="aborting", inflight=inflight)
        return [say("aborted")]
    return [say("error", batch)]


def journal(state: dict, event: dict) -> list[dict]:
    """A journal of contiguous batches with bounded pending ones; the manifest stands last and names them all.

    Events: append (start, end), flushed, finish. An append that doesn't follow on is refused; one beyond the bound must wait.
    """
    if not state:
        state.update(end=0, pending=[], objects=0, closed=False)
    say = lambda what, objects=None: [{"seq": event["seq"], "what": what, "objects": objects, "end": state["end"]}]
    kind = event["event"]
    if state["closed"]:
        return say("closed")
    if kind == "append":
        if event["start"] != state["end"] or event["end"] <= event["start"]:
            return say("gap" if event["start"] > state["end"] else "duplicate")
        if len(state["pending"]) >= JOURNAL["pending"]:
            return say("wait")
        state["end"] = event["end"]
        state["pending"].append(event["end"])
        return say("pending")
    if kind == "flushed":
        if not state["pending"]:
            return say("nothing")
        state["pending"].pop(0)
        state["objects"] += 1
        return say("object", state["objects"])
    if state["pending"]:
        return say("unfinished")
    state["closed"] = True
    return say("manifest", state["objects"])


def report_builder(state: dict, event: dict) -> list[dict]:
    """A rank's reports: each holds one delta of the history, in turn, and one page of a rolling checkpoint.

    Events: change (added, removed) and report. A change beyond a page in size isn't kept as a delta: the checkpoint alone carries it.
    """
    if not state:
        state.update(held={}, sequence=0, history=[], cursor=0, items=[], cycle=0, index=0)
    if event["event"] == "change":
        held = state["held"]
        added = sorted({str(x) for x in event["added"]} - held.keys())
        removed = sorted({str(x) for x in event["removed"]} & held.keys())
        if not added and not removed:
            return []
        for x in removed:
            del held[x]
        held.update(dict.fromkeys(added, 1))
        state["sequence"] += 1
        if len(added) + len(removed) <= REPORT["page"]:
            state["history"] = [*state["history"], [state["sequence"], len(added), len(removed)]][-REPORT["history"] :]
            state["cursor"] %= len(state["history"])
        state.update(items=sorted(held), cycle=state["cycle"] + 1, index=0)
        return []
    pages = max(1, -(-len(state["items"]) // REPORT["page"]))
    begin = state["index"] * REPORT["page"]
    page = state["items"][begin : begin + REPORT["page"]]
    out = {"seq": event["seq"], "sequence": state["sequence"], "cycle": state["cycle"], "page": state["index"], "pages": pages, "n_held": len(state["held"]), "on_page": len(page), "delta": None}
    state["index"] += 1
    if state["index"] >= pages:
        state.update(index=0, cycle=state["cycle"] + 1)
    if state["history"]:
        out["delta"] = state["history"][state["cursor"] % len(state["history"])][0]
        state["cursor"] = (state["cursor"] + 1) % len(state["history"])
    return [out]


def maintenance(max_bytes: int, low_bytes: int, cooldown: int, retries: int = 3, budget: int = 0):
    """When a capacity pass runs, what it leaves, and when it is tried again.

    Events: stored (bytes), tick, busy (the store is locked). A pass starts over the high mark, not within the cooldown; a busy store is tried again up to the
    limit; with a budget a pass frees at most that much and leaves work pending, which overrides the cooldown.
    """

    def step(state: dict, event: dict) -> list[dict]:
        if not state:
            state.update(bytes=0, last=None, tries=0, pending=False)
        say = lambda what, freed=0: [{"seq": event["seq"], "what": what, "freed": freed, "bytes": state["bytes"]}]
        if event["event"] == "stored":
            state["bytes"] += event["bytes"]
            return []
        if state["bytes"] <= max_bytes and not state["pending"]:
            return say("idle")
        if not state["pending"] and state["last"] is not None and event["at"] - state["last"] < cooldown:
            return say("cooldown")
        if event["event"] == "busy":
            state["tries"] += 1
            if state["tries"] > retries:
                state.update(tries=0, last=event["at"], pending=False)
                return say("gave_up")
            return say("retry")
        wanted = max(0, state["bytes"] - low_bytes)
        freed = min(wanted, budget) if budget else wanted
        state.update(bytes=state["bytes"] - freed, tries=0, last=event["at"], pending=freed < wanted)
        return say("pending" if state["pending"] else "satisfied", freed)

    return step


def ring(state: dict, event: dict) -> list[dict]:
    """Slots of a snapshot ring: free, filling, ready, writing; a full ring drops a submission instead of waiting.

    Events: submit (context), complete, claim, release (slot), abandon (context). An abandoned slot that is filling or being written is dropped when that ends.
    """
    slots = state.setdefault("slots", [{"state": "free", "context": None, "dropped": False, "generation": 0} for _ in range(RING_SLOTS)])
    say = lambda what, slot=None: [{"seq": event["seq"], "what": what, "slot": slot, "free": sum(x["state"] == "free" for x in slots)}]
    kind, i = event["event"], event["slot"]
    free = lambda x: x.update(state="free", context=None, dropped=False)
    if kind == "submit":
        for at, x in enumerate(slots):
            if x["state"] == "free":
                x.update(state="filling", context=event["context"], dropped=False, generation=x["generation"] + 1)
                return say("submitted", at)
        return say("would_block")
    if kind == "abandon":
        found = [x for x in slots if x["state"] != "free" and x["context"] == event["context"]]
        for x in found:
            if x["state"] == "ready":
                free(x)
            else:
                x["dropped"] = True
        return say("abandoned", len(found))
    one = slots[i]
    if kind == "complete" and one["state"] == "filling":
        if one["dropped"]:
            free(one)
            return say("dropped", i)
        one["state"] = "ready"
        return say("ready", i)
    if kind == "claim" and one["state"] == "ready" and not one["dropped"]:
        one["state"] = "writing"
        return say("claimed", i)
    if kind == "release" and one["state"] in ("ready", "writing"):
        free(one)
        return say("released", i)
    return say("refused", i)


RUNTIME = Machine(snapshot_runtime, "seq", "seq long, what string, batch long")
WRITER = Machine(journal, "seq", "seq long, what string, objects long, end long")
BUILDER = Machine(report_builder, "seq", "seq long, sequence long, cycle long, page long, pages long, n_held long, on_page long, delta long")
RING = Machine(ring, "seq", "seq long, what string, slot long, free long")


def maintenance_machine(max_bytes: int, low_bytes: int, cooldown: int, retries: int = 3, budget: int = 0) -> Machine:
    return Machine(maintenance(max_bytes, low_bytes, cooldown, retries, budget), "seq", "seq long, what string, freed long, bytes long")
