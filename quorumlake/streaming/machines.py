"""The session state machines: prompt attribution, snapshot planning, shadow admission, rank reports, block leases."""

from __future__ import annotations

from .replay import Machine

#: What a planner, a report and a receiver hold at most.
PLAN = {"chunk": 256, "chunks_per_batch": 16, "inflight": 3, "sessions": 8}
REPORT_GAPS = 64
WINDOW_SECONDS = 30


def attribution(state: dict, event: dict) -> list[dict]:
    """How many prompt tokens of a request were reused or computed, over its attempts.

    Emits a running account after each finished prompt step and at the end. An attempt's reuse is counted when its first
    step shows where computing began; evidence that contradicts itself makes the account incomplete.
    """
    if not state:
        state.update(total=event["prompt_tokens"], local=0, external=0, computed=0, generation=0, sound=True, done=False, attempt=None)
    kind, generation = event["event"], event["preemptions"] or 0
    limit = lambda name: min(event[name] or 0, state["total"])
    account = lambda: {"seq": event["seq"], "local_reused": state["local"], "external_reused": state["external"], "computed": state["computed"], "complete": state["sound"] and state["done"]}
    if kind == "finished":
        return [account()]
    if generation < state["generation"]:
        state["sound"] = False  # an event of an attempt that is over
        return []
    now = state["attempt"]
    if kind == "preempted":
        state.update(generation=generation, attempt=None)
    elif kind == "admitted":
        if now and now["generation"] == generation and not now["again"]:
            return []  # a parked restore resumes: its first admission stands
        state["sound"] &= generation == state["generation"]
        local = limit("local_tokens")
        offered = min(event["external_tokens"] or 0, state["total"] - local)
        state.update(generation=generation, attempt={"generation": generation, "local": local, "offered": offered, "external": 0, "waiting": offered > 0, "counted": False, "progress": 0, "again": False})
    elif not now or now["generation"] != generation:
        state["sound"] = False
    elif kind == "restore_finalized":
        if now["counted"] or not now["waiting"]:
            state["sound"] = False
            return []
        prefix, good = limit("valid_prefix_tokens"), event["success"] is True
        now["local"] = min(now["local"], prefix)
        gained = max(prefix - now["local"], 0)
        state["sound"] &= gained <= now["offered"] and (good or not gained)
        now.update(waiting=False, again=event["success"] is False, external=min(gained, now["offered"]) if good else 0)
    elif kind == "prompt_step_completed" and not event["stale"]:
        start, end = limit("start_token"), limit("end_token")
        known = max(now["local"] + now["external"], now["progress"])
        state["sound"] &= not now["waiting"] and start <= known and end >= start
        if not now["counted"]:
            local = min(now["local"], start)
            state["local"] += local
            state["external"] += min(now["external"], start - local)
            now["counted"] = True
        state["computed"] += max(end - max(start, now["progress"]), 0)
        now["progress"] = max(now["progress"], end)
        state["done"] |= end == state["total"]
        return [account()]
    return []


def planner(state: dict, event: dict) -> list[dict]:
    """Batches of completed tokens to write behind, under caps that all requests of a key share.

    Events: begin (request, digest, span), offer (request, tokens), written (request, batch), commit, abort.
    """
    sessions = state.setdefault("sessions", {})
    kind, request = event["event"], str(event["request"])
    say = lambda what, batch=None, start=None, end=None: {"seq": event["seq"], "request": event["request"], "what": what, "batch": batch, "token_start": start, "token_end": end}
    one = sessions.get(request)
    if kind == "begin":
        if one:
            same = (one["digest"], one["span"]) == (event["digest"], event["tokens"])
            return [] if same else [say("error")]
        if any(x["digest"] == event["digest"] for x in sessions.values()):
            return [say("duplicate")]
        if len(sessions) >= PLAN["sessions"]:
            return [say("no_capacity")]
        if event["tokens"] <= 0 or event["tokens"] % PLAN["chunk"]:
            return [say("error")]
        sessions[request] = {"digest": event["digest"], "span": event["tokens"], "next": 0, "batches": 0, "open": []}
        return [say("admitted")]
    if not one:
        return [say("unknown")]
    if kind == "offer":
        if event["tokens"] < one["next"]:
            return [say("error")]
        end = min(event["tokens"], one["span"]) // PLAN["chunk"] * PLAN["chunk"]
        size = PLAN["chunk"] * PLAN["chunks_per_batch"]
        starts = range(one["next"], end, size)
        if sum(len(x["open"]) for x in sessions.values()) + len(starts) > PLAN["inflight"]:
            del sessions[request]
            return [say("backpressure")]
        out = []
        for start in starts:
            out.append(say("batch", one["batches"], start, min(start + size, end)))
            one["open"].append(one["batches"])
            one["batches"] += 1
        one["next"] = max(one["next"], end)
        return out
    if kind == "written":
        if event["batch"] not in one["open"]:
            return [say("error")]
        one["open"].remove(event["batch"])
        return [say("ready")] if one["next"] == one["span"] and not one["open"] else []
    if kind == "commit" and (one["next"] < one["span"] or one["open"]):
        return [say("error")]
    del sessions[request]
    return [say("committed" if kind == "commit" else "aborted")]


def admission(window: int, main: int, halve_after: int = 8192, cap: int = 255):
    """A window band and a main band; a key that leaves the window enters the main band if it is hotter than its victim."""

    def step(state: dict, event: dict) -> list[dict]:
        if not state:
            state.update(n=0, heat={}, window={}, main={})
        heat, young, old, key = state["heat"], state["window"], state["main"], str(event["item"])
        heat[key] = min(cap, heat.get(key, 0) + 1)
        state["n"] += 1
        if state["n"] % halve_after == 0:
            state["heat"] = heat = {k: v >> 1 for k, v in heat.items() if v > 1}
        for band, name in ((young, "window_hit"), (old, "main_hit")):
            if key in band:
                band[key] = band.pop(key)  # now the most recent
                return [{"seq": event["seq"], "reason": name}]
        young[key] = 1
        reason = "window"
        if len(young) > window:
            out = next(iter(young))
            del young[out]
            reason = "spare"
            if len(old) >= main:
                victim = next(iter(old))
                reason = "win" if heat.get(out, 0) > heat.get(victim, 0) else "loss"
                if reason == "win":
                    del old[victim]
            if reason != "loss":
                old[out] = 1
        return [{"seq": event["seq"], "reason": reason}]

    return step


def rank_reports(state: dict, event: dict) -> list[dict]:
    """A rank's held set from numbered deltas. A gap withdraws the rank until it closes; a new generation starts empty.

    Emits what changes for the quorum: the number held, zero while the rank isn't in step.
    """
    if state.get("generation") != event["generation"]:
        if event["generation"] in state.get("retired", []):
            return []
        retired = [*state.get("retired", []), *([state["generation"]] if "generation" in state else [])][-REPORT_GAPS:]
        state.clear()
        state.update(generation=event["generation"], retired=retired, at=0, held=[], waiting={}, lost=False)
    sequence = event["sequence"]
    if sequence <= state["at"]:
        return []
    waiting = state["waiting"]
    if len(waiting) >= REPORT_GAPS:
        state["lost"] = True  # only a full report helps from here on
    else:
        waiting.setdefault(str(sequence), [list(event["added"]), list(event["removed"])])
    while (delta := waiting.pop(str(state["at"] + 1), None)) is not None:
        state["held"] = sorted(set(state["held"]) - set(delta[1]) | set(delta[0]))
        state["at"] += 1
    in_step = not waiting and not state["lost"]
    return [{"seq": event["seq"], "at": state["at"], "in_step": in_step, "n_held": len(state["held"]) if in_step else 0}]


def block_leases(state: dict, event: dict) -> list[dict]:
    """Leases of blocks without overlap, up to 64 leases and 4,096 blocks; a request finishes when its leases end."""
    leases = state.setdefault("leases", {})
    name, say = str(event["lease"]), lambda what: [{"seq": event["seq"], "lease": event["lease"], "what": what}]
    if event["event"] == "release":
        return say("released" if leases.pop(name, None) else "unknown")
    taken = {b for x in leases.values() for b in x}
    wanted = list(event["blocks"])
    if name in leases or len(set(wanted)) < len(wanted) or not wanted:
        return say("error")
    if taken & set(wanted):
        return say("overlap")
    if len(leases) >= 64 or len(taken) + len(wanted) > 4096:
        return say("full")
    leases[name] = wanted
    return say("reserved")


ATTRIBUTION = Machine(attribution, "seq", "seq long, local_reused long, external_reused long, computed long, complete boolean")
PLANNER = Machine(planner, "seq", "seq long, request long, what string, batch long, token_start long, token_end long")
REPORTS = Machine(rank_reports, "seq", "seq long, at long, in_step boolean, n_held long")
LEASES = Machine(block_leases, "seq", "seq long, lease long, what string")


def admission_machine(window: int = 1024, main: int = 65_536, halve_after: int = 8192) -> Machine:
    return Machine(admission(window, main, halve_after), "seq", "seq long, reason string")


def chunk_ledger(state: dict, event: dict) -> list[dict]:
    """Published contexts and their chunks. A context that gives a chunk another size is rejected as a whole.

    Emits after each accepted event the bytes that only this context holds, and the ledger's total.
    """
    sizes, users, contexts = (state.setdefault(x, {}) for x in ("sizes", "users", "contexts"))
    state.setdefault("total", 0)
    name, say = str(event["context"]), lambda what, own=None: [{"seq": event["seq"], "context": event["context"], "what": what, "marginal_bytes": own, "total_bytes": state["total"]}]
    if event["event"] == "remove":
        for chunk in contexts.pop(name, []):
            users[chunk] -= 1
            if not users[chunk]:
                state["total"] -= sizes.pop(chunk)
                del users[chunk]
        return say("removed")
    given = list(zip(map(str, event["chunks"]), event["bytes"], strict=True))
    named = dict(given)
    if name in contexts or any(named[c] != b or sizes.get(c, b) != b for c, b in given):
        return say("rejected")
    contexts[name] = sorted(named)
    for chunk, size in named.items():
        state["total"] += 0 if chunk in sizes else size
        sizes[chunk] = size
        users[chunk] = users.get(chunk, 0) + 1
    return say("published", sum(b for c, b in named.items() if users[c] == 1))


def receiver(state: dict, event: dict) -> list[dict]:
    """Replicated transactions: begin, put, commit, abort, in generations; idle ones expire.

    Events carry their time, so a replay expires what a timer would. A repeated frame with the same digest is inert.
    """
    open_, last = state.setdefault("open", {}), state.setdefault("generations", {})
    say = lambda what, name=None: {"seq": event["seq"], "transaction": event["transaction"] if name is None else name, "what": what}
    out = []
    while open_ and event["at"] - open_[first := next(iter(open_))]["at"] >= WINDOW_SECONDS:  # in the order of their last event
        del open_[first]
        out.append(say("expired", int(first)))
    name, generation = str(event["transaction"]), event["generation"]
    if generation < last.get(name, 0):
        return [*out, say("stale")]
    now = open_.get(name)
    if event["event"] == "begin":
        if now and now["generation"] == generation:
            return [*out, say("duplicate")]
        last[name] = generation
        open_.pop(name, None)
        open_[name] = {"generation": generation, "at": event["at"], "frames": {}}
        return [*out, say("ok")]
    if not now or now["generation"] != generation:
        return [*out, say("rejected")]
    open_[name] = open_.pop(name) | {"at": event["at"]}
    now = open_[name]
    if event["event"] == "put":
        known = now["frames"].get(str(event["frame"]))
        if known is None and event["intact"]:
            now["frames"][str(event["frame"])] = event["digest"]
            return [*out, say("ok")]
        if known == event["digest"] and event["intact"]:
            return [*out, say("duplicate")]
        del open_[name]
        return [*out, say("aborted")]
    del open_[name]
    whole = event["event"] == "commit" and sorted(map(int, now["frames"])) == list(range(event["frame"]))
    return [*out, say("committed" if whole else "aborted")]


def cohort_admission(flights: int, members: int, cap_bytes: int):
    """Admission of reads to flights by evidence under caps on flights, members and bytes."""

    def step(state: dict, event: dict) -> list[dict]:
        open_, name = state.setdefault("flights", {}), str(event["evidence"])
        say = lambda what: [{"seq": event["seq"], "load": event["load"], "what": what}]
        one = open_.get(name)
        if event["event"] == "finish":
            if one is None:
                return say("unknown")
            state["bytes"] -= open_.pop(name)["bytes"]
            return say("finished")
        if one is None:
            if len(open_) >= flights or state.get("bytes", 0) + event["bytes"] > cap_bytes:
                return say("independent")
            open_[name] = {"members": 1, "bytes": event["bytes"]}
            state["bytes"] = state.get("bytes", 0) + event["bytes"]
            return say("leader")
        if one["members"] >= members:
            return say("independent")
        one["members"] += 1
        return say("member")

    return step


LEDGER = Machine(chunk_ledger, "seq", "seq long, context long, what string, marginal_bytes long, total_bytes long")
RECEIVER = Machine(receiver, "seq", "seq long, transaction long, what string")


def cohort_machine(flights: int = 8, members: int = 16, cap_bytes: int = 1 << 30) -> Machine:
    return Machine(cohort_admission(flights, members, cap_bytes), "seq", "seq long, load long, what string")


def revisions(state: dict, event: dict) -> list[dict]:
    """A set whose revision grows only with a real change; adding and removing sets at a time."""
    held, items = state.setdefault("held", {}), {str(x) for x in event["items"]}
    gone = {"union": set(), "difference": items & held.keys(), "intersection": held.keys() - items, "symmetric": items & held.keys()}[event["event"]]
    new = items - held.keys() if event["event"] in ("union", "symmetric") else set()
    for x in gone:
        del held[x]
    held.update(dict.fromkeys(sorted(new), 1))
    state["revision"] = state.get("revision", 0) + bool(gone or new)
    return [{"seq": event["seq"], "revision": state["revision"], "n_held": len(held)}]


def sender(window: int = 32, window_bytes: int = 64 << 20):
    """Frames in flight under a window of frames and bytes and an absolute credit; without a peer it stays local."""

    def step(state: dict, event: dict) -> list[dict]:
        if not state:
            state.update(sent=0, credit=0, flying={}, local=False)
        flying, say = state["flying"], lambda what: [{"seq": event["seq"], "what": what, "in_flight": len(flying)}]
        kind = event["event"]
        if kind == "credit":
            if event["n"] <= state["credit"]:
                return say("replayed")  # credits are absolute and only grow
            state["credit"] = event["n"]
            for k in [k for k in flying if int(k) < event["n"] - window]:
                del flying[k]
            return say("credit")
        if kind in ("lost", "joined"):
            state["local"] = kind == "lost"
            flying.clear()
            return say(kind)
        if state["local"]:
            return say("local_only")
        if state["sent"] >= state["credit"] or len(flying) >= window or sum(flying.values()) + event["n"] > window_bytes:
            return say("blocked")
        flying[str(state["sent"])] = event["n"]
        state["sent"] += 1
        return say("sent")

    return step


def timed_leases(ttl: int):
    """Single flights by digest; a lease that isn't renewed in time goes, and the next request leads anew."""

    def step(state: dict, event: dict) -> list[dict]:
        leases, name = state.setdefault("leases", {}), str(event["digest"])
        while leases and event["at"] - leases[first := next(iter(leases))] >= ttl:  # in the order of their renewal
            del leases[first]
        known = name in leases
        if event["event"] == "release":
            leases.pop(name, None)
            return [{"seq": event["seq"], "digest": event["digest"], "role": "released" if known else "unknown"}]
        leases.pop(name, None)
        leases[name] = event["at"]
        return [{"seq": event["seq"], "digest": event["digest"], "role": "follower" if known else "leader"}]

    return step


REVISIONS = Machine(revisions, "seq", "seq long, revision long, n_held long")
SENDER = Machine(sender(), "seq", "seq long, what string, in_flight long")


def lease_machine(ttl: int) -> Machine:
    return Machine(timed_leases(ttl), "seq", "seq long, digest long, role string")


def frames(state: dict, event: dict) -> list[dict]:
    """Frames out of a byte stream that comes in pieces of any size (hex text in ``piece``); a bad length ends the stream."""
    if state.get("broken"):
        return []
    data = state.get("rest", "") + event["piece"]
    out = []
    while len(data) >= 32:
        try:
            head, body = (int(bytes.fromhex(data[a : a + 16]), 16) for a in (0, 16))
        except ValueError:
            state["broken"] = True
            return [*out, {"seq": event["seq"], "header": None, "payload_bytes": None}]
        end = 32 + 2 * (head + body)
        if len(data) < end:
            break
        out.append({"seq": event["seq"], "header": bytes.fromhex(data[32 : 32 + 2 * head]).decode(), "payload_bytes": body})
        data = data[end:]
    state["rest"] = data
    return out


FRAMES = Machine(frames, "seq", "seq long, header string, payload_bytes long")
