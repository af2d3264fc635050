"""The session rules that need state: preparing questions ahead (T5), revealing batches (T4), limits and lockouts (T8, T9) and
single-use tokens (T9). Each answers a row with what happened, refusals included; folds.py runs them as stream and batch."""

from __future__ import annotations

from .folds import Machine

#: T5: which status may follow which; stale comes by itself only.
NEXT = {
    "idle": ("queued",),
    "queued": ("preparing", "failed"),
    "preparing": ("ready", "complete", "failed"),
    "ready": ("preparing", "complete", "failed"),
    "failed": ("queued",),
    "stale": ("queued",),
    "complete": (),
}
#: States in which somebody is expected to go on.
WAITING = ("queued", "preparing")


class Prefetch(Machine):
    """T5: rows (key, ms, event_id, status) -> event_id, at, before, after, accepted.

    A quiz that stays queued or preparing for longer than `stale_after` seconds becomes stale by itself (a row without
    event_id); from there, as from a failure, it can only be queued again. A row that asks for a status that may not follow
    is refused and changes nothing, its time neither. The earliest offset that was asked for stays known (start).
    """

    output = "event_id long, at long, before string, after string, accepted boolean"

    def __init__(self, key: str = "quiz_id", stale_after: int = 180):
        self.key, self.stale_after = key, stale_after

    def start(self) -> dict:
        return {"status": "idle", "at": 0}

    def due(self, state: dict) -> int | None:
        return state["at"] + 1000 * self.stale_after + 1 if state["status"] in WAITING else None

    def timeout(self, state: dict, at: int) -> list[dict]:
        before, state["status"], state["at"] = state["status"], "stale", at
        return [{"event_id": None, "at": at, "before": before, "after": "stale", "accepted": True}]

    def step(self, state: dict, row: dict) -> list[dict]:
        before, wanted = state["status"], row["status"]
        ok = wanted in NEXT[before]
        if ok:
            state["status"], state["at"] = wanted, int(row["ms"])
        return [{"event_id": row["event_id"], "at": int(row["ms"]), "before": before, "after": state["status"], "accepted": ok}]


class Reveal(Machine):
    """T4: rows (key, ms, event_id, kind, index, answer, target) -> event_id, loaded, accepted, reason, first_unanswered.

    kind open: a quiz of `target` questions begins, its first batch loaded; a new one takes the place of the old. answer: the
    letter to question `index`. next: the following batch is asked for by somebody who saw `index` questions; it comes if they
    are still all that is loaded and every one of them is answered. submit: the quiz ends.
    """

    output = "event_id long, loaded long, accepted boolean, reason string, first_unanswered long"

    def __init__(self, key: str = "quiz_id", batch: int = 5):
        self.key, self.batch = key, batch

    def start(self) -> dict:
        return {"loaded": 0, "target": 0, "answers": {}}

    def step(self, state: dict, row: dict) -> list[dict]:
        kind, reason, gap = row["kind"], None, None
        index = -1 if row.get("index") is None or row["index"] != row["index"] else int(row["index"])
        if kind == "open":
            target = int(row["target"])
            state.update(loaded=min(self.batch, target), target=target, answers={})
        elif not state["loaded"]:
            reason = "not active"
        elif kind == "answer":
            if 0 <= index < state["loaded"] and row["answer"] in ("A", "B", "C", "D"):
                state["answers"][str(index)] = row["answer"]
            else:
                reason = "invalid answer"
        elif kind == "next":
            missing = [i for i in range(state["loaded"]) if str(i) not in state["answers"]]
            if index != state["loaded"]:
                reason = "quiz_state_changed"
            elif missing:
                reason, gap = "incomplete_batch", missing[0]
            elif state["loaded"] >= state["target"]:
                reason = "nothing left"
            else:
                state["loaded"] = min(state["target"], state["loaded"] + self.batch)
        else:
            state.update(loaded=0, target=0, answers={})
        return [{"event_id": row["event_id"], "loaded": state["loaded"], "accepted": reason is None, "reason": reason, "first_unanswered": gap}]


class SlidingLimits(Machine):
    """Rows (key, ms, event_id) -> event_id, accepted, limited_by (seconds of the window that is full).

    limits: (how many, seconds) that hold at once. A row is let through if each window that ends with it holds fewer rows let
    through before than its limit; refused rows do not count. The state keeps times within the longest window only, at
    most as many as the largest limit.
    """

    output = "event_id long, accepted boolean, limited_by long"

    def __init__(self, key: str = "user_id", limits: tuple[tuple[int, int], ...] = ((5, 60), (20, 3600))):
        self.key, self.limits = key, limits

    def start(self) -> dict:
        return {"times": []}

    def step(self, state: dict, row: dict) -> list[dict]:
        now = int(row["ms"])
        longest = max(s for _, s in self.limits)
        state["times"] = [t for t in state["times"] if t > now - 1000 * longest]
        full = [s for n, s in self.limits if sum(t > now - 1000 * s for t in state["times"]) >= n]
        if not full:
            state["times"].append(now)
        return [{"event_id": row["event_id"], "accepted": not full, "limited_by": full[0] if full else None}]


class Lockout(Machine):
    """Rows (key, ms, event_id, kind) -> event_id, failures, locked: failures since the last success."""

    output = "event_id long, failures long, locked boolean"

    def __init__(self, key: str = "user_id", failure: str = "error", success: str = "purchase", limit: int = 5):
        self.key, self.failure, self.success, self.limit = key, failure, success, limit

    def start(self) -> dict:
        return {"failures": 0}

    def step(self, state: dict, row: dict) -> list[dict]:
        if row["kind"] == self.success:
            state["failures"] = 0
        elif row["kind"] == self.failure:
            state["failures"] += 1
        return [{"event_id": row["event_id"], "failures": state["failures"], "locked": state["failures"] >= self.limit}]


class SingleUse(Machine):
    """Rows (key, ms, event_id, kind) -> event_id, accepted, reason: a token issued once can be consumed once while it lasts.

    kind issue: the token is valid for `lasts` seconds from then on (issued again: anew). consume: the first one in time wins.
    """

    output = "event_id long, accepted boolean, reason string"

    def __init__(self, key: str = "token", lasts: int = 3600):
        self.key, self.lasts = key, lasts

    def start(self) -> dict:
        return {"until": None, "used": False}

    def step(self, state: dict, row: dict) -> list[dict]:
        now, reason = int(row["ms"]), None
        if row["kind"] == "issue":
            state.update(until=now + 1000 * self.lasts, used=False)
        elif state["until"] is None:
            reason = "unknown"
        elif state["used"]:
            reason = "used"
        elif now >= state["until"]:
            reason = "expired"
        else:
            state["used"] = True
        return [{"event_id": row["event_id"], "accepted": reason is None, "reason": reason}]
