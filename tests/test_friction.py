"""The windows of friction against a state machine over random sessions."""

import random

from quern.operators import friction as fr


def machine(events):
    """Per skill: invocations, retries, corrections, folded; one event after another."""
    out, turn, last, current, count = {}, 0, None, None, 0

    def close(nxt=None):
        if current is None:
            return
        row = out[current]
        if nxt is None:
            row["corrections"] += count
        elif not nxt["retry"]:
            row["corrections"] += max(count - (nxt["route"] == "text"), 0)

    for e in events:
        if e["kind"] == "turn":
            turn += 1
        elif e["kind"] == "text":
            count += current is not None
        elif e["kind"] == "fire":
            near = last is not None and last[0] == e["skill"] and turn - last[2] <= 3
            fold = near and last[1] == "text" and e["route"] == "structural"
            last = (e["skill"], e["route"], turn)
            if fold:
                out[current]["folded"] += 1
                continue
            close({"retry": near, "route": e["route"]})
            row = out.setdefault(e["skill"], {"invocations": 0, "repeats": 0, "corrections": 0, "folded": 0})
            row["invocations"] += 1
            row["repeats"] += near
            current, count = e["skill"], 0
    close()
    return {k: (v["invocations"], v["repeats"] + 1 if v["repeats"] else 0, v["corrections"], v["folded"]) for k, v in out.items()}


def test_windows_like_state_machine(spark):
    rng, rows, want = random.Random(3), [], {}
    for s in range(400):
        session = []
        for i in range(rng.randrange(1, 25)):
            kind = rng.choice(["turn", "turn", "text", "fire", "fire", "error"])
            session.append({"kind": kind, "skill": rng.choice("ab") if kind == "fire" else None, "route": rng.choice(["text", "structural"]) if kind == "fire" else None})
            rows.append(("claude", f"s{s}", i, kind, "user" if kind == "turn" else None, session[-1]["skill"], session[-1]["route"]))
        want |= {(f"s{s}", k): v for k, v in machine(session).items()}
    df = spark.createDataFrame(rows, "store string, sid string, seq int, kind string, role string, skill string, route string")
    got = {(r["sid"], r["skill"]): (r["invocations"], r["retries"], r["corrections"], r["folded"]) for r in fr.session_skills(fr.firing_groups(fr.mark_firings(df))).collect()}
    assert got == want and any(v[3] for v in want.values()) and any(v[1] for v in want.values())


def test_abandonment_is_strict(spark):
    rows = [("claude", "a", i, "turn") for i in range(10)] + [("claude", "a", 20 + i, "error") for i in range(3)] + [("claude", "b", i, "turn") for i in range(10)] + [("claude", "b", 20 + i, "error") for i in range(4)] + [("codex", "c", 0, "error"), ("codex", "d", 0, "abandoned")]
    got = {r["sid"]: r["abandoned"] for r in fr.session_rows(spark.createDataFrame(rows, "store string, sid string, seq int, kind string"), fr.store_caps(spark)).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True}


def test_identities_cut_sessions(spark):
    rows = [("s", i, k) for i, k in enumerate(["turn", "identity", "turn", "identity", "turn"])]
    got = [r["session_seq"] for r in fr.split_sessions(spark.createDataFrame(rows, "store string, seq int, kind string")).orderBy("seq").collect()]
    assert got == [0, 1, 1, 2, 2]
