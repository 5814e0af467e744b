"""Logs of three stores read from files, and what is written."""

import datetime as dt
import json
import os
import sqlite3
import stat

import pytest
from pyspark.sql import functions as F

from quern.operators import adapters
from quern.operators import friction as fr
from quern.sources import files, sinks, stores


def put(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def at(minute):
    return f"2026-08-15T10:{minute:02d}:00Z"


@pytest.fixture(scope="module")
def places(tmp_path_factory):
    root = tmp_path_factory.mktemp("stores")
    say = lambda role, text, m, **x: {"type": role, "timestamp": at(m), "sessionId": "S1", "message": {"role": role, "content": text}, **x}
    fire = {"type": "tool_use", "id": "t1", "name": "Skill", "input": {"skill": "acme:mill-sort"}}
    put(
        f"{root}/c/-home-ann-demo/one.jsonl",
        [
            say("user", "/acme:mill-sort the rows", 1), say("assistant", [fire], 2), "{cut", "", say("assistant", [{"type": "text", "text": "sorted"}], 3),
            say("user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True}], 4), say("user", "no, the other way", 5), say("user", "again", 6), say("assistant", [{**fire, "id": "t2"}], 7), {"type": "summary"},
            say("user", "", 8), {"type": "user", "message": {"role": "user", "content": "undated"}},
        ],
    )
    put(f"{root}/c/-home-ann-demo/empty.jsonl", [""])
    meta = {"timestamp": at(1), "type": "session_meta", "payload": {"session_id": "R1", "cwd": "/home/ann/demo"}}
    ev = lambda m, t, **p: {"timestamp": at(m), "type": t, "payload": p}
    put(
        f"{root}/x/2026/08/15/rollout-a.jsonl",
        [meta, ev(2, "event_msg", type="user_message", message="/acme:bolt-fit it"), ev(2, "response_item", type="message", role="user", content=[{"type": "input_text", "text": "mirror"}]), ev(3, "response_item", type="function_call", call_id="k", name="shell"), ev(4, "event_msg", type="exec_command_end", call_id="k", exit_code=2), ev(4, "event_msg", type="exec_command_end", call_id="q", exit_code=0), ev(5, "event_msg", type="agent_message", message="done"), ev(6, "event_msg", type="turn_aborted")],
    )
    put(f"{root}/x/2026/08/16/rollout-b.jsonl", [ev(1, "response_item", type="message", role="user", content="hello")])
    db = sqlite3.connect(f"{root}/store one.db")
    db.executescript("create table session(id text, slug text, directory text, title text, version text, time_created integer, time_updated integer); create table message(id text, session_id text, time_created integer, time_updated integer, data text); create table part(id text, message_id text, session_id text, time_created integer, time_updated integer, data text);")
    t = int(dt.datetime(2026, 8, 15, 10, tzinfo=dt.UTC).timestamp() * 1000)
    db.execute("insert into session values ('s', 'x', '/home/ann/demo', 't', '1', ?, ?), (null, 'x', '/d', 't', '1', ?, ?)", (t, t, t, t))
    db.executemany("insert into message values (?, 's', ?, ?, ?)", [("m1", t, t, '{"role":"user"}'), ("m2", t + 1, t, '{"role":"assistant"}'), ("m3", t + 2, t, "{cut")])
    db.executemany("insert into part values (?, ?, 's', ?, ?, ?)", [("p2", "m1", t + 1, t, '{"type":"text","text":"b"}'), ("p1", "m1", t, t, '{"type":"text","text":"a"}'), ("p3", "m2", t, t, '{"type":"tool","tool":"skill","state":{"status":"error","input":{"name":"pipe-cut"}}}')])
    db.commit()
    return {"claude": f"{root}/c", "codex": f"{root}/x", "opencode": f"{root}/store one.db"}


def kinds(events, store):
    rows = events.where(F.col("store") == store).orderBy("sid", "seq").collect()
    return [(r["kind"], r["role"] or r["skill"] or r["tool"]) for r in rows]


def test_events_of_each_store(spark, places):
    readings = stores.build_stores(spark, "all", places)
    assert all(r.present and r.note is None for r in readings)
    events = stores.all_store_events(spark, readings)
    assert kinds(events, "claude") == [
        ("turn", "user"), ("text", None), ("fire", "mill-sort"), ("fire", "mill-sort"), ("turn", "assistant"), ("error", "Skill"), ("turn", "user"), ("text", None),
        ("turn", "user"), ("text", None), ("fire", "mill-sort"), ("turn", "user"),
    ]
    assert kinds(events, "codex") == [("turn", "user"), ("text", None), ("fire", "bolt-fit"), ("error", "shell"), ("turn", "assistant"), ("abandoned", None), ("turn", "user"), ("text", None)]
    assert kinds(events, "opencode") == [("turn", "user"), ("text", None), ("fire", "pipe-cut"), ("error", "skill")]
    assert [r["text"] for r in events.where("store = 'opencode' and kind = 'text'").collect()] == ["a\nb"]
    sessions = {r["session_id"]: (r["project"], r["superset"]) for x in readings for r in x.sessions.collect()}
    assert sessions == {"S1": ("-home-ann-demo", False), "R1": ("-home-ann-demo", False), "rollout-b": ("", True), "s": ("-home-ann-demo", False)}


def test_friction_of_the_stores(spark, places):
    events, caps = stores.all_store_events(spark, stores.build_stores(spark, "all", places)), fr.store_caps(spark)
    got = {r["skill"]: r for r in fr.with_scores(fr.skill_friction(fr.session_skills(fr.firing_groups(fr.mark_firings(events))), fr.session_rows(events, caps), caps)).collect()}
    mill, bolt, pipe = got["mill-sort"], got["bolt-fit"], got["pipe-cut"]
    # one command seen on both routes is folded; the third firing comes three turns later and is a retry
    assert (mill["invocations"], mill["retries"], mill["folded"], mill["corrections"], mill["turns"], mill["tool_errors"]) == (2, 2, 1, 0, 5, 1)
    assert bolt["abandoned"] == 1 and bolt["downgraded"] and bolt["confidence"] == "Low" and bolt["inferred_stores"] == ""
    assert pipe["abandoned"] == 1 and not pipe["downgraded"] and pipe["inferred_stores"] == "opencode"


def test_period_and_project(spark, places):
    since = dt.datetime(2026, 8, 15, 10, 5, tzinfo=dt.UTC)
    late = stores.all_store_events(spark, stores.build_stores(spark, "claude", places, since=since))
    assert kinds(late, "claude")[0] == ("turn", "user") and late.count() == 6
    assert stores.all_store_events(spark, stores.build_stores(spark, "claude", places, project="home-ann-demo")).count() == 0
    assert stores.chosen_project(None, False, "/home/ann/demo", spark) == "-home-ann-demo" and stores.chosen_project("p", True, "/", spark) is None
    with pytest.raises(ValueError):
        stores.selected_names("other")


def test_a_broken_store_leaves_the_others(spark, places, tmp_path):
    (tmp_path / "bad.db").write_text("no database")
    readings = {r.name: r for r in stores.build_stores(spark, "all", {**places, "opencode": str(tmp_path / "bad.db"), "codex": str(tmp_path / "none")})}
    assert readings["claude"].events is not None and not readings["codex"].present and "codex" in readings["codex"].note


def test_guards_and_sinks(spark, tmp_path):
    with pytest.raises(files.Refused):
        files.resolve_within(str(tmp_path), "../x")
    os.symlink("/etc", tmp_path / "link")
    with pytest.raises(files.Refused):
        sinks.new_output("link/new", str(tmp_path))
    sinks.write_json(str(tmp_path / "a.json"), {"b": 1, "a": "é"})
    assert (tmp_path / "a.json").read_text().index('"a"') < (tmp_path / "a.json").read_text().index('"b"') and files.load_json_object(str(tmp_path / "a.json"), {"c": 2}) == {"a": "é", "b": 1, "c": 2}
    (tmp_path / "bad.json").write_text("[")
    assert files.load_json_object(str(tmp_path / "bad.json")) == {}
    with pytest.raises(files.Refused):
        files.load_json_object(str(tmp_path / "bad.json"), strict=True)
    assert sinks.write_records(spark.range(3), "out.jsonl", str(tmp_path)) == 3
    assert stat.S_IMODE((tmp_path / "out.jsonl").stat().st_mode) == 0o600
    with pytest.raises(files.Refused):
        sinks.write_records(spark.range(3), "out.jsonl", str(tmp_path))
    assert not sinks.is_git_ignored(str(tmp_path / "x"))
    assert sinks.render_markdown([{"rule": "R", "severity": "WARN", "place": "a:1", "what": "w", "action": "REPORT_ONLY"}]).count("\n") == 4


def test_trees(spark, tmp_path):
    for name, text in (("skills/a/SKILL.md", "---\nname: a\ndescription: does a\n---\nx"), ("skills/b/SKILL.md", "no header"), ("AGENTS.md", "x"), (".git/x.md", "x"), ("notes.md", "caf\u00e9")):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "raw.md").write_bytes(b"ok \xff end")
    got = {r["path"]: r["content"] for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"skills/a/SKILL.md", "skills/b/SKILL.md", "AGENTS.md", "notes.md", "raw.md"} and got["raw.md"] == "ok \ufffd end" and got["notes.md"] == "caf\u00e9"
    assert {tuple(r) for r in files.skill_descriptions(spark, str(tmp_path)).collect()} == {("a", "does a"), ("b", "")}
    found, skipped = files.collect_targets(str(tmp_path))
    assert [t["kind"] for t in found] == ["agents_md"] and len(skipped) == 2


def test_backends_and_placeholders():
    assert files.check_backends({"a": {"argv": ["run", "{prompt_file}"]}, "b": {"argv": []}, "c": {"argv": ["{home}"]}}) == ["b: argv must be a list of strings", "c: unknown placeholder home"]
    assert files.substitute_shas("x {{fixture:sha:baseline}} {{fixture:sha:commits[0]}}", "b", ["c"]) == "x b c"
    with pytest.raises(files.Refused):
        files.substitute_shas("{{fixture:sha:commits[1]}}", "b", ["c"])


def test_part_events_of_documents_encoded_twice_and_roles_in_any_spelling(spark):
    twice = lambda o: json.dumps(json.dumps(o))
    messages = [("m1", json.dumps({"role": "User"})), ("m2", twice({"role": " assistant"})), ("m3", twice({"role": "USER "})), ("m4", json.dumps("no document")), ("m5", json.dumps({"role": "tool"})), ("m6", json.dumps({"role": "model"}))]
    parts = [("m1", "p1", twice({"type": "text", "text": "hello"})), ("m2", "p2", json.dumps({"type": "text", "text": "yes"})), ("m2", "p3", twice({"type": "tool", "tool": "bash", "state": {"status": "error"}})), ("m3", "p4", json.dumps({"type": "text", "text": "on"})), ("m5", "p5", json.dumps({"type": "text", "text": "x"})), ("m6", "p6", json.dumps({"type": "text", "text": "z"}))]
    m = spark.createDataFrame([(i, "s", 1_700_000_000_000 + k, d) for k, (i, d) in enumerate(messages)], "id string, session_id string, time_created bigint, data string")
    p = spark.createDataFrame([(i, 1_700_000_000_000 + k, n, d) for k, (i, n, d) in enumerate(parts)], "message_id string, time_created bigint, id string, data string")
    rows = adapters.part_events(m, p).select("seq.pos.id", "seq.sub", "kind", "role", "text", "tool").collect()
    assert sorted(map(tuple, rows)) == [
        ("m1", 0, "turn", "user", None, None), ("m1", 1, "text", None, "hello", None), ("m2", 0, "turn", "assistant", None, None), ("m2", 1, "error", None, None, "bash"), ("m3", 0, "turn", "user", None, None), ("m3", 1, "text", None, "on", None),
        ("m6", 0, "turn", "assistant", None, None),
    ]
