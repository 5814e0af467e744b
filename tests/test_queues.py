"""Queues, contained paths, result records and read faults on small fixtures."""

import json
import os

from quern.operators import queues as q
from quern.sources import files

SCHEMA = "skill string, scenario string, title string, isolation string, executor_tier string, prompt string, expectations array<string>, env map<string,string>, staged int, skill_text string, scenario_sha string, extra int"


def scenario(skill="tidy-up", name="s1", prompt="Do it.", expectations=("first", "second"), env=None, staged=1, text="# Tidy\nBody\n\n"):
    return (skill, name, None, None, None, prompt, list(expectations) if expectations is not None else None, env, staged, text, "sha", 7)


def test_queue(spark):
    rows = [scenario(), scenario(name="s2", env={"B": "2", "A": "1"}, staged=0), scenario(skill="Bad Name"), scenario(name="s3", text=None), scenario(name="s4", prompt=" "), scenario(name="s5", expectations=()), scenario(name="s6", expectations=None), scenario(name="s7"), scenario(name="s7")]
    made = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in q.build_queue(made, "/b").collect():
        got.setdefault((r["skill"], r["scenario"]), []).append(r)
    fault = {k: {r["fault"] for r in v} for k, v in got.items()}
    assert fault == {("tidy-up", "s1"): {None}, ("tidy-up", "s2"): {None}, ("Bad Name", "s1"): {"malformed name"}, ("tidy-up", "s3"): {"skill without text"}, ("tidy-up", "s4"): {"no prompt"}, ("tidy-up", "s5"): {"no expectations"}, ("tidy-up", "s6"): {"no expectations"}, ("tidy-up", "s7"): {"identifier twice"}}
    one, two = got["tidy-up", "s1"][0], got["tidy-up", "s2"][0]
    assert (one["id"], one["prompt_file"], one["output_file"], one["cwd"]) == ("tidy-up-s1", "prompts/tidy-up-s1.md", "work/tidy-up-s1/report.json", "work/tidy-up-s1")
    assert "skills/tidy-up/SKILL.md" in one["prompt_text"] and "## Environment" not in one["prompt_text"] and "It is empty" not in one["prompt_text"] and "\n1. first\n2. second\n" in one["prompt_text"]
    assert "- `A` = `1`\n- `B` = `2`" in two["prompt_text"] and "It is empty" in two["prompt_text"]
    entry = json.loads(one["manifest"])
    assert entry["title"] == "s1" and entry["isolation"] == "worktree" and entry["executor_tier"] == "standard" and entry["inline_skill"] is False and entry["expectations"] == ["first", "second"]
    inlined = q.build_queue(made.where("scenario = 's1'"), "/b", inline=True).where("fault is null").first()["prompt_text"]
    assert "<skill>\n# Tidy\nBody\n</skill>" in inlined and "SKILL.md" not in inlined
    assert q.build_queue(made.limit(0), "/b").count() == 0


def test_contained_paths(spark):
    rows = [(1, "a/b.md", "work/x/report.json", None), (2, "../out.md", "x", ""), (3, "a/../../root/b.md", "/root/dir/y", "."), (4, "ok.md", "/etc/passwd", ""), (5, "l.md", "z", "w"), (6, "a.md", "b.md", "../../root/dir/../other"), (7, None, "x", "")]
    units = spark.createDataFrame(rows, "id int, prompt_file string, output_file string, cwd string")
    links = spark.createDataFrame([("/root/dir/l.md",), ("/root/dir/l.md",)], "path string")
    got = {r["id"]: (r["prompt_abs"], r["output_abs"], r["cwd_abs"], r["fault"]) for r in q.contained_paths(units, links, "/root/dir/").collect()}
    assert got[1] == ("/root/dir/a/b.md", "/root/dir/work/x/report.json", "/root/dir", None) and got[3][:2] == (None, "/root/dir/y")
    assert [got[i][3] for i in range(1, 8)] == [None, "prompt_file leads out of the root", "prompt_file leads out of the root", "output_file leads out of the root", "prompt_file is a link", "cwd leads out of the root", None]


def test_records(spark):
    rows = [("u1", "done", "", "", 0, 12, "t", "free text"), ("u2", "failed", "timeout", "transient", None, 3, "t", "x"), ("u3", "odd", "", "", 0, 1, "t", "x")]
    got = {r["id"]: json.loads(r["record"]) for r in q.result_records(spark.createDataFrame(rows, "id string, status string, error_kind string, failure_class string, exit_code int, duration_ms bigint, started_at string, said string")).collect()}
    assert set(got) == {"u1", "u2"} and list(got["u1"]) == list(q.RECORD_FIELDS)
    assert got["u1"]["error_kind"] is None and got["u1"]["exit_code"] == 0 and got["u2"]["exit_code"] is None and got["u2"]["failure_class"] == "transient"


def test_read_faults(tmp_path):
    good = tmp_path / "a"
    good.write_text("x")
    assert files.unreadable([str(good), str(tmp_path / "none"), str(tmp_path)]) == [(str(tmp_path / "none"), "not-found"), (str(tmp_path), "io-error")]
    assert files.read_fault(PermissionError()) == "permission-denied" and os.path.exists(good)
