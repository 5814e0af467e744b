"""Conversations against a brute-force version, whatever the size of a block."""

import json
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import conversations as c
from quern.operators.instants import log_instants, message_instants


def speaker(role):
    return {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "system": "system"}.get((role or "").strip().lower(), "?")


def speaks(content):
    try:
        o = json.loads(content)
    except (TypeError, ValueError):
        return False
    if isinstance(o, list):
        return any(isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"].strip() for b in o)
    return isinstance(o, str) and bool(o.strip())


def decoded(text):
    try:
        o = json.loads(text)
        return json.loads(o) if isinstance(o, str) else o
    except (TypeError, ValueError):
        return None


@pytest.fixture(scope="module")
def expected(spark, duck, sf_dir):
    session = spark.read.parquet(f"{sf_dir}/session_one.parquet")
    zones = spark.read.parquet(f"{sf_dir}/machine_zone.parquet")
    instants = {r["row_id"]: (r["sec"], r["nano"]) for r in log_instants(session.select("row_id", "log_file", "line_no", "machine", F.col("timestamp").alias("text")), F.col("text"), zones).collect() if r["sec"] is not None}
    rows = duck.execute("select row_id, log_file, line_no, sessionid, type, message.role, message.content from session_one order by row_id").fetchall()
    owner = {r[1]: r[3] for r in rows if r[3]}
    first = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if r[0] in instants:
            first.setdefault(r[1], instants[r[0]])
    talk, seen = defaultdict(list), set()
    for row, file, line, sid, kind, role, content in rows:
        if (file, line) in seen:
            continue
        seen.add((file, line))
        who = speaker(role if role is not None else kind)
        if speaks(content) and who != "system" and (sid or owner.get(file)):
            talk["session_one", sid or owner[file]].append((file not in first, first.get(file, (0, 0)), file, line, row, who))
    said = {m for m, d in duck.execute("select message_id, data from oc_part where message_id is not null").fetchall() if isinstance(o := decoded(d), dict) and o.get("type") == "text" and isinstance(o.get("text"), str) and o["text"].strip()}
    times = {r["row_id"]: (r["sec"], r["nano"]) for r in message_instants(spark.read.parquet(f"{sf_dir}/oc_message.parquet").select("row_id", "time_created")).collect()}
    ids = set()
    for row, key, sid, data in duck.execute("select row_id, id, session_id, data from oc_message order by row_id").fetchall():
        if key in ids or key not in said or not sid:
            continue
        ids.add(key)
        o = decoded(data)
        talk["oc_message", sid].append((False, times[row], key, 0, row, speaker(o.get("role") if isinstance(o, dict) else None)))
    want = set()
    for (tbl, conv), turns in talk.items():
        turns.sort()
        who = [t[5] for t in turns]
        if "?" not in who and who[0] == "user" and who[-1] == "assistant" and all(b == "assistant" for a, b in zip(who, who[1:]) if a == "user"):
            want |= {(tbl, conv, i, t[4]) for i, t in enumerate(turns, 1)}
    return want


@pytest.mark.parametrize("block", [2, 4096])
def test_like_brute_force(spark, sf_dir, expected, block, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", block)
    assert expected and {tuple(r) for r in c.p6_found(spark, sf_dir).collect()} == expected


def test_links_form_one_tree(spark, sf_dir):
    by = defaultdict(dict)
    for r in c.p6_links(spark, sf_dir).collect():
        by[r["tbl"], r["conv_id"]][r["row_id"]] = r
    for turns in by.values():
        assert sorted(r["turn_no"] for r in turns.values()) == list(range(1, len(turns) + 1))
        assert [r["turn_no"] for r in turns.values() if r["parent"] is None] == [1]
        assert all(turns[r["parent"]]["turn_no"] < r["turn_no"] for r in turns.values() if r["parent"] is not None)


def test_dirty_lines(spark):
    text = lambda t: json.dumps([{"type": "text", "text": t}])
    rows = [
        (1, "f", 1, "user", "s", ("user", '"hi"')), (2, "f", 2, "assistant", None, (" AI", text("yes"))), (3, "f", 2, "assistant", None, (" AI", text("yes"))), (4, "f", 3, "system", "s", ("system", '"x"')), (5, "f", 4, "user", "s", ("user", '" \\u3000 "')),
        (6, "g", 1, "user", "t", ("user", '"hi"')), (7, "g", 2, "assistant", "t", (None, '"yes"')), (8, "g", 3, None, "t", (None, '"who"')), (9, "h", 1, "user", None, ("user", '"hi"')), (10, "k", 1, "user", "u", None), (11, "k", None, "assistant", "u", ("model", "[{cut")),
    ]
    df = spark.createDataFrame([(a, b, n, t, s, m, "2025-01-01T00:00:00Z", "m") for a, b, n, t, s, m in rows], "row_id bigint, log_file string, line_no int, type string, sessionid string, message struct<role:string,content:string>, timestamp string, machine string")
    zones = spark.createDataFrame([], "machine string, zone_name string")
    turns, files = c.session_turns(df, zones)
    got = {tuple(r) for r in c.conversations(turns, files).where("kept").select("conv_id", "turn_no", "row_id").collect()}
    assert got == {("s", 1, 1), ("s", 2, 2)}
    none, files = c.session_turns(df.limit(0), zones)
    assert c.conversations(none, files).count() == 0


def test_links_do_not_depend_on_blocks(spark, sf_dir, monkeypatch):
    links = []
    for block in (2, 64, 4096):
        monkeypatch.setattr(c, "BLOCK", block)
        links.append({tuple(r) for r in c.p6_links(spark, sf_dir).collect()})
    assert links[0] == links[1] == links[2] and all((r[6] is None) == (r[2] == 1) for r in links[0])


TOPICS = ("the parser drops empty lines at the end of a file", "our nightly backup fills the whole disk volume", "colours of the chart legend look wrong in dark mode", "the login form rejects valid phone numbers", "memory usage of the worker grows every hour")


def interleaved(seed, channels, people=True):
    """Lines of one session in which several exchanges run side by side, and the true parent of each."""
    rng, rows, last, at = random.Random(seed), [], {}, 1_700_000_000
    for i in range(240):
        k = rng.randrange(channels)
        at += rng.choice((5, 20, 40, 90))
        words = rng.sample(TOPICS[k].split(), 4) + rng.sample("please check again maybe later done thanks now what about this one here".split(), 3)
        who = "assistant" if last.get(k, (0, "assistant"))[1] == "user" else "user"
        rows.append((i + 1, who, at, " ".join(words) + (f" @{'abcde'[k]}desk" if people and rng.random() < 0.5 else ""), last[k][0] if k in last else None))
        last[k] = (i + 1, who)
    return rows


def link_accuracy(spark, channels, candidates, monkeypatch):
    monkeypatch.setattr(c, "CANDIDATES", candidates)
    rows = [(f"s{seed}", *r) for seed in range(6) for r in interleaved(seed, channels)]
    schema = "conv_id string, row_id bigint, speaker string, sec bigint, said string, parent bigint"
    told = spark.createDataFrame(rows, schema)
    turns = told.select(
        F.lit("oc_message").alias("tbl"), "conv_id", F.lit("").alias("channel"), F.expr("sec div 3600").alias("block"), F.lit("").alias("part"), (F.col("sec") * 1_000_000_000).alias("pos"), F.col("row_id").cast("string").alias("line"), "row_id", "speaker", "sec",
        c.words_of(F.col("said")).alias("words"), F.regexp_extract_all("said", F.lit(r"@[\w-]+"), F.lit(0)).alias("mentions"),
    )
    files = spark.createDataFrame([], "tbl string, channel string, first struct<sec:bigint,nano:bigint>")
    want = {(r[0], r[1]): r[5] for r in rows if r[5] is not None}
    got = {(r["conv_id"], r["row_id"]): r["parent"] for r in c.conversations(turns, files).collect()}
    return sum(got[k] == v for k, v in want.items()) / len(want)


def test_links_find_their_channel(spark, monkeypatch):
    figures = {(n, k): link_accuracy(spark, n, k, monkeypatch) for n, k in ((1, c.CANDIDATES), (2, c.CANDIDATES), (3, c.CANDIDATES))}
    assert figures[1, c.CANDIDATES] > 0.88 and figures[2, c.CANDIDATES] > 0.68 and figures[3, c.CANDIDATES] > 0.5, figures


SCHEMA = "conv_id string, row_id bigint, speaker string, sec bigint, said string"
NO_FILES = "tbl string, channel string, first struct<sec:bigint,nano:bigint>"


def links_of(spark, rows):
    """Row -> parent and score, rows of a session in order of ``row_id`` and read from one file."""
    turns = spark.createDataFrame(rows, SCHEMA).select(
        F.lit("session_one").alias("tbl"), "conv_id", F.lit("f").alias("channel"), F.expr(f"row_id div {c.BLOCK}").alias("block"), F.lit("").alias("part"), F.col("row_id").alias("pos"), F.col("row_id").cast("string").alias("line"), "row_id", "speaker", "sec",
        c.words_of(F.col("said")).alias("words"), F.regexp_extract_all("said", F.lit(r"@[\w-]+"), F.lit(0)).alias("mentions"),
    )
    return {(r["conv_id"], r["row_id"]): (r["parent"], r["score"]) for r in c.conversations(turns, spark.createDataFrame([], NO_FILES)).collect()}


def likeliest_of_all(turns):
    """Every turn before, scored one by one."""
    words = lambda said: {w for w in re.split(r"[^\w@]+", said.lower()) if len(w) > 2}
    told = [(row, who, sec, words(said), set(re.findall(r"@[\w-]+", said))) for _, row, who, sec, said in turns]
    out = {}
    for i, (row, who, sec, said, named) in enumerate(told):
        best = None
        for j, (parent, other, then, heard, called) in enumerate(told[:i]):
            time = 0.5 ** (abs(sec - then) / c.HALF_LIFE) if sec is not None and then is not None else 0.5
            traits = {"time": time, "nearness": 1 / (i - j), "distance": -math.log(i - j), "mention": bool(named & called), "words": len(said & heard) / max(1, len(said | heard)), "speaker": who != other}
            best = max(filter(None, (best, (round(sum(c.WEIGHTS[k] * v for k, v in traits.items()), 9), j, parent))))
        out[row] = (best[2], best[0]) if best else (None, None)
    return out


def long_sessions():
    """Runs of one speaker, words and mentions that come back from far, unordered and missing times."""
    rng, rows = random.Random(6), []
    for s in range(4):
        who, at = "user", 1_700_000_000
        for i in range(150):
            who = rng.choice(("user", "assistant")) if rng.random() < (0.5, 0.1, 0.02, 0.5)[s] else who
            at += rng.choice((1, 5, 400, -300) if s == 3 else (0, 5, 60, 900))
            said = " ".join(rng.choice(TOPICS).split()[: rng.randrange(9)]) + rng.choice(("", "", "", " @desk", " @five"))
            rows.append((f"s{s}", 1000 * s + i + 1, who, None if rng.random() < 0.05 else at, said))
    return rows


@pytest.mark.parametrize("sizes", [(16, 4096, 64), (3, 20, 7), (1, 1, 1)])
def test_parents_are_the_likeliest_of_all_turns(spark, sizes, monkeypatch):
    for name, size in zip(("CANDIDATES", "PIECE", "SPAN"), sizes):
        monkeypatch.setattr(c, name, size)
    rows = long_sessions()
    want = {}
    for s in range(4):
        want |= {(f"s{s}", k): v for k, v in likeliest_of_all([r for r in rows if r[0] == f"s{s}"]).items()}
    got = links_of(spark, rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1], abs=1e-8) for k, v in got.items() if v[1] is not None)
    back = [k[1] - v[0] for k, v in got.items() if v[0] is not None]
    assert max(back) > 16 and sum(b > 3 for b in back) > 20


def test_parent_from_far_back(spark):
    said = ["which colour has the third @desk legend", *(f"step{i} runs" for i in range(40)), "the third @desk legend has which colour"]
    rows = [("s", i + 1, "user" if i == 0 else "assistant", 1_700_000_000, t) for i, t in enumerate(said)]
    assert links_of(spark, rows)["s", len(said)][0] == 1


def test_turns_are_scored_once(spark, sf_dir):
    fields = "spark.sql.debug.maxToStringFields"
    spark.conf.set(fields, "1000")
    try:
        for query in (c.p6_found, c.p6_links):
            plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
            # what is left of scoring are turns that reach far; tables and blocks are read before
            assert plan.count("array_intersect") == 1 and "parquet" not in plan.lower()
    finally:
        spark.conf.unset(fields)


def test_content_after_white_space(spark):
    rows = [(i, content) for i, content in enumerate(('"a"', '\n\t"b"', ' "c"', '\r\n[{"type": "text", "text": "d"}]', '{"type": "text", "text": "e"}', '["text"]', '[{"type": "text", "text": 5}]', "5", "[", ""))]
    got = {r["row_id"]: r["said"] for r in c.with_said(spark.createDataFrame(rows, "row_id int, content string")).collect()}
    assert got == {0: "a", 1: "b", 2: "c", 3: "d"}


@pytest.mark.parametrize("words, mentions", [(30, 0), (5, 2), (0, 0)])
def test_no_turn_scores_more_than_most(spark, words, mentions):
    own = {"words": F.array(*map(F.lit, range(words))).cast("array<int>"), "mentions": F.array(*(F.lit(f"@{i}") for i in range(mentions))).cast("array<string>")}
    turn = F.struct(F.lit("user").alias("speaker"), F.col("back").alias("turn_no"), F.lit(1).cast("bigint").alias("row_id"), F.lit(0).cast("bigint").alias("sec"), F.col("words"), F.col("mentions"))
    asked = spark.range(1, 50).select(F.col("id").alias("back")).withColumns(own | {"speaker": F.lit("assistant"), "sec": F.lit(0).cast("bigint"), "turn_no": F.lit(50).cast("bigint")})
    for r in asked.select(c.likeliest(F.array(turn))["score"].alias("score"), c.most((F.lit(50) - F.col("back")).cast("double")).alias("most")).collect():
        assert r["score"] == pytest.approx(r["most"], abs=1e-8)
