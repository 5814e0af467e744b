"""Orphans, drift and nested records against brute force on small tables."""

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import drift, nested, orphans


def kind_and_call(record_type, payload):
    try:
        o = json.loads(payload)
    except (TypeError, ValueError):
        return None, None, None
    if not isinstance(o, dict):
        return None, None, None
    kind = o.get("type", o.get("kind"))
    kind = kind.get("name") if isinstance(kind, dict) else kind
    call = next((v for k, v in o.items() if k.lower().replace("_", "") == "callid"), None)
    return ("session_meta" if record_type == "session_meta" else kind), call, o


def test_orphans_like_brute_force(spark, duck, sf_dir):
    dead = {(e, k) for e, k in duck.execute("select entity, record_key from tombstone where restored_at is null").fetchall()}
    first = {}
    for entity, t in (("message", "oc_message"), ("session", "oc_session")):
        for key, at in duck.execute(f"select id, min(loaded_at) from {t} group by 1").fetchall():
            first[entity, "", key] = at
    want, calls = set(), []
    for row_id, file, kind, payload, at in duck.execute("select row_id, log_file, type, payload, loaded_at from rollout").fetchall():
        k, call, _ = kind_and_call(kind, payload)
        if k == "function_call" and call:
            first["call", file, call] = min(first.get(("call", file, call), at), at)
        elif k in ("exec_command_end", "function_call_output") and call:
            calls.append((row_id, file, call, at))
    refs = [("rollout", r, "call_id", ("call", f, c), at) for r, f, c, at in calls]
    for row_id, m, s, at in duck.execute("select row_id, message_id, session_id, loaded_at from oc_part").fetchall():
        refs += [("oc_part", row_id, f, (e, "", k), at) for f, e, k in (("message_id", "message", m), ("session_id", "session", s)) if k]
    for tbl, row_id, field, key, at in refs:
        reason = "deleted" if (key[0], key[2]) in dead else "missing" if key not in first else "late" if first[key] > at else None
        if reason:
            want.add((tbl, row_id, field, reason))
    assert want and {tuple(r) for r in orphans.p1_found(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("share", [1e-9, 0.2, 2.0])
def test_split_by_weight_changes_nothing(spark, share):
    refs = spark.createDataFrame([("t", i, "f", "message", "", "hot" if i % 3 else f"k{i}", None) for i in range(60)], "tbl string, row_id bigint, field string, entity string, scope string, key string, loaded_at timestamp")
    targets = spark.createDataFrame([("message", "", "k3", None), ("message", "", "k3", None)], "entity string, scope string, key string, loaded_at timestamp")
    dead = spark.createDataFrame([("message", "k6", None, None), ("message", "k6", None, None), ("message", "k9", None, "2025-01-01")], "entity string, record_key string, deleted_at string, restored_at string")
    got = Counter(r["reason"] for r in orphans.find_orphans(refs, targets, dead, share).collect())
    assert got == {"missing": 58, "deleted": 1}


def test_orphans_of_nothing(spark):
    refs = spark.createDataFrame([], "tbl string, row_id bigint, field string, entity string, scope string, key string, loaded_at timestamp")
    targets = spark.createDataFrame([], "entity string, scope string, key string, loaded_at timestamp")
    dead = spark.createDataFrame([], "entity string, record_key string, deleted_at timestamp, restored_at timestamp")
    assert orphans.find_orphans(refs, targets, dead).count() == 0


def json_type(v):
    return {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array"}.get(type(v))


def changes(records, catalogue):
    """``(stream, file, kind) -> [record]`` against ``(stream, kind) -> {field: (type, required)}``."""
    out = set()
    for (stream, file, kind), rows in records.items():
        wanted = catalogue.get((stream, kind))
        if not wanted:
            continue
        types, n = defaultdict(set), Counter()
        for o in rows:
            for f, v in o.items():
                n[f] += 1
                types[f] |= {json_type(v)} - {None}
        add = lambda f, c: out.add((stream, file, kind, f, c))  # noqa: B023, E731
        for f, (t, _) in wanted.items():
            if types[f] - {t}:
                add(f, "retyped")
        absent = [f for f, (_, required) in wanted.items() if required and not n[f]]
        strange, used = [f for f in n if f not in wanted and n[f]], set()
        for f in absent:
            t = wanted[f][0]
            able = [s for s in strange if n[s] == len(rows) and types[s] == {t}]
            if sum(wanted[a][0] == t for a in absent) == 1 and len(able) == 1:
                add(f, "renamed")
                used.add(able[0])
            else:
                add(f, "removed")
        for s in set(strange) - used:
            add(s, "added")
    return out


def test_drift_like_brute_force(spark, duck, sf_dir):
    catalogue = defaultdict(dict)
    for stream, kind, field, t, required in duck.execute("select * from field_catalog").fetchall():
        catalogue[stream, kind][field] = (t, required)
    records = defaultdict(list)
    for file, t, payload in duck.execute("select log_file, type, payload from rollout").fetchall():
        kind, _, o = kind_and_call(t, payload)
        if o is not None:
            records["rollout", file, kind].append(o)
    for file, record in duck.execute("select export_file, record from session_export").fetchall():
        records["session_export", file, "session"].append(json.loads(record))
    want = changes(records, catalogue)
    assert len({w[4] for w in want}) == 4 and {tuple(r) for r in drift.p2_found(spark, sf_dir).collect()} == want


def test_kind_in_any_holder(spark):
    rows = [("event_msg", p) for p in ('{"type":"message"}', '{"kind":"message"}', '{"type":{"name":"message","rev":2}}', '{"x_type":"message"}', '{"TYPE":"message"}', '{"typeValue":"message"}', '{"type":["message"]}', '{"what":"message"}', "{}", '{"type":"cut', "[1]", None)]
    from quern.functions.payloads import fields_of, payload_kind

    df = spark.createDataFrame(rows, "type string, payload string").withColumn("fields", fields_of(F.col("payload")))
    assert [r[0] for r in df.select(payload_kind(F.col("type"), F.col("fields"))).collect()] == ["message"] * 8 + [None] * 4


def test_unified_table(spark):
    big = 2**53 + 1
    rows = [
        (1, "a", '{"type":"message","role":"user","content":[1],"size":%d}' % big), (2, "b", '{"type":"message","speaker":"user","content":"x","size":"7","mood":{"z":1,"a":2}}'), (3, "b", "{cut"),
        (4, "a", '{"type":"message","role":7,"content":[],"size":%s}' % ("9" * 38)), (5, "a", '{"type":"message","role":null,"content":{"k":[]},"size":1.5,"mood":true}'),
    ]
    rollout = spark.createDataFrame([(i, f, 1, "event_msg", p, None) for i, f, p in rows], "row_id bigint, log_file string, line_no int, type string, payload string, loaded_at timestamp")
    export = spark.createDataFrame([], "row_id bigint, export_file string, record string, loaded_at timestamp")
    fields = [("type", "string"), ("role", "string"), ("content", "array"), ("size", "number")]
    catalogue = spark.createDataFrame([("rollout", "message", f, t, True) for f, t in fields], "stream string, record_kind string, field string, json_type string, required boolean")
    records = drift.typed_records(rollout, export)
    found = drift.schema_changes(drift.fuse_schemas(records), catalogue)
    assert {tuple(r) for r in found.where("file_name = 'b'").select("file_name", "field", "change", "now").collect()} == {("b", "role", "renamed", "speaker"), ("b", "content", "retyped", None), ("b", "size", "retyped", None), ("b", "mood", "added", None)}
    got = {r["row_id"]: r for r in drift.unify_kind(records, found, catalogue.collect(), "rollout", "message").collect()}
    assert set(got) == {1, 2, 4, 5} and got[1]["size__digits"] == big and got[4]["size__digits"] == 10**38 - 1 and got[2]["size"] == 7.0 and got[2]["size__type"] == "string" and got[2]["size__string"] == "7"
    assert got[2]["role"] == "user" and got[2]["content__type"] == "string" and got[2]["content__string"] == "x" and got[2]["content"] is None and got[1]["content"] == "[1]" and got[1]["content__type"] is None
    assert got[4]["role"] == "7" and got[4]["role__number"] == 7.0 and got[5]["role"] is None and got[5]["content__object"] == '{"k":[]}' and got[5]["size"] == 1.5 and got[5]["size__digits"] is None
    assert got[2]["extra"] == {"mood": '{"z":1,"a":2}'} and got[5]["extra"] == {"mood": "true"} and got[1]["extra"] == {}
    values = {(r["row_id"], r["field"]): (r["held_as"], r["value"], r["part"]) for r in drift.field_values(records, found, catalogue).collect()}
    assert values[2, "role"] == ("speaker", "user", "canonical") and values[2, "mood"] == ("mood", '{"z":1,"a":2}', "extra") and values[1, "size"] == ("size", str(big), "canonical") and values[4, "role"][2] == "branch" and (5, "role") not in values


def test_calls_under_any_name(spark):
    """A file that calls the identifier something else altogether is read under the name its schema shows."""
    p = lambda kind, name, value: json.dumps({"type": kind, name: value, **({"output": "ok"} if kind == "function_call_output" else {"name": "shell", "arguments": "{}"})})
    rows = [
        (1, "a", p("function_call", "invocation", "c1")), (2, "a", p("function_call_output", "handle", "c1")), (3, "a", p("function_call_output", "handle", "c2")),
        (4, "b", p("function_call", "callId", "c1")), (5, "b", p("function_call_output", "x_call_id", ["c1", "c9", None, ""])), (6, "b", p("function_call_output", "call_id", None)), (7, "b", p("function_call_output", "call_id", ["c8", "c9"])),
    ]
    at = "2025-01-01 00:00:00"
    rollout = spark.createDataFrame([(i, f, "response_item", t, at) for i, f, t in rows], "row_id bigint, log_file string, type string, payload string, loaded_at string").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    kinds = {"function_call": {"type": "string", "call_id": "string", "name": "string", "arguments": "string"}, "function_call_output": {"type": "string", "call_id": "string", "output": "string"}}
    # names and outputs are strings too, but catalogued: the only uncatalogued string in all records stands for the only missing one
    catalogue = spark.createDataFrame([("rollout", k, f, t, True) for k, fields in kinds.items() for f, t in fields.items()], "stream string, record_kind string, field string, json_type string, required boolean")
    calls = orphans.call_references(rollout, catalogue)
    assert {(r["row_id"], r["call_id"]) for r in calls.collect()} == {(1, "c1"), (2, "c1"), (3, "c2"), (4, "c1"), (5, "c1"), (5, "c9"), (7, "c8"), (7, "c9")}
    empty = lambda schema: spark.createDataFrame([], schema)
    refs, targets = orphans.references_and_targets(empty("row_id bigint, message_id string, session_id string, loaded_at timestamp"), empty("id string, loaded_at timestamp"), empty("id string, loaded_at timestamp"), rollout, catalogue)
    dead = empty("entity string, record_key string, deleted_at timestamp, restored_at timestamp")
    assert {(r["row_id"], r["reason"]) for r in orphans.find_orphans(refs, targets, dead).select("row_id", "reason").distinct().collect()} == {(3, "missing"), (5, "missing"), (7, "missing")}


def test_counts_of_months(spark):
    rows = [("late", "2025-01-05"), ("late", "2025-01-25"), ("late", "2025-02-01"), ("late", None), ("none", "2025-01-05"), ("none", None), ("there", "2025-03-01")]
    refs = spark.createDataFrame([("t", i, "f", "message", "", k, at) for i, (k, at) in enumerate(rows)], "tbl string, row_id bigint, field string, entity string, scope string, key string, loaded_at string").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    targets = spark.createDataFrame([("message", "", "late", "2025-01-20"), ("message", "", "there", "2024-01-01")], "entity string, scope string, key string, loaded_at string").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    dead = spark.createDataFrame([], "entity string, record_key string, deleted_at timestamp, restored_at timestamp")
    for share in (1e-9, 2.0):
        assert {(r["reason"], r["month"], r["n"]) for r in orphans.count_orphans(refs, targets, dead, share).collect()} == {("late", "2025-01", 1), ("missing", "2025-01", 1), ("missing", None, 1)}


def test_nested_like_brute_force(spark, duck, sf_dir):
    want = set()

    def visit(value, path, tbl, row):
        if isinstance(value, dict):
            for k, v in value.items():
                visit(v, f"{path}.{k}", tbl, row)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                if isinstance(v, dict):
                    want.add((tbl, row, f"{path}[{i}]"))
                visit(v, f"{path}[{i}]", tbl, row)

    for tbl, column, root in (("session_one", "message.content", "content"), ("oc_part", "data", "data"), ("oc_message", "data", "data")):
        for row, text in duck.execute(f"select row_id, {column} from {tbl} where {column} is not null").fetchall():
            try:
                o = json.loads(text)
                visit(json.loads(o) if root == "data" and isinstance(o, str) else o, root, tbl, row)
            except ValueError:
                continue
    assert want and {tuple(r) for r in nested.p4_found(spark, sf_dir).collect()} == want


def test_dewey_labels(spark):
    deep = "[" * 300 + '{"a": 1}' + "]" * 300
    texts = ['{"a":[{"b":{"c":[{}]}},2,"x"]}', None, "", "{cut", '"{\\"a\\":[{}]}"', deep, "[]", '{"k\\ud800":[{}]}']
    df = spark.createDataFrame([("t", i, "data", True, t) for i, t in enumerate(texts)], "tbl string, row_id bigint, root string, unwrap boolean, json string")
    nodes = nested.dewey_nodes(df).withColumn("parent", nested.parent_of(F.col("label")))
    by = {(r["row_id"], r["label"]): r for r in nodes.collect()}
    for (row, label), node in by.items():
        assert (node["parent"] is None) == (label == "0")
        if node["parent"] is not None:
            assert node["path"].startswith(by[row, node["parent"]]["path"])
    assert {r["path"] for r in by.values() if r["row_id"] == 0 and r["in_array"] and r["kind"] == "object"} == {"data.a[0]", "data.a[0].b.c[0]"}
    assert {(r["row_id"], r["path"][-4:]) for r in nested.array_objects(df).collect() if r["row_id"] not in (0, 7)} == {(4, "a[0]"), (5, "][0]")}
    rows = {r["label"]: r["parent_label"] for r in nested.child_table(nested.dewey_nodes(df.where("row_id = 0")), "data.a[].b.c[]").collect()}
    assert rows == {"0.0.0.0.0.0": "0.0.0.0"}


def test_any_depth_and_any_number(spark):
    deep, digits = 100_000, "9" * 5000
    texts = ["[" * deep + '{"a": 1}' + "]" * deep, '{"n":[{"k":%s,"x":1.50}]}' % digits, '{"a":' * 20_000 + "[{}]" + "}" * 20_000, '[{"a":NaN}]', "[" * deep, '[{"a":1},]', '{"a.b":[{"c]":1}],"a":{"b":[{}]}}']
    df = spark.createDataFrame([("t", i, "data", True, t) for i, t in enumerate(texts)], "tbl string, row_id bigint, root string, unwrap boolean, json string")
    assert [(r["row_id"], len(r["path"])) for r in nested.array_objects(df).orderBy("row_id", "path").collect()] == [(0, 4 + 3 * deep), (1, len("data.n[0]")), (2, 4 + 2 * 20_000 + 3), (6, 11), (6, 11)]
    rows = {(r["row_id"], r["schema_path"]): {f["name"]: f["value"] for f in r["fields"]} for r in nested.array_tables(df.where("row_id in (1, 6)")).collect()}
    assert rows[1, "data.n[]"] == {"k": digits, "x": "1.50"} and rows[6, 'data["a.b"][]'] == {'["c]"]': "1"} and rows[6, "data.a.b[]"] == {}
    assert {r["schema_path"] for r in nested.schema_paths(df.where("row_id = 6")).collect()} == {"data", 'data["a.b"]', 'data["a.b"][]', 'data["a.b"][]["c]"]', "data.a", "data.a.b", "data.a.b[]"}


def test_deep_reader_like_json():
    for text in ("[]", "{}", '[[],{}]', '{"a":[1,2,{"b":null}],"a":3}', ' [ 1 , "x\\n\\ud83d\\ude00" , true ] ', "3", '"s"', '{"a":{}}', "[1e5,-0.5]"):
        assert nested.read_deep(text) == nested._loads(text)
    for text in ("[1,]", '{"a":1,}', "[1 2]", '{"a" 1}', "{a:1}", "[", '{"a":}', "[1]x", "", "{,}", "[,1]", "tru", "01", '"a', "[NaN]", "}", "[}"):
        with pytest.raises(ValueError):
            nested.read_deep(text)
        assert nested._read(text, False) is None


def test_array_objects_are_dewey_nodes(spark, monkeypatch):
    texts = ['{"a":[{"b":[{},1]}]}', '"{\\"a\\":\\u005b{}]}"']
    df = spark.createDataFrame([("t", i, "data", True, t) for i, t in enumerate(texts)], "tbl string, row_id bigint, root string, unwrap boolean, json string")
    every = nested.dewey_nodes(df).where("kind = 'object' and in_array")
    labelled = {tuple(r) for r in every.collect()}
    assert {tuple(r) for r in nested.dewey_nodes(df, array_objects_only=True).collect()} == labelled
    assert {(r, p) for _, r, p, *_ in labelled} == {(0, "data.a[0]"), (0, "data.a[0].b[0]"), (1, "data.a[0]")}
    seen = []
    monkeypatch.setattr(nested, "dewey_nodes", lambda *a, real=nested.dewey_nodes, **k: (seen.append(1), real(*a, **k))[1])
    assert {(r["row_id"], r["path"]) for r in nested.array_objects(df).collect()} == {(r, p) for _, r, p, *_ in labelled} and seen


def test_tables_hold_every_scalar(spark, sf_dir):
    text = '{"r":1,"a":[{"i":{"x":"u"},"i.x":"v","y[]":null,"t":[1,"w"],"f":[{"h":[{"n":true}]}]}]}'
    df = spark.createDataFrame([("t", 0, "data", True, text), ("t", 1, "data", True, '"plain"')], "tbl string, row_id bigint, root string, unwrap boolean, json string")
    got = {r["schema_path"]: (r["label"], r["parent_label"], sorted((f["name"], f["value"]) for f in r["fields"] if f["value"])) for r in nested.array_tables(df).collect()}
    assert got == {
        "data": ("0", None, [("r", "1")]), "data.a[]": ("0.1.0", "0", [('["i.x"]', "v"), ("i.x", "u"), ("t[0]", "1"), ("t[1]", "w")]),
        "data.a[].f[]": ("0.1.0.4.0", "0.1.0", []), "data.a[].f[].h[]": ("0.1.0.4.0.0.0", "0.1.0.4.0", [("n", "true")]),
    }
    tables = nested.p4_tables(spark, sf_dir).cache()
    found = tables.where("endswith(schema_path, '[]')")
    assert {tuple(r) for r in found.select("tbl", "row_id", "path").collect()} == {tuple(r) for r in nested.p4_found(spark, sf_dir).collect()}
    rows = {(r["tbl"], r["row_id"], r["label"]): r for r in tables.collect()}
    assert all(r["parent_label"] is None or (r["tbl"], r["row_id"], r["parent_label"]) in rows for r in rows.values())
    documents = nested.nested_documents(spark, sf_dir)
    scalars = nested.dewey_nodes(documents).where("kind not in ('object', 'array') and label <> '0'").count()
    assert scalars == sum(len(r["fields"]) for r in rows.values())
    assert nested.p4_hunks(spark, sf_dir).count() == tables.where("tbl = 'oc_part' and schema_path = 'data.state.metadata.files[].hunks[]'").count() > 0
