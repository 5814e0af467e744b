"""Logs of three runtimes as normalised events (B).

Each adapter takes records ``file, pos, line`` (JSON text, position in the file) or the
tables of a store, and gives ``events_norm`` rows: ``store, sid, seq, kind, role, text, at,
skill, route, tool``. What one record yields is an array in the order it happened, exploded
with its ordinal, so the order of events needs no further sort key. Union-typed bodies
(a string, or a list of blocks) are read through VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.instants import read_times
from quern.session import evaluated, table

UNNAMED = "unknown"
ROLES = ("user", "assistant")
#: Other words for the roles in stored messages.
SPELLINGS = {"human": "user", "ai": "assistant", "model": "assistant"}
EVENT = "struct<kind:string,role:string,text:string,skill:string,route:string,tool:string>"


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def string_at(v: Column, path: str) -> Column:
    """The value at a path if it is a JSON string."""
    held = get(v, path, "variant")
    return F.when(F.schema_of_variant(held) == "STRING", get(held, "$", "string"))


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def event(kind: str, **values: Column) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), *(values.get(c, empty).alias(c) for c in ("role", "text", "skill", "route", "tool")))


def when_array(condition: Column, *events: Column) -> Column:
    return F.when(condition, F.array(*events)).otherwise(F.array().cast(f"array<{EVENT}>"))


def parse_records(lines: DataFrame) -> DataFrame:
    """A2: JSON objects only; blank, malformed and other lines are left out."""
    rows = lines.select("file", "pos", F.try_parse_json("line").alias("v"))
    return rows.where(F.col("v").isNotNull() & is_object(F.col("v")))


def unreadable_lines(lines: DataFrame) -> DataFrame:
    """A2: how many non-blank lines of a file were not read (repeated keys and NaN among them)."""
    return lines.where(F.col("line").rlike(r"\S") & F.try_parse_json("line").isNull()).groupBy("file").agg(F.count("*").alias("unreadable"))


def zoned_time(df: DataFrame, text: Column, name: str = "at") -> DataFrame:
    """ISO text as an instant; a time without zone is UTC; anything else null."""
    df = read_times(df, F.when(text.rlike(r"^\d{4}-"), text), "z_")
    second = F.coalesce("z_sec", "z_local")
    return df.withColumn(name, F.timestamp_micros(second * 1_000_000 + F.expr("z_nano div 1000"))).drop("z_sec", "z_local", "z_nano")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(tx.base_name(path), r"\.[^.]*$", "")


def emit(rows: DataFrame, store: str, events: Column, since=None) -> DataFrame:
    """One row per event; undated records and those before ``since`` yield none."""
    rows = rows.where("at is not null")
    if since is not None:
        rows = rows.where(F.col("at") >= since)
    flat = rows.select("file", "pos", "at", F.posexplode(events).alias("sub", "e"))
    return flat.select(F.lit(store).alias("store"), F.col("file").alias("sid"), F.struct("pos", "sub").alias("seq"), "at", "e.*")


# ------------------------------------------------------------------ blocks in messages


def blocks_of(content: Column) -> Column:
    """B1: object blocks of a body written as a list."""
    return F.filter(get(content, "$", "array<variant>"), is_object)


def spoken(content: Column) -> Column:
    """A plain string, or a block of text."""
    return (F.schema_of_variant(content) == "STRING") | F.coalesce(F.exists(blocks_of(content), lambda b: get(b, "$.type") == "text"), F.lit(False))


def utterance(content: Column, kinds: tuple[str, ...] = ("text",)) -> Column:
    """The whole body; an empty string is none, but empty text blocks join to an utterance."""
    parts = F.filter(F.transform(F.filter(blocks_of(content), lambda b: get(b, "$.type").isin(*kinds)), lambda b: string_at(b, "$.text")), lambda t: t.isNotNull())
    return F.when(F.schema_of_variant(content) == "STRING", F.nullif(get(content, "$", "string"), F.lit(""))).when(F.size(parts) > 0, F.array_join(parts, "\n"))


def fitted_name(name: Column) -> Column:
    """Without ``plugin:`` where the name fits; as written otherwise."""
    fitted = F.regexp_extract(name, r"^([a-z][a-z0-9-]*):([a-z][a-z0-9-]*)$", 2)
    return F.nullif(F.coalesce(F.nullif(fitted, F.lit("")), name), F.lit(""))


def said_events(said: Column) -> Column:
    """An utterance and the firing of a slash command in it."""
    fired = tx.slash_skill(said)
    return F.concat(when_array(said.isNotNull(), event("text", text=said)), when_array(fired.isNotNull(), event("fire", skill=fired, route=F.lit("text"))))


def latest_call(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Name the failing tool by the last earlier call of that id in the file, whatever the period.

    Both sides meet by file and id in one sorted window, not by a range join.
    """
    asks = rows.where("answered is not null").select("file", F.col("answered").alias("id"), "pos", F.lit(None).cast("string").alias("name"), F.lit(1).alias("side"))
    both = calls.select("file", "id", "pos", "name", F.lit(0).alias("side")).unionByName(asks)
    w = Window.partitionBy("file", "id").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0)
    named = both.withColumn("tool", F.last("name", True).over(w)).where("side = 1").select("file", "pos", "tool").dropDuplicates(["file", "pos"])
    return rows.join(named, ["file", "pos"], "left").withColumn("tool", F.when(F.col("failed"), F.coalesce("tool", F.lit(UNNAMED))))


def block_events(records: DataFrame, since=None) -> DataFrame:
    """Events of session lines ``file, pos, v, at`` (``v``: the record)."""
    content, role = get(F.col("v"), "$.message.content", "variant"), get(F.col("v"), "$.message.role")
    rows = records.withColumns({"content": content, "role": F.when(role.isin(*ROLES), role)})
    errors = F.filter(blocks_of(F.col("content")), lambda b: (get(b, "$.type") == "tool_result") & F.coalesce(get(b, "$.is_error", "boolean"), F.lit(False)))
    beside = F.coalesce(get(F.col("v"), "$.toolUseResult.is_error", "boolean"), F.lit(False))
    rows = rows.withColumns({"failed": F.coalesce(F.size(errors) > 0, F.lit(False)) | beside, "answered": get(F.get(errors, F.lit(0)), "$.tool_use_id")})
    uses = F.filter(blocks_of(F.col("content")), lambda b: get(b, "$.type") == "tool_use")
    calls = rows.select("file", "pos", F.explode(uses).alias("b")).select("file", "pos", string_at(F.col("b"), "$.id").alias("id"), string_at(F.col("b"), "$.name").alias("name")).where("id is not null and name is not null")
    rows = latest_call(rows, calls)
    skills = F.filter(F.transform(F.filter(uses, lambda b: get(b, "$.name").isin("Skill", "skill")), lambda b: fitted_name(string_at(b, "$.input.skill"))), lambda s: s.isNotNull())
    said = F.when(F.col("role") == "user", utterance(F.col("content")))
    events = F.concat(
        when_array(F.col("role").isNotNull() & spoken(F.col("content")), event("turn", role=F.col("role"))),
        said_events(said),
        F.coalesce(F.transform(skills, lambda s: event("fire", skill=s, route=F.lit("structural"))), F.array().cast(f"array<{EVENT}>")),
        when_array(F.col("failed"), event("error", tool=F.col("tool"))),
    )
    return emit(rows, "claude", events, since)


def rollout_events(records: DataFrame, since=None) -> DataFrame:
    """Events of rollout records ``file, pos, type, payload, at`` (``payload``: VARIANT)."""
    kind = get(F.col("payload"), "$.type")
    typed = (F.col("type") == "event_msg") & (kind == "user_message")
    rows = records.withColumn("spoken", kind)
    rows = rows.withColumn("interface", F.coalesce(F.bool_or(typed).over(Window.partitionBy("file")), F.lit(False)))
    code = get(F.col("payload"), "$.exit_code", "variant")
    status = F.coalesce(F.when(F.schema_of_variant(code) == "BIGINT", get(code, "$", "bigint")), get(code, "$", "boolean").cast("bigint"))
    rows = rows.withColumns({"failed": F.coalesce((F.col("spoken") == "exec_command_end") & (F.schema_of_variant(code).isin("BIGINT", "BOOLEAN")) & (status != 0), F.lit(False)), "answered": F.when(F.col("spoken") == "exec_command_end", get(F.col("payload"), "$.call_id"))})
    calls = rows.where("spoken in ('function_call', 'custom_tool_call')").select("file", "pos", string_at(F.col("payload"), "$.call_id").alias("id"), string_at(F.col("payload"), "$.name").alias("name")).where("id is not null and name is not null")
    rows = latest_call(rows, calls)
    role = get(F.col("payload"), "$.role")
    by_item = ~F.col("interface") & (F.col("type") == "response_item") & (F.col("spoken") == "message") & role.isin(*ROLES)
    by_face = F.col("interface") & (F.col("type") == "event_msg")
    body = utterance(get(F.col("payload"), "$.content", "variant"), ("input_text", "output_text"))
    said = F.nullif(F.when(by_item & (role == "user"), body).when(by_face & (F.col("spoken") == "user_message"), string_at(F.col("payload"), "$.message")), F.lit(""))
    speaker = F.when(by_item, role).when(by_face & (F.col("spoken") == "user_message"), "user").when(by_face & (F.col("spoken") == "agent_message"), "assistant")
    events = F.concat(when_array(speaker.isNotNull(), event("turn", role=speaker)), said_events(said), when_array(F.col("spoken") == "turn_aborted", event("abandoned")), when_array(F.col("failed"), event("error", tool=F.col("tool"))))
    return emit(rows, "codex", events, since)


def decoded(rows: DataFrame) -> DataFrame:
    """Rows whose ``data`` is a JSON object, also one encoded twice, as ``d``."""
    rows = evaluated(rows, {"v": F.try_parse_json("data")}).drop("data")
    inner = F.when(F.schema_of_variant("v") == "STRING", F.try_parse_json(get(F.col("v"), "$"))).otherwise(F.col("v"))
    return evaluated(rows, {"d": inner}).drop("v").where(F.col("d").isNotNull() & is_object(F.col("d")))


def part_events(messages: DataFrame, parts: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Events of stored messages ``id, session_id, time_created, data`` and their parts.

    Parts are put in order inside their message; a message without parts is kept. A document encoded twice is read
    as the inner one, and a role may have another name, capitals and space around it.
    """
    p = decoded(parts.select("message_id", "time_created", "id", "data"))
    kind, state = get(F.col("d"), "$.type"), get(F.col("d"), "$.state.status")
    skill = F.when((kind == "tool") & (get(F.col("d"), "$.tool") == "skill"), F.nullif(string_at(F.col("d"), "$.state.input.name"), F.lit("")))
    failure = F.when((kind == "tool") & (state == "error"), F.coalesce(F.nullif(string_at(F.col("d"), "$.tool"), F.lit("")), F.lit(UNNAMED)))
    said = F.when(kind == "text", F.nullif(string_at(F.col("d"), "$.text"), F.lit("")))
    p = p.select("message_id", F.struct("time_created", "id", (kind == "text").alias("is_text"), said.alias("said"), skill.alias("skill"), failure.alias("failure")).alias("p"))
    grouped = p.groupBy("message_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    m = decoded(messages.where("time_created is not null").select("id", "session_id", "time_created", "data"))
    m = m.join(grouped, F.col("id") == F.col("message_id"), "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<time_created:bigint,id:string,is_text:boolean,said:string,skill:string,failure:string>>")))
    role = F.lower(F.regexp_replace(get(F.col("d"), "$.role"), r"(?U)^\s+|\s+$", ""))
    role = F.coalesce(*(F.when(role == k, v) for k, v in SPELLINGS.items()), role)
    rows = m.select(F.col("session_id").alias("file"), F.struct("time_created", "id").alias("pos"), F.timestamp_millis(millis_of(F.col("time_created"))).alias("at"), F.when(role.isin(*ROLES), role).alias("role"), "parts")
    texts = F.filter(F.transform("parts", lambda x: x["said"]), lambda t: t.isNotNull())
    whole = F.when((F.col("role") == "user") & (F.size(texts) > 0), F.array_join(texts, "\n"))
    worked = F.flatten(F.transform("parts", lambda x: F.concat(when_array(x["skill"].isNotNull(), event("fire", skill=x["skill"], route=F.lit("structural"))), when_array(x["failure"].isNotNull(), event("error", tool=x["failure"])))))
    events = F.concat(when_array(F.col("role").isNotNull() & F.exists("parts", lambda x: x["is_text"]), event("turn", role=F.col("role"))), said_events(whole), worked)
    return emit(rows, "opencode", events, None if since_ms is None else F.timestamp_millis(F.lit(since_ms)))


def line_sessions(records: DataFrame) -> DataFrame:
    """A3: one session per file, named by its first readable record, even if all of it is out of period."""
    first = records.groupBy("file").agg(F.min_by(get(F.col("v"), "$.sessionId"), "pos").alias("id"))
    return first.select(F.lit("claude").alias("store"), F.col("file").alias("sid"), F.coalesce("id", file_stem(F.col("file"))).alias("session_id"), F.split("file", "/")[0].alias("project"), F.lit(False).alias("superset"))


def rollout_sessions(records: DataFrame) -> DataFrame:
    """One session per log: identifier, project slug and whether utterances are a superset."""
    opening = F.when(F.col("type") == "session_meta", F.struct(F.coalesce(string_at(F.col("payload"), "$.session_id"), string_at(F.col("payload"), "$.id")).alias("id"), string_at(F.col("payload"), "$.cwd").alias("cwd")))
    typed = (F.col("type") == "event_msg") & (get(F.col("payload"), "$.type") == "user_message")
    per = records.groupBy("file").agg(F.min_by(opening, F.when(opening.isNotNull(), F.col("pos"))).alias("o"), F.bool_or(F.coalesce(typed, F.lit(False))).alias("interface"))
    return per.select(F.lit("codex").alias("store"), F.col("file").alias("sid"), F.coalesce("o.id", file_stem(F.col("file"))).alias("session_id"), F.coalesce(tx.project_slug(F.col("o.cwd")), F.lit("")).alias("project"), (~F.col("interface")).alias("superset"))


def millis_of(time: Column) -> Column:
    """An integer time in milliseconds, whether written in seconds, milli-, micro- or nanoseconds."""
    size = F.abs(time)
    return F.when(size < 10**11, time * 1000).when(size < 10**14, time).when(size < 10**17, F.floor(time / 1000)).otherwise(F.floor(time / 1_000_000)).cast("bigint")


def stored_sessions(session: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Sessions of a store; without id or directory left out, pruned if last changed before the period."""
    rows = session.where("id is not null and directory is not null")
    if since_ms is not None:
        rows = rows.where(F.col("time_updated").isNull() | (F.col("time_updated") >= since_ms))
    return rows.select(F.lit("opencode").alias("store"), F.col("id").alias("sid"), F.col("id").alias("session_id"), tx.project_slug(F.col("directory")).alias("project"), F.lit(False).alias("superset"))


# ------------------------------------------------------------------ the project's own tables


def session_table_records(session: DataFrame) -> DataFrame:
    """``session_one`` as records: the columns of a line put back into one variant, copies left out."""
    first = session.groupBy("log_file", "line_no").agg(F.min("row_id").alias("row_id"))
    rows = session.join(first, ["log_file", "line_no", "row_id"], "left_semi")
    part = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    content = F.coalesce(F.when(F.try_parse_json(F.col("message.content")).isNotNull(), F.col("message.content")), F.lit("null"))
    message = F.when(F.col("message").isNotNull(), F.concat(F.lit("{"), part("role", F.coalesce(quoted(F.trim(F.lower("message.role"))), F.lit("null"))), F.lit(","), part("content", content), F.lit("}"))).otherwise(F.lit("null"))
    beside = F.coalesce(F.when(F.try_parse_json("tooluseresult").isNotNull(), F.col("tooluseresult")), F.lit("null"))
    text = F.concat(F.lit("{"), part("sessionId", F.coalesce(quoted(F.col("sessionid")), F.lit("null"))), F.lit(","), part("message", message), F.lit(","), part("toolUseResult", beside), F.lit("}"))
    rows = rows.select(F.col("log_file").alias("file"), F.col("line_no").alias("pos"), "timestamp", F.try_parse_json(text).alias("v"))
    return zoned_time(rows, F.col("timestamp")).drop("timestamp")


def rollout_table_records(rollout: DataFrame) -> DataFrame:
    first = rollout.groupBy("log_file", "line_no").agg(F.min("row_id").alias("row_id"))
    rows = rollout.join(first, ["log_file", "line_no", "row_id"], "left_semi").select(F.col("log_file").alias("file"), F.col("line_no").alias("pos"), "type", "timestamp", F.try_parse_json("payload").alias("payload"))
    return zoned_time(rows, F.col("timestamp")).drop("timestamp")


def all_events(spark, sf_dir: str) -> DataFrame:
    """Events of all three stores, in one table."""
    a = block_events(session_table_records(table(spark, sf_dir, "session_one")))
    b = rollout_events(rollout_table_records(table(spark, sf_dir, "rollout")))
    c = part_events(table(spark, sf_dir, "oc_message"), table(spark, sf_dir, "oc_part"))
    plain = lambda df: df.withColumn("seq", F.struct(F.coalesce(F.col("seq.pos").cast("bigint"), F.lit(0)).alias("pos"), F.lit("").alias("id"), F.col("seq.sub").alias("sub")))
    c = c.withColumn("seq", F.struct(F.col("seq.pos.time_created").alias("pos"), F.col("seq.pos.id").alias("id"), F.col("seq.sub").alias("sub")))
    return plain(a).unionByName(plain(b)).unionByName(c)


def b09_session_events(spark, sf_dir):
    events = block_events(session_table_records(table(spark, sf_dir, "session_one")))
    return events.select("sid", F.col("seq.pos").alias("pos"), F.col("seq.sub").alias("sub"), "kind", "role", "skill", "route", "tool")


def b13_part_events(spark, sf_dir):
    events = part_events(table(spark, sf_dir, "oc_message"), table(spark, sf_dir, "oc_part"))
    return events.select("sid", F.col("seq.pos.id").alias("message"), F.col("seq.sub").alias("sub"), "kind", "role", "skill", "route", "tool")


def b15_rollout_sessions(spark, sf_dir):
    return rollout_sessions(rollout_table_records(table(spark, sf_dir, "rollout")))


def b18_rollout_events(spark, sf_dir):
    events = rollout_events(rollout_table_records(table(spark, sf_dir, "rollout")))
    return events.select("sid", F.col("seq.pos").alias("pos"), F.col("seq.sub").alias("sub"), "kind", "role", "skill", "route", "tool")


def a09_stored_sessions(spark, sf_dir):
    return stored_sessions(table(spark, sf_dir, "oc_session"))


def c09_log_friction(spark, sf_dir):
    """Friction of skills over the three stores' logs."""
    from quern.operators import friction as fr

    events, caps = all_events(spark, sf_dir), fr.store_caps(spark)
    return fr.with_scores(fr.skill_friction(fr.session_skills(fr.firing_groups(fr.mark_firings(events))), fr.session_rows(events, caps), caps))


def c21_secret_kinds(spark, sf_dir):
    """Kinds of secrets in utterances, each kind with its masked form once."""
    said = all_events(spark, sf_dir).where("kind = 'text'")
    hits = said.withColumn("kinds", tx.secret_kinds(F.col("text"))).where("size(kinds) > 0")
    return hits.select(F.explode("kinds").alias("secret"), "store").groupBy("secret", "store").agg(F.count("*").alias("utterances"))
