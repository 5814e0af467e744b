"""The registry of stores and their reading as far as it goes."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import project_slug
from quern.operators import adapters
from quern.sources.files import log_files, read_lines, session_files
from quern.sources.sqlite import read_sqlite

EVENTS = "store string, sid string, at timestamp, kind string, role string, text string, skill string, route string, tool string, seq struct<pos:bigint,id:string,sub:int>"
TABLES = {
    "session": "id string, slug string, directory string, title string, version string, time_created bigint, time_updated bigint",
    "message": "id string, session_id string, time_created bigint, time_updated bigint, data string",
    "part": "id string, message_id string, session_id string, time_created bigint, time_updated bigint, data string",
}


@dataclass(frozen=True)
class Reading:
    name: str
    location: str
    present: bool
    sessions: DataFrame | None
    events: DataFrame | None
    note: str | None = None


def _ordered(events: DataFrame) -> DataFrame:
    pos = F.col("seq.pos")
    if dict(events.select(pos).dtypes)["pos"].startswith("struct"):
        seq = F.struct(F.col("seq.pos.time_created").alias("pos"), F.col("seq.pos.id").alias("id"), F.col("seq.sub").alias("sub"))
    else:
        seq = F.struct(pos.cast("bigint").alias("pos"), F.lit("").alias("id"), F.col("seq.sub").alias("sub"))
    return events.select("store", "sid", "at", "kind", "role", "text", "skill", "route", "tool", seq.alias("seq"))


def read_claude(spark, root, project=None, since=None):
    """A4: session logs in project directories."""
    lines = read_lines(spark, root, session_files(root, project, since and since.timestamp()))
    records = adapters.parse_records(lines)
    timed = adapters.zoned_time(records.withColumn("t", F.try_variant_get("v", "$.timestamp", "string")), F.col("t")).drop("t")
    return adapters.line_sessions(records), adapters.block_events(timed, since)


def read_codex(spark, root, project=None, since=None):
    """Rollout logs in date directories; the project is known only once a log is read."""
    records = adapters.parse_records(read_lines(spark, root, log_files(root, since=since and since.timestamp())))
    get = lambda p: F.try_variant_get("v", p, "string")
    rows = records.select("file", "pos", get("$.type").alias("type"), get("$.timestamp").alias("t"), F.coalesce(F.try_variant_get("v", "$.payload", "variant"), F.parse_json(F.lit("{}"))).alias("payload"))
    rows = adapters.zoned_time(rows, F.col("t")).drop("t")
    sessions = adapters.rollout_sessions(rows)
    if project is not None:
        sessions = sessions.where(F.col("project") == project)
    return sessions, adapters.rollout_events(rows, since).join(sessions.select("sid"), "sid", "left_semi")


def read_opencode(spark, path, project=None, since=None):
    """A SQLite store."""
    t = {name: read_sqlite(spark, path, name, schema) for name, schema in TABLES.items()}
    since_ms = since and int(since.timestamp() * 1000)
    sessions = adapters.stored_sessions(t["session"], since_ms)
    if project is not None:
        sessions = sessions.where(F.col("project") == project)
    events = adapters.part_events(t["message"], t["part"], since_ms).join(sessions.select("sid"), "sid", "left_semi")
    return sessions, events


#: name -> (reader, where it lies by default, whether that is a directory)
STORES: dict[str, tuple[Callable, str, Callable]] = {
    "claude": (read_claude, "~/.claude/projects", os.path.isdir),
    "codex": (read_codex, "~/.codex/sessions", os.path.isdir),
    "opencode": (read_opencode, "~/.local/share/opencode/opencode.db", os.path.isfile),
}


def selected_names(choice: str) -> list[str]:
    """One store or all; an unknown name is refused."""
    if choice == "all":
        return sorted(STORES)
    if choice not in STORES:
        raise ValueError(f"unknown store {choice}; known: {', '.join(sorted(STORES))}, all")
    return [choice]


def chosen_project(named: str | None, every: bool, cwd: str, spark: SparkSession) -> str | None:
    """All projects before a named one before that of the working directory."""
    if every:
        return None
    return named or spark.range(1).select(project_slug(F.lit(cwd)).alias("p")).first()["p"]


def build_stores(spark: SparkSession, choice: str = "all", locations: dict[str, str] | None = None, project: str | None = None, since=None) -> list[Reading]:
    """Each selected store, read or with a note why not; one that fails leaves the others whole."""
    found = []
    for name in selected_names(choice):
        reader, default, exists = STORES[name]
        where = (locations or {}).get(name, os.path.expanduser(default))
        if not exists(where):
            found.append(Reading(name, where, False, None, None, f"store {name}: nothing at its place"))
            continue
        try:
            sessions, events = reader(spark, where, project, since)
            found.append(Reading(name, where, True, sessions, _ordered(events)))
        except Exception as error:  # noqa: BLE001 - whatever breaks one store is reported beside the others
            found.append(Reading(name, where, True, None, None, f"store {name}: {type(error).__name__}"))
    return found


def all_store_events(spark: SparkSession, readings: list[Reading]) -> DataFrame:
    """Events of the stores that could be read."""
    parts = [r.events for r in readings if r.events is not None]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], EVENTS)
