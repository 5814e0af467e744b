"""Column expressions over JSON payloads whose field names drift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of payload that a rollout record can be (catalogue of the store).
PAYLOAD_KINDS = (
    "session_meta", "user_message", "agent_message", "exec_command_end",
    "turn_aborted", "message", "function_call", "function_call_output",
)

KIND_FIELDS = ("type", "kind")


def fields_of(json_text: Column) -> Column:
    """Top-level fields of a JSON object as ``map<string,variant>``; null if unreadable or no object."""
    return F.from_json(json_text, "map<string,variant>")


def plain_name(name: Column) -> Column:
    """A field name without case, separators and the usual marks of a renamed copy."""
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.regexp_replace(bare, "^x(?=callid|type|kind|message|timestamp)|(?:v\\d+|value)$", "")


def text_of(fields: Column, key: str) -> Column:
    return F.try_variant_get(fields[F.lit(key)], "$", "string")


def _known_kind(value: Column) -> Column:
    """The kind that a variant names: itself, its ``name``, or the first of its elements that is one."""
    known = list(PAYLOAD_KINDS)
    own, name = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$.name", "string")
    listed = F.get(F.filter(F.try_variant_get(value, "$", "array<string>"), lambda x: x.isin(known)), F.lit(0))
    return F.coalesce(F.when(own.isin(known), own), F.when(name.isin(known), name), listed)


def payload_kind(record_type: Column, fields: Column) -> Column:
    """Kind of a rollout record, whatever field or form holds its name; null if none is known."""
    entries = F.map_entries(fields)
    renamed = F.filter(entries, lambda e: plain_name(e["key"]).isin("type", "kind") & _known_kind(e["value"]).isNotNull())
    anywhere = F.filter(entries, lambda e: _known_kind(e["value"]).isNotNull())
    return F.when(record_type == "session_meta", F.lit("session_meta")).otherwise(
        F.coalesce(*(_known_kind(fields[F.lit(k)]) for k in KIND_FIELDS), _known_kind(F.get(renamed, F.lit(0))["value"]), _known_kind(F.get(anywhere, F.lit(0))["value"]))
    )


def ids_in(value: Column) -> Column:
    """The identifiers that a variant holds: itself, or each of its elements; no null and no empty ones."""
    ids = F.coalesce(F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<string>")), F.array(F.try_variant_get(value, "$", "string")))
    return F.array_distinct(F.filter(ids, lambda v: v.isNotNull() & (v != "")))


def call_ids_of(fields: Column) -> Column:
    """The calls that a payload names, under whichever spelling of ``call_id``; null if no field is spelled so."""
    held = F.filter(F.map_entries(fields), lambda e: plain_name(e["key"]) == "callid")
    ids = F.transform(held, lambda e: ids_in(e["value"]))
    return F.when(F.size(held) > 0, F.coalesce(F.get(F.filter(ids, lambda x: F.size(x) > 0), F.lit(0)), F.array().cast("array<string>")))


def json_type_of(value: Column) -> Column:
    """JSON type of a variant: string, number, boolean, object, array; null for a null."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "STRING", "string")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.isNull() | (schema == "VOID"), None)
        .otherwise("number")
    )
