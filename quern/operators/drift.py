"""Schemas that drift between files (problem 2).

Tagged-union inference: the fields of every record are tagged with their JSON type
and fused per file and kind into ``field -> {type: records}``, keeping every
alternative. Fusing is a plain aggregate with map-side combine, so neither a large
file nor a frequent kind is a hot spot; what is gathered per file and kind is one
entry per distinct field. The fused schemas are compared with the catalogue to
report changes, and each record is read into the catalogue's table of its kind: a
canonical column, a typed branch for each other type a value may have, and all other
fields in a map. Alternatives come with the first and last arrival of a record that holds them.

Defined results: unreadable payloads and payloads that are no object have no fields;
null values have no type but their field is present; kinds not in the catalogue are
left out; numbers keep their digits (text, and decimal(38) where it is a whole number); a value that the canonical type cannot
hold is null there and stands in its branch; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.payloads import fields_of, json_type_of, payload_kind
from quern.session import cut_lineage, evaluated, table

FILE_KIND = ["stream", "file_name", "record_kind"]


def typed_records(rollout: DataFrame, export: DataFrame) -> DataFrame:
    """Records of both streams: ``stream, row_id, file_name, record_kind, fields, json, loaded_at``."""
    a = evaluated(rollout.select(F.lit("rollout").alias("stream"), "row_id", F.col("log_file").alias("file_name"), F.col("type"), F.col("payload").alias("json"), "loaded_at"), {"fields": fields_of(F.col("json"))})
    a = evaluated(a, {"record_kind": payload_kind(F.col("type"), F.col("fields"))}).drop("type")
    b = evaluated(export.select(F.lit("session_export").alias("stream"), "row_id", F.col("export_file").alias("file_name"), F.col("record").alias("json"), "loaded_at"), {"fields": fields_of(F.col("json")), "record_kind": F.lit("session")})
    return a.unionByName(b).where("fields is not null and record_kind is not null")


def fuse_schemas(records: DataFrame, timed: bool = False) -> DataFrame:
    """Tagged unions per file and kind: ``records`` and ``fields: [{field, n, types}]``, alternatives ``timed`` if asked for."""
    # records of one file mostly have one shape: counting shapes first leaves few rows to shuffle,
    # and what follows is grouped within the partitions of a file and kind
    shape = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field"), json_type_of(e["value"]).alias("json_type"))))
    times = [F.min("loaded_at").alias("first_seen"), F.max("loaded_at").alias("last_seen")] if timed else []
    again = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")] if timed else []
    seen = ["first_seen", "last_seen"] if timed else []
    shapes = records.select(*FILE_KIND, "loaded_at", shape.alias("shape")).groupBy(*FILE_KIND, "shape").agg(F.count("*").alias("n"), *times).repartition(*FILE_KIND)
    # one entry without a name stands for the record itself
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("json_type")))
    tagged = shapes.select(*FILE_KIND, "n", *seen, F.explode(F.concat(whole, "shape")).alias("e")).select(*FILE_KIND, "n", *seen, "e.field", "e.json_type")
    per_type = tagged.groupBy(*FILE_KIND, "field", "json_type").agg(F.sum("n").alias("n"), *again)
    alternatives = F.collect_list(F.when(F.col("json_type").isNotNull(), F.struct("json_type", "n", *seen)))
    per_field = per_type.groupBy(*FILE_KIND, "field").agg(F.sum("n").alias("n"), F.array_sort(alternatives).alias("types"))
    return per_field.groupBy(FILE_KIND).agg(
        F.max(F.when(F.col("field").isNull(), F.col("n"))).alias("records"),
        F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "n", "types")))).alias("fields"),
    )


def catalogue_of(field_catalog: DataFrame) -> DataFrame:
    """One row per stream and kind; the catalogue does not grow with the data."""
    return field_catalog.groupBy("stream", "record_kind").agg(F.sort_array(F.collect_list(F.struct("field", "json_type", "required"))).alias("wanted"))


def schema_changes(fused: DataFrame, field_catalog: DataFrame) -> DataFrame:
    """Changes of each file against the catalogue: ``…, field, change``."""
    df = fused.join(F.broadcast(catalogue_of(field_catalog)), ["stream", "record_kind"])
    have, wanted = F.col("fields"), F.col("wanted")
    have_names, wanted_names = F.transform(have, lambda f: f["field"]), F.transform(wanted, lambda c: c["field"])
    df = df.withColumns(
        {
            "absent": F.filter(wanted, lambda c: c["required"] & ~F.array_contains(have_names, c["field"])),
            "unknown": F.filter(have, lambda f: ~F.array_contains(wanted_names, f["field"])),
            "retyped": F.filter(wanted, lambda c: F.exists(have, lambda f: (f["field"] == c["field"]) & F.exists(f["types"], lambda t: t["json_type"] != c["json_type"]))),
        }
    )

    def sole(c):
        return F.size(F.filter("absent", lambda a: a["json_type"] == c["json_type"])) == 1

    def stand_ins(c):
        return F.filter("unknown", lambda f: (f["n"] == F.col("records")) & (F.size(f["types"]) == 1) & (F.get(f["types"], F.lit(0))["json_type"] == c["json_type"]))

    df = df.withColumn(
        "judged",
        F.transform("absent", lambda c: F.struct(c["field"].alias("field"), F.when(sole(c) & (F.size(stand_ins(c)) == 1), F.get(stand_ins(c), F.lit(0))["field"]).alias("now"))),
    )
    taken = F.transform("judged", lambda j: j["now"])
    rows = F.concat(
        F.transform("retyped", lambda c: F.struct(c["field"].alias("field"), F.lit("retyped").alias("change"), F.lit(None).cast("string").alias("now"))),
        F.transform("judged", lambda j: F.struct(j["field"].alias("field"), F.when(j["now"].isNull(), "removed").otherwise("renamed").alias("change"), j["now"].alias("now"))),
        F.transform(F.filter("unknown", lambda f: ~F.coalesce(F.array_contains(taken, f["field"]), F.lit(False))), lambda f: F.struct(f["field"].alias("field"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("now"))),
    )
    return df.select(*FILE_KIND, F.explode(rows).alias("r")).select(*FILE_KIND, "r.field", "r.change", "r.now")


BRANCHES = ("string", "number", "boolean", "object", "array")


def _typed(text, json_type: str):
    """JSON text, or that of a string, as a column of a type; null where it cannot be read so."""
    if json_type == "number":
        return F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(text.isin("true", "false"), text == "true") if json_type == "boolean" else text


NUMBER = r"^\s*-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\s*$"


def field_values(records: DataFrame, changes: DataFrame, field_catalog: DataFrame) -> DataFrame:
    """Every value of every record in one form: ``stream, row_id, file_name, record_kind, field, held_as, json_type, value, part``.

    ``field`` is the catalogue's name, ``held_as`` the one in the file; ``part`` is ``canonical``, ``branch`` (another type than the
    catalogue's) or ``extra`` (no catalogued field). ``value`` is the string, or the JSON text as written.
    """
    renames = changes.where("change = 'renamed'").groupBy(FILE_KIND).agg(F.map_from_entries(F.collect_list(F.struct("now", "field"))).alias("renames"))
    wanted = F.broadcast(field_catalog.groupBy("stream", "record_kind").agg(F.map_from_entries(F.collect_list(F.struct("field", "json_type"))).alias("wanted")))  # a fixed table
    rows = records.join(wanted, ["stream", "record_kind"]).join(renames, FILE_KIND, "left")
    rows = evaluated(rows, {"texts": F.from_json("json", "map<string,string>")}).drop("json")
    entries = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("held_as"), json_type_of(e["value"]).alias("json_type"), F.col("texts")[e["key"]].alias("value")))
    flat = rows.select("stream", "row_id", "file_name", "record_kind", "wanted", "renames", F.inline(entries)).where("json_type is not null")
    flat = flat.withColumn("field", F.coalesce(F.when(F.col("wanted")[F.col("held_as")].isNotNull(), F.col("held_as")), F.col("renames")[F.col("held_as")], "held_as"))
    part = F.when(F.col("wanted")[F.col("field")].isNull(), "extra").when(F.col("wanted")[F.col("field")] == F.col("json_type"), "canonical").otherwise("branch")
    return flat.select("stream", "row_id", "file_name", "record_kind", "field", "held_as", "json_type", "value", part.alias("part"))


def unify_kind(records: DataFrame, changes: DataFrame, catalogue: list, stream: str, kind: str) -> DataFrame:
    """All files of one kind in one table as in the catalogue.

    A catalogued field has a column of its type, holding other types where they can be read as it; for a
    value of another type also ``<field>__type`` and the typed branches ``<field>__string``, ``__number``, ``__boolean``,
    ``__object`` and ``__array`` (the last two as JSON text), and for a number ``<field>__digits`` (decimal(38) of a whole number).
    A renamed field is read under its present name. Fields that are not catalogued are kept in ``extra``, as JSON text by name.
    """
    own = records.where((F.col("stream") == stream) & (F.col("record_kind") == kind))
    renames = (
        changes.where((F.col("stream") == stream) & (F.col("record_kind") == kind) & (F.col("change") == "renamed"))
        .groupBy("file_name")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "now"))).alias("renames"))
    )
    own = evaluated(own.join(renames, "file_name", "left"), {"texts": F.from_json("json", "map<string,string>")}).drop("json")
    wanted = sorted((c["field"], c["json_type"]) for c in catalogue if (c["stream"], c["record_kind"]) == (stream, kind))
    own = evaluated(own, {f"name_{i}": F.coalesce(F.when(F.map_contains_key("fields", F.lit(field)), F.lit(field)), F.col("renames")[field], F.lit(field)) for i, (field, _) in enumerate(wanted)} | {"none": F.lit(None).cast("string")})
    own = evaluated(own, {f"type_{i}": json_type_of(F.element_at("fields", F.col(f"name_{i}"))) for i in range(len(wanted))} | {"no_type": F.lit(None).cast("string")})
    columns = ["row_id", "file_name", "loaded_at"]
    for i, (field, json_type) in enumerate(wanted):
        text, held = F.element_at("texts", F.col(f"name_{i}")), F.col(f"type_{i}")
        # a string column holds any value as text, other columns their own type and strings that read as it
        readable = held.isNotNull() if json_type == "string" else held.isin(json_type, "string") if json_type in ("number", "boolean") else held == json_type
        columns.append(F.when(readable, _typed(text, json_type)).alias(field))
        if json_type == "number":
            columns.append(F.when(held.isin("number", "string") & text.rlike(r"^\s*-?[0-9]{1,38}\s*$"), text.try_cast("decimal(38,0)")).alias(f"{field}__digits"))
        columns.append(F.when(held != json_type, held).alias(f"{field}__type"))
        columns += [F.when(held == b, _typed(text, b)).alias(f"{field}__{b}") for b in BRANCHES if b != json_type]
    known = F.array(*(F.col(f"name_{i}") for i in range(len(wanted))), *(F.lit(field) for field, _ in wanted))
    columns.append(F.map_filter("texts", lambda k, v: ~F.array_contains(known, k)).alias("extra"))
    return own.select(*columns)


def _records(spark, sf_dir: str) -> DataFrame:
    return typed_records(table(spark, sf_dir, "rollout"), table(spark, sf_dir, "session_export"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Every change of a field: ``stream, file_name, record_kind, field, change``."""
    return schema_changes(fuse_schemas(_records(spark, sf_dir)), table(spark, sf_dir, "field_catalog")).drop("now")


def p2_unions(spark, sf_dir: str) -> DataFrame:
    """Tagged union of each field over all files: the alternative types, how many records and files hold each, and where and when each appeared first and last."""
    fused = fuse_schemas(_records(spark, sf_dir), timed=True)
    flat = fused.select(*FILE_KIND, F.explode("fields").alias("f")).select(*FILE_KIND, "f.field", F.explode("f.types").alias("t"))
    return flat.groupBy("stream", "record_kind", "field", F.col("t.json_type").alias("json_type")).agg(
        F.sum("t.n").alias("records"), F.count("*").alias("files"), F.min("t.first_seen").alias("first_seen"), F.max("t.last_seen").alias("last_seen"),
        F.min_by("file_name", F.struct("t.first_seen", "file_name")).alias("first_file"), F.max_by("file_name", F.struct("t.last_seen", "file_name")).alias("last_file"),
    )


def p2_values(spark, sf_dir: str) -> DataFrame:
    """All values of all files under the catalogue's names; the tables of the kinds are its columns."""
    records, catalogue = cut_lineage(_records(spark, sf_dir)), table(spark, sf_dir, "field_catalog")
    return field_values(records, schema_changes(fuse_schemas(records), catalogue), catalogue)


def unified_table(stream: str, kind: str):
    def query(spark, sf_dir: str) -> DataFrame:
        # schemas are fused per file and kind, so the other kinds and the other stream are not read any further
        records = cut_lineage(_records(spark, sf_dir).where((F.col("stream") == stream) & (F.col("record_kind") == kind)))
        catalogue = table(spark, sf_dir, "field_catalog")
        changes = schema_changes(fuse_schemas(records), catalogue)
        return unify_kind(records, changes, catalogue.collect(), stream, kind)  # the catalogue is a fixed table

    return query
