"""References to records that do not exist (problem 1).

A reference is a row that names a key of another table. Each reference is found,
``deleted``, ``missing`` or ``late``. References are first counted per key and period
(map-side combine, so a hot key sends one row per task and period), with the first and last
arrival of each count. What a key's targets say is joined to these counts, not to the rows: that gives the
keys with orphans, and the counts per month come from it alone but for periods in which a
late target arrived. The rows are then met with these keys only, split by weight: keys
of at least ``heavy_share`` of all references, or of ``HEAVY_ROWS``, are looked up by
broadcast (at most ``1 / heavy_share`` keys and one for ``HEAVY_ROWS`` references), all
others by a shuffled join in which no key is large; both parts are united.

A payload may give ``call_id`` another name. Spellings of it are known by their letters; a file and
kind in which no record has one is read under the name that the schemas of problem 2 infer.

Defined results: null and empty keys are no references; a list of keys is a reference to each; null
``loaded_at`` of a reference is never late; a target with only null ``loaded_at`` is found; equal
rows are separate references; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.payloads import call_ids_of, fields_of, ids_in, payload_kind
from quern.operators.drift import fuse_schemas, schema_changes
from quern.session import cut_lineage, evaluated, table

KEY = ["entity", "scope", "key"]
HEAVY_SHARE, HEAVY_ROWS = 1 / 1000, 10_000_000
CALL_KINDS = ("exec_command_end", "function_call_output", "function_call")


def _references(df: DataFrame, tbl: str, field: str, entity: str, key, scope=None) -> DataFrame:
    return df.select(
        F.lit(tbl).alias("tbl"),
        F.col("row_id"),
        F.lit(field).alias("field"),
        F.lit(entity).alias("entity"),
        (F.lit("") if scope is None else F.coalesce(scope, F.lit(""))).alias("scope"),
        key.cast("string").alias("key"),
        F.col("loaded_at"),
    ).where("key is not null and key <> ''")


def call_references(rollout: DataFrame, field_catalog: DataFrame) -> DataFrame:
    """Calls named by command ends and call outputs, and the calls themselves: one row per named call."""
    parsed = evaluated(rollout.select("row_id", "log_file", "loaded_at", "type", "payload"), {"fields": fields_of(F.col("payload"))}).drop("payload")
    parsed = evaluated(parsed, {"kind": payload_kind(F.col("type"), F.col("fields"))}).drop("type").where(F.col("kind").isin(*CALL_KINDS))
    parsed = evaluated(parsed, {"call_ids": call_ids_of(F.col("fields"))})
    # payloads are parsed once: calls are needed as references, for their weights, and as targets
    read = cut_lineage(parsed.withColumn("fields", F.when(F.col("call_ids").isNull(), F.col("fields"))))
    named = read.where("call_ids is not null").drop("fields")
    unnamed = read.where("call_ids is null")
    if not unnamed.isEmpty():
        # a field is renamed only if no record of the file and kind has it
        lost = unnamed.join(named.select("log_file", "kind").distinct(), ["log_file", "kind"], "left_anti")
        records = lost.select(F.lit("rollout").alias("stream"), "row_id", F.col("log_file").alias("file_name"), F.col("kind").alias("record_kind"), "fields", "loaded_at")
        renames = schema_changes(fuse_schemas(records), field_catalog).where("change = 'renamed' and field = 'call_id'").select(F.col("file_name").alias("log_file"), F.col("record_kind").alias("kind"), "now")
        found = lost.join(renames, ["log_file", "kind"]).withColumn("call_ids", ids_in(F.col("fields")[F.col("now")]))
        named = named.unionByName(found.select(named.columns))
    return named.select("row_id", "log_file", "loaded_at", "kind", F.explode("call_ids").alias("call_id"))


def references_and_targets(part: DataFrame, message: DataFrame, session: DataFrame, rollout: DataFrame, field_catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    calls = call_references(rollout, field_catalog)
    refs = (
        _references(part, "oc_part", "message_id", "message", F.col("message_id"))
        .unionByName(_references(part, "oc_part", "session_id", "session", F.col("session_id")))
        .unionByName(_references(calls.where(F.col("kind").isin("exec_command_end", "function_call_output")), "rollout", "call_id", "call", F.col("call_id"), F.col("log_file")))
    )
    rows = (
        message.select(F.lit("message").alias("entity"), F.lit("").alias("scope"), F.col("id").alias("key"), "loaded_at")
        .unionByName(session.select(F.lit("session").alias("entity"), F.lit("").alias("scope"), F.col("id").alias("key"), "loaded_at"))
        .unionByName(calls.where(F.col("kind") == "function_call").select(F.lit("call").alias("entity"), F.coalesce("log_file", F.lit("")).alias("scope"), F.col("call_id").alias("key"), "loaded_at"))
    )
    return refs, rows.where("key is not null and key <> ''")


def counted_references(refs: DataFrame) -> DataFrame:
    """References per key and month of arrival: how many, the first and the last."""
    month = F.date_trunc("month", "loaded_at").alias("period")
    return cut_lineage(refs.groupBy("tbl", "field", *KEY, month).agg(F.count("*").alias("n"), F.min("loaded_at").alias("earliest"), F.max("loaded_at").alias("latest")))


def orphan_keys(counted: DataFrame, targets: DataFrame, tombstone: DataFrame) -> DataFrame:
    """Keys that have an orphan: ``n`` references, ``gone``, ``found`` and ``first_loaded``."""
    first = targets.groupBy(KEY).agg(F.min("loaded_at").alias("first_loaded"), F.lit(True).alias("found"))
    gone = tombstone.where("restored_at is null and record_key is not null").select(F.col("entity"), F.lit("").alias("scope"), F.col("record_key").alias("key")).distinct().withColumn("gone", F.lit(True))
    keys = counted.groupBy(KEY).agg(F.sum("n").alias("n"), F.min("earliest").alias("earliest"))
    status = keys.join(first, KEY, "left").join(gone, KEY, "left")
    return cut_lineage(status.where("gone or found is null or first_loaded > earliest").drop("earliest"))


def _reason(late):
    return F.when(F.col("gone"), "deleted").when(F.col("found").isNull(), "missing").when(late, "late")


def meet_keys(refs: DataFrame, keys: DataFrame, counted: DataFrame, heavy_share: float) -> DataFrame:
    """References joined to ``keys``, the heavy ones by broadcast and the others by shuffle."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit = max(2.0, min(total * heavy_share, HEAVY_ROWS))
    # bounded: at most total / limit keys can hold so many references each
    heavy_keys = counted.groupBy(KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(limit)).select(KEY).collect()
    heavy = refs.sparkSession.createDataFrame(heavy_keys, counted.select(KEY).schema)
    by_broadcast = refs.join(F.broadcast(keys.join(F.broadcast(heavy), KEY, "left_semi")), KEY)
    by_shuffle = refs.join(F.broadcast(heavy), KEY, "left_anti").join(keys, KEY)
    return by_broadcast.unionByName(by_shuffle)


def find_orphans(refs: DataFrame, targets: DataFrame, tombstone: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Orphan references with ``reason``; see the module docstring for the split by weight."""
    counted = counted_references(refs)
    met = meet_keys(refs, orphan_keys(counted, targets, tombstone).drop("n"), counted, heavy_share)
    return met.withColumn("reason", _reason(F.col("first_loaded") > F.col("loaded_at"))).where("reason is not null").drop("gone", "found", "first_loaded")


def count_orphans(refs: DataFrame, targets: DataFrame, tombstone: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Orphans per table, field, reason and month, from the counts; rows are looked at only where a target arrived within the month."""
    counted = counted_references(refs)
    keys = orphan_keys(counted, targets, tombstone).drop("n")
    status = cut_lineage(counted.join(keys, KEY).withColumn("reason", _reason(F.col("first_loaded") > F.col("latest"))))
    open_ = status.where("reason is null and first_loaded > earliest").select(*KEY, "period", "first_loaded").distinct()
    whole = status.where("reason is not null").select("tbl", "field", "reason", "period", "n")
    within = meet_keys(refs.withColumn("period", F.date_trunc("month", "loaded_at")), open_.withColumnRenamed("period", "open_period"), counted, heavy_share)
    late = within.where("period = open_period and first_loaded > loaded_at").groupBy("tbl", "field", F.lit("late").alias("reason"), "period").agg(F.count("*").alias("n"))
    return whole.unionByName(late).groupBy("tbl", "field", "reason", F.date_format("period", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"))


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs, targets = references_and_targets(*(table(spark, sf_dir, t) for t in ("oc_part", "oc_message", "oc_session", "rollout", "field_catalog")))
    return refs, targets, table(spark, sf_dir, "tombstone")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Every orphan reference: ``tbl, row_id, field, reason``; one row if several calls of a payload are gone for one reason."""
    return find_orphans(*_tables(spark, sf_dir)).select("tbl", "row_id", "field", "reason").distinct()


def p1_by_month(spark, sf_dir: str) -> DataFrame:
    """Orphan references counted per table, field, reason and month of arrival."""
    return count_orphans(*_tables(spark, sf_dir))
