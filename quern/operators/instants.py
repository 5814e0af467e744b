"""One UTC instant for times of many forms (problem 3).

``functions.instants`` reads a text; here times without a zone get their machine's
clock. Where that clock shows a time twice, the reading depends on the line before
it. Such lines are rare (one hour a year), so only their files are looked at: the
line before is found with a window inside blocks of ``BLOCK`` lines plus what the
blocks before it end with, and no task holds a whole file, even one written in that hour only. Once a line of an
unbroken run of such lines takes the later reading, so does the rest of the run: a line is late
if the last line that went back lies after the last one that began a run, two running
maxima that add up over blocks. Texts are read once, into narrow rows that are written before their files are looked at.

Defined results: null, empty, impossible and placeholder times, and local times that
a clock skips, have no instant; a machine without a known zone runs on UTC; if both
readings lie before the line before, the later one holds; of copies of a line the
smallest ``row_id`` counts for what follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.instants import OWN_ISO, read_times, readings_of
from quern.functions.payloads import fields_of, text_of
from quern.session import cut_lineage, evaluated, table

BLOCK = 4096


def with_readings(df: DataFrame, text, zones: DataFrame) -> DataFrame:
    """Add ``sec``, ``nano`` and, where the clock shows the time twice, ``early`` and ``late``."""
    df = read_times(df, text)
    # machine_zone is a fixed table: it does not grow with the data
    df = df.join(F.broadcast(zones.where("machine is not null").groupBy("machine").agg(F.min("zone_name").alias("zone_name"))), "machine", "left")
    early, late = readings_of(F.col("t_local"), F.coalesce("zone_name", F.lit("UTC")))
    df = evaluated(df, {"t_early": F.when(F.col("t_local").isNotNull(), early), "t_late": F.when(F.col("t_local").isNotNull(), late)})
    twice = F.col("t_early") != F.col("t_late")
    return evaluated(
        df,
        {
            "sec": F.coalesce("t_sec", F.when(~twice, F.col("t_early"))),
            "nano": F.col("t_nano"),
            "early": F.when(twice, F.col("t_early")),
            "late": F.when(twice, F.col("t_late")),
        },
    ).drop("t_sec", "t_local", "t_nano", "t_early", "t_late", "zone_name")


def settle_twice(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Give rows with two readings the one that fits the line before: ``sec``; drops ``early``, ``late``."""
    plain = df.where("early is null").drop("early", "late")
    twice = df.where("early is not null")
    files = twice.select("log_file").distinct()
    lines = (
        df.where("(sec is not null or early is not null) and line_no is not null")
        .join(files, "log_file", "left_semi")
        .groupBy("log_file", "line_no")
        .agg(F.min_by(F.struct(F.coalesce("sec", "early").alias("at"), "early", "late"), "row_id").alias("v"))
        .select("log_file", "line_no", "v.*", F.expr(f"line_no div {block}").alias("block"))
    )
    value = F.struct("at", F.col("early").isNotNull().alias("twice"))
    ends = lines.groupBy("log_file", "block").agg(F.max_by(value, "line_no").alias("end"))
    carried = ends.select("log_file", "block", F.lag("end").over(Window.partitionBy("log_file").orderBy("block")).alias("carried"))
    inside = F.lag(value).over(Window.partitionBy("log_file", "block").orderBy("line_no"))
    marked = lines.withColumn("prev", inside).where("early is not null").join(carried, ["log_file", "block"], "left").withColumn("prev", F.coalesce("prev", "carried"))
    # two repeated hours of one clock lie months apart, so a gap of over a day starts a new run
    new_run = F.col("prev").isNull() | ~F.col("prev.twice") | (F.abs(F.col("prev.at") - F.col("early")) > 86400)
    before = F.coalesce(F.col("early") < F.col("prev.at"), F.lit(False))
    marked = marked.select("log_file", "block", "line_no", "early", "late", F.when(new_run, F.col("line_no")).alias("began"), F.when(before, F.col("line_no")).alias("back"))
    blocks = marked.groupBy("log_file", "block").agg(F.max("began").alias("began"), F.max("back").alias("back"))
    earlier = Window.partitionBy("log_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("log_file", "block", F.max("began").over(earlier).alias("began_before"), F.max("back").over(earlier).alias("back_before"))
    so_far = Window.partitionBy("log_file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"began": F.max("began").over(so_far), "back": F.max("back").over(so_far)}).join(blocks, ["log_file", "block"])
    is_late = F.coalesce(F.greatest("back", "back_before") >= F.greatest("began", "began_before"), F.lit(False))
    settled = marked.select("log_file", "line_no", F.when(is_late, F.col("late")).otherwise(F.col("early")).alias("settled"))
    found = twice.join(settled, ["log_file", "line_no"], "left").withColumn("sec", F.coalesce("settled", "early")).drop("settled", "early", "late")
    return plain.unionByName(found)


def log_instants(df: DataFrame, text, zones: DataFrame) -> DataFrame:
    """``df`` (with ``row_id, log_file, line_no, machine``) plus ``sec`` and ``nano`` of ``text``."""
    return settle_twice(with_readings(df, text, zones))


def narrow_instants(df: DataFrame, zones: DataFrame) -> DataFrame:
    """``row_id, sec, nano, own_form`` of readable times: ``log_instants`` over rows that are read once and written narrow."""
    read = with_readings(df, F.col("text"), zones).withColumn("own_form", F.col("text").rlike(OWN_ISO)).where("sec is not null or early is not null")
    return settle_twice(cut_lineage(read.select("row_id", "log_file", "line_no", "sec", "nano", "early", "late", "own_form")))


def meta_times(rollout: DataFrame) -> DataFrame:
    metas = rollout.where("type = 'session_meta'")
    return metas.select("row_id", "log_file", "line_no", "machine", text_of(fields_of(F.col("payload")), "timestamp").alias("text"))


def message_instants(message: DataFrame) -> DataFrame:
    """``oc_message`` with ``sec`` and ``nano`` of ``time_created``, whatever its unit."""
    told = message.withColumn("time_text", F.col("time_created").cast("string"))
    if dict(message.dtypes)["time_created"] not in ("int", "bigint"):
        return read_times(told, F.col("time_text")).withColumnsRenamed({"t_sec": "sec", "t_nano": "nano"}).drop("t_local")
    # a whole number is read as ``read_times`` reads its digits, without matching a text
    digits = F.length("time_text")
    unit = F.when(digits <= 11, F.lit(1)).when(digits <= 14, F.lit(1000)).when(digits <= 17, F.lit(1_000_000)).otherwise(F.lit(1_000_000_000)).cast("bigint")
    read = evaluated(told, {"t_unit": F.when(F.col("time_created") >= 100_000_000, unit)})
    sec, nano = F.expr("time_created div t_unit"), F.expr("(time_created % t_unit) * (1000000000L div t_unit)")
    return read.withColumns({"sec": sec, "nano": F.coalesce(nano, F.lit(0).cast("bigint"))}).drop("t_unit")


def _utc_ms():
    return (F.col("sec") * 1000 + F.expr("nano div 1000000")).cast("bigint")


def p3_all(spark, sf_dir: str) -> DataFrame:
    """Every readable time of the three tables: ``tbl, row_id, utc_ms, own_form``."""
    zones = table(spark, sf_dir, "machine_zone")
    parts = []
    session = table(spark, sf_dir, "session_one").select("row_id", "log_file", "line_no", "machine", F.col("timestamp").alias("text"))
    for name, df in (("session_one", session), ("rollout", meta_times(table(spark, sf_dir, "rollout")))):
        parts.append(narrow_instants(df, zones).select(F.lit(name).alias("tbl"), "row_id", _utc_ms().alias("utc_ms"), "own_form"))
    read = message_instants(table(spark, sf_dir, "oc_message").select("row_id", "time_created"))
    parts.append(read.select(F.lit("oc_message").alias("tbl"), "row_id", _utc_ms().alias("utc_ms"), F.length("time_text").between(12, 14).alias("own_form")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("utc_ms is not null")


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Readable times not in their store's own form: ``tbl, row_id, utc_ms``."""
    return p3_all(spark, sf_dir).where("not own_form").select("tbl", "row_id", "utc_ms")
