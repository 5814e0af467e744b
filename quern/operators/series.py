"""Iteration series: has a series of runs settled, diverged or bloated (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import table

#: Window, tolerances of a settled step, growth that counts as bloat, categories of friction.
WINDOW, PRECISION_STEP, STEPS_SHARE, SECONDS_SHARE, BLOAT, DIVERGED_RUNS = 2, 0.03, 0.10, 0.15, 0.20, 3
CATEGORIES = ("click", "error", "purchase", "signup", "view")
HARNESS_ERRORS = ("timeout", "spawn_failed", "protocol_violation")


def iterations_of(events: DataFrame) -> DataFrame:
    """P10: a user's weeks as iterations; event types with more than two events are friction."""
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    per = events.groupBy("user_id", week.alias("iteration"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    rows = per.groupBy(F.col("user_id").alias("series"), "iteration").agg(
        F.sum("n").alias("steps"), F.round(F.sum("v"), 6).alias("seconds"), F.round(F.sum(F.when(F.col("event_type") != "error", F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("precision"),
        F.array_sort(F.collect_set(F.when(F.col("n") > 4, F.col("event_type")))).alias("friction"),
    )
    return rows


def classify_friction(category, known=CATEGORIES):
    """G7."""
    return F.when(category.isin(*known), category).otherwise("uncategorized")


def settled_steps(rows: DataFrame) -> DataFrame:
    """Per iteration whether its step from the one before is settled, and its growth. A missing or zero value before counts as one."""
    w = Window.partitionBy("series").orderBy("iteration")
    was = lambda c: F.coalesce(F.nullif(F.lag(c).over(w).cast("double"), F.lit(0.0)), F.lit(1.0))
    first = F.lag("steps").over(w).isNull()
    share = lambda c: F.abs(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))) / was(c)
    settled = (F.round(F.abs(F.col("precision") - F.lag("precision").over(w)), 9) <= PRECISION_STEP) & (F.round(share("steps"), 9) <= STEPS_SHARE) & (F.round(share("seconds"), 9) <= SECONDS_SHARE)
    growth = F.round((F.col("steps") - F.coalesce(F.lag("steps").over(w), F.lit(0))) / was("steps"), 6)
    return rows.withColumns({"settled": F.when(first, None).otherwise(settled), "growth": F.when(first, None).otherwise(growth), "has_friction": F.size("friction") > 0})


def verdicts(rows: DataFrame, window: int = WINDOW, runs: int = DIVERGED_RUNS) -> DataFrame:
    """One verdict per series: diverged, bloat, converged or continue.

    Only the last ``window + 1`` (or ``runs``) iterations matter; they are cut by rank before the aggregate.
    """
    last = Window.partitionBy("series").orderBy(F.desc("iteration"))
    recent = settled_steps(rows).withColumn("age", F.row_number().over(last)).where(F.col("age") <= max(window + 1, runs))
    per = recent.groupBy("series").agg(
        F.count("*").alias("held"),
        F.bool_and(F.when(F.col("age") <= window, ~F.col("has_friction"))).alias("calm"),
        F.bool_and(F.when(F.col("age") <= window, F.coalesce("settled", F.lit(False)))).alias("flat"),
        F.collect_list(F.when(F.col("age") <= runs, F.col("friction"))).alias("frictions"),
        F.max(F.when(F.col("age") == 1, F.col("growth"))).alias("growth"),
    )
    common = F.aggregate(F.slice("frictions", F.lit(2), F.size("frictions")), F.get(F.col("frictions"), F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    diverged = (F.size("frictions") >= runs) & (F.size(common) > 0)
    converged = (F.col("held") >= window + 1) & F.col("calm") & F.col("flat")
    bloat = F.coalesce(F.col("growth") > BLOAT, F.lit(False))
    return per.select("series", F.when(diverged, "diverged").when(bloat, "bloat").when(converged, "converged").otherwise("continue").alias("verdict"), F.array_join(F.array_sort(common), ",").alias("common"))


def instruction_fingerprint(docs: DataFrame, by: str) -> DataFrame:
    """Hash over path and content in order of path."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: F.concat(x["path"], F.lit("\0"), x["content"], F.lit("\0")))
    return docs.groupBy(by).agg(F.sha2(F.array_join(parts, ""), 256).alias("fingerprint"))


def grade_precision(grades: DataFrame) -> DataFrame:
    """Mean of pass, partial, fail; success if every critical one passes; the action that follows with or without friction."""
    mark = F.when(F.col("grade") == "pass", 1.0).when(F.col("grade") == "partial", 0.5).otherwise(0.0)
    rows = grades.groupBy("series").agg(F.round(F.avg(mark), 6).alias("precision"), F.coalesce(F.bool_and(F.when(F.col("critical"), F.col("grade") == "pass")), F.lit(True)).alias("success"), F.bool_or(F.col("grade") == "fail").alias("any_fail"), F.bool_or("friction").alias("friction"))
    action = F.when(F.col("any_fail") & F.col("friction"), "fix instruction").when(F.col("any_fail"), "fix checklist").when(F.col("friction"), "reduce friction").otherwise("accept")
    return rows.select("series", "precision", "success", action.alias("action"))


def checker_failures(outputs: DataFrame, dispatched: DataFrame) -> DataFrame:
    """The first protocol failure of each checker output, structural faults before evidence.

    ``outputs``: run, pos, idx, value, evidence, note; ``dispatched``: run, idx. Per grade the order is
    malformed, extra, duplicate, invalid value; then missing grades, then absent evidence.
    """
    w = Window.partitionBy("run", "idx").orderBy("pos")
    rows = outputs.join(dispatched.withColumn("sent", F.lit(True)), ["run", "idx"], "left").withColumn("copy", F.row_number().over(w) > 1)
    fault = F.when(F.col("idx").isNull(), F.lit("malformed_grade")).when(F.col("sent").isNull(), F.lit("extra_grade")).when(F.col("copy"), F.lit("duplicate_grade")).when(~F.coalesce(F.col("value").isin("pass", "partial", "fail"), F.lit(False)), F.lit("invalid_value"))
    per = rows.withColumn("fault", fault).groupBy("run").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("pos", "fault"))).alias("first"), F.count_distinct(F.when(F.col("sent"), F.col("idx"))).alias("got"), F.bool_or(F.trim(F.coalesce("evidence", F.lit(""))) == "").alias("bare"), F.bool_or(F.trim(F.coalesce("note", F.lit(""))) != "").alias("noted"))
    wanted = dispatched.groupBy("run").agg(F.count_distinct("idx").alias("wanted"))
    df = wanted.join(per, "run", "left")
    return df.select("run", F.when(F.col("got").isNull(), "no_output").when(F.col("first").isNotNull(), F.col("first.fault")).when(F.col("got") < F.col("wanted"), "missing_grade").when(F.col("noted"), "isolation_violation").when(F.col("bare"), "no_evidence").otherwise("ok").alias("outcome"))


def _rows(spark, sf_dir):
    return iterations_of(table(spark, sf_dir, "events"))


def g02_settled_steps(spark, sf_dir):
    return settled_steps(_rows(spark, sf_dir)).select("series", "iteration", "steps", "precision", "settled", "growth", "has_friction")


def g12_verdicts(spark, sf_dir):
    return verdicts(_rows(spark, sf_dir))


def g06_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("skill_name is not null and path is not null and text is not null")
    latest = docs.groupBy("skill_name", "path").agg(F.max_by("text", F.struct("updated_at", "doc_id")).alias("content"))
    return instruction_fingerprint(latest, "skill_name")


def g14_grades(spark, sf_dir):
    """Orders as grades: a customer's orders, F passing, P partial; urgent ones are critical."""
    grade = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "P", "partial").otherwise("fail")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), grade.alias("grade"), F.col("o_orderpriority").startswith("1").alias("critical"), (F.col("o_totalprice") > 200000).alias("friction"))
    return grade_precision(rows)


def g09_checker_failures(spark, sf_dir):
    """Line items of an order as grades against the lines that the order numbers up to three."""
    items = table(spark, sf_dir, "lineitem")
    outputs = items.select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") * F.lit(10_000_000) + F.col("l_partkey")).alias("pos"), F.when(F.col("l_quantity") < 49, F.col("l_linenumber")).alias("idx"), F.when(F.col("l_returnflag") == "R", "pass").when(F.col("l_returnflag") == "A", "fail").otherwise("pass").alias("value"), F.when(F.col("l_discount") > 0, "seen").alias("evidence"), F.when(F.col("l_tax") > 0.07, "note").alias("note"))
    dispatched = items.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("idx")).distinct()
    return checker_failures(outputs, dispatched)
