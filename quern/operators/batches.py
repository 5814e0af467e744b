"""Cost, outcomes and grading of batches of work (I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.session import table

#: Classes of failure, order of halts, exit codes, types of predicates with their keys.
FAILURE_CLASS = {"missing_prompt": "permanent", "spawn_failed": "permanent", "timeout": "transient", "missing_artifact": "transient", "empty_artifact": "transient", "malformed_artifact": "transient"}
HALT_ORDER = ("kill_file", "interrupted", "wall_clock", "failed_streak", "dry_run")
EXIT_OK, EXIT_FAILURES, EXIT_HALTED = 0, 10, 11
PREDICATE_KEYS = {
    "file_exists": ("path",), "file_regex": ("path", "pattern"), "report_regex": ("pattern",), "git_clean": (), "git_commit_count": (), "git_head_equals_baseline": (),
    "git_subject_regex": ("rev", "pattern"), "git_subjects_regex": ("pattern",), "git_path_committed": ("path",), "git_no_commit_touches_both": ("path_a", "path_b"),
}
STREAK = 3


def record_costs(history: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key; what was observed last stands."""
    both = history.unionByName(seen)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("observed", *[c for c in rest if c != "observed"])).alias("v")).select(*keys, "v.*")


def estimate_costs(units: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Look-up by key; input tokens scaled by bytes, halves to even, one at least; without a record measured is false.

    A record without bytes counts as one of the present size.
    """
    known = history.select(*keys, F.col("input_bytes").alias("was_bytes"), F.col("input_tokens").alias("was_tokens"), "output_tokens", "wall_seconds").withColumn("measured", F.lit(True))
    df = units.join(known, keys, "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    base = F.coalesce(F.nullif("was_bytes", F.lit(0)), F.nullif("input_bytes", F.lit(0)), F.lit(1))
    scaled = F.greatest(F.lit(1), F.bround(F.coalesce("was_tokens", F.lit(0)) * (F.col("input_bytes").cast("double") / base)).cast("bigint"))
    return df.select(*units.columns, tx.approx_tokens(F.col("input_bytes")).cast("bigint").alias("approx_input_tokens"), "measured", F.when(F.col("measured"), scaled).alias("input_tokens"), "output_tokens", "wall_seconds")


def dry_run(estimates: DataFrame) -> DataFrame:
    """Totals of what is measured, the approximation over all, stop if anything is unmeasured."""
    return estimates.agg(F.count("*").alias("units"), F.count_if("measured").alias("measured"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("wall_seconds"), 6).alias("wall_seconds"), F.sum("approx_input_tokens").alias("approx_input_tokens"), F.bool_or(~F.col("measured")).alias("stop"))


def ceiling_reached(tokens, seconds, max_tokens, max_seconds):
    """I4: tokens before seconds."""
    return F.when(tokens >= max_tokens, "tokens").when(seconds >= max_seconds, "seconds")


def text_bytes(*texts):
    """UTF-8 bytes of texts; absent ones count nothing."""
    total = F.lit(0)
    for t in texts:
        total = total + F.coalesce(F.octet_length(t), F.lit(0))
    return total


def artifact_state(content, output_format):
    """Missing, empty, malformed or ok."""
    return F.when(content.isNull(), "missing").when(~content.rlike(r"\S"), "empty").when((output_format == "json") & F.try_parse_json(content).isNull(), "malformed").otherwise("ok")


def error_kind(state, timed_out, spawn_failed, missing_prompt):
    """I8: missing prompt before spawn failure before timeout before the artifact; '' if done."""
    return F.when(missing_prompt, "missing_prompt").when(spawn_failed, "spawn_failed").when(timed_out, "timeout").when(state == "ok", "").otherwise(F.concat(state, F.lit("_artifact")))


def failure_class(kind):
    """I9a."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in FAILURE_CLASS.items() for x in p)), kind), F.lit(""))


def failed_streaks(results: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Failures in a row; done resets, skipped leaves it: islands between done units."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = results.withColumn("island", F.sum((F.col("status") == "done").cast("bigint")).over(w))
    inside = Window.partitionBy(by, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("streak", F.sum((F.col("status") == "failed").cast("bigint")).over(inside)).drop("island")


def summarize_batches(units: DataFrame, results: DataFrame, by: str) -> DataFrame:
    """Counts, pending, halt by order of precedence, exit code; a dry run is no halt."""
    counts = results.groupBy(by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("skipped", "done", "failed")), F.max("streak").alias("streak"))
    df = units.join(counts, by, "left").na.fill(0, ["skipped", "done", "failed", "streak"])
    df = df.withColumn("pending", F.col("total") - F.col("skipped") - F.col("done") - F.col("failed")).withColumn("halt", F.when(F.col("streak") >= STREAK, "failed_streak"))
    return df.withColumn("exit_code", F.when(F.col("halt").isNotNull() & (F.col("halt") != "dry_run"), EXIT_HALTED).when(F.col("failed") > 0, EXIT_FAILURES).otherwise(EXIT_OK))


def strongest_halt(*reasons):
    """The first present in the order of halts, else the first present."""
    held = F.array_compact(F.array(*reasons))
    ranked = F.filter(F.array(*map(F.lit, HALT_ORDER)), lambda h: F.array_contains(held, h))
    return F.coalesce(F.get(ranked, F.lit(0)), F.get(held, F.lit(0)))


def invalid_predicates(predicates: DataFrame) -> DataFrame:
    """``unit, pos, kind, keys``: unknown type, missing key, or a count without a bound."""
    needed = F.element_at(F.create_map(*(x for k, v in PREDICATE_KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")))), F.col("kind"))
    lacking = F.array_except(needed, "keys")
    fault = F.when(needed.isNull(), "unknown type").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(lacking), ", "))).when((F.col("kind") == "git_commit_count") & ~F.arrays_overlap("keys", F.array(F.lit("equals"), F.lit("min"), F.lit("max"))), "needs a bound")
    return predicates.withColumn("fault", fault).where("fault is not null")


def evaluate_predicates(predicates: DataFrame, files: DataFrame, commits: DataFrame) -> DataFrame:
    """``unit, pos, kind, path, pattern, path_b, low, high, expect`` against files and commits of the unit.

    ``files``: unit, path, content; ``commits``: unit, seq (0 newest), subject, paths. A pattern is Java's.
    """
    f = files.select("unit", "path", F.col("content"), F.lit(True).alias("is_file"))
    log = commits.groupBy("unit").agg(F.count("*").alias("n_commits"), F.array_sort(F.collect_list(F.struct("seq", "subject", "paths"))).alias("log"))
    df = predicates.join(f, ["unit", "path"], "left").join(log, "unit", "left")
    log_of = F.coalesce("log", F.array().cast("array<struct<seq:bigint,subject:string,paths:array<string>>>"))
    actual = (
        F.when(F.col("kind") == "file_exists", F.coalesce("is_file", F.lit(False)))
        .when(F.col("kind") == "file_regex", F.coalesce(F.rlike(F.col("content"), F.col("pattern")), F.lit(False)))
        .when(F.col("kind") == "git_commit_count", F.coalesce("n_commits", F.lit(0)).between(F.coalesce("low", F.lit(0)), F.coalesce("high", F.lit(2**31 - 1))))
        .when(F.col("kind") == "git_subjects_regex", F.forall(log_of, lambda c: F.rlike(c["subject"], F.col("pattern"))))
        .when(F.col("kind") == "git_path_committed", F.exists(log_of, lambda c: F.array_contains(c["paths"], F.col("path"))))
        .when(F.col("kind") == "git_no_commit_touches_both", ~F.exists(log_of, lambda c: F.array_contains(c["paths"], F.col("path")) & F.array_contains(c["paths"], F.col("path_b"))))
    )
    missing_file = (F.col("kind") == "file_regex") & F.col("is_file").isNull()
    ok = F.when(missing_file, False).otherwise(actual == F.coalesce("expect", F.lit(True)))
    return df.select("unit", "expectation", "pos", "kind", ok.alias("ok"), F.concat(F.when(ok, "PASS ").otherwise("FAIL "), F.col("kind")).alias("evidence"))


def evaluate_asserts(evaluated: DataFrame) -> DataFrame:
    """All predicates of an expectation must hold."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence"))), lambda x: x["evidence"]), "; ")
    return evaluated.groupBy("unit", "expectation").agg(F.bool_and("ok").alias("ok"), joined.alias("evidence"))


def report_faults(reports: DataFrame) -> DataFrame:
    """``unit, text, expected``: the first fault of a report; null for a sound one."""
    v = F.try_parse_json("text")
    entries = F.try_variant_get(v, "$.expectations", "array<variant>")
    index = F.transform(entries, lambda e: F.try_variant_get(e, "$.index", "int"))
    verdict = F.transform(entries, lambda e: F.try_variant_get(e, "$.verdict", "string"))
    fault = (
        F.when(v.isNull(), "not json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object").when(entries.isNull(), "no expectations").when(F.size(entries) != F.col("expected"), "wrong count")
        .when(F.exists(index, lambda i: i.isNull() | (i < 1) | (i > F.col("expected"))), "index out of range").when(F.size(F.array_distinct(index)) < F.size(index), "index twice")
        .when(F.exists(verdict, lambda x: ~F.coalesce(x.isin("yes", "no", "partial"), F.lit(False))), "unknown verdict")
    )
    return reports.select("unit", fault.alias("fault"))


def grade_scenarios(expectations: DataFrame, said: DataFrame, machine: DataFrame) -> DataFrame:
    """I16: the machine's verdict replaces the report's; anything but yes is a miss; a critical miss fails."""
    df = expectations.join(said, ["unit", "expectation"], "left").join(machine.select("unit", "expectation", "ok"), ["unit", "expectation"], "left")
    verdict = F.coalesce(F.when(F.col("ok"), "yes").when(~F.col("ok"), "no"), F.col("verdict"))
    df = df.withColumn("miss", F.coalesce(verdict != "yes", F.lit(True)))
    return df.groupBy("skill", "unit").agg(F.count_if(F.col("miss") & F.col("critical")).alias("critical_missed"), F.count_if(F.col("miss") & ~F.col("critical")).alias("other_missed")).withColumn("verdict", F.when(F.col("critical_missed") > 0, "fail").otherwise("unadjudicated_pass"))


def roll_up(skills: DataFrame, graded: DataFrame) -> DataFrame:
    """Per skill: needs_rerun before fail before pass; a skill without results needs a rerun."""
    per = graded.groupBy("skill").agg(F.bool_or(F.col("verdict") == "needs_rerun").alias("r"), F.bool_or(F.col("verdict") == "fail").alias("f"), F.count("*").alias("units"))
    df = skills.join(per, "skill", "left")
    return df.select("skill", F.coalesce("units", F.lit(0)).alias("units"), F.when(F.col("units").isNull() | F.col("r"), "needs_rerun").when(F.col("f"), "fail").otherwise("unadjudicated_pass").alias("result"))


def rerun_units(units: DataFrame, satisfied: DataFrame, named: DataFrame, changed: DataFrame) -> DataFrame:
    """I20, I21f: units that are unfinished or named, but none whose declaration changed."""
    unfinished = units.join(satisfied, "unit", "left_anti")
    return unfinished.unionByName(units.join(named, "unit", "left_semi")).distinct().join(changed, "unit", "left_anti")


def unit_id(skill, scenario):
    """``skill-scenario``; null unless both are well formed."""
    return F.when(skill.rlike("^[a-z0-9][a-z0-9-]*$") & scenario.rlike("^[a-z0-9][a-z0-9-]*$"), F.concat_ws("-", skill, scenario))


def unsafe_path(path):
    """I22e: rooted, climbing or inside ``.git`` in any case."""
    return path.rlike(r"^[/\\~]|^[A-Za-z]:") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | path.rlike(r"(?i)(^|[/\\])\.git([/\\]|$)") | (path == "")


# ------------------------------------------------------------------ queries


def _units(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("unit"), F.col("o_orderdate").alias("at"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


def _costs(spark, sf_dir):
    """Line items as observed costs of a brand on a route."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select(F.col("p_brand").alias("scenario"), F.col("l_returnflag").alias("route"), F.col("l_partkey").alias("input_bytes"), (F.col("l_quantity") * 10).cast("bigint").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.col("l_extendedprice").alias("wall_seconds"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("observed"))


def i05_history(spark, sf_dir):
    costs = _costs(spark, sf_dir)
    return record_costs(costs.where("observed < '1996-01-01'"), costs.where("observed >= '1996-01-01'"), ["scenario", "route"])


def _estimates(spark, sf_dir):
    history = record_costs(_costs(spark, sf_dir).where("route <> 'A'"), _costs(spark, sf_dir).limit(0), ["scenario", "route"])
    routes = spark.createDataFrame([("A",), ("N",), ("R",)], "route string")
    units = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("scenario")).agg(F.sum("p_size").cast("bigint").alias("input_bytes")).join(F.broadcast(routes))
    return estimate_costs(units, history, ["scenario", "route"])


def i02_estimates(spark, sf_dir):
    return _estimates(spark, sf_dir)


def i03_dry_run(spark, sf_dir):
    return dry_run(_estimates(spark, sf_dir))


def i07_failed_streak(spark, sf_dir):
    return failed_streaks(_units(spark, sf_dir), "run", ["at", "unit"]).select("run", "unit", "status", "streak")


def i08_outcomes(spark, sf_dir):
    """Payload texts of the rollout logs as artifacts: state, kind of error, class."""
    rows = table(spark, sf_dir, "oc_part").select("row_id", F.col("data").alias("content"), (F.col("row_id") % 97 == 0).alias("timed_out"), F.col("message_id").isNull().alias("missing_prompt"))
    kind = error_kind(artifact_state(F.col("content"), F.lit("json")), F.col("timed_out"), F.lit(False), F.col("missing_prompt"))
    return rows.select("row_id", kind.alias("error_kind"), failure_class(kind).alias("failure_class"))


def i10_summary(spark, sf_dir):
    results = failed_streaks(_units(spark, sf_dir), "run", ["at", "unit"])
    totals = _units(spark, sf_dir).groupBy("run").agg((F.count("*") + F.lit(1)).alias("total"))
    return summarize_batches(totals, results, "run")


def i16_grades(spark, sf_dir):
    """Orders as scenarios: line items are expectations, return flags the report, tax the machine."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = items.groupBy(F.col("o_orderpriority").alias("skill"), F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("expectation")).agg(F.min("l_returnflag").alias("flag"), F.max("l_tax").alias("tax"), F.max("l_quantity").alias("q"))
    said = rows.select("unit", "expectation", F.when(F.col("flag") == "R", "partial").otherwise("yes").alias("verdict"))
    machine = rows.where("tax > 0.05").select("unit", "expectation", (F.col("q") < 45).alias("ok"))
    return grade_scenarios(rows.select("skill", "unit", "expectation", (F.col("expectation") == 1).alias("critical")), said, machine)


def i17_roll_up(spark, sf_dir):
    skills = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("skill")).distinct().unionByName(spark.createDataFrame([("9-NONE",)], "skill string"))
    return roll_up(skills, i16_grades(spark, sf_dir))


def i20_rerun(spark, sf_dir):
    units = _units(spark, sf_dir)
    pick = lambda c: units.where(c).select("unit")
    return rerun_units(units.select("unit", "status"), pick("status = 'done'"), pick("startswith(priority, '1')"), pick("price > 300000"))
