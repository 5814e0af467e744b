"""Records of verification and assembled reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import friction as fr
from quern.operators import snapshots as sn
from quern.session import table

#: Verdicts of a judgment, and how many revisions are looked through for a base.
VERDICTS = ("affected", "unaffected", "unclear")
MAX_REVISIONS = 200


def skill_result(records: DataFrame) -> DataFrame:
    """Pass if every scenario ran and passed, accepted-semantic if the rest was judged, else accepted without a run."""
    seen = F.collect_set("result")
    only = lambda *allowed: F.size(F.array_except("seen", F.array(*map(F.lit, allowed)))) == 0
    per = records.groupBy("skill").agg(seen.alias("seen"))
    return per.select("skill", F.when(only("pass"), "pass").when(only("pass", "accepted-semantic"), "accepted-semantic").otherwise("accepted-without-run").alias("result"))


def stamped_records(scenarios: DataFrame, previous: DataFrame, result: Column, today: Column, ran: bool) -> DataFrame:
    """A run stamps today; an acceptance keeps the date of the scenario, of its skill, or today."""
    if ran:
        return scenarios.withColumns({"result": result, "verified": today})
    old = previous.select("skill", "scenario", F.col("verified").alias("old"))
    entry = previous.groupBy("skill").agg(F.max("entry_verified").alias("entry"))
    df = scenarios.join(old, ["skill", "scenario"], "left").join(entry, "skill", "left")
    return df.select(*scenarios.columns, result.alias("result"), F.coalesce("old", "entry", today).alias("verified"))


def carried_note(note: Column, previous: Column, previous_carried: Column) -> Column:
    """The last note, or the one it carried, for one generation; none if it is the new one."""
    last = F.coalesce(F.nullif(previous, F.lit("")), F.nullif(previous_carried, F.lit("")))
    return F.when(~last.eqNullSafe(note), last)


def lock_entries(surface: DataFrame, results: DataFrame, notes: DataFrame) -> DataFrame:
    """One JSON entry per skill with hashes by path; absent notes leave no key."""
    hashes = surface.groupBy("skill").agg(F.array_sort(F.collect_set("path")).alias("surface"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "sha")))).alias("file_sha256"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "structure")))).alias("structural_sha256"))
    df = hashes.join(sn.fingerprint(surface, "skill"), "skill").join(results, "skill", "left").join(notes, "skill", "left")
    return df.select("skill", F.to_json(F.struct("surface", "file_sha256", "structural_sha256", F.col("fingerprint").alias("surface_sha256"), "result", "verified", "note", "carried_note")).alias("entry"))


def judgment_faults(judgments: DataFrame, moved: DataFrame, known: DataFrame, gate: Column | None = None) -> DataFrame:
    """Why a judgment ``skill, text`` may not be used, the first fault in order; null if it may.

    ``moved``: skill, moved_sha; ``known``: skill, scenario. Shape before skill before change before model
    before scenarios before each verdict and its ground; the gate comes last.
    """
    v = F.try_parse_json("text")
    ids = known.groupBy("skill").agg(F.collect_set("scenario").alias("ids"))
    df = judgments.withColumn("v", v).join(moved, "skill", "left").join(ids, "skill", "left")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    missing = F.array_except(F.array(*map(F.lit, ("skill", "diff_sha256", "model", "scenarios"))), F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>")))
    verdicts = get("$.scenarios", "map<string,variant>")
    entries = F.map_entries(verdicts)
    inner = lambda e, p: F.try_variant_get(e["value"], p, "string")
    fault = (
        F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "not an object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(get("$.skill") != F.col("skill"), "another skill")
        .when(~get("$.diff_sha256").eqNullSafe(F.col("moved_sha")), "another change").when(F.coalesce(F.trim(get("$.model")), F.lit("")) == "", "no model").when(verdicts.isNull(), "scenarios is no mapping")
        .when(F.size(F.array_except(F.map_keys(verdicts), F.coalesce("ids", F.array().cast("array<string>")))) > 0, "unknown scenario")
        .when(F.exists(entries, lambda e: ~F.coalesce(inner(e, "$.verdict").isin(*VERDICTS), F.lit(False))), "unknown verdict").when(F.exists(entries, lambda e: F.coalesce(F.trim(inner(e, "$.rationale")), F.lit("")) == ""), "no rationale")
    )
    return df.select("skill", fault.alias("fault") if gate is None else F.coalesce(fault, gate).alias("fault"))


def restored_bases(wanted: DataFrame, revisions: DataFrame, limit: int = MAX_REVISIONS) -> DataFrame:
    """``path, sha`` -> the newest of the last ``limit`` revisions ``path, seq, content`` with that hash."""
    hashed = revisions.where(F.col("seq") < limit).withColumn("sha", F.sha2(F.col("content").cast("binary"), 256))
    return wanted.where(F.col("sha") != sn.MISSING).join(hashed, ["path", "sha"], "left").groupBy("path", "sha").agg(F.min_by("content", "seq").alias("base"))


def judgment_skeleton(impacted: DataFrame, unclear: DataFrame, moved: DataFrame) -> DataFrame:
    """An empty verdict for each impacted scenario, ``unclear`` where a base could not be restored."""
    df = impacted.select("skill", "scenario").join(unclear.select("skill", "scenario").withColumn("u", F.lit(True)), ["skill", "scenario"], "left").join(moved, "skill", "left")
    return df.select("skill", "scenario", F.col("moved_sha").alias("diff_sha256"), F.when(F.col("u"), "unclear").otherwise("").alias("verdict"), F.when(F.col("u"), "base not restored").otherwise("").alias("rationale"))


def judgment_input(diff: DataFrame, bases: DataFrame, current: DataFrame) -> DataFrame:
    """Per moved path its state before and after; a path that left the surface reads empty, a base that is lost is flagged."""
    df = diff.where("kind <> 'same'").join(bases.select("path", F.col("base")), "path", "left").join(current.select("path", F.col("content").alias("now")), "path", "left")
    before = F.when(F.col("sha_before").isNull(), F.lit("")).otherwise(F.col("base"))
    after = F.when(F.col("sha_after").isNull(), F.lit("")).otherwise(F.col("now"))
    return df.select("skill", "path", "kind", before.alias("before"), after.alias("after"), (before.isNull() | after.isNull()).alias("unrestorable"))


def friction_report(friction: DataFrame, sessions: DataFrame, stores: DataFrame) -> DataFrame:
    """The measurement as one JSON object: summary, stores, skills in order of score."""
    # one row per skill and per store: dimensions, not data
    skills = friction.agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("score"), "skill", F.struct("skill", "score", "band", "confidence", "recommendation", "invocations", "retries", "corrections").alias("row")))), lambda x: x["row"]).alias("skills"))
    totals = sessions.agg(F.struct(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.sum("tool_errors").alias("tool_errors"), F.count_if("abandoned").alias("abandoned")).alias("summary"))
    held = stores.agg(F.array_sort(F.collect_list(F.struct("store", "sessions", "turns"))).alias("stores"))
    df = totals.join(F.broadcast(skills)).join(F.broadcast(held))  # single rows
    return df.select(F.to_json(F.struct("summary", (F.col("summary.sessions") > 0).alias("proceed"), "stores", "skills")).alias("report"))


def findings_report(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """counts first, then findings per rule in order of gravity and place."""
    rows = findings.groupBy("rule").agg(F.count("*").alias("n"), F.min("gravity").alias("gravity"), F.min_by("place", F.struct("gravity", "place")).alias("first_place"))
    return rows.join(F.broadcast(suppressed)).select("rule", "n", "gravity", "first_place", "withheld")  # suppressed is a single row


def h16_skill_results(spark, sf_dir):
    """Carry-over outcomes of each scenario folded to a result per skill."""
    carry = sn.h15_carryover(spark, sf_dir)
    result = F.when(F.col("scenario").contains("docs/"), "pass").when(F.col("reason").isNull(), "accepted-semantic").otherwise("accepted-without-run")
    return skill_result(carry.select("skill", result.alias("result")))


def h17_lock_entries(spark, sf_dir):
    after = sn._two(spark, sf_dir)[1]
    results = after.select("skill").distinct().select("skill", F.lit("pass").alias("result"), F.lit("2026-11-01").alias("verified"))
    notes = results.select("skill", F.when(F.col("skill") < "m", F.lit("by hand")).alias("note"), F.lit(None).cast("string").alias("carried_note"))
    return lock_entries(after, results, notes).select("skill", F.sha2("entry", 256).alias("sha"), F.get_json_object("entry", "$.note").alias("note"))


def h34_bases(spark, sf_dir):
    """The texts of the earlier snapshot found again among all texts of their path."""
    from pyspark.sql import Window

    before, _ = sn._two(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").where("path is not null and text is not null")
    w = Window.partitionBy("path").orderBy(F.desc("updated_at"), F.desc("doc_id"))
    revisions = documents.select("path", (F.row_number().over(w) - 1).alias("seq"), F.col("text").alias("content"))
    return restored_bases(before.select("path", "sha"), revisions).select("path", "sha", F.length("base").alias("chars"))


def c17_report(spark, sf_dir):
    events, caps = fr._parts(spark, sf_dir)
    sessions = fr.session_rows(events, caps)
    return friction_report(fr.c09_skill_friction(spark, sf_dir), sessions, fr.store_report(caps, sessions))


QUERIES = {n: globals()[n] for n in ("c17_report", "h16_skill_results", "h17_lock_entries", "h34_bases")}
