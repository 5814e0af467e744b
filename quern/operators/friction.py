"""Session analytics and friction of skills over normalised events.

Input (``events_norm``): one row per event, ``store, sid, seq, kind, role, text, at,
skill, route, tool`` with ``kind`` one of turn, text, fire, error, abandoned. What looks
like a state machine per session is expressed with windows that share one partition and
order, so a session costs one sort: after every detection, folded or not, the state equals
that detection's own values, and the detection before is all a later one needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import cut_lineage, table

#: How many turns apart two detections still count as one or as a retry.
NEAR_TURNS = 3
#: Stores and what they can report (text, structural, abandonment, partial errors).
STORE_CAPS = (("claude", True, True, False, False), ("opencode", True, True, False, False), ("codex", True, False, True, True))
#: Share of errors above which a session counts as broken off.
ABANDON_SHARE = 0.3


def store_caps(spark: SparkSession) -> DataFrame:
    """Three rows, one per store."""
    return spark.createDataFrame(list(STORE_CAPS), "store string, text boolean, structural boolean, abandonment_signal boolean, error_detection_partial boolean")


def declared_capabilities(caps: list[tuple]) -> dict[str, tuple]:
    """Store -> capabilities; a repeated store is an error."""
    found = {}
    for name, *rest in caps:
        if name in found:
            raise ValueError(f"store declared twice: {name}")
        found[name] = tuple(rest)
    return found


def split_sessions(events: DataFrame) -> DataFrame:
    """Number the sessions of a stream by the identities seen so far; 0 before the first.

    A stream is one of three stores, so it is cut into ranges of its order: each counts alone and begins with what the
    ranges before it hold.
    """
    ranged = cut_lineage(events.repartitionByRange("store", "seq").withColumn("stretch", F.spark_partition_id()))
    opens = F.sum((F.col("kind") == "identity").cast("bigint"))
    before = Window.partitionBy("store").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("store", "stretch").agg(opens.alias("n")).select("store", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy("store", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("session_seq", opens.over(here)).join(F.broadcast(held), ["store", "stretch"]).withColumn("session_seq", F.col("session_seq") + F.col("before")).drop("stretch", "before")  # a row per store and range


def events_from_clicks(events: DataFrame) -> DataFrame:
    """The ``events`` table as normalised events; weekly sessions of a user."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    empty = F.lit(None).cast("string")

    def ev(name, role=empty, route=empty, skill=empty):
        return F.struct(F.lit(name).alias("kind"), role.alias("role"), route.alias("route"), skill.alias("skill"))

    skill = F.concat(F.lit("skill_"), (k % 5).cast("string"))
    store = F.element_at(F.array(F.lit("claude"), F.lit("opencode"), F.lit("codex")), (F.col("user_id") % 3 + 1).cast("int"))
    made = (
        F.when(kind == "signup", F.array(ev("fire", route=F.lit("text"), skill=skill)))
        .when(kind == "purchase", F.array(ev("fire", route=F.lit("structural"), skill=skill)))
        .when(kind == "click", F.array(ev("turn", role=F.lit("user")), ev("text")))
        .when(kind == "view", F.array(ev("turn", role=F.lit("assistant"))))
        .when((kind == "error") & (F.col("user_id") % 3 == 2) & (k % 10 == 0), F.array(ev("error"), ev("abandoned")))
        .when(kind == "error", F.array(ev("error")))
    )
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    base = events.select(store.alias("store"), F.concat_ws("/", F.col("user_id").cast("string"), week).alias("sid"), F.col("ts").alias("at"), F.col("event_id"), F.posexplode(made).alias("sub", "e"))
    return base.select("store", "sid", F.struct("at", "event_id", "sub").alias("seq"), "at", "event_id", "sub", "e.kind", "e.role", "e.route", "e.skill")


def mark_firings(events: DataFrame) -> DataFrame:
    """Turn number, and per firing whether it is folded or near the detection before."""
    upto = Window.partitionBy("store", "sid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("store", "sid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fire = F.col("kind") == "fire"
    df = events.withColumn("turn_no", F.coalesce(F.sum((F.col("kind") == "turn").cast("bigint")).over(upto), F.lit(0)))
    df = df.withColumn("was", F.last(F.when(fire, F.struct("skill", "route", "turn_no")), True).over(before))
    close = fire & (F.col("was.skill") == F.col("skill")) & (F.col("turn_no") - F.col("was.turn_no") <= NEAR_TURNS)
    folded = close & (F.col("was.route") == "text") & (F.col("route") == "structural")
    df = df.withColumns({"near": F.coalesce(close, F.lit(False)), "folded": F.coalesce(folded, F.lit(False))})
    return df.withColumn("grp", F.coalesce(F.sum((fire & ~F.col("folded")).cast("bigint")).over(upto), F.lit(0))).drop("was")


def firing_groups(marked: DataFrame) -> DataFrame:
    """Per unfolded firing its utterances until the next one, and the corrections they make."""
    opens = (F.col("kind") == "fire") & ~F.col("folded")
    groups = (
        marked.where("grp >= 1")
        .groupBy("store", "sid", "grp")
        .agg(
            F.max(F.when(opens, F.col("skill"))).alias("skill"), F.max(F.when(opens, F.col("route"))).alias("route"), F.bool_or(opens & F.col("near")).alias("retry"),
            F.count_if(F.col("kind") == "text").alias("said"), F.count_if(F.col("folded")).alias("folded"), F.collect_set(F.when(F.col("folded"), F.col("route"))).alias("folded_routes"),
        )
    )
    w = Window.partitionBy("store", "sid").orderBy("grp")
    ahead = F.lead(F.struct("retry", "route")).over(w)
    groups = groups.withColumn("ahead", ahead)
    left = F.greatest(F.col("said") - (F.col("ahead.route") == "text").cast("bigint"), F.lit(0))
    return groups.withColumn("corrections", F.when(F.col("ahead").isNull(), F.col("said")).when(F.col("ahead.retry"), 0).otherwise(left).cast("bigint")).drop("ahead")


def session_skills(groups: DataFrame) -> DataFrame:
    """C4: per session and skill: invocations, retries (repeats + 1), corrections, folded, routes."""
    repeats = F.count_if("retry")
    return groups.groupBy("store", "sid", "skill").agg(
        F.count("*").alias("invocations"), F.when(repeats > 0, repeats + 1).otherwise(0).cast("bigint").alias("retries"), F.sum("corrections").alias("corrections"), F.sum("folded").alias("folded"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.collect_set("route"), F.flatten(F.collect_list("folded_routes"))))), ",").alias("routes"),
    )


def session_rows(events: DataFrame, caps: DataFrame) -> DataFrame:
    """Per session turns, tool errors, and whether it was broken off."""
    rows = events.groupBy("store", "sid").agg(F.count_if(F.col("kind") == "turn").alias("turns"), F.count_if(F.col("kind") == "error").alias("tool_errors"), F.bool_or(F.col("kind") == "abandoned").alias("recorded"))
    inferred = (F.col("turns") > 0) & (F.col("tool_errors") > F.lit(ABANDON_SHARE) * F.col("turns"))
    rows = rows.join(F.broadcast(caps.select("store", "abandonment_signal")), "store", "left")
    return rows.select("store", "sid", "turns", "tool_errors", F.when(F.coalesce("abandonment_signal", F.lit(False)), F.col("recorded")).otherwise(inferred).alias("abandoned"))


def skill_friction(skills: DataFrame, sessions: DataFrame, caps: DataFrame) -> DataFrame:
    """Per skill, session-wide counts attributed whole to each of its skills."""
    df = skills.join(sessions, ["store", "sid"]).join(F.broadcast(caps), "store", "left")
    return df.groupBy("skill").agg(
        F.count_distinct("store", "sid").alias("sessions"), F.sum("invocations").alias("invocations"), F.sum("retries").alias("retries"), F.sum("corrections").alias("corrections"), F.sum("folded").alias("folded"),
        F.sum("turns").alias("turns"), F.sum("tool_errors").alias("tool_errors"), F.count_if("abandoned").alias("abandoned"),
        F.array_join(F.array_sort(F.collect_set("store")), ",").alias("stores"),
        F.bool_or(~F.coalesce("structural", F.lit(True))).alias("downgraded"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce("abandonment_signal", F.lit(True)), F.col("store")))), ",").alias("inferred_stores"),
    ).where("invocations > 0")


def with_scores(friction: DataFrame) -> DataFrame:
    """Score, band, confidence and size of the recommendation.

    Bands are half open. Scores up to 2 ask for nothing, below 6 for a small and from 6 for a large change.
    """
    inv = F.col("invocations").cast("double")
    score = F.least(
        F.lit(10.0),
        3 * F.col("retries") / inv + 2 * F.least(F.lit(1.0), F.col("corrections") / (5 * inv)) + 3 * F.col("abandoned") / inv + 2 * F.least(F.lit(1.0), F.col("tool_errors").cast("double") / F.greatest(F.col("turns"), F.lit(1))),
    )
    band = F.when(F.col("score") < 1, "Excellent").when(F.col("score") < 2, "Good").when(F.col("score") < 3, "Acceptable").when(F.col("score") < 5, "Needs Attention").when(F.col("score") < 7, "Problematic").otherwise("Critical")
    grade = F.when(F.col("invocations") <= 2, 0).when(F.col("invocations") <= 9, 1).otherwise(2) - F.col("downgraded").cast("int")
    confidence = F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), F.greatest(grade, F.lit(0)) + 1)
    size = F.when(F.col("score") <= 2, "none").when(F.col("score") < 6, "Small").otherwise("Large")
    return friction.withColumn("score", F.round(score, 6)).withColumns({"band": band, "confidence": confidence, "recommendation": size})


def aggregate_totals(sessions: DataFrame, skills: DataFrame) -> DataFrame:
    """Totals: sessions are distinct, turns and errors summed over session rows."""
    a = sessions.agg(F.count_distinct("store", "sid").alias("sessions"), F.sum("turns").alias("turns"), F.sum("tool_errors").alias("tool_errors"), F.count_if("abandoned").alias("abandoned"))
    b = skills.agg(F.coalesce(F.sum("invocations"), F.lit(0)).alias("invocations"), F.count_distinct("skill").alias("skills"))
    return a.join(F.broadcast(b))  # two single rows


def store_report(caps: DataFrame, sessions: DataFrame) -> DataFrame:
    """What each store covers, with zero rows for a store without sessions."""
    counted = sessions.groupBy("store").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"))
    return caps.join(counted, "store", "left").na.fill(0, ["sessions", "turns"])


def absence_notes(report: DataFrame) -> DataFrame:
    """A note per store that gave nothing."""
    return report.where("sessions = 0").select("store", F.format_string("store %s: no sessions were read", "store").alias("note"))


def harvest(events: DataFrame) -> DataFrame:
    """Utterances with the skill fired last before them in the session, and what they signal."""
    before = Window.partitionBy("store", "sid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.withColumn("fired_skill", F.last(F.when(F.col("kind") == "fire", F.col("skill")), True).over(before)).where("kind = 'text'")
    return carried.withColumn("signals", F.when(F.col("fired_skill").isNotNull(), "correction_after_skill").otherwise(""))


def session_shapes(skills: DataFrame, sessions: DataFrame, many_errors: int = 3) -> DataFrame:
    """Sessions with several skills, and sessions with many tool errors."""
    n = skills.groupBy("store", "sid").agg(F.count("*").alias("n"))
    return sessions.join(n, ["store", "sid"], "left").agg(F.count("*").alias("sessions"), F.count_if(F.col("n") > 1).alias("several_skills"), F.count_if(F.col("tool_errors") >= many_errors).alias("many_errors"))


def _parts(spark, sf_dir):
    events = events_from_clicks(table(spark, sf_dir, "events"))
    caps = store_caps(spark)
    return events, caps


def c01_split(spark, sf_dir):
    """Clicks of a store as a stream in order of time, a signup opening a session."""
    events, _ = _parts(spark, sf_dir)
    stream = events.select("store", "seq", "event_id", "sub", F.when((F.col("kind") == "fire") & (F.col("route") == "text"), "identity").otherwise(F.col("kind")).alias("kind"))
    return split_sessions(stream).select("store", "event_id", "sub", "session_seq")


def c03_firings(spark, sf_dir):
    events, _ = _parts(spark, sf_dir)
    return mark_firings(events).where("kind = 'fire'").select("store", "sid", "event_id", "skill", "route", "turn_no", "near", "folded", "grp")


def c02_sessions(spark, sf_dir):
    events, caps = _parts(spark, sf_dir)
    return session_rows(events, caps)


def c04_session_skills(spark, sf_dir):
    events, _ = _parts(spark, sf_dir)
    return session_skills(firing_groups(mark_firings(events)))


def c07_corrections(spark, sf_dir):
    events, _ = _parts(spark, sf_dir)
    return firing_groups(mark_firings(events)).select("store", "sid", "grp", "skill", "route", "retry", "said", "corrections", "folded")


def c09_skill_friction(spark, sf_dir):
    events, caps = _parts(spark, sf_dir)
    return with_scores(skill_friction(session_skills(firing_groups(mark_firings(events))), session_rows(events, caps), caps))


def c10_totals(spark, sf_dir):
    events, caps = _parts(spark, sf_dir)
    return aggregate_totals(session_rows(events, caps), session_skills(firing_groups(mark_firings(events))))


def c18_store_report(spark, sf_dir):
    events, caps = _parts(spark, sf_dir)
    return store_report(caps, session_rows(events, caps))


def c26_harvest(spark, sf_dir):
    events, _ = _parts(spark, sf_dir)
    return harvest(events).select("store", "sid", "event_id", "fired_skill", "signals")


def c27_session_shapes(spark, sf_dir):
    events, caps = _parts(spark, sf_dir)
    return session_shapes(session_skills(firing_groups(mark_firings(events))), session_rows(events, caps))
