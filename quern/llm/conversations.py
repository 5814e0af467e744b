"""Rebuilding conversations from message rows (problem 6).

Reply links: candidate parents of a turn are all turns before it in its session, across its files,
hours and blocks, scored by time gap, distance, mentions and overlap of words; a
change of speaker speaks for a reply. The likeliest candidate is the parent. Links form trees; a
conversation is the tree of a root, that is, of a turn without a turn before it, and named by the
root's session. A turn belongs to it if it is the root or has a parent. Which trees are sound is then checked
exactly: known speakers, a user at the root, and each turn of the user directly followed by the assistant's.

Distribution: a session may hold a third of all rows, so nothing is partitioned by session
alone. Turns are sorted within blocks of a channel: ``BLOCK`` lines, or an hour of messages, and
a second of an hour with more than ``BLOCK``, or eight leading characters of the id where such messages have no time. A block is summed
up in one row (turns, speakers at its ends, soundness). Blocks are put in order within a day of a
session, days within a session, and each level hands its sums to the next. Candidates are scored in pieces
of the numbered session, and beyond the nearest only as far back as a likelier one can be; each is scored once.

Defined results: lines without a session take that of their file and are left out if it has
none; unreadable content is no turn; the words and mentions of a message are those of all its text parts; of copies the smallest ``row_id`` counts; messages
without a readable time come last; a tie in time is broken by id; files without a
readable time come last, by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.instants import message_instants, with_readings
from quern.session import cut_lineage, evaluated, table

BLOCK, DAY = 4096, 86400
#: Sizes that no result depends on: turns scored first, turns of a piece of a session, turns held at once for those that reach further.
CANDIDATES, PIECE, SPAN = 16, 4096, 64
#: Spellings of the speakers, without case and space around them.
USER, ASSISTANT, SYSTEM = ("user", "human"), ("assistant", "ai", "model"), ("system",)
#: Fitted (softmax over the three turns before) on constructed sessions of one to three interleaved exchanges; the distance by right parents among all turns before, the others as they were.
WEIGHTS = {"time": 1.0, "nearness": 2.0, "mention": 1.5, "words": 3.2, "speaker": 2.8, "distance": 0.75}
HALF_LIFE = 300.0
#: More than rounding moves a score.
MARGIN = 1e-6
NOT_BLANK = r"(?U)\S"
LAST = 2**63 - 1


def speaker_of(role: Column) -> Column:
    """user, assistant, system, or '?' for anything else."""
    plain = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    return F.when(plain.isin(*USER), "user").when(plain.isin(*ASSISTANT), "assistant").when(plain.isin(*SYSTEM), "system").otherwise("?")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}@]+"), lambda w: F.length(w) > 2), lambda w: F.hash(w)))


def heard() -> list[Column]:
    """``words`` and ``mentions`` of ``said``."""
    return [words_of(F.col("said")).alias("words"), F.regexp_extract_all("said", F.lit(r"@[\w-]+"), F.lit(0)).alias("mentions")]


def _text_block(block: Column) -> Column:
    text = F.try_variant_get(block, "$.text", "variant")
    return F.when((F.try_variant_get(block, "$.type", "string") == "text") & (F.schema_of_variant(text) == "STRING"), F.try_variant_get(text, "$", "string"))


def with_said(rows: DataFrame) -> DataFrame:
    """Rows of ``content`` that say something, with ``said``: a string, or text blocks joined. JSON is parsed once."""
    # the first character tells a string or an array; the schema of all that is in it costs as much as parsing
    rows = rows.withColumn("opens", F.ltrim("content", F.lit(" \t\r\n")).substr(1, 1))
    likely = rows.where((F.col("opens") == '"') | ((F.col("opens") == "[") & F.contains("content", F.lit('"text"'))))
    rows = evaluated(likely, {"v": F.try_parse_json("content")}).drop("content").where("v is not null")
    blocks = F.transform(F.try_variant_get("v", "$", "array<variant>"), _text_block)
    said = F.when(F.col("opens") == '"', F.try_variant_get("v", "$", "string")).otherwise(F.nullif(F.array_join(blocks, "\n"), F.lit("")))
    return evaluated(rows, {"said": said}).drop("v", "opens").where(F.col("said").rlike(NOT_BLANK))


def inner_document(v: Column) -> Column:
    """A JSON document, also if it is encoded twice."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)


def session_turns(session: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of ``session_one``, and the order of its files."""
    lines = session.select("row_id", "log_file", "line_no", "machine", "sessionid", "type", F.col("message.role").alias("role"), F.col("message.content").alias("content"), F.col("timestamp").alias("text"))
    # the first readable line of a file has none before it, so of two readings the earlier holds;
    # the gap between turns does not need the other one either
    read = lambda rows: with_readings(rows, F.col("text"), zones).withColumn("sec", F.coalesce("sec", "early")).drop("early", "late")
    at = F.struct("line_no", "row_id")
    # most files begin with a readable line; only the others are read line by line for it
    heads = lines.groupBy("log_file").agg(F.min_by(F.struct("text", "machine"), F.when(F.col("text").isNotNull(), at)).alias("head"), F.min("sessionid").alias("owner")).select("log_file", "owner", "head.text", "head.machine")
    heads = cut_lineage(read(heads).select("log_file", "owner", "sec", "nano"))
    late = read(lines.where("text is not null").select("log_file", "line_no", "row_id", "text", "machine").join(heads.where("sec is null").select("log_file"), "log_file", "left_semi"))
    late = late.where("sec is not null").groupBy("log_file").agg(F.min_by(F.struct("sec", "nano"), at).alias("first"))
    files = heads.where("sec is not null").select("log_file", F.struct("sec", "nano").alias("first")).unionByName(late)

    # times are read last, of turns only, as they cost more than all else that is read of a line
    turns = with_said(lines.where("content is not null"))
    turns = turns.withColumn("speaker", speaker_of(F.coalesce("role", "type"))).where("speaker <> 'system'")
    turns = turns.select(F.lit("session_one").alias("tbl"), F.col("sessionid").alias("conv_id"), "log_file", "line_no", "row_id", "speaker", "machine", "text", *heard())
    owner = heads.where("owner is not null").select("log_file", "owner")
    orphans = turns.where("conv_id is null").join(owner, "log_file").withColumn("conv_id", F.col("owner")).drop("owner")
    turns = read(turns.where("conv_id is not null").unionByName(orphans))
    return (
        turns.select(
            "tbl", "conv_id", F.coalesce("log_file", F.lit("")).alias("channel"), F.coalesce(F.expr(f"line_no div {BLOCK}"), F.lit(LAST)).alias("block"), F.lit("").alias("part"), F.coalesce(F.col("line_no").cast("bigint"), F.lit(LAST)).alias("pos"),
            F.coalesce(F.col("line_no").cast("string"), F.concat(F.lit("row "), F.col("row_id").cast("string"))).alias("line"), "row_id", "speaker", "sec", "words", "mentions",
        ),
        files.select(F.lit("session_one").alias("tbl"), F.col("log_file").alias("channel"), F.struct("first.sec", "first.nano").alias("first")),
    )


def message_turns(message: DataFrame, part: DataFrame) -> DataFrame:
    """Turns of ``oc_message``: messages named by a text part that says something."""
    parts = evaluated(part.where("message_id is not null and contains(data, 'text')").select("message_id", "data"), {"v": F.try_parse_json("data")}).drop("data")
    parts = evaluated(parts, {"d": inner_document(F.col("v"))})
    parts = evaluated(parts, {"said": _text_block(F.col("d"))}).select("message_id", "said").where(F.col("said").rlike(NOT_BLANK))
    parts = parts.select("message_id", *heard(), F.spark_partition_id().alias("task"))
    # joined within a task first, where a message with any number of parts is no larger than the task
    join = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    parts = parts.groupBy("message_id", "task").agg(join("words"), join("mentions")).groupBy("message_id").agg(join("words"), join("mentions"))
    timed = message_instants(message.select("row_id", "id", "session_id", "time_created", "data")).where("session_id is not null and id is not null")
    timed = evaluated(timed, {"v": F.try_parse_json("data")})
    timed = evaluated(timed, {"speaker": speaker_of(F.try_variant_get(inner_document(F.col("v")), "$.role", "string"))}).where("speaker <> 'system'")
    turns = timed.select("row_id", "id", "session_id", "sec", "nano", "speaker").withColumn("block", F.coalesce(F.expr("sec div 3600"), F.lit(LAST)))
    busy = turns.groupBy("session_id", "block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("session_id", "block", F.lit(True).alias("busy"))
    within = F.when(F.col("sec").isNull(), F.col("id").substr(1, 8)).otherwise(F.lpad((F.col("sec") % 3600).cast("string"), 4, "0"))
    turns = turns.join(busy, ["session_id", "block"], "left").withColumn("part", F.when(F.col("busy"), within).otherwise("")).join(parts, F.col("id") == F.col("message_id"))
    return turns.select(
        F.lit("oc_message").alias("tbl"), F.col("session_id").alias("conv_id"), F.lit("").alias("channel"), "block", "part", F.coalesce(F.col("sec") * 1_000_000_000 + F.col("nano"), F.lit(LAST)).alias("pos"),
        F.col("id").alias("line"), "row_id", "speaker", "sec", "words", "mentions",
    )


KEYS = ["tbl", "conv_id", "channel", "block", "part"]
TURN = ["turn_no", "row_id", "speaker", "sec", "words", "mentions"]


def most(back: Column) -> Column:
    """What a turn ``back`` turns before can score at most, by the own words and mentions."""
    own = F.when(F.size("words") > 0, WEIGHTS["words"]).otherwise(0.0) + F.when(F.size("mentions") > 0, WEIGHTS["mention"]).otherwise(0.0)
    return WEIGHTS["time"] + WEIGHTS["speaker"] + WEIGHTS["nearness"] / back - WEIGHTS["distance"] * F.ln(back) + own


def likeliest(candidates: Column) -> Column:
    """``score, turn_no, parent`` of the likeliest of ``candidates``, of equal ones the nearest; null if there are none.

    Words are compared only where a candidate can be likelier than those looked at so far, so the nearest should come first.
    """
    back = lambda c: (F.col("turn_no") - c["turn_no"]).cast("double")

    def score(c: Column) -> Column:
        gap = F.coalesce(F.abs(F.col("sec") - c["sec"]).cast("double"), F.lit(HALF_LIFE))
        shared = F.size(F.array_intersect("words", c["words"])).cast("double")
        # bound by a name, as it would be counted wherever it stands
        overlap = F.get(F.transform(F.array(shared), lambda n: n / F.greatest(F.lit(1.0), F.size("words") + F.size(c["words"]) - n)), F.lit(0))
        return (
            WEIGHTS["time"] * F.pow(F.lit(0.5), gap / HALF_LIFE)
            + WEIGHTS["nearness"] / back(c)
            - WEIGHTS["distance"] * F.ln(back(c))
            + WEIGHTS["words"] * overlap
            + WEIGHTS["mention"] * F.arrays_overlap("mentions", c["mentions"]).cast("double")
            + WEIGHTS["speaker"] * (F.col("speaker") != c["speaker"]).cast("double")
        )

    def likelier(best: Column, c: Column) -> Column:
        scored = F.struct(F.round(score(c), 9).alias("score"), c["turn_no"].alias("turn_no"), c["row_id"].alias("parent"))
        return F.when(best["score"] > most(back(c)) + MARGIN, best).otherwise(F.greatest(best, scored))

    return F.aggregate(candidates, F.lit(None).cast("struct<score:double,turn_no:bigint,parent:bigint>"), likelier)


def placed(turns: DataFrame) -> DataFrame:
    """Turns without copies, each with its place in its block and the speaker after it."""
    w = Window.partitionBy(*KEYS).orderBy("pos", "line", "row_id")
    single = turns.withColumn("copy", F.coalesce(F.lag("line").over(w) == F.col("line"), F.lit(False))).where("not copy").drop("copy")
    return single.withColumns({"place": F.row_number().over(w), "next_speaker": F.lead("speaker").over(w)})


def blocks_of(places: DataFrame, files: DataFrame) -> DataFrame:
    """One row per block: first turn number less one, soundness of its conversation."""
    sound = (F.col("speaker") != "?") & ((F.col("speaker") != "user") | F.coalesce(F.col("next_speaker") == "assistant", F.lit(True)))
    by_place = lambda f, c: f(c, "place")
    blocks = places.groupBy(KEYS).agg(
        F.count("*").alias("n"), F.bool_and(sound).alias("sound"), by_place(F.min_by, "speaker").alias("first_speaker"), by_place(F.max_by, "speaker").alias("last_speaker"),
    ).join(files, ["tbl", "channel"], "left")
    day = F.when(F.col("tbl") == "session_one", F.expr(f"first.sec div {DAY}")).when(F.col("block") != LAST, F.expr(f"block * 3600 div {DAY}"))
    # met twice below, by themselves and by day
    blocks = cut_lineage(blocks.withColumns({"day": F.coalesce(day, F.lit(LAST)), "untimed": F.col("first").isNull()}))
    order = ["untimed", "first", "channel", "block", "part"]

    of_day = Window.partitionBy("tbl", "conv_id", "day").orderBy(*order)
    blocks = blocks.withColumns({"offset": F.coalesce(F.sum("n").over(of_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "following": F.lead("first_speaker").over(of_day)})
    # the last block of a day is followed by that of a later day, if any
    answered = F.col("following").isNull() | (F.col("last_speaker") != "user") | (F.col("following") == "assistant")
    at = F.struct(*order)
    days = blocks.groupBy("tbl", "conv_id", "day").agg(F.sum("n").alias("n"), F.bool_and(F.col("sound") & answered).alias("good"), F.min_by("first_speaker", at).alias("first_speaker"), F.max_by("last_speaker", at).alias("last_speaker"))
    of_session = Window.partitionBy("tbl", "conv_id")
    in_session = of_session.orderBy("day")
    days = days.withColumns({"day_offset": F.coalesce(F.sum("n").over(in_session.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "following": F.lead("first_speaker").over(in_session)})
    ended = (F.col("last_speaker") != "user") | F.coalesce(F.col("following") == "assistant", F.lit(False))
    begun = (F.col("day_offset") > 0) | (F.col("first_speaker") == "user")
    days = days.select("tbl", "conv_id", "day", "day_offset", F.min(F.col("good") & ended & begun).over(of_session).alias("kept"))
    return blocks.select(*KEYS, "day", "offset").join(days, ["tbl", "conv_id", "day"]).select(*KEYS, (F.col("offset") + F.col("day_offset")).alias("offset"), "kept")


def reply_links(turns: DataFrame) -> DataFrame:
    """Numbered turns with ``best``, the likeliest of all turns before in the session; null for the first.

    The ``CANDIDATES`` turns before are scored first, in pieces of a session that bring the end of the piece before. No score can
    exceed what the turn's own words and mentions allow less the weight of the distance, so beyond ``reach`` turns back none
    is likelier than the best of these. Most reach no further; the others are scored against every turn within it, ``SPAN`` at a time.
    """
    near, size, session = CANDIDATES, max(PIECE, CANDIDATES), ["tbl", "conv_id"]
    piece = F.expr(f"(turn_no - 1) div {size}")
    pieces = turns.withColumn("piece", F.explode(F.when((F.col("turn_no") - 1) % size >= size - near, F.array(piece, piece + 1)).otherwise(F.array(piece))))
    of_piece = Window.partitionBy(*session, "piece")
    scored = pieces.withColumn("near", F.collect_list(F.struct(*TURN)).over(of_piece.orderBy("turn_no").rowsBetween(-near, -1))).where(F.col("piece") == piece)
    scored = evaluated(scored, {"best": likeliest(F.reverse("near"))}).drop("near")
    beyond = most(F.lit(near + 1.0)) + WEIGHTS["distance"] * F.ln(F.lit(near + 1.0))
    reach = F.least(F.floor(F.exp((beyond - F.col("best.score") + MARGIN) / WEIGHTS["distance"])), F.col("turn_no") - 1)
    scored = scored.withColumn("reach", F.coalesce(reach, F.lit(0)))

    # turns that reach further meet the turns of the spans they reach; a piece that has another after it is held whole
    far = F.col("reach") > near
    low, high = F.when(far, F.col("turn_no") - F.col("reach")), F.when(far, F.col("turn_no") - near - 1)
    scored = scored.withColumns({"low": low, "high": high}).withColumns({"lowest": F.min("low").over(of_piece), "highest": F.max("high").over(of_piece), "end": F.max("turn_no").over(of_piece)})
    held = F.coalesce(F.col("turn_no").between(F.col("lowest"), F.col("highest")), F.lit(False)) | (F.col("end") == (F.col("piece") + 1) * size)
    span = lambda c: F.expr(f"{c} div {SPAN}")
    spans = F.when(far, F.sequence(span("low"), span("high")))
    meets = F.concat(F.when(held, F.array(F.struct(span("turn_no").alias("span"), F.lit(False).alias("asks")))).otherwise(F.array()), F.coalesce(F.transform(spans, lambda x: F.struct(x.alias("span"), F.lit(True).alias("asks"))), F.array()))
    # scored once: all are written, but what they say only of those that are met
    kinds, says = [*session, "turn_no", "row_id", "speaker", "kept", "best"], ["sec", "words", "mentions", "low", "high"]
    scored = cut_lineage(scored.select(*kinds, far.alias("far"), F.when(held | far, F.struct(*says, meets.alias("meets"))).alias("says")))
    sought = scored.where("says is not null").select(*kinds, *(f"says.{c}" for c in says), F.inline("says.meets"))
    sought = sought.groupBy(*session, "span").agg(
        F.collect_list(F.when(F.col("asks"), F.struct(*TURN, "kept", "best", "low", "high"))).alias("asking"), F.collect_list(F.when(~F.col("asks"), F.struct(*TURN))).alias("held")
    )
    sought = sought.select(*session, "held", F.inline("asking")).withColumn("found", likeliest(F.filter("held", lambda c: c["turn_no"].between(F.col("low"), F.col("high")))))
    sought = sought.groupBy(*session, "turn_no").agg(*(F.first(c).alias(c) for c in ("row_id", "speaker", "kept")), F.array_max(F.array(F.first("best"), F.max("found"))).alias("best"))
    return scored.where("not far").select(kinds).unionByName(sought.select(kinds))


def conversations(turns: DataFrame, files: DataFrame, sound: bool = False) -> DataFrame:
    """Every turn, or those of the sound conversations, with ``turn_no``, ``parent`` (null at the root of its tree), ``score`` and ``kept``."""
    turns = cut_lineage(turns)
    blocks = blocks_of(placed(turns), files)
    # joined before they are placed, so that one shuffle by block does for both
    numbered = placed(turns.join(blocks.where("kept") if sound else blocks, KEYS)).withColumn("turn_no", (F.col("offset") + F.col("place")).cast("bigint"))
    linked = reply_links(numbered.select("tbl", "conv_id", *TURN, "kept"))
    return linked.select("tbl", "conv_id", "turn_no", "row_id", "speaker", F.col("best.parent").alias("parent"), F.col("best.score").alias("score"), "kept")


def _conversations(spark, sf_dir: str, sound: bool = False) -> DataFrame:
    session, files = session_turns(table(spark, sf_dir, "session_one"), table(spark, sf_dir, "machine_zone"))
    return conversations(session.unionByName(message_turns(table(spark, sf_dir, "oc_message"), table(spark, sf_dir, "oc_part"))), files, sound)


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Turns of the sound conversations: ``tbl, conv_id, turn_no, row_id``."""
    in_tree = F.col("parent").isNotNull() | (F.col("turn_no") == 1)
    return _conversations(spark, sf_dir, sound=True).where(in_tree).select("tbl", "conv_id", "turn_no", "row_id")


def p6_links(spark, sf_dir: str) -> DataFrame:
    """Reply links of all conversations: each turn, its likeliest parent and the score."""
    return _conversations(spark, sf_dir).select("tbl", "conv_id", "turn_no", "row_id", "speaker", "parent", F.round("score", 6).alias("score"))
