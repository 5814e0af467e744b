"""Routing metrics and lexical similarity of descriptions (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.session import table

INVALID, NONE = "INVALID", "none"
#: Function words that vote for a language.
VOTES = {"en": ("the", "is", "you", "and", "every", "when"), "de": ("die", "wenn", "ist", "und"), "es": ("la", "cuando", "está", "el"), "ja": ()}
LABELS = tuple(VOTES)


def normalize_judgment(label, labels=LABELS):
    """A valid label or ``none``; anything else, null too, is INVALID."""
    return F.when(label.isin(*labels, NONE), label).otherwise(INVALID)


def lexical_vote(text):
    """P5: the language with most function words; ``none`` without one or on a tie."""
    words = F.split(F.lower(text), r"[^a-záéíóúñüöäß]+")


    def heard(own: tuple):
        return F.size(F.filter(words, lambda w: w.isin(*own))) if own else F.lit(0)

    counts = F.array(*(F.struct(heard(v).alias("n"), F.lit(k).alias("label")) for k, v in VOTES.items()))
    top = F.array_max(F.transform(counts, lambda c: c["n"]))
    best = F.filter(counts, lambda c: c["n"] == top)
    return F.when(F.coalesce(top, F.lit(0)) == 0, NONE).when(F.size(best) > 1, NONE).otherwise(best[0]["label"])


def cases_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("case_id"), F.coalesce("lang", F.lit(NONE)).alias("gold"), normalize_judgment(lexical_vote(F.coalesce("text", F.lit("")))).alias("j1"), normalize_judgment(lexical_vote(F.substring(F.coalesce("text", F.lit("")), 1, 200))).alias("j2"))


def confusion(cases: DataFrame) -> DataFrame:
    """Sparse confusion matrix."""
    return cases.groupBy("gold", "j1").agg(F.count("*").alias("n"))


def label_metrics(cells: DataFrame, labels=LABELS) -> DataFrame:
    """D3: per label tp, fn, fp, precision, recall; undefined where nothing is counted. A wrong gold outside the labels is a false positive too.

    A cell counts for the two labels it names, so cells are spread to labels and not joined to them.
    """
    rows = cells.sparkSession.createDataFrame([(x, 0) for x in labels], "label string, zero bigint")
    same = F.col("gold") == F.col("j1")
    sides = F.when(same, F.array(F.struct(F.col("gold").alias("label"), F.lit("tp").alias("side")))).otherwise(F.array(F.struct(F.col("gold").alias("label"), F.lit("fn").alias("side")), F.struct(F.col("j1").alias("label"), F.lit("fp").alias("side"))))
    counted = cells.select("n", F.inline(sides)).where(F.col("label").isin(*labels)).groupBy("label").agg(*(F.sum(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in ("tp", "fn", "fp")))
    df = rows.join(counted, "label", "left").select("label", *(F.coalesce(s, "zero").alias(s) for s in ("tp", "fn", "fp")))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(a) + F.col(b), F.lit(0)).cast("double")), 6)
    return df.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def overall_metrics(cases: DataFrame) -> DataFrame:
    """Micro accuracy, specificity of ``none``, invalid rate, stability of the two judgments."""
    none = F.col("gold") == NONE
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return cases.agg(
        F.count("*").alias("cases"), share(F.col("gold") == F.col("j1")).alias("micro"), share(F.when(none, F.col("j1") == NONE)).alias("specificity"),
        F.coalesce(share(F.col("j1") == INVALID), F.lit(0.0)).alias("invalid_rate"), share(F.when(F.col("j2").isNotNull(), F.col("j1") == F.col("j2"))).alias("stability"),
    )


def confused_pairs(cells: DataFrame) -> DataFrame:
    """Unordered pairs of labels confused with each other, against the cases of either gold; INVALID is no member."""
    off = cells.where((F.col("gold") != F.col("j1")) & (F.col("j1") != INVALID) & (F.col("gold") != INVALID))
    raw = off.groupBy(F.least("gold", "j1").alias("a"), F.greatest("gold", "j1").alias("b")).agg(F.sum("n").alias("raw"))
    gold = cells.groupBy("gold").agg(F.sum("n").alias("g"))
    df = raw.join(F.broadcast(gold.select(F.col("gold").alias("a"), F.col("g").alias("ga"))), "a", "left").join(F.broadcast(gold.select(F.col("gold").alias("b"), F.col("g").alias("gb"))), "b", "left")
    related = F.coalesce("ga", F.lit(0)) + F.coalesce("gb", F.lit(0))
    return df.select("a", "b", "raw", related.alias("related"), F.round(F.coalesce(F.try_divide(F.col("raw").cast("double"), F.nullif(related, F.lit(0)).cast("double")), F.lit(0.0)), 6).alias("normalized"))


def descriptions_of(documents: DataFrame) -> DataFrame:
    """One description per skill: the least by document of its skill documents."""
    rows = documents.where("doc_kind = 'skill_doc' and skill_name is not null and text is not null")
    return rows.groupBy(F.col("skill_name").alias("name")).agg(F.min_by(tx.description_of(F.col("text")), "doc_id").alias("description"))


def collisions(descriptions: DataFrame, top_n: int | None = None, least: float = 0.0) -> DataFrame:
    """Pairs of descriptions by overlap of tokens.

    Only pairs that share a token are formed: overlap is counted by an equality join on tokens
    and two sizes, so no pair of unrelated descriptions is ever made (such pairs score zero). With ``least``
    above zero only pairs are formed that share one of the rarest tokens that a pair with so much overlap must share, and whose sizes allow it;
    without it every pair that shares a token is wanted, and made.
    """
    tokens = descriptions.select("name", tx.lexical_tokens(F.col("description")).alias("tokens")).withColumn("size", F.size("tokens"))
    each = tokens.select("name", "size", F.explode("tokens").alias("token"))
    if least > 0:
        rarity = each.groupBy("token").agg(F.count("*").alias("df"))
        ranked = each.join(rarity, "token").withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("df", "token")))
        head = ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1).select("name", "size", "token")
        a, b = head.select(F.col("name").alias("a"), F.col("size").alias("na"), "token"), head.select(F.col("name").alias("b"), F.col("size").alias("nb"), "token")
        met = a.join(b, "token").where("a < b").where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")).select("a", "b").distinct()
        held = lambda side: tokens.select(F.col("name").alias(side), F.col("tokens").alias("t" + side))
        shared = met.join(held("a"), "a").join(held("b"), "b").withColumn("both", F.array_intersect("ta", "tb"))
        scored = shared.select("a", "b", F.round(F.size("both") / (F.size("ta") + F.size("tb") - F.size("both")), 6).alias("jaccard"), F.array_join(F.array_sort("both"), " ").alias("shared")).where(F.col("jaccard") >= least)
        return scored if top_n is None else scored.orderBy(F.desc("jaccard"), "a", "b").limit(top_n)
    a, b = each.select(F.col("name").alias("a"), F.col("size").alias("na"), "token"), each.select(F.col("name").alias("b"), F.col("size").alias("nb"), "token")
    shared = a.join(b, "token").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("token")), " ").alias("shared"))
    scored = shared.select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"), "shared").where(F.col("jaccard") >= least)
    return scored if top_n is None else scored.orderBy(F.desc("jaccard"), "a", "b").limit(top_n)


def holdout_sizes(n_cases: int, n_none: int, spark) -> DataFrame:
    """Feasible holdouts ``H`` with ``ceil(.25 H) <= h <= M - ceil(.25 (N - H))`` for some h; closest to a fifth first."""
    sizes = spark.range(1, n_cases).select(F.col("id").alias("holdout"))
    low, high = F.ceil(F.col("holdout") * 0.25), F.least(F.col("holdout"), F.lit(n_none) - F.ceil((F.lit(n_cases) - F.col("holdout")) * 0.25))
    return sizes.select("holdout", low.alias("least_none"), high.alias("most_none"), F.round(F.abs(F.col("holdout") / n_cases - 0.2), 6).alias("distance")).where("least_none <= most_none")


def near_copies(pairs: DataFrame, a: str, b: str, limit: float = 0.30) -> DataFrame:
    """Edit distance over the longer length below ``limit``."""
    distance = F.try_divide(F.levenshtein(a, b).cast("double"), F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)).cast("double"))
    return pairs.withColumn("distance", F.round(F.coalesce(distance, F.lit(0.0)), 6)).where(F.col("distance") < limit)


def series_guard(series: DataFrame, metric: str, by: str) -> DataFrame:
    """Stop after two gains below one point, go back after a loss above five; undefined steps are left out."""
    w = Window.partitionBy(by).orderBy("iteration")
    step = F.round(F.col(metric) - F.lag(metric).over(w), 6)
    return series.withColumn("step", step).withColumns({"stop": F.coalesce((F.col("step") < 0.01) & (F.lag("step").over(w) < 0.01), F.lit(False)), "revert": F.coalesce(F.col("step") < -0.05, F.lit(False))})


def _cases(spark, sf_dir):
    return cases_of(table(spark, sf_dir, "documents"))


def d01_judgments(spark, sf_dir):
    return _cases(spark, sf_dir)


def d02_confusion(spark, sf_dir):
    return confusion(_cases(spark, sf_dir))


def d03_label_metrics(spark, sf_dir):
    return label_metrics(confusion(_cases(spark, sf_dir)))


def d04_overall(spark, sf_dir):
    return overall_metrics(_cases(spark, sf_dir))


def d05_confused_pairs(spark, sf_dir):
    return confused_pairs(confusion(_cases(spark, sf_dir)))


def d06_jaccard_pairs(spark, sf_dir):
    return collisions(descriptions_of(table(spark, sf_dir, "documents")))


def d07_tokens(spark, sf_dir):
    return descriptions_of(table(spark, sf_dir, "documents")).select("name", F.array_join(tx.lexical_tokens(F.col("description")), " ").alias("tokens"))


def d14_holdout(spark, sf_dir):
    return holdout_sizes(188, 47, spark)


def distinct_descriptions(documents: DataFrame) -> DataFrame:
    """Descriptions of skill documents, equal ones once: by the first document that has it, and how many have."""
    rows = documents.where("doc_kind = 'skill_doc' and text is not null").select("doc_id", tx.description_of(F.col("text")).alias("description")).where("description <> ''")
    return rows.groupBy("description").agg(F.min("doc_id").alias("name"), F.count("*").alias("copies"))


def d15_near_copies(spark, sf_dir):
    """Pairs of different descriptions that are near copies, by the first document of each, with the copies of both."""
    d = distinct_descriptions(table(spark, sf_dir, "documents"))
    pairs = collisions(d, least=0.3).select("a", "b")
    side = lambda s: d.select(F.col("name").alias(s), F.col("description").alias("d" + s), F.col("copies").alias("copies_" + s))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return near_copies(both, "da", "db").select("a", "b", "copies_a", "copies_b", "distance")


def d16_high_entropy(spark, sf_dir):
    return table(spark, sf_dir, "session_one").where(tx.high_entropy(F.col("message.content"))).select("row_id")


def d17_series_guard(spark, sf_dir):
    """Share of errors per user and week as a metric over iterations."""
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    series = table(spark, sf_dir, "events").groupBy("user_id", week.alias("iteration")).agg(F.round(F.avg((F.col("event_type") != "error").cast("double")), 6).alias("precision"))
    return series_guard(series, "precision", "user_id")
