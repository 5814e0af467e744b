"""Reading level of each document (problem 9).

Documents and the words of their English prose form a bipartite graph, an edge weighing
how often the word stands in the document. Documents of known level are clamped; then
difficulty is propagated: a word takes the weighted mean of its documents, a document
the weighted mean of its words, a word counting more the less its documents differ.
A line fitted on the clamped documents undoes the shrinking of the means in each round.
Rounds are harmonic and end when the words move by less than ``STILL`` on average, after ``ROUNDS`` at most. The
difficulty is then cut into levels where the clamped documents are best told apart; these keep the level they have.

Distribution: the graph is written once, one row per document (hashed words, counts).
A round reads it in one pass and reduces to one row per word and task before the
shuffle, so a word in every document is no hot key. The word table is sent to the tasks
only if it has at most ``MAX_WORDS`` rows. Beyond that the most frequent words, ``MAX_WORDS`` of them at most, are sent, and
only edges to the others, none of which is frequent, meet their words by a join; sums per word are made per task all the same. The driver holds the words it sends (within that bound), five sums and a
histogram of fixed size, never documents.

Defined results: null and blank texts and texts with fewer than ``MIN_WORDS`` words of
English prose have no level, even if one is known; without any graded document the result is empty; texts are
read whole; equal texts get equal levels unless one is known.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.prose import english_words
from quern.session import cut_lineage, table

MIN_WORDS, ROUNDS, MAX_WORDS, BINS, STILL = 40, 12, 300_000, 600, 0.01
SMOOTH, SPREAD = 1.0, 0.05


def word_graph(documents: DataFrame) -> DataFrame:
    """``doc_id, words array<bigint>, counts array<int>`` of documents with enough prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of: dict[str, int] = {}
        for batch in batches:
            ids, words, counts, offsets = [], [], [], [0]
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                found = english_words(texts[i].as_py())
                if len(found) < MIN_WORDS:
                    continue
                held = Counter(found)
                for w in held:
                    if w not in key_of:
                        if len(key_of) > MAX_WORDS:
                            key_of.clear()
                        key_of[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
                ids.append(doc_id)
                words += [key_of[w] if w in key_of else xxhash.xxh64_intdigest(w) - (1 << 63) for w in held]
                counts += held.values()
                offsets.append(len(words))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(at, pa.array(words, pa.int64())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))], names=["doc_id", "words", "counts"])

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(run, "doc_id bigint, words array<bigint>, counts array<int>")


class Words:
    """The word side of one round: keys in order, value and weight of each."""

    def __init__(self, keys: np.ndarray, sums: np.ndarray, squares: np.ndarray, weights: np.ndarray, prior: float):
        order = np.argsort(keys)
        self.keys = keys[order]
        n = weights[order]
        self.value = (sums[order] + SMOOTH * prior) / (n + SMOOTH)
        spread = np.maximum(squares[order] / n - 2 * self.value * sums[order] / n + self.value**2, 0)
        self.weight = 1 / (SPREAD + spread)
        self.prior = prior

    def parts(self, offsets: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights and of weighted values over the words of each document that are here."""
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        weight = np.where(self.keys[at] == words, self.weight[at], 0.0) * counts
        return np.add.reduceat(weight, offsets[:-1]), np.add.reduceat(weight * self.value[at], offsets[:-1])

    def scores(self, offsets: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total, value = self.parts(offsets, words, counts)
        return np.where(total > 0, value / np.maximum(total, 1e-12), self.prior)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, counts = batch.column("words"), batch.column("counts")
    offsets = words.offsets.to_numpy()
    return offsets - offsets[0], words.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False).astype(float)


def _difficulty(score: np.ndarray, line: tuple[float, float]) -> np.ndarray:
    return np.clip(line[0] * score + line[1], 1, 4)


def score_documents(graph: DataFrame, words: Words) -> DataFrame:
    """``doc_id, level, score`` from a word table within ``MAX_WORDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("level"), pa.array(words.scores(*_lists(batch)))], names=["doc_id", "level", "score"])

    return graph.mapInArrow(run, "doc_id bigint, level bigint, score double")


def word_sums(graph: DataFrame, words: Words | None, line: tuple[float, float], prior: float) -> DataFrame:
    """``word, s, q, n``: sums of difficulty, of its square and of edge weights, one row per task and word before the shuffle.

    The difficulty of a document is its level, or what its words say; or ``score``, if the graph brings one.
    """
    scored = "score" in graph.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] | None = {}

        def rows(keys, sums):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(3))], names=["word", "s", "q", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, keys, counts = _lists(batch)
            level = batch.column("level").to_numpy(zero_copy_only=False).astype(float)
            if scored:
                base = _difficulty(batch.column("score").to_numpy(zero_copy_only=False), line)
            else:
                base = np.full(len(level), prior) if words is None else _difficulty(words.scores(offsets, keys, counts), line)
            value = np.where(np.isnan(level), base, level)
            each = np.repeat(value, np.diff(offsets))
            unique, index = np.unique(keys, return_inverse=True)
            sums = np.stack([np.bincount(index, counts * x, len(unique)) for x in (each, each * each, np.ones_like(each))], 1)
            if len(held) > MAX_WORDS:
                yield rows(list(held), np.array(list(held.values())))
                held = {}
            for k, v in zip(unique.tolist(), sums):
                if k in held:
                    held[k] += v
                else:
                    held[k] = v
        if held:
            yield rows(list(held), np.array(list(held.values())))

    return graph.mapInArrow(run, "word bigint, s double, q double, n double").groupBy("word").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))


def _word_values(sums: DataFrame, prior: float) -> DataFrame:
    """``word, value, weight``: the word side of a round as a table."""
    mean = (F.col("s") + SMOOTH * prior) / (F.col("n") + SMOOTH)
    spread = F.greatest(F.col("q") / F.col("n") - 2 * mean * F.col("s") / F.col("n") + mean * mean, F.lit(0.0))
    return sums.select("word", mean.alias("value"), (1 / (SPREAD + spread)).alias("weight"))


def frequent_words(sums: DataFrame, most: int) -> np.ndarray:
    """The words that weigh most, ``most`` at the most, in order; all others stand in few documents each."""
    return np.sort(np.array([r["word"] for r in sums.orderBy(F.desc("n"), "word").limit(most).select("word").collect()], np.int64))


def split_scores(graph: DataFrame, sums: DataFrame, prior: float, sent: np.ndarray) -> DataFrame:
    """The scores of ``score_documents`` for word tables of any size: ``sent`` words in the tasks, the others by a join."""
    rows = sums.join(F.broadcast(sums.sparkSession.createDataFrame([(int(w),) for w in sent], "word bigint")), "word", "left_semi") if len(sent) else sums.where("false")  # within MAX_WORDS
    held = rows.toArrow()
    words = Words(*(held.column(c).to_numpy() for c in ("word", "s", "q", "n")), prior) if len(sent) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, keys, counts = _lists(batch)
            total, value = words.parts(offsets, keys, counts) if words else (np.zeros(batch.num_rows), np.zeros(batch.num_rows))
            rare = ~np.isin(keys, sent)
            lengths = np.add.reduceat(rare, offsets[:-1], dtype=np.int64)
            at = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x[rare])) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("level"), pa.array(total), pa.array(value), *lists], names=["doc_id", "level", "total", "value", "words", "counts"])

    parts = graph.mapInArrow(run, "doc_id bigint, level bigint, total double, value double, words array<bigint>, counts array<double>")
    edges = parts.select("doc_id", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("doc_id", F.col("e.words").alias("word"), F.col("e.counts").alias("k"))
    w = F.col("k") * F.col("weight")
    rare = edges.join(_word_values(sums, prior), "word").groupBy("doc_id").agg(F.sum(w).alias("rare_total"), F.sum(w * F.col("value")).alias("rare_value"))
    total, value = (F.col(c) + F.coalesce(f"rare_{c}", F.lit(0.0)) for c in ("total", "value"))
    return parts.join(rare, "doc_id", "left").select("doc_id", "level", F.when(total > 0, value / total).otherwise(F.lit(prior)).alias("score"))


def fit_line(scores: DataFrame) -> tuple[float, float]:
    """Slope and intercept of level by score over the clamped documents."""
    r = scores.where("level is not null").agg(F.count("*").alias("n"), F.sum("score").alias("x"), F.sum("level").alias("y"), F.sum(F.col("score") * F.col("score")).alias("xx"), F.sum(F.col("score") * F.col("level")).alias("xy")).first()
    spread = r["n"] * r["xx"] - r["x"] ** 2
    if spread < 1e-9:
        return 1.0, 0.0
    slope = max((r["n"] * r["xy"] - r["x"] * r["y"]) / spread, 1e-6)
    return slope, (r["y"] - slope * r["x"]) / r["n"]


def fit_cuts(scores: DataFrame, line: tuple[float, float]) -> list[float]:
    """Three cuts between the levels, from a histogram of ``BINS`` bins over the clamped documents."""
    value = F.least(F.greatest(line[0] * F.col("score") + line[1], F.lit(1.0)), F.lit(4.0))
    hist = np.zeros((4, BINS + 1))
    for r in scores.where("level is not null").groupBy("level", F.floor((value - 1) / 3 * BINS).cast("int").alias("bin")).count().collect():
        hist[min(max(int(r["level"]), 1), 4) - 1, r["bin"]] += r["count"]
    cuts = []
    for k in (1, 2, 3):
        low, high = hist[:k].sum(0), hist[k:].sum(0)
        # a document of bin b or less counts as low if the cut is b
        wrong = np.array([low[b + 1 :].sum() + high[: b + 1].sum() for b in range(-1, BINS + 1)])
        best = np.flatnonzero(wrong == wrong.min())
        cuts.append(1 + 3 * (best[len(best) // 2]) / BINS)
    return cuts


def _moved(before: DataFrame, after: DataFrame) -> float:
    """How far the mean of a word moved, on average."""
    mean = F.col("s") / F.col("n")
    both = before.select("word", mean.alias("a")).join(after.select("word", mean.alias("b")), "word")
    return both.agg(F.avg(F.abs(F.col("a") - F.col("b")))).first()[0] or 0.0


def reading_levels(documents: DataFrame, graded: DataFrame, rounds: int = ROUNDS, max_words: int = MAX_WORDS, still: float = STILL) -> DataFrame:
    """``doc_id, difficulty, level`` of every document with enough prose."""
    grades = graded.where("level is not null").groupBy("doc_id").agg(F.min("level").alias("level"))
    graph = cut_lineage(word_graph(documents).join(grades, "doc_id", "left"))
    known = graph.where("level is not null")
    first = known.agg(F.avg("level").alias("mean")).first()["mean"]
    if first is None:
        return graph.select("doc_id", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("bigint").alias("level")).where("false")
    prior, line = float(first), (1.0, 0.0)
    sums = cut_lineage(word_sums(graph, None, line, prior))
    small = sums.count() <= max_words
    scores = last = None
    if small:
        for i in range(rounds):
            held = sums.toArrow()
            words = Words(*(held.column(c).to_numpy() for c in ("word", "s", "q", "n")), prior)
            scores = score_documents(graph, words)
            line = fit_line(score_documents(known, words))
            if i == rounds - 1 or (last is not None and np.abs(words.value - last).mean() < still):
                break
            last = words.value
            sums = word_sums(graph, words, line, prior)
    else:
        sent = frequent_words(sums, max_words)
        for i in range(rounds):
            scores = cut_lineage(split_scores(graph, sums, prior, sent))
            line = fit_line(scores)
            if i == rounds - 1 or (last is not None and _moved(last, sums) < still):
                break
            last = sums
            sums = cut_lineage(word_sums(graph.join(scores.select("doc_id", "score"), "doc_id"), None, line, prior))
    cuts = fit_cuts(scores, line)
    value = F.least(F.greatest(line[0] * F.col("score") + line[1], F.lit(1.0)), F.lit(4.0))
    level = F.lit(1)
    for c in cuts:
        level = level + F.when(value >= c, 1).otherwise(0)
    return scores.select("doc_id", F.coalesce(F.col("level").cast("double"), value).alias("difficulty"), F.coalesce("level", level.cast("bigint")).alias("level"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Level 1 (easiest) to 4 of every document with enough English prose: ``doc_id, level``."""
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_level_sample")).select("doc_id", "level")


def p9_profile(spark, sf_dir: str) -> DataFrame:
    """The corpus by level, source and kind: documents and mean difficulty."""
    documents = table(spark, sf_dir, "documents")
    levels = reading_levels(documents, table(spark, sf_dir, "doc_level_sample"))
    return documents.select("doc_id", "source", "doc_kind").join(levels, "doc_id").groupBy("source", "doc_kind", "level").agg(F.count("*").alias("documents"), F.round(F.avg("difficulty"), 4).alias("mean_difficulty"))
