"""Which texts are slightly changed copies of each other: shingles of five words, similarity of about 0.8 and more.

A text is summed up in ``BINS`` least shingle hashes (one permutation, one least hash a bin, empty bins
filled from the next), cut into ``BANDS`` keys. Texts that share a key are linked to the least text of that key, so a key
of any size gives as many links as it has texts and never pairs; linked texts form one class. With 12 keys of 5 bins, two
texts of similarity 0.8 share a key in 99 of 100 cases. Classes say which documents to keep apart; they err towards keeping apart.

Defined results: texts without a word have no keys; shorter texts than a shingle are one shingle; case and white space do not count.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage

WORDS, BINS, BANDS = 5, 60, 12
MEMORY, CHUNK = 500_000, 400_000
_EMPTY = np.uint64(2**64 - 1)
_POWERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 for i in range(WORDS)], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class BandKeys:
    """Keys of texts; hashes of words are remembered, which changes time only."""

    def __init__(self):
        self.codes: dict[str, int] = {}

    def _code(self, word: str) -> int:
        if len(self.codes) >= MEMORY:
            self.codes.clear()
        code = self.codes[word] = xxhash.xxh64_intdigest(word)
        return code

    def keys(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Per text its ``BANDS`` keys as int64, or None without a word."""
        found: list = [None] * len(texts)
        at, flat, lengths = [], [], []
        for i, text in enumerate(texts):
            words = text.lower().split() if text else ()
            if not words:
                continue
            known = self.codes
            flat += [known[w] if w in known else self._code(w) for w in words]
            flat += [0] * (WORDS - len(words))
            at.append(i)
            lengths.append(max(len(words), WORDS))
            if len(flat) > CHUNK:
                self._fill(found, at, flat, lengths)
                at, flat, lengths = [], [], []
        if at:
            self._fill(found, at, flat, lengths)
        return found

    def _fill(self, found: list, at: list, flat: list, lengths: list) -> None:
        codes = np.fromiter(flat, np.uint64, len(flat))
        starts = len(codes) - WORDS + 1
        hashes = sum(codes[k : k + starts] * _POWERS[k] for k in range(WORDS))
        owner = np.repeat(np.arange(len(at)), lengths)
        inside = owner[:starts] == owner[WORDS - 1 :]
        hashes, owner = _mixed(hashes[inside]), owner[:starts][inside]
        least = np.full(len(at) * BINS, _EMPTY)
        np.minimum.at(least, owner * BINS + ((hashes >> np.uint64(32)) % np.uint64(BINS)).astype(np.int64), hashes)
        least = least.reshape(len(at), BINS)
        rows = np.flatnonzero((least == _EMPTY).any(1))
        part, step = least[rows], 0
        whole = part.copy()
        while len(rows) and (part == _EMPTY).any():
            step += 1
            part = np.where(part == _EMPTY, np.roll(whole, -step, 1) + np.where(np.roll(whole, -step, 1) == _EMPTY, np.uint64(0), np.uint64(step)), part)
        least[rows] = part
        keys = np.zeros((len(at), BANDS), np.uint64)
        for k in range(BINS // BANDS):
            keys = _mixed(keys * _POWERS[1] + least[:, k :: BINS // BANDS])
        for i, row in zip(at, keys.view(np.int64)):
            found[i] = row


def copy_classes(texts: DataFrame) -> DataFrame:
    """``exact, cluster`` of texts that have slightly changed copies, for ``exact`` (hash of a text) and its ``keys``."""
    distinct = texts.where("exact is not null and keys is not null").groupBy("exact").agg(F.min("keys").alias("keys"))
    rows = cut_lineage(distinct.select("exact", F.posexplode("keys").alias("band", "key")))
    heads = rows.groupBy("band", "key").agg(F.min("exact").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = cut_lineage(rows.join(heads, ["band", "key"]).where("exact <> head").select("exact", "head").distinct())
    both = links.unionByName(links.select(F.col("head").alias("exact"), F.col("exact").alias("head")))
    labels = cut_lineage(both.select("exact").distinct().withColumn("cluster", F.col("exact")))
    changed = not labels.isEmpty()
    while changed:
        # the least label beside a text, then the label of that label, so that chains halve in each round
        beside = both.join(labels.withColumnRenamed("exact", "head"), "head").groupBy("exact").agg(F.min("cluster").alias("beside"))
        nearer = labels.join(beside, "exact").select("exact", F.col("cluster").alias("was"), F.least("cluster", "beside").alias("via"))
        jumped = nearer.join(labels.select(F.col("exact").alias("via"), F.col("cluster").alias("on")), "via", "left")
        after = cut_lineage(jumped.select("exact", "was", F.least("via", F.coalesce("on", "via")).alias("cluster")))
        changed = not after.where("cluster <> was").isEmpty()
        labels = after.select("exact", "cluster")
    return labels
