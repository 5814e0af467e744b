"""Filling containers of fixed capacity with documents (problem 8).

Conflict-constrained best fit: items come in order of decreasing size; bins are kept by
residual room and carry two bitmaps, of the duplicate clusters and of the sources they
hold. A successor search starts at the smallest residual that takes the item and goes
on until a bin with neither the item's cluster nor its source is found: the tightest compatible bin.

Neither conflict can always be kept without waste: a cluster or source with more members than there
are bins must share. A cluster is therefore coloured so that no colour has more members than the
bins that the items need at least; each colour is a bit of its own, and only members of one
colour exclude each other. One with no more members than these bins has one colour, that is, its
members never meet. The conflict of sources yields: where every bin with room
and without the cluster holds the source, the tightest of these is taken, since a bin of its own would cost the room that the problem
asks to save. The cluster never yields.

A cluster holds slightly changed copies (``shingles``) and texts equal but for case and white space. Members
of clusters with more than a ``CROWDED``-th of the bins are placed first, while
every bin still has room; were they left to the end, as their size may ask, each would
open a bin of its own. This changes the order only.

An item larger than the capacity is cut into full pieces and a rest; nothing else is
cut. Packing is done in groups of about ``GROUP`` documents taken by hash, which bounds
a task whatever the corpus, source or cluster; each group leaves at most a few bins less
than full.

Defined results: null and empty texts have no tokens and take no room but have a place;
capacities below one are left out; equal texts are separate items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shingles import BandKeys, copy_classes
from quern.llm.tokens import default_vocabulary, encoder
from quern.session import cut_lineage, table

GROUP = 20_000
CROWDED = 40
NEAR = 64  # bins that are looked at one by one before all are looked at together


class Bins:
    """Open bins by residual room, with what each holds."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room: list[int] = []  # by bin
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.order: list[tuple[int, int]] = []  # (room, bin)
        self.holders: dict[tuple[str, int], list[int]] = defaultdict(list)
        self.left = np.empty(1024, np.int64)  # room by bin again, for looking at all of them

    def tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The bin with least room for ``size`` that has neither; without the source if there is none, None if all hold the cluster."""
        order, sources, clusters = self.order, self.sources, self.clusters
        at, second = bisect_left(order, (size, -1)), None
        for _, b in order[at : at + NEAR]:
            if not clusters[b] & cluster:
                if not sources[b] & source:
                    return b
                second = b if second is None else second
        if len(order) - at <= NEAR:
            return second
        left = np.where(self.left[: len(self.room)] >= size, self.left[: len(self.room)], self.capacity + 1)
        left[self.holders["cluster", cluster] if cluster else []] = self.capacity + 1
        if second is None:
            second = int(left.argmin()) if left.min() <= self.capacity else None
        left[self.holders["source", source] if source else []] = self.capacity + 1
        return int(left.argmin()) if left.min() <= self.capacity else second

    def put(self, b: int | None, size: int, source: int, cluster: int) -> int:
        if b is None:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            if b == len(self.left):
                self.left = np.concatenate([self.left, np.empty_like(self.left)])
        else:
            del self.order[bisect_left(self.order, (self.room[b], b))]
        self.room[b] -= size
        self.left[b] = self.room[b]
        insort(self.order, (self.room[b], b))
        if source and not self.sources[b] & source:
            self.sources[b] |= source
            self.holders["source", source].append(b)
        if cluster:
            self.clusters[b] |= cluster
            self.holders["cluster", cluster].append(b)
        return b


class Colours:
    """Bits of keys with more than one member, a bit for every ``share`` members in order."""

    def __init__(self, members: dict, share: int):
        self.members, self.share = members, share
        self.seen: dict = defaultdict(int)
        self.bits: dict = {}

    def bit(self, key) -> int:
        if key is None or self.members.get(key, 0) < 2:
            return 0
        colour = (key, self.seen[key] // self.share)
        self.seen[key] += 1
        return 1 << self.bits.setdefault(colour, len(self.bits))


def pack_items(items: list[tuple], capacity: int) -> list[tuple]:
    """``(bin, key, piece, start, size)`` for items ``(key, size, source, cluster)``."""
    placed, rests, full = [], [], 0
    for key, size, source, cluster in items:
        pieces = size // capacity if size > capacity else 0
        for p in range(pieces):
            placed.append((full, key, p, p * capacity, capacity))
            full += 1
        if size - pieces * capacity or not pieces:
            rests.append((size - pieces * capacity, key, source, cluster, pieces))
    need = max(1, -(-sum(r[0] for r in rests) // capacity))
    of_cluster, of_source = Counter(r[3] for r in rests if r[3] is not None and r[0]), Counter(r[2] for r in rests if r[0])
    clusters, sources = Colours(of_cluster, need), Colours(of_source, len(rests) + 1)

    crowd = lambda r: of_cluster.get(r[3], 0) if r[0] and of_cluster.get(r[3], 0) * CROWDED > need else 0
    rests.sort(key=lambda r: (-crowd(r), -r[0], r[1]))
    bins = Bins(capacity)
    for size, key, source, cluster, piece in rests:
        wanted, origin = (clusters.bit(cluster), sources.bit(source)) if size else (0, 0)
        b = bins.put(bins.tightest(size, origin, wanted), size, origin, wanted)
        placed.append((full + b, key, piece, piece * capacity, size))
    return placed


def sized_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, cluster, n_tokens``; a cluster holds slightly changed copies and texts equal but for case and white space."""
    vocabulary = vocabulary or default_vocabulary()
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    keyed = documents.select("doc_id", F.xxhash64("source").alias("source"), F.when(F.length(plain) > 0, F.xxhash64(plain)).alias("exact"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, keys = encoder(vocabulary).encode, BandKeys().keys
        for batch in batches:
            texts = batch.column(3).to_pylist()
            counts = [len(encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(keys(texts), pa.list_(pa.int64()))], names=["doc_id", "source", "exact", "n_tokens", "keys"])

    read = cut_lineage(keyed.mapInArrow(run, "doc_id bigint, source bigint, exact bigint, n_tokens bigint, keys array<bigint>"))
    # a class is small next to the texts: only texts with changed copies are looked up
    return read.drop("keys").join(copy_classes(read), "exact", "left").select("doc_id", "source", F.coalesce("cluster", "exact").alias("cluster"), "n_tokens")


def pack_documents(sized: DataFrame, documents_count: int, capacities: list[tuple[int, int]], group: int = GROUP) -> DataFrame:
    """``capacity_id, container_id, doc_id, piece_no, start_token, n_tokens``."""
    groups = max(1, round(documents_count / group))
    sizes = F.array(*(F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in capacities))
    spread = sized.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups))).select("*", F.inline(sizes))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity_id, capacity, part = int(pdf["capacity_id"].iloc[0]), int(pdf["capacity"].iloc[0]), int(pdf["part"].iloc[0])
        cluster = [None if pd.isna(c) else int(c) for c in pdf["cluster"]]
        items = sorted(zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), pdf["source"].tolist(), cluster), key=lambda x: x[0])
        placed = pack_items(items, capacity)
        out = pd.DataFrame(placed, columns=["bin", "doc_id", "piece_no", "start_token", "n_tokens"])
        out.insert(0, "container_id", [f"{capacity_id}-{part}-{b}" for b in out.pop("bin")])
        out.insert(0, "capacity_id", capacity_id)
        return out

    schema = "capacity_id int, container_id string, doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint"
    # the hash of a cluster is carried as text so that pandas keeps all its digits
    typed = spread.withColumn("cluster", F.col("cluster").cast("string"))
    return typed.groupBy("capacity_id", "capacity", "part").applyInPandas(run, schema)


def p8_containers(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document in its container, for each capacity."""
    documents = table(spark, sf_dir, "documents")
    capacities = sorted((r["capacity_id"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacity").where("capacity_tokens > 0").collect())  # a fixed table
    return pack_documents(sized_documents(documents), documents.count(), capacities)


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of room used per capacity."""
    packed = p8_containers(spark, sf_dir)
    capacity = table(spark, sf_dir, "pack_capacity")
    per_bin = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    return per_bin.join(F.broadcast(capacity), "capacity_id").groupBy("capacity_id", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.count("*") * F.first("capacity_tokens")), 5).alias("filled"))
