"""Encoding with a public byte-level BPE vocabulary (problem 7).

Forced-boundary splitting: a pair of neighbouring bytes that occurs inside no token of
the vocabulary can never be merged, so the text may be cut there and the pieces encoded
alone and joined. The vocabulary's splitting pattern looks at neighbours too, so a cut
is only taken where that cannot matter: between characters, not after white space
(``\\s+(?!\\S)`` looks ahead) and not beside an apostrophe (contractions). Most cuts fall
before the space of a word, so pieces are words, and a memory of encoded pieces does
most of the work. The cuts of a text are found at once over its bytes.

Defined results: null and empty texts give an empty list; marks such as
``<|endoftext|>`` inside a text are ordinary characters; texts of any length are
encoded whole.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import table

MEMORY = 400_000
BATCH_TOKENS = 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ForcedBoundaryEncoder:
    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memory: dict[bytes, list[int]] = {}
        # cut[a * 256 + b]: never a followed by b inside a token, and safe for the splitting pattern
        cut = np.ones((256, 256), bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                cut[a, b] = False
        cut[:, 0x80:0xC0] = False  # inside a character
        space_ends = [*range(0x21), 0x7F, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
        cut[space_ends, :] = False
        cut[0x27, :] = cut[:, 0x27] = False
        self.cut = cut.ravel()

    def pieces(self, data: bytes) -> list[bytes]:
        codes = np.frombuffer(data, np.uint8)
        pairs = codes[:-1].astype(np.uint16) << 8 | codes[1:]
        cuts = (np.flatnonzero(self.cut[pairs]) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)])]

    def _piece(self, piece: bytes) -> list[int]:
        ids = self._whole.encode_ordinary(piece.decode("utf-8"))
        if len(piece) <= 64:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memory, one = self.memory, self._piece
        found = [memory.get(p) or one(p) for p in self.pieces(text.encode("utf-8"))]
        return list(itertools.chain.from_iterable(found))


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str | None = None) -> ForcedBoundaryEncoder:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return ForcedBoundaryEncoder(vocabulary, pattern)


def encode_texts(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` for ``doc_id, text``; ``vocabulary`` is the path of a rank file on every executor."""
    vocabulary = vocabulary or default_vocabulary()

    def batch_of(ids: list, lists: list) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int32)
        values = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(offsets[-1]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            ids, lists, held = [], [], 0
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                lists.append(encode(texts[i].as_py()))
                ids.append(doc_id)
                held += len(lists[-1])
                if held > BATCH_TOKENS:
                    yield batch_of(ids, lists)
                    ids, lists, held = [], [], 0
            yield batch_of(ids, lists)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns plus ``n_tokens`` of ``text``; the tokens themselves never leave the worker."""
    vocabulary = vocabulary or default_vocabulary()
    df = df.select(*keep, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.drop("text").schema) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            texts = batch.column(len(keep))
            counts = [len(encode(texts[i].as_py())) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return df.mapInArrow(run, schema)


def p7_ids(spark, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``doc_id, ids``."""
    return encode_texts(table(spark, sf_dir, "documents"))
