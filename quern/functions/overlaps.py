"""Which lists of words of two sides overlap, counted exactly by products of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A word on which less than this share of all pairs meet is counted by its pairs, any other by a product.
RARE = 1 / 64


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """How long each list is, and the list that each of the words stands in."""
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return sizes, np.repeat(np.arange(len(sizes)), sizes)


def shared_words(left: pa.ListArray, right: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both sides and, for each pair, how many words it shares; no list holds a word twice."""
    (na, ia), (nb, ib) = _rows(left), _rows(right)
    coded = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    codes, count = coded.indices.to_numpy(), len(coded.dictionary)
    wa, wb = codes[: len(ia)], codes[len(ia) :]
    meet = np.bincount(wa, minlength=count) * np.bincount(wb, minlength=count)
    often = meet >= max(1, RARE * len(na) * len(nb))
    place = np.cumsum(often) - 1

    def dense(rows: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
        out, held = np.zeros((length, int(often.sum())), np.float32), often[words]
        out[rows[held], place[words[held]]] = 1
        return out

    shared = np.rint(dense(ia, wa, len(na)) @ dense(ib, wb, len(nb)).T).astype(np.int64)
    rare = ~often & (meet > 0)
    ia, wa, ib, wb = ia[rare[wa]], wa[rare[wa]], ib[rare[wb]], wb[rare[wb]]
    if len(wa):
        order = np.argsort(wb, kind="stable")
        times = np.bincount(wb, minlength=count)
        start, each = (np.cumsum(times) - times)[wa], times[wa]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start, each)
        shared += np.bincount(np.repeat(ia, each) * len(nb) + ib[order[at]], minlength=shared.size).reshape(shared.shape)
    return na, nb, shared


def overlapping(left: pa.ListArray, right: pa.ListArray, overlap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places on both sides and similarity of the pairs that share a word and ``overlap`` of all their words."""
    na, nb, shared = shared_words(left, right)
    similarity = shared / np.maximum(1, na[:, None] + nb[None, :] - shared)
    i, j = np.nonzero((similarity >= overlap) & (shared > 0))
    return i, j, similarity[i, j]
