"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

A text becomes the set of its distinct word shingles, the set a signature of ``SLOTS``
b-bit minima. Two sets of Jaccard similarity J differ in a slot with a chance of at most
1 - J, so at J = 0.8 a distance above ``DISTANCE`` of 64 slots has a chance of about 2e-6.

The index: the slots are split into ``CHUNKS`` chunks. By the pigeonhole principle two
signatures within ``DISTANCE`` agree on one chunk up to ``DISTANCE // CHUNKS`` = 1 slots, so
for every chunk each way of leaving one slot out is enumerated as a key; *all* pairs within
the distance share a key. Candidates are confirmed on the full shingle sets.

The plan, from keys to exact links, is that of :mod:`.similarity`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._common import key_long, mix
from .similarity import Scheme, similar_documents

#: Slots of a signature, bits of a slot, chunks of the index, greatest signature distance.
SLOTS, BITS, CHUNKS, DISTANCE = 64, 16, 15, 28

_rng = np.random.default_rng(20260)
_XOR = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
_STARTS = np.array([SLOTS * c // CHUNKS for c in range(CHUNKS)])
_CHUNK_OF = np.searchsorted(_STARTS, np.arange(SLOTS), side="right") - 1


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SLOTS`` minima of the set under as many permutations, cut to ``BITS`` bits."""
    with np.errstate(over="ignore"):
        low = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):  # keeps the matrix in cache
            part = (shingles[None, at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return (mix(low) >> np.uint64(64 - BITS)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, SLOTS) signatures -> (n, SLOTS) keys: key j stands for slot j's chunk without slot j."""
    with np.errstate(over="ignore"):
        each = (signatures.astype(np.uint64) + np.uint64(1)) * _KEY
        total = np.add.reduceat(each, _STARTS, axis=1)
        return mix(total[:, _CHUNK_OF] - each + _SALT)


def _loaded(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(-1, SLOTS)


def _keys_of(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sigs)), SLOTS), key_long(chunk_keys(_loaded(sigs)).ravel())


SCHEME = Scheme(
    sign=lambda shingles: signature(shingles).tobytes(),
    keys=_keys_of,
    near=lambda a, b: (_loaded(a) != _loaded(b)).sum(axis=1) <= DISTANCE,
)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` plus ``n_shingles``, ``component_id`` and ``kept``: :func:`.similarity.similar_documents`
    with MinHash signatures, its defined cases included."""
    return similar_documents(docs, SCHEME, id_col, text_col, width, percent)
