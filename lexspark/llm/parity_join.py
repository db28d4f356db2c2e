"""N-gram Jaccard join with parity sketches: every pair of similar documents, found by pigeonhole.

A set's sketch has a bit for each hash value, flipped by each token that falls on it. What two sets share
cancels out, so the XOR of their sketches is the sketch of their symmetric difference, and its
set bits are no more than the difference has members: the Hamming distance is a lower bound.

Sets of sizes x and y with a Jaccard similarity of ``percent`` differ in at most
D = ``(x + y) * (100 - percent) / (100 + percent)`` members. Sizes are cut into bands so wide that similar sets lie in one band or
in neighbours; the layout of a band has more words of 64 bits than any pair in it may differ in members. A member of the
difference touches one word, so two similar sets have all words but D alike, in the layout of the larger one's band. A
word is *strong* if ``STRONG`` bits of it are set; that, too, is alike where words are. A set shows the first words of a layout up to
its (D + 1)-th strong one, and has a key for each strong one among them: of the strong words of the one that shows fewer
places, one is left alone, and the other shows it as well. A set with too few strong words shows all, with a key for each. Words
that hold next to nothing, in which unlike sets agree by chance, thus give no keys, and no pair is lost.
A key is the XOR of the hashes of a word's tokens, with its place and band.

Candidates whose sketches differ in more bits than the sizes allow go; the others are confirmed on
the full sets, by the plan of :mod:`.similarity`.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from ._common import key_long, mix
from .similarity import Scheme, similar_documents

WORD = 64
#: Set bits of a word that has a key.
STRONG = 3
#: Sizes of one band: a wide one has sets with fewer tokens a word, a narrow one more sets with keys in two bands.
SPREAD = 125


class Bands:
    """Bands of set sizes for one similarity."""

    def __init__(self, percent: int) -> None:
        if not 1 <= percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent, self.lows = percent, [1]

    def of(self, size: int) -> int:
        while self.lows[-2:][0] <= size or len(self.lows) < 3:
            low = self.lows[-1]
            # the sizes that a set of the least size of the band may be similar to, at least
            self.lows.append(max(100 * low // self.percent, SPREAD * low // 100) + 1)
        return bisect_right(self.lows, size) - 1

    def differ(self, total: int) -> int:
        """Members in which two similar sets of ``total`` members together may differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def words(self, band: int) -> int:
        """Words of a band's sketches: one more than sets there may differ in, and some for weak ones."""
        self.of(self.lows[band])
        most = self.differ(2 * (self.lows[band + 1] - 1)) + 1
        return most + most // 8 + 2

    def layouts(self, size: int) -> list[tuple[int, int]]:
        """The bands in which a set of ``size`` may meet a similar one that differs from it, and how many strong
        words it has to show there."""
        own, largest = self.of(size), 100 * size // self.percent
        held = []
        for band in (own, own + 1):
            low, high = self.lows[band], self.lows[band + 1] - 1
            most = self.differ(size + min(largest, high))
            if largest >= low and most:
                held.append((band, most + 1))
        return held


def sketch(shingles: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Parities of ``words`` words of 64 bits, of which each token flips one, and the XOR of each word's tokens."""
    bins = (shingles % np.uint64(words * WORD)).astype(np.int64)
    flipped = (np.bincount(bins, minlength=words * WORD) & 1).astype(np.uint8)
    total = np.zeros(words, dtype=np.uint64)
    np.bitwise_xor.at(total, bins // WORD, shingles)
    return np.packbits(flipped).view(np.uint64), total


def shown(parity: np.ndarray, wanted: int) -> int:
    """Words up to the ``wanted``-th strong one, or all."""
    strong = np.flatnonzero(np.bitwise_count(parity) >= STRONG)
    return int(strong[wanted - 1]) + 1 if len(strong) >= wanted else len(parity)


def _signed(bands: Bands, shingles: np.ndarray) -> bytes:
    """The size; for each layout, the number of words shown, their parities and their XORs."""
    parts = [np.array([len(shingles)], dtype=np.uint64)]
    for band, wanted in bands.layouts(len(shingles)):
        parity, total = sketch(shingles, bands.words(band))
        n = shown(parity, wanted)
        parts += [np.array([n], dtype=np.uint64), parity[:n], total[:n]]
    return np.concatenate(parts).tobytes()


def _read(bands: Bands, sig: bytes) -> tuple[int, dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """The size, and by band the strong words wanted, parities and XORs."""
    held, at, out = np.frombuffer(sig, dtype=np.uint64), 1, {}
    size = int(held[0])
    for band, wanted in bands.layouts(size):
        n = int(held[at])
        out[band] = wanted, held[at + 1 : at + 1 + n], held[at + 1 + n : at + 1 + 2 * n]
        at += 1 + 2 * n
    return size, out


def _keys_of(bands: Bands, sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each strong word that is shown, or for all if there are too few."""
    place, keys = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
    for i, sig in enumerate(sigs):
        for band, (wanted, parity, total) in _read(bands, sig)[1].items():
            own = np.flatnonzero(np.bitwise_count(parity) >= STRONG)
            if len(own) < wanted:
                own = np.arange(len(parity))
            salt = mix((np.uint64(band) << np.uint64(40)) + own.astype(np.uint64) + np.uint64(1))
            keys.append(mix(total[own] ^ salt))
            place.append(np.full(len(own), i))
    return np.concatenate(place), key_long(np.concatenate(keys))


def may_link(bands: Bands, a: bytes, b: bytes) -> bool:
    """Whether two signatures leave room for similar sets that are not equal."""
    (x, p), (y, q) = (_read(bands, v) for v in (a, b))
    band, most = bands.of(max(x, y)), bands.differ(x + y)
    if 100 * min(x, y) < bands.percent * max(x, y) or not most:
        return False
    n = min(len(p[band][1]), len(q[band][1]))
    return bool(np.bitwise_count(p[band][1][:n] ^ q[band][1][:n]).sum() <= most)


@cache
def scheme(percent: int) -> Scheme:
    bands = Bands(percent)
    return Scheme(
        sign=lambda shingles: _signed(bands, shingles),
        keys=lambda sigs: _keys_of(bands, sigs),
        near=lambda a, b: np.array([may_link(bands, x, y) for x, y in zip(a, b, strict=True)], dtype=bool),
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` plus ``n_shingles``, ``component_id`` and ``kept`` over links between documents whose
    ``width``-word shingle sets have a Jaccard similarity of ``percent`` or more. No link is missed: the
    bound holds for every pair. Its defined cases are those of :func:`.similarity.similar_documents`."""
    return similar_documents(docs, scheme(percent), id_col, text_col, width, percent)
