"""Words of many texts as arrays: places and 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text that are looked at together; a longer text is looked at alone.
CHUNK = 1 << 21

_BLANKS = b" \t\n\x0b\x0c\r"
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (finaliser of SplitMix64)."""
    # Fixed values of the published finaliser.
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Odd multipliers of the rolling hashes, by the rule of the finaliser.
BYTE, WORD = (int(v) | 1 for v in mix(np.array([11, 12], U)))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n - 1), modulo 2**64."""
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


@dataclass
class Words:
    """Words of the texts [first, first + texts) in order."""

    first: int
    texts: int
    data: bytes
    #: Per word: its text (from ``first``), and its bytes [start, end) in ``data``.
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: Per text, the number of its first word; one more entry closes the last.
    bounds: np.ndarray


def _chunk(texts: list[bytes], first: int) -> Words:
    data = b" ".join([*texts, b""])
    array = np.frombuffer(data, np.uint8)
    blank = np.zeros(256, bool)
    blank[list(_BLANKS)] = True
    spaces = blank[array] if len(array) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], spaces, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    lengths = end - start
    letters = array[~spaces]
    head = np.cumsum(lengths) - lengths
    if len(start):
        table = mix(np.arange(1, 257, dtype=U))
        within = np.arange(len(letters)) - np.repeat(head, lengths)
        values = table[letters] * powers(BYTE, int(lengths.max()))[within]
        hashes = mix(np.add.reduceat(values, head) + lengths.astype(U) * U(WORD))
    else:
        hashes = np.zeros(0, U)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(first, len(texts), data, doc, start, end, hashes, bounds)


def words(texts: list[bytes | None]) -> Iterator[Words]:
    """The texts in chunks of bounded size; null counts as empty."""
    at = 0
    while at < len(texts):
        size, until = 0, at
        while until < len(texts) and (until == at or size + len(texts[until] or b"") <= CHUNK):
            size += len(texts[until] or b"")
            until += 1
        yield _chunk([t or b"" for t in texts[at:until]], at)
        at = until


class Sequences:
    """Hashes of runs of consecutive words."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(hashes * powers(WORD, n), dtype=U)))
        self.inverse = powers(pow(WORD, -1, 1 << 64), n + 1)

    def hash(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])
