"""Words of whole texts as 64-bit hashes, by numpy over the bytes of many texts at once.

A word is a maximal run of the bytes of a class after A-Z is lower-cased. Both classes are closed under
UTF-8: a byte from 0x80 on is always a word byte, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_bytes(not_word: Sequence[tuple[int, int]]) -> np.ndarray:
    word = np.ones(256, dtype=bool)
    for a, b in not_word:
        word[a : b + 1] = False
    return word


#: [^\x20\x09-\x0D]+
SPACED = _word_bytes([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text
ALNUM = _word_bytes([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = int(_rng.integers(1, 2**63, dtype=np.uint64)) | 1
_PLACE = np.ones(64, dtype=np.uint64)
for _i in range(1, 64):
    _PLACE[_i] = U64((int(_PLACE[_i - 1]) * _BASE) % 2**64)
_SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _places(n: int) -> np.ndarray:
    global _PLACE
    while len(_PLACE) < n:
        step = U64(pow(_BASE, len(_PLACE), 2**64))
        _PLACE = np.concatenate([_PLACE, _PLACE * step])
    return _PLACE


def _piece(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one byte array."""
    low = _LOWER[data]
    m = word[low]
    edge = np.flatnonzero(np.diff(m, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U64), starts
    lens = ends - starts
    at = np.flatnonzero(m)
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    k = np.arange(len(at)) - np.repeat(first, lens)
    v = _BYTE[low[at]] * _places(int(lens.max()))[k]
    return mix(np.add.reduceat(v, first) + lens.astype(U64)), starts


def _cut(text: bytes, word: np.ndarray) -> Iterator[bytes]:
    """A long text in pieces that end where a word does."""
    a = 0
    while a < len(text):
        b = min(a + PIECE, len(text))
        while b < len(text):
            gap = np.flatnonzero(~word[_LOWER[np.frombuffer(text, np.uint8, min(4096, len(text) - b), b)]])
            if len(gap):
                b += int(gap[0]) + 1
                break
            b = min(b + 4096, len(text))
        yield text[a:b]
        a = b


def hash_texts(texts: Sequence[bytes | None], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    found, counts = [], np.zeros(len(texts) + 1, dtype=np.int64)
    group: list[int] = []
    room = 0

    def flush() -> None:
        nonlocal group, room
        if group:
            blob = b"\n".join(texts[i] for i in group)
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            h, starts = _piece(np.frombuffer(blob, np.uint8), word)
            found.append(h)
            counts[np.asarray(group) + 1] = np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(group))
        group, room = [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > PIECE:
            flush()
            for part in _cut(t, word):
                h, _ = _piece(np.frombuffer(part, np.uint8), word)
                found.append(h)
                counts[i + 1] += len(h)
            continue
        group.append(i)
        room += len(t)
        if room > PIECE:
            flush()
    flush()
    return (np.concatenate(found) if found else np.empty(0, U64)), np.cumsum(counts)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one text; a text of fewer words, but some, is one run."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return mix(np.array([np.add.reduce(h * _SLOT[:n]) + U64(n)], dtype=U64))
    s = h[: n - k + 1] * _SLOT[0]
    for j in range(1, k):
        s += h[j : n - k + 1 + j] * _SLOT[j]
    return mix(s + U64(k))


def utf8(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
