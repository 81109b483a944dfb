"""Words of many texts at once, found over their bytes and hashed to a fixed number of buckets."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words of more bytes are hashed one by one.
VERY_LONG = 1024
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Buckets that stand for a word's shape: lower case, capital first letter, capitals, number, other signs.
SHAPES = 5
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _table() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = out[128:] = LETTER
    return out


_CLASSES = _table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_words(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bucket``, ``shape`` and ``owner`` (the text's number) of every word, in order.

    A word is a run of letters, of digits or of other signs, hashed by its length and all its bytes in lower case. Bytes
    beyond ASCII count as letters.
    """
    joined = b"\n".join(texts) + bytes(b"\n" * 9)
    raw = np.frombuffer(joined, dtype=np.uint8)
    low = _LOWER[raw]
    kind = _CLASSES[raw]
    edges = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    word = kind[edges] != SPACE
    starts, ends = edges[word], np.append(edges[1:], len(raw))[word]
    lengths = ends - starts
    eights = np.lib.stride_tricks.as_strided(low, (len(low) - 7, 8), (1, 1))
    mask = _MASKS[np.minimum(lengths, 8)]
    head = eights[starts].view("<u8")[:, 0] & mask
    tail = eights[np.maximum(ends - 8, starts)].view("<u8")[:, 0] & mask
    code = head * np.uint64(0x9E3779B97F4A7C15) ^ (tail + lengths.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    # What lies between the first and the last eight bytes, eight at a time; of very long words by a digest.
    long, at = np.flatnonzero(lengths > 16), 8
    for i in long[lengths[long] > VERY_LONG].tolist():
        code[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]], digest_size=8).digest(), "little"))
    long = long[lengths[long] <= VERY_LONG]
    while len(long):
        middle = eights[starts[long] + at].view("<u8")[:, 0]
        code[long] = (code[long] ^ middle ^ (middle >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        at += 8
        long = long[lengths[long] > at + 8]
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xD6E8FEB86659FD93)
    bucket = (code >> np.uint64(40)).astype(np.int64) % (buckets - SHAPES) + SHAPES
    upper = np.append(0, np.cumsum((raw >= 65) & (raw <= 90)))
    capitals = upper[ends] - upper[starts]
    shape = np.where(capitals == 0, 0, np.where(capitals == 1, 1, 2))
    shape[kind[starts] == DIGIT] = 3
    shape[kind[starts] == OTHER] = 4
    stops = np.cumsum([len(t) + 1 for t in texts])
    return bucket, shape, np.searchsorted(stops, starts, side="right")
