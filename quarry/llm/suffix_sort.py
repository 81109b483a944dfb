"""Suffix sorting by a difference cover, over arrays.

The positions not divisible by 3 cover all differences modulo 3. Their triples are sorted and named; equal names are
told apart by sorting the suffixes of the string of names in the same way. The other suffixes follow from one symbol
and the rank of the sampled suffix behind it, and both kinds are merged by counting, for every unsampled suffix, the
sampled ones of either kind before it.
"""

from __future__ import annotations

import numpy as np

#: Three symbols below 2**BITS fit a key of 63 bits as they are, two below 2**WIDE always.
BITS, WIDE = 21, 31


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``keys`` and for each key its name, from 1, equal keys having equal names."""
    order = np.argsort(keys)
    inorder = keys[order]
    names = np.empty(len(keys), dtype=np.int64)
    names[order] = np.cumsum(np.append(True, inorder[1:] != inorder[:-1]))
    return order, names


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the triples; of large symbols the first two are named first."""
    if max(int(x.max(initial=0)) for x in (a, b, c)) < 1 << BITS:
        return a << 2 * BITS | b << BITS | c
    return _ranked(a << WIDE | b)[1] << WIDE | c


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``symbols`` (whole numbers from 0 below 2**30, as many at most) in lexicographic order."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    t = np.zeros(n + 3, dtype=np.int64)
    t[:n] = symbols.astype(np.int64) + 1
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    # A string whose length is 1 modulo 3 gets one empty sampled suffix, so that every unsampled suffix has one behind it.
    sample = np.concatenate([ones, twos])
    _, names = _ranked(_triples(t[sample], t[np.minimum(sample + 1, n + 2)], t[np.minimum(sample + 2, n + 2)]))
    if len(sample) and names.max() < len(sample):
        deeper = suffix_order(names)
        names = np.empty(len(sample), dtype=np.int64)
        names[deeper] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = names
    zeros = np.arange(0, n, 3)
    by_one = t[:n] << WIDE | rank[1 : n + 1]
    by_two = _triples(t[:n], t[1 : n + 1], rank[2 : n + 2])
    zeros = zeros[np.argsort(by_one[zeros])]
    in_rank = sample[np.argsort(names)]
    in_rank = in_rank[in_rank < n]
    sorted_ones, sorted_twos = in_rank[in_rank % 3 == 1], in_rank[in_rank % 3 == 2]
    before = np.searchsorted(by_one[sorted_ones], by_one[zeros]) + np.searchsorted(by_two[sorted_twos], by_two[zeros])
    out = np.full(n, -1)
    out[before + np.arange(len(zeros))] = zeros
    out[out < 0] = in_rank
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For suffixes ``starts`` in order: whether each has the first ``length`` bytes in common with the one before it.

    ``text`` needs 8 bytes behind the last of these prefixes.
    """
    same = np.ones(len(starts), dtype=bool)
    same[:1] = False
    eights = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    alive = np.flatnonzero(same)
    for at in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        mine = eights[starts[alive] + at].view("<u8")[:, 0]
        other = eights[starts[alive - 1] + at].view("<u8")[:, 0]
        fits = mine == other
        same[alive[~fits]] = False
        alive = alive[fits]
    return same
