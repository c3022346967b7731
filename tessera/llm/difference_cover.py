"""Suffix sorting with the difference cover {1, 2} modulo 3, in vectorised numpy.

Sampled suffixes, those at places 1 and 2 modulo 3, are sorted by their first three symbols and
named; unless all names differ, the names in text order are a text of two thirds of the length,
which is sorted in the same way. The other suffixes follow from their first symbol and the rank
of the suffix behind it, and both kinds are merged by keys that a common offset of the cover
makes comparable.
"""

from __future__ import annotations

import numpy as np


def ranks_of(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each row of keys, most significant key first, equal rows alike; and how many differ."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum()) + 1 if len(order) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of text (integers from 1 up) in the order of the suffixes that start there."""
    n = len(text)
    if n < 12:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = text
    # as many places of 0 as of 1 modulo 3, so that names of the first half end in a filler
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    padded = np.concatenate([s, np.zeros(3, np.int64)])
    name, kinds = ranks_of(padded[sample], padded[sample + 1], padded[sample + 2])
    if kinds < len(sample):
        order = suffix_array(name + 1)
        rank_in_sample = np.empty(len(sample), np.int64)
        rank_in_sample[order] = np.arange(len(sample))
    else:
        rank_in_sample = name
    rank = np.zeros(n + 4, np.int64)  # from 1; 0 beyond the end
    rank[sample] = rank_in_sample + 1
    sampled = sample[np.argsort(rank_in_sample)]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.lexsort((rank[zeros + 1], s[zeros]))]
    return merged(s, rank, sampled, zeros)


def merged(s: np.ndarray, rank: np.ndarray, sampled: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Both kinds are in order; a sampled suffix of place 1 compares with one of place 0 after one symbol, one of place 2 after two.

    Where each suffix of place 0 goes among those of either sampled class is found by bisection over packed keys.
    """
    before = np.zeros(len(zeros), np.int64)
    for residue, depth in ((1, 1), (2, 2)):
        own = sampled[sampled % 3 == residue]
        if not len(own):
            continue
        both = np.concatenate([own, zeros])
        keys = [s[both + k] for k in range(depth)] + [rank[both + depth]]
        joint, _ = ranks_of(*keys)
        before += np.searchsorted(joint[: len(own)], joint[len(own) :], "left")
    out = np.empty(len(sampled) + len(zeros), np.int64)
    at = before + np.arange(len(zeros))
    out[at] = zeros
    free = np.ones(len(out), bool)
    free[at] = False
    out[free] = sampled
    return out


def repeats(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of length symbols at each place starts at another place too: adjacent suffixes with equal prefixes. False where fewer symbols are left."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < length or length < 1:
        return out
    order = suffix_array(text)
    common = adjacent(text, order, length)
    long = common >= length
    out[order[1:][long]] = True
    out[order[:-1][long]] = True
    return out


def adjacent(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many symbols each suffix has in common with the next in order, up to most; whole columns at a time, dropping pairs that differ."""
    a, b = order[:-1], order[1:]
    n, out = len(text), np.zeros(max(0, len(order) - 1), np.int64)
    padded = np.concatenate([text, np.full(most + 1, -1, text.dtype)])
    left = np.flatnonzero(np.maximum(a, b) + most <= n)  # the others are too short to count
    for k in range(most):
        left = left[padded[a[left] + k] == padded[b[left] + k]]
        if not len(left):
            break
        out[left] = k + 1
    return out
