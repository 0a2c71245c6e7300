"""Context-tree weighting over bytes: Krichevsky-Trofimov estimates of all context depths, mixed by their evidence.

A byte is eight binary decisions; the bits already decided name a bit node (1 to 255). For each bit node there is a
tree of contexts: the root knows none of the bytes before, a node at depth d knows the last d. Every node counts
the zeros and ones seen in it, which give its KT probability; its weighted probability is half of that plus half of
the product over its children. After training, a bit is predicted along its path: each node mixes its own KT estimate with
its child's prediction by the share that the KT part has in the weighted probability. The deepest node that training has
seen speaks for itself alone, so that predictions stay probabilities in contexts never seen.

Only counts enter, and counts add up, so the trees are built from counts of (context, byte) in any order. All functions work
on sorted arrays of packed keys: a gram is its context with the nearest byte first, then the byte itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Contexts of up to so many bytes; a gram must fit 64 bits.
MAX_DEPTH = 7
#: The bit nodes of a byte are numbered 1 to 255; tables leave place 0 empty.
NODES = 256
_LOG_HALF, _LOG_PI = float(np.log(0.5)), float(np.log(np.pi))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0: Stirling's series eight steps further on."""
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    y = x + 8
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / y
    # Large x would overflow the product, and need no steps.
    large = x > 1e6
    z = np.where(large, x, y)
    series = np.where(large, 1 / (12 * z), series)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.where(large, 0.0, np.log(np.where(large, 1.0, product)))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT probability of a sequence with so many zeros and ones."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - _LOG_PI


def grams(text: np.ndarray, depth: int) -> np.ndarray:
    """The gram that ends at each byte of ``text`` from place ``depth`` on: context nearest byte first, then the byte."""
    n = len(text) - depth
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(1, depth + 1):
        key = (key << np.uint64(8)) | text[depth - i : depth - i + n]
    return (key << np.uint64(8)) | text[depth : depth + n]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[starts], *[np.add.reduceat(v[order], starts) for v in values])


def bit_steps(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each gram its eight decisions: (bit node before the context's bytes, bit), one row each."""
    shift = np.uint64(8 * depth)
    context, byte = keys >> np.uint64(8), keys & np.uint64(255)
    nodes = np.empty((8, len(keys)), np.uint64)
    bits = np.empty((8, len(keys)), bool)
    for j in range(8):
        nodes[j] = ((np.uint64(1 << j) | (byte >> np.uint64(8 - j))) << shift) | context
        bits[j] = (byte >> np.uint64(7 - j)) & np.uint64(1)
    return nodes, bits


@dataclass
class Level:
    """Nodes of one depth in the order of their keys: bit node, then context bytes from the nearest on."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_weighted: np.ndarray
    share: np.ndarray

    def one(self, at: np.ndarray) -> np.ndarray:
        """KT estimate of a one in the nodes."""
        return (self.ones[at] + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """The trees of these grams from depth ``top`` to ``depth``; grams that share ``top`` context bytes must all be among them."""
    seen = counts > 0
    nodes, bits = bit_steps(keys[seen], depth)
    times = np.broadcast_to(counts[seen].astype(np.int64), nodes.shape)
    key, zeros, ones = summed(nodes.ravel(), np.where(bits, 0, times).ravel(), np.where(bits, times, 0).ravel())
    weighted = log_kt(zeros, ones)
    found = [Level(key, zeros, ones, weighted, np.ones(len(key)))]
    for _ in range(depth - top):
        above = key >> np.uint64(8)
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(above) else np.zeros(0, np.int64)
        if len(above):
            zeros, ones, below = (np.add.reduceat(v, starts) for v in (zeros, ones, weighted))
        else:
            below = weighted
        key, own = above[starts], log_kt(zeros, ones)
        weighted = _LOG_HALF + np.logaddexp(own, below)
        found.append(Level(key, zeros, ones, weighted, np.exp(_LOG_HALF + own - weighted)))
    return found[::-1]


def path_ones(found: list[Level], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of a one, whether any node was seen) for deepest nodes, mixed over the levels at hand."""
    chance, known = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for up, level in enumerate(reversed(found)):
        key = nodes >> np.uint64(8 * up)
        at = np.minimum(np.searchsorted(level.keys, key), max(len(level.keys) - 1, 0))
        hit = level.keys[at] == key if len(level.keys) else np.zeros(len(key), bool)
        at, own = at[hit], level.one(at[hit])
        chance[hit] = np.where(known[hit], level.share[at] * own + (1 - level.share[at]) * chance[hit], own)
        known |= hit
    return chance, known


@dataclass
class Top:
    """Depths 0 and 1 for all bit nodes: 3 x 256 x 256 numbers at most.

    ``constant`` and ``factor``, by nearest byte and bit node, give the chance of a one as constant + factor * the chance from
    depth 2 on; ``short`` is the chance where nothing was seen at depth 2.
    """

    constant: np.ndarray
    factor: np.ndarray
    short: np.ndarray


def top_of(nearest: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Top:
    """From the sums over the depth-2 nodes of each (nearest byte, bit node): counts and log weighted probability."""
    a, b, deep = (np.zeros((NODES, NODES)) for _ in range(3))
    a[nearest, node], b[nearest, node], deep[nearest, node] = zeros, ones, below
    seen = a + b > 0
    own = log_kt(a, b)
    weighted = np.where(seen, _LOG_HALF + np.logaddexp(own, deep), 0.0)
    share1 = np.where(seen, np.exp(_LOG_HALF + own - weighted), 1.0)
    one1 = (b + 0.5) / (a + b + 1.0)
    a0, b0 = a.sum(axis=0), b.sum(axis=0)
    own0 = log_kt(a0, b0)
    share0 = np.exp(_LOG_HALF + own0 - (_LOG_HALF + np.logaddexp(own0, weighted.sum(axis=0))))
    one0 = (b0 + 0.5) / (a0 + b0 + 1.0)
    constant = share0 * one0 + (1 - share0) * share1 * one1
    factor = (1 - share0) * (1 - share1)
    return Top(constant, factor, np.where(seen, share0 * one0 + (1 - share0) * one1, one0))


def log10_grams(keys: np.ndarray, found: list[Level], top: Top, depth: int) -> np.ndarray:
    """log10 probability of each gram's byte in its context."""
    nodes, bits = bit_steps(keys, depth)
    total = np.zeros(len(keys))
    nearest = (keys >> np.uint64(8 * depth)).astype(np.int64)
    for j in range(8):
        chance, known = path_ones(found, nodes[j])
        node = (nodes[j] >> np.uint64(8 * depth)).astype(np.int64)
        one = np.where(known, top.constant[nearest, node] + top.factor[nearest, node] * chance, top.short[nearest, node])
        total += np.log10(np.where(bits[j], one, 1 - one))
    return total
