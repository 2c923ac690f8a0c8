"""A tree of byte contexts, walked for all bytes of a batch of texts at once.

The byte models of this subpackage (prediction by partial matching, context-tree
weighting, Markov models of URLs) differ in how they turn counts into
probabilities, not in how contexts are counted, kept and looked up.

A context of length d is the d bytes before a byte, the nearest in the lowest
place of its number. What is before a text's start is ``EDGE``, a byte that
UTF-8 never has. A *gram* is a context of the full depth and the byte after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EDGE = 0xFF
#: Bytes of text that are looked at together.
TOGETHER = 1 << 20


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def grams(texts: list[bytes], depth: int, end: bool) -> np.ndarray:
    """The grams of some texts, each as one number; ``end``: the edge is a byte of the text too."""
    flat, starts = joined(texts, depth, end)
    code = np.zeros(len(flat) - depth, np.int64)
    for d in range(depth, -1, -1):
        code = (code << 8) | flat[depth - d : len(flat) - d]
    return np.concatenate([code[a : a + n] for a, n in starts]) if starts else code[:0]


def joined(texts: list[bytes], depth: int, end: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The texts in one array, ``depth`` edges before each; where each starts less ``depth``, and its length."""
    edges, last = bytes([EDGE]) * depth, bytes([EDGE]) * end
    starts, at = [], 0
    for t in texts:
        n = len(t) + end
        starts.append((at, n))
        at += depth + n
    flat = np.frombuffer(b"".join(x for t in texts for x in (edges, t, last)), np.uint8)
    return flat, starts


def counted(texts: list[bytes], depth: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how often each occurs."""
    return np.unique(grams(texts, depth, end), return_counts=True)


def coded(texts: list[bytes], depth: int, end: bool) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """The number of a first text, how many grams it and the next ones have, and the grams; a long text comes in several parts."""
    start = 0
    while start < len(texts):
        stop, size = start + 1, len(texts[start])
        while stop < len(texts) and size + len(texts[stop]) <= TOGETHER:
            size += len(texts[stop])
            stop += 1
        if size <= TOGETHER:
            yield start, [len(t) + end for t in texts[start:stop]], grams(texts[start:stop], depth, end)
        else:
            text = texts[start]
            for a in range(0, len(text), TOGETHER):
                before = text[max(0, a - depth) : a]
                found = grams([before + text[a : a + TOGETHER]], depth, end and a + TOGETHER >= len(text))[len(before) :]
                yield start, [len(found)], found
        start = stop


class Finder:
    """Where numbers are in an array of distinct ones, by tables of hashes; what two tables leave out is searched."""

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.tables = numbers, []
        left = np.arange(len(numbers), dtype=np.int32)
        for factor in self.FACTORS:
            bits = max(4, int(len(left)).bit_length() + 2)
            slots = np.zeros(1 << bits, np.int32)
            at = self._slot(numbers[left], factor, bits)
            slots[at] = left
            self.tables.append((factor, bits, slots))
            left = left[slots[at] != left]
        order = np.argsort(numbers[left])
        self.left, self.sorted = left[order], numbers[left][order]

    @staticmethod
    def _slot(numbers: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return ((numbers.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, looked: np.ndarray) -> np.ndarray:
        """Of numbers that are all there."""
        out = self.tables[0][2][self._slot(looked, *self.tables[0][:2])]
        for factor, bits, slots in self.tables[1:]:
            miss = np.flatnonzero(self.numbers[out] != looked)
            out[miss] = slots[self._slot(looked[miss], factor, bits)]
        miss = np.flatnonzero(self.numbers[out] != looked)
        out[miss] = self.left[np.searchsorted(self.sorted, looked[miss])]
        return out


class Tree:
    """``kept``: for each length from 1 the sorted numbers of the contexts that have a node.

    A context with a node must have its shorter ones kept, too. Node 0 is the
    empty context. Each node above the greatest depth has, besides the children
    that are kept, one for the rest: the bytes that have no child of their own.
    """

    def __init__(self, kept: list[np.ndarray]):
        self.depth = len(kept)
        self.kept = [np.zeros(1, np.int64), *(np.asarray(k, np.int64) for k in kept)]
        sizes = [len(k) for k in self.kept]
        self.first = np.cumsum([0, *sizes])  # of the nodes of each depth; after them the rests
        inner = self.first[self.depth]
        self.nodes = int(self.first[-1] + inner)
        self.rest = np.arange(inner) + self.first[-1]
        self.parent = np.zeros(self.nodes, np.int64)
        self.parent[self.rest] = np.arange(inner)
        step = np.arange(self.nodes, dtype=np.int32)[:, None].repeat(256, 1)
        step[:inner] = self.rest[:, None]
        for d in range(1, self.depth + 1):
            ids = self.first[d] + np.arange(sizes[d])
            shorter = self.find(d - 1, self.kept[d] & ((1 << 8 * (d - 1)) - 1))
            self.parent[ids] = shorter
            step[shorter, self.kept[d] >> 8 * (d - 1)] = ids
        self.step = step.ravel()

    def find(self, d: int, contexts: np.ndarray) -> np.ndarray:
        """The node of each context of length d, -1 if it has none."""
        if not len(self.kept[d]):
            return np.full(len(contexts), -1)
        k = np.minimum(np.searchsorted(self.kept[d], contexts), len(self.kept[d]) - 1)
        return np.where(self.kept[d][k] == contexts, self.first[d] + k, -1)

    def nodes_of(self, d: int) -> slice:
        return slice(int(self.first[d]), int(self.first[d + 1]))

    def counts(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How often each byte follows each node's context, from counts of grams; without the rests."""
        out = np.zeros((int(self.first[-1]), 256))
        for d in range(self.depth + 1):
            node = self.find(d, (grams >> 8) & ((1 << 8 * d) - 1))
            there = node >= 0
            out += np.bincount(node[there] * 256 + (grams[there] & 255), weights=n[there], minlength=out.size).reshape(out.shape)
        return out

    def cells(self, texts: list[bytes], end: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """For each byte (node, byte) as one number, and where each text's are."""
        flat, starts = joined(texts, self.depth, end)
        flat, n = flat.astype(np.int32), len(flat) - self.depth
        at = np.zeros(max(n, 0), np.int32)
        for d in range(1, self.depth + 1):
            at = self.step[(at << 8) | flat[self.depth - d : self.depth - d + n]]
        return (at << 8) | flat[self.depth :], starts

    def summed(self, texts: list[bytes], cost: np.ndarray, end: bool) -> np.ndarray:
        """The sum of ``cost[node * 256 + byte]`` over the bytes of each text; cost may have columns."""
        out = np.zeros((len(texts), *cost.shape[1:]))
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= TOGETHER:
                size += len(texts[stop])
                stop += 1
            if size > TOGETHER:
                out[start] = self._long(texts[start], cost, end)
            else:
                cells, starts = self.cells(texts[start:stop], end)
                found = np.concatenate([cost[cells], np.zeros((1, *cost.shape[1:]), cost.dtype)])  # a last row, so that each text's start is one
                edges = np.array([x for a, n in starts for x in (a, a + n)])
                sums = np.add.reduceat(found, np.minimum(edges, len(found) - 1), axis=0, dtype=np.float64)[::2]
                empty = np.array([n == 0 for _, n in starts])
                sums[empty] = 0
                out[start:stop] = sums
            start = stop
        return out

    def _long(self, text: bytes, cost: np.ndarray, end: bool) -> np.ndarray:
        """For one text that is longer than what is looked at together."""
        total = np.zeros(cost.shape[1:])
        for a in range(0, len(text), TOGETHER):
            last = a + TOGETHER >= len(text)
            before = text[max(0, a - self.depth) : a]
            cells, _ = self.cells([before + text[a : a + TOGETHER]], end and last)
            total = total + cost[cells[len(before) :]].sum(axis=0, dtype=np.float64)
        return total


def kept_contexts(sums: list[tuple[np.ndarray, np.ndarray]], share: float) -> list[np.ndarray]:
    """Of each depth the contexts (with their weights, which sum to one) of at least the given share."""
    return [np.sort(c[w >= share]) for c, w in sums]


def context_sums(grams: np.ndarray, weight: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to ``depth`` the contexts and the sum of their grams' weights."""
    out = []
    for d in range(1, depth + 1):
        c, at = np.unique((grams >> 8) & ((1 << 8 * d) - 1), return_inverse=True)
        out.append((c, np.bincount(at, weights=weight, minlength=len(c))))
    return out
