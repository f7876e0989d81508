"""M8 at scale: the forests of many fits grown side by side, node for node those of Spark ML's RandomForestClassifier.

Spark ML deals the rows over the tasks, so every task holds statistics of all nodes of all trees and each level shuffles them;
a row that meets a feature of few categories is counted for every subset of them.  Here a task has some trees of a fit, and
all rows of the fit stream past it in blocks: nothing but best splits leaves it, and a category is counted once, the subsets
are put together afterwards.  All fits take a pass at a time, as the features of a node are drawn in the order in which Spark ML
takes the nodes of all trees.

What a forest depends on is drawn and computed as there: sample of rows and thresholds (``RandomForest.findSplits``), Poisson counts of
each row (``BaggedPoint``, per partition), features of a node (``selectNodesToSplit``), gains and ties (``binsToBestSplit``),
merged leaves (``LearningNode.toNode``) and votes.  Entropies that decide between close splits use Java's logarithm.
Memory of a task: a block of rows and the counts of one level of its trees.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES_A_TASK = 24   # each task reads the rows of its fit once per pass for so many trees at most
BLOCK = 16384       # rows dealt and counted together
EPSILON = 2.0 ** -52
M32, M48, M64 = (1 << 32) - 1, (1 << 48) - 1, (1 << 64) - 1


# --- random numbers, as drawn by the JVM ---------------------------------------
def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


class JavaRandom:
    """java.util.Random."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & M48

    def _int(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & M48
        return _signed(self.state >> 16, 32)

    def next_long(self) -> int:
        high = self._int() << 32
        return _signed((high + self._int()) & M64, 64)


def _murmur3(data: bytes, seed: int) -> int:
    h = seed
    for k in struct.unpack(f"<{len(data) // 4}I", data):
        k = k * 0xCC9E2D51 & M32
        k = ((k << 15 | k >> 17) & M32) * 0x1B873593 & M32
        h ^= k
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & M32
    return h ^ h >> 16


class XorShift:
    """Spark's XORShiftRandom."""

    def __init__(self, seed: int):
        data = struct.pack(">q", seed)
        low = _murmur3(data, 0x3C074A61)
        self.state = _murmur3(data, low) << 32 | low

    def _bits(self, n: int) -> int:
        self.state = _shifted(self.state)
        return self.state & ((1 << n) - 1)

    def next_int(self) -> int:
        return _signed(self._bits(32), 32)

    def next_double(self) -> float:
        high = self._bits(26) << 27
        return (high + self._bits(27)) * 2.0 ** -53


def _shifted(x):
    """The state after ``x``: a number, or an array of unsigned 64 bits."""
    x ^= x << 21 & M64
    x ^= x >> 35
    x ^= x << 4 & M64
    return x


def reservoirs(n: int, k: int, seeds: list[int]) -> list[list[int]]:
    """For each seed k of the numbers below n (SamplingUtils.reservoirSampleAndCount)."""
    state = np.array([XorShift(seed).state for seed in seeds], dtype=np.uint64)
    kept = np.tile(np.arange(k), (len(seeds), 1))
    for item in range(k, n):
        state = _shifted(state)
        high = (state & ((1 << 26) - 1)) << 27
        state = _shifted(state)
        at = ((high + (state & ((1 << 27) - 1))).astype(float) * 2.0 ** -53 * (item + 1)).astype(np.int64)
        taken = np.flatnonzero(at < k)
        kept[taken, at[taken]] = item
    return kept.tolist()


@cache
def _powers() -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(d, images of the low and of the high 16 bits) of the generator's step on its last word, applied d = 1, 2, 4 .. 64 times."""
    out, d = [], 1
    words = [np.arange(65536, dtype=np.uint32), np.arange(65536, dtype=np.uint32) << np.uint32(16)]
    done = 0
    while d < 70:
        while done < d:
            words = [_step(x) for x in words]
            done += 1
        out.append((d, *words))
        d *= 2
    return out


def _step(x: np.ndarray) -> np.ndarray:
    b = x ^ (x << np.uint32(25))
    return (b << np.uint32(9)) ^ (b >> np.uint32(21))


class Bag:
    """Counts of Poisson(1) as BaggedPoint draws them for a partition: commons-math's PoissonDistribution over Well19937c.

    A word of the generator is the sum (xor) of images of the word before and of words at least 70 back.  So 70 are made at once, and the
    images of the words before are added by doubling.
    """

    CHUNK = 70 * 300

    def __init__(self, seed: int):
        v = [seed >> 32 & M32, seed & M32]
        for i in range(2, 624):
            x = _signed(v[i - 2], 32)
            v.append((1812433253 * (x ^ (x >> 30)) + i) & M32)
        self.past = np.array(v[:0:-1], dtype=np.uint32)   # oldest first
        self.last = np.array(v[:1], dtype=np.uint32)
        self.rest = np.empty(0)
        self.counts, self.first = np.empty(0, np.uint8), 0   # counts from position ``first`` on

    def _words(self) -> np.ndarray:
        n, u = self.CHUNK, np.uint32
        y, x = np.empty(623 + n, np.uint32), np.empty(n + 1, np.uint32)
        y[:623], x[:1] = self.past, self.last
        powers = _powers()
        top, low, s1, s9, s21, s25, s27 = u(0x80000000), u(0x7FFFFFFF), u(1), u(9), u(21), u(25), u(27)
        for s in range(0, n, 70):
            m1, m3 = y[s + 553:s + 623], y[s + 174:s + 244]
            z1 = m1 ^ (m1 >> s27)
            z2 = (y[s + 444:s + 514] >> s9) ^ m3 ^ (m3 >> s1)
            z3 = z1 ^ z2
            c = (y[s:s + 70] & top) ^ (y[s + 1:s + 71] & low) ^ (z1 << s9) ^ (z2 << s21) ^ (z3 >> s21)
            c[:1] ^= _step(x[s:s + 1])
            half = c.view(np.uint16)
            for d, images_low, images_high in powers:
                e = 140 - 2 * d
                add = images_low.take(half[0:e:2])
                add ^= images_high.take(half[1:e:2])
                c[d:] ^= add
            x[s + 1:s + 71] = c
            before = x[s:s + 70]
            z3 ^= before
            z3 ^= before << s25
            y[s + 623:s + 693] = z3
        self.past, self.last = y[n:].copy(), x[n:].copy()
        out = x[1:]
        out = out ^ ((out << u(7)) & u(0xE46E1700))
        return out ^ ((out << u(15)) & u(0x9B868000))

    def _more(self) -> np.ndarray:
        w = (self._words() >> np.uint32(6)).astype(np.int64)
        r = np.concatenate([self.rest, ((w[0::2] << 26) | w[1::2]) * 2.0 ** -52])
        least = math.exp(-1.0)
        # How many numbers a count takes that starts at a place; 0: more than there are.
        length = np.ones(len(r), np.uint8)
        at = np.flatnonzero(r >= least)
        product, k = r[at], 1
        while at.size:
            inside = at + k < len(r)
            length[at[~inside]] = 0
            at, product = at[inside], product[inside]
            product = product * r[at + k]
            k += 1
            length[at] = k
            on = product >= least
            at, product = at[on], product[on]
        steps, found, j = length.tobytes(), bytearray(), 0
        while j < len(steps) and steps[j]:
            found.append(steps[j] - 1)
            j += steps[j]
        self.rest = r[j:]
        return np.frombuffer(bytes(found), np.uint8)

    def take(self, start: int, n: int) -> np.ndarray:
        missing, more = start + n - self.first - len(self.counts), []
        while missing > 0:
            more.append(self._more())
            missing -= len(more[-1])
        if more:
            self.counts = np.concatenate([self.counts, *more])
        return self.counts[start - self.first:start - self.first + n]

    def forget(self, before: int) -> None:
        self.counts = self.counts[before - self.first:].copy()
        self.first = before


# --- bins ------------------------------------------------------------------------
def thresholds(values: np.ndarray, counts: np.ndarray, expected: float, splits: int) -> list[float]:
    """RandomForest.findSplitsForContinuousFeature: ``values`` other than 0 and how often each is in the sample, ``expected``
    rows of the sample; at most ``splits`` places."""
    if not len(values):
        return []
    weights, total = dict(zip(values.tolist(), counts.astype(float).tolist(), strict=True)), float(counts.sum())
    if expected - total > EPSILON * int(counts.sum()) * 100:
        weights[0.0] = expected - total
    pairs = sorted(weights.items())
    possible = len(pairs) - 1
    if possible <= splits:
        return [(a + b) / 2.0 for (a, _), (b, _) in zip(pairs, pairs[1:])]
    stride = expected / (splits + 1)
    found, seen, target = [], pairs[0][1], stride
    for (a, _), (b, n) in zip(pairs, pairs[1:]):
        before, seen = seen, seen + n
        if abs(before - target) < abs(seen - target):
            found.append((a + b) / 2.0)
            target += stride
    return found


@dataclass(frozen=True)
class Shape:
    """What Spark ML's DecisionTreeMetadata says of the rows of a fold's fits."""
    classes: int
    arity: dict[int, int]       # categorical features
    rows: int
    bins: tuple[int, ...]       # as Spark ML counts them: memory of a node
    unordered: frozenset[int]
    thresholds: tuple[np.ndarray | None, ...]

    @property
    def codes(self) -> list[int]:
        """Codes of each feature: bins of a continuous one, values of a categorical one."""
        return [self.arity[f] if f in self.arity else len(t) + 1 for f, t in enumerate(self.thresholds)]


def shape_of(n_features: int, classes: int, arity: dict[int, int], rows: int, max_bins: int, cuts: dict[int, list[float]]) -> Shape:
    most = min(max_bins, rows)
    small = math.floor(math.log(most // 2 + 1) / math.log(2.0) + 1)
    unordered = frozenset(f for f, k in arity.items() if classes > 2 and 1 < k <= small)
    bins = []
    for f in range(n_features):
        if f in unordered:
            bins.append((1 << arity[f] - 1) - 1)
        elif f in arity:
            bins.append(arity[f] if arity[f] > 1 else most)
        else:
            bins.append(len(cuts.get(f, ())) + 1)
    places = tuple(None if f in arity else np.array(cuts.get(f, ()), dtype=float) for f in range(n_features))
    return Shape(classes, arity, rows, tuple(bins), unordered, places)


def codes_of(shape: Shape, values: np.ndarray) -> np.ndarray:
    """(features, rows): the bin or category of each value."""
    out = np.empty(values.shape[::-1], np.uint16)
    for f, places in enumerate(shape.thresholds):
        out[f] = values[:, f] if places is None else np.searchsorted(places, values[:, f], side="left")
    return out


# --- splits ------------------------------------------------------------------------
def java_log(x: np.ndarray) -> np.ndarray:
    """Java's logarithm (fdlibm) of normal numbers, bit for bit; numpy's differs in the last bit for some."""
    high = (x.view(np.int64) >> 32).astype(np.int64)
    k = (high >> 20) - 1023
    high &= 0xFFFFF
    i = (high + 0x95F64) & 0x100000
    x = ((x.view(np.int64) & M32) | ((high | (i ^ 0x3FF00000)) << 32)).view(np.float64)
    k = (k + (i >> 20)).astype(float)
    ln2_high, ln2_low = 6.93147180369123816490e-01, 1.90821492927058770002e-10
    f = x - 1.0
    s = f / (2.0 + f)
    z = s * s
    w = z * z
    t1 = w * (3.999999999940941908e-01 + w * (2.222219843214978396e-01 + w * 1.531383769920937332e-01))
    t2 = z * (6.666666666666735130e-01 + w * (2.857142874366239149e-01 + w * (1.818357216161805012e-01 + w * 1.479819860511658591e-01)))
    r = t2 + t1
    half = 0.5 * f * f
    # With k = 0 the terms of k are nothing, and the rest is rounded in the same places: f - x equals 0 - (x - f).
    one = k * ln2_high - ((half - (s * (half + r) + k * ln2_low)) - f)
    two = k * ln2_high - ((s * (f - r) - k * ln2_low) - f)
    out = np.where(((high - 0x6147A) | (0x6B851 - high)) > 0, one, two)
    near = (0xFFFFF & (2 + high)) < 3
    if not near.any():
        return out
    r = f * f * (0.5 - 0.33333333333333333 * f)
    flat = np.where(f == 0, k * ln2_high + k * ln2_low, np.where(k == 0, f - r, k * ln2_high - ((r - k * ln2_low) - f)))
    return np.where(near, flat, out)


LOG_2 = float(java_log(np.array([2.0]))[0])


def entropy(counts: np.ndarray) -> np.ndarray:
    """Entropy of each row of class counts, by the same operations in the same order as Spark ML's Entropy."""
    total = counts.sum(axis=-1)
    freq = counts / np.where(total == 0, 1.0, total)[..., None]
    some = freq > 0
    terms = np.where(some, freq * (java_log(np.where(some, freq, 1.0)) / LOG_2), 0.0)
    return np.subtract.reduce(np.concatenate([np.zeros((*counts.shape[:-1], 1)), terms], axis=-1), axis=-1)


CLOSE = 1e-9   # bits of gain that rounding is far below of


def _xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1.0))


@cache
def subsets(k: int) -> np.ndarray:
    """The left categories of each split of k unordered ones, a row per split."""
    return ((np.arange(1, 1 << k - 1)[:, None] >> np.arange(k)) & 1).astype(float)


def close_splits(counts: np.ndarray, feature: int, shape: Shape, whole: np.ndarray) -> tuple[float, list] | None:
    """(score, splits) of a feature's splits that leave rows on both sides and whose gain may be the greatest: their threshold's
    index or left categories and the class counts left, in order.  ``counts``: class counts by code.  The score is the gain but
    for constants of the node and rounding, times its rows."""
    if feature in shape.unordered:
        cats = subsets(shape.arity[feature])
        left = cats @ counts
        size = left.sum(axis=1)
        where = np.flatnonzero((size > 0) & (size < whole.sum()))
        left = left[where]
    else:
        where = np.flatnonzero(counts.any(axis=1))   # a split at a code without rows parts them as the split before it
        counts = counts[where]
        if feature in shape.arity:
            centroid = entropy(counts) if shape.classes > 2 else counts[:, 1]
            order = np.argsort(centroid, kind="stable")
            counts, where = counts[order], where[order]
        left = np.cumsum(counts, axis=0)[:-1]
    if not len(left):
        return None
    right = whole - left
    score = _xlogx(left).sum(axis=1) + _xlogx(right).sum(axis=1) - _xlogx(left.sum(axis=1)) - _xlogx(right.sum(axis=1))
    best = float(score.max())
    found = []
    for at in np.flatnonzero(score >= best - CLOSE * whole.sum()).tolist():
        if feature in shape.unordered:
            split = tuple(np.flatnonzero(cats[where[at]]).tolist())
        elif feature in shape.arity:
            split = tuple(where[:at + 1].tolist())
        else:
            split = int(where[at])
        found.append((split, left[at]))
    return best, found


def best_split(tables: list[tuple[int, np.ndarray]], shape: Shape) -> tuple:
    """(class counts, gain, feature, split, class counts left) of a node: the first split of greatest gain over its features in order;
    gain None if nothing can be split.  ``tables``: (feature, class counts by code)."""
    whole = tables[0][1].sum(axis=0)
    close = []
    if np.count_nonzero(whole) > 1:
        close = [(f, c) for f, table in tables if (c := close_splits(table, f, shape, whole))]
    if not close:
        return whole, None, None, None, None
    least = max(score for _, (score, _) in close) - CLOSE * whole.sum()
    splits = [(f, split, left) for f, (score, found) in close if score >= least for split, left in found]
    lefts = np.array([left for _, _, left in splits])
    rights = whole - lefts
    k, impurity = len(splits), entropy(np.concatenate([lefts, rights, whole[None]]))
    n_left, n_right = lefts.sum(axis=1), rights.sum(axis=1)
    gain = impurity[-1] - n_left / (n_left + n_right) * impurity[:k] - n_right / (n_left + n_right) * impurity[k:-1]
    at = int(np.argmax(gain))
    return whole, float(gain[at]), *splits[at]


# --- trees ------------------------------------------------------------------------
class Walk:
    """Where rows are in a tree: nodes by number (root 1, children 2i and 2i + 1), ``splits`` node -> (feature, threshold's index or
    left categories)."""

    def __init__(self, splits: dict[int, tuple], codes: int):
        self.levels, self.codes = max(splits, default=0).bit_length(), codes
        size = 1 << self.levels + 1
        self.feature = np.zeros(size, np.int64)
        # Node that follows a node by the code of its feature; rows in a leaf stay there.
        after = np.repeat(np.arange(size, dtype=np.int32)[:, None], codes, axis=1)
        order = np.arange(codes)
        for node, (f, split) in splits.items():
            self.feature[node] = f
            after[node] = 2 * node + 1
            after[node, order <= split if isinstance(split, int) else list(split)] = 2 * node
        self.after = after.ravel()

    def nodes(self, codes: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        """``codes``: (features, n) in one row."""
        at, column = np.ones(len(rows), np.int64), self.feature * n
        for _ in range(self.levels):
            here = column.take(at)
            here += rows
            at *= self.codes
            at += codes.take(here)
            at = self.after.take(at).astype(np.int64)
        return at


class Search:
    """Counts of the nodes of some trees that are split in a pass, and their best splits."""

    def __init__(self, shape: Shape, trees: dict[int, tuple[dict, list]]):
        """``trees``: number in the task -> (splits so far, [(node, features)])."""
        self.shape, self.trees, most = shape, {}, max(shape.codes)
        for t, (splits, active) in trees.items():
            walk = Walk(splits, most)
            slot = np.full(2 << max(walk.levels, *(n.bit_length() for n, _ in active)), -1, np.int64)
            slot[[n for n, _ in active]] = range(len(active))
            features = np.array([fs for _, fs in active], dtype=np.int64)
            sizes = np.array(shape.codes)[features] * shape.classes
            offsets = np.concatenate([[0], np.cumsum(sizes.ravel())])
            self.trees[t] = (active, walk, slot, features.T.copy(), offsets[:-1].reshape(features.shape).T.copy(),
                             np.zeros(offsets[-1], np.int32 if shape.rows < 1 << 30 else np.int64))

    def add(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        n = len(labels)
        small = np.uint16 if codes.max() < 65535 // self.shape.classes else np.int64
        both = (codes.astype(small) * small(self.shape.classes) + labels.astype(small)).ravel()
        codes = codes.ravel()
        for t, (_, walk, slot, features, offsets, counts) in self.trees.items():
            rows = np.flatnonzero(weights[t])
            at = slot.take(walk.nodes(codes, n, rows))
            on = at >= 0
            if not on.all():
                at, rows = at[on], rows[on]
            w = weights[t].take(rows).astype(counts.dtype)
            for column, offset in zip(features * n, offsets):
                where = column.take(at)
                where += rows
                place = offset.take(at)
                place += both.take(where)
                np.add.at(counts, place, w)

    def found(self) -> list[tuple]:
        """(tree, node, *best split)."""
        out, codes, classes = [], self.shape.codes, self.shape.classes
        for t, (active, _, _, _, offsets, counts) in self.trees.items():
            for k, (node, features) in enumerate(active):
                tables = [(f, counts[o:o + codes[f] * classes].reshape(codes[f], classes).astype(float)) for f, o in zip(features, offsets[:, k])]
                out.append((t, node, *best_split(tables, self.shape)))
        return out


def iteration_order(keys: list[int], shift: int = 0) -> list[int]:
    """The order in which a Scala Map (immutable, made from a mutable one) gives its small numbers."""
    if shift == 0 and len(keys) <= 4:
        return sorted(keys, key=lambda k: (k & 15, k))
    buckets: dict[int, list[int]] = {}
    for k in keys:
        buckets.setdefault(_improved(k) >> shift & 31, []).append(k)
    ordered = [b for _, b in sorted(buckets.items())]
    return [b[0] for b in ordered if len(b) == 1] + [k for b in ordered if len(b) > 1 for k in iteration_order(b, shift + 5)]


def _improved(k: int) -> int:
    h = k + ~(k << 9) & M32
    h ^= h >> 14
    h = h + (h << 4) & M32
    return h ^ h >> 10


class Forest:
    """One fit while it grows: the nodes to split, in Spark ML's order, and what is known of each tree."""

    def __init__(self, rf: RandomForestClassifier, shape: Shape, fold: int):
        self.shape, self.fold, self.n_trees, self.depth = shape, fold, rf.getNumTrees(), rf.getMaxDepth()
        self.memory = rf.getMaxMemoryInMB() << 20
        self.rng, self.n_features = JavaRandom(rf.getSeed()), len(shape.bins)
        self.a_node = math.ceil(math.sqrt(self.n_features))
        self.splits: list[dict[int, tuple]] = [{} for _ in range(self.n_trees)]
        self.counts: list[dict[int, np.ndarray]] = [{} for _ in range(self.n_trees)]
        self.stack = [(t, 1) for t in range(self.n_trees)]
        self.group: dict[int, list[tuple[int, list[int]]]] = {}

    def select(self) -> dict[int, list[tuple[int, list[int]]]]:
        """tree -> [(node, features)] of the next pass."""
        self.group, used, n = {}, 0, self.n_features
        states, seeds = [self.rng.state], []
        if self.a_node < n:
            for _ in self.stack:
                seeds.append(self.rng.next_long())
                states.append(self.rng.state)
        drawn = reservoirs(n, self.a_node, seeds) if seeds else [list(range(n))] * len(self.stack)
        for k, features in enumerate(drawn, 1):
            need = self.shape.classes * sum(self.shape.bins[f] for f in features) * 8
            if used and used + need > self.memory:
                self.rng.state = states[k] if seeds else states[0]   # the features of a node that has to wait are drawn again
                break
            t, node = self.stack.pop()
            self.group.setdefault(t, []).append((node, features))
            used += need
        return self.group

    def grow(self, found: dict[tuple[int, int], tuple]) -> None:
        for t in iteration_order(list(self.group)):
            for node, _ in self.group[t]:
                whole, gain, feature, split, left = found[t, node]
                self.counts[t][node] = whole
                if gain is None or gain <= 0 or node.bit_length() > self.depth:
                    continue
                self.splits[t][node] = (feature, split)
                for child, counts in ((2 * node, left), (2 * node + 1, whole - left)):
                    self.counts[t][child] = counts
                    if child.bit_length() <= self.depth and np.count_nonzero(counts) > 1:
                        self.stack.append((t, child))

    def trees(self) -> list[tuple[dict[int, tuple], dict[int, np.ndarray]]]:
        """(splits, class shares by leaf) of each tree; leaves under one node that predict the same class are one."""
        out = []
        for splits, counts in zip(self.splits, self.counts):
            kept = dict(splits)
            for node in sorted(splits, reverse=True):   # children before their parents
                a, b = 2 * node, 2 * node + 1
                if a not in kept and b not in kept and np.argmax(counts[a]) == np.argmax(counts[b]):
                    del kept[node]
            leaves = [c for n in kept for c in (2 * n, 2 * n + 1) if c not in kept] or [1]
            out.append((kept, {n: counts[n] / (counts[n].sum() or 1.0) for n in leaves}))
        return out


# --- Spark jobs ------------------------------------------------------------------
def _blocks(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(features, labels, folds, partition) of about BLOCK rows each, in the rows' order."""
    kept, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield _arrays(kept, n_features)
            kept, n = [], 0
    if kept:
        yield _arrays(kept, n_features)


def _arrays(batches: list[pa.RecordBatch], n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    t = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: t[name].combine_chunks()
    values = column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
    return values, column("label").to_numpy().astype(np.int64), column("fold").to_numpy(), t["part"][0].as_py()


DEALT = "task int, n int, codes binary, labels binary, weights binary"


def _deal(shapes: dict[int, Shape], tasks: list[tuple[int, int, int, int, int]], n_features: int, seed: int):
    """Rows of a partition -> for each task (number, fold, trees of the fit, its trees from and to) codes, labels and counts of its rows."""
    schema = pa.schema([("task", pa.int32()), ("n", pa.int32()), ("codes", pa.binary()), ("labels", pa.binary()), ("weights", pa.binary())])

    def run(batches):
        bag, seen = None, dict.fromkeys(shapes, 0)
        sizes = {(fold, n_trees) for _, fold, n_trees, _, _ in tasks}
        for values, labels, folds, part in _blocks(batches, n_features):
            bag = bag or Bag(seed + part + 1)
            for fold, shape in shapes.items():
                mine = folds != fold
                n = int(mine.sum())
                if not n:
                    continue
                codes, classes = codes_of(shape, values[mine]).tobytes(), labels[mine].astype(np.uint16).tobytes()
                for n_trees in sorted(t for f, t in sizes if f == fold):
                    weights = bag.take(seen[fold] * n_trees, n * n_trees).reshape(n, n_trees).T
                    for task, f, t, start, end in tasks:
                        if (f, t) == (fold, n_trees):
                            yield pa.RecordBatch.from_arrays([pa.array([x], type=c.type) for x, c in zip(
                                (task, n, codes, classes, weights[start:end].tobytes()), schema)], schema=schema)
                seen[fold] += n
            bag.forget(min(seen[f] * t for f, t in sizes))
    return run


def _search(plans, n_features: int):
    """Dealt rows -> the best splits of the nodes in a task's plan."""
    def run(batches):
        searches: dict[int, tuple[Search, int]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] not in plans.value:
                    continue
                if r["task"] not in searches:
                    shape, n_trees, trees = pickle.loads(plans.value[r["task"]])
                    searches[r["task"]] = Search(shape, trees), n_trees
                search, n_trees = searches[r["task"]]
                search.add(np.frombuffer(r["codes"], np.uint16).reshape(n_features, r["n"]), np.frombuffer(r["labels"], np.uint16),
                           np.frombuffer(r["weights"], np.uint8).reshape(n_trees, r["n"]))
        for task, (search, _) in searches.items():
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "found": pa.array([pickle.dumps(search.found())], pa.binary())})
    return run


def _judge(forests, n_features: int):
    """Rows -> (trees of the fit, fold, rows held out, rows predicted right)."""
    def run(batches):
        for values, labels, folds, _ in _blocks(batches, n_features):
            for fold in np.unique(folds).tolist():
                mine = folds == fold
                for n_trees, pickled in forests.value.get(fold, {}).items():
                    shape, trees = pickle.loads(pickled)
                    codes, n = codes_of(shape, values[mine]).ravel(), int(mine.sum())
                    rows, votes, most = np.arange(n), np.zeros((n, shape.classes)), max(shape.codes)
                    for splits, leaves in trees:
                        walk = Walk(splits, most)
                        shares = np.zeros((max(leaves) + 1, shape.classes))
                        shares[list(leaves)] = list(leaves.values())
                        votes += shares[walk.nodes(codes, n, rows)]
                    right = int((votes.argmax(axis=1) == labels[mine]).sum())
                    yield pa.RecordBatch.from_pydict({"num_trees": pa.array([n_trees], pa.int32()), "fold": pa.array([fold], pa.int32()),
                                                      "n": pa.array([n], pa.int64()), "n_right": pa.array([right], pa.int64())})
    return run


def _sampled(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """RDD.sample, as Spark ML samples the rows for thresholds."""
    spark = rows.sparkSession
    sample = rows._jdf.toJavaRDD().sample(False, fraction, seed)
    return DataFrame(spark._jsparkSession.createDataFrame(sample, rows._jdf.schema()), spark)


def _cuts(rows: DataFrame, sizes: dict[int, int], continuous: list[int], max_bins: int, seed: int) -> dict[int, dict[int, list[float]]]:
    """fold -> feature -> thresholds, from a sample of the rows outside the fold."""
    samples, expected, splits = [], {}, {}
    if not continuous:
        return {}
    for fold, n in sizes.items():
        most = min(max_bins, n)   # continuous features have as many bins
        need = max(most * most, 10000)
        fraction = need / n if need < n else 1.0
        outside = rows.where(F.col("fold") != fold).select("features")
        outside = outside if fraction == 1.0 else _sampled(outside, fraction, XorShift(seed).next_int())
        samples.append(outside.select(F.lit(fold).alias("fold"), F.posexplode(vector_to_array("features")).alias("feature", "value")))
        expected[fold], splits[fold] = fraction * float(n), most - 1
    every = samples[0]
    for s in samples[1:]:
        every = every.unionByName(s)
    counted = every.where(F.col("feature").isin(continuous) & (F.col("value") != 0)).groupBy("fold", "feature", "value").count()

    def places(key, pdf):
        import pandas as pd
        fold, feature = int(key[0]), int(key[1])
        found = thresholds(pdf["value"].to_numpy(), pdf["count"].to_numpy(), expected[fold], splits[fold])
        return pd.DataFrame({"fold": [fold], "feature": [feature], "places": [found]})
    out: dict[int, dict[int, list[float]]] = {fold: {} for fold in sizes}
    for r in counted.groupBy("fold", "feature").applyInPandas(places, "fold int, feature int, places array<double>").collect():
        out[r["fold"]][r["feature"]] = list(r["places"])
    return out


def _kinds(rows: DataFrame) -> tuple[int, dict[int, int], int]:
    """(features, number of values of each categorical one, classes), from what the indexers noted in the schema."""
    attributes = rows.schema["features"].metadata["ml_attr"]
    arity = {a["idx"]: len(a["vals"]) for a in attributes["attrs"].get("nominal", [])}
    return attributes["num_attrs"], arity, len(rows.schema["label"].metadata["ml_attr"].get("vals", []))


def _grown_here(rf: RandomForestClassifier) -> bool:
    return rf.getImpurity() == "entropy" and rf.getFeatureSubsetStrategy() == "sqrt" and rf.getBootstrap() and rf.getSubsamplingRate() == 1.0 \
        and rf.getMinInstancesPerNode() == 1 and rf.getMinInfoGain() == 0.0 and rf.getMinWeightFractionPerNode() == 0.0 \
        and not rf.isSet(rf.weightCol) and not rf.isSet(rf.thresholds)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(vector_to_array("features").alias("features"), "label", "fold", F.spark_partition_id().alias("part"))


def grow(rows: DataFrame, fits: list[tuple[RandomForestClassifier, int]]) -> list[Forest] | None:
    """The forest of each fit (estimator, fold left out) on ``rows`` (features, label, fold), which are cached: their partitions
    and order count for the draws.

    None where Spark ML has a case of its own (no rows, one class, more categories than bins, settings other than those grown
    here): the caller fits there.
    """
    spark = rows.sparkSession
    n_features, arity, classes = _kinds(rows)
    per_fold = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    folds = sorted({fold for _, fold in fits})
    sizes = {fold: sum(per_fold.values()) - per_fold.get(fold, 0) for fold in folds}
    one = fits[0][0] if fits else None
    if not fits or classes < 2 or not all(_grown_here(rf) for rf, _ in fits) or any(n == 0 or max(arity.values(), default=0) > min(one.getMaxBins(), n) for n in sizes.values()) \
            or any(k == 0 for k in arity.values()):
        return None
    seed, max_bins = one.getSeed(), one.getMaxBins()
    cuts = _cuts(rows, sizes, [f for f in range(n_features) if f not in arity], max_bins, seed)
    shapes = {fold: shape_of(n_features, classes, arity, sizes[fold], max_bins, cuts.get(fold, {})) for fold in folds}
    forests = [Forest(rf, shapes[fold], fold) for rf, fold in fits]
    tasks, owner = [], []
    for k, forest in enumerate(forests):
        parts = math.ceil(forest.n_trees / TREES_A_TASK)
        ends = [forest.n_trees * i // parts for i in range(parts + 1)]
        for start, end in zip(ends, ends[1:]):
            tasks.append((len(tasks), forest.fold, forest.n_trees, start, end))
            owner.append(k)
    dealt = _plain(rows).mapInArrow(_deal(shapes, tasks, n_features, seed), DEALT).repartitionById(len(tasks), F.col("task")) \
        .persist(StorageLevel.DISK_ONLY)
    try:
        while any(forest.stack for forest in forests):
            groups, plans = [forest.select() for forest in forests], {}
            for (task, fold, _, start, end), k in zip(tasks, owner):
                mine = {t - start: (forests[k].splits[t], groups[k][t]) for t in range(start, end) if t in groups[k]}
                if mine:
                    plans[task] = pickle.dumps((shapes[fold], end - start, mine))
            shared = spark.sparkContext.broadcast(plans)
            found: list[dict] = [{} for _ in forests]
            for r in dealt.mapInArrow(_search(shared, n_features), "task int, found binary").collect():
                start = tasks[r["task"]][3]
                found[owner[r["task"]]].update({(start + t, node): rest for t, node, *rest in pickle.loads(r["found"])})
            for forest, f in zip(forests, found):
                forest.grow(f)
            shared.destroy()
    finally:
        dealt.unpersist()
    return forests


def held_out(rows: DataFrame, forests: list[Forest]) -> list[tuple[int, int, int, int]]:
    """(trees, fold, rows held out, rows predicted right) of each forest."""
    n_features = len(forests[0].shape.bins)
    grown: dict[int, dict[int, bytes]] = {}
    for forest in forests:
        grown.setdefault(forest.fold, {})[forest.n_trees] = pickle.dumps((forest.shape, forest.trees()))
    shared = rows.sparkSession.sparkContext.broadcast(grown)
    judged = _plain(rows).mapInArrow(_judge(shared, n_features), "num_trees int, fold int, n long, n_right long").groupBy("num_trees", "fold") \
        .agg(F.sum("n").alias("n"), F.sum("n_right").alias("n_right")).collect()
    shared.destroy()
    right = {(r["num_trees"], r["fold"]): (r["n"], r["n_right"]) for r in judged}
    return [(forest.n_trees, forest.fold, *right.get((forest.n_trees, forest.fold), (0, 0))) for forest in forests]
