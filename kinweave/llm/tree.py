"""Softmaxes over a tree of token classes, with hashed features: the numpy side of the language model.

Every token is a leaf of a tree in which a node has up to FAN children; its chance given a context is the product of
the softmaxes on its path. Frequent tokens are split by their counts, so that a path is about as long as the logarithm of how rare the token is. All
other tokens share one more leaf, below which a complete tree tells apart classes that a token's hash gives.
"""

from __future__ import annotations

import numpy as np

from ._common import U64, mix64

#: Children of a node.
FAN = 8
#: Levels below the rare tokens' leaf at most.
DEEPEST = 6
RATE = 0.5
#: Rows of the table of weights that a shard's features are hashed to, as a power of two, and events that are looked at together.
TABLE, CHUNK = 18, 1 << 15
_SALTS = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3))
_NODE, _SPREAD = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_ABSENT = np.float32(-1e9)


def depth_for(rare: int) -> int:
    """Levels below the rare tokens' leaf: a class for each rare token, as far as DEEPEST goes."""
    depth = 1
    while depth < DEEPEST and FAN**depth < rare:
        depth += 1
    return depth


def rare_class(hashes: np.ndarray, depth: int) -> np.ndarray:
    return (mix64(hashes ^ U64(0x1D8E4E27C47D124F)) >> U64(64 - 3 * depth)).astype(np.int64)


class Tree:
    """Leaf i is the i-th frequent token, or from len(counts) on a class of rare tokens."""

    def __init__(self, counts: np.ndarray, rare: np.ndarray):
        """counts: of the frequent tokens, falling; rare: the mass of each class of rare tokens, a power of FAN many."""
        k, depth = len(counts), 0
        while FAN**depth < len(rare):
            depth += 1
        at = int(np.searchsorted(-counts, -rare.sum()))  # where all rare tokens stand among the frequent ones
        mass = np.insert(counts.astype(float), at, rare.sum())
        parent, child, up, turn, prior = _split(mass)
        leaf, leaf_child = np.delete(parent, at), np.delete(child, at)
        above, own = int(parent[at]), int(child[at])
        for level in range(depth):
            share = rare.reshape(FAN**level, FAN, -1).sum(axis=2)
            node = np.arange(FAN**level)
            first = len(up)
            up = np.concatenate([up, [above] if level == 0 else before + node // FAN])
            turn = np.concatenate([turn, [own] if level == 0 else node % FAN])
            prior = np.concatenate([prior, np.log(share / share.sum(axis=1, keepdims=True))])
            before = first
        ends = np.arange(len(rare))
        self.leaf = np.concatenate([leaf, before + ends // FAN]).astype(np.int32)
        self.leaf_child = np.concatenate([leaf_child, ends % FAN]).astype(np.int8)
        self.up, self.turn, self.prior = up.astype(np.int32), turn.astype(np.int8), prior.astype(np.float32)
        self.frequent = k

    def steps(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each node on the paths of the leaves: which leaf, the node and the child that is taken. Lower nodes come first."""
        at, node, child, out = np.arange(len(leaves)), self.leaf[leaves], self.leaf_child[leaves], []
        while len(at):
            out.append((at, node, child))
            above = self.up[node]
            go = np.flatnonzero(above >= 0)
            at, node, child = at[go], above[go], self.turn[node[go]]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int8))


def _split(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parent and child number of each leaf, of each node (-1: the root), and the logarithms of the shares of a node's children.

    A node's range of leaves is cut where its mass passes the eighths, each part holding one leaf at least.
    """
    total = np.r_[0.0, np.cumsum(mass)]
    parent, child = np.empty(len(mass), dtype=np.int64), np.empty(len(mass), dtype=np.int64)
    up, turn, prior, waiting = [], [], [], [(0, len(mass), -1, 0)]
    while waiting:
        lo, hi, above, own = waiting.pop()
        me = len(up)
        up.append(above)
        turn.append(own)
        if hi - lo <= FAN:
            cuts = np.arange(lo, hi + 1)
        else:
            cuts = np.searchsorted(total, total[lo] + (total[hi] - total[lo]) * np.arange(1, FAN) / FAN)
            least = lo + np.arange(1, FAN)
            cuts = np.r_[lo, np.minimum(np.maximum.accumulate(np.maximum(cuts, least) - np.arange(FAN - 1)) + np.arange(FAN - 1), hi - FAN + np.arange(1, FAN)), hi]
        row = np.full(FAN, _ABSENT)
        row[: len(cuts) - 1] = np.log((total[cuts[1:]] - total[cuts[:-1]]) / (total[hi] - total[lo]))
        prior.append(row)
        for j, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b - a == 1:
                parent[a], child[a] = me, j
            else:
                waiting.append((a, b, me, j))
    return parent, child, np.array(up), np.array(turn), np.array(prior).reshape(-1, FAN)


def equal_events(one: np.ndarray, two: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct event first is, and which of them each event is."""
    own, last = one.astype(U64) << U64(32) | two.astype(U64), leaves.astype(U64)
    bits = max((int(x.max()).bit_length() for x in (one, two, leaves)), default=0) if len(one) else 0
    if bits <= 21:  # all three fit into 64 bits
        own = (one.astype(U64) << U64(bits) | two.astype(U64)) << U64(bits) | last
    else:
        own = np.unique(own, return_inverse=True)[1].astype(U64) << U64(32) | last
    return np.unique(own, return_index=True, return_inverse=True)[1:]


def train_and_score(tree: Tree, one: np.ndarray, two: np.ndarray, leaves: np.ndarray, fits: np.ndarray, rounds: int, table: int = TABLE) -> np.ndarray:
    """Natural logarithms of the chances of the leaves, given the codes of the previous token and the one before it.

    Weights start at 0, where the chances are the leaves' shares. Each of the `rounds` takes its part of the events that `fits` selects, sums the
    slope of their log chance over the features (previous token, token before it and both, each with a node) and makes an AdaGrad step.
    Equal events are worked once, and their slope counts as often as `fits` selects them.
    """
    first, back = equal_events(one, two, leaves)
    times = np.bincount(back, fits, len(first)).astype(np.float32)
    one, two, leaves = one[first].astype(U64), two[first].astype(U64), leaves[first]
    features = (mix64(one ^ _SALTS[0]), mix64(two ^ _SALTS[1]), mix64((one << U64(32) | two) ^ _SALTS[2]))
    # by the event itself, so that the order of arrival doesn't matter
    turn = (mix64(features[2] + leaves.astype(U64)) % U64(max(1, rounds))).astype(np.int16)
    turn[times == 0] = rounds
    order = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[order], np.arange(rounds + 1))
    weights, seen = np.zeros((1 << table, FAN), dtype=np.float32), np.ones((1 << table, FAN), dtype=np.float32)
    shift = U64(64 - table)

    ones = np.ones(FAN, dtype=np.float32)

    def look(x: np.ndarray) -> tuple:
        """Steps of the events x with the rows of their features and exp of the children's weights, which 3 * rounds * RATE bounds."""
        at, node, child = tree.steps(leaves[x])
        salt = (node.astype(U64) + U64(1)) * _NODE
        rows = [((f[x][at] + salt) * _SPREAD >> shift).astype(np.int64) for f in features]
        z = tree.prior.take(node, axis=0)
        for s in rows:
            z += weights.take(s, axis=0)
        taken = z[np.arange(len(z)), child]
        return at, child, rows, np.exp(z, out=z), taken

    for r in range(rounds):
        own = order[cuts[r] : cuts[r + 1]]
        if not len(own):
            continue
        slope = np.zeros(weights.shape[::-1], dtype=np.float32)
        for lo in range(0, len(own), CHUNK):
            at, child, rows, z, _ = look(own[lo : lo + CHUNK])
            z /= -(z @ ones)[:, None]
            z[np.arange(len(z)), child] += 1
            z *= times[own[lo : lo + CHUNK]][at][:, None]
            places = np.concatenate(rows)
            for j in range(FAN):  # by children, so that the sums stay in the cache
                slope[j] += np.bincount(places, np.tile(z[:, j], len(rows)), len(weights))
        slope = np.ascontiguousarray(slope.T)
        seen += slope * slope
        slope /= np.sqrt(seen)
        slope *= np.float32(RATE)
        weights += slope
    out = np.empty(len(leaves))
    for lo in range(0, len(leaves), CHUNK):
        x = np.arange(lo, min(len(leaves), lo + CHUNK))
        at, _, _, z, taken = look(x)
        out[x] = np.bincount(at, taken - np.log(z @ ones), len(x))
    return out[back]
