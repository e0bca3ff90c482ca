"""Signature trees over sets of hashed tokens, inside one task.

An entry is a set in a cell: only entries of one cell are to be paired, of two sides if the cell has
sides, and of two classes. A leaf holds the entry's bitmap (a bit for each hash value of its tokens), its size and
its excess (size less set bits). A node holds the OR of its entries' bitmaps, the range of their sizes, cells,
sides and classes, and their largest excess. Two sets share at most

    min(sizes, set bits that both have + the smaller excess)

tokens; the same with a node's largest values bounds every pair below two nodes. A pair of nodes is left out if
that is less than the overlap their smallest sizes ask for, or if no entries below them are to be paired.
Entries of one class (sets known to be connected) stand together, so their nodes' bitmaps stay sparse. Two
entries are also bounded by each set's tokens whose bits the other lacks. Bitmaps are as wide as their sets are
large; a wider one is folded to the other's width.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Two sets link when PART * shared >= WHOLE * (size + size), from 100 * shared >= 75 * union.
PART, WHOLE = 7, 3
FAN = 8


def bitmap(tokens: np.ndarray, times: int = 1) -> np.ndarray:
    """A bit for each value of the hashes' lowest bits: `times` to 2 * `times` bits a token, as a power of two, 64 to 2**15."""
    width = 1 << min(15, max(6, (times * len(tokens) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) as they would be with `words` * 64 bits."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
    return bitmaps


@dataclass
class Entries:
    """Arrays with an item for each entry; side is -1 in cells without sides."""

    cell: np.ndarray
    side: np.ndarray
    size: np.ndarray
    kind: np.ndarray

    def at(self, where: np.ndarray) -> Entries:
        return Entries(self.cell[where], self.side[where], self.size[where], self.kind[where])


class Level:
    """Nodes: bitmaps, and the least and largest values of what is below them."""

    def __init__(self, maps: np.ndarray, low: Entries, high: Entries, excess: np.ndarray):
        self.maps, self.low, self.high, self.excess = maps, low, high, excess

    def __len__(self) -> int:
        return len(self.excess)

    def above(self) -> Level:
        at = np.arange(0, len(self), FAN)
        of = lambda f, e: Entries(*(f.reduceat(x, at) for x in (e.cell, e.side, e.size, e.kind)))
        return Level(np.bitwise_or.reduceat(self.maps, at), of(np.minimum, self.low), of(np.maximum, self.high), np.maximum.reduceat(self.excess, at))


class Tree:
    """levels: from the entries, which should be in order of (cell, side, kind, size), up to a few nodes."""

    def __init__(self, maps: np.ndarray, entries: Entries):
        self.levels = [Level(maps, entries, entries, entries.size - np.bitwise_count(maps).sum(axis=1).astype(np.int64))]
        while len(self.levels[-1]) > FAN:
            self.levels.append(self.levels[-1].above())


def may_link(a: Level, b: Level, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs (i of a, j of b) can hold a linked pair that is to be found."""
    fits = (a.low.cell[i] <= b.high.cell[j]) & (b.low.cell[j] <= a.high.cell[i])
    one = lambda x, y, lo, hi: (lo(a)[x] == hi(a)[x]) & (lo(b)[y] == hi(b)[y]) & (lo(a)[x] == lo(b)[y])
    fits &= ~one(i, j, lambda t: t.low.kind, lambda t: t.high.kind)
    fits &= ~(one(i, j, lambda t: t.low.side, lambda t: t.high.side) & (a.low.side[i] >= 0))
    fits &= PART * np.minimum(a.high.size[i], b.high.size[j]) >= WHOLE * (a.low.size[i] + b.low.size[j])
    i, j = i[fits], j[fits]
    common = np.bitwise_count(a.maps[i] & b.maps[j]).sum(axis=1).astype(np.int64) + np.minimum(a.excess[i], b.excess[j])
    fits[fits] = PART * common >= WHOLE * (a.low.size[i] + b.low.size[j])
    return fits


def entries_may_link(maps_i: np.ndarray, maps_j: np.ndarray, n_i: np.ndarray, n_j: np.ndarray) -> np.ndarray:
    """The bound for two sets: tokens whose bits the other lacks aren't shared."""
    lack_i = np.bitwise_count(maps_i & ~maps_j).sum(axis=1).astype(np.int64)
    lack_j = np.bitwise_count(maps_j & ~maps_i).sum(axis=1).astype(np.int64)
    return PART * np.minimum(n_i - lack_i, n_j - lack_j) >= WHOLE * (n_i + n_j)


def pairs(a: Tree, b: Tree, *, same: bool, slab: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of entries that may link; with same (a is b), each pair once.

    Both trees are walked down together; the higher one steps down alone until they are level.
    slab: words of bitmaps looked at at a time.
    """
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    slab = max(64, slab // a.levels[0].maps.shape[1])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[la])), np.arange(len(b.levels[lb])), indexing="ij"))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(la, lb, i, j)]
    while todo:
        la, lb, i, j = todo.pop()
        if len(i) > slab:
            todo += [(la, lb, i[k : k + slab], j[k : k + slab]) for k in range(0, len(i), slab)]
            continue
        if same and la == lb:
            keep = i <= j if la else i < j
            i, j = i[keep], j[keep]
        keep = may_link(a.levels[la], b.levels[lb], i, j)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not la and not lb:
            x, y = a.levels[0], b.levels[0]
            keep = entries_may_link(x.maps[i], y.maps[j], x.low.size[i], y.low.size[j])
            found.append((i[keep], j[keep]))
            continue
        step_a, step_b = la >= lb, lb >= la
        if step_a:
            i, j, la = *_down(i, j, len(a.levels[la - 1])), la - 1
        if step_b:
            j, i, lb = *_down(j, i, len(b.levels[lb - 1])), lb - 1
        todo.append((la, lb, i, j))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _down(nodes: np.ndarray, others: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes, each with its node's other."""
    children = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    others = np.repeat(others, FAN)
    there = children < below
    return children[there], others[there]


def forest(raw: list[bytes], entries: Entries) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places) that may link, of entries in any order with their bitmaps: a tree for each width, and walks of neighbouring widths."""
    words = np.array([len(x) // 8 for x in raw], np.int64)
    trees = []
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        own = entries.at(at)
        at = at[np.lexsort((own.size, own.kind, own.side, own.cell))]
        trees.append((w, at, np.frombuffer(b"".join(raw[k] for k in at), np.uint64).reshape(len(at), w)))
    out = []
    for x, (w, at, maps) in enumerate(trees):
        tree = Tree(maps, entries.at(at))
        i, j = pairs(tree, tree, same=True)
        out.append((at[i], at[j]))
        if x + 1 < len(trees) and trees[x + 1][0] == 2 * w:  # sizes of others are too far apart
            _, at_, maps_ = trees[x + 1]
            i, j = pairs(tree, Tree(folded(maps_, w), entries.at(at_)), same=False)
            out.append((at[i], at_[j]))
    return out
