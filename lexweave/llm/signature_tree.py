"""Signature trees over sets of hashes, and the dual traversal that joins two of them by Jaccard similarity.

A leaf is a set: its bitmap has a bit for each of its tokens (several tokens may share one), its slack is how many
tokens that hides. A node holds the OR of the bitmaps below it, the range of their sizes and their largest slack. Two
sets A and B have at most min(slack) + popcount(bits(A) & bits(B)) tokens in common, and the same bound with the
nodes' values holds for every pair below two nodes, so a pair of nodes is dropped if that is too few for the
smallest sizes below it, or if the size ranges are too far apart. A pair of nodes whose sets are already connected is
dropped too: only components are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Bits of a bitmap, and children of a node.
BITS, FAN = 2048, 8


class Node:
    __slots__ = ("bits", "kids", "leaf", "lo", "hi", "one", "slack")

    def __init__(self, leaf: int, hashes: np.ndarray | None, kids: list[Node] | None = None):
        self.leaf, self.kids = leaf, kids
        if kids is None:
            mask = np.zeros(BITS, dtype=bool)
            mask[(hashes % np.uint64(BITS)).astype(np.int64)] = True
            self.bits = int.from_bytes(np.packbits(mask).tobytes(), "big")
            self.lo = self.hi = len(hashes)
            self.slack = len(hashes) - int(mask.sum())
            self.one = True
        else:
            self.bits = 0
            for kid in kids:
                self.bits |= kid.bits
            self.lo, self.hi = min(k.lo for k in kids), max(k.hi for k in kids)
            self.slack = max(k.slack for k in kids)
            self.one = False


class Forest:
    """Union-find whose roots are the smallest ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x] = root
            x = above
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class SignatureJoin:
    """Joins sets by 100 * |A & B| >= percent * |A | B|, keeping the components of the links."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.forest = Forest()

    def tree(self, members: Iterable[tuple[int, np.ndarray]]) -> Node | None:
        """A tree over (id, sorted distinct hashes); sets with the same smallest hashes are neighbours."""
        level = []
        for node, hashes in sorted(members, key=lambda m: (*m[1][:2].tolist(), len(m[1]))):
            self.ids.append(node)
            self.sets.append(hashes)
            level.append(Node(len(self.ids) - 1, hashes))
        while len(level) > 1:
            level = [Node(-1, None, level[i : i + FAN]) if len(level) > i + 1 else level[i] for i in range(0, len(level), FAN)]
        return level[0] if level else None

    def _first(self, node: Node) -> int:
        while node.kids is not None:
            node = node.kids[0]
        return self.forest.find(self.ids[node.leaf])

    def _connected(self, node: Node) -> bool:
        if not node.one:
            root = self._first(node)
            node.one = all(self._connected(kid) and self._first(kid) == root for kid in node.kids)
        return node.one

    def _far(self, u: Node, v: Node) -> bool:
        p = self.percent
        if u.hi * 100 < p * v.lo or v.hi * 100 < p * u.lo:
            return True
        return (min(u.slack, v.slack) + (u.bits & v.bits).bit_count()) * (100 + p) < p * (u.lo + v.lo)

    def _linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        common = int((b[at] == a).sum())
        return 100 * common >= self.percent * (len(a) + len(b) - common)

    def join(self, u: Node | None, v: Node | None) -> None:
        """Link every pair of a set below u and a set below v; u and v may be the same tree."""
        stack = [(u, v)] if u is not None and v is not None else []
        while stack:
            u, v = stack.pop()
            if u is v:
                if u.kids is not None:
                    kids = u.kids
                    stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i + 1, len(kids))]
                    stack += [(kid, kid) for kid in kids]  # on top: what is close comes first
                continue
            if self._far(u, v) or (self._connected(u) and self._connected(v) and self._first(u) == self._first(v)):
                continue
            if u.kids is None and v.kids is None:
                if self._linked(self.sets[u.leaf], self.sets[v.leaf]):
                    self.forest.union(self.ids[u.leaf], self.ids[v.leaf])
            elif v.kids is None or (u.kids is not None and u.hi - u.lo >= v.hi - v.lo):
                stack += [(kid, v) for kid in u.kids]
            else:
                stack += [(u, kid) for kid in v.kids]

    def links(self) -> list[tuple[int, int]]:
        """(id, root) of each id that is not the root of its component."""
        return [(node, root) for node in sorted(self.forest.up) if (root := self.forest.find(node)) != node]
