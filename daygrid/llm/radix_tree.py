"""An adaptive radix tree over byte keys: node layouts of 4, 16, 48 and 256 branches, with path compression.

Keys are of any length, may be prefixes of each other and may repeat. A node knows its members as a range of insertion
numbers, so keys must be inserted in ascending order.
"""

from __future__ import annotations

from bisect import bisect_left


class Node:
    """A node with its compressed path; up to 16 branches lie in sorted order beside their bytes.

    ``first`` and ``last`` bound the members below (insertion numbers), ``ends`` counts the keys that end here.
    """

    __slots__ = ("branches", "ends", "first", "labels", "last", "layout", "path")

    def __init__(self, path: bytes, first: int):
        self.path, self.first, self.last, self.ends = path, first, first, 0
        self.layout = 4
        self.labels: bytearray | None = bytearray()
        self.branches: list = []

    def child(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.branches[byte]
        if self.layout == 48:
            slot = self.labels[byte]
            return self.branches[slot - 1] if slot else None
        k = bisect_left(self.labels, byte)
        return self.branches[k] if k < len(self.labels) and self.labels[k] == byte else None

    def put(self, byte: int, node: Node) -> None:
        """Set the branch of a byte; a layout that is full grows to the next one."""
        if self.layout <= 16:
            k = bisect_left(self.labels, byte)
            if k < len(self.labels) and self.labels[k] == byte:
                self.branches[k] = node
                return
            if len(self.labels) < self.layout:
                self.labels.insert(k, byte)
                self.branches.insert(k, node)
                return
            self._grow()
            self.put(byte, node)
        elif self.layout == 48:
            slot = self.labels[byte]
            if slot:
                self.branches[slot - 1] = node
            elif len(self.branches) < 48:
                self.branches.append(node)
                self.labels[byte] = len(self.branches)
            else:
                self._grow()
                self.put(byte, node)
        else:
            self.branches[byte] = node

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for k, byte in enumerate(self.labels):
                index[byte] = k + 1
            self.labels, self.layout = index, 48
        else:
            wide = [None] * 256
            for byte in range(256):
                if self.labels[byte]:
                    wide[byte] = self.branches[self.labels[byte] - 1]
            self.labels, self.branches, self.layout = None, wide, 256

    def children(self) -> list[Node]:
        """Branches by ascending byte."""
        if self.layout <= 16:
            return self.branches
        if self.layout == 48:
            return [self.branches[slot - 1] for slot in self.labels if slot]
        return [node for node in self.branches if node is not None]


def _common(a: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``key[at:]``."""
    other = key[at:at + len(a)]
    if a == other:
        return len(a)
    low, high = 0, min(len(a), len(other))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == other[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Tree:
    def __init__(self):
        self.root: Node | None = None
        self.size = 0

    def insert(self, key: bytes) -> None:
        number, self.size = self.size, self.size + 1
        if self.root is None:
            self.root = Node(b"", number)
        above, byte, node, at = None, 0, self.root, 0
        while True:
            same = _common(node.path, key, at)
            at += same
            if same < len(node.path):  # the key leaves inside the compressed path: split it there
                split = Node(node.path[:same], node.first)
                split.put(node.path[same], node)
                node.path = node.path[same + 1:]
                above.put(byte, split)
                node = split
            node.last = number
            if at == len(key):
                node.ends += 1
                return
            byte, above = key[at], node
            below = node.child(byte)
            if below is None:
                leaf = Node(key[at + 1:], number)
                leaf.ends = 1
                node.put(byte, leaf)
                return
            node, at = below, at + 1
