"""Deep-shallow suffix sorting of byte strings.

The shallow part is a multikey quicksort whose characters are 8 bytes wide: groups are split into less,
equal and greater by a pivot character, and equal groups go on with the next character, ``SHALLOW``
characters deep. Groups that are still equal there have a long common prefix; a blind trie (it stores
branching depths and bytes only, and compares an inserted string once, with one leaf) orders each.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 3
#: Small groups of the shallow part are sorted directly.
SMALL = 16


def _multikey(words: np.ndarray, order: np.ndarray) -> list[tuple[int, int]]:
    """Sort ``order`` (rows of ``words``) in place by the first SHALLOW characters; returns runs still equal."""
    deep, todo = [], [(0, len(order), 0)]
    while todo:
        begin, end, d = todo.pop()
        if end - begin < 2:
            continue
        if d == words.shape[1]:
            deep.append((begin, end))
            continue
        own = order[begin:end]
        key = words[own, d]
        if end - begin <= SMALL:
            by = np.argsort(key, kind="stable")
            order[begin:end], key = own[by], key[by]
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            edges = [0, *cuts.tolist(), end - begin]
            todo += [(begin + a, begin + b, d + 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            continue
        pivot = np.sort(key[:: max(1, len(key) // 9)])[len(key[:: max(1, len(key) // 9)]) // 2]
        less, same = key < pivot, key == pivot
        a, b = int(less.sum()), int(same.sum())
        order[begin:end] = np.concatenate([own[less], own[same], own[~(less | same)]])
        todo += [(begin, begin + a, d), (begin + a, begin + a + b, d + 1), (begin + a + b, end, d)]
    return deep


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not x else n - 1 - (x.bit_length() - 1) // 8


class BlindTrie:
    """Orders strings that share a long prefix. A node is ``[depth, {byte: child}]``, a leaf a list of numbers."""

    def __init__(self, strings: list[bytes]):
        self._s = strings
        self._root: list | None = None

    def _at(self, i: int, depth: int) -> int:
        s = self._s[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        if self._root is None:
            self._root = [None, [i]]
            return
        node = self._root
        while node[0] is not None:  # blindly to some leaf
            child = node[1].get(self._at(i, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other = node[1][0]
        depth = _common(self._s[i], self._s[other])
        if depth == len(self._s[i]) == len(self._s[other]):
            node[1].append(i)
            return
        node, above, byte = self._root, None, None
        while node[0] is not None and node[0] < depth:
            above, byte = node, self._at(i, node[0])
            node = node[1][byte]
        mine = self._at(i, depth)
        if node[0] == depth:
            node[1][mine] = [None, [i]]
            return
        split = [depth, {mine: [None, [i]], self._at(other, depth): node}]
        if above is None:
            self._root = split
        else:
            above[1][byte] = split

    def walk(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and the common prefix of each with the one before (-1: equal; first: 0)."""
        out, common, todo = [], [], [(self._root, 0)]
        while todo:
            node, lcp = todo.pop()
            if node[0] is None:
                out += node[1]
                common += [lcp] + [-1] * (len(node[1]) - 1)
                continue
            children = [node[1][x] for x in sorted(node[1])]
            todo += [(c, node[0]) for c in reversed(children[1:])]
            todo.append((children[0], lcp))
        return out, common


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and the common prefix of each with its predecessor.

    ``group`` numbers the groups; the first string of a group has a common prefix of -1.
    """
    n, wide = len(strings), 8 * SHALLOW
    head = np.frombuffer(b"".join(s[:wide].ljust(wide, b"\0") for s in strings), ">u8").reshape(n, SHALLOW).astype(np.uint64)
    words = np.concatenate([group.astype(np.uint64)[:, None], head], axis=1)
    order = np.arange(n)
    deep = _multikey(words, order)
    size = np.array([len(s) for s in strings])
    shared = np.zeros(n, np.int64)
    for begin, end in deep:
        own = order[begin:end].tolist()
        if end - begin == 2:
            a, b = own
            if strings[b] < strings[a]:
                a, b = b, a
            order[begin:end] = a, b
            shared[begin + 1] = _common(strings[a], strings[b])
            continue
        trie = BlindTrie([strings[i] for i in own])
        for i in range(len(own)):
            trie.insert(i)
        place, common = trie.walk()
        order[begin:end] = [own[i] for i in place]
        shared[begin:end] = [len(strings[own[p]]) if c < 0 else c for p, c in zip(place, common, strict=True)]
    # Between runs the shallow characters differ: the common prefix is found in them.
    first = np.ones(n, bool)
    for begin, end in deep:
        first[begin + 1 : end] = False
    at = np.flatnonzero(first)
    at = at[at > 0]
    a, b = words[order[at - 1]], words[order[at]]
    x = a[:, 1:] ^ b[:, 1:]
    column = (x != 0).argmax(axis=1)
    value = x[np.arange(len(at)), column]
    lead = np.zeros(len(at), np.int64)
    for k in range(8):
        lead += (value >> np.uint64(56 - 8 * k) == 0).astype(np.int64)
    inside = np.minimum(8 * column + lead, np.minimum(size[order[at - 1]], size[order[at]]))
    shared[at] = np.where(a[:, 0] == b[:, 0], inside, -1)
    if n:
        shared[0] = -1
    return order, shared
