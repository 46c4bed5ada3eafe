"""Deep-shallow sorting of byte strings of one length.

Multikey quicksort on eight-byte symbols orders the strings to a shallow
depth, all segments of a round side by side; groups that still agree there are
ordered by blind tries, which branch on single bytes and compare a new string
with one leaf only.
"""

from __future__ import annotations

import numpy as np


class _Trie:
    """A blind trie: an inner node is [depth, {byte: child}], a leaf is an index."""

    def __init__(self, strings: list[bytes]):
        self.s, self.size = strings, len(strings[0])
        self.n = [int.from_bytes(x, "big") for x in strings]
        self.root: list | int = 0
        for k in range(1, len(strings)):
            self._insert(k)

    def _common(self, a: int, b: int) -> int:
        return self.size - (((self.n[a] ^ self.n[b]).bit_length() + 7) >> 3)

    def _insert(self, k: int) -> None:
        s, node = self.s[k], self.root
        while not isinstance(node, int):  # blind: only branching bytes are looked at
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        depth = self._common(k, node)
        other = self.s[node]
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = k
            return
        made = [depth, {other[depth]: node, s[depth]: k}]
        if parent is None:
            self.root = made
        else:
            parent[1][s[parent[0]]] = made

    def order(self) -> tuple[list[int], list[int]]:
        """Leaves in order, and each one's common prefix with the one before."""
        out, lcp, stack = [], [], [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, int):
                out.append(node), lcp.append(shared)
                continue
            children = sorted(node[1])
            for c in reversed(children[1:]):
                stack.append((node[1][c], node[0]))
            stack.append((node[1][children[0]], shared))
        return out, lcp


def _multikey(words: np.ndarray, order: np.ndarray, seg: np.ndarray, shallow: int) -> np.ndarray:
    """Multikey quicksort of all segments side by side; seg holds each place's segment start. Returns the starts of the segments that remain.

    A round splits each open segment by its pivot, the median of three symbols
    at the segment's depth, into lesser, equal and greater strings; equal ones
    go on with their next symbol, the others stay at theirs. A segment is
    closed when it holds one string or has agreed on `shallow` symbols.
    """
    n = len(order)
    depth = np.zeros(n, np.int64)
    while True:
        ends = np.flatnonzero(np.append(seg[1:] != seg[:-1], True)) + 1
        starts = np.append(0, ends[:-1])
        size = ends - starts
        open_ = (size > 1) & (depth[starts] < shallow)
        if not open_.any():
            return seg
        starts, size = starts[open_], size[open_]
        at = np.repeat(starts - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        w = words[order[at], depth[at]]
        head = np.append(0, np.cumsum(size)[:-1])
        three = np.sort(np.stack([w[head], w[head + size // 2], w[head + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = np.where(w < pivot, 0, np.where(w == pivot, 1, 2)).astype(np.int64)
        # a stable deal of each segment's places to its three sides
        inner = np.argsort(np.repeat(np.arange(len(size)), size) * 3 + side, kind="stable")
        order[at] = order[at[inner]]
        side = side[inner]
        new = np.append(True, (side[1:] != side[:-1]))
        new[head] = True
        seg[at] = at[new][np.cumsum(new) - 1]
        depth[at] += side == 1


def sort(group: np.ndarray, strings: np.ndarray, shallow: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Order rows by (group, string). Returns the order and each row's common prefix with the row before, -1 where a group begins.

    Equal strings share their whole length. strings: n x length bytes.
    """
    n, size = strings.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = -(-size // 8) * 8
    words = np.zeros((n, width), np.uint8)
    words[:, :size] = strings
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.append(True, g[1:] != g[:-1])
    seg = _multikey(words, order, np.flatnonzero(first)[np.cumsum(first) - 1], min(shallow, words.shape[1]))
    # deep: what still agrees, in blind tries over its distinct strings
    starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    ends = np.append(starts[1:], n)
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        seen: dict[bytes, list[int]] = {}
        for r in order[a:b].tolist():
            seen.setdefault(strings[r].tobytes(), []).append(r)
        distinct = list(seen)
        if len(distinct) > 1:
            order[a:b] = [r for k in _Trie(distinct).order()[0] for r in seen[distinct[k]]]
    lcp = np.full(n, -1, np.int64)
    for a in range(1, n, 1 << 16):
        x = slice(a, min(n, a + (1 << 16)))
        apart = words[order[x]] ^ words[order[a - 1 : x.stop - 1]]
        word = (apart != 0).argmax(axis=1)
        differ = apart[np.arange(len(word)), word]
        lcp[x] = np.where(differ == 0, size, np.minimum(8 * word + _leading(differ), size))
    lcp[first] = -1
    return order, lcp


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero 64-bit numbers."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += (x >> np.uint64(64 - 8 * k)) == 0
    return out
