"""What single tasks compute over arrays: graphs by number, shortest paths, power iteration, MD5 of many texts at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Edges up to which a graph is handed to tasks whole (strings of 45 bytes: 100 MB); beyond, operators join.
WHOLE_EDGES = 1_000_000


def numbered(edges: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ends of pairs (``u``, ``v``) in ascending order, and each pair's ends by their places in it."""
    both = pa.concat_arrays([*edges["u"].chunks, *edges["v"].chunks]) if edges.num_rows else pa.array([], edges.schema.field("u").type)
    names = both.unique()
    names = names.take(pc.sort_indices(names))
    at = pc.index_in(both, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    return names, at[: edges.num_rows], at[edges.num_rows :]


def neighbours(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` nodes linked by pairs: where each one's neighbours begin, and the neighbours, ascending."""
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).astype(np.int64), b[np.lexsort((b, a))]


def principal(n: int, u: np.ndarray, v: np.ndarray, tolerance: float, rounds: int, at_once: int = 10) -> np.ndarray | None:
    """The vector of length one on which powers of A + I settle from ones; None if ``rounds`` steps change it by more than ``tolerance`` of its sum per ``at_once``."""
    start, to = neighbours(n, u, v)
    x = np.full(n, 1.0 / max(n, 1))
    for _ in range(0, rounds, at_once):
        was = x
        for _ in range(at_once):
            x = x + (np.add.reduceat(x[to], start[:-1]) if n else x)
        x = x / x.sum()
        if np.abs(x - was).sum() <= tolerance:
            return x / math.sqrt((x * x).sum())
    return None if n else x


class Paths:
    """Shortest paths of an undirected graph, with hanging trees taken off and counted by their sizes.

    ``inner`` of a node: ordered pairs of others whose paths it separates by the trees that hang on it. What is left of the
    graph, ``core`` (numbers of the nodes, by component), carries the sizes as ``weight``; ``passed`` searches from some of its nodes.
    """

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray):
        link = np.zeros(n, np.int64)
        np.bitwise_xor.at(link, u, v)
        np.bitwise_xor.at(link, v, u)
        degree = (np.bincount(u, minlength=n) + np.bincount(v, minlength=n)).tolist()
        link, weight, squares, parent = link.tolist(), [1] * n, [0] * n, list(range(n))
        leaves, taken = [i for i in range(n) if degree[i] == 1], []
        while leaves:
            a = leaves.pop()
            if degree[a] != 1:
                continue
            b = link[a]  # of the neighbours that are left, the exclusive or: the only one
            degree[a], degree[b], link[b], parent[a] = 0, degree[b] - 1, link[b] ^ a, b
            weight[b] += weight[a]
            squares[b] += weight[a] ** 2
            taken.append(a)
            if degree[b] == 1:
                leaves.append(b)
        root = np.arange(n)
        for a in reversed(taken):
            root[a] = root[parent[a]]
        off = np.zeros(n, bool)
        off[taken] = True
        keep = ~(off[u] | off[v])
        u, v = u[keep], v[keep]
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, u, label[v])
            np.minimum.at(new, v, label[u])
            new = new[new]
            if (new == label).all():
                break
            label = new
        weight, squares = np.array(weight, np.int64), np.array(squares, np.int64)
        total = np.zeros(n, np.int64)
        np.add.at(total, label[~off], weight[~off])
        size = total[label[root]]
        self.inner = ((size - 1) ** 2 - squares - (size - weight) ** 2).astype(float)
        linked = np.flatnonzero((np.bincount(u, minlength=n) + np.bincount(v, minlength=n)) > 0)
        self.core = linked[np.argsort(label[linked], kind="stable")]
        at = np.zeros(n, np.int64)
        at[self.core] = np.arange(len(self.core))
        self.start, self.to = neighbours(len(self.core), at[u], at[v])
        self.weight = weight[self.core].astype(float)
        _, self.first, back, count = np.unique(label[self.core], return_index=True, return_inverse=True, return_counts=True)
        self.first, self.size = self.first[back], count[back]

    def passed(self, sources: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
        """Of each core node the weighted share of the paths from ``sources`` to all others that lead through it; sources are searched together by ``cells``."""
        out, degree = np.zeros(len(self.core)), np.diff(self.start)
        ends = np.cumsum(self.size[sources])
        done = 0
        while done < len(sources):
            before = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, before + cells, side="right")))
            s = sources[done:upto]
            done = upto
            width = self.size[s]
            shift = np.cumsum(width) - width - self.first[s]  # a source's cells: its component's nodes, shifted
            seen, slot = np.zeros(int(width.sum()), bool), np.zeros(int(width.sum()), np.int64)
            node, who, paths = s, np.arange(len(s)), np.ones(len(s))
            seen[node + shift] = True
            levels, steps = [(node, who, paths)], []
            while True:
                d = degree[node]
                near = np.repeat(np.arange(len(node)), d)
                to = self.to[np.arange(len(near)) - np.repeat(np.cumsum(d) - d - self.start[node], d)]
                cell = to + shift[who][near]
                new = ~seen[cell]
                near, to, cell = near[new], to[new], cell[new]
                if not len(cell):
                    break
                slot[cell] = np.arange(len(cell))
                one = slot[cell] == np.arange(len(cell))  # of each cell reached one way that stands for all
                far = (np.cumsum(one) - 1)[slot[cell]]
                paths = np.bincount(far, weights=paths[near])
                node, who = to[one], who[near[one]]
                seen[cell] = True
                levels.append((node, who, paths))
                steps.append((near, far))
            x = np.zeros(len(node))
            nodes, shares = [], []
            for (near, far), (node, who, paths), (beyond, _, ways) in zip(reversed(steps[1:]), reversed(levels[1:-1]), reversed(levels[2:]), strict=True):
                x = paths * np.bincount(near, weights=((self.weight[beyond] + x) / ways)[far], minlength=len(node))
                nodes.append(node)
                shares.append(x * self.weight[s[who]])
            if nodes:
                out += np.bincount(np.concatenate(nodes), weights=np.concatenate(shares), minlength=len(out))
        return out


def by_depth(start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """All nodes, depth first from the lowest of each component: those that follow each other lie near each other."""
    near, bounds, seen, out = to.tolist(), start.tolist(), bytearray(len(start) - 1), []
    for root in range(len(seen)):
        stack = [] if seen[root] else [root]
        seen[root] = 1
        while stack:
            a = stack.pop()
            out.append(a)
            for b in near[bounds[a] : bounds[a + 1]]:
                if not seen[b]:
                    seen[b] = 1
                    stack.append(b)
    return np.array(out, np.int64)


class Contexts:
    """Counts of the pairs of ``n`` nodes (by number) that meet within ``window`` steps of walks of one ``length``.

    At distance d a pair counts (window + 1 - d) / window: skip-gram's draw of the width of its window, as expected.
    """

    def __init__(self, n: int, length: int, window: int, most: int = 2_000_000):
        pairs = [(i, i + d, (window + 1 - d) / window) for d in range(1, min(window, length - 1) + 1) for i in range(length - d)]
        self.first, self.second, self.share = (np.array([x[k] for x in pairs], kind) for k, kind in ((0, np.int64), (1, np.int64), (2, float)))
        self.n, self.most, self.held, self.parts = n, most, 0, []

    def add(self, path: np.ndarray) -> None:
        """Count the walks in the rows of ``path``; few that lie near each other are counted fastest."""
        nodes, at = np.unique(path, return_inverse=True)
        m, at = len(nodes), at.reshape(path.shape)
        key = (at[:, self.first] * m + at[:, self.second]).reshape(-1)
        share = np.broadcast_to(self.share, (len(path), len(self.share))).reshape(-1)
        if m * m <= 20 * len(key):
            count = np.bincount(key, share, m * m)
            key = np.flatnonzero(count)
            count = count[key]
        else:
            key, back = np.unique(key, return_inverse=True)
            count = np.bincount(back, share)
        a, b = nodes[key // m], nodes[key % m]
        self.parts.append((np.minimum(a, b) * self.n + np.maximum(a, b), count))
        self.held += len(key)
        if self.held > self.most:
            self.parts = [summed(self.parts)]
            self.held = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What was counted since the last call, each pair both ways (one of a node and itself twice as much): nodes, ascending, others, counts."""
        key, count = summed(self.parts)
        self.parts, self.held = [], 0
        a, b = key // self.n, key % self.n
        apart = a != b
        key, count = np.concatenate([key, (b * self.n + a)[apart]]), np.concatenate([np.where(apart, count, 2 * count), count[apart]])
        order = np.argsort(key)
        return key[order] // self.n, key[order] % self.n, count[order]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, with the sums of their values."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    keys, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([x for _, x in parts]), len(keys))


def fitted(x: np.ndarray, seen: np.ndarray, counts: np.ndarray, drawn: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
    """Rows ``x`` after ``steps`` of descent on skip-gram's loss, all else fixed: counts times log(1 + exp(-x y)) over the rows y of ``seen``, weight times log(1 + exp(x z)) over those of ``drawn``.

    The loss lies below parabolas of curvature tanh(s / 2) / 2 s that touch it at the products s; under twice the way to their least, it falls.
    """
    y2, z2 = (seen * seen).sum(axis=1), (drawn * drawn).sum(axis=1)
    for _ in range(steps):
        slope, curve = 0, 1e-6
        for other, square, sign, by in ((seen, y2, 1, counts), (drawn, z2, -1, weight[:, None])):
            s = x @ (other.T * sign)
            np.minimum(s, 80, out=s)
            off = np.exp(s)
            off += 1
            np.reciprocal(off, out=off)
            np.abs(s, out=s)
            s += 1e-6
            bend = np.abs(off - 0.5)
            bend += 2.5e-7
            bend /= s
            bend *= by
            curve = curve + bend @ square
            off *= by
            slope = slope + off @ other * sign
        x = x + 1.9 * slope / curve[:, None]
    return x


_TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, axis=0).reshape(4, 4, 4).reshape(-1)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]


def digests(texts: np.ndarray, rows: int = 16_384, words: int = 4) -> np.ndarray:
    """MD5 of texts of one length, a row of bytes each: the first ``words`` of four a row, whose bytes in big-endian order are the digest."""
    n, length = texts.shape
    blocks = (length + 8) // 64 + 1
    out = np.empty((words, n), np.uint32)
    for begin in range(0, n, rows):
        part = texts[begin : begin + rows]
        padded = np.zeros((len(part), 64 * blocks), np.uint8)
        padded[:, :length] = part
        padded[:, length] = 128
        padded[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
        read = np.ascontiguousarray(padded.view("<u4").T)
        state = [np.full(len(part), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        f, t = np.empty(len(part), np.uint32), np.empty(len(part), np.uint32)
        for at in range(0, 16 * blocks, 16):
            a, b, c, d = (x.copy() for x in state)
            for i in range(64):
                if i < 16:
                    np.bitwise_xor(c, d, out=f)
                    f &= b
                    f ^= d
                elif i < 32:
                    np.bitwise_xor(b, c, out=f)
                    f &= d
                    f ^= c
                elif i < 48:
                    np.bitwise_xor(b, c, out=f)
                    f ^= d
                else:
                    np.invert(d, out=f)
                    f |= b
                    f ^= c
                a += f
                a += read[at + _PLACES[i]]
                a += np.uint32(_SINES[i])
                np.left_shift(a, np.uint32(_TURNS[i]), out=t)
                a >>= np.uint32(32 - _TURNS[i])
                a |= t
                a += b
                a, b, c, d = d, a, b, c
            for x, y in zip(state, (a, b, c, d), strict=True):
                x += y
        for k, x in enumerate(state[:words]):
            out[k, begin : begin + rows] = x.byteswap()
    return out


def by_length(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts of each length, and their bytes, a row each."""
    texts = texts.cast(pa.large_string())
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        some = texts.take(pa.array(at))
        begin = np.frombuffer(some.buffers()[1], np.int64)[some.offset] if length else 0
        yield at, np.frombuffer(some.buffers()[2] if length else b"", np.uint8)[begin : begin + len(at) * length].reshape(len(at), int(length))
