"""Counts of short id strings in a HAT-trie, spilled as sorted runs; packing and merging of runs.

A string is a run of big-endian 8-byte ids. The trie is shallow: nodes branch by one id, and below them hash
containers count what is left of the strings. A container that grows beyond a limit bursts into a node.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ID = 8
#: Strings of a packed piece of a run.
PIECE = 1 << 15


class _Node(dict):
    """Children by id; containers are plain dicts."""


class HatTrie:
    def __init__(self, burst: int = 4096, depth: int = 2):
        self.root, self.entries = _Node(), 0
        self._burst, self._depth = burst, depth * ID

    def add(self, counts: dict[bytes, int]) -> None:
        for key, n in counts.items():
            node, part, at = self.root, key[:ID], ID
            child = node.get(part)
            while type(child) is _Node:
                node, part = child, key[at: at + ID]
                at += ID
                child = node.get(part)
            if child is None:
                child = node[part] = {}
            tail = key[at:]
            if tail in child:
                child[tail] += n
                continue
            child[tail] = n
            self.entries += 1
            if len(child) > self._burst and at < self._depth:
                node[part] = burst = _Node()
                for rest, count in child.items():
                    burst.setdefault(rest[:ID], {})[rest[ID:]] = count

    def spill(self, left: int = 0) -> list[tuple[bytes, int]]:
        """Take out whole subtrees of the root, the largest first, until ``left`` strings remain; sorted."""
        sizes = sorted(((_size(child), part) for part, child in self.root.items()), reverse=True)
        taken = []
        for size, part in sizes:
            if self.entries <= left:
                break
            taken.append(part)
            self.entries -= size
        out: list[tuple[bytes, int]] = []
        # a subtree's strings lie together, so each is sorted alone
        for part in sorted(taken):
            own: list[tuple[bytes, int]] = []
            _collect(self.root.pop(part), part, own)
            own.sort()
            out += own
        return out


def _size(child: dict) -> int:
    return sum(map(_size, child.values())) if type(child) is _Node else len(child)


def _collect(child: dict, prefix: bytes, out: list) -> None:
    if type(child) is _Node:
        for part, below in child.items():
            _collect(below, prefix + part, out)
    else:
        out.extend((prefix + tail, n) for tail, n in child.items())


def borders(run: list[tuple[bytes, int]], splitters: list[bytes]) -> list[int]:
    """Where the ranges between splitters begin and end in a sorted run."""
    return [0, *(bisect_left(run, (s,)) for s in splitters), len(run)]


def cut(run: list[tuple[bytes, int]], splitters: list[bytes]) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    """Pieces of a sorted run as (range between splitters, strings), none longer than ``PIECE``."""
    at = borders(run, splitters)
    for number, (lo, hi) in enumerate(zip(at, at[1:])):
        for start in range(lo, hi, PIECE):
            yield number, run[start: min(start + PIECE, hi)]


def columns(run: list[tuple[bytes, int]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (rows padded with zeros) and counts of a run."""
    keys, counts = zip(*run)
    sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys)) // ID
    ids = np.zeros((len(keys), words), dtype=np.uint64)
    ids[np.arange(words) < sizes[:, None]] = np.frombuffer(b"".join(keys), dtype=">u8")
    return ids, np.array(counts, dtype=np.int64)


def pieces(runs: list[tuple[np.ndarray, np.ndarray, list[int]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, ids, counts): the strings that runs (ids, counts, borders) have in each range, together, not in order; long ones sorted and cut."""
    for number in range(len(runs[0][2]) - 1):
        own = [(ids[at[number]: at[number + 1]], counts[at[number]: at[number + 1]]) for ids, counts, at in runs if at[number] < at[number + 1]]
        if not own:
            continue
        ids, counts = (np.concatenate(c) if len(own) > 1 else c[0] for c in zip(*own))
        if len(ids) > PIECE:
            ids, counts = merge(ids, counts)
        for at in range(0, len(ids), PIECE):
            yield number, ids[at: at + PIECE], counts[at: at + PIECE]


def least(ids: np.ndarray) -> bytes:
    """The first string in order."""
    for j in range(ids.shape[1]):
        ids = ids[ids[:, j] == ids[:, j].min()]
    return ids[0][ids[0] != 0].astype(">u8").tobytes()


def pack(piece: list[tuple[bytes, int]], words: int) -> bytes:
    """A piece of a run, packed."""
    return pack_rows(*columns(piece, words))


def pack_rows(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Strings with the ids that each string shares with the one before left out, compressed."""
    place, sizes = np.arange(ids.shape[1]), (ids != 0).sum(axis=1)
    given = place < sizes[:, None]
    counts, sizes = counts.astype(np.uint64), sizes.astype(np.uint8)
    shared = np.zeros(len(ids), dtype=np.uint8)
    shared[1:] = np.cumprod(ids[1:] == ids[:-1], axis=1).sum(axis=1)
    np.minimum(shared, sizes, out=shared)
    new = ids[(place >= shared[:, None]) & given]
    wide = [int(a.max(initial=0) >> np.uint64(32) > 0) for a in (new, counts)]
    parts = [np.array([len(ids), len(new), *wide], dtype="<u4").tobytes(), (shared << 4 | sizes).tobytes(),
             new.astype("<u8" if wide[0] else "<u4").tobytes(), counts.astype("<u8" if wide[1] else "<u4").tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (rows padded with zeros) and counts of a packed piece."""
    raw = pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), codec="zstd", asbytes=True)
    n, m, wide_ids, wide_counts = np.frombuffer(raw, dtype="<u4", count=4).tolist()
    head = np.frombuffer(raw, dtype=np.uint8, count=n, offset=16)
    new = np.frombuffer(raw, dtype="<u8" if wide_ids else "<u4", count=m, offset=16 + n).astype(np.uint64)
    counts = np.frombuffer(raw, dtype="<u8" if wide_counts else "<u4", count=n, offset=16 + n + m * (8 if wide_ids else 4))
    shared, sizes = (head >> 4).astype(np.int64), (head & 15).astype(np.int64)
    place = np.arange(words)
    given = (place >= shared[:, None]) & (place < sizes[:, None])
    ids = np.zeros((n, words), dtype=np.uint64)
    ids[given] = new
    # a shared id is the last one given in its column
    source = np.maximum.accumulate(np.where(given, np.arange(n)[:, None], 0), axis=0)
    ids = np.where(place < sizes[:, None], ids[source, place], 0)
    return ids, counts.astype(np.int64)


def merge(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal strings of concatenated runs added up, in order."""
    order = np.lexsort(ids.T[::-1])
    ids, counts = ids[order], counts[order]
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.add.reduceat(counts, first) if len(first) else counts


def prefix_counts(ids: np.ndarray, counts: np.ndarray, least: int, shortest: int = 2) -> list[tuple[bytes, int]]:
    """Counts of all prefixes of sorted strings: those of ``least`` or more, and the first and last of each length.

    The first and last prefix may go on in a neighbouring block of strings, so their counts are parts of a sum.
    """
    out = []
    for k in range(shortest, ids.shape[1] + 1):
        rows = np.flatnonzero(ids[:, k - 1] != 0)
        if not len(rows):
            continue
        heads = ids[rows, :k]
        first = np.flatnonzero(np.r_[True, (heads[1:] != heads[:-1]).any(axis=1)])
        total = np.add.reduceat(counts[rows], first)
        shown = total >= least
        shown[0] = shown[-1] = True
        keys = heads[first[shown]].astype(">u8")
        out += [(key.tobytes(), int(n)) for key, n in zip(keys, total[shown])]
    return out
