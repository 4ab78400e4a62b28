"""Distributed grouping: links within keys, connected components, blocks of a cluster, block pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwarden.llm.scratch import Scratch


#: Ids of which a task remembers the component; when there are more, it reports what it knows and forgets.
_REMEMBERED = 1_000_000


class _Forest(dict):
    """Components of ids met in a task: each id's parent, roots are their own."""

    def find(self, x: int) -> int:
        root = x
        while self.setdefault(root, root) != root:
            root = self[root]
        while self[x] != root:
            self[x], x = root, self[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)

    def links(self) -> tuple[list[int], list[int]]:
        ids = [x for x in list(self) if self.find(x) != x]
        return ids, [self[x] for x in ids]


_LINK_FIELDS = ("a", "b", "shared", "part", "head_key", "head_id", "tail_key", "tail_id")


def _link_rows(*columns) -> pa.RecordBatch:
    n = len(columns[0])
    given = [pa.array(c, pa.int64()) for c in columns]
    return pa.record_batch([*given, *[pa.nulls(n, pa.int64())] * (len(_LINK_FIELDS) - len(given))], names=list(_LINK_FIELDS))


#: Ids of one key whose pairs are looked at; all ids of a key with more are joined.
_CHECKED = 1 << 12
#: Ids of a key whose pairs are looked at together with those of other keys.
_FEW_IDS = 16
#: Ids of one key that give a row for each pair; all ids of a key with more are joined.
_COUNTED = 1 << 6


def _pairs_of_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows with equal keys; the keys are sorted."""
    left, right, alive, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(keys)), 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(keys)]
        alive = alive[keys[alive] == keys[alive + step]]
        left.append(alive)
        right.append(alive + step)
    return np.concatenate(left), np.concatenate(right)


def _reached(columns: list[np.ndarray], alike: Callable[[list, list], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of rows that join what all pairs of alike rows would."""
    rest = np.arange(len(columns[0]))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            met = alike([c[at] for c in columns], [c[rest] for c in columns])
            found, rest = rest[met].tolist(), rest[~met]
            yield from ((at, x) for x in found)
            queue += found


def _key_components(alike: Callable[[list, list], np.ndarray] | None, checked: int, shared: Callable[[np.ndarray], np.ndarray] | None):
    """Join the ids of every run of one key in a sorted partition; report the components and the partition's ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, tail, forest = TaskContext.get().partitionId(), None, None, _Forest()

        def chained(keys: np.ndarray, ids: np.ndarray) -> None:
            same = keys[1:] == keys[:-1]
            for pair in zip(ids[1:][same].tolist(), ids[:-1][same].tolist()):
                forest.union(*pair)

        def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return starts, np.diff(np.append(starts, len(keys)))

        def counted(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The pairs of ids of whole runs that are not joined yet, with the number of keys that they need."""
            _, sizes = runs(keys)
            long, few = (np.repeat(x, sizes) for x in (sizes > checked, (sizes > 1) & (sizes <= checked)))
            chained(keys[long], ids[long])
            keys, ids = keys[few], ids[few]
            own, at = np.unique(ids, return_inverse=True)
            roots = np.array([forest.find(x) if x in forest else x for x in own.tolist()], dtype=np.int64)[at]
            left, right = _pairs_of_runs(keys)
            apart = roots[left] != roots[right]
            left, right = left[apart], right[apart]
            for at in range(0, len(left), 1 << 16):
                a, b = left[at: at + (1 << 16)], right[at: at + (1 << 16)]
                yield _link_rows(ids[a], ids[b], shared(keys[a]))

        def joined(keys: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
            """Join the alike ids of whole runs."""
            if not alike:
                return chained(keys, ids)
            starts, sizes = runs(keys)
            few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= _FEW_IDS), sizes))
            left, right = (few[x] for x in _pairs_of_runs(keys[few]))
            met = alike([c[left] for c in more], [c[right] for c in more])
            for pair in zip(ids[left[met]].tolist(), ids[right[met]].tolist()):
                forest.union(*pair)
            for start, size in zip(starts[sizes > _FEW_IDS].tolist(), sizes[sizes > _FEW_IDS].tolist()):
                own = slice(start, start + size)
                if size > checked:
                    chained(keys[own], ids[own])
                    continue
                names = ids[own].tolist()
                for a, b in _reached([c[own] for c in more], alike):
                    forest.union(names[a], names[b])

        # a run that may go on waits, but for one whose ids are all joined: the first, which may have begun before, and long ones
        held, open_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            keys, ids = columns[:2]
            # rows of one key and id are alike
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
            keys, ids, *_ = columns = [c[new] for c in columns]
            if head is None:
                head, open_key = (int(keys[0]), int(ids[0])), keys[0]
            tail = int(keys[-1]), int(ids[-1])
            begin, end = int(np.searchsorted(keys, open_key, side="right")), int(np.searchsorted(keys, keys[-1]))
            chained(keys[:begin], ids[:begin])
            if begin < end and shared:
                yield from counted(keys[begin:end], ids[begin:end])
            elif begin < end:
                joined(*[c[begin:end] for c in columns])
            if begin <= end and len(keys) - end > checked:
                chained(keys[end:], ids[end:])
                begin, open_key = len(keys), keys[-1]
            held = [c[-1:] if begin == len(keys) else c[end:] for c in columns]
            if len(forest) > _REMEMBERED:
                yield _link_rows(*forest.links())
                forest.clear()
        if held:
            # the last run may go on in the next partition
            chained(*held[:2])
        yield _link_rows(*forest.links())
        if head:
            row = dict(zip(_LINK_FIELDS, (None, None, None, part, *head, *tail)))
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, pa.int64()) for n in row]))

    return run


def key_links(rows: DataFrame, scratch: Scratch, alike: Callable[[list, list], np.ndarray] | None = None, checked: int = _CHECKED,
              shared: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Links (a, b) that join all ids of each key, fewer than rows.

    Rows (key, id) are range-partitioned by both, so the rows of a hot key spread over many tasks;
    parts of one key are linked over the partition borders.

    ``alike`` tells from the further columns of rows, given for the left and the right rows of pairs, which pairs of one key may be
    wanted; ids are then joined over such pairs alone. ``shared`` tells from a key how many keys two ids must share to be joined, the least
    such number of the keys they do share. All ids are joined of a key with more than ``checked`` (at most ``_COUNTED`` with ``shared``) of
    them in a partition, or that may run over its borders: more than asked for, never less.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    checked = min(checked, _COUNTED) if shared else checked if alike else 1
    found = scratch.keep(ordered.mapInArrow(_key_components(alike, checked, shared), ", ".join(f"{name} long" for name in _LINK_FIELDS)))
    ends = found.where("part IS NOT NULL")
    order = Window.orderBy("part")  # one row per partition
    over = (ends.withColumns({"before_key": F.lag("tail_key").over(order), "before_id": F.lag("tail_id").over(order)})
            .where("before_key = head_key AND before_id <> head_id").select(F.col("head_id").alias("a"), F.col("before_id").alias("b")))
    links = found.where("part IS NULL AND shared IS NULL").select("a", "b").unionByName(over)
    if shared:
        pairs = found.where("shared IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("shared").alias("shared"))
        links = links.unionByName(pairs.where("n >= shared").select("a", "b"))
    return links


def _local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = _Forest()
    for batch in batches:
        for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.union(*pair)
        if len(forest) > _REMEMBERED:
            yield _link_rows(*forest.links()).select(["a", "b"])
            forest.clear()
    yield _link_rows(*forest.links()).select(["a", "b"])


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for every id of the links (a, b) with a <> b; the root is the smallest id of its component.

    Tasks join what they hold, up to ``_REMEMBERED`` links each, and report their forests. Where one
    forest can't be sure to hold all ids (a link brings up to two), large-star and small-star steps follow: a
    union-find over the whole cluster whose rounds are joins, until every component is a star around its root.
    Each round's links are a written table.
    """
    def joined(table: DataFrame, rows: int | None = None) -> DataFrame:
        fewer = table if rows is None else table.coalesce(max(1, -(-rows // _REMEMBERED)))
        return scratch.keep(fewer.mapInArrow(_local_components, "a long, b long"))

    current = joined(links.where("a <> b").select("a", "b"))
    while True:
        rows = current.count()
        before, current = current, joined(current, rows)
        scratch.free(before)
        if 2 * rows <= _REMEMBERED:  # one task, whose forest was never cleared
            break
        if _stars(current):
            # several forests may have reported one link
            before, current = current, scratch.keep(current.distinct())
            scratch.free(before)
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, current = current, scratch.keep(small.unionByName(roots.select("a", F.col("m").alias("b"))).distinct())
        scratch.free(before)
    roots = current.select(F.col("b").alias("id")).distinct()
    out = current.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("id")))
    out.scratch_path = current.scratch_path
    return out


def _stars(links: DataFrame) -> bool:
    """Whether every id has one parent at most and no parent has one."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))).distinct()
    parents = links.distinct().groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    bad = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 0 AND down > 0")
    return bad.limit(1).count() + parents.limit(1).count() == 0


def _number(most_rows: int, most_weight: int, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        cluster, rows, weight = None, 0, 0
        for batch in batches:
            blocks = []
            for own, size in zip(batch.column("cluster").to_pylist(), batch.column("weight").to_pylist()):
                if own != cluster:
                    # a tree node of the level above holds blocks of one cluster
                    block = (block // height + 1) * height
                    cluster, rows, weight = own, 0, 0
                elif rows >= most_rows or weight + size > most_weight:
                    block, rows, weight = block + 1, 0, 0
                rows, weight = rows + 1, weight + size
                blocks.append(block)
            yield batch.append_column("block", pa.array(blocks, pa.int64()))

    return run


def blocks_of_clusters(members: DataFrame, most_rows: int = 256, most_weight: int = 150_000, height: int = 16) -> DataFrame:
    """Adds ``block`` to (cluster, weight, id): members of a cluster in order of weight, in bounded blocks.

    A cluster may run over any number of partitions; blocks end at their borders. ``block / height``
    numbers the nodes above, which never mix clusters.
    """
    n = max(2, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = members.repartitionByRange(n, "cluster", "weight", "id").sortWithinPartitions("cluster", "weight", "id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields) + ", block long"
    return ordered.mapInArrow(_number(most_rows, most_weight, height), schema)


class UnionFind:
    """Components of a few local items."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b
