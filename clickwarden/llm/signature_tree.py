"""Signature trees over hashed sets, and the distributed dual traversal that joins similar sets.

Sets of a cluster lie in blocks; a node's signature is the OR and the AND of the bitmaps of its
sets with the range of their sizes. From these follow how many elements of any set of one node are
missing in every set of another, hence the largest overlap and the largest Jaccard similarity a
pair could reach. Pairs of upper nodes that can't reach the threshold are dropped, the
rest open into pairs of blocks, then of twigs and leaves inside a task, and what is left is
compared element by element. For components alone, pairs that earlier matches of the task join
already are skipped; all links, or their number for each set, come from comparing every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickwarden.llm.grouping import UnionFind
from clickwarden.llm.scratch import Scratch

WORDS = 32  # 64-bit words of a bitmap
TWIG = 16  # sets under a lowest node inside a block
HEIGHT = 16  # blocks under an upper node
FEW_PAIRS = 64  # of two blocks that are compared without a traversal
#: Elements of the block pairs that a task unpacks together.
UNPACKED = 1 << 20
#: Elements and sets of small tiles' pairs that are unpacked together.
GATHERED, GATHERED_SETS = 1 << 17, 1 << 12
_NODE = "block long, cluster long, least int, most int, any binary, all binary, sets binary, sizes binary, ids binary"


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bitmap per set."""
    bits = np.zeros((len(sets), WORDS * 64), dtype=bool)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits[row, (np.concatenate(sets) >> np.uint64(17)).astype(np.int64) % (WORDS * 64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def missing(all_of: np.ndarray, any_of: np.ndarray) -> np.ndarray:
    """Lower bound of the elements of sets under one node that no set under the other has."""
    return np.bitwise_count(all_of[:, None, :] & ~any_of[None, :, :]).sum(2, dtype=np.int64)


def reachable(most_a, most_b, least_a, least_b, lost_a, lost_b, percent: int) -> np.ndarray:
    """Whether some pair of sets could have 100 * overlap >= percent * union."""
    overlap = np.minimum(most_a - lost_a, most_b - lost_b)
    # the union has the overlap and at least what each side lost
    possible = (overlap > 0) & (100 * overlap >= percent * (overlap + lost_a + lost_b))
    return possible & (100 * most_a >= percent * least_b) & (100 * most_b >= percent * least_a)


def _twigs(size: np.ndarray, bits: np.ndarray):
    cuts = np.arange(0, len(size), TWIG)
    return (np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts),
            np.bitwise_or.reduceat(bits, cuts, axis=0), np.bitwise_and.reduceat(bits, cuts, axis=0))


def candidate_pairs(size_a, bits_a, size_b, bits_b, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (positions in a and b) that a dual traversal of both blocks can't exclude."""
    least_a, most_a, any_a, all_a = _twigs(size_a, bits_a)
    least_b, most_b, any_b, all_b = _twigs(size_b, bits_b)
    open_nodes = reachable(most_a[:, None], most_b[None, :], least_a[:, None], least_b[None, :],
                           missing(all_a, any_b), missing(all_b, any_a).T, percent)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in zip(*np.nonzero(open_nodes)):
        a, b = slice(i * TWIG, (i + 1) * TWIG), slice(j * TWIG, (j + 1) * TWIG)
        x, y = size_a[a][:, None], size_b[b][None, :]
        lost_a, lost_b = missing(bits_a[a], bits_b[b]), missing(bits_b[b], bits_a[a]).T
        overlap = np.minimum(x - lost_a, y - lost_b)
        p, q = np.nonzero(100 * overlap >= percent * (x + y - overlap))
        left.append(p + i * TWIG)
        right.append(q + j * TWIG)
    return np.concatenate(left), np.concatenate(right)


def overlap_size(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def numbers(packed: list[bytes]) -> list[np.ndarray]:
    """Sets that travel as their packed elements."""
    return [np.frombuffer(p, "<u8") for p in packed]


def _unpack(packed: dict[int, tuple], expand: Callable[[list[bytes]], list[np.ndarray]]) -> dict[int, tuple]:
    """(ids, sizes, sets, bitmaps) of some blocks (sets, sizes, ids), all expanded together."""
    pieces, counts, unzip = [], [], zstandard.ZstdDecompressor()
    for blob, sizes, _ in packed.values():
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))]).tolist()
        raw = unzip.decompress(blob)
        pieces += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        counts.append(len(cuts) - 1)
    if not pieces:
        return {}
    sets = expand(pieces)
    bits, size, out, at = bitmaps(sets), np.array([len(s) for s in sets], dtype=np.int64), {}, 0
    for (block, (_, _, ids)), n in zip(packed.items(), counts):
        own = slice(at, at + n)
        out[block] = (np.frombuffer(ids, "<i8"), size[own], sets[own], bits[own])
        at += n
    return out


def overlap_sizes(sets_a: list[np.ndarray], sets_b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Common elements of every set of a with every set of b, from products of 0/1 tables of some columns each."""
    total = np.zeros((len(sets_a), len(sets_b)), dtype=np.int64)
    both = np.intersect1d(np.concatenate(sets_a), np.concatenate(sets_b))
    if not len(both):
        return total

    def places(sets):
        row, all_of = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, all_of), len(both) - 1)
        found = both[at] == all_of
        return row[found], at[found]

    sides = [(len(s), *places(s)) for s in (sets_a, sets_b)]
    for lo in range(0, len(both), columns):
        tables = []
        for n, row, at in sides:
            table, here = np.zeros((n, min(columns, len(both) - lo)), dtype=np.float32), (at >= lo) & (at < lo + columns)
            table[row[here], at[here] - lo] = 1
            tables.append(table)
        total += np.rint(tables[0] @ tables[1].T).astype(np.int64)
    return total


def matches(a: tuple, b: tuple, same: bool, percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links between the sets of two blocks (or of one with itself): those that join their components, or ``every`` one."""
    (ids_a, size_a, sets_a, bits_a), (ids_b, size_b, sets_b, bits_b) = a, b
    if len(ids_a) * len(ids_b) <= FEW_PAIRS:
        x, y = size_a[:, None], size_b[None, :]
        left, right = np.nonzero(100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    else:
        left, right = candidate_pairs(size_a, bits_a, size_b, bits_b, percent)
    if every:
        if same:
            left, right = left[left < right], right[left < right]
        if len(left) > 1000:
            common = overlap_sizes(sets_a, sets_b)[left, right]
        else:
            common = np.array([overlap_size(sets_a[i], sets_b[j]) for i, j in zip(left.tolist(), right.tolist())], dtype=np.int64)
        kept = 100 * common >= percent * (size_a[left] + size_b[right] - common)
        return list(zip(ids_a[left[kept]].tolist(), ids_b[right[kept]].tolist()))
    joined, shift = UnionFind(len(ids_a) + (0 if same else len(ids_b))), 0 if same else len(ids_a)
    found = []
    for i, j in zip(left.tolist(), right.tolist()):
        if (same and j <= i) or joined.find(i) == joined.find(j + shift):
            continue
        common = overlap_size(sets_a[i], sets_b[j])
        if 100 * common >= percent * (len(sets_a[i]) + len(sets_b[j]) - common):
            joined.union(i, j + shift)
            found.append((int(ids_a[i]), int(ids_b[j])))
    return found


def _blocks(expand: Callable[[list[bytes]], list[np.ndarray]]):
    """One row per block of rows sorted by block: its node and all its sets."""
    schema = pa.schema([("block", pa.int64()), ("cluster", pa.int64()), ("least", pa.int32()), ("most", pa.int32()),
                        *[(n, pa.binary()) for n in ("any", "all", "sets", "sizes", "ids")]])

    def node(rows, zipped):
        packed = [r["elements"] for r in rows]
        size = np.array([r["size"] for r in rows], "<i8")
        bits = np.stack([r["bits"] for r in rows])
        return {
            "block": rows[0]["block"], "cluster": rows[0]["cluster"], "least": int(size.min()), "most": int(size.max()),
            "any": np.bitwise_or.reduce(bits).tobytes(), "all": np.bitwise_and.reduce(bits).tobytes(),
            # near copies share most elements, and a block goes to every pair that stays
            "sets": zipped.compress(b"".join(packed)),
            "sizes": np.array([len(p) for p in packed], "<i8").tobytes(), "ids": np.array([r["id"] for r in rows], "<i8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, zipped = [], zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, done = batch.slice(lo, 256).to_pylist(), []
                sets = expand([row["elements"] for row in part])
                for row, size, bits in zip(part, map(len, sets), bitmaps(sets)):
                    if rows and row["block"] == rows[0]["block"] and row["id"] == rows[-1]["id"]:
                        continue  # a repeated row; each set counts once
                    if rows and row["block"] != rows[0]["block"]:
                        done.append(node(rows, zipped))
                        rows = []
                    rows.append(row | {"size": size, "bits": bits})
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
        if rows:
            yield pa.RecordBatch.from_pylist([node(rows, zipped)], schema=schema)

    return run


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine the nodes of sorted rows (upper, ...) into one row per upper node."""
    held = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            bits = {k: np.frombuffer(row[k], np.uint64) for k in ("any", "all")}
            if held is None or row["upper"] != held["upper"]:
                if held:
                    out.append(held)
                held = row | bits
            else:
                held |= {"least": min(held["least"], row["least"]), "most": max(held["most"], row["most"]),
                         "any": held["any"] | bits["any"], "all": held["all"] & bits["all"]}
        if out:
            yield _upper_rows(out)
    if held:
        yield _upper_rows([held])


def _upper_rows(rows):
    schema = pa.schema([("upper", pa.int64()), ("cluster", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("any", pa.binary()), ("all", pa.binary())])
    return pa.RecordBatch.from_pylist([r | {"any": r["any"].tobytes(), "all": r["all"].tobytes()} for r in rows], schema=schema)


def _prune(key: str, percent: int):
    """Drop the node pairs whose bound is below the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = {k: np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                    for k in ("any_a", "all_a", "any_b", "all_b")}
            lost_a = np.bitwise_count(bits["all_a"] & ~bits["any_b"]).sum(1, dtype=np.int64)
            lost_b = np.bitwise_count(bits["all_b"] & ~bits["any_a"]).sum(1, dtype=np.int64)
            n = {k: batch.column(k).to_numpy().astype(np.int64) for k in ("least_a", "most_a", "least_b", "most_b")}
            kept = reachable(n["most_a"], n["most_b"], n["least_a"], n["least_b"], lost_a, lost_b, percent)
            kept |= batch.column(f"{key}_a").to_numpy() == batch.column(f"{key}_b").to_numpy()
            yield batch.select([f"{key}_a", f"{key}_b"]).filter(pa.array(kept))

    return run


def _side(nodes: DataFrame, side: str, *names: str) -> list[Column]:
    return [F.col(n).alias(f"{n}_{side}") for n in names]


def _pairs(nodes: DataFrame, key: str, percent: int, within: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b) with key_a <= key_b of node pairs that stay: of one cluster, or opened from pairs above."""
    names = (key, "least", "most", "any", "all")
    a, b = nodes.select("cluster", "parent", *_side(nodes, "a", *names)), nodes.select("cluster", "parent", *_side(nodes, "b", *names))
    sizes = F.expr(f"100L * most_a >= {percent} * least_b AND 100L * most_b >= {percent} * least_a")
    if within is None:
        both = a.drop("parent").join(b.drop("parent"), "cluster").where(F.col(f"{key}_a") <= F.col(f"{key}_b")).where(sizes)
    else:
        opened = within.join(a.drop("cluster").withColumnRenamed("parent", "upper_a"), "upper_a")
        both = opened.join(b.drop("cluster").withColumnRenamed("parent", "upper_b"), "upper_b")
        both = both.where((F.col(f"{key}_a") <= F.col(f"{key}_b")) & sizes)
    wanted = [f"{n}_{s}" for s in "ab" for n in names]
    return both.select(*wanted).mapInArrow(_prune(key, percent), f"{key}_a long, {key}_b long")


def _compare(percent: int, expand, output: str):
    def compared(rows: list[tuple], packed: dict[int, dict], known: dict[int, tuple]) -> dict[int, tuple]:
        """Unpack what the block pairs need and was not unpacked for the pairs before."""
        wanted = dict.fromkeys(block for pair in rows for block in pair)
        held = {block: known[block] for block in wanted if block in known}
        new = {x: tuple(packed[x][k] for k in ("sets", "sizes", "ids")) for x in wanted if x not in held}
        return held | _unpack(new, expand)

    def answers(rows: list[tuple], known: dict[int, tuple]):
        links = []
        for a, b in rows:
            own = matches(known[a], known[b], a == b, percent, output != "spanning")
            if own and output == "counts":
                yield _counted(np.array(own, dtype=np.int64))
            else:
                links += own
        if links:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packed, tile, rows, weight, held = {}, {}, None, [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for row in batch.slice(lo, 64).to_pylist():
                    if (row["upper_a"], row["upper_b"]) != tile:
                        tile = (row["upper_a"], row["upper_b"])
                        # most tiles are a pair or two, so several are unpacked at once
                        if not rows or weight > GATHERED or held > GATHERED_SETS:
                            if rows:
                                known = compared(rows, packed, known)
                                yield from answers(rows, known)
                            packed, rows, weight, held = {}, [], 0, 0
                    if row["block_b"] is None:
                        packed[row["block_a"]] = row
                        continue
                    rows.append((row["block_a"], row["block_b"]))
                    sets = [len(packed[x]["sizes"]) // 8 for x in rows[-1]]
                    weight, held = weight + sum(packed[x]["most"] * n for x, n in zip(rows[-1], sets)), held + sum(sets)
                    if weight > UNPACKED:
                        known = compared(rows, packed, known)
                        yield from answers(rows, known)
                        rows, weight, held = [], 0, 0
        if rows:
            yield from answers(rows, compared(rows, packed, known))

    return run


def _counted(links: np.ndarray) -> pa.RecordBatch:
    """(a, b, n): links that join the same components, without n, and the number of links of each id, without b."""
    ids, at = np.unique(links, return_inverse=True)
    at, joined = at.reshape(-1, 2), UnionFind(len(ids))
    kept = links[[joined.union(i, j) for i, j in at.tolist()]]
    n = np.bincount(at.ravel(), minlength=len(ids))
    return pa.record_batch([pa.array(np.concatenate([kept[:, 0], ids])), pa.array([*kept[:, 1].tolist(), *[None] * len(ids)], pa.int64()),
                            pa.array([*[None] * len(kept), *n.tolist()], pa.int64())], names=["a", "b", "n"])


def tree_links(sets: DataFrame, percent: int, scratch: Scratch, expand: Callable[[list[bytes]], list[np.ndarray]] = numbers,
               output: str = "spanning") -> DataFrame:
    """Links (a, b) that join all ids whose sets have 100 * overlap >= percent * union within a cluster.

    ``sets`` has block, cluster, id and elements, from which ``expand`` makes sorted distinct 64-bit
    numbers (packed numbers by default; a text may be shorter to move). No pair that reaches the threshold is left unlinked,
    directly or over other links. With ``output`` "every" all pairs that reach the threshold come, each once; with
    "counts" every pair is compared, and beside the joining links (n is null) come rows (a, n) without b, whose sum over a is
    the number of its links: no more rows than sets in the compared blocks.
    """
    ordered = sets.repartition("block").sortWithinPartitions("block", "id")
    nodes = scratch.keep(ordered.select("block", "cluster", "id", "elements").mapInArrow(_blocks(expand), _NODE))
    nodes = nodes.withColumn("parent", F.floor(F.col("block") / F.lit(HEIGHT)))
    narrow = nodes.select("block", "cluster", "least", "most", "any", "all", "parent")
    upper = (narrow.withColumnRenamed("parent", "upper").drop("block").repartition("upper").sortWithinPartitions("upper")
             .mapInArrow(_above, "upper long, cluster long, least int, most int, any binary, all binary").withColumn("parent", F.lit(0)))
    pairs = _pairs(narrow, "block", percent, within=_pairs(upper, "upper", percent))
    # a tile is a pair of upper nodes: a block goes there once, however many of the tile's pairs it is in
    tile = [F.floor(F.col(f"block_{s}") / F.lit(HEIGHT)).alias(f"upper_{s}") for s in "ab"]
    pairs = scratch.keep(pairs.select(*tile, "block_a", "block_b"))
    needed = pairs.select("upper_a", "upper_b", F.explode(F.array("block_a", "block_b")).alias("block")).distinct()
    content = ["most", "sets", "sizes", "ids"]
    placed = needed.join(nodes.select("block", *content), "block").withColumnRenamed("block", "block_a").withColumn("block_b", F.lit(None).cast("long"))
    none = {c: F.lit(None).cast(nodes.schema[c].dataType) for c in content}
    # a number of tasks that the few bytes of the tiles don't lower: each costs by its pairs
    n = max(2, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = placed.unionByName(pairs.withColumns(none)).repartition(n, "upper_a", "upper_b").sortWithinPartitions(
        "upper_a", "upper_b", F.col("block_b").isNotNull(), "block_b", "block_a")
    return both.mapInArrow(_compare(percent, expand, output), "a long, b long" + (", n long" if output == "counts" else ""))
