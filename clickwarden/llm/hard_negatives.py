"""Hard negatives by exact window search in a GNAT over all vectors.

A tree grown from a bounded sample routes every row to a leaf; one pass over all rows gives the ranges of the
tree, so elimination is exact for rows outside the sample as well. Leaves are cut into blocks of
bounded size, and each task grows a deeper tree over a block. An anchor searches twice for positives and twice for
negatives: first in the few leaves nearest to the annulus, then, with the bound that these results give, in
all leaves whose distance range still meets the annulus. What is found in a leaf is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickwarden.llm.gnat import Tree, lift
from clickwarden.llm.scratch import Scratch

#: Scores have to fit 64 bits.
NORM_LIMIT = 2.0 ** 31
_ANY = 1 << 62
_QUERY = {"id": "long", "label": "int", "vec": "array<bigint>", "lows": "array<bigint>", "highs": "array<bigint>"}
_FOUND = "anchor_id long, slot int, vec_id long, score long"


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    low_percent: int = 30  # window of a negative's score, in percent of the positive's
    high_percent: int = 90
    scale: int = 256
    arity: int = 16
    sample_bytes: int = 16 << 20  # of the rows the tree grows from
    leaf_rows: int = 2048
    most_leaves: int = 4096
    block_bytes: int = 8 << 20  # of vectors that a task holds at once
    inner_leaf: int = 512
    probe: int = 2  # leaves of the first search
    group: int = 64  # queries scored together


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = values
    return out


def _lists(column: pa.Array) -> np.ndarray:
    return _matrix(column, int(np.diff(column.offsets.to_numpy()).max(initial=0)))


def _annulus(vectors: np.ndarray, lows: np.ndarray, highs: np.ndarray, norm2: float) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance of points whose inner product with a query lies in each of its windows."""
    base = np.einsum("ij,ij->i", vectors, vectors)[:, None] + norm2
    near = np.sqrt(np.maximum(base - 2.0 * highs, 0))
    far = np.sqrt(np.maximum(base - 2.0 * lows, 0))
    # an empty window meets nothing
    return np.where(lows > highs, np.inf, near), np.where(lows > highs, -np.inf, far)


def _meets(low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which leaves (columns) can hold a point of any window of a query (rows)."""
    out = np.zeros(low.shape, dtype=bool)
    for slot in range(near.shape[1]):
        out |= (low <= far[:, slot, None]) & (high >= near[:, slot, None])
    return out


def _probed(low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` leaves nearest to the inner border of a query's first window."""
    meets = _meets(low, high, near, far)
    gap = np.where(meets, np.maximum(low - near[:, :1], 0) + 1e-9 * low, np.inf)
    chosen = np.argsort(gap, axis=1, kind="stable")[:, :count]
    out = np.zeros(low.shape, dtype=bool)
    np.put_along_axis(out, chosen, True, axis=1)
    return out & meets


def _placed(tree, dim: int, norm2: float, probe: int, probing: bool):
    """Add to each query the leaves to search: with ``probing`` the nearest, else all that its windows may meet but those."""
    slack = 1e-6 * np.sqrt(norm2) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vectors = _matrix(batch.column("vec"), dim).astype(np.float64)
                low, high = tree.value.bounds(np.column_stack([vectors, np.zeros(len(vectors))]), slack)
                near, far = _annulus(vectors, _lists(batch.column("lows")), _lists(batch.column("highs")), norm2)
                if probing:
                    go = _probed(low, high, near - slack, far + slack, probe)
                else:
                    go = _meets(low, high, near - slack, far + slack)
                    for row, leaves in enumerate(batch.column("probed").to_pylist()):
                        go[row, leaves] = False
                leaves = pa.array([np.flatnonzero(g) for g in go], pa.list_(pa.int32()))
                name = "probed" if probing else "leaves"
                yield pa.record_batch([*(batch.column(c) for c in _QUERY), leaves], names=[*_QUERY, name])

    return place


class _Block:
    """Rows of one block under a tree of their own."""

    def __init__(self, ids, labels, vectors, norm2: float, settings: Settings):
        points = lift(vectors.astype(np.float64), norm2)
        step = max(1, len(points) // 4096)
        self.tree = Tree.grow(points[::step], settings.arity, max(settings.inner_leaf // step, 1))
        leaf = self.tree.route(points)
        self.tree.widen(self.tree.ranges, points, leaf)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.edges = np.searchsorted(leaf[order], np.arange(max(self.tree.leaves, 1) + 1))
        self.norm2, self.slack = norm2, 1e-6 * np.sqrt(norm2) + 1e-9

    def search(self, ids, labels, vectors, lows, highs, same_label: bool, count: int):
        """The best ``count`` rows of each query and window as arrays (query, slot, row, score)."""
        wide = vectors.astype(np.float64)
        low, high = self.tree.bounds(np.column_stack([wide, np.zeros(len(wide))]), self.slack)
        near, far = _annulus(wide, lows, highs, self.norm2)
        go = _meets(low, high, near - self.slack, far + self.slack)
        # double sums of integers are exact below 2^53
        exact = np.abs(self.vectors).max(initial=0) * float(np.abs(vectors).max(initial=0)) * max(vectors.shape[1], 1) < 2.0 ** 52
        scores = np.full((len(ids), len(self.ids)), -_ANY - 1, dtype=np.int64)
        for leaf in np.flatnonzero(go.any(axis=0)):
            lo, hi = self.edges[leaf], self.edges[leaf + 1]
            here = np.flatnonzero(go[:, leaf])
            rows = self.vectors[lo:hi]
            product = (wide[here] @ rows.T.astype(np.float64)) if exact else vectors[here] @ rows.T
            scores[here, lo:hi] = np.rint(product).astype(np.int64) if exact else product
        found = []
        for q in range(len(ids)):
            fits = (self.labels == labels[q]) & (self.ids != ids[q]) if same_label else self.labels != labels[q]
            rows = np.flatnonzero(fits & (scores[q] >= lows[q].min(initial=_ANY)) & (scores[q] <= highs[q].max(initial=-_ANY)))
            if not len(rows):
                continue
            rows = rows[np.lexsort((self.ids[rows], -scores[q][rows]))]
            own = scores[q][rows]
            for slot in range(lows.shape[1]):
                # sorted by falling score: a window is one stretch
                start = np.searchsorted(-own, -highs[q, slot], side="left")
                stop = np.searchsorted(-own, -lows[q, slot], side="right")
                found += [(q, slot, r) for r in rows[start: min(stop, start + count)]]
        if not found:
            return None
        q, slot, r = (np.array(c) for c in zip(*found))
        return ids[q], slot, self.ids[r], scores[q, r]


def _search_blocks(dim: int, norm2: float, same_label: bool, count: int, settings: Settings):
    """Rows of a block come before its queries, so a task holds one block and streams the queries past it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "block", "kind")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if batch.num_rows else []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                leaf, number, kind = keys[:, lo]
                if (leaf, number) != current:
                    current, parts, block = (leaf, number), [], None
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                vectors = _matrix(part.column("vec"), dim)
                if kind == 0:
                    parts.append((ids, labels, vectors))
                    continue
                if not parts:
                    continue
                if block is None:
                    block = _Block(*(np.concatenate(c) for c in zip(*parts)), norm2, settings)
                lows, highs = _lists(part.column("lows")), _lists(part.column("highs"))
                for at in range(0, len(ids), settings.group):
                    s = slice(at, at + settings.group)
                    out = block.search(ids[s], labels[s], vectors[s], lows[s], highs[s], same_label, count)
                    if out:
                        yield pa.record_batch([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2]),
                                               pa.array(out[3])], names=["anchor_id", "slot", "vec_id", "score"])

    return search


class _Index:
    """All rows by leaf and block, with the tree and its ranges in a broadcast of bounded size."""

    def __init__(self, rows: DataFrame, scratch: Scratch, settings: Settings):
        self.spark, self.scratch, self.settings = rows.sparkSession, scratch, settings
        self.tree = None
        stats = rows.agg(F.count("*"), F.max("norm2"), F.max(F.size("vec"))).first()
        self.count, self.norm2, self.dim = stats[0], float(stats[1] or 0), stats[2] or 0
        if not self.count:
            return
        bound = max(256, settings.sample_bytes // (8 * (self.dim + 1)))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec").limit(bound).toArrow().column("vec")
        sample = lift(_matrix(sample.combine_chunks(), self.dim).astype(np.float64), self.norm2)
        leaf_rows = max(settings.leaf_rows, self.count / settings.most_leaves)
        grown = Tree.grow(sample, settings.arity, max(4, int(leaf_rows * len(sample) / self.count)))
        plain = self.spark.sparkContext.broadcast(grown)
        dim, norm2 = self.dim, self.norm2

        def route(batches):
            for batch in batches:
                leaf = plain.value.route(lift(_matrix(batch.column("vec"), dim).astype(np.float64), norm2))
                yield pa.record_batch([pa.array(leaf.astype(np.int32)), *batch.columns], names=["leaf", "id", "label", "vec"])

        self.rows = scratch.keep(rows.select(F.col("vec_id").alias("id"), "label", "vec").mapInArrow(
            route, "leaf int, id long, label int, vec array<bigint>"))

        def widen(batches):
            ranges = plain.value.no_ranges()
            for batch in batches:
                points = lift(_matrix(batch.column("vec"), dim).astype(np.float64), norm2)
                plain.value.widen(ranges, points, batch.column("leaf").to_numpy())
            for at, (low, high) in enumerate(ranges):
                cell = np.flatnonzero(np.isfinite(low.ravel()))
                yield pa.record_batch([pa.array(np.full(len(cell), at)), pa.array(cell), pa.array(low.ravel()[cell]),
                                       pa.array(high.ravel()[cell])], names=["node", "cell", "low", "high"])

        cells = self.rows.select("leaf", "vec").mapInArrow(widen, "node long, cell long, low double, high double")
        for cell in cells.groupBy("node", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            for side, value in enumerate((cell.low, cell.high)):
                grown.ranges[cell.node][side].ravel()[cell.cell] = value
        plain.destroy()
        self.tree = self.spark.sparkContext.broadcast(grown)
        block_rows = max(256, settings.block_bytes // (8 * (self.dim + 1)))
        # as many rows as the tree has leaves
        self.blocks = scratch.keep(self.rows.groupBy("leaf").agg(
            F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks")))
        self.tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.count // block_rows + 1)

    def _place(self, queries: DataFrame, added: str) -> DataFrame:
        schema = ", ".join(f"{name} {kind}" for name, kind in _QUERY.items()) + f", {added} array<int>"
        return queries.mapInArrow(_placed(self.tree, self.dim, self.norm2, self.settings.probe, added == "probed"), schema)

    def probed(self, queries: DataFrame) -> DataFrame:
        """Queries with the leaves of their first search, stored, so that the second leaves out just these."""
        return self.scratch.keep(self._place(queries, "probed"))

    def first(self, queries: DataFrame, same_label: bool, count: int) -> DataFrame:
        """The best rows of each query's windows in its probed leaves."""
        return self.scratch.keep(self._search(queries.withColumnRenamed("probed", "leaves"), same_label, count))

    def rest(self, queries: DataFrame, same_label: bool, count: int) -> DataFrame:
        """The best rows of each query's windows in all leaves that may hold one, but the probed."""
        return self._search(self._place(queries, "leaves"), same_label, count)

    def _search(self, queries: DataFrame, same_label: bool, count: int) -> DataFrame:
        blocks = F.broadcast(self.blocks)
        sent = queries.withColumn("leaf", F.explode("leaves")).join(blocks, "leaf")
        sent = sent.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "kind": F.lit(1)})
        rows = self.rows.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        none = F.lit(None).cast("array<bigint>")
        rows = rows.withColumns({"kind": F.lit(0), "lows": none, "highs": none})
        names = ["leaf", "block", "kind", *_QUERY]
        both = rows.select(*names).unionByName(sent.select(*names)).repartition(self.tasks, "leaf", "block")
        found = both.sortWithinPartitions("leaf", "block", "kind").mapInArrow(
            _search_blocks(self.dim, self.norm2, same_label, count, self.settings), _FOUND)
        return _best(found, count)


def _best(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def prepared_vectors(embeddings: DataFrame, settings: Settings, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """vec_id, label, vec (scaled integers), norm2 of the rows that take part, one per id."""
    x = F.col(f"`{vector_column}`").cast("array<double>")
    rows = embeddings.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"),
                             F.col(f"`{label_column}`").cast("int").alias("label"), x.alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < NORM_LIMIT / settings.scale)))
    rows = rows.withColumn("vec", F.transform("x", lambda v: F.floor(v * settings.scale).cast("long")))
    square = F.aggregate("vec", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    rows = rows.withColumn("norm2", square).where(F.col("norm2") < NORM_LIMIT ** 2)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "norm2")).alias("row"))
    return one.select("vec_id", "row.label", "row.vec", "row.norm2")


def mine_hard_negatives(embeddings: DataFrame, anchor_every: int = 100, relabel_every: int | None = None, classes: int = 10,
                        settings: Settings = Settings(), id_column: str = "vec_id", vector_column: str = "embedding",
                        label_column: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``anchor_every``; with ``relabel_every`` the rows whose id it divides
    first get the label (label + 1) % ``classes``. Scores are inner products of the vectors floor(scale * x), ties go to
    the smaller id. Rows with a null id, label, vector or component or a component that isn't finite take no part,
    nor do vectors of a scaled norm of 2^31 or more, whose scores don't fit 64 bits. Rows that repeat an id count once,
    the one of the smallest label, then vector. Vectors of several lengths meet as if padded with zeros. An anchor
    without another row of its label has no result. Other columns are ignored. An empty table gives an empty result.
    """
    s = settings
    scratch = Scratch(embeddings.sparkSession, "negatives")
    rows = prepared_vectors(embeddings, s, id_column, vector_column, label_column)
    if relabel_every:
        shifted = F.pmod(F.col("label") + 1, F.lit(classes)).cast("int")
        rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel_every == 0, shifted).otherwise(F.col("label")))
    rows = scratch.keep(rows)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).select(F.col("vec_id").alias("id"), "label", "vec")
    # of equal vectors of one label only the smallest ids can be among the first of any list
    order = Window.partitionBy("label", "vec").orderBy("vec_id")
    wanted = max(s.positives + 1, s.negatives)
    candidates = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= wanted).drop("n")
    candidates = scratch.keep(candidates)
    index = _Index(candidates, scratch, s)
    if not index.count:
        return embeddings.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def limits(found: DataFrame, count: int) -> DataFrame:
        return found.where(F.col("rank") == count).select("anchor_id", "slot", F.col("score").alias("limit"))

    # positives: first the nearest leaves, then all that may hold something as good as the last of these
    queries = index.probed(anchors.withColumns({"lows": F.array(F.lit(-_ANY)), "highs": F.array(F.lit(_ANY))}))
    first = index.first(queries, True, s.positives)
    bounded = queries.join(limits(first, s.positives).select(F.col("anchor_id").alias("id"), "limit"), "id", "left")
    bounded = bounded.withColumn("lows", F.array(F.coalesce("limit", F.lit(-_ANY)))).drop("limit")
    rest = index.rest(bounded, True, s.positives)
    positives = scratch.keep(_best(first.drop("rank").unionByName(rest.drop("rank")), s.positives).select(
        "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # negatives: one window of scores for each positive
    percent = F.col("positive_score").cast("decimal(20,0)") / F.lit(100)
    windows = positives.select("anchor_id", "slot", F.ceil(percent * s.low_percent).cast("long").alias("low"),
                               F.floor(percent * s.high_percent).cast("long").alias("high"))
    by_anchor = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))
    queries = index.probed(anchors.join(by_anchor.select(
        F.col("anchor_id").alias("id"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "id"))
    first = index.first(queries, False, s.negatives)
    limit = limits(first, s.negatives).groupBy(F.col("anchor_id").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "limit"))).alias("limits"))
    bounded = queries.join(limit, "id", "left").withColumn(
        "lows", F.transform("lows", lambda v, i: F.greatest(v, F.coalesce(F.element_at("limits", i), v)))).drop("limits")
    rest = index.rest(bounded, False, s.negatives)
    negatives = _best(first.drop("rank").unionByName(rest.drop("rank")), s.negatives)
    result = scratch.keep(negatives.join(positives, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")))
    scratch.free_others(result)
    return result


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all others."""
    return mine_hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), relabel_every=7)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {"op12_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 10
"""}
