"""Approximate nearest neighbours by NN-descent: a neighbour graph from joins, searched greedily.

Equal vectors are one node. The graph starts from blocks of rows that lie close after sorting by
the sides of random hyperplanes. Each round of NN-descent ships the vectors of a node's neighbours and
reverse neighbours to the node, compares them with each other, and merges better neighbours into
their lists, until a round renews only a small share of their entries. A query starts at the neighbours of
its own node and expands its best unexpanded candidates, hop by hop, until all candidates that any query
keeps are expanded; what is left is scored exactly on the original vectors.

Vectors of very different norms are kept apart: a shell holds the nodes whose norms lie within a factor
of two, and has a graph of its own. Largest inner products become nearest neighbours in a shell by one extra
coordinate that gives all its vectors the same norm. A query enters its own shell at its node, every other one at the
best of some nodes taken by hash (all of a small shell), and keeps the best candidates of every shell
until the exact scores decide. Vectors travel as 8-bit codes with a scale each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickwarden.llm.arrays import mix
from clickwarden.llm.scratch import Scratch

_EDGE = "src long, dst long, score float"
_BITS = 24
#: Bits of the marks of a list; some 7.5 % of the unlisted ids look listed, others in each round.
_MARKS = 512


@dataclass(frozen=True)
class Settings:
    neighbours: int = 40  # of each node in the graph
    reverse: int = 24  # nodes taken of those that name it, by hash
    trees: int = 32
    block: int = 256  # rows compared with each other at the start
    seeds: int = 6  # taken of each of these blocks by each row
    settled: float = 0.005  # share of list entries; a round that renews fewer is the last
    offers: int = 4  # of each pair of lists, to each node and round
    expand: int = 40  # candidates opened in a hop; hops follow until none is left to open
    search_reverse: int = 40  # as reverse, for the search
    beam: int = 64  # candidates kept of each shell, and scored exactly; 3 times the rows asked for if that is more
    doors: int = 4096  # nodes of a shell, about, at which queries of other shells can enter; 65,536 in all


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and some not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _level(vector: Column) -> Column:
    """Binary logarithm of the norm, of numbers that could not be squared, too."""
    largest = F.array_max(F.transform(vector, F.abs))
    return F.log2(largest) + F.log2(F.aggregate(F.transform(vector, lambda x: x / largest), F.lit(0.0), lambda s, x: s + x * x)) / 2


def _codes(top: float):
    """The vector over the largest norm of its shell, with the coordinate that completes it to norm 1: a 4-byte scale and 8-bit parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, shell = _matrix(batch.column("vector")), batch.column("shell").to_numpy()
            largest = np.abs(x).max(1)
            x = x / largest[:, None] * np.exp2(np.log2(largest) - (top - shell))[:, None]
            x = np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))])
            scale = (np.abs(x).max(1) / 127).astype(np.float32)
            code = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
            packed = [s.tobytes() + c.tobytes() for s, c in zip(scale, code)]
            yield pa.record_batch([batch.column("node"), batch.column("shell"), pa.array(packed, pa.binary())], names=["node", "shell", "code"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _decode(column: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)
    return packed[:, 4:] * np.ascontiguousarray(packed[:, :4]).view(np.float32)


def _sides(trees: int):
    """(tree of a shell, side bits, node, code): rows near each other mostly agree in their first bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, shell = _decode(batch.column("code"))[:, :-1], batch.column("shell").to_numpy()
            planes = np.random.default_rng(11).normal(size=(trees, x.shape[1], _BITS)).astype(np.float32)
            for tree in range(trees):
                bits = (x @ planes[tree] > 0) @ (1 << np.arange(_BITS)[::-1])
                yield pa.record_batch([pa.array((shell * trees + tree).astype(np.int32)), pa.array(bits.astype(np.int64)), batch.column("node"), batch.column("code")],
                                      names=["tree", "bits", "node", "code"])

    return run


def _best(score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` largest entries of every row; -inf is no entry."""
    most = min(most, score.shape[1])
    at = np.argpartition(-score, most - 1, axis=1)[:, :most]
    rows = np.repeat(np.arange(len(score)), most)
    at = at.ravel()
    kept = score[rows, at] > -np.inf
    return rows[kept], at[kept]


def _edges(found: list) -> pa.RecordBatch:
    src, dst, score = (np.concatenate(x) for x in zip(*found))
    return pa.record_batch([pa.array(src), pa.array(dst), pa.array(score.astype(np.float32))], names=["src", "dst", "score"])


def _start(block: int, most: int):
    """Each row's best of every ``block`` neighbouring rows of its tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, codes = None, [], []

        def compared():
            x, own = np.concatenate(codes), np.concatenate(ids)
            score = x @ x.T
            np.fill_diagonal(score, -np.inf)
            r, c = _best(score, most)
            return own[r], own[c], score[r, c]

        for batch in batches:
            found, trees, nodes = [], batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            x = _decode(batch.column("code")) if batch.num_rows else None
            lo = 0
            while lo < batch.num_rows:
                if codes and (trees[lo] != tree or sum(map(len, ids)) >= block):
                    found.append(compared())
                    ids, codes = [], []
                tree = trees[lo]
                hi = min(lo + block - sum(map(len, ids)), lo + int(np.searchsorted(trees[lo:], tree, side="right")))
                ids.append(nodes[lo:hi])
                codes.append(x[lo:hi])
                lo = hi
            if found:
                yield _edges(found)
        if codes:
            yield _edges([compared()])

    return run


def _local_join(offers: int, turn: int):
    """Compare the listed neighbours of each node with each other; offer those better than a list's last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _groups(batches, "node", lambda g: _offers(g, offers, turn)):
            yield _edges(found)

    return run


def _slot(ids: np.ndarray, turn: int) -> np.ndarray:
    """Bit of each id in the marks of a list, another one in each round."""
    salt = np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(ids.astype(np.uint64) ^ salt) >> np.uint64(40)).astype(np.int64) % _MARKS


def _summary(full: int, turn: int):
    """Of each node's list the score to beat, and marks that tell most ids that are not in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.zeros((batch.num_rows, _MARKS), dtype=bool)
            sizes = batch.column("size").to_numpy()
            bits[np.repeat(np.arange(batch.num_rows), sizes), _slot(batch.column("listed").flatten().to_numpy(), turn)] = True
            last = np.where(sizes >= full, batch.column("least").to_numpy(), -np.inf).astype(np.float32)
            yield pa.record_batch([batch.column("src"), pa.array(last), pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())],
                                  names=["dst", "last", "marks"])

    return run


def _offers(group: dict, offers: int, turn: int):
    x, own = _decode(group["code"]), group["dst"].to_numpy()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    marks = np.unpackbits(np.frombuffer(b"".join(group["marks"].to_pylist()), np.uint8).reshape(len(own), -1), axis=1).astype(bool)
    score[marks[:, _slot(own, turn)] | (score <= group["last"].to_numpy()[:, None])] = -np.inf
    r, c = _best(score, offers)
    return own[r], own[c], score[r, c]


def _groups(batches: Iterator[pa.RecordBatch], key: str, work):
    """Apply ``work`` to the columns of every run of equal ``key``; results come in lists of some thousand rows."""
    waiting, found, rows = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches(([waiting] if waiting is not None else []) + [batch]).combine_chunks().to_batches()[0]
        keys = batch.column(key).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        for a, b in zip(cuts, cuts[1:]):
            out = work({n: batch.column(n)[a:b] for n in batch.schema.names})
            if len(out[0]):
                found.append(out)
                rows += len(out[0])
            if rows > 50_000:
                yield found
                found, rows = [], 0
        waiting = batch.slice(cuts[-1])
    if waiting is not None:
        out = work({n: waiting.column(n) for n in waiting.schema.names})
        if len(out[0]):
            found.append(out)
    if found:
        yield found


def _top(edges: DataFrame, most: int, key: str = "src") -> DataFrame:
    """The best ``most`` of each key, each named once; ties go to the smaller id. ``fresh`` if no row says it is not."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "dst")
    once = edges.groupBy(key, "dst").agg(F.max("score").alias("score"), *([F.min("fresh").alias("fresh")] if "fresh" in edges.columns else []))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _both_ways(graph: DataFrame, reverse: int, turn: int) -> DataFrame:
    """(node, dst): each node's list, and some of the nodes that list it."""
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "dst", F.lit(turn)), "dst")
    back = graph.select(F.col("dst").alias("node"), F.col("src").alias("dst"))
    back = back.withColumn("place", F.row_number().over(order)).where(F.col("place") <= reverse).drop("place")
    return graph.select(F.col("src").alias("node"), "dst").unionByName(back).distinct()


def neighbour_graph(codes: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """(src, dst, score, place) of each node's neighbours after NN-descent, kept as a table."""
    n = max(2, int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sided = codes.mapInArrow(_sides(settings.trees), "tree int, bits long, node long, code binary")
    near = sided.repartitionByRange(n, "tree", "bits", "node").sortWithinPartitions("tree", "bits", "node")
    graph = scratch.keep(_top(near.mapInArrow(_start(settings.block, settings.seeds), _EDGE), settings.neighbours))
    turn = 0
    while True:
        lists = graph.groupBy("src").agg(F.count("*").cast("int").alias("size"), F.min("score").alias("least"), F.collect_list("dst").alias("listed"))
        known = lists.mapInArrow(_summary(settings.neighbours, turn), "dst long, last float, marks binary")
        known = codes.select(F.col("node").alias("dst"), "code").join(known, "dst")
        listed = _both_ways(graph, settings.reverse, turn).join(known, "dst").select("node", "dst", "code", "last", "marks")
        offered = listed.repartition("node").sortWithinPartitions("node", "dst").mapInArrow(_local_join(settings.offers, turn), _EDGE)
        offered = offered.withColumn("fresh", F.lit(1)).unionByName(graph.select("src", "dst", "score", F.lit(0).alias("fresh")))
        better = scratch.keep(_top(offered, settings.neighbours))
        scratch.free(graph)
        graph, turn = better, turn + 1
        entries = better.agg(F.count("*").alias("n"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh")).first()
        if entries.fresh <= settings.settled * entries.n:
            return graph


def _asked(code: np.ndarray) -> np.ndarray:
    """Codes as queries: without the extra coordinate, products are inner products up to a factor of the query and the shell."""
    asked = code.copy()
    asked[:, -1] = 0
    return asked


def _score_codes(group: dict):
    """Scores of a query's candidates by codes; the query's own row has no candidate."""
    x, dst = _decode(group["code"]), group["dst"].to_pylist()
    at = dst.index(None)
    kept = np.array([i for i in range(len(dst)) if i != at], dtype=np.int64)
    return group["query"].to_numpy()[kept], group["shell"].to_numpy()[kept], group["dst"].take(pa.array(kept)).to_numpy(), x[kept] @ _asked(x[at : at + 1])[0]


_CANDIDATE = "query long, shell int, dst long, score float"


def _candidates(found: list) -> pa.RecordBatch:
    query, shell, dst, score = (np.concatenate(x) for x in zip(*found))
    return pa.record_batch([pa.array(query), pa.array(shell.astype(np.int32)), pa.array(dst.astype(np.int64)), pa.array(score.astype(np.float32))],
                           names=["query", "shell", "dst", "score"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _groups(batches, "query", _score_codes):
        yield _candidates(found)


def _entered(doors: dict[int, tuple[list[int], list[bytes]]], most: int):
    """The best doors of every shell but its own for each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {shell: (np.array(ids), _decode(pa.array(codes, pa.binary()))) for shell, (ids, codes) in doors.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                own, query, home = _asked(_decode(part.column("code"))), part.column("node").to_numpy(), part.column("shell").to_numpy()
                for shell, (ids, x) in known.items():
                    away = np.flatnonzero(home != shell)
                    if len(away):
                        score = own[away] @ x.T
                        r, c = _best(score, most)
                        yield _candidates([(query[away][r], np.full(len(r), shell), ids[c], score[r, c])])

    return run


def _doors(codes: DataFrame, sizes: dict[int, int], settings: Settings) -> dict[int, tuple[list[int], list[bytes]]]:
    """Some nodes of each shell, by hash; all of one that has no more than are wanted."""
    wanted = max(64, min(settings.doors, 65_536 // len(sizes)))
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for shell, n in sizes.items() for x in (shell, million if n <= wanted else max(1, wanted * million // n))])
    chosen = codes.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(million)) < share[F.col("shell")])
    doors: dict[int, tuple[list[int], list[bytes]]] = {}
    for row in chosen.select("shell", "node", "code").toLocalIterator():
        ids, packed = doors.setdefault(row.shell, ([], []))
        ids.append(row.node)
        packed.append(bytes(row.code))
    return doors


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            score = (_matrix(batch.column("a")) * _matrix(batch.column("b"))).sum(1)
            yield pa.record_batch([batch.column("query"), batch.column("node"), pa.array(score)], names=["query", "node", "score"])


def nearest_neighbours(vectors: DataFrame, query_filter: Column, most: int = 20, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``most`` largest inner products found for each query, among all other rows.

    ``vectors`` has vec_id and embedding; ``query_filter`` tells the queries. Null or zero vectors,
    those with null or non-finite components, those of another length than most have, and
    rows without vec_id take no part; of rows that repeat a vec_id one does. Scores are double
    precision on the original vectors, equal scores go to the smaller vec_id. Equal vectors are one
    node and are all found with it; any norms are allowed. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(query_filter, F.lit(False)).alias("asks"))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (length.d if length else 0)).dropDuplicates(["vec_id"])
    keyed = scratch.keep(rows.withColumns({"key": F.xxhash64("vector"), "check": F.hash("vector")}))
    same = ["key", "check"]
    nodes = scratch.keep(keyed.groupBy(*same).agg(F.min("vec_id").alias("node"), F.min_by("vector", "vec_id").alias("vector"))
                         .withColumn("level", _level(F.col("vector"))))
    # a little above the largest, so that vectors of one norm share a shell
    top = (nodes.agg(F.max("level")).first()[0] or 0.0) + 1e-6
    nodes = nodes.withColumn("shell", F.floor(F.lit(top) - F.col("level")).cast("int"))
    # one member more than asked for, since a query is not its own neighbour
    order = Window.partitionBy(*same).orderBy("vec_id")
    members = keyed.select("vec_id", *same).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
    members = members.join(nodes.select(*same, "node"), same).select("node", "vec_id")
    asking = scratch.keep(keyed.where("asks").select("vec_id", *same).join(nodes.select(*same, "node"), same).select(F.col("vec_id").alias("query"), "node"))

    beam = max(settings.beam, 3 * most)
    codes = scratch.keep(nodes.select("node", "shell", "vector").mapInArrow(_codes(top), "node long, shell int, code binary"))
    sizes = {r.shell: r["count"] for r in codes.groupBy("shell").count().collect()}
    graph = neighbour_graph(codes, settings, scratch)

    # queries with one vector have one search
    starts = asking.select(F.col("node").alias("query")).distinct()
    ways = scratch.keep(_both_ways(graph, settings.search_reverse, -1))
    entered = None
    if len(sizes) > 1:
        entered = starts.join(codes, F.col("query") == F.col("node")).select("node", "shell", "code")
        entered = entered.mapInArrow(_entered(_doors(codes, sizes, settings), settings.expand), _CANDIDATE).withColumn("open", F.lit(False))
    found = None
    while found is None or not found.where(~F.col("open")).isEmpty():
        if found is None:
            opened = starts.select("query", F.col("query").alias("node"))
        else:
            opened = found.where(~F.col("open") & (F.col("turn") <= settings.expand)).select("query", F.col("dst").alias("node"))
        reached = opened.join(ways, "node").where(F.col("dst") != F.col("query")).select("query", "dst").distinct()
        if found is not None:
            reached = reached.join(found.select("query", "dst"), ["query", "dst"], "left_anti")
        listed = reached.join(codes.withColumnRenamed("node", "dst"), "dst").select("query", "shell", "dst", "code")
        listed = listed.unionByName(starts.join(codes, F.col("query") == F.col("node")).select("query", "shell", F.lit(None).cast("long").alias("dst"), "code"))
        scored = listed.repartition("query").sortWithinPartitions("query", "dst").mapInArrow(_scored, _CANDIDATE)
        scored = scored.withColumn("open", F.lit(False))
        if found is not None:
            opened = F.col("open") | (F.col("turn") <= settings.expand)
            scored = scored.unionByName(found.select("query", "shell", "dst", "score", opened.alias("open")))
        elif entered is not None:
            scored = scored.unionByName(entered)
        rank = Window.partitionBy("query", "shell").orderBy(F.desc("score"), "dst")
        before = found
        # the place among all, and among those not opened
        scored = scored.withColumns({"place": F.row_number().over(rank), "turn": F.sum((~F.col("open")).cast("int")).over(rank)})
        found = scratch.keep(scored.where(F.col("place") <= beam))
        if before is not None:
            scratch.free(before)

    vector = nodes.select("node", "vector")
    pairs = found.select("query", F.col("dst").alias("node")).unionByName(starts.select("query", F.col("query").alias("node")))
    pairs = pairs.join(vector.withColumnRenamed("vector", "b"), "node").join(vector.select(F.col("node").alias("query"), F.col("vector").alias("a")), "query")
    exact = pairs.mapInArrow(_exact, "query long, node long, score double")
    # of the nodes at equal rank at most ``most`` + 1 members can matter; so few nodes can, too
    best = Window.partitionBy("node_of").orderBy(F.desc("score"), "node")
    exact = exact.withColumnRenamed("query", "node_of").withColumn("place", F.row_number().over(best)).where(F.col("place") <= beam)
    listed = exact.join(members, "node").join(asking.select(F.col("query").alias("query_id"), F.col("node").alias("node_of")), "node_of")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    listed = listed.where("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= most)
    return listed.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {"op4_nearest": op4_nearest}
SQL: dict[str, str] = {}
