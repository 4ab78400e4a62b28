"""Site graph: edges, nodes, depths and hop distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import NO_PATH_HOPS, ROOT_PATH
from ..functions.paths import path_category
from ..session import checkpointed


def read_edges(df: DataFrame) -> DataFrame:
    """Distinct edges of a stored edge list; weight 1 when none is stored."""
    missing = sorted({"source", "target"} - set(df.columns))
    if missing:
        raise ValueError(f"edges lack columns: {missing}")
    weight = F.col("weight").cast("bigint") if "weight" in df.columns else F.lit(1).cast("bigint")
    return df.groupBy("source", "target").agg(F.max(weight).alias("weight"))


def read_categories(df: DataFrame) -> DataFrame:
    missing = sorted({"path", "category"} - set(df.columns))
    if missing:
        raise ValueError(f"categories lack columns: {missing}")
    return df.groupBy("path").agg(F.max("category").alias("category"))


def graph_edges(events: DataFrame, use_referrers: bool = True) -> DataFrame:
    """Weighted page transitions, with one more count for each site referrer of another page."""
    edge = lambda source: F.struct(F.col(source).alias("source"), F.col("path").alias("target"))
    steps = [F.when(F.col("seq") > 1, edge("prev_path"))]
    if use_referrers:
        on_site = F.col("referrer").startswith("/") & (F.col("referrer") != F.col("path"))
        steps.append(F.when(on_site, edge("referrer")))
    return (
        events.select(F.explode(F.array_compact(F.array(*steps))).alias("edge"))
        .select("edge.*")
        .groupBy("source", "target")
        .agg(F.count("*").alias("weight"))
    )


def node_degrees(edges: DataFrame, root: str = ROOT_PATH) -> DataFrame:
    """In- and out-degree of every endpoint and of the root."""
    end = lambda name, outgoing: F.struct(
        F.col(name).alias("path"), F.lit(outgoing).alias("out"), F.lit(1 - outgoing).alias("in")
    )
    ends = edges.select(F.explode(F.array(end("source", 1), end("target", 0))).alias("end")).select("end.*")
    root_row = edges.sparkSession.range(1).select(F.lit(root).alias("path"), F.lit(0).alias("out"), F.lit(0).alias("in"))
    return ends.unionByName(root_row).groupBy("path").agg(
        F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree")
    )


def bfs_depths(edges: DataFrame, root: str = ROOT_PATH) -> DataFrame:
    """Hops from the root to every page it reaches, one round of joins per depth."""
    links = checkpointed(edges.select("source", "target"))
    reached = checkpointed(
        edges.sparkSession.range(1).select(F.lit(root).alias("path"), F.lit(0).alias("depth"))
    )
    depth = 0
    while True:
        frontier = reached.where(F.col("depth") == depth)
        found = (
            links.join(frontier, links["source"] == frontier["path"], "left_semi")
            .select(F.col("target").alias("path"))
            .distinct()
            .join(reached, "path", "left_anti")
            .withColumn("depth", F.lit(depth + 1))
        )
        found = checkpointed(found)
        if found.isEmpty():
            return reached
        reached = reached.unionByName(found)
        depth += 1


def graph_nodes(edges: DataFrame, categories: DataFrame | None = None, root: str = ROOT_PATH) -> DataFrame:
    """Nodes with category, depth (-1 when unreached), degrees and leaf flag."""
    edges = checkpointed(edges.select("source", "target"))
    nodes = node_degrees(edges, root).join(bfs_depths(edges, root), "path", "left")
    category = path_category(F.col("path"))
    if categories is not None:
        stored = categories.withColumnRenamed("category", "_category")
        nodes = nodes.join(stored, "path", "left")
        category = F.coalesce("_category", category)
    return nodes.select(
        "path",
        category.alias("category"),
        F.coalesce("depth", F.lit(-1)).alias("depth"),
        "in_degree",
        "out_degree",
        (F.col("out_degree") == 0).alias("is_leaf"),
    )


def transitions(events: DataFrame) -> DataFrame:
    """Distinct page-to-page steps in the sessions."""
    return (
        events.where(F.col("seq") > 1)
        .select(F.col("prev_path").alias("source"), F.col("path").alias("target"))
        .distinct()
    )


def hub_labels(edges: DataFrame) -> DataFrame:
    """Labels (side, node, hub, hops) that hold all hop counts of the graph.

    Side 0 holds hubs that a node reaches, side 1 hubs that reach it. The hop count from s to t is the least sum over a
    shared hub of side 0 of s and side 1 of t. All pages search at once, a round per hop, but only over pages that
    rank below them by degree, and not where labels already found give as short a way: so
    popular pages become hubs and a page keeps few of them. Every page is its own hub.
    """
    links = edges.where(F.col("source") != F.col("target")).select("source", "target").distinct()
    ends = F.explode(F.array(F.col("source"), F.col("target"))).alias("node")
    rank = F.struct(F.count("*").alias("links"), F.col("node")).alias("rank")
    ranks = checkpointed(links.select(ends).groupBy("node").agg(rank))
    # from a node against the links on side 0, along them on side 1
    arcs = links.select(F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("target").alias("node"), F.col("source").alias("next")),
        F.struct(F.lit(1).alias("side"), F.col("source").alias("node"), F.col("target").alias("next")),
    )).alias("arc")).select("arc.*")
    arcs = checkpointed(arcs.join(ranks.select(F.col("node").alias("next"), F.col("rank").alias("next_rank")), "next"))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    frontier = checkpointed(ranks.select(sides, "node", F.col("node").alias("hub"), F.col("rank").alias("hub_rank"), F.lit(0).alias("hops")))
    labels = frontier.select("side", "node", "hub", "hops")
    while True:
        reached = (
            frontier.join(arcs, ["side", "node"]).where(F.col("hub_rank") > F.col("next_rank"))
            .select("side", F.col("next").alias("node"), "hub", "hub_rank", (F.col("hops") + 1).alias("hops")).distinct()
        )
        # the ways over a hub that both ends have already
        own = labels.select("side", "node", F.col("hub").alias("over"), F.col("hops").alias("to_over"))
        other = labels.select((1 - F.col("side")).alias("side"), F.col("node").alias("hub"), F.col("hub").alias("over"), F.col("hops").alias("from_over"))
        known = reached.join(own, ["side", "node"]).join(other, ["side", "hub", "over"]).where(
            F.col("to_over") + F.col("from_over") <= F.col("hops")).select("side", "node", "hub")
        frontier = checkpointed(reached.join(known, ["side", "node", "hub"], "left_anti"))
        if frontier.isEmpty():
            return labels
        labels = labels.unionByName(frontier.select("side", "node", "hub", "hops"))


def with_hub_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with their hubs as maps ``hubs_out`` and ``hubs_in``, for the live scorer."""
    side = lambda number, name: labels.where(F.col("side") == number).groupBy(F.col("node").alias("path")).agg(
        F.map_from_entries(F.collect_list(F.struct("hub", "hops"))).alias(name))
    none = F.create_map().cast("map<string,int>")
    joined = nodes.join(side(0, "hubs_out"), "path", "left").join(side(1, "hubs_in"), "path", "left")
    return joined.withColumns({name: F.coalesce(name, none) for name in ("hubs_out", "hubs_in")})


def hop_distances(pairs: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Shortest hop count for each distinct (source, target) pair; 999 without a path.

    Equal ends are 0 and direct links 1 by a join. The remaining pairs join the hub labels of their two ends
    (``hub_labels``, built here when none are given).
    """
    links = checkpointed(edges.select("source", "target").distinct())
    direct = checkpointed(
        pairs.select("source", "target").distinct().join(links.withColumn("linked", F.lit(1)), ["source", "target"], "left")
        .withColumn("hops", F.when(F.col("source") == F.col("target"), 0).when(F.col("linked") == 1, 1))
        .drop("linked")
    )
    known = direct.where(F.col("hops").isNotNull())
    waiting = direct.where(F.col("hops").isNull()).select("source", "target")
    labels = hub_labels(links) if labels is None else labels
    out = labels.where(F.col("side") == 0).select(F.col("node").alias("source"), "hub", F.col("hops").alias("to_hub"))
    into = labels.where(F.col("side") == 1).select(F.col("node").alias("target"), "hub", F.col("hops").alias("from_hub"))
    ways = waiting.join(out, "source").join(into, ["target", "hub"]).groupBy("source", "target").agg(
        F.min(F.col("to_hub") + F.col("from_hub")).alias("hops"))
    found = waiting.join(ways, ["source", "target"], "left").withColumn("hops", F.coalesce("hops", F.lit(NO_PATH_HOPS)))
    return known.unionByName(found).select("source", "target", F.col("hops").cast("int").alias("hops"))
