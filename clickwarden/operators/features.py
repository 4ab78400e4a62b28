"""Navigation, timing, graph and entropy features of sessions and of their first requests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    ABLATIONS, FAR_JUMP_HOPS, FEATURE_COLUMNS, FEATURE_GROUPS, LOW_LATENCY_SECONDS,
    NAVIGATION_SCORE_V2_WEIGHTS, NAVIGATION_SCORE_WEIGHTS, NO_PATH_HOPS, PREFIXES,
)
from ..functions.values import clip01, ratio
from ..session import materialized

# a session with more events spreads its symbols over SALTS groups before the last sum
LONG_SESSION_EVENTS = 100_000
SALTS = 256
# events of a task when a large table is dealt out by session
EVENTS_PER_TASK = 50_000
# a site of at most so many pages is broadcast; of a larger one, pages that hold more than that share of the events
MAX_BROADCAST_PAGES = 10_000

_KEYS = ["session_id", "prefix_len"]


def clean_prefixes(prefixes: Iterable[int]) -> list[int]:
    return sorted({int(p) for p in prefixes if int(p) >= 2})


def expand_prefixes(events: DataFrame, prefixes: Iterable[int] = PREFIXES) -> DataFrame:
    """Each event once per prefix that holds it and that its session reaches."""
    lengths = clean_prefixes(prefixes)
    if not lengths:
        raise ValueError("need a prefix of at least 2")
    reached = F.filter(
        F.array(*[F.lit(p) for p in lengths]),
        lambda p: (p >= F.col("seq")) & (p <= F.col("n_events")),
    )
    return events.where(F.col("seq") <= lengths[-1]).withColumn("prefix_len", F.explode(reached))


def prefix_features(
    events: DataFrame, nodes: DataFrame, prefixes: Iterable[int] = PREFIXES, hops: DataFrame | None = None
) -> DataFrame:
    """One row per session and prefix it reaches, with all features.

    ``hops``: distances of the steps taken (``hop_distances``). Without it the graph is taken to
    hold every step, as one built from these sessions does, so a step is 0 or 1 hops.
    """
    lengths = clean_prefixes(prefixes)
    early = events.where(F.col("seq") <= lengths[-1])
    rows = early.count()
    dealt = _dealt(_with_graph(early, nodes, hops, rows), rows, "session_id")
    return _features(expand_prefixes(dealt, lengths), rows, salted=False)


def full_session_features(events: DataFrame, nodes: DataFrame, hops: DataFrame | None = None) -> DataFrame:
    """One row per session of at least two events; ``prefix_len`` is its length."""
    whole = events.where(F.col("n_events") >= 2).withColumn("prefix_len", F.col("n_events").cast("int"))
    rows, longest = whole.agg(F.count("*"), F.max("n_events")).head()
    salted = (longest or 0) > LONG_SESSION_EVENTS
    chunk = [F.floor(F.col("seq") / LONG_SESSION_EVENTS)] if salted else []
    return _features(_dealt(_with_graph(whole, nodes, hops, rows), rows, "session_id", *chunk), rows, salted)


def features_of_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features of rows that hold the summed measures of a session so far."""
    return _assemble(sums).select(*keys, *FEATURE_COLUMNS)


def _dealt(df: DataFrame, rows: int, *place: str | Column) -> DataFrame:
    """Rows of one place in one task. A table of many rows goes to as many tasks as keep each at about
    ``EVENTS_PER_TASK``, however few bytes the rows take; the tasks of a small one are the engine's choice."""
    tasks = -(-rows // EVENTS_PER_TASK)
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(*place)
    return df.repartition(tasks, *place)


def _with_pages(events: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """Events with the attributes of their page. No page brings its events together: those of a small site and the
    busy pages of a large one, fewer than ``MAX_BROADCAST_PAGES``, come to the events, the others by a shuffle."""
    attributes = materialized(nodes.select("path", "depth", "out_degree", "is_leaf"))
    if attributes.count() <= MAX_BROADCAST_PAGES:
        return events.join(F.broadcast(attributes), "path", "left")
    counts = events.groupBy("path").agg(F.count("*").alias("_events"))
    busy = materialized(counts.where(F.col("_events") * MAX_BROADCAST_PAGES > rows).select("path"))
    at_busy = events.join(F.broadcast(busy.join(attributes, "path", "left")), "path")
    return events.join(F.broadcast(busy), "path", "left_anti").join(attributes, "path", "left").unionByName(at_busy)


def _with_graph(events: DataFrame, nodes: DataFrame, hops: DataFrame | None, rows: int) -> DataFrame:
    joined = _with_pages(events, nodes, rows).withColumns({
        "depth": F.coalesce("depth", F.lit(-1)),
        "out_degree": F.coalesce("out_degree", F.lit(0)),
        "is_leaf": F.coalesce("is_leaf", F.lit(False)),
    })
    moved = F.col("path") != F.col("prev_path")
    if hops is None:
        return joined.withColumn("hops", F.when(F.col("seq") > 1, moved.cast("int")))
    steps = hops.select(F.col("source").alias("prev_path"), F.col("target").alias("path"), F.col("hops").alias("_hops"))
    distance = F.when(moved, F.coalesce("_hops", F.lit(NO_PATH_HOPS))).otherwise(F.lit(0))
    return (
        joined.join(steps, ["prev_path", "path"], "left")
        .withColumn("hops", F.when(F.col("seq") > 1, distance))
        .drop("_hops")
    )


def _features(dealt: DataFrame, rows: int, salted: bool) -> DataFrame:
    """Features of events that lie together by session, or with ``salted`` by session and chunk."""
    symbols = _symbol_measures(dealt, salted, ["session_id"] if salted else None, rows)
    joined = _event_measures(dealt).join(symbols, _KEYS)
    return _assemble(joined).select(*_KEYS, "label", *FEATURE_COLUMNS)


def _event_measures(events: DataFrame) -> DataFrame:
    """Sums over the events themselves."""
    moved = F.col("seq") > 1
    delta = F.when(moved, F.col("delta_t"))
    agent, last_agent = F.col("user_agent"), F.col("prev_user_agent")
    count = lambda condition: F.count_if(condition)
    return events.groupBy(*_KEYS).agg(
        F.max("label").alias("label"),
        F.count("*").alias("n"),
        count((F.col("seq") > 2) & (F.col("path") == F.col("prev2_path"))).alias("backtracks"),
        count(moved & (F.col("path") == F.col("prev_path"))).alias("self_loops"),
        F.sum(F.when(F.col("depth") >= 0, F.col("depth"))).alias("depth_sum"),
        count(F.col("depth") >= 0).alias("depth_n"),
        count("is_leaf").alias("leaves"),
        F.sum("out_degree").alias("out_degree_sum"),
        F.sum("hops").alias("hop_sum"),
        count(F.col("hops") >= FAR_JUMP_HOPS).alias("far_jumps"),
        F.sum(delta).alias("delta_sum"),
        F.stddev_pop(delta).alias("delta_std"),
        count(delta <= LOW_LATENCY_SECONDS).alias("fast"),
        F.count("status_code").alias("statuses"),
        count(F.col("status_code") >= 400).alias("errors"),
        F.count("user_agent").alias("agents"),
        count(moved & (agent != last_agent)).alias("agent_switches"),
        count(moved & (F.col("page_category") != F.col("prev_category"))).alias("category_switches"),
    )


def _plogp(count: Column, total: Column) -> Column:
    p = count / total
    return F.when(count > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def _symbol_measures(events: DataFrame, salted: bool, place: list[str] | None, rows: int = 0) -> DataFrame:
    """Entropy and concentration sums over paths, categories and their transitions.

    A symbol is (family, a, b): a visited path or category when b is NULL, else a step a -> b.
    One placement by session serves the aggregations; without ``place`` the events have it already. When some
    sessions are long, symbols are first combined to the distinct ones, and those of long sessions are spread.
    """
    half = F.greatest(F.lit(2), F.floor(F.col("prefix_len") / 2))
    moved = F.col("seq") > 1
    symbol = lambda family, a, b, degree: F.struct(
        F.lit(family).alias("family"), a.alias("a"), b.alias("b"), degree.alias("degree")
    )
    nothing, no_degree = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    path, category = F.col("path"), F.col("page_category")
    if place and not salted:  # move before exploding: an event travels once, not as its up to four symbols
        events = events.select(
            *_KEYS, "n_events", "seq", "path", "page_category", "prev_path", "prev_category", "out_degree").repartition(*place)
    symbols = events.select(
        *_KEYS, "n_events", (F.col("seq") <= half).alias("early"),
        F.explode(F.array_compact(F.array(
            symbol("path", path, nothing, F.col("out_degree").cast("bigint")),
            symbol("category", category, nothing, no_degree),
            F.when(moved, symbol("path", F.col("prev_path"), path, no_degree)),
            F.when(moved, symbol("category", F.col("prev_category"), category, no_degree)),
        ))).alias("symbol"),
    ).select(*_KEYS, "n_events", "early", "symbol.*")
    keys = list(_KEYS)
    if salted:
        spread = F.pmod(F.xxhash64("family", "a"), F.lit(SALTS)).cast("int")
        salt = F.when(F.col("n_events") > LONG_SESSION_EVENTS, spread).otherwise(F.lit(0))
        symbols, place, keys = symbols.withColumn("salt", salt), [*place, "salt"], [*_KEYS, "salt"]

    measures = [F.count("*").alias("c"), F.count_if("early").alias("c_early"), F.max("degree").alias("degree")]
    if salted:  # combine before moving: a long session shrinks to its distinct symbols
        counted = symbols.groupBy(*keys, "family", "a", "b").agg(*measures)
        counted = _dealt(counted, rows, *place)
    else:
        counted = symbols.groupBy(*keys, "family", "a", "b").agg(*measures)
    visit, step = F.col("b").isNull(), F.col("b").isNotNull()
    visits = F.col("prefix_len")
    early_visits = half
    total = F.when(visit, visits).otherwise(visits - 1).cast("double")
    early_total = F.when(visit, early_visits).otherwise(early_visits - 1).cast("double")
    c, c_early = F.col("c").cast("double"), F.col("c_early").cast("double")
    measured = counted.withColumns({
        "plogp": _plogp(c, total),
        "early_plogp": _plogp(c_early, early_total),
        "p2": (c / total) * (c / total),
        "clogc": c * F.log2(c),
        "is_early": (F.col("c_early") > 0).cast("bigint"),
    })
    by_source = measured.groupBy(*keys, "family", "a").agg(
        F.max("degree").alias("degree"),
        F.count_if(step).alias("choices"),
        F.sum(F.when(step, c)).alias("leaving"),
        F.sum(F.when(step, F.col("clogc"))).alias("leaving_clogc"),
        *[
            F.sum(F.when(kind, F.col(name))).alias(f"{kind_name}_{name}")
            for kind_name, kind in (("visit", visit), ("step", step))
            for name in ("plogp", "early_plogp", "p2", "is_early")
        ],
        F.count_if(visit).alias("visit_distinct"),
    )
    # normalised by the links the page offers, else by the links taken
    support = F.when(F.col("degree") >= 2, F.col("degree")).otherwise(F.col("choices"))
    branching = F.when(F.col("choices") <= 1, F.lit(0.0)).otherwise(
        (F.log2("leaving") - F.col("leaving_clogc") / F.col("leaving")) / F.log2(support.cast("double"))
    )
    left = (F.col("family") == "path") & (F.col("choices") > 0)
    by_source = by_source.withColumns({
        "branching": F.when(left, branching), "left_pages": left.cast("bigint"),
        "step_distinct": F.col("choices"),
    })
    sums = {"branching": F.sum("branching"), "left_pages": F.sum("left_pages")}
    for short, family, kind in (
        ("node", "path", "visit"), ("trans", "path", "step"),
        ("cat", "category", "visit"), ("cattrans", "category", "step"),
    ):
        of_family = lambda name: F.sum(F.when(F.col("family") == family, F.col(f"{kind}_{name}")))
        for name in ("plogp", "early_plogp", "p2", "is_early", "distinct"):
            sums[f"{short}_{name}"] = of_family(name)
    result = by_source.groupBy(*keys).agg(*[value.alias(name) for name, value in sums.items()])
    if salted:
        result = result.groupBy(*_KEYS).agg(*[F.sum(name).alias(name) for name in sums])
    return result


def _assemble(joined: DataFrame) -> DataFrame:
    """The named features from the summed measures."""
    n = F.col("n").cast("double")
    steps = n - 1
    half = F.greatest(F.lit(2), F.floor(F.col("n") / 2)).cast("double")

    def entropy(short: str, early: bool) -> Column:
        return F.lit(0.0) - F.col(f"{short}_early_plogp" if early else f"{short}_plogp")

    def normalized(short: str, early: bool) -> Column:
        distinct = F.col(f"{short}_is_early" if early else f"{short}_distinct")
        return F.when(distinct > 1, entropy(short, early) / F.log2(distinct.cast("double"))).otherwise(F.lit(0.0))

    values: dict[str, Column] = {}
    for short, name in (("trans", "transition"), ("cat", "category"), ("node", "node"), ("cattrans", "category_transition")):
        values[f"{name}_entropy"] = entropy(short, False)
        values[f"normalized_{name}_entropy"] = normalized(short, False)
        values[f"{name}_entropy_delta"] = entropy(short, False) - entropy(short, True)
        values[f"normalized_{name}_entropy_delta"] = normalized(short, False) - normalized(short, True)
    mean_delta, std_delta = F.col("delta_sum") / steps, F.col("delta_std")
    spread = std_delta + mean_delta
    new_share = F.col("node_distinct") / n
    early_revisits = 1.0 - F.col("node_is_early") / half
    branching = ratio(F.col("branching"), F.col("left_pages"))
    values.update({
        "session_length_so_far": n,
        "unique_nodes": F.col("node_distinct").cast("double"),
        "unique_node_ratio": new_share,
        "revisit_ratio": 1.0 - new_share,
        "repeated_path_ratio": (n - F.col("node_distinct")) / n,
        "repeated_transition_ratio": (steps - F.col("trans_distinct")) / steps,
        "backtrack_count": F.col("backtracks").cast("double"),
        "self_loop_ratio": F.col("self_loops") / steps,
        "mean_depth": ratio(F.col("depth_sum"), F.col("depth_n")),
        "leaf_visit_ratio": F.col("leaves") / n,
        "out_degree_mean": F.col("out_degree_sum") / n,
        "mean_hop_distance": F.col("hop_sum") / steps,
        "far_jump_ratio": F.col("far_jumps") / steps,
        "mean_delta_t": mean_delta,
        "std_delta_t": std_delta,
        "burstiness": F.when((steps >= 2) & (spread != 0), (std_delta - mean_delta) / spread).otherwise(F.lit(0.0)),
        "low_latency_ratio": F.col("fast") / steps,
        "error_rate": ratio(F.col("errors"), F.col("statuses")),
        "user_agent_switch_rate": ratio(F.col("agent_switches"), F.col("agents") - 1),
        "category_switch_rate": F.col("category_switches") / steps,
        "local_branching_entropy": branching,
        "branching_concentration": clip01(1.0 - branching),
        "coverage_concentration": F.col("node_p2"),
        "transition_concentration": F.col("trans_p2"),
        "category_concentration": F.col("cat_p2"),
        "revisit_growth": F.greatest(F.lit(0.0), (1.0 - new_share) - early_revisits),
    })
    slopes = {
        "entropy_slope": ratio(F.col("node_entropy_delta"), n - half),
        "transition_entropy_slope": ratio(F.col("transition_entropy_delta"), n - half),
        "category_transition_entropy_slope": ratio(F.col("category_transition_entropy_delta"), n - half),
    }
    scored = joined.withColumns(values).withColumns(slopes)
    return scored.withColumns({
        "navigation_entropy_score": navigation_score(),
        "navigation_entropy_score_v2": navigation_score_v2(),
    })


def navigation_score() -> Column:
    """Exploration score in [0, 1]; higher is more human-like."""
    w = NAVIGATION_SCORE_WEIGHTS
    score = (
        w["normalized_transition_entropy"] * F.col("normalized_transition_entropy")
        + w["normalized_category_entropy"] * F.col("normalized_category_entropy")
        + w["novelty"] * (1.0 - F.col("revisit_ratio"))
        + w["category_switch_rate"] * F.col("category_switch_rate")
        + w["far_jump_ratio"] * F.col("far_jump_ratio")
        + w["steadiness"] * (1.0 - F.abs("burstiness"))
    )
    return clip01(score)


def navigation_score_v2() -> Column:
    """Second exploration score in [0, 1], without timing."""
    w = NAVIGATION_SCORE_V2_WEIGHTS
    score = (
        w["normalized_transition_entropy"] * F.col("normalized_transition_entropy")
        + w["normalized_node_entropy"] * F.col("normalized_node_entropy")
        + w["normalized_category_transition_entropy"] * F.col("normalized_category_transition_entropy")
        + w["local_branching_entropy"] * F.col("local_branching_entropy")
        + w["transition_delta"] * clip01(0.5 + F.col("normalized_transition_entropy_delta"))
        + w["spread"] * (1.0 - F.col("coverage_concentration"))
        + w["no_growth"] * (1.0 - clip01(F.col("revisit_growth")))
    )
    return clip01(score)


def ablation_columns(ablation: str, available: Iterable[str] = tuple(FEATURE_COLUMNS)) -> list[str]:
    """Feature columns of an ablation that exist, in group order."""
    present = set(available)
    return [c for group in ABLATIONS[ablation] for c in FEATURE_GROUPS[group] if c in present]


def ablation_features(features: DataFrame, ablation: str) -> DataFrame:
    return features.select(*_KEYS, "label", *ablation_columns(ablation, features.columns))
