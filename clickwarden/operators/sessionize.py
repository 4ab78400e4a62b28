"""Inactivity sessions and event order.

A client's requests are cut into sessions at gaps longer than the timeout and numbered within
them. Ordinary clients are one window partition. A client with more rows than ``hot_rows`` is cut
into slices of about that many rows at sampled quantiles of its order (time, path, tie-breaker), so
bursts and equal times are cut too; each slice is a window partition of its own, and what crosses a
slice border (open session, position, last paths, last agent) is carried over by a window on one
summary row per slice. Rows of hot clients are written in slices once, all others are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import LABELS, REQUIRED_SESSION_REQUEST_COLUMNS, SESSION_TIMEOUT_SECONDS, UNKNOWN
from ..functions.paths import is_page_path, normalize_path, path_category
from ..functions.values import blank_to_null, int_or_null, text_or_null
from ..session import materialized

# rows of one key that a single task may order; None when no key can have more
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000
# characters of a text that slice borders look at
BORDER_CHARACTERS = 64

_EVENT = "struct<path:string,page_category:string>"
_CARRY = {
    "c_breaks": "bigint", "c_rows_before": "bigint", "c_breaks_before": "bigint", "c_open_start": "bigint",
    "c_last_time": "double", "c_last": _EVENT, "c_last2": _EVENT,
    "c_agent": "struct<position:bigint,user_agent:string>",
    "c_head_n": "bigint", "c_tail_n": "bigint", "c_head_vote_min": "string", "c_tail_vote_min": "string",
    "c_head_vote_max": "string", "c_tail_vote_max": "string",
}


def client_key(df: DataFrame) -> Column:
    """cookie_id or client_id when present, else address and agent."""
    def optional(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    named = [
        F.when(blank_to_null(optional(name)).isNotNull(),
               F.concat(F.lit(f"{name}:"), blank_to_null(optional(name))))
        for name in ("cookie_id", "client_id")
    ]
    part = lambda name: F.coalesce(F.trim(optional(name)), F.lit("None"))
    return F.coalesce(*named, F.concat(F.lit("ip_ua:"), part("ip"), F.lit("|"), part("user_agent")))


def session_id(key: Column, index: Column) -> Column:
    return F.concat(
        F.lit("sess_"), F.substring(F.sha1(key), 1, 12), F.lit("_"), F.format_string("%03d", index)
    )


def allowed_label(label: Column) -> Column:
    cleaned = F.lower(F.trim(label))
    return F.when(cleaned.isin(LABELS), cleaned)


def sessionize(
    requests: DataFrame,
    *,
    timeout: float = SESSION_TIMEOUT_SECONDS,
    default_label: str = UNKNOWN,
    drop_assets: bool = True,
    min_length: int = 2,
    tie_breaker: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Events of all sessions with at least ``min_length`` requests.

    Sessions are numbered before short ones are dropped. Requests of a client are ordered by time,
    path and ``tie_breaker``. Next to the request columns each event carries ``session_id``,
    ``session_index``, ``seq`` (1-based), ``n_events``, ``delta_t``, the filled ``referrer``, and
    the previous path, category and agent in its session.
    """
    df = requests.withColumn("path", normalize_path(F.col("path")))
    # one condition: a NULL path is no page either
    df = df.where(is_page_path(F.col("path")) if drop_assets else F.col("path").isNotNull())
    if "client_key" not in df.columns:
        df = df.withColumn("client_key", client_key(df))
    df = df.withColumn("timestamp", F.col("timestamp").try_cast("double"))
    df = df.where(F.col("timestamp").isNotNull() & ~F.isnan("timestamp"))
    order = ["timestamp", "path"] + ([tie_breaker] if tie_breaker else [])
    events = _sequence(df, "client_key", order, timeout, default_label, hot_rows)
    events = events.withColumn("session_id", session_id(F.col("client_key"), F.col("session_index")))
    return _ordered_columns(events.where(F.col("n_events") >= min_length))


def load_session_requests(df: DataFrame, *, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Events from stored session requests, whose sessions are already known.

    Missing columns raise at once; a label outside the allowed ones, or two labels in one session,
    fail the job that reads the result.
    """
    missing = sorted(set(REQUIRED_SESSION_REQUEST_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"session requests lack columns: {missing}")
    label = F.lower(F.trim(F.col("label").cast("string")))
    bad_label = F.raise_error(F.concat(F.lit("unsupported label: "), F.coalesce(label, F.lit("NULL"))))
    df = df.withColumns({
        "session_id": F.col("session_id").cast("string"),
        "timestamp": F.col("timestamp").cast("double"),
        "path": F.col("path").cast("string"),
        "stored_delta_t": F.col("delta_t").cast("double"),
        "label": F.when(label.isin(LABELS), label).otherwise(bad_label.cast("string")),
        "stored_referrer": text_or_null(F.col("referrer")) if "referrer" in df.columns else F.lit(None).cast("string"),
    })
    events = _sequence(df.drop("delta_t"), "session_id", ["timestamp", "path"], None, None, hot_rows)
    events = events.withColumns({"delta_t": F.col("stored_delta_t"), "referrer": F.col("stored_referrer")})
    return _ordered_columns(events.drop("stored_delta_t", "stored_referrer"))


def check_session_requests(df: DataFrame) -> DataFrame:
    """Per session: requests, distinct labels, unsupported labels and whether it may be loaded."""
    label = F.lower(F.trim(F.col("label").cast("string")))
    unsupported = F.sum(F.when(label.isin(LABELS), 0).otherwise(1))
    return df.groupBy("session_id").agg(
        F.count("*").alias("num_requests"),
        F.count_distinct(label).alias("num_labels"),
        unsupported.alias("num_unsupported"),
        ((F.count_distinct(label) == 1) & (unsupported == 0)).alias("is_valid"),
    )


def _ordered_columns(events: DataFrame) -> DataFrame:
    first = [
        "session_id", "session_index", "seq", "n_events", "timestamp", "path", "delta_t", "label",
        "page_category", "referrer", "user_agent", "status_code",
    ]
    last = ["prev_path", "prev2_path", "prev_category", "prev_user_agent"]
    rest = [c for c in events.columns if c not in first + last]
    return events.select(*[c for c in first if c in events.columns], *rest, *last)


def _hot_keys(df: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame, int] | None:
    """Keys with too many rows for one window partition and the number of slices; None without any.

    A hot key holds more than total/MAX_HOT_KEYS rows, so there are fewer than MAX_HOT_KEYS of
    them and their list is safe to broadcast at any data size.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    largest, total = counts.agg(F.max("_rows"), F.sum("_rows")).head()
    limit = max(hot_rows, (total or 0) // MAX_HOT_KEYS)
    if not total or largest <= limit:
        return None
    hot = materialized(counts.where(F.col("_rows") > limit))
    return hot.select(key), -(-hot.agg(F.sum("_rows")).head()[0] // limit)


def _border_order(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Columns of bounded length that sort like ``order``, with ties behind long texts that start alike.

    The range partitioner samples them, so what passes through the driver has a fixed size a row.
    """
    columns, open_so_far = [], F.lit(True)
    for name in order:
        here = F.when(open_so_far, F.col(name))
        if df.schema[name].dataType.typeName() != "string":
            columns.append(here)
            continue
        is_long = F.coalesce(F.length(name) > BORDER_CHARACTERS, F.lit(False))
        columns += [F.left(here, F.lit(BORDER_CHARACTERS)), open_so_far & is_long]
        open_so_far = open_so_far & ~is_long
    return columns


def _with_slices(df: DataFrame, key: str, hot: DataFrame, slices: int, order: Sequence[str]) -> DataFrame:
    """Add ``_slice``: rising with the order for hot keys, NULL for all others.

    Borders come from a sample, so the sliced rows are written: whatever reads them, and however
    often, sees one set of borders.
    """
    chosen = df.join(F.broadcast(hot), key, "left_semi")
    ranged = chosen.repartitionByRange(slices, F.col(key), *_border_order(df, order))
    sliced = materialized(ranged.withColumn("_slice", F.spark_partition_id().cast("bigint")))
    rest = df.join(F.broadcast(hot), key, "left_anti").withColumn("_slice", F.lit(None).cast("bigint"))
    return rest.unionByName(sliced)


def _sequence(
    df: DataFrame, key: str, order: Sequence[str], timeout: float | None,
    default_label: str | None, hot_rows: int | None,
) -> DataFrame:
    text = lambda name: text_or_null(F.col(name)) if name in df.columns else F.lit(None).cast("string")
    status = int_or_null(F.col("status_code")) if "status_code" in df.columns else F.lit(None).cast("int")
    vote = F.lit(None).cast("string")
    if "label" in df.columns:
        # a missing label does not vote, a blank one votes for the default
        label = F.col("label").cast("string")
        vote = allowed_label(
            F.coalesce(blank_to_null(label), F.when(label.isNotNull(), F.lit(default_label)))
        )
    df = df.withColumns({
        "page_category": F.coalesce(text("page_category"), path_category(F.col("path"))),
        "referrer": text("referrer"),
        "user_agent": text("user_agent"),
        "status_code": status,
        "_vote": vote,
    })
    hot = _hot_keys(df, key, hot_rows) if hot_rows else None
    part = [key]
    if hot is not None:
        df, part = _with_slices(df, key, *hot, order), [key, "_slice"]
    ordered = Window.partitionBy(*part).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("timestamp") - F.lag("timestamp").over(ordered)
    is_break = (gap > F.lit(float(timeout))) if timeout is not None else F.lit(False)
    local = (
        df.withColumns({
            "_row": F.row_number().over(ordered),
            "_here": F.struct("path", "page_category"),
            "_last_time": F.lag("timestamp").over(ordered),
            "_break": F.coalesce(is_break, F.lit(False)),
        })
        .withColumns({
            "_breaks": F.sum(F.col("_break").cast("int")).over(running),
            "_break_row": F.max(F.when(F.col("_break"), F.col("_row"))).over(running),
            "_last": F.lag("_here", 1).over(ordered),
            "_last2": F.lag("_here", 2).over(ordered),
            "_agent_here": F.when(F.col("user_agent").isNotNull(), F.struct("_row", "user_agent")),
        })
        .withColumn("_agent", F.last("_agent_here", ignorenulls=True).over(before))
    )
    segment = Window.partitionBy(*part, "_breaks")
    local = local.withColumns({
        "_n": F.count("*").over(segment),
        "_vote_min": F.min("_vote").over(segment) if "label" in df.columns else F.col("_vote"),
        "_vote_max": F.max("_vote").over(segment) if "label" in df.columns else F.col("_vote"),
    })
    if hot is None:
        joined = local.withColumns({name: F.lit(None).cast(kind) for name, kind in _CARRY.items()})
    else:  # NULL slices are ordinary keys and find no carry
        joined = local.join(_slice_carry(local.where(F.col("_slice").isNotNull()), key, timeout), part, "left")

    offset = F.coalesce("c_rows_before", F.lit(0))
    position = offset + F.col("_row")
    start = F.coalesce(offset + F.col("_break_row"), "c_open_start", F.lit(1))
    at_head = F.col("_breaks") == 0
    at_tail = F.col("_breaks") == F.col("c_breaks")
    whole = lambda name, own: (
        F.when(at_head, F.coalesce(f"c_head_{name}", own))
        .when(at_tail, F.coalesce(f"c_tail_{name}", own))
        .otherwise(F.col(own))
    )
    previous = F.coalesce("_last", "c_last")
    previous2 = F.coalesce("_last2", F.when(F.col("_row") == 1, F.col("c_last2")), F.when(F.col("_row") == 2, F.col("c_last")))
    agent_position = F.coalesce(offset + F.col("_agent._row"), "c_agent.position")
    agent_text = F.coalesce("_agent.user_agent", "c_agent.user_agent")
    numbered = joined.withColumns({
        "session_index": (F.coalesce("c_breaks_before", F.lit(0)) + F.col("_breaks")).cast("int"),
        "seq": (position - start + 1).cast("bigint"),
        "n_events": whole("n", "_n").cast("bigint"),
        "_vote_low": whole("vote_min", "_vote_min"),
        "_vote_high": whole("vote_max", "_vote_max"),
        "_prev": previous,
        "_prev2": previous2,
        "_prev_time": F.coalesce("_last_time", "c_last_time"),
        "_prev_agent": F.when(agent_position >= start, agent_text),
    })
    later = F.col("seq") > 1
    one_label = F.col("_vote_low") == F.col("_vote_high")
    if default_label is None:
        mixed = F.raise_error(F.concat(F.lit("conflicting labels in session "), F.col(key)))
        label = F.when(one_label, F.col("_vote_low")).otherwise(mixed.cast("string"))
    else:
        fallback = default_label if default_label in LABELS else "human"
        label = F.when(one_label, F.col("_vote_low")).otherwise(F.lit(fallback))
    result = numbered.withColumns({
        "label": label,
        "delta_t": F.when(
            later, F.greatest(F.lit(0.0), F.col("timestamp") - F.col("_prev_time"))
        ).otherwise(F.lit(0.0)),
        "prev_path": F.when(later, F.col("_prev.path")),
        "prev_category": F.when(later, F.col("_prev.page_category")),
        "prev2_path": F.when(F.col("seq") > 2, F.col("_prev2.path")),
        "prev_user_agent": F.when(later, F.col("_prev_agent")),
        "raw_referrer": F.col("referrer"),
    })
    result = result.withColumn("referrer", F.coalesce("referrer", "prev_path"))
    hidden = [c for c in result.columns if c.startswith(("_", "c_"))]
    return result.drop(*hidden)


def _slice_carry(local: DataFrame, key: str, timeout: float | None) -> DataFrame:
    """What each slice of a hot key must know of the slices before and after it."""
    part = [key, "_slice"]
    summary = local.groupBy(*part).agg(
        F.count("*").alias("rows"),
        F.max("_breaks").alias("c_breaks"),
        F.max("_break_row").alias("last_break_row"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.max_by("_here", "_row").alias("last"),
        F.max_by("_last", "_row").alias("last2"),
        F.max("_agent_here").alias("agent"),  # struct order: the largest row wins
        F.max_by(F.struct("_n", "_vote_min", "_vote_max"), -F.col("_row")).alias("head"),
        F.max_by(F.struct("_n", "_vote_min", "_vote_max"), "_row").alias("tail"),
    )
    ordered = Window.partitionBy(key).orderBy("_slice")
    prior = ordered.rowsBetween(Window.unboundedPreceding, -1)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border_gap = F.col("first_time") - F.lag("last_time").over(ordered)
    at_border = (border_gap > F.lit(float(timeout))) if timeout is not None else F.lit(False)
    carried = (
        summary.withColumns({
            "border_break": F.coalesce(at_border, F.lit(False)),
            "c_rows_before": F.coalesce(F.sum("rows").over(prior), F.lit(0)),
            "c_last_time": F.lag("last_time").over(ordered),
            "c_last": F.lag("last").over(ordered),
            # the event before last: from the slice before, or from the one before a one-row slice
            "c_last2": F.coalesce(F.lag("last2").over(ordered), F.lag("last", 2).over(ordered)),
        })
        .withColumns({
            "c_breaks_before": F.sum(F.col("border_break").cast("int")).over(running)
            + F.coalesce(F.sum("c_breaks").over(prior), F.lit(0)),
            "last_start": F.coalesce(
                F.col("c_rows_before") + F.col("last_break_row"),
                F.when(F.col("border_break"), F.col("c_rows_before") + 1),
            ),
            "agent_position": F.when(
                F.col("agent").isNotNull(),
                F.struct(
                    (F.col("c_rows_before") + F.col("agent._row")).alias("position"),
                    F.col("agent.user_agent").alias("user_agent"),
                ),
            ),
        })
        .withColumns({
            "c_open_start": F.when(F.col("border_break"), F.col("c_rows_before") + 1).otherwise(
                F.coalesce(F.max("last_start").over(prior), F.lit(1))
            ),
            "c_agent": F.last("agent_position", ignorenulls=True).over(prior),
        })
    )
    # session totals over slices: a slice adds to its first and to its last session
    piece = lambda source, index: F.struct(
        index.alias("index"), F.col(f"{source}._n").alias("n"),
        F.col(f"{source}._vote_min").alias("low"), F.col(f"{source}._vote_max").alias("high"),
    )
    first_index, last_index = F.col("c_breaks_before"), F.col("c_breaks_before") + F.col("c_breaks")
    pieces = carried.select(
        key, "_slice",
        F.explode(
            F.when(F.col("c_breaks") == 0, F.array(piece("head", first_index)))
            .otherwise(F.array(piece("head", first_index), piece("tail", last_index)))
        ).alias("piece"),
    ).select(key, "_slice", "piece.*")
    same_session = Window.partitionBy(key, "index")
    totals = (
        pieces.withColumns({
            "n": F.sum("n").over(same_session),
            "low": F.min("low").over(same_session),
            "high": F.max("high").over(same_session),
        })
        .groupBy(*part)
        .agg(
            F.min(F.struct("index", "n", "low", "high")).alias("head_total"),
            F.max(F.struct("index", "n", "low", "high")).alias("tail_total"),
        )
    )
    return carried.join(totals, part).select(
        *part, "c_breaks", "c_rows_before", "c_breaks_before", "c_open_start", "c_last_time",
        "c_last", "c_last2", "c_agent",
        F.col("head_total.n").alias("c_head_n"), F.col("tail_total.n").alias("c_tail_n"),
        F.col("head_total.low").alias("c_head_vote_min"), F.col("tail_total.low").alias("c_tail_vote_min"),
        F.col("head_total.high").alias("c_head_vote_max"), F.col("tail_total.high").alias("c_tail_vote_max"),
    )
