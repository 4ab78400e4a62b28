"""Train, validation and test splits as tables of (session_id, split)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import BOT, HUMAN, SPLIT_SHARES
from ..functions.values import blank_to_null
from .ranking import with_global_row_number

DEFAULT_SEED = "42"


def hash_share(key: Column, seed: str = DEFAULT_SEED) -> Column:
    """Reproducible uniform number in [0, 1) of a key."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), F.lit("|"), key)), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def split_by_share(share: Column, shares: Sequence[tuple[str, float]] = SPLIT_SHARES) -> Column:
    """Split whose interval of [0, 1) holds the share."""
    *leading, (last, _) = shares
    bound, choice = 0.0, None
    for name, size in leading:
        bound += size
        condition = share < F.lit(round(bound, 10))
        choice = F.when(condition, name) if choice is None else choice.when(condition, name)
    return choice.otherwise(last)


def bucket_split(metadata: DataFrame, key: str = "path_signature", shares: Sequence[tuple[str, float]] = SPLIT_SHARES, seed: str = DEFAULT_SEED) -> DataFrame:
    """Whole groups to splits by the hash of the group: no shuffle, sizes right on average."""
    group = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return metadata.select("session_id", split_by_share(hash_share(group, seed), shares).alias("split"))


def train_test_split(metadata: DataFrame, test_share: float = 0.30, seed: str = DEFAULT_SEED) -> DataFrame:
    return bucket_split(metadata, "session_id", [("train", 1.0 - test_share), ("test", test_share)], seed)


def _greedy_counts(deficit: dict[str, float], placed: dict[str, int], size: int, groups: int) -> dict[str, int]:
    """How many of equally large groups each split takes when each goes to the largest deficit.

    Splits whose deficits differ by less than one group take turns, so whole turns are given out at
    once; only a few single steps are left at each change.
    """
    given = dict.fromkeys(deficit, 0)

    def give(name: str, count: int) -> None:
        deficit[name] -= count * size
        placed[name] += count * size
        given[name] += count

    while groups:
        ordered = sorted(deficit, key=lambda name: (-deficit[name], placed[name]))
        for turn in range(1, len(ordered) + 1):
            level = deficit[ordered[turn - 1]]
            if turn < len(ordered):
                rounds = int((level - deficit[ordered[turn]]) // size) - 1
            else:
                rounds = groups // turn - 1
            rounds = min(rounds, groups // turn)
            if rounds >= 1:
                for name in ordered[:turn]:
                    give(name, rounds)
                groups -= rounds * turn
                break
        else:
            best = max(deficit, key=lambda name: (deficit[name], -placed[name]))
            give(best, 1)
            groups -= 1
    return given


def grouped_split(metadata: DataFrame, group_key: str = "path_signature", shares: Sequence[tuple[str, float]] = SPLIT_SHARES, seed: str = DEFAULT_SEED) -> DataFrame:
    """Whole groups per label to splits, largest first, each to the split lacking most sessions.

    Only the number of groups per label and size reaches the driver: sizes that add up to n
    sessions take at most sqrt(2n) values. Groups of equal size are interchangeable and are handed
    out in the order of their hash.
    """
    spark = metadata.sparkSession
    group = F.col(group_key).cast("string").alias("group")
    sized = metadata.select("label", group).groupBy("label", "group").agg(F.count("*").alias("size"))
    order = [F.col("label"), F.col("size").desc(), hash_share(F.coalesce("group", F.lit("")), seed), F.col("group")]
    ranked = with_global_row_number(sized, order, "rank")
    histogram = ranked.groupBy("label", "size").agg(F.count("*").alias("groups"), F.min("rank").alias("first"))

    runs, state = [], {}
    rows = histogram.orderBy("label", F.desc("size")).collect()
    totals: dict[str, int] = {}
    for row in rows:
        totals[row["label"]] = totals.get(row["label"], 0) + row["size"] * row["groups"]
    for row in rows:
        if row["label"] not in state:
            total = totals[row["label"]]
            state[row["label"]] = ({n: total * s for n, s in shares}, {n: 0 for n, _ in shares})
        given = _greedy_counts(*state[row["label"]], row["size"], row["groups"])
        start = row["first"]
        for name, _ in shares:
            if given[name]:
                runs.append((row["label"], row["size"], start, start + given[name] - 1, name))
                start += given[name]
    schema = T.StructType([
        T.StructField("label", T.StringType()), T.StructField("size", T.LongType()),
        T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("split", T.StringType()),
    ])
    plan = spark.createDataFrame(runs, schema)
    placed = ranked.join(F.broadcast(plan), ["label", "size"]).where(  # bounded like the histogram
        F.col("rank").between(F.col("low"), F.col("high"))
    )
    left = metadata.select("session_id", F.col("label").alias("_label"), F.col(group_key).cast("string").alias("_group"))
    same = F.col("_label").eqNullSafe(F.col("label")) & F.col("_group").eqNullSafe(F.col("group"))
    return left.join(placed.select("label", "group", "split"), same).select("session_id", "split")


def stratified_split(metadata: DataFrame, seed: str = DEFAULT_SEED) -> DataFrame:
    """60/20/20 inside each label with exact sizes, in hash order."""
    share = hash_share(F.col("session_id"), seed)
    ranked = with_global_row_number(
        metadata.select("session_id", "label"), [F.col("label"), share, F.col("session_id")], "rank"
    )
    labels = ranked.groupBy("label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    place = F.col("rank") - F.col("first") + 1
    held = F.ceil(F.col("n") * 0.40)
    test = F.ceil(held * 0.50)
    split = F.when(place <= F.col("n") - held, "train").when(place <= F.col("n") - test, "val").otherwise("test")
    return ranked.join(labels, "label").select("session_id", split.alias("split"))


def time_split(metadata: DataFrame) -> DataFrame:
    """First 60 % of sessions by start time, next 20 %, rest; no rows when a split is unusable."""
    ranked = with_global_row_number(
        metadata.select("session_id", "label", "start_timestamp"),
        [F.col("start_timestamp"), F.col("session_id")], "rank",
    )
    total = ranked.agg(F.count("*")).scalar()
    train_end = F.greatest(F.lit(1), F.floor(total * 0.60))
    val_end = F.greatest(train_end + 1, F.floor(total * 0.80))
    placed = ranked.withColumn(
        "split", F.when(F.col("rank") <= train_end, "train").when(F.col("rank") <= val_end, "val").otherwise("test")
    )
    usable = placed.groupBy("split").agg(F.count_distinct("label").alias("labels")).where(F.col("labels") >= 2)
    fits = usable.agg(F.count("*")).scalar()
    return placed.where((total >= 6) & (fits == 3)).select("session_id", "split")


def family_holdouts(metadata: DataFrame) -> DataFrame:
    """Bot families that can be held out, with their number of sessions."""
    bots = metadata.where(F.col("label") == BOT)
    counts = (
        bots.where(blank_to_null(F.col("bot_family")).isNotNull() & (F.col("bot_family") != HUMAN))
        .groupBy(F.col("bot_family").alias("held_out")).agg(F.count("*").alias("held_out_sessions"))
        .where(F.col("held_out_sessions") >= 3)
    )
    humans = metadata.where(F.col("label") == HUMAN).agg(F.count("*")).scalar()
    all_bots = bots.agg(F.count("*")).scalar()
    families = counts.agg(F.count("*")).scalar()
    return counts.where((families >= 2) & (humans >= 6) & (all_bots - F.col("held_out_sessions") >= 4))


def participant_holdouts(metadata: DataFrame) -> DataFrame:
    """Human participants that can be held out, with their number of sessions."""
    known = blank_to_null(F.col("participant_id")).isNotNull()
    counts = (
        metadata.where((F.col("label") != BOT) & known)
        .groupBy(F.col("participant_id").alias("held_out"))
        .agg(F.count_if(F.col("label") == HUMAN).alias("held_out_sessions"), F.count("*").alias("_n"))
        .where(F.col("_n") >= 2)
    )
    people = counts.agg(F.count("*")).scalar()
    humans = metadata.where(F.col("label") == HUMAN).agg(F.count("*")).scalar()
    bots = metadata.where(F.col("label") == BOT).agg(F.count("*")).scalar()
    enough = (people >= 2) & (bots >= 6) & (F.col("held_out_sessions") >= 2) & (humans - F.col("held_out_sessions") >= 4)
    return counts.where(enough).drop("_n")


def balanced_folds(metadata: DataFrame, key: str, folds: int) -> DataFrame:
    """(value, sessions, fold) of each known value of ``key``; ``human`` as a family is no bot family.

    While there are at most ``folds`` values each is a fold of its own, by its name. More values are dealt
    by size, largest first, there and back over the folds, so folds differ by less than the largest value.
    """
    value = blank_to_null(F.col(key))
    sizes = metadata.where(value.isNotNull() & (value != HUMAN)).groupBy(F.col(key).alias("value")).agg(F.count("*").alias("sessions"))
    ranked = with_global_row_number(sizes, [F.desc("sessions"), F.col("value")], "_rank")
    place = (F.col("_rank") - 1) % folds
    turned = F.floor((F.col("_rank") - 1) / folds) % 2 == 1
    fold = F.format_string("fold_%02d", F.when(turned, folds - 1 - place).otherwise(place))
    alone = ranked.agg(F.count("*")).scalar() <= folds
    return ranked.select("value", "sessions", F.when(alone, F.col("value")).otherwise(fold).alias("fold"))


def in_folds(metadata: DataFrame, key: str, folds: int) -> DataFrame:
    """The metadata with each known value of ``key`` replaced by its balanced fold; people and families stay whole."""
    dealt = balanced_folds(metadata, key, folds).select(F.col("value").alias(key), F.col("fold").alias("_fold"))
    return metadata.join(dealt, key, "left").withColumn(key, F.coalesce("_fold", key)).select(*metadata.columns)


_PARTS = {
    # label -> shares of the sessions that are not held out
    "bot_family": {HUMAN: SPLIT_SHARES, BOT: [("train", 0.75), ("val", 0.25)]},
    "participant_id": {HUMAN: [("train", 0.75), ("val", 0.25)], BOT: SPLIT_SHARES},
}
_HELD_LABEL = {"bot_family": BOT, "participant_id": HUMAN}


def holdout_base(metadata: DataFrame, key: str, seed: str = DEFAULT_SEED) -> DataFrame:
    """What every hold-out of ``key`` shares: each session's split while it is not held out.

    A hold-out only moves the sessions of one key to test, so all of them are this one table plus a
    filter; no session is repeated per held-out value.
    """
    share = hash_share(F.col("session_id"), seed)
    split = None
    for label, shares in _PARTS[key].items():
        condition, value = F.col("label") == label, split_by_share(share, shares)
        split = F.when(condition, value) if split is None else split.when(condition, value)
    held = F.when(F.col("label") == _HELD_LABEL[key], F.col(key))
    return metadata.where(F.col("label").isin(BOT, HUMAN)).select(
        "session_id", "label", held.alias("held_out"), split.alias("base_split")
    )


def holdout_split(base: DataFrame, held_out: str) -> DataFrame:
    """The split with one family or participant held out."""
    is_held = F.coalesce(F.col("held_out") == held_out, F.lit(False))
    return base.select("session_id", F.when(is_held, "test").otherwise(F.col("base_split")).alias("split"))


def holdout_sizes(base: DataFrame, holdouts: DataFrame) -> DataFrame:
    """Sessions per hold-out, split and label, from totals less the held-out sessions' own."""
    totals = base.groupBy("label", F.col("base_split").alias("split")).agg(F.count("*").alias("total"))
    own = base.where(F.col("held_out").isNotNull()).groupBy("held_out", "label", F.col("base_split").alias("split")).agg(F.count("*").alias("own"))
    # six totals at most, exploded per hold-out
    listed = totals.agg(F.collect_list(F.struct("label", "split", "total")).alias("totals")).select("totals").scalar()
    parts = holdouts.select("held_out", "held_out_sessions", F.explode(listed).alias("t")).select("held_out", "held_out_sessions", "t.*")
    rest = parts.join(own, ["held_out", "label", "split"], "left").select(
        "held_out", "split", "label", (F.col("total") - F.coalesce("own", F.lit(0))).alias("n")
    )
    held_label = own.groupBy("held_out").agg(F.max("label").alias("label"))
    moved = holdouts.join(held_label, "held_out").select(
        "held_out", F.lit("test").alias("split"), "label", F.col("held_out_sessions").alias("n")
    )
    return rest.unionByName(moved).groupBy("held_out", "split").agg(
        F.sum("n").alias("num_sessions"),
        F.sum(F.when(F.col("label") == HUMAN, F.col("n")).otherwise(0)).alias("num_humans"),
        F.sum(F.when(F.col("label") == BOT, F.col("n")).otherwise(0)).alias("num_bots"),
    )


def with_split(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of the sessions in the split table, with their split."""
    return rows.join(splits.select("session_id", "split"), "session_id")


def split_summary(metadata: DataFrame, splits: DataFrame) -> DataFrame:
    """Sessions, humans, bots, participants and bot families per split."""
    joined = with_split(metadata, splits)
    families = (
        joined.where(F.col("label") == BOT).groupBy("split", "bot_family").agg(F.count("*").alias("n"))
        .groupBy("split").agg(F.array_sort(F.collect_list(
            F.struct((-F.col("n")).alias("order"), "bot_family"))).alias("families"))
        .select("split", F.array_join(F.transform("families", lambda f: F.concat(
            f["bot_family"], F.lit(":"), (-f["order"]).cast("string"))), "; ").alias("bot_family_counts"))
    )
    counts = joined.groupBy("split").agg(
        F.count("*").alias("num_sessions"),
        F.count_if(F.col("label") == HUMAN).alias("num_humans"),
        F.count_if(F.col("label") == BOT).alias("num_bots"),
        F.count_distinct(blank_to_null(F.col("participant_id"))).alias("num_participants"),
    )
    return counts.join(families, "split", "left").withColumn("bot_family_counts", F.coalesce("bot_family_counts", F.lit("")))
