"""Exact duplicates by content sort: range partitions of the sorted texts, neighbours compared whole.

Sampled splitters range-partition the rows by their bytes and id, the sort inside a partition spills
to disk, and one pass over the sorted rows compares each whole text with the one before it. For the
splitters, which pass through the driver, a text's bytes are its beginning and the SHA-256 of all,
so they stay small. A group of copies may run over many partitions, since the id is part of
the sort key: each partition reports its first and last text, and neighbouring partitions are joined
where those are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickwarden.llm.scratch import Scratch

_SORTED = "id long, sha string, part long, run long, again boolean, edge int, edge_text string"
FIRST, LAST = 1, 2
#: Characters of a text's beginning in the sort key.
HEAD = 32


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts in a sorted partition; its first and last row keep the text."""
    part = TaskContext.get().partitionId()
    run, before, before_id, held, first = -1, None, None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text")
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        new[0] = first or text[0].as_py() != before
        runs = run + np.cumsum(new)
        ids = batch.column("id").to_pylist()
        again = ~new
        again &= np.array([a == b for a, b in zip(ids, [before_id, *ids])], dtype=bool)
        edge = np.zeros(batch.num_rows, dtype=np.int32)
        edge[0] = FIRST if first else 0
        shown = pa.array([text[0].as_py()] if first else [None], pa.string())
        if batch.num_rows > 1:
            shown = pa.concat_arrays([shown, pa.nulls(batch.num_rows - 1, pa.string())])
        out = pa.record_batch(
            [batch.column("id").cast(pa.int64()), batch.column("sha"), pa.array(np.full(len(edge), part, np.int64)),
             pa.array(runs, pa.int64()), pa.array(again), pa.array(edge), shown],
            names=["id", "sha", "part", "run", "again", "edge", "edge_text"])
        run, before, before_id, first = int(runs[-1]), text[-1].as_py(), ids[-1], False
        # the last row waits: it may be the last of the partition
        if held is not None:
            yield held
        yield out[:-1]
        held = out[-1:]
    if held is not None:
        row = held.to_pylist()[0]
        yield pa.RecordBatch.from_pylist([row | {"edge": row["edge"] | LAST, "edge_text": before}], schema=held.schema)


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest",
                     normalise: Callable[[Column], Column] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``smallest`` or ``largest``: which id of equal texts stays. ``normalise`` maps the
    text column to what is compared (nothing by default). A null text counts as empty; a null id
    takes part in its group and stays only if the group has no other id. Of rows with the
    same id and text all but one are dropped too. Other columns are ignored. An empty table gives
    an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), (normalise(text) if normalise else text).alias("text"))
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD), "sha": F.sha2(F.encode("text", "UTF-8"), 256)})
    ordered = rows.repartitionByRange(n, "head", "sha", "id").sortWithinPartitions("head", "sha", "text", "id")
    marked = scratch.keep(ordered.select("id", "text", "sha").mapInArrow(_runs, _SORTED))

    # one narrow row per partition: does its first run continue the last run of the one before?
    edges = marked.where("edge > 0").groupBy("part").agg(
        F.min(F.when(F.col("edge").bitwiseAND(FIRST) > 0, F.col("edge_text"))).alias("head"),
        F.min(F.when(F.col("edge").bitwiseAND(LAST) > 0, F.col("edge_text"))).alias("tail"),
        F.max("run").alias("last_run"))
    order = Window.orderBy("part")
    pairs = edges.select("part", "last_run").withColumn("previous", F.lag("part").over(order))
    linked = (pairs.join(edges.select("part", "head"), "part")
              .join(edges.select(F.col("part").alias("previous"), "tail"), "previous", "left")
              .select("part", "last_run", F.coalesce(F.col("head") == F.col("tail"), F.lit(False)).alias("joined")))
    # a partition's last run starts in the nearest partition, itself included, that opens it
    opens = linked.withColumn("opened", F.when(~F.col("joined") | (F.col("last_run") > 0), F.col("part")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = opens.withColumn("carrier", F.last("opened", ignorenulls=True).over(before))
    carrier = opens.where("joined").select("part", F.lit(0).cast("long").alias("run"), "carrier")
    carrier = carrier.join(opens.select(F.col("part").alias("carrier"), F.col("last_run").alias("carrier_run")), "carrier")

    better = F.max("id") if keep == "largest" else F.min("id")
    runs = (marked.groupBy("part", "run").agg(F.count("*").alias("n"), better.alias("best"))
            .join(carrier, ["part", "run"], "left")
            .withColumn("group_part", F.coalesce("carrier", "part"))
            .withColumn("group_run", F.when(F.col("carrier").isNull(), F.col("run")).otherwise(F.col("carrier_run"))))
    better = F.max("best") if keep == "largest" else F.min("best")
    groups = runs.groupBy("group_part", "group_run").agg(F.sum("n").alias("group_size"), better.alias("keep_id"))
    lookup = runs.join(groups, ["group_part", "group_run"]).select("part", "run", "group_size", "keep_id")
    # a part and run has at most one partition's rows, however large the group
    out = marked.select("id", "sha", "part", "run", "again").join(lookup, ["part", "run"])
    return out.select(
        F.col("id").alias(id_column), "keep_id", "group_size",
        (F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()) & ~F.col("again")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of each group of equal texts (the largest id)."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
SQL = {"op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""}
