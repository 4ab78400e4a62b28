"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard, one line per component.

Lines are signed by one-permutation MinHash with rotation for empty bins; bands of bins put similar
lines under one key. Keys are linked by sorting, not by pairs, so a line that half the corpus
repeats costs what it counts; lines of one key whose marked shingles show that they can't reach the
threshold stay apart. Inside the clusters that come out, every pair above the threshold is
found on exact shingle sets, and a distributed union-find closes the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwarden.llm.arrays import mix, powers, slices
from clickwarden.llm.grouping import blocks_of_clusters, connected_components, key_links
from clickwarden.llm.scratch import Scratch, unused_names
from clickwarden.llm.signature_tree import reachable, tree_links

SHINGLE = 8
#: A pair shares no band with a probability of 0.9 % at a similarity of 0.8, 0.09 % at 0.85, 1 in 45,000 at 0.9.
BANDS, BAND_BINS = 12, 5
_BINS = BANDS * BAND_BINS
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Lines whose keys a task remembers to have given; a forgotten one only gives them again.
_REMEMBERED = 500_000


def compared_lines(text: str | None) -> list[str]:
    """What is compared of each line: lower case, without white space at the ends."""
    return [line.strip() for line in (text or "").lower().split("\n")]


class Lines:
    """Shingle hashes of some lines: ``line`` and ``hash`` per shingle, ``mark`` and ``other`` per line."""

    def __init__(self, lines: list[str]):
        size = np.array([len(x) for x in lines], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        place = np.arange(len(codes)) - np.repeat(begin[:-1], size)
        up, down = powers(int(size.max(initial=0)))
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix(codes) * up[place], out=sums[1:])
        whole = sums[begin[1:]] - sums[begin[:-1]]
        self.mark = mix(whole + size.astype(np.uint64))
        self.other = mix(whole ^ (size.astype(np.uint64) * _STEP))
        shingles = np.where(size > 0, np.maximum(size - SHINGLE + 1, 1), 0)
        self.size = shingles
        self.line = np.repeat(np.arange(len(lines)), shingles)
        first = np.arange(len(self.line)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(begin[:-1], shingles)
        last = np.minimum(first + SHINGLE, np.repeat(begin[1:], shingles))
        self.hash = mix((sums[last] - sums[first]) * down[place[first]])


def band_keys(lines: Lines, count: int) -> np.ndarray:
    """(count, BANDS) keys; lines that agree in all bins of a band have its key in common."""
    least = np.full(count * _BINS, _NONE, dtype=np.uint64)
    bins = ((lines.hash >> np.uint64(32)) * np.uint64(_BINS)) >> np.uint64(32)
    np.minimum.at(least, lines.line * _BINS + bins.astype(np.int64), lines.hash)
    least = least.reshape(count, _BINS)
    holes = np.flatnonzero((least == _NONE).any(1) & (lines.size > 0))
    if len(holes):
        # an empty bin borrows from the next filled one to its right, marked by the distance
        twice = np.concatenate([least[holes]] * 2, axis=1)
        at = np.where(twice != _NONE, np.arange(2 * _BINS), 2 * _BINS)
        following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :_BINS]
        distance = (following - np.arange(_BINS)).astype(np.uint64)
        least[holes] = np.take_along_axis(twice, following, axis=1) + distance * _STEP
    grouped = least.reshape(count, BANDS, BAND_BINS)
    total = np.zeros((count, BANDS), dtype=np.uint64)
    for j in range(BAND_BINS):
        total = (total + grouped[:, :, j]) * _STEP
    return mix(total + np.arange(BANDS, dtype=np.uint64))


def line_bits(lines: Lines) -> np.ndarray:
    """64 bits per line, those that some shingle falls on."""
    ends = np.cumsum(lines.size)
    bits = np.zeros(len(ends), dtype=np.uint64)
    filled = lines.size > 0
    if filled.any():
        bits[filled] = np.bitwise_or.reduceat(np.uint64(1) << (lines.hash & np.uint64(63)), (ends - lines.size)[filled])
    return bits


def may_link(percent: int):
    """For pairs of lines by (bits, size): whether they could reach the threshold; repeated shingles count in a size."""
    def alike(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        (bits_a, size_a), (bits_b, size_b) = a, b
        lost_a, lost_b = (np.bitwise_count(x.view(np.uint64)).astype(np.int64) for x in (bits_a & ~bits_b, bits_b & ~bits_a))
        return reachable(size_a, size_b, 1, 1, lost_a, lost_b, percent)

    return alike


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of every line, and keys where the task meets a line for the first time: equal lines have equal keys."""
    seen: set[int] = set()
    for batch in batches:
        for lo, hi in slices(batch.column("text")):
            texts = batch.column("text")[lo:hi].to_pylist()
            distinct: dict[str, int] = {}
            found = [(row, at, distinct.setdefault(line, len(distinct)))
                     for row, text in enumerate(texts) for at, line in enumerate(compared_lines(text)) if line]
            if not found:
                continue
            row, at, which = (np.array(c) for c in zip(*found))
            signed = Lines(list(distinct))
            keys, bits = band_keys(signed, len(distinct)).view(np.int64), line_bits(signed).view(np.int64)
            # the first place of each line in the slice, unless a slice before had it
            first = np.zeros(len(which), dtype=bool)
            first[np.unique(which, return_index=True)[1]] = True
            marks = signed.mark.tolist()
            first[first] = [marks[w] not in seen for w in which[first].tolist()]
            if len(seen) > _REMEMBERED:
                seen.clear()
            seen.update(marks)
            cuts = np.concatenate([[0], np.cumsum(np.where(first, BANDS, 0))]).astype(np.int32)
            yield pa.record_batch(
                [batch.column("doc_id")[lo:hi].take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(signed.size[which]),
                 pa.array(signed.mark[which].view(np.int64)), pa.array(signed.other[which].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[which[first]].ravel())), pa.array(np.where(first, bits[which], 0))],
                names=["doc_id", "line", "size", "mark", "other", "keys", "bits"])


def shingle_sets(packed: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of compared lines."""
    signed = Lines([line.decode() for line in packed])
    cuts = np.concatenate([[0], np.cumsum(signed.size)])
    return [np.unique(signed.hash[a:b]) for a, b in zip(cuts, cuts[1:])]


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("cluster", pa.int64()), ("id", pa.int64()), ("elements", pa.binary())])
    for batch in batches:
        for lo, hi in slices(batch.column("text")):
            part, wanted, lines = batch.slice(lo, hi - lo), [], []
            for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist()):
                own = compared_lines(text)
                for p in places:
                    if p["line"] < len(own) and own[p["line"]]:
                        wanted.append(p)
                        lines.append(own[p["line"]])
            if not lines:
                continue
            marks = Lines(lines).mark.view(np.int64).tolist()
            # of several rows with one doc_id, the one that has this line
            rows = [{"block": p["block"], "cluster": p["cluster"], "id": p["id"], "elements": line.encode()}
                    for p, line, mark in zip(wanted, lines, marks) if mark == p["mark"]]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def line_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per non-blank line: doc_id, line (from 0), keep_doc_id, keep_line, group_size, kept.

    Lines end at line feeds. Two lines link when their sets of 8-character shingles (of the line in
    lower case without white space at its ends; a shorter line is one shingle) reach 100 * overlap
    >= percent * union; the first line of a component by (doc_id, line) stays. Blank lines take no part and always
    stay; a null text has none. Rows that repeat a doc_id count as documents of their own, and of
    equal lines at equal places of theirs all stay or go together. Rows without doc_id keep all their lines and take no part.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    signed = scratch.keep(texts.mapInArrow(_sign, "doc_id long, line int, size long, mark long, other long, keys array<long>, bits long"))
    same = ["size", "mark", "other"]
    classes = scratch.keep(signed.groupBy(*same).agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
                           .withColumn("id", F.xxhash64(*same)))
    keys = signed.select(F.explode("keys").alias("key"), F.xxhash64(*same).alias("id"), "bits", "size")
    links = key_links(keys, scratch, may_link(percent))
    clusters = connected_components(links, scratch).select("id", F.col("root").alias("cluster"))
    members = classes.join(clusters, "id").select("cluster", F.col("size").alias("weight"), "id", "mark", "first.doc_id", "first.line")
    blocks = blocks_of_clusters(members)
    # at most one entry for each line of a document
    places = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("line", "block", "cluster", "id", "mark")).alias("places"))
    sets = texts.join(places.hint("merge"), "doc_id").select("text", "places").mapInArrow(_elements, "block long, cluster long, id long, elements binary")
    joined = connected_components(tree_links(sets, percent, scratch, shingle_sets), scratch)
    scratch.free_others(signed, classes, joined)
    roots = classes.join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = roots.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("group_size"))
    of_class = roots.join(groups, "root").select(*same, "keep", "group_size")
    lines = signed.select("doc_id", "line", *same).join(of_class, same)
    return lines.select("doc_id", "line", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), "group_size",
                        (F.struct("doc_id", "line") == F.col("keep")).alias("kept"))


def deduplicate_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without their dropped lines; a document that only had dropped lines goes.

    Other columns stay as they are. Documents without any line to compare stay untouched.
    """
    own, gone, left = unused_names(docs, "doc", "dropped", "lines")
    dropped = (line_groups(docs, percent).where("NOT kept").groupBy(F.col("doc_id").alias(own))
               .agg(F.array_sort(F.collect_set("line")).alias(gone)))
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda line, at: ~F.array_contains(F.col(gone), at))
    both = docs.join(dropped, docs.doc_id.cast("long") == F.col(own), "left")
    both = both.withColumn(left, F.when(F.col(gone).isNotNull(), kept))
    both = both.where(F.col(left).isNull() | F.exists(left, lambda line: F.trim(line) != ""))
    return both.withColumn("text", F.coalesce(F.array_join(left, "\n"), F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents with the line that stays of each fuzzy group."""
    return line_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
SQL: dict[str, str] = {}
