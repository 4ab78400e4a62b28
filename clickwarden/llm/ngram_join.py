"""Jaccard join of documents on word n-grams by signature trees.

Equal sets are one class. A set is cut by hash ranges into more segments than two sets of the
threshold can differ in, so linked classes agree on several whole segments and, without those of fewest
elements and some frequent ones, still share a number of keys: classes that share as many, and theirs, form a cluster. In each cluster a signature tree excludes pairs; the links of the rest are
counted, listed or just closed to components. All counts in the bound are exact, no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwarden.llm.arrays import LOWER, WHITE, Words, mix, slices, text_bytes
from clickwarden.llm.grouping import blocks_of_clusters, connected_components, key_links
from clickwarden.llm.scratch import Scratch
from clickwarden.llm.signature_tree import tree_links


def agreements(differ: int) -> int:
    """Segments on which two linked sets agree at least, since there are so many more than elements can differ."""
    return 2 * shared_keys(differ) + 3 + differ // 3


def shared_keys(differ: int) -> int:
    """Keys that two linked sets have in common at least, although each leaves out ``agreements`` less as many.

    It leaves out those of the segments of fewest elements, empty ones and those of one element, which unlike sets share by a passage or two, and
    then as many again: frequent ones first. So many empty segments that some are left are rare.
    """
    return min(3 + differ // 10, _SHARED)


#: The end of a key: the number of keys to share, and whether the number of its size class is odd.
_SHARED, _ODD = 63, 64
#: One in so many sets tells which keys are frequent: those that so many of the told ones have.
_TOLD, _FREQUENT, _MOST_FREQUENT = 16, 2, 1 << 17


_OTHER = np.uint64(0x2127599BF4325C37)
_CLASS_STEP, _SEGMENT_STEP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


def size_classes(percent: int, most: int) -> np.ndarray:
    """Least sizes of classes such that a set links only within its class and to the next ones above and below."""
    borders = [1]
    while borders[-1] <= most:
        borders.append(100 * borders[-1] // percent + 1)
    return np.array(borders, dtype=np.int64)


def differences(most: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of at most ``most`` elements each."""
    # overlap >= percent * (x + y) / (100 + percent), so the rest is at most (x + y) * (100 - percent) / (100 + percent)
    return 2 * most * (100 - percent) // (100 + percent)


def segment_keys(elements: np.ndarray, percent: int, classes: np.ndarray) -> np.ndarray:
    """Keys of a sorted set: for its own size class as the upper one and for the next, of all segments but the weakest, in their order.

    The segments on which two linked sets agree have one order in both, so those that one of them leaves out are its first ones.
    """
    own = int(np.searchsorted(classes, len(elements), side="right")) - 1
    spread = mix(elements.copy())
    keys = []
    for c in (own, own + 1):
        most = int(classes[c + 1]) - 1
        differ = differences(most, percent)
        if not differ:
            continue
        segments = np.uint64(differ + agreements(differ))
        segment = ((elements >> np.uint64(32)) * segments) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums, used, held = np.add.reduceat(spread, starts), segment[starts], np.diff(np.append(starts, len(elements)))
        weak = agreements(differ) - 2 * shared_keys(differ)
        blank = int(segments) - len(used)
        if blank > weak:
            none = np.setdiff1d(np.arange(int(segments), dtype=np.uint64), used, assume_unique=True)
            sums, used, held = (np.concatenate([a, b]) for a, b in ((sums, np.zeros(blank, np.uint64)), (used, none), (held, np.zeros(blank, np.int64))))
            blank = 0
        own_keys = mix(sums + np.uint64(c * int(_CLASS_STEP) % (1 << 64)) + used * _SEGMENT_STEP)
        own_keys = (own_keys & ~np.uint64(_SHARED | _ODD)) | np.uint64(shared_keys(differ) + c % 2 * _ODD)
        # by elements, then by key: an order that all sets have in common, in which empty segments come first
        keys.append(own_keys[np.lexsort((own_keys, held))[weak - blank:]])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def without_frequent(keys: np.ndarray, borders: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which keys of some sets are kept: in each size class all but as many as must be shared, of frequent keys (sorted) or else the first ones."""
    number, row = np.arange(len(keys)), np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    odd = keys & np.int64(_ODD)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (odd[1:] != odd[:-1])
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    hot = np.zeros(len(keys), dtype=bool)
    if len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys
    needed = keys & np.int64(_SHARED)
    hot_so_far = np.concatenate([[0], np.cumsum(hot)])
    rank_hot = hot_so_far[:-1] - hot_so_far[start][group]
    all_hot = (hot_so_far[np.append(start[1:], len(keys))] - hot_so_far[start])[group]
    rank_other = number - start[group] - rank_hot
    return np.where(hot, rank_hot >= needed, rank_other >= needed - np.minimum(all_hot, needed))


def _kept_keys(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                lists, ids = batch.column("keys")[lo: lo + 1000], batch.column("id")[lo: lo + 1000].to_numpy()
                borders = lists.offsets.to_numpy().astype(np.int64)
                keys = lists.values.to_numpy()[borders[0]: borders[-1]]
                kept = without_frequent(keys, borders - borders[0], frequent.value)
                yield pa.record_batch([pa.array(keys[kept]), pa.array(np.repeat(ids, np.diff(borders))[kept])], names=["key", "id"])

    return run


def shingle_sets(column: pa.Array, n: int):
    """Sorted distinct hashes of the word n-grams of every row, with the row's number."""
    for lo, hi in slices(column):
        words = Words(*text_bytes(column[lo:hi]), WHITE, LOWER)
        first, gram = words.grams(n)
        cuts = np.searchsorted(words.row[first], np.arange(hi - lo + 1))
        borders = np.searchsorted(words.row, np.arange(hi - lo + 1))
        for row in range(hi - lo):
            if cuts[row] < cuts[row + 1]:
                yield lo + row, np.unique(gram[cuts[row]: cuts[row + 1]])
            elif borders[row] < borders[row + 1]:
                # too few words: the whole sequence is the one shingle
                yield lo + row, np.array([words.sequence_hash(borders[row], borders[row + 1])], dtype=np.uint64)
            else:
                yield lo + row, np.zeros(0, dtype=np.uint64)


def _sketch(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(percent, 1 << 40)
        for batch in batches:
            sizes, marks, others, keys = [], [], [], []
            for _, s in shingle_sets(batch.column("text"), n):
                sizes.append(len(s))
                marks.append(mix(s.copy()).sum(dtype=np.uint64) if len(s) else np.uint64(0))
                others.append(mix(s ^ _OTHER).sum(dtype=np.uint64) if len(s) else np.uint64(0))
                keys.append(segment_keys(s, percent, classes).view(np.int64) if len(s) else np.zeros(0, np.int64))
            cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64)),
                 pa.array(np.array(others, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                names=["doc_id", "n_shingles", "mark", "other", "keys"])

    return run


def _elements(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, kept = batch.column("mark").to_pylist(), []
            for row, s in shingle_sets(batch.column("text"), n):
                # of several rows with one doc_id, the one with this set
                same = len(s) and int(mix(s.copy()).sum(dtype=np.uint64).view(np.int64)) == marks[row]
                kept.append(s.tobytes() if same else None)
            out = batch.select(["block", "cluster", "id"]).append_column("elements", pa.array(kept, pa.binary()))
            yield out.filter(out.column("elements").is_valid())

    return run


def _class_sets(docs: DataFrame, n: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, classes of equal sets, and the sets of the classes that may have a partner, in blocks."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketches = scratch.keep(texts.mapInArrow(_sketch(n, percent), "doc_id long, n_shingles long, mark long, other long, keys array<long>"))
    filled = sketches.where("n_shingles > 0")
    classes = scratch.keep(filled.groupBy("n_shingles", "mark", "other").agg(F.min("doc_id").alias("class_id"))
                           .withColumn("id", F.xxhash64("n_shingles", "mark", "other")))
    keyed = filled.select("keys", F.xxhash64("n_shingles", "mark", "other").alias("id"))
    told = keyed.where(F.pmod(F.xxhash64("id"), F.lit(_TOLD)) == 0).select(F.explode("keys").alias("key"), "id").distinct()
    listed = told.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= _FREQUENT).orderBy(F.desc("n"), "key").limit(_MOST_FREQUENT)
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(listed.select("key").toArrow().column("key").to_numpy()))
    links = key_links(keyed.mapInArrow(_kept_keys(frequent), "key long, id long"), scratch, shared=lambda keys: keys & np.int64(_SHARED))
    frequent.destroy()
    clusters = connected_components(links, scratch).select("id", F.col("root").alias("cluster"))
    members = classes.where("class_id IS NOT NULL").join(clusters, "id").select("cluster", F.col("n_shingles").alias("weight"), "id", "mark", "class_id")
    blocks = scratch.keep(blocks_of_clusters(members).select("block", "cluster", "id", "mark", F.col("class_id").alias("doc_id")))
    # the text of one document of each class that may have a partner
    sets = texts.join(blocks.hint("merge"), "doc_id").select("block", "cluster", "id", "mark", "text").mapInArrow(_elements(n), "block long, cluster long, id long, elements binary")
    return sketches, classes, sets


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(class_a, class_b), class_a < class_b: every pair of different sets that links as in ``ngram_components``.

    A group of near copies has as many pairs as it has; to count them, ask ``ngram_components`` for ``n_links``.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    _, classes, sets = _class_sets(docs, n, percent, scratch)
    found = scratch.keep(tree_links(sets, percent, scratch, output="every"))
    scratch.free_others(classes, found)
    a, b = (classes.select(F.col("id").alias(s), F.col("class_id").alias(f"class_{s}")) for s in "ab")
    both = found.join(a, "a").join(b, "b")
    return both.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row; two rows link at 100 * overlap >= percent * union.

    Words are separated by ASCII white space, A-Z are lower-cased. A text of fewer than ``n`` words
    has its whole sequence as one shingle; a null, empty or blank text has none and links to
    nothing. ``class_id`` is the smallest doc_id with the same set, ``component_id`` the smallest
    reachable over links. Shingles are compared by 64-bit hashes, sets by 128 bits and size. A row without doc_id
    has null as both where no other row of its set has one; such a set links to no other. Repeated rows stay rows.

    ``count_links`` adds ``n_links``, the number of other sets that the row's set links to, for which every pair is compared.
    Without it, pairs that other links join already are skipped: right for components, but not all links are found.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    sketches, classes, sets = _class_sets(docs, n, percent, scratch)
    counted = []
    if count_links:
        found = scratch.keep(tree_links(sets, percent, scratch, output="counts"))
        joined = connected_components(found.where("n IS NULL").select("a", "b"), scratch)
        counted.append(found)
    else:
        joined = connected_components(tree_links(sets, percent, scratch), scratch)
    scratch.free_others(sketches, classes, joined, *counted)
    roots = classes.join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = roots.groupBy("root").agg(F.min("class_id").alias("component_id"))
    columns = ["class_id", "component_id"]
    of_class = roots.join(smallest, "root").select("id", "n_shingles", "mark", "other", *columns)
    if count_links:
        counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
        of_class = of_class.join(counts, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        columns.append("n_links")
    of_class = of_class.drop("id")
    rows = sketches.select("doc_id", "n_shingles", "mark", "other")
    full = rows.where("n_shingles > 0").join(of_class, ["n_shingles", "mark", "other"]).select("doc_id", "n_shingles", *columns)
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    if count_links:
        empty = empty.withColumn("n_links", F.lit(0).cast("long"))
    return full.unionByName(empty)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component and number of links over 3-word shingles at a similarity of 0.9."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90, count_links=True).select(
        "doc_id", "n_shingles", "component_id", "class_id", "n_links")


QUERIES = {"op2_ngram_join": op2_ngram_join}
SQL: dict[str, str] = {}
