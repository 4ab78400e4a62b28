"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Best fit only looks at lengths, so the whole plan follows from the number of pieces of each length:
at most ``capacity`` numbers, whatever the input. The plan is made on those; a segment tree over
remaining capacities finds the tightest open sequence in logarithmic time, and equal pieces are
placed together. Pieces then take their place by their rank among the pieces of their length, which
is a rank inside their input partition plus the counts of the partitions before it.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickwarden.llm.scratch import Scratch

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


class OpenBins:
    """Open bins by remaining capacity; a segment tree tells the least remaining capacity that fits."""

    def __init__(self, capacity: int):
        self._size = 1 << (capacity + 1).bit_length()
        self._any = [0] * (2 * self._size)
        self._runs: dict[int, list[list[int]]] = defaultdict(list)

    def add(self, remaining: int, first: int, count: int) -> None:
        self._runs[remaining].append([first, count])
        self._mark(remaining, 1)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is at least ``length``."""
        node = length + self._size
        if self._any[node]:
            return length
        while node > 1:
            if not node & 1 and self._any[node + 1]:
                node += 1
                while node < self._size:
                    node = 2 * node if self._any[2 * node] else 2 * node + 1
                return node - self._size
            node >>= 1
        return None

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins with this remaining capacity: first number and count."""
        run = self._runs[remaining][-1]
        count = min(most, run[1])
        first = run[0]
        run[0] += count
        run[1] -= count
        if not run[1]:
            self._runs[remaining].pop()
            if not self._runs[remaining]:
                self._mark(remaining, 0)
        return first, count

    def _mark(self, remaining: int, value: int) -> None:
        node = remaining + self._size
        self._any[node] = value
        while node > 1:
            node >>= 1
            self._any[node] = self._any[2 * node] | self._any[2 * node + 1]


@dataclass
class Plan:
    """Row i places pieces of ``length`` from ``rank`` on, ``each`` to a bin, from bin ``first`` at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    bins: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """The places of best-fit decreasing for so many pieces of each length (1 to capacity)."""
    open_bins, bins, rows = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = open_bins.tightest(length)
            room = capacity if remaining is None else remaining
            # the tightest bin stays the tightest until it is too full for this length
            each = min(room // length, left)
            if remaining is None:
                first, count = bins, left // each
                bins += count
            else:
                first, count = open_bins.take(remaining, left // each)
            rows.append((length, rank, each, first, capacity - room))
            if room - each * length:
                open_bins.add(room - each * length, first, count)
            rank += count * each
            left -= count * each
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return Plan(*(columns[:, i].copy() for i in range(5)), bins=bins)


#: Letters of Latin scripts, ASCII, and marks on which ``re`` and ``regex`` agree on all classes.
_UNUSUAL = re.compile("[^\t\n\r -~¡¿«»À-ÖØ-öø-ɏ]")


def word_splitter(pattern: str) -> Callable[[str], list[str]]:
    """The pattern's matches; texts without unusual letters go through the faster engine."""
    exact = regex.compile(pattern)
    swapped = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    fast = re.compile(swapped) if r"\p" not in swapped else None

    def split(text: str) -> list[str]:
        if fast is None or (not text.isascii() and _UNUSUAL.search(text)) or _CONTROL.search(text):
            return exact.findall(text)
        return fast.findall(text)

    return split


#: Separators that only one of the engines takes for white space.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """Ids by token bytes of a byte-level BPE file; its merges must be in the order of their ids.

    Then merging the pair of least id is merging by the file's order. In such files printable
    bytes stand for themselves and the others, in order, for the characters from 256 on.
    """
    model = json.loads(tokenizer_json)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("the merges of this tokenizer are not in the order of their ids")
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}


class _WordIds(dict):
    """Packed ids of words met so far; forgotten when there are too many."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        super().__init__()
        self._encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def trim(self) -> None:
        if len(self) > 200_000:
            self.clear()

    def __missing__(self, word: str) -> bytes:
        # a word is a match of the pattern, so it is one pre-token of its own
        packed = self[word] = array("I", self._encode(word)).tobytes()
        return packed


def _pieces(vocabulary, pattern: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        split, ids, ranks = word_splitter(pattern), _WordIds(vocabulary.value, pattern), defaultdict(int)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                chunk = batch.slice(at, 256)
                ids.trim()
                words = [split(text or "") for text in chunk.column("text").to_pylist()]
                for doc_id, row in zip(chunk.column("doc_id").to_pylist(), words):
                    packed = b"".join([ids[word] for word in row]) + end
                    total = len(packed) // 4
                    first = total % capacity or min(total, capacity)
                    starts = [0, *range(first, total, capacity), total]
                    for piece, (lo, hi) in enumerate(zip(starts, starts[1:])):
                        rows.append((doc_id, piece, lo, hi - lo, zlib.crc32(packed[4 * lo: 4 * hi]), part, ranks[hi - lo]))
                        ranks[hi - lo] += 1
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def _place(plan: Plan):
    # lengths and ranks as one sorted key: ranks of a length are below its count
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.searchsorted(plan.length, np.arange(plan.length.max(initial=0) + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                own = length == value
                lo, hi = lows[value], lows[value + 1]
                row[own] = lo + np.searchsorted(plan.rank[lo:hi], rank[own], side="right") - 1
            place = rank - plan.rank[row]
            sequence = plan.first[row] + place // plan.each[row]
            offset = plan.offset[row] + place % plan.each[row] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    A document is its ids by the tokenizer plus ``end_id``; a null or empty text is that id alone.
    Longer ones are cut into pieces of ``capacity``, of which the first may be shorter. Every row
    counts: rows repeated or with a null doc_id are packed like others. Columns besides doc_id and
    text are ignored. One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    with open(tokenizer_file, encoding="utf-8") as source:
        vocabulary = spark.sparkContext.broadcast(byte_ranks(source.read()))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = scratch.keep(rows.mapInArrow(_pieces(vocabulary, pattern, capacity, end_id), _PIECES))

    # partitions x lengths rows; ranks of a partition follow those of the partitions before
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("length", "part", "before")
    histogram = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_decreasing(histogram, capacity)
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    return ranked.mapInArrow(
        _place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {"op8_pack_documents": op8_pack_documents}
SQL: dict[str, str] = {}
