"""Toxicity by maximum-scoring segments of token log-odds.

Token log-odds of toxic against clean documents come from labelled rows with chained Dirichlet priors: the
prior of a word is the estimate of its six-byte beginning, whose prior is that of its four-byte
beginning, whose prior is the base rate. So an unseen form of a known stem still counts. Counts live in hashed tables
of fixed size. A linear scan finds all maximal scoring segments of a text; the extreme-value
distribution of segment scores in clean text (lambda and K) turns them into one calibrated
statistic, and a logistic fit into a probability. Every labelled row counts and calibrates: for the calibration
its own tokens are taken out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clickwarden.llm.arrays import NOT_WORD, Words, slices, text_bytes
from clickwarden.llm.labelled import fit_logistic, labelled_sample, remainder, sampled_documents

_BITS = 20
_SIZE = 1 << _BITS
#: Bytes of a word's beginning on the two upper levels; the third is the whole word.
STEMS = (4, 6)
_SALT = (0x51ED270B, 0x2545F491, 0)


@dataclass(frozen=True)
class Lexicon:
    """Toxic and all occurrences of labelled tokens by level and hash, and the calibration."""

    counts: np.ndarray | None = None  # [toxic | all][level, bucket]
    base: float = 0.5
    drift: float = 0.7
    decay: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0


def _buckets(words: Words) -> list[np.ndarray]:
    hashes = [words.prefix_hash(np.minimum(words.end, words.start + n)) for n in STEMS] + [words.hash]
    return [((h ^ (h << np.uint64(7)) ^ np.uint64(salt)) >> np.uint64(64 - _BITS)).astype(np.int64) for h, salt in zip(hashes, _SALT)]


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, total = (np.zeros((3, _SIZE), dtype=np.int32) for _ in range(2))
    for batch in batches:
        label = batch.column("label").to_numpy()
        for lo, hi in slices(batch.column("text")):
            words = Words(*text_bytes(batch.column("text")[lo:hi]), NOT_WORD)
            own = label[lo:hi][words.row] == 1
            for level, bucket in enumerate(_buckets(words)):
                for table, seen in ((total, bucket), (toxic, bucket[own])):
                    at, n = np.unique(seen, return_counts=True)
                    table[level, at] += n.astype(np.int32)
    for level in range(len(total)):
        bucket = np.flatnonzero(total[level])
        yield pa.record_batch([pa.array(np.full(len(bucket), level, np.int32)), pa.array(bucket.astype(np.int32)),
                               pa.array(toxic[level, bucket]), pa.array(total[level, bucket])],
                              names=["level", "bucket", "toxic", "total"])


def _lexicon(counts: pa.Table) -> Lexicon:
    level, bucket, toxic, total = (counts.column(c).to_numpy() for c in ("level", "bucket", "toxic", "total"))
    table = np.zeros((2, 3, _SIZE), dtype=np.float32)
    table[0, level, bucket], table[1, level, bucket] = toxic, total
    words = level == len(STEMS)
    return Lexicon(counts=table, base=float((toxic[words].sum() + 0.5) / (total[words].sum() + 1)))


def _token_scores(words: Words, lexicon: Lexicon, prior: float, own_label: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of each token over the base rate, less the drift that makes clean text score below zero.

    ``own_label`` has the label of each row when the rows themselves were counted: their tokens are then left out.
    """
    p = np.full(len(words.row), lexicon.base)
    for level, bucket in enumerate(_buckets(words)):
        toxic, total = (lexicon.counts[i, level][bucket].astype(np.float64) for i in (0, 1))
        if own_label is not None:
            _, at, n = np.unique(words.row * _SIZE + bucket, return_inverse=True, return_counts=True)
            total -= n[at]
            toxic -= n[at] * (own_label[words.row] == 1)
        p = (toxic + prior * p) / (total + prior)
    odds = lambda q: np.log(q) - np.log1p(-q)
    return np.clip(odds(p) - odds(lexicon.base), -4, 8) - lexicon.drift


def maximal_segments(position: list[int], score: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, by the linear-time scan over positive tokens.

    ``before`` is the running total of all scores up to each positive token. Segments are (first,
    last, score) with token positions; they are disjoint and in order.
    """
    first, last, left, right = [], [], [], []
    for at, own, low in zip(position, score, before):
        begin, low_total, high_total = at, low, low + own
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low_total:
                j -= 1
            if j < 0 or right[j] >= high_total:
                break
            begin, low_total = first[j], left[j]
            del first[j:], last[j:], left[j:], right[j:]
        first.append(begin)
        last.append(at)
        left.append(low_total)
        right.append(high_total)
    return [(a, b, r - l) for a, b, l, r in zip(first, last, left, right)]


def _scan(words: Words, score: np.ndarray, rows: int):
    """(row, first token, last token, score) of all maximal segments, and the tokens of each row."""
    sizes = np.bincount(words.row, minlength=rows)
    borders = np.concatenate([[0], np.cumsum(sizes)])
    running = np.cumsum(score) - score
    found = []
    positive = np.flatnonzero(score > 0)
    cuts = np.searchsorted(positive, borders)
    for row in np.flatnonzero(np.diff(cuts)):
        own = positive[cuts[row]: cuts[row + 1]]
        for a, b, s in maximal_segments(own.tolist(), score[own].tolist(), running[own].tolist()):
            found.append((row, a, b, s))
    return np.array(found, dtype=np.float64).reshape(-1, 4), sizes


def _statistic(found: np.ndarray, sizes: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """log of the summed exp(lambda S), less log(K n): how far a row's segments exceed chance."""
    total = np.zeros(len(sizes))
    np.add.at(total, found[:, 0].astype(int), np.expm1(np.minimum(lexicon.decay * found[:, 3], 500)))
    return np.log1p(total) - lexicon.log_k - np.log(np.maximum(sizes, 1))


def _calibration(lexicon: Lexicon, prior: float):
    """Per label: histogram of token scores (kind 0) and of the documents' statistic with K = 1 (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, model = {}, SimpleNamespace(**lexicon.value)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for lo, hi in slices(batch.column("text")):
                words = Words(*text_bytes(batch.column("text")[lo:hi]), NOT_WORD)
                score = _token_scores(words, model, prior, label[lo:hi])
                kinds = [(0, np.round(score * 20), label[lo:hi][words.row])]
                if model.decay > 0:
                    found, sizes = _scan(words, score, hi - lo)
                    kinds = [(1, np.round(np.clip(_statistic(found, sizes, model), -100, 100) * 20), label[lo:hi])]
                for kind, bins, own in kinds:
                    for value in (0, 1):
                        for b, n in zip(*np.unique(bins[own == value], return_counts=True)):
                            out[kind, value, int(b)] = out.get((kind, value, int(b)), 0) + int(n)
        keys = list(out)
        yield pa.record_batch([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array(list(out.values()), pa.int64())],
                              names=["kind", "label", "bin", "n"])

    return run


def _decay(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1."""
    if not (values > 0).any() or values @ share >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while share @ np.exp(np.minimum(high * values, 500)) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(np.minimum(middle * values, 500)) < 1 else (low, middle)
    return high


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_label: int = 10_000,
                 prior: float = 8.0) -> Lexicon:
    """Learn the lexicon and its calibration from at most ``per_label`` training rows of each label.

    Every such row gives counts and calibrates, there without its own tokens. Without rows of both labels the score is
    the smoothed share of label 1.
    """
    spark = docs.sparkSession
    sample, sizes = labelled_sample(labels, "toxic", modulus, held_out, per_label)
    sample = sample.persist()
    try:
        if not all(sizes.values()):
            p = (sizes[1] + 0.5) / (sum(sizes.values()) + 1)
            return Lexicon(intercept=float(np.log(p / (1 - p))), slope=0.0)
        rows = sampled_documents(docs, sample)
        counts = (rows.select("text", "label")
                  .mapInArrow(_count_tokens, "level int, bucket int, toxic int, total int")
                  .groupBy("level", "bucket").agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("total").cast("int").alias("total")))
        # at most three tables of fixed size
        lexicon = replace(_lexicon(counts.toArrow()), decay=0.0)
        calibrating = rows.select("text", "label")

        def histogram(kind):
            sent = spark.sparkContext.broadcast(vars(lexicon))
            got = calibrating.mapInArrow(_calibration(sent, prior), "kind int, label int, bin int, n long")
            got = got.groupBy("kind", "label", "bin").agg(F.sum("n").alias("n")).toPandas()
            sent.destroy()
            return got[got.kind == kind]

        clean = histogram(0).query("label == 0")
        if not len(clean):
            clean_values, share = np.array([-1.0]), np.array([1.0])
        else:
            clean_values, share = clean.bin.to_numpy() / 20, (clean.n / clean.n.sum()).to_numpy()
        lexicon = replace(lexicon, decay=_decay(clean_values, share))
        got = histogram(1)
        x, y, n = got.bin.to_numpy() / 20, got.label.to_numpy(), got.n.to_numpy().astype(float)
        # of a Gumbel distribution the mean lies Euler's constant above log K n
        log_k = float(np.average(x[y == 0], weights=n[y == 0])) - 0.5772156649 if (y == 0).any() else 0.0
        for value in (0, 1):
            if (y == value).any():
                n[y == value] *= sizes[value] / n[y == value].sum()
        slope, intercept = fit_logistic(x - log_k, y, n)
        return replace(lexicon, log_k=log_k, slope=max(slope, 0.0), intercept=intercept)
    finally:
        sample.unpersist()


def _score(lexicon, prior: float, significance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SimpleNamespace(**lexicon.value)
        for batch in batches:
            scores, passages = [], []
            for lo, hi in slices(batch.column("text")):
                if model.counts is None:
                    scores.append(np.zeros(hi - lo))
                    passages += [[]] * (hi - lo)
                    continue
                words = Words(*text_bytes(batch.column("text")[lo:hi]), NOT_WORD)
                found, sizes = _scan(words, _token_scores(words, model, prior), hi - lo)
                scores.append(_statistic(found, sizes, model))
                own = [[] for _ in range(hi - lo)]
                offsets = text_bytes(batch.column("text")[lo:hi])[1]
                for row, a, b, s in found:
                    row, a, b = int(row), int(a), int(b)
                    e_value = float(np.exp(min(model.log_k + np.log(sizes[row]) - model.decay * s, 500)))
                    if e_value <= significance:
                        own[row].append({"start": int(words.start[a] - offsets[row]), "end": int(words.end[b] - offsets[row]),
                                         "score": float(s), "e_value": e_value})
                passages += own
            z = np.clip(model.slope * np.concatenate(scores or [np.zeros(0)]) + model.intercept, -35, 35)
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z))), pa.array(passages, kinds)],
                                  names=["doc_id", "score", "passages"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, prior: float = 8.0, significance: float = 0.01) -> DataFrame:
    """doc_id, score (0 to 1), passages: spans in UTF-8 bytes whose expected number by chance is at most ``significance``.

    A null or empty text has no passages and the score of a text without evidence. Repeated rows
    and null ids are scored like others; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(vars(lexicon))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_score(model, prior, significance),
                           "doc_id long, score double, passages array<struct<start:long,end:long,score:double,e_value:double>>")


def with_toxicity(docs: DataFrame, lexicon: Lexicon, column: str, prior: float = 8.0) -> DataFrame:
    """The documents, all columns, with their toxicity score as ``column`` (a new name); the text doesn't move.

    A null or empty text has the score of a text without evidence. Repeated rows are scored alike; a long text is scored
    whole, in a slice of its own. An empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(vars(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = SimpleNamespace(**model.value)
        for batch in batches:
            # a slice goes out before the next is looked at
            for lo, hi in slices(batch.column("text")):
                part, score = batch.slice(lo, hi - lo), np.zeros(hi - lo)
                if known.counts is not None:
                    words = Words(*text_bytes(part.column("text")), NOT_WORD)
                    score = _statistic(*_scan(words, _token_scores(words, known, prior), hi - lo), known)
                    del words
                z = np.clip(known.slope * score + known.intercept, -35, 35)
                yield part.append_column(column, pa.array(1 / (1 + np.exp(-z))))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their toxicity score; learned from labels outside the held-out fifth."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
