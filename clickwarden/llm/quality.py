"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words; only documents have labels. Every
passage becomes a feature vector and is encoded by a learned layer; gated attention learns which
passages speak for the document, and the score is a logistic function of the weighted passage
encoding. Training averages parameters: each of a fixed number of shards of the bounded labelled
sample takes some epochs from the common parameters, then their mean is the next common state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clickwarden.llm.arrays import WHITE, Words, slices, text_bytes
from clickwarden.llm.labelled import labelled_sample, remainder, sampled_documents
from clickwarden.llm.scratch import Scratch

PASSAGE_WORDS = 64
_BIGRAMS = 64
_LAGS = (1, 2, 3, 4, 5, 8)
#: Byte classes: other, lower, upper, digit, white space, sentence marks, symbols, other scripts.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASSES = 8
FEATURES = _CLASSES * _CLASSES + _BIGRAMS + len(_LAGS) + 4
HIDDEN, GATE = 16, 8


def passage_features(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, its features). Every row has a passage; that of an empty text is all zero."""
    rows = len(borders) - 1
    words = Words(data, borders, WHITE, fold=None)
    sizes = np.bincount(words.row, minlength=rows)
    first_word = np.concatenate([[0], np.cumsum(sizes)])
    passages = np.maximum(1, -(-sizes // PASSAGE_WORDS))
    first_passage = np.concatenate([[0], np.cumsum(passages)])
    of_row = np.repeat(np.arange(rows), passages)
    n = len(of_row)
    of_word = first_passage[words.row] + (np.arange(len(words.row)) - first_word[words.row]) // PASSAGE_WORDS
    out = np.zeros((n, FEATURES), dtype=np.float32)
    own_words = np.bincount(of_word, minlength=n)
    count = np.maximum(own_words, 1)
    # a passage's bytes run from its first word to the next passage
    begins = borders[of_row].copy()
    opens = np.flatnonzero(np.diff(of_word, prepend=-1))
    later = (words.row[opens] == np.roll(words.row[opens], 1)) & (np.arange(len(opens)) > 0)
    begins[of_word[opens[later]]] = words.start[opens[later]]
    lengths = np.diff(np.append(begins, borders[-1]))
    of_byte = np.repeat(np.arange(n), lengths)
    kind = _CLASS[data]
    pair = kind[:-1] * _CLASSES + kind[1:]
    inside = of_byte[:-1] == of_byte[1:]
    left = of_byte[:-1][inside]
    k = _CLASSES * _CLASSES
    out[:, :k] = np.bincount(left * k + pair[inside], minlength=n * k).reshape(n, k)
    hashed = (data[:-1].astype(np.int64) * 31 + data[1:].astype(np.int64) * 17) % _BIGRAMS
    out[:, k:k + _BIGRAMS] = np.bincount(left * _BIGRAMS + hashed[inside], minlength=n * _BIGRAMS).reshape(n, _BIGRAMS)
    out[:, :k + _BIGRAMS] = np.sqrt(out[:, :k + _BIGRAMS] / np.maximum(lengths, 1)[:, None])
    at = k + _BIGRAMS
    for lag in _LAGS:
        if len(of_word) > lag:
            same = (words.hash[lag:] == words.hash[:-lag]) & (of_word[lag:] == of_word[:-lag])
            out[:, at] = np.bincount(of_word[lag:][same], minlength=n) / count
        at += 1
    size = (words.end - words.start).astype(float)
    mean = np.bincount(of_word, weights=size, minlength=n) / count
    out[:, at] = mean / 8
    out[:, at + 1] = np.sqrt(np.maximum(np.bincount(of_word, weights=size * size, minlength=n) / count - mean * mean, 0)) / 8
    out[:, at + 2] = np.bincount(of_word, weights=(size == 1), minlength=n) / count
    out[:, at + 3] = np.log1p(own_words) / 4
    return of_row, out


def initial_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed).normal
    return {
        "W": draw(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
        "V": draw(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": draw(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "w": draw(0, 0.3, GATE),
        "c": draw(0, 0.3, HIDDEN), "d": np.zeros(1),
    }


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def forward(p: dict, x: np.ndarray, borders: np.ndarray) -> dict:
    """Encodings, attention and scores of bags; bag i has the passages borders[i]..borders[i+1]-1 (one or more)."""
    first, bag = borders[:-1], np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    e = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
    energy = (v * u) @ p["w"]
    weight = np.exp(energy - np.maximum.reduceat(energy, first)[bag])
    weight /= np.add.reduceat(weight, first)[bag]
    z = np.add.reduceat(weight[:, None] * e, first)
    return {"e": e, "v": v, "u": u, "a": weight, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["d"][0])}


def gradient(p: dict, x: np.ndarray, borders: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
    """Gradient of the weighted mean cross-entropy."""
    f = forward(p, x, borders)
    delta = weight * (f["y"] - label) / weight.sum()
    dz = delta[:, None] * p["c"]
    bag, a, e = f["bag"], f["a"], f["e"]
    de = a[:, None] * dz[bag]
    da = (e * dz[bag]).sum(1)
    denergy = a * (da - np.add.reduceat(a * da, borders[:-1])[bag])
    dv = denergy[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
    du = denergy[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
    de = de + dv @ p["V"].T + du @ p["U"].T
    dh = de * (1 - e ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": e.T @ dv, "U": e.T @ du, "w": (f["v"] * f["u"]).T @ denergy,
            "c": f["z"].T @ delta, "d": np.array([delta.sum()])}


def train_locally(p: dict, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int, seed: int,
                  rate: float = 0.01, decay: float = 1e-4, batch: int = 64) -> dict:
    """Some epochs of mini-batch steps with momentum estimates (Adam) over one shard."""
    p = {k: v.copy() for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            own = order[lo: lo + batch]
            borders = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
            g, step = gradient(p, np.concatenate([bags[i] for i in own]).astype(np.float64), borders, label[own], weight[own]), step + 1
            for k in p:
                grad = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return p


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column("text")):
            of_row, x = passage_features(*text_bytes(batch.column("text")[lo:hi]))
            cuts = np.searchsorted(of_row, np.arange(hi - lo + 1))
            packed = [x[a:b].astype(np.float16).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([batch.column("shard")[lo:hi], batch.column("label")[lo:hi], pa.array(packed, pa.binary())],
                                  names=["shard", "label", "bag"])


def _train_shards(state, weights: dict[int, float], epochs: int, turn: int):
    """Each shard's parameters after its epochs, as bytes, with its number of bags."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            for shard, label, bag in zip(*(batch.column(c).to_pylist() for c in ("shard", "label", "bag"))):
                shards.setdefault(shard, []).append((label, np.frombuffer(bag, np.float16).reshape(-1, FEATURES)))
        for shard, rows in shards.items():
            label = np.array([r[0] for r in rows], dtype=float)
            weight = np.where(label > 0, weights[1], weights[0])
            p = train_locally(state.value, [r[1] for r in rows], label, weight, epochs, 1000 * turn + shard)
            flat = np.concatenate([p[k].ravel() for k in sorted(p)])
            yield pa.record_batch([pa.array([len(rows)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "flat"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_label: int = 10_000,
                shards: int = 6, turns: int = 5, epochs: int = 4) -> dict[str, np.ndarray]:
    """Learn from at most ``per_label`` training rows of each label; a shard holds 1 / ``shards`` of them.

    Labels weigh so that both sides count as often as they occur among all training labels.
    Without labelled rows of both labels, or without any of their documents, the score is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    sample, sizes = labelled_sample(labels, "quality", modulus, held_out, per_label)
    p = initial_parameters()
    share = (sizes[1] + 0.5) / (sum(sizes.values()) + 1)
    untrained = p | {"c": np.zeros(HIDDEN), "d": np.array([np.log(share / (1 - share))])}
    if not all(sizes.values()):
        return untrained
    scratch = Scratch(spark, "quality")
    rows = sampled_documents(docs, sample).select("text", "label", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int").alias("shard"))
    bags = scratch.keep(rows.mapInArrow(_bags, "shard int, label int, bag binary").repartition(shards, "shard"))
    weights = {value: sizes[value] / min(sizes[value], per_label) for value in (0, 1)}
    for turn in range(turns):
        state = spark.sparkContext.broadcast(p)
        # every shard lies in one file group, whichever task reads it
        got = (bags.repartition(shards, "shard").mapInArrow(_train_shards(state, weights, epochs, turn), "n long, flat binary").collect())
        if not got:  # none of the labelled rows is among the documents
            return untrained
        total = sum(r.n for r in got)
        flat = sum(np.frombuffer(r.flat) * (r.n / total) for r in sorted(got, key=lambda r: r.flat))
        at = 0
        for k in sorted(p):
            p[k] = flat[at: at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        state.unpersist()
    scratch.free(bags)
    return p


def _score(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = state.value
        for batch in batches:
            score, strongest, weight, passages = ([np.zeros(0)] for _ in range(4))
            for lo, hi in slices(batch.column("text")):
                of_row, x = passage_features(*text_bytes(batch.column("text")[lo:hi]))
                borders = np.searchsorted(of_row, np.arange(hi - lo + 1))
                f = forward(p, x.astype(np.float64), borders)
                most = np.maximum.reduceat(f["a"], borders[:-1])
                at = np.flatnonzero(f["a"] == most[f["bag"]])
                where = np.zeros(hi - lo, dtype=np.int64)
                where[f["bag"][at][::-1]] = at[::-1]
                score.append(f["y"])
                strongest.append(where - borders[:-1])
                weight.append(most)
                passages.append(np.diff(borders))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.concatenate(score)), pa.array(np.concatenate(passages).astype(np.int64)),
                 pa.array(np.concatenate(strongest).astype(np.int64)), pa.array(np.concatenate(weight))],
                names=["doc_id", "score", "passages", "strongest_passage", "attention"])

    return run


def score_quality(docs: DataFrame, parameters: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score (0 to 1), number of passages, the passage with most attention and its weight.

    A null, empty or blank text is one passage without features. Repeated rows and null ids are
    scored like others; other columns are ignored.
    """
    state = docs.sparkSession.sparkContext.broadcast(parameters)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_score(state), "doc_id long, score double, passages long, strongest_passage long, attention double")


def with_quality(docs: DataFrame, parameters: dict[str, np.ndarray], column: str) -> DataFrame:
    """The documents, all columns, with their quality score as ``column`` (a new name); the text doesn't move.

    A null, empty or blank text is one passage without features. Repeated rows are scored alike; a long text is scored
    whole, in a slice of its own. An empty table stays empty.
    """
    state = docs.sparkSession.sparkContext.broadcast(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a slice goes out before the next is looked at
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                of_row, x = passage_features(*text_bytes(part.column("text")))
                score = forward(state.value, x.astype(np.float64), np.searchsorted(of_row, np.arange(hi - lo + 1)))["y"]
                yield part.append_column(column, pa.array(score))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their quality score; learned from labels outside the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages", "strongest_passage", "attention")


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
SQL: dict[str, str] = {}
