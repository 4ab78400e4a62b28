"""Byte-level BPE by a global shuffle of distinct words.

Documents are cut into pre-tokens. A block is some consecutive documents of a task: it keeps each
document as positions into the block's own word list. The words are shuffled by buckets of their
hash, so that each distinct word of the corpus is encoded once; the ids go back to the blocks that
named the word and documents are put together by position. Decoding looks up the ids in the
token-byte table. Words and positions travel packed, a row for each block and bucket.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwarden.llm.packing import word_splitter

#: A block ends when it has so many pre-tokens or distinct words; a longer document is a block of its own.
BLOCK_TOKENS, BLOCK_WORDS = 6_000_000, 400_000
_ROW_TOKENS = 500_000
_REMEMBERED = 400_000
WORD, DOCUMENTS = 0, 1
_MOVED = "key long, block long, kind int, ids binary, sizes binary, codes binary"
_FIELDS = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as byte planes, compressed: the upper planes are mostly zero."""
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(arrays), *map(len, arrays)], "<u4").tobytes(), *planes]))


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    lengths, at, out = np.frombuffer(raw, "<u4", n, 4).tolist(), 4 * (n + 1), []
    for length in lengths:
        planes = np.frombuffer(raw, np.uint8, 4 * length, at).reshape(4, length)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * length
    return out


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _code(pattern: str, buckets: int):
    """Blocks of documents as word numbers, and each block's words by bucket of their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = word_splitter(pattern)
        numbers, block, codes, ids, sizes = _Numbers(), TaskContext.get().partitionId() << 24, array("I"), [], []

        def finished():
            nonlocal numbers, block, codes, ids, sizes
            if not ids:
                return
            flat = np.frombuffer(codes, np.uint32)
            counts = np.bincount(flat, minlength=len(numbers))
            # common words get small numbers
            order = np.argsort(-counts, kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            at = 0
            while at < len(ids):
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + _ROW_TOKENS, side="right")) - 1)
                known = [[i or 0, i is not None] for i in ids[at:stop]]
                row = {"key": block + (1 << 40), "block": block, "kind": DOCUMENTS, "ids": np.array(known, "<i8").tobytes(),
                       "sizes": np.array(sizes[at:stop], "<i8").tobytes(), "codes": pack(number[flat[ends[at]: ends[stop]]])}
                yield pa.RecordBatch.from_pylist([row], schema=_FIELDS)
                at = stop
            words = [word.encode() for word in numbers]
            bucket = np.array([zlib.crc32(word) for word in words], dtype=np.int64) % buckets
            by_bucket = np.lexsort((number, bucket)) if words else np.zeros(0, np.int64)
            rows = []
            for own in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if words else []:
                rows.append({"key": int(bucket[own[0]]), "block": block, "kind": WORD, "codes": pack(np.diff(number[own].astype(np.int64), prepend=0), np.array([len(words[i]) for i in own])),
                             "ids": zstandard.ZstdCompressor(level=3).compress(b"".join([words[i] for i in own]))})
            if rows:
                yield pa.RecordBatch.from_pylist([r | {"sizes": None} for r in rows], schema=_FIELDS)
            numbers, block, codes, ids, sizes = _Numbers(), block + 1, array("I"), [], []

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                chunk = batch.slice(at, 64)
                for doc_id, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist()):
                    found = split(text or "")
                    ids.append(doc_id)
                    sizes.append(len(found))
                    codes.extend([numbers[w] for w in found])
                    if len(codes) >= BLOCK_TOKENS or len(numbers) >= BLOCK_WORDS:
                        yield from finished()
        yield from finished()

    return run


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as source:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in source if line.strip())}


def _encode(ranks, pattern: str):
    """Words of a bucket become ids, each distinct word once for all blocks that name it; documents pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        key, known = None, {}
        for batch in batches:
            for lo in range(batch.num_rows):
                row = batch.slice(lo, 1)
                if row.column("kind")[0].as_py() == DOCUMENTS:
                    yield row
                    continue
                own = row.to_pylist()[0]
                if own["key"] != key or len(known) > _REMEMBERED:
                    key, known = own["key"], {}
                steps, lengths = unpack(own["codes"])
                raw, at, found = zstandard.ZstdDecompressor().decompress(own["ids"]), 0, []
                for length in lengths.tolist():
                    word = raw[at: at + length]
                    at += length
                    if word not in known:
                        known[word] = encode(word.decode())
                    found.append(known[word])
                ids = np.array([i for word in found for i in word], dtype=np.uint32)
                yield pa.RecordBatch.from_pylist([own | {"ids": None, "codes": pack(steps, np.array([len(w) for w in found]), ids)}], schema=_FIELDS)

    return run


def _assemble(ranks):
    """Documents of a block from its words' ids, and back to bytes by the token table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = {rank: token for token, rank in ranks.value.items()}
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        block, words, listing = None, {}, None
        for batch in batches:
            for lo in range(batch.num_rows):
                row = batch.slice(lo, 1).to_pylist()[0]
                if row["block"] != block:
                    block, words, listing = row["block"], {}, None
                if row["kind"] == WORD:
                    steps, counts, ids = unpack(row["codes"])
                    at, listed = 0, ids.tolist()
                    for number, count in zip(np.cumsum(steps.astype(np.int64)).tolist(), counts.tolist()):
                        own = listed[at: at + count]
                        at += count
                        words[number] = (" ".join(map(str, own)), b"".join([token_bytes[i] for i in own]), count)
                    continue
                if listing is None:  # words sort before documents
                    texts, originals, counts = zip(*[words.pop(i) for i in range(len(words))]) if words else ((), (), ())
                    listing = texts, originals, np.array(counts, np.int64)
                texts, originals, counts = listing
                codes, at, out = unpack(row["codes"])[0], 0, []
                for (doc_id, known), size in zip(np.frombuffer(row["ids"], "<i8").reshape(-1, 2).tolist(), np.frombuffer(row["sizes"], "<i8").tolist()):
                    own = codes[at: at + size]
                    at += size
                    listed = own.tolist()
                    out.append({
                        "doc_id": doc_id if known else None, "n_tokens": int(counts[own].sum()) if size else 0,
                        "ids_sha256": hashlib.sha256(" ".join([texts[c] for c in listed]).encode()).hexdigest(),
                        "decoded_sha256": hashlib.sha256(b"".join([originals[c] for c in listed])).hexdigest()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode and decode all texts: doc_id, n_tokens, ids_sha256, decoded_sha256, one row per input row.

    The ids are those of the byte-level merges by rank within each match of ``pattern``; strings of
    special tokens are ordinary text. A null text is empty: no ids, and the digests of nothing.
    Repeated rows and null ids are kept. Columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))  # the vocabulary
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = rows.mapInArrow(_code(pattern, buckets), _MOVED)
    encoded = coded.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_encode(ranks, pattern), _MOVED)
    placed = encoded.repartition("block").sortWithinPartitions("block", "kind", "key")
    return placed.mapInArrow(_assemble(ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the byte-level vocabulary of 50,256 ranks and back."""
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
