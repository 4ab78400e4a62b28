import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickwarden.llm.packing import best_fit_decreasing, pack_documents, word_splitter

import regex


def naive_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        rooms_left = room - n
        if room == capacity:
            naive_bins.count += 1
        if rooms_left:
            insort(rooms, rooms_left)
    return naive_bins.count


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 1024])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, 3) for _ in range(rng.randint(0, 900))]
    counts = Counter(lengths)
    plan = best_fit_decreasing(counts, capacity)
    naive_bins.count = 0
    assert plan.bins == naive_bins(lengths, capacity)
    fill = defaultdict(set)
    for length, n in counts.items():
        rows = np.flatnonzero(plan.length == length)
        for rank in range(n):
            row = rows[np.searchsorted(plan.rank[rows], rank, side="right") - 1]
            place = rank - plan.rank[row]
            at = plan.offset[row] + place % plan.each[row] * length
            taken = set(range(at, at + length))
            own = fill[plan.first[row] + place // plan.each[row]]
            assert not own & taken
            own |= taken
    assert all(own == set(range(len(own))) and len(own) <= capacity for own in fill.values())


TEXTS = ["", None, "a", "Don't  stop\n\n  now ", "x" * 9000, "é ü ñ ²½ ٠ 日本語 👍🏽\x1c\x85\xa0 end", "<|endoftext|> ok", " ",
         "it's 12'345 __init__ %%%&&&", "word " * 5000, "\t\r\n  tail", "I'LL we'll 's", "tail  "]


def test_splitter_equals_the_exact_pattern():
    split, exact = word_splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    for text in TEXTS:
        assert split(text or "") == exact.findall(text or "")


def test_pieces_equal_whole_document_encoding(spark):
    rows = [(i, t, "clash", 5) for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string, part int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = pack_documents(df, path, public_tokenizers.PATTERN).collect()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        borders = [0, *range(first, len(ids), 1024), len(ids)]
        for piece, (lo, hi) in enumerate(zip(borders, borders[1:])):
            want.append((doc_id, piece, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    naive_bins.count = 0
    assert len(fill) == naive_bins([r.length for r in got], 1024)
    assert pack_documents(df.limit(0), path, public_tokenizers.PATTERN).count() == 0
