"""Phrases against plain counting; the trie, runs and merges by themselves; odd rows."""

import cProfile
import random
import re
from collections import Counter
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from clickwarden.llm import collocations as co
from clickwarden.llm import hat_trie

SCHEMA = "text string, lang string, word string, n long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, s):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update(tuple(words[i: i + k]) for k in range(1, s.longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= s.least}
        kept = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in found.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[: s.first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, rows, s):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in co.collocations(df, settings=s).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "É", "é", "x1", "#", "ten", "blue", "new york"] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary[: rng.choice([4, 22])]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.4:
            words[3:3] = ["one", "very", "common", "long", "phrase", "indeed"]
        rows.append(("".join(w + rng.choice([" ", "\t", "  ", ", ", ".", "\n"] if rng.random() < 0.3 else [" "]) for w in words),
                     rng.choice(["en", "en", "de", None, "und"])))
    return rows


SMALL = co.Settings(least=8, first=60, trie_entries=60, range_windows=50, merge_windows=30)


def test_plain_counts_with_spills_and_many_ranges(spark):
    rows = corpus(1, 300)
    want = expected(rows, SMALL)
    assert len(want) > 150 and mined(spark, rows, SMALL) == want
    # words beyond the dictionary go by their hash
    assert mined(spark, rows, replace(SMALL, dictionary=5)) == want
    assert mined(spark, rows, replace(SMALL, range_windows=1 << 20, merge_windows=1 << 20, trie_entries=10**6)) == want


def test_odd_rows(spark):
    s = replace(SMALL, least=2)
    long = "alpha beta gamma. " * 150_000 + "delta " * 400_000
    rows = [(None, "en"), ("", None), ("a a a a", "en"), ("a a a a", "en"), (" , ; ", "de"), ("One two three", "x"),
            ("one two three", "x"), ("lone", "fr"), (long, "long"), ("A.b", "en"), ("a b", "en"), ("a\r\nb a\tb", "en")]
    assert mined(spark, rows, s) == expected(rows, s)
    assert mined(spark, [], s) == [] and mined(spark, [(None, None)], s) == []


def test_long_texts_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(co, "SLICE_BYTES", 50)
    text = "one two. " * 30 + "x " * 200 + ".end here"
    parts = [data.tobytes() for *_, data, _ in co._parts(pa.array([text]))]
    assert b"".join(parts) == text.encode() and len(parts) > 5 and all(p.endswith(b".") for p in parts[:-1])


def test_trie_bursts_spills_and_merges():
    rng = random.Random(5)
    strings = [b"".join(rng.randrange(1, 6).to_bytes(8) for _ in range(rng.randrange(2, 6))) for _ in range(20_000)]
    trie, runs = hat_trie.HatTrie(burst=20), []
    for at in range(0, len(strings), 500):
        trie.add(Counter(strings[at: at + 500]))
        if trie.entries > 900:
            before = trie.entries
            runs.append(trie.spill(400))
            assert trie.entries <= 400 < before and runs[-1] == sorted(runs[-1])
    runs.append(trie.spill())
    assert trie.entries == 0 and not trie.root
    splitters = sorted(set(strings))[::100]
    packed = [(number, hat_trie.pack(piece, 5)) for run in runs for number, piece in hat_trie.cut(run, splitters)]
    unpacked = [hat_trie.unpack(p, 5) for _, p in packed]
    ids, counts = hat_trie.merge(np.concatenate([u[0] for u in unpacked]), np.concatenate([u[1] for u in unpacked]))
    got = {b"".join(int(i).to_bytes(8) for i in row if i): int(n) for row, n in zip(ids, counts)}
    assert got == dict(Counter(strings))
    prefixes = Counter(s[: 8 * k] for s in strings for k in range(2, 6) if len(s) >= 8 * k)
    assert {k: n for k, n in hat_trie.prefix_counts(ids, counts, 50) if n >= 50} == {k: n for k, n in prefixes.items() if n >= 50}


def test_wide_ids_and_counts_survive_packing():
    piece = [((1 << 63).to_bytes(8) + (7).to_bytes(8), 1 << 40), ((1 << 63).to_bytes(8) + (9).to_bytes(8), 3)]
    ids, counts = hat_trie.unpack(hat_trie.pack(piece, 5), 5)
    assert ids.tolist() == [[1 << 63, 7, 0, 0, 0], [1 << 63, 9, 0, 0, 0]] and counts.tolist() == [1 << 40, 3]


def test_words_are_counted_without_a_step_of_python_for_each():
    words = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(words[at: at + 50]) + " É w7" for at in range(0, len(words), 50)]
    batch = pa.record_batch([pa.array(texts), pa.array([("en", "de")[i % 2] for i in range(len(texts))])], names=["text", "lang"])
    plain = Counter(((lang, w) for text, lang in zip(*(c.to_pylist() for c in batch.columns)) for w in text.split()))
    for settings in (co.Settings(), co.Settings(word_entries=300), co.Settings(word_bytes=2_000)):
        profile = cProfile.Profile()
        out = profile.runcall(lambda: list(co._count_words(settings)(iter([batch, batch]))))
        got = Counter()
        for part in out:
            for lang, word, n in zip(*(part.column(c).to_pylist() for c in ("lang", "word", "n"))):
                if word is not None:
                    got[lang, word] += n
        assert got == {k: 2 * n for k, n in plain.items()}
        # other threads are profiled too, and decode none of the words
        assert sum(entry.callcount for entry in profile.getstats() if "'decode'" in str(entry.code)) < 5_000
    broken = pa.array([b"ok", b"\xff"], pa.binary())
    assert co._decoded(broken).to_pylist() == ["ok", "\ufffd"]


def test_pieces_that_begin_with_the_range_are_merged_few_times(monkeypatch):
    rng, sizes = np.random.default_rng(3), []
    merge = hat_trie.merge
    monkeypatch.setattr(co, "merge", lambda ids, counts: sizes.append(len(ids)) or merge(ids, counts))
    total, packed = Counter(), []
    for _ in range(200):
        ids = np.unique(np.concatenate([[[1, 1, 1, 1, 1]], rng.integers(1, 9, (40, 5))]).astype(np.uint64), axis=0)
        packed.append(hat_trie.pack([(row.astype(">u8").tobytes(), 1) for row in ids], 5))
        total.update(row[:2].tobytes() for row in ids.astype(">u8"))
    first = np.ones(5, ">u8").tobytes()
    batch = pa.record_batch([pa.array([0] * 200, pa.int32()), pa.array([first] * 200, pa.binary()), pa.array(packed, pa.binary())], names=["range", "first", "packed"])
    got = Counter()
    for out in co._merge_ranges(replace(SMALL, merge_windows=100))(iter([batch])):
        for key, n in zip(out.column("key").to_pylist(), out.column("n").to_pylist()):
            got.update({key: n} if len(key) == 16 else {})
    assert got == {k: n for k, n in total.items() if n >= SMALL.least}
    # every string is in a merge a few times, not in one for every piece
    assert sum(sizes) < 5 * sum(total.values())


def test_spills_leave_together(monkeypatch):
    rng, words = random.Random(9), [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(300)]
    batch = pa.record_batch([pa.array(texts), pa.array(["en"] * 300)], names=["text", "lang"])
    # a batch of ten rows each, so that the trie spills often
    batches = [batch.slice(at, 10) for at in range(0, 300, 10)]
    keys = np.unique(np.concatenate([key for b in batches for _, _, key, _ in co._words(b, co._Langs())]))
    ids = co._Ids(keys, True)
    splitters = [np.array([i, 0, 0, 0, 0], ">u8").tobytes() for i in range(2, 60)]
    rows = {}
    for spills in (1, 16):
        run = co._count_windows(SimpleNamespace(value=ids), SimpleNamespace(value=splitters), replace(SMALL, trie_entries=300, spills=spills))
        out = list(run(iter(batches)))
        counted = Counter()
        for r in out:
            window, n = hat_trie.unpack(r.column("packed")[0].as_py(), 5)
            assert r.column("first")[0].as_py() == min(w[w != 0].astype(">u8").tobytes() for w in window)
            for w, k in zip(window, n.tolist()):
                counted[w.tobytes()] += k
        rows[spills] = (len(out), counted)
    assert rows[1][1] == rows[16][1] and rows[16][0] < rows[1][0] / 5
