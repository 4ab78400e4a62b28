import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import zstandard

from clickwarden.llm import signature_tree
from clickwarden.llm.grouping import UnionFind
from clickwarden.llm.line_dedup import BANDS, Lines, band_keys, compared_lines, deduplicate_lines, line_groups


def shingles(line):
    return {line[i:i + 8] for i in range(len(line) - 7)} or {line}


def brute(rows, percent=80):
    lines = [(r[0], at, shingles(line)) for r in rows if r[0] is not None for at, line in enumerate(compared_lines(r[1])) if line]
    found = UnionFind(len(lines))
    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][2], lines[j][2]
            if 100 * len(a & b) >= percent * len(a | b):
                found.union(i, j)
    keep, size = {}, {}
    for i, (doc, at, _) in enumerate(lines):
        r = found.find(i)
        keep[r] = min(keep.get(r, (1 << 60, 0)), (doc, at))
        size[r] = size.get(r, 0) + 1
    return {(d, at): (*keep[found.find(i)], size[found.find(i)]) for i, (d, at, _) in enumerate(lines)}


def corpus(seed=4):
    rng, known, rows = random.Random(seed), [], []
    letters = "abcdefghij éü漢"
    for doc in range(160):
        lines = []
        for _ in range(rng.randint(0, 6)):
            if known and rng.random() < 0.4:
                line = list(rng.choice(known))
                if line and rng.random() < 0.6:
                    line[rng.randrange(len(line))] = rng.choice(letters)
                line = "".join(line)
            else:
                line = "".join(rng.choices(letters, k=rng.choice([1, 3, 8, 20, 60, 150, 150, 400])))
            known.append(line)
            lines.append(line)
        rows.append((doc, "\n".join(lines), "x", 1))
    return rows + [(900, None, "x", 1), (901, "\n \n", "x", 1), (None, rows[5][1], "x", 1), (902, "long line " * 30_000, "x", 1)]


def test_groups_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, size int").repartition(5)
    got = {(r.doc_id, r.line): (r.keep_doc_id, r.keep_line, r.group_size) for r in line_groups(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    # banding may miss a pair in a hundred at the threshold; it never joins what the exact check doesn't
    assert np.mean([got[k] == want[k] for k in want]) > 0.98
    assert all(got[k][2] <= want[k][2] for k in want)


def test_kept_text_and_columns(spark):
    boiler = "this line is on every page of the site and says so at quite some length, with many words, 2024 edition"
    rows = [(1, f"first own line here\n{boiler}\n\nend of one", "s", 9), (2, f"{boiler.replace('2024', '2025')}\nsecond own", "s", 9), (3, boiler.upper(), "s", 9),
            (4, None, "s", 9), (5, "", "s", 9), (None, boiler, "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = deduplicate_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "second own", 4: None, 5: "", None: boiler}
    assert deduplicate_lines(df.limit(0)).count() == 0


def test_repeated_rows_with_other_texts(spark):
    rows = [(1, "a common line that is long enough\nown text of the first row"), (1, "own text of the second row, longer"), (2, "a common line that is long enough!")]
    got = sorted((r.doc_id, r.line, r.kept, r.group_size) for r in line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, True, 1), (1, 0, True, 2), (1, 1, True, 1), (2, 0, False, 2)]


def test_bands_of_equal_and_unlike_lines():
    rng = random.Random(1)
    lines = ["".join(rng.choices("abcdefgh ", k=200)) for _ in range(50)]
    keys = band_keys(Lines(lines + lines), 100)
    assert (keys[:50] == keys[50:]).all() and keys.shape == (100, BANDS)
    assert len(np.unique(keys[:50])) == 50 * BANDS


def test_pairs_at_the_threshold_share_a_band():
    # 8 of 10 distinct shingles in common
    n, size = 20_000, 180
    hashes = np.random.default_rng(5).integers(0, 1 << 63, (n, 200), dtype=np.uint64) * np.uint64(2)
    keys = [band_keys(SimpleNamespace(hash=part.ravel(), line=np.repeat(np.arange(n), size), size=np.full(n, size)), n)
            for part in (hashes[:, :size], hashes[:, 20:])]
    missed = np.mean(~(keys[0] == keys[1]).any(1))
    assert missed < 0.009, missed


def test_small_tiles_are_unpacked_together():
    calls, rows, want = [], [], []

    def expand(packed):
        calls.append(len(packed))
        return signature_tree.numbers(packed)

    def blocks(tile, *sizes):
        return [{"upper_a": tile, "upper_b": tile, "block_a": 16 * tile + i, "block_b": None, "most": size, "ids": np.array([10 * tile + i, 10 * tile + i + 5]).tobytes(),
                 "sets": zstandard.ZstdCompressor().compress(np.arange(size, dtype="<u8").tobytes() * 2), "sizes": np.array([8 * size] * 2).tobytes()}
                for i, size in enumerate(sizes)]

    # tiles of a block each, and among them one whose pairs are many elements
    for tile in range(400):
        own = blocks(tile, *[200_000] * 4) if tile == 200 else blocks(tile, 9)
        pairs = [(a, b) for i, a in enumerate(own) for b in own[i:]]
        rows += own + [dict.fromkeys(a) | {"upper_a": tile, "upper_b": tile, "block_a": a["block_a"], "block_b": b["block_a"]} for a, b in pairs]
        want.append({10 * tile + x for i in range(len(own)) for x in (i, i + 5)})
    kinds = [(c, pa.int64()) for c in ("upper_a", "upper_b", "block_a", "block_b", "most")] + [(c, pa.binary()) for c in ("sets", "sizes", "ids")]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
    joined = UnionFind(5_000)
    for out in signature_tree._compare(80, expand, "spanning")(iter([batch])):
        for a, b in zip(*(c.to_pylist() for c in out.columns)):
            joined.union(a, b)
    got = {}
    for x in set().union(*want):
        got.setdefault(joined.find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert len(calls) < 20 and max(calls) <= signature_tree.GATHERED_SETS
