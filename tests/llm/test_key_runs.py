"""Ids of one key are joined over pairs that may reach the threshold, not all of them."""

import random

import numpy as np

from clickwarden.llm.grouping import UnionFind, key_links
from clickwarden.llm.line_dedup import Lines, band_keys, line_bits, may_link
from clickwarden.llm.ngram_join import _class_sets, differences, ngram_components, segment_keys, shared_keys, size_classes, without_frequent
from clickwarden.llm.scratch import Scratch


def components(n, links):
    found = UnionFind(n)
    for a, b in links:
        found.union(a, b)
    return [found.find(i) for i in range(n)]


def same_or_finer(fine, coarse):
    return len(set(zip(fine, coarse))) == len(set(fine))


def test_alike_rows_of_a_key_are_joined_over_batches_and_borders(spark):
    rng = random.Random(3)
    # keys of one, a few, many rows, and rows that come twice
    rows = [(key, i, rng.randrange(300)) for i in range(600) for key in {0, rng.randrange(1, 4), rng.randrange(10, 40), rng.randrange(100, 900)}]
    values = {(key, i): v for key, i, v in rows}
    by_key = {}
    for key, i, _ in rows:
        by_key.setdefault(key, []).append(i)
    exact = components(600, [(a, b) for key, ids in by_key.items() for a in ids for b in ids if a < b and abs(values[key, a] - values[key, b]) <= 1])
    every = components(600, [(ids[0], b) for ids in by_key.values() for b in ids])
    apart = components(600, [(a, b) for key, ids in by_key.items() if key >= 10 for a in ids for b in ids if a < b and abs(values[key, a] - values[key, b]) <= 1])

    def alike(a, b):
        return np.abs(a[0] - b[0]) <= 1

    df = spark.createDataFrame(rows + rows[::7], "key long, id long, value long").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        for size, tasks, checked in ((7, 3, 1 << 12), (50, 2, 100), (10_000, 2, 1 << 12), (10_000, 5, 10)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            got = components(600, [(r.a, r.b) for r in key_links(df, Scratch(spark, "runs"), alike, checked).collect()])
            assert same_or_finer(exact, got) and same_or_finer(got, every)
        # one key alone between others: nothing but alike pairs
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        narrow = spark.createDataFrame([(-1, 0, 0), (901, 0, 0)] + [r for r in rows if r[0] >= 10], "key long, id long, value long")
        got = components(600, [(r.a, r.b) for r in key_links(narrow, Scratch(spark, "runs"), alike).collect()])
        assert same_or_finer(apart, got) and len(set(got)) > len(set(apart)) - 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_short_lines_that_share_a_passage_form_no_cluster(spark):
    rng = random.Random(8)
    passage = "the terms apply "
    lines = [passage + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=24)) for _ in range(1500)]
    lines += [line[:-1] + "#" for line in lines[:50]]
    signed = Lines(lines)
    keys, bits = band_keys(signed, len(lines)).view(np.int64), line_bits(signed).view(np.int64)
    # a key by which hundreds of them meet, amid others; the partitions' border lies beyond them
    assert np.unique(keys, return_counts=True)[1].max() > 300
    rows = [(-(1 << 63), 0, 0, 0)] + [(int(k) >> 1, i, int(bits[i]), int(signed.size[i])) for i in range(len(lines)) for k in set(keys[i].tolist())]
    rows += [((1 << 62) + i, 0, 0, 0) for i in range(3 * len(rows))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        df = spark.createDataFrame(rows, "key long, id long, bits long, size long")
        found = components(len(lines), [(r.a, r.b) for r in key_links(df, Scratch(spark, "lines"), may_link(80)).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.bincount(found).max() <= 8
    assert np.mean([found[i] == found[1500 + i] for i in range(50)]) == 1


def test_no_pair_at_the_threshold_is_denied():
    rng = random.Random(2)
    lines, pairs = [], []
    for _ in range(3000):
        a = "".join(rng.choices("ab ", k=rng.choice([1, 5, 9, 30]))) + "".join(rng.choices("abcdefgh", k=rng.choice([0, 9, 40, 120, 600])))
        b = list(a)
        for _ in range(rng.choice([0, 1, 2])):
            b[rng.randrange(len(b))] = rng.choice("ab#")
        lines += [a * rng.choice([1, 1, 3]), "".join(b) * rng.choice([1, 1, 3])]
    signed = Lines(lines)
    bits, cuts = line_bits(signed).view(np.int64), np.concatenate([[0], np.cumsum(signed.size)])
    sets = [set(signed.hash[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
    pairs = np.array([(i, i + 1) for i in range(0, len(lines), 2)] + [(rng.randrange(len(lines)), rng.randrange(len(lines))) for _ in range(3000)])
    link = np.array([100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in pairs])
    for i, j in (pairs.T, pairs.T[::-1]):
        may = may_link(80)([bits[i], signed.size[i]], [bits[j], signed.size[j]])
        assert may[link].all() and link.sum() > 500
    assert may[~link].mean() < 0.7


def test_linked_sets_share_as_many_keys_as_they_must():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        classes = size_classes(percent, 1 << 40)
        for size in [*range(4, 60, 3), 190, 400, 1500, 9000]:
            for _ in range(5):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[rng.integers(0, size) // 8:]], rng.integers(0, 1 << 63, rng.integers(0, size) // 8, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common < percent * (len(a) + len(b) - common):
                    continue
                keys = [segment_keys(x, percent, classes).view(np.int64) for x in (a, b)]
                flat, borders = np.concatenate(keys), np.cumsum([0, *map(len, keys)])
                for share in (0, 0.1, 0.6):
                    frequent = np.sort(rng.choice(flat, int(share * len(flat))))
                    kept = without_frequent(flat, borders, frequent)
                    x, y = (set(flat[lo:hi][kept[lo:hi]].tolist()) for lo, hi in zip(borders, borders[1:]))
                    upper = int(np.searchsorted(classes, max(len(a), len(b)), side="right"))
                    if differences(int(classes[upper]) - 1, percent):
                        both = [k & 63 for k in x & y]
                        assert both and len(both) >= min(both) and min(both) >= min(shared_keys(0), 63)


def test_texts_that_share_a_passage_form_no_cluster(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    passage = " ".join(rng.choices(words, k=24))
    rows = []
    for i in range(600):
        own = rng.choices(words, k=rng.choice([60, 100, 150]))
        rows.append((i, " ".join(own[:30] + passage.split() + own[30:])))
    rows += [(1000 + i, rows[i][1] + " one more end") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in _class_sets(df, 5, 80, Scratch(spark, "sets"))[2].groupBy("cluster").count().collect()]
    assert max(sizes) <= 10 and sum(sizes) < 200
    got = {r.doc_id: r.component_id for r in ngram_components(df, 5, 80).collect()}
    assert all(got[1000 + i] == i for i in range(40)) and len(set(got.values())) == 600
