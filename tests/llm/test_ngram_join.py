import random

import numpy as np
import pytest

from clickwarden.llm import grouping, ngram_join
from clickwarden.llm.grouping import UnionFind, blocks_of_clusters, connected_components, key_links
from clickwarden.llm.ngram_join import differences, ngram_components, ngram_links, segment_keys, size_classes
from clickwarden.llm.scratch import Scratch


def words_of(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    found = UnionFind(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                found.union(i, j)
    smallest = {}
    for i, r in enumerate(rows):
        smallest[found.find(i)] = min(smallest.get(found.find(i), 1 << 60), r[0])
    return sorted((r[0], len(sets[i]), smallest[found.find(i)]) for i, r in enumerate(rows))


def corpus(seed, n):
    rng, texts = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "É", "a b"]
    for _ in range(n // 8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 20, 60, 200, 400]))]
        texts.append(base)
        for _ in range(rng.randint(0, 12)):
            copy = list(rng.choice(texts[-8:]))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[at] = rng.choice(vocabulary)
                else:
                    copy.insert(at, rng.choice(vocabulary))
            texts.append(copy)
    rows = [(i, rng.choice([" ", "  ", "\t", "\n"]).join(t).swapcase() if rng.random() < 0.5 else " ".join(t), "x", 1) for i, t in enumerate(texts)]
    k = len(rows)
    return rows + [(k, "", "x", 1), (k + 1, None, "x", 1), (k + 2, " \n ", "x", 1), (k + 3, "w1", "x", 1), (k + 4, "W1", "x", 1), (0, rows[0][1], "x", 1)]


@pytest.mark.parametrize("seed,n,percent,small", [(1, 3, 90, False), (2, 3, 90, True), (3, 5, 80, True), (4, 1, 75, False)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, percent, small):
    rows = corpus(seed, 400)
    if small:  # many blocks and upper nodes in a cluster
        original = blocks_of_clusters
        monkeypatch.setattr(ngram_join, "blocks_of_clusters", lambda members: original(members, most_rows=3, most_weight=500))
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, cluster int").repartition(5)
    got = ngram_components(df, n, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, percent)
    assert {r.doc_id: r.class_id for r in got}[rows[-2][0]] == rows[-3][0]


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        classes = size_classes(percent, 1 << 40)
        for size in [*range(4, 60), 190, 400, 1500]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
                grow, drop = rng.integers(0, size), rng.integers(0, size)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop // 8:]], rng.integers(0, 1 << 63, grow // 8, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                union = len(a) + len(b) - common
                if 100 * common >= percent * union and len(np.setxor1d(a, b)):
                    assert len(np.setxor1d(a, b)) <= differences(max(len(a), len(b)), percent)
                    assert set(segment_keys(a, percent, classes)) & set(segment_keys(b, percent, classes))


def test_key_links_and_components_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(7, i) for i in range(800)] + [(rng.randint(8, 400), rng.randint(1000, 3000)) for _ in range(900)] + [(9, 5), (9, 5)]
    found = UnionFind(3001)
    first = {}
    for key, i in rows:
        found.union(first.setdefault(key, i), i)
    scratch = Scratch(spark, "test")
    links = key_links(spark.createDataFrame(rows, "key long, id long").repartition(4), scratch)
    got = {r.id: r.root for r in connected_components(links, scratch).collect()}
    ids = {i for _, i in rows}
    assert {i: got.get(i, i) for i in ids} == {i: found.find(i) for i in ids}


def test_empty_and_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in ngram_components(df, 3, 90).collect())
    assert got == [("5", "5"), ("None", "5"), ("None", "5"), ("None", "None"), ("None", "None")]
    assert ngram_components(df.limit(0)).count() == 0


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(grouping, "_REMEMBERED", 40)
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300)] + [(rng.randint(400, 900), rng.randint(400, 900)) for _ in range(300)]
    found = UnionFind(901)
    for a, b in links:
        found.union(a, b)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r.id: r.root for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert got == {i: found.find(i) for i in {x for a, b in links if a != b for x in (a, b)}}


def test_components_of_more_ids_than_links(spark, monkeypatch):
    monkeypatch.setattr(grouping, "_REMEMBERED", 40)
    # fewer links than the bound, more ids; the last links name ids of the first batches again
    links = [(i, i + 100) for i in range(26)] + [(i + 100, i + 200) for i in range(8)] + [(0, 100), (1, 101)]
    found = UnionFind(301)
    for a, b in links:
        found.union(a, b)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = connected_components(spark.createDataFrame(links, "a long, b long").coalesce(1), Scratch(spark, "test")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.id, r.root) for r in got) == [(i, found.find(i)) for i in sorted({x for link in links for x in link})]


@pytest.mark.parametrize("small", [False, True])
def test_all_links_and_their_numbers(spark, monkeypatch, small):
    if small:
        original = blocks_of_clusters
        monkeypatch.setattr(ngram_join, "blocks_of_clusters", lambda members: original(members, most_rows=3, most_weight=500))
    base = [f"v{i}" for i in range(80)]
    # near copies that all link to each other, more than a block compares one by one
    near = [(1000 + i, " ".join([*base[:40], f"own{i}", *base[40:]]), "x", 1) for i in range(60)]
    rows = corpus(7, 200) + near
    first, sets = {}, {}
    for doc_id, text, *_ in rows:
        w = words_of(text)
        own = frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) or frozenset([tuple(w)] if w else [])
        first[own] = min(first.get(own, 1 << 60), doc_id)
        sets[doc_id] = own
    different = [s for s in first if s]
    want = {tuple(sorted((first[a], first[b]))) for i, a in enumerate(different) for b in different[:i] if 100 * len(a & b) >= 80 * len(a | b)}
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, cluster int").repartition(5)
    got = [(r.class_a, r.class_b) for r in ngram_links(df, 3, 80).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    numbers = {r.doc_id: r.n_links for r in ngram_components(df, 3, 80, count_links=True).collect()}
    assert numbers == {d: sum(first[s] in pair for pair in want) if s else 0 for d, s in sets.items()}
    assert numbers[1000] == 59
