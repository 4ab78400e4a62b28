import hashlib
import random

import pytest

from clickwarden.llm.exact_dedup import exact_duplicates

SCHEMA = "doc_id long, text string, part int, run long, sha string"


def brute(rows, keep):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    best = {t: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    out = []
    for doc_id, text in rows:
        text = text or ""
        out.append((doc_id, best[text], len(groups[text]), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("partitions", [2, 7])
def test_matches_brute_force_with_groups_over_many_partitions(spark, keep, partitions):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + ["", None, "a", "b", "ü" * 9, "long " * 5000, f"own {i}"])) for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).repartition(5)
    got = exact_duplicates(df, keep=keep, partitions=partitions).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute(rows, keep))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "alone"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_duplicates(df).collect()
    assert sorted(str(r.doc_id) for r in got if r.kept) == ["1", "2", "None"]
    assert {r.group_size for r in got if r.doc_id == 1} == {3}
    assert exact_duplicates(df.limit(0)).count() == 0
