import random
from collections import defaultdict

import pytest

import corpus_pipeline
from clickwarden.llm.line_dedup import compared_lines
from test_line_dedup import shingles
from test_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(12), [], []
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    boiler = " ".join(rng.choices(words, k=25))
    for i in range(360):
        lines = [" ".join(rng.choices(words, k=rng.randint(8, 30))) for _ in range(rng.randint(1, 5))]
        toxic, good = i % 6 == 0, i % 7 != 0
        if toxic:
            lines = [line + " idiotic scum" for line in lines]
        if not good:
            lines = [" ".join(w.upper() + "!!" for w in line.split()) for line in lines]
        if i % 5 == 1:
            lines.append(boiler)
        if i % 11 == 3 and i > 60:
            lines = rows[i - 55][1].split("\n")
            lines[-1] += " tail"
            toxic, good = labels[i - 55][2] == 1, labels[i - 55][1] == 1
        rows.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "en", "s", None), (1001, "", None, "s", 0), rows[8], (None, "no id but words of its own here", "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] % 4 != 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, {x[0]: x[1:] for x in labels}


def test_every_stage_on_its_own_input(spark, folder, tmp_path):
    path, rows, truth = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "ngram_join", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = [tuple(r) for r in docs.collect()], spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, [tuple(r) for r in docs.collect()]
    for name, side in (("toxicity", 1), ("quality", 0)):
        before, after = seen[name]
        assert set(after) <= set(before)
        ids = {r[0] for r in after}
        wrong = [r[0] for r in before if r[0] in truth and (r[0] in ids) == (truth[r[0]][side] == side)]
        assert len(wrong) <= 0.05 * len(before)
    before, after = seen["line_dedup"]
    left = [shingles(line) for r in after if r[0] is not None for line in compared_lines(r[1]) if line]
    close = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    assert close <= 3
    assert all(r[4] == (len(r[1]) if r[1] is not None else None) for r in after)
    before, after = seen["ngram_join"]
    own = [r for r in before if r[0] is not None]
    assert sorted(r[0] for r in after if r[0] is not None) == sorted({d for d, _, c in brute(own, 5, 80) if d == c})
    pieces = defaultdict(int)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    for r in final:
        pieces[r.sequence_id] += r.length
    assert {r.doc_id for r in final} == {r[0] for r in after} and max(pieces.values()) <= 1024
    whole = corpus_pipeline.run(spark, path).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, final))


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_with_clashing_columns_long_texts_and_empty_tables(spark, folder):
    path, rows, _ = folder
    clashing = "doc_id long, text string, _score string, score int, _kept int, kept string, place int, _doc long, doc string, _dropped string, _lines array<string>, lines string"
    odd = [(i, text, "s", 1, 2, "k", 3, 4, "d", "x", ["own"], "l") for i, text, *_ in rows[:60]]
    odd += [(2000, "one word after the other " * 100_000, "s", 1, 2, "k", 3, 4, "d", "x", ["own"], "l")]
    docs = spark.createDataFrame(odd, clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.names == docs.schema.names, name
        kept = out.collect()
        assert kept and all(tuple(r)[2:] == odd[0][2:] for r in kept), name
        assert stage(spark, docs.limit(0), path).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).collect() == []


def test_rows_of_one_id_and_text_leave_the_smallest(spark, folder):
    rows = [(1, "a b c d e f", "z"), (1, "a b c d e f", "y"), (1, "a b c d e f", None), (2, "", "q"), (2, "", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    out = corpus_pipeline.one_of_near_copies(spark, docs, folder[0]).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2] and {r["other"] for r in out if r["doc_id"] == 2} == {"p"}
