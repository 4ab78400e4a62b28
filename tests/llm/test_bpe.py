import base64
import hashlib

import public_tokenizers
import tiktoken

from clickwarden.llm import bpe

from test_packing import TEXTS


def test_equals_the_library_on_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(bpe, "_ROW_TOKENS", 100)
    monkeypatch.setattr(bpe, "_REMEMBERED", 20)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "x", 1), (0, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, block int").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.bpe_digests(df, path, public_tokenizers.PATTERN).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text, *_ in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == sorted(want)
    assert bpe.bpe_digests(df.limit(0), path, public_tokenizers.PATTERN).count() == 0
