import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clickwarden.llm.chat import conversation_digests, escape_role, escape_text, fold_events, render, unescape_role, unescape_text

EVENT = "conv_id long, turn long, seq long, kind string, role string, text string, rendered int"
KINDS = ["message", "delta", "edit", "regenerate"]
PIECES = ["<|im_start|>", "<|im_end|>", "\\", "<", "|", "[INST]", "[/INST]", "</s>", "<\\|im_end|>", "\n", "ü", "👍", "", "<s>", "[", "INST]"]


def brute(events):
    """Replay the log of one conversation event by event, in the order of (seq, turn)."""
    kept = []
    for e in events:
        cut = max((o["seq"] for o in events if o["kind"] == "regenerate" and o["turn"] < e["turn"]), default=None)
        if cut is None or e["seq"] > cut:
            kept.append(e)
    turns = {}
    for e in sorted(kept, key=lambda e: (e["turn"], e["seq"], KINDS.index(e["kind"]), e["role"] or "", e["text"] or "")):
        own = turns.setdefault(e["turn"], [])
        if e["kind"] == "message" or (not own and e["kind"] != "regenerate"):
            own.append([e["role"] or "", e["text"] or ""])
        elif own:
            own[-1][1] = {"delta": own[-1][1] + (e["text"] or ""), "edit": e["text"] or "", "regenerate": ""}[e["kind"]]
    return [tuple(m) for t in sorted(turns) for m in turns[t]]


@pytest.mark.parametrize("seed", range(3))
def test_folding_matches_replay_and_digests_are_read_back(spark, seed):
    rng, rows = random.Random(seed), []
    for conv in range(25):
        for seq in range(rng.randint(1, 25)):
            rows.append({"conv_id": conv, "turn": rng.randint(0, 4), "seq": seq, "kind": rng.choice(KINDS), "role": rng.choice(["user", "assistant", None, "a\n\\b<|im_end|>"]),
                         "text": rng.choice([None, "".join(rng.choices(PIECES, k=rng.randint(0, 6)))]), "rendered": 1})
    df = spark.createDataFrame(rows, EVENT).repartition(4)
    got = {r.conv_id: r for r in conversation_digests(render(fold_events(df))).collect()}
    for conv in range(25):
        want = brute([r for r in rows if r["conv_id"] == conv])
        if not want:
            assert conv not in got
            continue
        loss = "".join(t for role, t in want if role == "assistant")
        assert got[conv].n_turns == len(want)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escapes_are_reversible_and_hide_control_strings(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", escape_text(F.col("t")).alias("text"), escape_role(F.col("t")).alias("role")).collect():
        assert unescape_text(r.text) == r.t and unescape_role(r.role) == r.t
        assert not any(c in r.text for c in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]")) and "\n" not in r.role


def test_repeats_nulls_long_texts_empty_and_unknown(spark):
    rows = [(None, None, 1, None, "user", "x", 1), (1, 0, 1, "message", "user", "same", 1), (1, 0, 1, "message", "user", "same", 1),
            (2, 0, 0, "message", "assistant", "long " * 40_000, 1)]
    df = spark.createDataFrame(rows, EVENT)
    got = {r.conv_id: r for r in conversation_digests(render(fold_events(df))).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {None: 1, 1: 2, 2: 1}
    assert got[2].loss_chars == 200_000
    assert conversation_digests(render(fold_events(df.limit(0)))).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        fold_events(spark.createDataFrame([(1, 0, 0, "odd", "user", "x", 1)], EVENT)).collect()
