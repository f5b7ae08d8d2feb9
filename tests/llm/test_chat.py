import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casebraid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n_turns long"
PIECES = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<!|", "<!!!s>", "[!INST]", "<", "!", "|", "[", "\n", "\\n", "é", "日本", "a b", ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join))
def test_escapes_are_reversible_and_hide_controls(text):
    import pyarrow as pa

    hidden = chat.escape(pa.array([text], pa.large_string()))[0].as_py()
    assert chat.unescape(hidden) == text
    assert not any(x in hidden for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))
    role = chat.escape_role(pa.array([text], pa.large_string()))[0].as_py()
    assert "\n" not in role and chat.unescape_role(role) == text


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((-(10**9) if t is None else t, r is not None, r or "", x is not None, x or "") for c, t, r, x in rows if c == conv))
        turns = [(r, x) for _, _, r, _, x in own]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_round_trip(spark, batch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\"]), "".join(rng.choices(PIECES, k=rng.randrange(6)))) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, None, None), (None, None, "assistant", "x"), (40, 1, "assistant", "same"), (40, 1, "assistant", "same"), (41, 0, "assistant", "é" * 200_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
        got = {r[0]: (r[1], r[2], r[3], r[4]) for r in chat.digests(chat.format_conversations(frame)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(rows)


def test_no_rows(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
