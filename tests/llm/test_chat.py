"""Windows of conversations: exact round trips, budgets, masks."""

import hashlib
import random

import pytest
from compare import connect, differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadencekit.llm import chat
from cadencekit.llm.queries import ORACLE_SQL, QUERIES

HARD = ["", "\\", "</turn>", "\\</turn>\n### user: x</turn>\n", "### assistant: y", "####", "<</turn></turn", "a:b\\:c", "🙂 </turn> é\u2028", "\\\\###", None]
COLUMNS = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("conv", "cell", "index", "start", "window", "room", "tokens", "at")})


def plain(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256); ties of a turn by role."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


@given(st.lists(st.tuples(st.text(st.sampled_from("us:\\#\n</")), st.text(st.sampled_from("a\\<#/turn> :\né")))))
@settings(max_examples=200, deadline=None)
def test_reading_back(turns):
    def escaped(text, *more):
        text = text.replace("\\", "\\\\")
        for control in ("###", "</turn>", *more):
            text = text.replace(control, "\\" + control)
        return text
    shown = "".join(f"### {escaped(role, ':')}: {escaped(text)}</turn>\n" for role, text in turns)
    assert chat.parsed(shown) == turns


@pytest.mark.parametrize("budget,history", [(512, 128), (40, 10), (12, 3), (7, 6)])
def test_round_trips(spark, budget, history):
    draw = random.Random(budget)
    roles = ["user", "assistant", "system", "tool:\\x", None]
    rows = [(7, t, "system" if t == 0 else draw.choice(roles), draw.choice(HARD + ["word " * draw.randint(0, 30)])) for t in range(200)]
    rows += [(c, t, draw.choice(roles), draw.choice(HARD)) for c in range(30, 60) for t in range(draw.randint(1, 6))]
    rows += [(None, 0, "assistant", "no id"), (None, None, "user", "no turn"), (8, 0, "system", "only this"), (9, 0, "user", "x" * 300_000), (9, 1, "assistant", "é" * 9)]
    formatted = chat.windows(frame(spark, rows), budget, history)
    got = [tuple(r)[:5] for r in chat.digests(formatted).collect()]
    assert sorted(got, key=repr) == plain(rows)
    kept = formatted.collect()
    for w in kept:
        turns = chat.parsed(w.text)
        assert w.n_tokens == len(chat.re.findall(chat.WORD, w.text))
        new = turns[w.n_repeated:]
        under = [chat.unescaped(w.text[s.start:s.end]) for s in w.loss]
        assert under == [text for role, text in new if role == "assistant"]
        if w.n_tokens > budget:  # only where one turn alone is longer than the room
            assert len([r for r, _ in new if r != "system"]) <= 1 or budget < 20
        if w.conv_id == 7 and w.first_index > 0:
            assert turns[0] == ("system", rows[0][3] or "") and w.n_repeated >= 1


def test_history_is_repeated_and_masked(spark):
    rows = [(1, 0, "system", "be kind"), *[(1, t, ("assistant", "user")[t % 2], f"w{t} " * 5) for t in range(1, 30)]]
    got = chat.windows(frame(spark, rows), 60, 20).orderBy("window").collect()
    assert len(got) > 4 and all(w.n_tokens <= 60 for w in got)
    for w in got[1:]:
        turns = chat.parsed(w.text)
        assert turns[0] == ("system", "be kind") and w.n_repeated == 3  # system and two turns of 7 words
        assert turns[1:] == [(r[2], r[3]) for r in rows[w.first_index - 2:w.first_index + len(turns) - 3]]
    assert sum(len(w.loss) for w in got) == sum(r[2] == "assistant" for r in rows)


def test_empty(spark):
    assert chat.digests(chat.windows(frame(spark, []))).count() == 0


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(QUERIES["op13_chat"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op13_chat"]) == []
