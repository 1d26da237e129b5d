"""Few conversations: marks say who speaks where nothing else was counted."""

import random

import pytest

from orrery.llm import chat


@pytest.mark.parametrize("conversations", [1, 2])
def test_few_conversations(spark, conversations):
    said = [("system", "Be brief."), ("user", "What is the time?"), ("assistant", "It is noon.\nOr near it."), ("user", "Thanks, and the day?"), ("assistant", "Monday.")]
    rows = [(c, t, role, text) for c in range(conversations) for t, (role, text) in enumerate(said)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).orderBy("conv_id", "turn").collect()
    by = [[(r.role, r.text) for r in got if r.conv_id == c] for c in range(conversations)]
    right = sum(x in said for own in by for x in own)
    assert {role for own in by for role, _ in own} >= {"user", "assistant"} and right >= 3 * conversations


def _plain_turns(lines):
    """Turn numbers of one transcript's (role, begins), line by line."""
    out, turn, role = [], -1, None
    for r, begins in lines:
        turn += begins or r != role
        role = r
        out.append(turn)
    return out


@pytest.mark.parametrize(("block", "span"), [(1, 1), (3, 2), (7, 3), (512, 1024)])
def test_turns_are_numbered_across_blocks_and_spans(spark, monkeypatch, block, span):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "SPAN", span)
    rng = random.Random(block)
    talks = {c: [(rng.choice(chat.ROLES), rng.random() < 0.3) for _ in range(n)] for c, n in ((1, 100), (2, 1), (3, block), (4, block + 1))}
    rows = [(c, i, f"{i}", r, b) for c, ls in talks.items() for i, (r, b) in enumerate(ls)]
    df = spark.createDataFrame(rows, "conv_id long, line long, text string, role string, begins boolean").repartition(4)
    got = {(r.conv_id, r.line): r.turn for r in chat._turns(df).collect()}
    assert got == {(c, i): t for c, ls in talks.items() for i, t in enumerate(_plain_turns(ls))}


def test_path_is_that_of_one_block_whatever_the_spans(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, ("user", "assistant")[t % 2], "\n".join(rng.choice(["Why?", "so be it", "", "User: no", "x" * 90]) for _ in range(rng.randint(1, 5)))) for c in range(3) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = []
    for block, span in ((100_000, 1), (5, 2), (2, 3)):
        monkeypatch.setattr(chat, "BLOCK", block)
        monkeypatch.setattr(chat, "SPAN", span)
        found.append(sorted(map(tuple, chat.format_chats(df).collect())))
    assert found[0] == found[1] == found[2]


def test_numbers_of_a_transcript_in_many_chunks(spark):
    rows = [(1, t, "user", "\n".join("ab"[: 1 + t % 2])) for t in range(500)] + [(2, t, "user", "a") for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = chat._numbered(chat.seen(chat.transcripts(df))).orderBy("conv_id", "line").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for conv in (1, 2):
        mine = [r for r in lines if r.conv_id == conv]
        assert [r.line for r in mine] == list(range(len(mine)))
        assert [(r.turn, r.k) for r in mine] == sorted((r.turn, r.k) for r in mine)
        assert [r.after_blank for r in mine] == [0, *(int(r.blank) for r in mine[:-1])]
