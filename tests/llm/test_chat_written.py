"""Operator 9: every example's context is written out and read back (its results are tested in test_text_spans)."""

import pytest
from pyspark.sql import functions as F

from cobframe.llm import chat
from tests.llm.test_text_spans import TURNS, conversations, ordered


def examples_of(spark, rows, **sizes):
    turns = chat.format_turns(conversations(spark, rows))
    texts, done = {}, []
    for r in chat.write_out(chat.expand(turns), **sizes).collect():
        if r["context"] is not None:
            texts.setdefault(r["conv_id"], []).append(r["context"])
        elif r["completion"] is not None:
            done.append((r["conv_id"], texts.pop(r["conv_id"], []), r))
    assert not texts
    return done


def test_examples_hold_their_whole_context(spark):
    found = examples_of(spark, TURNS, piece=7, held=20)
    want = {c: [i for i, row in enumerate(rows) if row[2] == "assistant"] for c, rows in ordered(TURNS).items()}
    seen = {c: [] for c in want}
    for conv, pieces, r in found:
        whole = "".join(pieces) + r["completion"]
        said = chat.parse(whole)
        assert said == [(role, x) for _, _, role, x in ordered(TURNS)[conv][:len(said)]]
        assert all(len(x) == 7 for x in pieces[:-1]) and len("".join(pieces)) == r["context_end"]
        assert chat.unescape(whole[r["loss_start"]:r["loss_end"]]) == said[-1][1]
        seen[conv].append(len(said) - 1)
    assert seen == want


def test_long_contexts_lie_in_a_scratch_file():
    for held in (0, 10, 1000):
        p, text = chat.Prefix(piece=5, held=held), ""
        assert list(p.pieces()) == []
        for part in ("ab", "\u20ac\U0001f600c", "", "d" * 23, "e", "\u00e9" * 5):
            p.add(part)
            text += part
            assert "".join(p.pieces()) == text == "".join(p.pieces())
            assert all(len(x) == 5 for x in list(p.pieces())[:-1]) and sum(map(len, p.full)) <= held
        assert (p.file is None) == (held == 1000)


def test_lengths_are_those_of_the_examples_written_out(spark):
    turns = chat.format_turns(conversations(spark, TURNS))
    want = {c: 0 for c in ordered(TURNS)}
    for conv, pieces, r in examples_of(spark, TURNS):
        want[conv] += len("".join(pieces)) + len(r["completion"])
    assert {r["conv_id"]: r["example_chars"] for r in chat.digests(turns).collect()} == want


def test_a_context_that_is_not_written_whole_is_an_error(spark, monkeypatch):
    write = chat.write_out
    monkeypatch.setattr(chat, "write_out", lambda rows: write(rows).withColumn(
        "context", F.when(F.length("context") > 1, F.expr("substring(context, 2)")).otherwise(F.col("context"))))
    with pytest.raises(Exception, match="not its prefix"):
        chat.digests(chat.format_turns(conversations(spark, TURNS))).collect()
