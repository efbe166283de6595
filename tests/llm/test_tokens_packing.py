import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cobframe.llm import packing, token_counts
from cobframe.llm.queries import COUNTING_VOCABULARY, PACKING_VOCABULARY, vocabulary
from tests.llm.helpers import AWKWARD, SF, docs_frame

COUNTING, PACKING = vocabulary(COUNTING_VOCABULARY), vocabulary(PACKING_VOCABULARY)
ODD = [*"aab  \n\t'stre_-.,!ÀéßŒœ“…€×µ0123", "<|endoftext|>", "<|startoftext|>", "\xa0", "́", "İ", "日本", "🙂", "ﬁ", "Σς", "\x1c",
       "\x85", "²", "<|", "‍", "'s", "'LL"]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(COUNTING), Tokenizer.from_file(PACKING)


def test_counts_and_ids_equal_the_library(libraries):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(ODD, k=rnd.randint(0, 50))) for _ in range(3000)] + ["a" * 3000, "ab" * 2000, " " * 500, ""]
    assert token_counts.Counter(COUNTING).count(texts) == [len(libraries[0].encode(t, add_special_tokens=False).ids) for t in texts]
    ids = packing.Encoder(PACKING).encode(texts)
    assert [x.tolist() for x in ids] == [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(libraries):
    texts = [f"word{i} other{i % 7}" for i in range(60)]
    small = token_counts.Counter(COUNTING, remember=10)
    assert [small.count([t])[0] for t in texts] == [len(libraries[0].encode(t).ids) for t in texts]
    coder = packing.Encoder(PACKING, remember=10)
    assert [coder.encode([t])[0].tolist() for t in texts] == [libraries[1].encode(t).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_counts_of_any_text(texts):
    library = Tokenizer.from_file(COUNTING) if not hasattr(test_counts_of_any_text, "lib") else test_counts_of_any_text.lib
    test_counts_of_any_text.lib = library
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert token_counts.counter(COUNTING).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_rows(spark, libraries):
    got = token_counts.token_counts(docs_frame(spark, AWKWARD, clash=True), COUNTING, limit=3).collect()
    want = []
    for i, t in AWKWARD:
        n = len(libraries[0].encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 3))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs_frame(spark, []), COUNTING).count() == 0


def plain_first_fit(lengths, capacity):
    room, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), None)
        if b is None:
            b = len(room)
            room.append(capacity)
        out[i] = (b, capacity - room[b])
        room[b] -= lengths[i]
    return [out[i][0] for i in range(len(lengths))], [out[i][1] for i in range(len(lengths))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_tournament_tree_is_first_fit(lengths):
    assert packing.first_fit_decreasing(lengths, 50) == plain_first_fit(lengths, 50)


def check_packing(rows, docs, library, capacity):
    bodies = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in docs)
    assert sum(r["length"] for r in rows) == sum(map(len, bodies))
    assert all(r["length"] > 0 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        assert all(r["sequence_tokens"] == at and r["padding"] == (0 if at & (at - 1) == 0 else capacity - at) for r in held)
    whole = {}
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), capacity):
            part = ids[s:s + capacity]
            key = (i, s, len(part), zlib.crc32(part.tobytes()), len(ids))
            whole[key] = whole.get(key, 0) + 1
    got = {}
    for r in rows:
        key = tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))
        got[key] = got.get(key, 0) + 1
    assert got == whole


@pytest.mark.parametrize("group", [16_384, 3])
def test_packing_is_whole(spark, libraries, group):
    frame = docs_frame(spark, AWKWARD, clash=True)
    rows = packing.pack(frame, PACKING, capacity=64, group_pieces=group).collect()
    check_packing(rows, AWKWARD, libraries[1], 64)


def test_packing_wastes_little(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, PACKING).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], libraries[1], 4096)
    sequences = {r["sequence_id"]: r["sequence_tokens"] for r in rows}
    assert sum(sequences.values()) > 0.97 * 4096 * (len(sequences) - 1)


def test_empty_table_packs_to_nothing(spark):
    assert packing.pack(docs_frame(spark, []), PACKING).count() == 0


def test_equal_parts_of_texts_are_split_into_words_once(libraries, monkeypatch):
    read = []

    class Spy:
        def findall(self, text):
            read.append(len(text))
            return words.findall(text)

    words = packing.WORDS
    monkeypatch.setattr(packing, "WORDS", Spy())
    coder = packing.Encoder(PACKING)
    texts = ["Alpha beta, it's\n7x " * 1000, "", "  beta, ALPHA\tgamma "]
    for part in (texts[:1], texts):
        assert [x.tolist() for x in coder.encode(part)] == [libraries[1].encode(t, add_special_tokens=False).ids for t in part]
    assert sum(read) < 50  # it was every character of every text
