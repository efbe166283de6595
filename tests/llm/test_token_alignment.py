import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cobframe.llm import token_alignment as T
from cobframe.llm.queries import ALIGNED_VOCABULARIES, vocabulary
from cobframe.llm.token_counts import byte_symbols
from tests.llm.helpers import AWKWARD, SF, docs_frame, prose

A, B = map(vocabulary, ALIGNED_VOCABULARIES)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(libraries, text):
    """Brute force: the groups of a text, tokenized in one go."""
    if not text:
        return []
    a, b = libraries
    chars = byte_symbols()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return []
    out, i, j, end_a, end_b = [], 0, 0, 0, 0
    while i < len(ids_a):
        first = i, j
        while True:
            if end_a <= end_b:
                end_a += len(raw_a[i])
                i += 1
            else:
                end_b += len(raw_b[j])
                j += 1
            if end_a == end_b:
                break
        out.append((ids_a[first[0]:i], ids_b[first[1]:j]))
    return out


def plain(libraries, rows):
    groups = [groups_of(libraries, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for x in links for p in x)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), g, own in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def texts():
    rnd = random.Random(5)
    bits = ["the", " ", "  ", "\n", "\n\n", "\t", "don't", "été", "日本語", "🙂", "x1", "1234", ".", "...", "\r\n", "<|endoftext|>", "</s>",
            "<0x0A>", "ﬁ", " ", "　", "́", "A", "'s", "\x1c", "\x85", "--", "zażółć", "​", "Ünï"]
    odd = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    return [*odd, " lead", "\nlead", "trail ", "trail\n", " ", "\n", "a▁b", "▁", "x \ny", "x\n y", "q" * 700, "é" * 300]


ROWS = [*AWKWARD[:-3], (8, "\u0000\u0001 ퟿ 🙂 日本語"), *((100 + i, t) for i, t in enumerate(texts())),
        (900, prose(3, 900)), (901, prose(3, 900)), (900, prose(3, 900))]


def result(frame, **settings):
    return sorted((tuple(r) for r in T.alignments(frame, A, B, **settings).collect()), key=str)


@pytest.mark.parametrize("chunk_chars", [32_768, 37])
def test_against_brute_force(spark, libraries, chunk_chars):
    frame = docs_frame(spark, ROWS, clash=True)
    for name in ("row", "seq", "cover", "code", "codes", "docs", "bad", "groups", "times"):
        frame = frame.withColumn(name, F.lit("x"))
    assert result(frame.repartition(3), chunk_chars=chunk_chars) == plain(libraries, ROWS)


def test_blocks_of_counts(spark, libraries):
    rows = ROWS[:60] + [(7, prose(8, 300))]
    assert result(docs_frame(spark, rows), chunk_chars=400, most_pairs=40) == plain(libraries, rows)


def test_real_texts(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert result(docs_frame(spark, rows), chunk_chars=2000) == plain(libraries, rows)


def test_empty_table(spark):
    assert result(docs_frame(spark, [])) == []
    assert result(docs_frame(spark, [(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def shape(x):
    return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in x.__dict__.items()}


def test_composition_is_associative():
    rnd = np.random.default_rng(7)
    for _ in range(60):
        n = int(rnd.integers(2, 60))
        cuts = np.unique(rnd.integers(0, n, 4))
        ends_a, ends_b = (np.unique(np.append(rnd.integers(1, n + 1, n // 2), n)) for _ in "ab")
        a, b = np.arange(len(ends_a)), np.arange(len(ends_b)) + 100
        parts = []
        for low, high in zip([0, *cuts], [*cuts, n], strict=True):
            of_a, of_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
            parts.append(T.fragment(a[of_a], b[of_b], ends_a[of_a], ends_b[of_b], 1000))
        whole = shape(T.fragment(a, b, ends_a, ends_b, 1000))
        assert shape(T.composed(parts, 1000)) == whole
        k = int(rnd.integers(0, len(parts) + 1))
        halves = [T.composed(parts[:k], 1000), T.Fragment(), T.composed(parts[k:], 1000)]
        assert shape(T.composed(halves, 1000)) == whole


def test_ranges_cover_a_text_and_leave_giant_words_whole():
    text = " " + prose(2, 300) + " " + "w" * 5000 + " " + prose(4, 50)
    found = list(T.ranges(text, 100))
    assert sum(size for _, _, size in found) == len(text.encode())
    assert "".join(cover.encode()[skip:skip + size].decode() for cover, skip, size in found) == text
    assert sum(len(cover) for cover, _, _ in found) < 2 * len(text)


def test_large_groups_by_distinct_ids(monkeypatch):
    a, b = np.array([5, 5, 6, 9, 5]), np.array([1, 2, 1, 1, 7])
    sides = np.array([3, 2]), np.array([4, 1])
    codes, times, _ = T.group_links(a, b, *sides, 10)
    monkeypatch.setattr(T, "LARGE_GROUP", 2)
    few, more, _ = T.group_links(a, b, *sides, 10)
    assert len(few) < len(codes)
    assert [x.tolist() for x in T.summed(codes, times)] == [x.tolist() for x in T.summed(few, more)]


def test_vocabulary_files_are_what_tiles_need():
    with open(A, encoding="utf-8") as f:
        spec = json.load(f)
    assert spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel"
    T.Vocabularies(A, B)


def test_tiles_are_tokenized_in_short_runs(libraries):
    voc = T.Vocabularies(A, B)
    longest = []

    class Spy:
        def encode(self, text, **kw):
            longest.append(len(text))
            return libraries[1].encode(text, **kw)

    voc.b = Spy()
    tiles = [f" word{i * 7919}, {'<|endoftext|>' if i % 50 == 0 else ''}".rstrip() for i in range(5000)]
    a, n_a, b, n_b = voc.encode(tiles)
    assert max(longest) < 20_000  # it was one text of all tiles
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    for k in range(0, 5000, 25):
        assert a[ends_a[k] - n_a[k]:ends_a[k]].tolist() == libraries[0].encode(tiles[k], add_special_tokens=False).ids
        assert b[ends_b[k] - n_b[k]:ends_b[k]].tolist() == libraries[1].encode(tiles[k][1:])
