import numpy as np
import pytest
import xxhash

from cobframe.llm import simhash
from tests.llm.helpers import AWKWARD, docs_frame, prose


def plain_fingerprint(text, words=4):
    tokens = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
              .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, max_bits=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= max_bits and group[j] > group[i]:
                    group[j], changed = group[i], True
    ids = {g: [i for (i, _), x in zip(rows, group, strict=True) if x == g and i is not None] for g in set(group)}
    return sorted(((i, f"{p:016x}", min(ids[g], default=None)) for (i, _), p, g in zip(rows, prints, group, strict=True)), key=str)


def test_hash_is_the_one_spark_has(spark):
    words = ["", "a", "abc def", "été ñ " * 9, "x" * 31, "y" * 32, "z" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) h").collect()
    assert all(xxhash.xxh64_intdigest(r["w"].encode(), 42) == r["h"] % (1 << 64) for r in rows)


def test_golay_decoding_is_within_three_bits():
    v = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    index = simhash.codeword_index(v)
    assert np.bitwise_count(v ^ (index << 11 | simhash.PARITY[index])).max() <= 3


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_linked_fingerprints_share_a_key(bits):
    rng = np.random.default_rng(bits)
    for _ in range(200):
        a = int(rng.integers(0, 1 << 63)) * 2 + 1
        b = a
        for k in rng.choice(64, bits, replace=False):
            b ^= 1 << int(k)
        row, key = simhash.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_components_equal_brute_force(spark):
    base = prose(3, 300).split(" ")
    rows = [(100 + i, prose(i, 60)) for i in range(30)]
    for i in range(60):
        words = list(base)
        words[(7 * i) % 300] = f"changed{i}"
        rows.append((200 + i, " ".join(words)))
    rows += AWKWARD
    frame = docs_frame(spark, rows, clash=True)
    for cap in (2048, 8):  # with 8, buckets are split into blocks
        got = simhash.near_duplicates(frame, bucket_cap=cap).collect()
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == plain_components(rows)


def test_one_of_each_keeps_whole_rows(spark):
    rows = [(5, prose(1)), (3, prose(1)), (3, prose(1)), (9, prose(2)), (None, prose(4)), (7, None), (8, "")]
    got = simhash.one_of_each(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([3, 9, None, 7], key=str)
    assert all(r["lang"] == "en" for r in got)


def test_empty_table(spark):
    empty = docs_frame(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).columns == empty.columns


def test_more_bits_than_the_code_bears(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs_frame(spark, [(1, "a")]), max_bits=5)
