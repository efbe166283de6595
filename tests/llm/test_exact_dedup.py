import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cobframe.llm import common, exact_dedup
from tests.llm.helpers import AWKWARD, docs_frame, prose


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    """Brute force: (doc_id, keep_id, group_size, sha) of every row, and how many stay of each group."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lowered(t)] if x is not None]
        out.append((i, max(ids, default=None), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def result(frame, **settings):
    rows = exact_dedup.exact_duplicates(frame, **settings).collect()
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str), sum(r["kept"] for r in rows)


CASES = [*AWKWARD, (9, "ABC É"), (10, "abc É"), (11, "abc é"), (12, "Aßc"), (13, "aßC"), (14, "K"), (15, "k"), (3, "   \n\t "),
         (16, "İ"), (17, "i̇"), (-4, "ABC É"), *((100 + i, prose(i % 40)) for i in range(120)), *((500 + i, "Hot copy") for i in range(150))]


@pytest.mark.parametrize("clash", [False, True])
def test_against_brute_force(spark, clash):
    frame = docs_frame(spark, CASES, clash)
    if clash:
        for name in ("digest", "place", "suspect", "word", "bits", "slot", "keep"):
            frame = frame.withColumn(name, F.lit("x"))
    assert result(frame.repartition(7)) == plain(CASES)


def test_full_filter_changes_nothing(spark):
    assert result(docs_frame(spark, CASES), slots_per_row=1, filter_bits=64) == plain(CASES)
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(docs_frame(spark, CASES), filter_bits=100)


def test_groups_beside_the_large_ones(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE", 3)
    assert result(docs_frame(spark, CASES)) == plain(CASES)


def test_empty_table(spark):
    out = exact_dedup.exact_duplicates(docs_frame(spark, []))
    assert out.collect() == []
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_only_suspects_are_shuffled(spark):
    rows = docs_frame(spark, [(i, f"text {i}") for i in range(3000)] + [(5000 + i, "text 7") for i in range(50)])
    digests = common.staged(rows.select("doc_id", F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("digest")), "t")
    bits = exact_dedup.power_of_two(3050 * 64)
    words = exact_dedup.repeated_filter(digests, bits, bits)
    told = exact_dedup.flagged(digests, words, bits)
    assert 51 <= told.where("suspect").count() < 120
    assert "Exchange hashpartitioning(_word" not in told._jdf.queryExecution().toString()


def test_plan_has_no_python(spark):
    plan = exact_dedup.exact_duplicates(docs_frame(spark, CASES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
