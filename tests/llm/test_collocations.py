import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cobframe.llm import collocations
from tests.llm.helpers import AWKWARD

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, top):
    """Brute force over every contiguous run of words."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    out = []
    for (lang, g), a in found.items():
        if any(c >= a for (other, h), c in found.items() if other == lang and len(h) > len(g)
               and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, f[lang, g[:cut]], f[lang, g[cut:]], n[lang], score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return ranked


def corpus(seed, docs=60, vocabulary=7):
    rnd = random.Random(seed)
    words = ["La", "la", "été", "x", "to", "Be", "Zé", "ß", "日本"][:vocabulary]
    rows = []
    for i in range(docs):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b"]) for _ in range(rnd.randint(0, 60)))
        rows.append((i, text, rnd.choice(["en", "en", None, "und", "fr"])))
    passage = "to be x la be to Zé été x x to"
    return rows + [(1000 + i, f"{passage}. {passage}", "en") for i in range(12)] + [(i, t, "awk") for i, t in AWKWARD] + [
        (i, t, "awk") for i, t in AWKWARD[4:]]


def result(frame, **settings):
    rows = collocations.collocations(frame, **settings).collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("seed,least,top", [(1, 3, 2000), (2, 8, 7)])
def test_against_brute_force(spark, seed, least, top):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("w", "g", "k", "f", "h", "word", "n", "rank", "phrase"):
        frame = frame.withColumn(name, F.lit("x"))
    assert result(frame, least=least, top=top) == plain(rows, least, top)


def test_full_filters_change_nothing(spark):
    rows = corpus(3, vocabulary=9)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert result(frame, least=4, top=50, filter_bits=64) == plain(rows, 4, 50)
    with pytest.raises(ValueError):
        collocations.collocations(frame, filter_bits=100)


def test_busy_pairs_are_spread_out(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUSY", 40)
    rows = corpus(5, vocabulary=4)
    assert result(spark.createDataFrame(rows, SCHEMA), least=3, top=500) == plain(rows, 3, 500)


def test_units_in_small_steps(spark, monkeypatch):
    """Words met again after the memory was emptied have the same names."""
    plain_units = collocations.units
    monkeypatch.setattr(collocations, "units", lambda batches: plain_units(batches, hold=50, remember=5))
    rows = corpus(4)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pylist([{"lang": l or "und", "text": t} for _, t, l in rows])
    counts = Counter()
    for lang, codes, known in collocations.units(iter([batch.slice(0, 30), batch.slice(30)])):
        assert codes[-1] == 0
        for c in codes[codes > 0]:
            counts[lang, known.words[c].decode(), int(known.hashes[c])] += 1
    whole = Counter()
    for lang, codes, known in plain_units(iter([batch])):
        for c in codes[codes > 0]:
            whole[lang, known.words[c].decode(), int(known.hashes[c])] += 1
    assert counts == whole


def test_scores_beyond_64_bits(spark):
    big = 10 ** 14
    grams = spark.createDataFrame([("en", 2, [1, 2], big - 7)], "lang string, k int, g array<long>, f long")
    single = spark.createDataFrame([("en", 1, big), ("en", 2, big + 1)], "lang string, h long, f long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    [row] = collocations.scored(grams, single, totals).collect()
    assert row["score"] == Fraction(1000 * (big - 7) * 9 * big, big * (big + 1)).__floor__()


def test_bit_filter_has_every_value(spark):
    values = np.random.default_rng(3).integers(-2**63, 2**63 - 1, 500)
    frame = spark.createDataFrame([(int(v),) for v in values], "v long")
    held = collocations.bit_filter(frame, "v", 1 << 20).value
    assert held.has(values.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(-2**63, 2**63 - 1, 5000)
    assert held.has(others.view(np.uint64)).mean() < 0.05


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
