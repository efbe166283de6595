"""Small inputs with the awkward cases every operator must bear."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns whose names the operators use inside
CLASH = "key string, fp string, h string, at string, block string, salt string, grp string, node string, label string, r string"


def docs_frame(spark, rows, clash=False):
    """``rows``: (doc_id, text)."""
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC_SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        for part in CLASH.split(", "):
            frame = frame.withColumn(part.split(" ")[0], F.lit("x"))
    return frame


def prose(seed: int, words: int = 40) -> str:
    """Invented sentences."""
    rnd = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(rnd.choice(["ka", "lo", "mi", "ren", "su", "tav", "or", "el"]) for _ in range(rnd.randint(1, 4)))
        if i % 8 == 0:
            w = w.capitalize()
        out.append(w + ("." if i % 8 == 7 else ""))
    return " ".join(out)


AWKWARD = [(None, None), (None, "lost id"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "one"),
           (6, prose(1, 30_000)), (7, "é" * 5000), (8, "\u0000\u0001 \ud7ff 🙂 日本語 ﬁ ́")]
