"""Substring dedup over sliding sentence spans.

From every sentence on, the run of three consecutive sentences, or as many more
as it takes to hold ten words, is a run; so are every two sentences that have
ten, and every one that has sixteen, a third of a passage of fifty, as the outer
sentences of a passage planted inside others are not whole.  Runs are hashed but
for those whose sentences all lie in shorter ones: these repeat wherever they
do.  The hashes meet in one global
aggregation; a run's first place is its smallest ``(doc_id, sentence)``.  Every
sentence that lies in a run at any other place is removed.

Defined results: a null text stays null and an empty one empty; sentences end at
a line end or at ``. ! ? …``, quotes and brackets closed after it, before white
space, and differences of case and
white space do not count; sentences without words are no part of runs and stay;
rows of equal doc_id and equal text are one document and keep the same
sentences; a null doc_id sorts first; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common

END = re.compile(r"[.!?…]+[\"'»”’)\]}]*(?=\s)|\n")
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse among 64-bit numbers
INVERSE = pow(BASE, -1, 1 << 64)


def sentences(text: str) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Bounds, word counts and hashes of the sentences that have words."""
    bounds, words, hashes = [], [], []
    cuts = [m.span() for m in END.finditer(text)]
    cuts.append((len(text), len(text)))
    start = 0
    for at, end in cuts:
        if text[at:end] != "\n":
            at = end
        parts = text[start:at].lower().split()
        if parts:
            bounds.append((start, at))
            words.append(len(parts))
            hashes.append(xxhash.xxh64_intdigest(" ".join(parts).encode("utf-8", "surrogatepass")))
        start = end
    return bounds, np.array(words, np.int64), np.array(hashes, np.uint64)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` powers of the base and of its inverse."""
    if len(_POWERS[0]) < count:
        for i, step in enumerate((BASE, INVERSE)):
            _POWERS[i] = np.cumprod(np.append(np.uint64(1), np.full(2 * count, step, np.uint64)))
    return _POWERS[0][:count], _POWERS[1][:count]


def runs(words: np.ndarray, hashes: np.ndarray, length: int = 3, least: int = 10, alone: int = 16):
    """``(first sentence, sentences, hash)`` of the runs."""
    count = len(words)
    held = np.zeros(count + 1, np.int64)
    np.cumsum(words, out=held[1:])
    first = np.arange(count)
    end = np.maximum(first + length, np.searchsorted(held, held[:-1] + least))  # the run that has words enough
    inside = end <= count
    whole = words >= alone  # runs of n sentences, each of which lies in a run
    spans = [(first[whole], first[whole] + 1)]
    for n in range(2, min(length, count + 1)):
        both = whole[:-1] & whole[1:]
        enough = held[n:] - held[:-n] >= least
        at = np.flatnonzero(enough & ~both)
        spans.append((at, at + n))
        whole = both | enough
    if length > 1 and count >= length:
        inside[:len(whole) - 1] &= ~(whole[:-1] & whole[1:] & (end[:len(whole) - 1] == first[:len(whole) - 1] + length))
    spans.append((first[inside], end[inside]))
    at, end = (np.concatenate(c) for c in zip(*spans, strict=True))
    # sums of hash times base to the minus place: any run's is a difference
    up, down = powers(count + 1)
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(hashes * down[:-1], out=sums[1:])
    mixed = ((sums[end] - sums[at]) * up[at]) ^ ((end - at).astype(np.uint64) * np.uint64(BASE))
    return at, end - at, mixed


def cut(text: str, removed: list[tuple[int, int]], length: int = 3, least: int = 10, alone: int = 16) -> tuple[str, int, int]:
    """The text without the sentences of the runs ``(hash, first sentence)``, its
    sentences, and how many went."""
    bounds, words, hashes = sentences(text)
    gone = np.zeros(len(bounds), bool)
    if removed:
        wanted = set(removed)
        for at, n, h in zip(*(c.tolist() for c in runs(words, hashes, length, least, alone)), strict=True):
            if (h, at) in wanted:
                gone[at:at + n] = True
    if not gone.any():
        return text, len(bounds), 0
    out, last = [], 0
    for (start, end), g in zip(bounds, gone.tolist(), strict=True):
        if g:
            out.append(text[last:start])
            last = end
            while last < len(text) and text[last] in " \t":
                last += 1
    kept = re.sub(r"\n{2,}", "\n", "".join([*out, text[last:]])).strip("\n")
    return kept, len(bounds), int(gone.sum())


def remove_repeats(docs: DataFrame, length: int = 3, least: int = 10, alone: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_sentences, n_removed`` for every row."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def spans(batch: pa.RecordBatch):
        for part in common.slices(batch, "text"):
            ids, places, hashes = [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), common.text_or_empty(part, "text"), strict=True):
                _, words, h = sentences(text)
                at, _, mixed = runs(words, h, length, least, alone)
                ids += [doc] * len(at)
                places.append(at)
                hashes.append(mixed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(ids, pa.int64()),
                 pa.array(np.concatenate(places).astype(np.int32))], ["h", "doc_id", "at"])

    found = common.map_batches(rows, spans, "h long, doc_id long, at int")
    first = found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first"))
    first = common.staged(first.where(F.col("n") > 1).select("h", F.col("first.doc_id").alias("fd"), F.col("first.at").alias("fa")), "repeats")
    again = found.join(first, "h").where(~(F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("at") == F.col("fa"))))
    gone = again.groupBy("doc_id").agg(F.collect_set(F.struct("h", "at")).alias("gone")).withColumnRenamed("doc_id", "gid")

    def edit(batch: pa.RecordBatch):
        for part in common.slices(batch, "text"):
            texts, n, k = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                if not text:
                    kept, total, less = text, 0, 0
                else:
                    marks = [(g["h"] % (1 << 64), g["at"]) for g in gone or []]
                    kept, total, less = cut(text, marks, length, least, alone)
                texts.append(kept)
                n.append(total)
                k.append(less)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())],
                ["doc_id", "text", "n_sentences", "n_removed"])

    both = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gid"]), "left").select("doc_id", "text", "gone")
    return common.map_batches(both, edit, "doc_id long, text string, n_sentences long, n_removed long")
