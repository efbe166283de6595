"""Toxicity by a factorization machine over hashed terms.

A document's terms are its lower-cased words and their four- and five-letter
beginnings, hashed.  On a bounded sample of labelled rows the terms that go with
the label are chosen by chi-square; a second-order factorization machine is
then trained on them, so that pairs of terms count beside each one alone.  The
logit is shifted so that the best cut on the rows kept back lies at the
threshold.

Defined results: a null or empty text has no terms and gets the machine's
constant; a null label is no label, of several labels of a doc_id the largest
counts; without labels of both kinds every score is the share of toxic labels
(0 without labels); repeated rows are scored each for itself; other columns
never reach a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common
from cobframe.llm.token_counts import Codes

WORD = re.compile(r"\w+")
SPACE = 1 << 20


def word_terms(word: str) -> list[int]:
    """Hashed terms of a word."""
    forms = [word, *("^" + word[:n] for n in (4, 5) if len(word) > n)]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SPACE for f in forms]


class Terms:
    """Distinct hashed terms of texts; remembers words up to a fixed number.
    ``keep``: sorted terms of a model; with it, positions in it are returned."""

    def __init__(self, keep: np.ndarray | None = None, remember: int = 300_000):
        self.keep, self.remember = keep, remember
        self.clear()

    def clear(self) -> None:
        self.seen, self.rows = Codes(), np.zeros((0, 3), np.int64)

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        fresh = np.full((len(words), 3), -1, np.int64)
        for i, w in enumerate(words):
            t = word_terms(w)
            fresh[i, :len(t)] = t
        if self.keep is not None:
            at = np.minimum(np.searchsorted(self.keep, fresh), max(0, len(self.keep) - 1))
            fresh = np.where(self.keep[at] == fresh, at, -1) if len(self.keep) else np.full_like(fresh, -1)
        self.rows = np.concatenate([self.rows, fresh])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The distinct terms of each text."""
        if len(self.seen) > self.remember:
            self.clear()
        look = self.seen.__getitem__
        coded = [np.fromiter(map(look, set(WORD.findall(t.lower()))), np.int64) for t in texts]
        self.learn(self.seen.take())
        out = []
        for codes in coded:
            found = self.rows[codes].ravel()
            out.append(np.unique(found[found >= 0]))
        return out


def kept_terms(terms: np.ndarray) -> Terms:
    """A worker's memory of words, for the model whose terms these are."""
    return common.remembered(("terms", terms.tobytes()), lambda: Terms(terms))


@dataclass
class Machine:
    """``bias + sum w + half (square of sum v - sum of squares v)`` over a document's terms."""
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray) -> float:
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2).sum() - (v ** 2).sum())
        return self.bias + float(self.weights[at].sum()) + pairs


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def select_terms(rows: list[np.ndarray], y: np.ndarray, most: int, least_docs: int = 5, chi: float = 20.0) -> np.ndarray:
    flat = np.concatenate(rows)
    label = np.repeat(y, [len(r) for r in rows])
    n, n1 = len(y), int(y.sum())
    a = np.bincount(flat[label == 1], minlength=SPACE).astype(float)
    df = np.bincount(flat, minlength=SPACE).astype(float)
    b, c, d = df - a, n1 - a, n - n1 - (df - a)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = n * (a * d - b * c) ** 2 / (df * (n - df) * n1 * (n - n1))
    score[(df < least_docs) | ~np.isfinite(score)] = 0
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] > chi])


def fit(rows: list[np.ndarray], y: np.ndarray, threshold: float = 0.3, most_terms: int = 1024, rank: int = 8,
        epochs: int = 30, step: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Train on ``rows`` of distinct hashed terms with labels ``y`` (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.0
    none = np.zeros(0, np.int64)
    if share in (0.0, 1.0):
        logit = float(np.clip(np.log(max(share, 1e-12) / max(1 - share, 1e-12)), -35, 35))
        return Machine(none, logit, np.zeros(0), np.zeros((0, rank)))
    rng = np.random.default_rng(seed)
    back = rng.random(len(y)) < 0.2  # kept back to place the cut
    if y[back].min(initial=1) == y[back].max(initial=0) or y[~back].min(initial=1) == y[~back].max(initial=0):
        back = np.zeros(len(y), bool)
    terms = select_terms([r for r, k in zip(rows, back, strict=True) if not k], y[~back], most_terms)
    x = np.zeros((len(rows), len(terms)), np.uint8)
    if len(terms):
        for i, r in enumerate(rows):
            at = np.minimum(np.searchsorted(terms, r), len(terms) - 1)
            x[i, at[terms[at] == r]] = 1
    bias, w = np.log(share / (1 - share)), np.zeros(len(terms))
    v = rng.normal(0, 0.05, (len(terms), rank))
    gb, gw, gv = 1e-6, np.full(len(terms), 1e-6), np.full(v.shape, 1e-6)
    train = np.flatnonzero(~back)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 256):
            part = train[at:at + 256]
            xb, yb = x[part].astype(float), y[part]
            s = xb @ v
            out = bias + xb @ w + 0.5 * ((s ** 2).sum(1) - xb @ (v ** 2).sum(1))
            g = (sigmoid(out) - yb) / len(part)
            dw = xb.T @ g + decay * w
            dv = xb.T @ (g[:, None] * s) - (xb.T @ g)[:, None] * v + decay * v
            gb += g.sum() ** 2
            gw += dw ** 2
            gv += dv ** 2
            bias -= step * g.sum() / np.sqrt(gb)
            w -= step * dw / np.sqrt(gw)
            v -= step * dv / np.sqrt(gv)
    machine = Machine(terms, float(bias), w, v)
    held = back if back.any() else np.ones(len(y), bool)
    raw = np.array([machine.logit(np.flatnonzero(r)) for r in x[held]])
    if raw.max() > raw.min():  # scores that do not tell rows apart have no cut
        machine.bias += float(np.log(threshold / (1 - threshold))) - best_cut(raw, y[held])
    return machine


def best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The logit between two scores that gives the best F1; of equal ones, the
    middle of the widest gap.  Both sides hold rows."""
    order = np.argsort(-raw, kind="stable")
    s, hit = raw[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    gap = np.append(s[:-1] - s[1:], 0.0)
    f1 = np.where(gap > 0, f1, -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[np.argmax(gap[best])]
    return float(s[at] - gap[at] / 2)


def train(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 16_000,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          use: Column | None = None) -> Machine:
    """Fit a machine on at most ``sample_rows`` labelled rows, those whose id
    hashes lowest; only their hashed terms come to the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    if use is not None:
        known = known.where(use)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # the sample is ids and labels, ``sample_rows`` of them at most: every task may hold it
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "doc_id").select("text", "y")

    def run(batches):
        terms = Terms()
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = [t.astype("<i4").tobytes() for t in terms.of(common.text_or_empty(part, "text"))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column("y")], ["terms", "y"])

    got = texts.mapInArrow(run, "terms binary, y int").toArrow()
    rows = sorted(zip(got.column("terms").to_pylist(), got.column("y").to_pylist(), strict=True))
    return fit([np.frombuffer(t, "<i4").astype(np.int64) for t, _ in rows],
               np.array([y for _, y in rows], float), threshold)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    common.prepare(docs.sparkSession)

    def run(batches):
        terms = kept_terms(machine.terms)
        for batch in batches:
            for part in common.slices(batch, "text"):
                s = [float(sigmoid(machine.logit(t))) for t in terms.of(common.text_or_empty(part, "text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s, pa.float64()),
                     pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 16_000,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that a machine trained on them and ``labels`` does not reject."""
    common.prepare(docs.sparkSession)
    machine = train(docs, labels, threshold, sample_rows, id_col, text_col, use=~held_out(F.col("doc_id")))
    place = docs.columns.index(text_col)

    def run(batches):
        terms = kept_terms(machine.terms)
        for batch in batches:
            for part in common.slices(batch, place):
                found = terms.of([t or "" for t in part.column(place).to_pylist()])
                yield part.filter(pa.array([sigmoid(machine.logit(t)) < threshold for t in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 16_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    common.prepare(docs.sparkSession)
    machine = train(docs, labels, threshold, sample_rows, use=~held_out(F.col("doc_id")))
    return score(docs, machine, threshold).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
