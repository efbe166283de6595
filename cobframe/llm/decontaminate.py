"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, units after a
number, and capitalised words inside a sentence give typed placeholders.
Windows of eight template words are hashed and joined with those of the
benchmark; so are windows of eight plain words, lower-cased and without
placeholders, which find verbatim what templates cannot carry.  Along one alignment of a document with an item, every slot value of
the item must go to one value of the document (a re-parameterised question
replaces 5 by 7 everywhere), the one that more than half of its places take;
windows with a slot that neither does so nor keeps the item's value are dropped.
A pair is a finding when its alignments cover the wanted share of the item's
template windows or of its plain ones, or one of them as many windows as a
passage of 13 words has; it is exact when no slot differs along them.

Defined results: null and empty texts have no windows; an item of fewer words
than a window is one window as a whole, one of fewer than ``least_words`` a plain
one only, and one of fewer than ``least_plain`` takes no part; a template window
with fewer literal words than half its length says too little and is no
evidence; ``share``, ``n_windows`` and ``item_windows`` are those of the sort of
windows, template or plain, with the larger share; repeated rows and rows of equal id and text are one
document, items of equal id and text one item; a row without doc_id is found
with a null doc_id; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common
from cobframe.llm.substring import powers
from cobframe.llm.token_counts import Codes

NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?|[0-9][0-9.,]*[a-z]{1,3}")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg ton tons tonnes lb lbs oz ml l litre litres liter "
    "liters gallon gallons second seconds s minute minutes min hour hours h day days week weeks month months year years "
    "percent degrees celsius fahrenheit mph kmh km/h dollar dollars usd euro euros eur pound pounds cents watts w kw v "
    "volts amps hz khz mhz ghz kb mb gb tb joules newton newtons pa bar".split())
WORD = re.compile(r"\n|[^\s]+")
LITERAL, NUM, UNIT, NAME, BREAK, NONE = range(6)
MARKS = np.array([0, 0x6E756D, 0x756E6974, 0x6E616D65], np.uint64)  # hashes of the placeholders
FACTOR = np.uint64(0x9E3779B97F4A7C15)
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"
HIT_SCHEMA = "doc_key long, doc_id long, pos int, h long, slots array<string>"


class Templates:
    """Template words of texts; remembers words up to a fixed number."""

    def __init__(self, remember: int = 300_000):
        self.remember = remember
        self.clear()

    def clear(self) -> None:
        self.seen = Codes()
        self.kind, self.hash = np.zeros(0, np.int8), np.zeros(0, np.uint64)
        self.capital, self.ends, self.core = np.zeros(0, bool), np.zeros(0, bool), []

    def learn(self, words: list[str]) -> None:
        kind, hashes, capital, ends = [], [], [], []
        for w in words:
            core = w.strip(EDGE)
            low = core.lower()
            ends.append(w == "\n" or w.rstrip("\"'»”’)]")[-1:] in tuple(".!?:…"))
            capital.append(core[:1].isupper())
            kind.append(BREAK if w == "\n" else NONE if not core else NUM if NUMBER.fullmatch(low) else UNIT if low in UNITS else LITERAL)
            hashes.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
            self.core.append(core)
        self.kind = np.append(self.kind, np.array(kind, np.int8))
        self.hash = np.append(self.hash, np.array(hashes, np.uint64))
        self.capital = np.append(self.capital, np.array(capital, bool))
        self.ends = np.append(self.ends, np.array(ends, bool))

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Template hash, plain hash, kind and code of every word of each text."""
        if len(self.seen) > self.remember:
            self.clear()
        look = self.seen.__getitem__
        coded = []
        for text in texts:
            words = WORD.findall(text)
            coded.append(np.fromiter(map(look, words), np.int64, len(words)))
        self.learn(self.seen.take())
        for code in coded:
            code = code[self.kind[code] != NONE]
            kind = self.kind[code].copy()
            before = np.append(True, self.ends[code][:-1])
            kind[(kind == LITERAL) & self.capital[code] & ~before] = NAME
            solid = kind != BREAK
            code, kind = code[solid], kind[solid]
            after_number = np.append(False, kind[:-1] == NUM)
            kind[(kind == UNIT) & ~after_number] = LITERAL
            plain = self.hash[code]
            yield np.where(kind == LITERAL, plain, MARKS[np.where(kind == LITERAL, 0, kind)]), plain, kind, code

    def slots(self, kind: np.ndarray, code: np.ndarray) -> list[str]:
        return [f"{k}:{self.core[c].lower()}" for k, c in zip(kind.tolist(), code.tolist(), strict=True) if k != LITERAL]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words."""
    count = len(words) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    # sums of hash times base to the minus place: any window's is a difference
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * down[:-1], out=sums[1:])
    return ((sums[n:] - sums[:count]) * up[:count]) ^ (np.uint64(n) * FACTOR)


def literals(kind: np.ndarray, n: int) -> np.ndarray:
    """Literal words of every window of ``n`` words."""
    held = np.append(0, np.cumsum(kind == LITERAL))
    return held[n:] - held[:max(0, len(held) - n)]


def _item_windows(window: int, least_words: int, least_plain: int):
    def run(batches):
        templates = Templates()
        for batch in batches:
            out = []
            for item, (words, plain, kind, code) in zip(batch.column("item_id").to_pylist(),
                                                        templates.of(common.text_or_empty(batch, "text")), strict=True):
                n = min(window, len(words))
                if n < min(least_words, least_plain):
                    continue
                if n >= least_words:
                    at = np.flatnonzero(literals(kind, n) >= (n + 1) // 2)
                    h = window_hashes(words, n)[at]
                    for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        places = p + np.flatnonzero(kind[p:p + n] != LITERAL)
                        out.append((item, False, p, x, n, len(at), templates.slots(kind[p:p + n], code[p:p + n]), places.tolist()))
                h = window_hashes(plain, n).view(np.int64).tolist()
                out += [(item, True, p, x, n, len(h), [], []) for p, x in enumerate(h)]
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["item_id", "plain", "ipos", "h", "n", "windows", "islots", "places"])
    return run


def agreeing(met: list[dict]) -> list[int]:
    """Item positions of an alignment's windows whose slots all keep the item's
    value or go to the one that most places of that value take."""
    pairs = {p: (a, b) for w in met for p, a, b in zip(w["places"], w["islots"], w["slots"], strict=True)}
    value, pair = Counter(a for a, _ in pairs.values()), Counter(pairs.values())
    good = {(a, b) for (a, b), n in pair.items() if a == b or 2 * n > value[a]}
    return [w["ipos"] for w in met if all(x in good for x in zip(w["islots"], w["slots"], strict=True))]


def known_only(wanted: np.ndarray | None, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose hashes are among the sorted ``wanted``; all without such."""
    h = h.view(np.int64)
    if wanted is None:
        return at, h
    if not len(wanted) or not len(h):
        return at[:0], h[:0]
    hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
    return at[hit], h[hit]


def _judged(batch: pa.RecordBatch):
    """Every alignment's windows that count."""
    met = batch.column("met").to_pylist()
    yield pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in ("doc_key", "doc_id", "item_id", "plain", "windows")),
         pa.array([agreeing(m) for m in met], pa.list_(pa.int32())),
         pa.array([all(w["islots"] == w["slots"] for w in m) for m in met], pa.bool_())],
        ["doc_key", "doc_id", "item_id", "plain", "windows", "covered", "same"])


def findings(docs: DataFrame, benchmark: DataFrame, window: int = 8, share: float = 0.3, passage_windows: int = 6,
             least_words: int = 5, least_plain: int = 3, small_windows: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_key, doc_id, item_id, n_windows, item_windows, share, exact`` of every
    document and item that share template windows or plain windows enough.

    Up to ``small_windows`` distinct benchmark windows (counted first) their
    hashes go to every task and only hits leave it; beyond, all windows of the
    documents are joined by a shuffle.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    known = common.staged(items.mapInArrow(
        _item_windows(window, least_words, least_plain),
        "item_id long, plain boolean, ipos int, h long, n int, windows int, islots array<string>, places array<int>"), "items")
    sizes = [r["n"] for r in known.select("n").distinct().collect()] or [window]  # at most ``window`` of them
    distinct = known.select("h").distinct()
    few = distinct.limit(small_windows + 1).count() <= small_windows
    held = spark.sparkContext.broadcast(
        np.sort(distinct.toArrow().column("h").to_numpy()) if few else None)

    def run(batches):
        templates = common.remembered("templates", Templates)
        wanted = held.value
        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            out = []
            for key, doc, (words, plain, kind, code) in zip(batch.column("doc_key").to_pylist(), batch.column("doc_id").to_pylist(),
                                                            templates.of(common.text_or_empty(batch, "text")), strict=True):
                for n in sizes:
                    at, h = known_only(wanted, np.arange(max(0, len(plain) - n + 1)), window_hashes(plain, n))
                    out += [(key, doc, p, x, []) for p, x in zip(at.tolist(), h.tolist(), strict=True)]
                    if n < least_words:
                        continue
                    # a template window without placeholders is its plain window
                    own = literals(kind, n)
                    at = np.flatnonzero((own >= (n + 1) // 2) & (own < n))
                    at, h = known_only(wanted, at, window_hashes(words, n)[at])
                    for p, x in zip(at.tolist(), h.tolist(), strict=True):
                        out.append((key, doc, p, x, templates.slots(kind[p:p + n], code[p:p + n])))
                if len(out) > 20_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                          ["doc_key", "doc_id", "pos", "h", "slots"])

    rows = docs.select(common.doc_key(F.col(id_col), F.col(text_col)).alias("doc_key"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    hits = rows.mapInArrow(run, HIT_SCHEMA).join(known, "h").where(F.size("slots") == F.size("islots"))
    aligned = hits.groupBy("doc_key", "doc_id", "item_id", "plain", (F.col("pos") - F.col("ipos")).alias("shift")).agg(
        F.max("windows").alias("windows"), F.collect_set(F.struct("ipos", "places", "islots", "slots")).alias("met"))
    steady = common.map_batches(
        aligned, _judged, "doc_key long, doc_id long, item_id long, plain boolean, windows int, covered array<int>, same boolean")
    found = steady.where(F.size("covered") > 0).groupBy("doc_key", "doc_id", "item_id", "plain").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_windows"),
        F.max(F.size("covered")).alias("longest"),
        F.max("windows").alias("item_windows"), F.every("same").alias("exact"))
    enough = ((F.col("n_windows") >= F.greatest(F.lit(1.0), F.lit(share) * F.col("item_windows")))
              | (F.col("longest") >= passage_windows))
    best = F.max(F.when(enough, F.struct((F.col("n_windows") / F.col("item_windows")).alias("share"), "n_windows", "item_windows")))
    pairs = found.groupBy("doc_key", "doc_id", "item_id").agg(best.alias("best"), F.every("exact").alias("exact"))
    return pairs.where(F.col("best").isNotNull()).select(
        "doc_key", "doc_id", "item_id", "best.n_windows", "exact", "best.item_windows", "best.share")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = findings(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col("doc_key").alias("__bad")).distinct()
    return docs.join(common.staged(bad, "leaks"), common.doc_key(docs[id_col], docs[text_col]) == F.col("__bad"), "left_anti")
