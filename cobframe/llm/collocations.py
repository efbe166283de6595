"""Phrase collocations over a weighted de Bruijn graph of words.

Texts are cut into pieces and words.  A node is a sequence of ``longest - 1``
words, an edge the longer sequence that joins two overlapping nodes; its weight
is how often it stands in the corpus.  Near the end of a piece an edge is
shorter: those are the piece-end corrections.

1. *Words* are counted, then *pairs* of words that are frequent themselves.
   Each gives a Bloom filter of bounded size.  No phrase of ``least``
   occurrences holds a rarer word or pair, so pieces are cut there; a false
   positive of a filter cuts less and changes no count.
2. *Edges* of what is left are summed in the tasks, so that a passage or pair
   that fills the corpus is one entry a task, and dealt to buckets as packed
   arrays by their first two words (pairs that fill it, by all words).
3. *Node flow*: a sequence of k words is followed by a word or ends its piece,
   so its count is the weight of the longer edges that begin with it plus the
   corrections of exactly k words.
4. *Unary paths*: a node whose whole flow leaves along one edge, or comes along
   one, is an inner part of that longer sequence and is folded into it; path
   ends and branches stay as phrases.
5. Phrases are scored by their worst cut with exact decimals, ranked by language.

Words are named by 64-bit hashes until the phrases to report are known.

Defined results: a null text counts as empty, a null language as ``und``;
repeated rows count each; ties go to the phrase that is smaller in UTF-8 bytes;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobframe.llm import common
from cobframe.llm.token_counts import Codes

LONGEST = 5
BUSY = 500                   # a pair with more than one in so many places is spread out
BUCKET_WORDS = 8_000_000     # words of the corpus to a bucket of edges, at most
MOST_LANGUAGES = 100_000     # totals of so many languages may go to every task
BREAK = b"\xff"              # stands for the end of a piece; no byte of UTF-8
SEPARATORS = b".,;:!?\n\x0b\x0c\r"


def byte_table() -> bytes:
    """Lower-cases A-Z, turns tabs into blanks and separators into the break."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    table[ord("\t")] = ord(" ")
    for c in SEPARATORS:
        table[c] = BREAK[0]
    return bytes(table)


TABLE = byte_table()


class Words:
    """Codes of the words a worker has met (0: the break) and their hashes."""

    def __init__(self):
        self.codes = Codes()
        self.hashes = np.zeros(0, np.uint64)
        self.words: list[bytes] = []
        self.read(BREAK)

    def read(self, text: bytes) -> np.ndarray:
        found = text.translate(TABLE).replace(BREAK, b" \xff ").split()
        out = np.fromiter(map(self.codes.__getitem__, found), np.int32, len(found))
        fresh = self.codes.take()
        if fresh:
            made = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))
            self.hashes = np.append(self.hashes, np.maximum(made, np.uint64(1)))
            self.words += fresh
        return out


def units(batches: Iterator[pa.RecordBatch], hold: int = 2_000_000,
          remember: int = 400_000) -> Iterator[tuple[str, np.ndarray, Words]]:
    """A task's texts as word codes, by language, in units of about ``hold``
    words.  The codes of a unit end in a break and belong to the ``Words`` beside."""
    known, held, n = Words(), defaultdict(list), 0
    for batch in batches:
        for part in common.slices(batch, "text"):
            texts = defaultdict(list)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if text:
                    texts[lang].append(text.encode())
            for lang, some in texts.items():
                some.append(b"")
                held[lang].append(known.read(BREAK.join(some)))
                n += len(held[lang][-1])
            if n >= hold or len(known.codes) > remember:
                for lang, codes in held.items():
                    yield lang, np.concatenate(codes), known
                held, n = defaultdict(list), 0
                if len(known.codes) > remember:
                    known = Words()
    for lang, codes in held.items():
        yield lang, np.concatenate(codes), known


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


# ------------------------------------------------------------------ filters

class BitFilter:
    """Bloom filter of 64-bit hashes with two probes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def probe(self, slot: np.ndarray) -> np.ndarray:
        return self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return (self.probe(hashes & self.mask) & self.probe(hashes >> np.uint64(32) & self.mask)).astype(bool)


def bit_filter(hashes: DataFrame, column: str, most_bits: int):
    """A ``BitFilter`` of the column's values, sent to the tasks.  It has at
    most ``most_bits`` bits (a power of two), whatever the number of values."""
    bits = min(most_bits, 1 << max(6, (16 * hashes.count()).bit_length()))
    low, high = (f"({h}) & {bits - 1}L" for h in (column, f"shiftrightunsigned({column}, 32)"))
    rows = (hashes.select(F.explode(F.expr(f"array({low}, {high})")).alias("slot"))
            .selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, cast(slot & 63 AS int)) AS bit")
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(BitFilter(words))


def pair_hash(lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + b
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def frequent_pairs(codes: np.ndarray, known: Words, frequent: np.ndarray):
    """Places whose word and next word are both frequent; the distinct pairs
    there, as codes; which of them each place has."""
    good = frequent[codes]
    at = np.flatnonzero(good[:-1] & good[1:])
    size = len(known.hashes)
    pairs, which = np.unique(codes[at].astype(np.int64) * size + codes[at + 1], return_inverse=True)
    return at, pairs // size, pairs % size, which


# -------------------------------------------------------------------- counts

def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, h, f``: every word's occurrences."""
    def run(batches):
        for lang, codes, known in units(batches):
            n = np.bincount(codes, minlength=1)
            n[0] = 0
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array([known.words[i].decode() for i in at], pa.string()),
                 signed(known.hashes[at]), pa.array(n[at], pa.int64())], ["lang", "word", "h", "f"])
    rows = texts.mapInArrow(run, "lang string, word string, h long, f long")
    return rows.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def pair_counts(texts: DataFrame, words) -> DataFrame:
    """``pair, f``: occurrences of pairs of frequent words by the pair's hash
    (more than the true number where hashes meet, never less)."""
    def run(batches):
        for lang, codes, known in units(batches):
            _, a, b, which = frequent_pairs(codes, known, frequent_words(known, words))
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [signed(pair_hash(lang, known.hashes[a], known.hashes[b])), pa.array(np.bincount(which), pa.int64())],
                    ["pair", "f"])
    return texts.mapInArrow(run, "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f"))


def frequent_words(known: Words, words) -> np.ndarray:
    out = words.value.has(known.hashes)
    out[0] = False
    return out


def edges(texts: DataFrame, words, pairs, busy: list[int], buckets: int) -> DataFrame:
    """The longest sequence that begins at each place, up to ``LONGEST`` words,
    and how often it does: ``bucket, lang, grams, weights``, the sequences of a
    unit that go to one bucket packed into arrays (hash 0: no word).

    Sequences are dealt by their first two words, so that all that flows through
    a node of two words or more meets in one bucket; those that begin with one of
    the ``busy`` pairs are dealt by all their words."""
    hot = np.array(busy, np.int64).view(np.uint64)

    def run(batches):
        for lang, codes, known in units(batches):
            at, a, b, which = frequent_pairs(codes, known, frequent_words(known, words))
            if not len(at):
                continue
            lead = pair_hash(lang, known.hashes[a], known.hashes[b])
            joined = pairs.value.has(lead)[which]
            link = np.zeros(len(codes) + LONGEST, bool)
            link[at] = joined
            at, which = at[joined], which[joined]
            if not len(at):
                continue
            grams = [codes[at]]
            on = np.ones(len(at), bool)
            for k in range(1, LONGEST):
                on &= link[at + k - 1]
                grams.append(np.where(on, codes[np.minimum(at + k, len(codes) - 1)], 0))
            # number the sequences word by word, so that equal numbers are equal sequences
            number, size = grams[0].astype(np.int64), len(known.hashes)
            for g in grams[1:]:
                _, number = np.unique(number * size + g, return_inverse=True)
            _, first, n = np.unique(number, return_index=True, return_counts=True)
            named = known.hashes.copy()
            named[0] = 0
            rows = np.stack([named[g[first]] for g in grams], axis=1)
            deal = lead[which[first]]
            spread = np.isin(deal, hot)
            for g in grams[2:]:
                deal[spread] = pair_hash(lang, deal[spread], named[g[first]][spread])
            bucket = (deal % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, n, bucket = rows[order], n[order].astype(np.int64), bucket[order]
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
            spans = list(zip(begin, [*begin[1:], len(bucket)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[begin]), pa.array([lang] * len(begin), pa.string()),
                 pa.array([rows[i:j].tobytes() for i, j in spans], pa.binary()),
                 pa.array([n[i:j].tobytes() for i, j in spans], pa.binary())], ["bucket", "lang", "grams", "weights"])
    return texts.mapInArrow(run, "bucket long, lang string, grams binary, weights binary")


def node_flows(rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of ``k`` words and what flows through them: all sorted sequences
    that go on beyond them or end there."""
    through = rows[:, k - 1] != 0
    nodes, weights = rows[through, :k], weights[through]
    first = np.flatnonzero(np.append(True, (nodes[1:] != nodes[:-1]).any(axis=1))[:len(nodes)])
    return nodes[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


def flows(packed: DataFrame, least: int, busy: list[int]) -> DataFrame:
    """``lang, k, g, f``: sequences of 2 to ``LONGEST`` words with ``f >= least``,
    ``g`` the words' hashes."""
    hot = np.array(busy, np.int64).view(np.uint64)

    def reduce(table: pa.Table) -> pa.Table:
        out = []
        for lang in table.column("lang").unique().to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang))
            rows = np.frombuffer(b"".join(own.column("grams").to_pylist()), np.uint64).reshape(-1, LONGEST)
            weights = np.frombuffer(b"".join(own.column("weights").to_pylist()), np.int64)
            order = np.lexsort(rows.T[::-1])
            rows, weights = rows[order], weights[order]
            for k in range(LONGEST, 1, -1):
                nodes, f = node_flows(rows, weights, k)
                # only a part of what begins with a busy pair is in this bucket
                keep = (f >= least) | np.isin(pair_hash(lang, nodes[:, 0], nodes[:, 1]), hot)
                nodes, f = nodes[keep], f[keep]
                ends = np.arange(0, k * (len(f) + 1), k, dtype=np.int32)
                out.append(pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(f), pa.string()), pa.array([k] * len(f), pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(nodes).view(np.int64).ravel())),
                     pa.array(f)], ["lang", "k", "g", "f"]))
        return pa.Table.from_batches(out)

    found = packed.groupBy("bucket").applyInArrow(reduce, "lang string, k int, g array<long>, f long")
    return found.groupBy("lang", "k", "g").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def path_ends(grams: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrases`` without those inside a unary path: the whole flow of such a
    sequence goes through a longer one, at either side.

    It is enough to look one word further: between a phrase and any longer one
    that holds it as often lie only sequences with that same count."""
    longer = (grams.where("k > 2")
              .select("lang", "f", F.explode(F.array(F.expr("slice(g, 1, k - 1)"), F.expr("slice(g, 2, k - 1)"))).alias("g"))
              .groupBy("lang", "g").agg(F.max("f").alias("through")))
    return phrases.join(longer, ["lang", "g"], "left").where("through IS NULL OR through < a").drop("through")



def scored(grams: DataFrame, single: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, g, a, l, r, n, score`` of every phrase by its lowest-scoring cut."""
    parts = grams.select("lang", "g", "f").unionByName(single.select("lang", F.array("h").alias("g"), "f"))
    cuts = (grams.select("lang", "g", "k", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
            .withColumn("first", F.expr("slice(g, 1, cut)")).withColumn("rest", F.expr("slice(g, cut + 1, k - cut)")))
    cuts = (cuts.join(parts.select("lang", F.col("g").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(parts.select("lang", F.col("g").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .join(totals, "lang"))
    # thousand times a times n stays under 10^38 for corpora of up to 10^17 words
    ratio = F.expr("(1000BD * cast(a AS decimal(38,0)) * cast(n AS decimal(38,0))) "
                   "div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))")
    return (cuts.withColumn("score", ratio).groupBy("lang", "g", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
            .select("lang", "g", "a", "m.l", "m.r", "n", "m.score"))


def spelled(rows: DataFrame, single: DataFrame) -> DataFrame:
    """``rows`` with ``phrase`` in place of the words' hashes."""
    each = rows.select("*", F.posexplode("g").alias("at", "h")).join(single.select("lang", "h", "word"), ["lang", "h"])
    keys = [c for c in rows.columns if c != "g"]
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return each.groupBy("g", *keys).agg(F.array_join(in_order, " ").alias("phrase")).drop("g")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000,
                 filter_bits: int = 1 << 26) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each
    language, of 2 to 5 words with at least ``least`` occurrences."""
    if filter_bits & (filter_bits - 1) or filter_bits < 64:
        raise ValueError("filter_bits must be a power of two, 64 at least")
    common.prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = common.staged(word_counts(texts), "words")
    single = common.staged(words.where(F.col("f") >= least), "frequent")
    totals = common.staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    if totals.count() <= MOST_LANGUAGES:
        totals = F.broadcast(totals)
    frequent = bit_filter(single, "h", filter_bits)
    pairs = common.staged(pair_counts(texts, frequent).where(F.col("f") >= least), "pairs")
    joined = bit_filter(pairs, "pair", filter_bits)
    n = totals.agg(F.sum("n")).first()[0] or 0
    # fewer than BUSY pairs have more than one in BUSY places
    busy = [r["pair"] for r in pairs.where(F.col("f") * BUSY > n).select("pair").collect()]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_WORDS)
    grams = common.staged(flows(edges(texts, frequent, joined, busy, buckets), least, busy), "grams")
    rows = common.staged(path_ends(grams, scored(grams, single, totals)), "phrases")
    best = [F.col("score").desc(), F.col("a").desc()]
    # the last place's ties are kept until their words are known
    near = rows.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("place") <= top).drop("place")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))
    return (spelled(near, single).withColumn("rank", place).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
