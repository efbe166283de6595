"""Packing by first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenized where they lie; only ``(doc_id, start, length, crc)``
moves.  A document longer than a sequence gives full pieces, each a sequence of
its own, and a rest.  The rests are dealt at random into groups of bounded
size, and every group is packed for itself: longest first, each into the
leftmost bin that still holds it, found by descending a tree of maxima.

Defined results: a null or empty text is the closing id alone; equal lengths
are placed by doc_id (nulls first), then start, then checksum; repeated rows are
packed each for itself (an equal row's group is salted by its place in its
partition); other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common
from cobframe.llm.token_counts import SAFE, Codes

# fixed pattern of the vocabulary after lower-casing, for safe characters
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                 "offset long, sequence_tokens long, padding long")


class Encoder:
    """Ids of whole texts.  A word's ids do not depend on its neighbours, so each
    distinct word goes through the tokenizer library once; a text with characters
    outside the safe set goes through the library as it is.  No word goes across
    white space: texts are split there, and each distinct part is split into words once."""

    def __init__(self, path: str, remember: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers
        self.library, self.of_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # lower-cased safe words are as the normalizer and the pattern leave them: blanks alone part them
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.remember = remember
        self.clear()

    def clear(self) -> None:
        self.seen = Codes()
        self.flat = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.parts = pa.array([], pa.large_string())
        self.part_flat = np.zeros(0, np.uint32)
        self.part_lengths, self.part_starts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str], run: int = 500) -> None:
        """Many words as one text: between blanks, each is one pre-token."""
        flat, lengths = [self.flat], [self.lengths]
        for at in range(0, len(words), run):
            part = words[at:at + run]
            e = self.of_words.encode(" ".join(part), add_special_tokens=False)
            flat.append(np.array(e.ids, np.uint32))
            lengths.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
            if len(lengths[-1]) != len(part):
                raise ValueError("a word is more than one pre-token")
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of distinct parts stand; those not met before are learnt."""
        known = pc.index_in(parts, value_set=self.parts)
        fresh = parts.filter(pc.is_null(known))
        words = [WORDS.findall(p) for p in fresh.to_pylist()]
        n_words, look = np.fromiter(map(len, words), np.int64, len(words)), self.seen.__getitem__
        codes = np.fromiter((look(w) for of in words for w in of), np.int64, int(n_words.sum()))
        self.learn(self.seen.take())
        at = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.parts) + np.arange(len(fresh))
        self.parts = pa.concat_arrays([self.parts, fresh])
        self.part_flat = np.append(self.part_flat, joined(self.flat, self.starts[codes], self.lengths[codes]))
        self.part_lengths = np.append(self.part_lengths, summed_runs(self.lengths[codes], n_words))
        self.part_starts = np.cumsum(self.part_lengths) - self.part_lengths
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if max(len(self.seen), len(self.parts) // 2) > self.remember:
            self.clear()
        safe = ["<|" not in t and SAFE.fullmatch(t) is not None for t in texts]
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t, s in zip(texts, safe, strict=True) if s], pa.large_string()))
        parts = split.flatten().dictionary_encode()
        at = self.places(parts.dictionary)[parts.indices.to_numpy()]
        n_of = self.part_lengths[at]
        ids = joined(self.part_flat, self.part_starts[at], n_of)
        ends = np.cumsum(summed_runs(n_of, pc.list_value_length(split).to_numpy()))
        known = iter(np.split(ids, ends[:-1]) if len(ends) else [])
        return [next(known) if s else np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                for t, s in zip(texts, safe, strict=True)]


def joined(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after the other."""
    first = np.cumsum(n) - n
    return flat[np.repeat(starts - first, n) + np.arange(int(n.sum()))]


def summed_runs(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``n[0]``, then ``n[1]``, ... values."""
    return np.diff(np.append(0, np.cumsum(x))[np.append(0, np.cumsum(n))])


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return common.remembered(("ids", path), lambda: Encoder(path))


class Bins:
    """Tournament tree: a leaf is a bin's free room, an inner node the most below it."""

    def __init__(self, capacity: int, count: int):
        self.width = 1
        while self.width < max(1, count):
            self.width *= 2
        self.tree = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """The leftmost bin with room for ``size``, which it then holds."""
        tree, node = self.tree, 1
        while node < self.width:
            node *= 2
            if tree[node] < size:
                node += 1
        tree[node] -= size
        at = node - self.width
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a > b else b
        return at


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; ties keep the given order."""
    bins = Bins(capacity, len(lengths))
    used: dict[int, int] = {}
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = bins.place(lengths[i])
        where[i], offset[i] = b, used.get(b, 0)
        used[b] = offset[i] + lengths[i]
    return where, offset


def padding(tokens: int, capacity: int) -> int:
    """A sequence is filled up to the capacity unless its length is a power of two."""
    return 0 if tokens & (tokens - 1) == 0 else capacity - tokens


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, closing: int = 2,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces of at most ``capacity`` ids, with their checksums."""
    common.prepare(docs.sparkSession)

    def run(batches):
        context = TaskContext.get()
        serial = 0
        part_id = context.partitionId() if context else 0
        for batch in batches:
            for part in common.slices(batch, "text", 4_000_000):
                rows = []
                ids = encoder(vocabulary).encode(common.text_or_empty(part, "text"))
                for doc, body in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                    body = np.append(body, np.uint32(closing)).astype("<u4")
                    for at in range(0, len(body), capacity):
                        cut = body[at:at + capacity]
                        rows.append((doc, at, len(cut), zlib.crc32(cut.tobytes()), len(body), (part_id << 33) + serial))
                        serial += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, closing: int = 2,
         group_pieces: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens, padding``.

    ``group_pieces``: pieces that one group holds on average; groups are dealt
    by a hash, so their number follows the corpus and their size does not.
    """
    cut = common.staged(pieces(docs, vocabulary, capacity, closing, id_col, text_col), "pieces")
    total = cut.count()
    groups = max(1, -(-total // group_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"),
                               ("salt", "ascending")])
        lengths = group.column("length").to_pylist()
        where, offset = first_fit_decreasing(lengths, capacity)
        held: dict[int, int] = {}
        for b, n in zip(where, lengths, strict=True):
            held[b] = held.get(b, 0) + n
        first = group.column("grp")[0].as_py() << 32
        columns = [group.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        columns += [pa.array([first + b for b in where], pa.int64()), pa.array(offset, pa.int64()),
                    pa.array([held[b] for b in where], pa.int64()),
                    pa.array([padding(held[b], capacity) for b in where], pa.int64())]
        return pa.Table.from_arrays(columns, [c.split(" ")[0] for c in PACKED_SCHEMA.split(", ")])

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("salt", "doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(run, PACKED_SCHEMA)
