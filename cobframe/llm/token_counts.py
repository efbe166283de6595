"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one flat numpy array of symbols with
the start of each sequence.  One round finds every sequence's lowest-rank
adjacent pair and merges all its occurrences in all sequences at once; finished
sequences leave the arrays.  The surviving symbols are the tokens.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty text
has no tokens; repeated rows are counted each for itself; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common

# Characters on which the pre-tokenizers of Python's re and of the tokenizer
# library agree; a text with any other goes through the library's own splitter.
SAFE = re.compile("[\t\n\r\x20-\x7e¡-©«¬®-±´¶-¸»"
                  "¿-ÿŒœ‘-„–—…€]*")
# fixed pattern of the vocabulary, for safe characters
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
NEVER = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class MergeTable:
    """Pair -> (rank, merged symbol), as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.chars = byte_symbols()
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in self.chars.items():
            self.byte_id[b] = vocab[ch]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.made = code[order], order.astype(np.int32), made[order]

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
        hit = self.code[at] == want
        return np.where(hit, self.rank[at], NEVER).astype(np.int32), at


def count_symbols(table: MergeTable, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tokens of every sequence.  ``flat``: initial symbols, ``starts``: where
    each (non-empty) sequence begins in it."""
    n_seq = len(starts)
    out = np.zeros(n_seq, np.int64)
    if not n_seq:
        return out
    sym = flat.astype(np.int64)
    ids = np.arange(n_seq)
    lengths = np.diff(np.append(starts, len(sym)))
    rank = np.full(len(sym), NEVER, np.int32)  # of the pair that begins at each place
    fresh = np.arange(len(sym) - 1)
    while True:
        ends = starts + lengths - 1
        if len(fresh):
            rank[fresh], _ = table.look_up(sym[fresh], sym[fresh + 1])
        rank[ends] = NEVER
        low = np.minimum.reduceat(rank, starts)
        over = low == NEVER
        if over.any():
            out[ids[over]] = lengths[over]
            if over.all():
                return out
            keep = np.repeat(~over, lengths)
            sym, rank = sym[keep], rank[keep]
            ids, lengths, low = ids[~over], lengths[~over], low[~over]
            starts = np.cumsum(lengths) - lengths
        hit = np.flatnonzero(rank == np.repeat(low, lengths))
        # in a run of overlapping equal pairs, every second one from the left
        first = np.ones(len(hit), bool)
        first[1:] = np.diff(hit) != 1
        run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        _, at = table.look_up(sym[hit], sym[hit + 1])
        sym[hit] = table.made[at]
        alive = np.ones(len(sym), bool)
        alive[hit + 1] = False
        seq = np.searchsorted(starts, hit, side="right") - 1
        lengths = lengths - np.bincount(seq, minlength=len(lengths))
        moved = np.cumsum(alive) - 1
        sym, rank = sym[alive], rank[alive]
        starts = np.cumsum(lengths) - lengths
        place = moved[hit]
        touched = np.zeros(len(sym), bool)
        touched[place] = True
        touched[np.maximum(place - 1, 0)] = True
        fresh = np.flatnonzero(touched[:-1])


class Codes(dict):
    """Numbers words in the order they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code

    def take(self) -> list[str]:
        """The words numbered since the last call."""
        out, self.fresh = self.fresh, []
        return out


class Counter:
    """Counts tokens of texts; remembers the counts of pre-tokens seen, up to a
    fixed number of them, after which it starts afresh."""

    def __init__(self, path: str, remember: int = 500_000):
        from tokenizers import Tokenizer
        self.table = MergeTable(path)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.seen = Codes()
        self.counts = np.zeros(0, np.int64)
        self.remember = remember
        special = self.table.special
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if SAFE.fullmatch(text):
            return SPLIT.findall(text)
        chars = self.table.chars
        raw = (bytes(map(chars.__getitem__, w)) for w, _ in self.library.pre_tokenize_str(text))
        return [w.decode("utf-8", "surrogateescape") for w in raw]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.seen) > self.remember:
            self.seen, self.counts = Codes(), np.zeros(0, np.int64)
        words: list[str] = []
        ends, extra = [], []
        for text in texts:
            specials = 0
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                specials = len(parts) - 1
                for part in parts:
                    words += self.pieces(part)
            else:
                words += self.pieces(text)
            ends.append(len(words))
            extra.append(specials)
        codes = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        fresh = self.seen.take()
        if fresh:
            raw = [w.encode("utf-8", "surrogateescape") for w in fresh]
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            flat = self.table.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            self.counts = np.append(self.counts, count_symbols(self.table, flat, np.cumsum(lengths) - lengths))
        total = np.concatenate([[0], np.cumsum(self.counts[codes])])
        ends = np.array(ends, np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return (total[ends] - total[begins] + np.array(extra, np.int64)).tolist()


def counter(path: str) -> Counter:
    return common.remembered(("counts", path), lambda: Counter(path))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``vocabulary``: path of a byte-level BPE file that every executor has.
    """
    common.prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        for part in common.slices(batch, "text"):
            texts = common.text_or_empty(part, "text")
            n = counter(vocabulary).count(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
