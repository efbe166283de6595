"""Alignment of two tokenizers' tokens, with an associative fragment monoid.

Both tokenizers cover the same bytes.  Offsets where a token of each ends cut
the tokens into groups; all pairs of an A and a B token of one group are linked.

*Tiles.*  Neither tokenizer has a token across a single blank or newline that
stands between two other characters, so a text falls into tiles that are
tokenized for themselves; a worker remembers the tiles it has met.

*Fragments.*  A text of more than ``chunk_chars`` is cut into byte ranges,
mostly inside words, which go to different tasks.  A range yields a fragment:
the tokens that end in it as an open prefix (up to its first common end), closed
groups, and an open suffix (after its last).  Composing two neighbours closes
the group between them; the composition is associative, so fragments are reduced
as a tree, ``FAN`` neighbours at a time.  A range without a common end is all
open.

*Counts.*  A text is tokenized once and leaves a row with its distinct pairs.  An
id pair's count is the number of documents that hold it linked.  Counts of up to
``most_pairs`` pairs go to every task; more go in blocks of A ids, one after the
other.

Defined results: a null or empty text, and one whose tokens do not spell it out,
has no tokens (zeros, empty hash); repeated rows are documents each; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common
from cobframe.llm.token_counts import Codes, byte_symbols

# From a blank or newline between two other characters to the next one.
TILE = re.compile(r"(?:\A\s*|[ \n])\S+(?:(?![ \n]\S)\s+\S*)*|\A\s+\Z")
# Begins with such a blank or newline and does not end in white space: may follow any other one.
PLAIN_TILE = re.compile(r"[ \n](?!\s)(?:.*\S)?", re.DOTALL)
FAN = 8
LARGE_GROUP = 4096       # links of a group beyond it are counted by distinct ids
ROW_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
              "codes array<long>, times array<long>")
ROW_NAMES = [c.split(" ")[0] for c in ROW_SCHEMA.split(", ")]
FRAGMENT_SCHEMA = ("row long, doc_id long, seq long, bad boolean, cut boolean, before_a array<int>, before_b array<int>, "
                   "after_a array<int>, after_b array<int>, n_a long, n_b long, n_groups long, n_links long, groups string, "
                   "codes array<long>, times array<long>")


class Vocabularies:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        chars = byte_symbols()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.size_a, self.size_b = len(self.bytes_a), self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces go across blanks or newlines: texts do not fall into tiles")
        self.blank_b = pieces.index("▁")
        self.width_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.width_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x), np.uint8) for x in (self.bytes_a, self.bytes_b))

    def encode(self, tiles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all tiles by A and by B, one after the other, and how many of
        each tile; none by either where they do not spell it out."""
        plain = [k for k, t in enumerate(tiles) if PLAIN_TILE.fullmatch(t)]
        found = self.encode_run([tiles[k] for k in plain])
        if found is None:  # some tile is not spelt out: each for itself
            plain = []
        if found is not None and len(plain) == len(tiles):
            return found
        parts = [(plain, found)] if plain else []
        parts += [([k], self.encode_run([tiles[k]])) for k in sorted(set(range(len(tiles))) - set(plain))]
        counts = np.zeros((2, len(tiles)), np.int64)
        for rows, got in parts:
            if got is not None:
                counts[:, rows] = got[1], got[3]
        out = []
        for side in (0, 1):
            n = counts[side]
            first, flat = np.cumsum(n) - n, np.zeros(int(n.sum()), np.int64)
            for rows, got in parts:
                if got is not None:
                    ids, of = got[2 * side], n[rows]
                    flat[np.repeat(first[rows] - (np.cumsum(of) - of), of) + np.arange(len(ids))] = ids
            out += [flat, n]
        return tuple(out)

    def encode_run(self, tiles: list[str], run: int = 300):
        """As ``encode``, of tiles that may stand one after the other in a text:
        ``run`` of them are tokenized as one (more at once take longer, each).
        None where that does not spell them out."""
        if not tiles:
            return None
        a, b = [], []
        for at in range(0, len(tiles), run):
            text = "".join(tiles[at:at + run])
            some_a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
            # B puts a blank in front; a text that begins with a newline has none
            some_b = self.b.encode(text[1:] if text[0] == " " else text, num_threads=1)
            if text[0] != " ":
                some_b = some_b[1:] if some_b[:1] == [self.blank_b] else []
            a += some_a
            b += some_b
        raw, a, b = np.frombuffer("".join(tiles).encode(), np.uint8), np.array(a, np.int64), np.array(b, np.int64)
        for ids, width, flat in ((a, self.width_a, self.flat_a), (b, self.width_b, self.flat_b)):
            if not np.array_equal(runs(flat, (np.cumsum(width) - width)[ids], width[ids]), raw):
                return None
        ends = np.cumsum(pc.binary_length(pa.array(tiles, pa.large_string())).to_numpy())
        out = []
        for ids, width in ((a, self.width_a), (b, self.width_b)):
            upto = np.cumsum(width[ids])
            last = np.searchsorted(upto, ends)
            if (upto[last] != ends).any():
                raise ValueError("a token goes across two tiles")
            out += [ids, np.diff(np.concatenate([[0], last + 1]))]
        return tuple(out)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    return np.intersect1d(ends_a, ends_b, assume_unique=True)


def group_links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray,
                size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of groups of ``n_a[g]`` and ``n_b[g]`` consecutive tokens: the
    pair codes, how often each, and the number of codes of every group."""
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    each = n_a * n_b
    large = np.flatnonzero(each > LARGE_GROUP)
    made = {}
    for g in large:
        some_a, times_a = np.unique(a[at_a[g]:at_a[g] + n_a[g]], return_counts=True)
        some_b, times_b = np.unique(b[at_b[g]:at_b[g] + n_b[g]], return_counts=True)
        made[g] = (some_a[:, None] * size_b + some_b).ravel(), (times_a[:, None] * times_b).ravel()
        each[g] = len(made[g][0])
    start = np.cumsum(each) - each
    of = np.repeat(np.arange(len(each)), each)
    place = np.arange(int(each.sum())) - start[of]
    times = np.ones(len(of), np.int64)
    place[np.isin(of, large)] = 0
    codes = a[at_a[of] + place // n_b[of]] * size_b + b[at_b[of] + place % n_b[of]]
    for g, (c, t) in made.items():
        codes[start[g]:start[g] + each[g]], times[start[g]:start[g] + each[g]] = c, t
    return codes, times, each


def spelled(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, upto: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2``: the ids of the groups ``upto[0]`` to ``upto[1]``, and so on."""
    sides = [pc.binary_join(lists(ids, n, pa.int64(), pa.string()), ",") for ids, n in ((a, n_a), (b, n_b))]
    groups = pc.binary_join_element_wise(*sides, "|")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), groups), ";").to_pylist()


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sum of their times."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
    return codes[first], np.add.reduceat(times, first) if len(first) else times[:0]


# --------------------------------------------------------------------- tiles

def runs(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``n`` values from each start, one after the other."""
    return flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Ragged:
    """Rows of different length, appended to."""

    def __init__(self, kind=np.int64):
        self.flat, self.n, self.start = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, n: np.ndarray) -> None:
        self.flat, self.n = np.append(self.flat, flat), np.append(self.n, n)
        self.start = np.cumsum(self.n) - self.n

    def take(self, rows: np.ndarray) -> np.ndarray:
        return runs(self.flat, self.start[rows], self.n[rows])


class Tiles:
    """Tokens, groups and links of the tiles a worker has met, up to a number of
    them, after which it starts afresh."""

    def __init__(self, path_a: str, path_b: str, remember: int = 250_000):
        self.vocabularies = Vocabularies(path_a, path_b)
        self.remember = remember
        self.clear()

    def clear(self) -> None:
        self.codes = Codes()
        self.ids_a, self.ids_b = Ragged(np.int32), Ragged(np.int32)
        self.pairs, self.times = Ragged(), Ragged()
        self.bad = np.zeros(0, bool)
        self.n_groups, self.n_links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.groups: list[str] = []

    def read(self, texts: list[str]) -> list[np.ndarray]:
        """The tiles of every text, as codes; what they are is learnt first."""
        if len(self.codes) > self.remember:
            self.clear()
        found = [TILE.findall(text) for text in texts]
        met = pa.array([t for tiles in found for t in tiles], pa.large_string()).dictionary_encode()
        codes = np.fromiter(map(self.codes.__getitem__, met.dictionary.to_pylist()), np.int64, len(met.dictionary))
        out = np.split(codes[met.indices.to_numpy()], np.cumsum([len(tiles) for tiles in found])[:-1]) if texts else []
        fresh = self.codes.take()
        for at in range(0, len(fresh), 20_000):
            self.learn(fresh[at:at + 20_000])
        return out

    def learn(self, tiles: list[str]) -> None:
        voc = self.vocabularies
        a, len_a, b, len_b = voc.encode(tiles)
        ends_a, ends_b = np.cumsum(voc.width_a[a]), np.cumsum(voc.width_b[b])
        shared = common_ends(ends_a, ends_b)
        n_a = np.bincount(np.searchsorted(shared, ends_a), minlength=len(shared))
        n_b = np.bincount(np.searchsorted(shared, ends_b), minlength=len(shared))
        codes, times, each = group_links(a, b, n_a, n_b, voc.size_b)
        # a tile's last token ends a group, so groups belong to tiles
        total_a = np.concatenate([[0], np.cumsum(n_a)])
        upto = np.searchsorted(total_a, np.concatenate([[0], np.cumsum(len_a)]))
        per_tile = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])
        self.ids_a.add(a.astype(np.int32), len_a)
        self.ids_b.add(b.astype(np.int32), len_b)
        self.pairs.add(codes, per_tile(each))
        self.times.add(times, per_tile(each))
        self.bad = np.append(self.bad, len_a == 0)
        self.n_groups = np.append(self.n_groups, np.diff(upto))
        self.n_links = np.append(self.n_links, per_tile(n_a * n_b))
        self.groups += spelled(a, b, n_a, n_b, upto)


def tiles(path_a: str, path_b: str) -> Tiles:
    return common.remembered(("tiles", path_a, path_b), lambda: Tiles(path_a, path_b))


def by_task(df: DataFrame, fn, schema: str, path_a: str, path_b: str) -> DataFrame:
    """``map_batches`` whose worker keeps the tokenizers, but forgets the tiles
    when a task ends: workers that wait for a next one hold little."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
                pa.default_memory_pool().release_unused()
        tiles(path_a, path_b).clear()
    return df.mapInArrow(run, schema)


def spaced(texts: list[str | None]) -> list[str]:
    """What is tokenized: a blank and the text; nothing for an empty one."""
    return [" " + t if t else "" for t in texts]


# ----------------------------------------------------------------- fragments

@dataclass
class Fragment:
    """A byte range: open prefix, closed groups, open suffix.  Without a common
    end (``cut`` False) everything is in the prefix."""
    bad: bool = False
    cut: bool = False
    before_a: list = field(default_factory=list)
    before_b: list = field(default_factory=list)
    after_a: list = field(default_factory=list)
    after_b: list = field(default_factory=list)
    n_a: int = 0            # tokens of closed groups
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: str = ""
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def closed(a: list[int], b: list[int], size_b: int) -> Fragment:
    """One closed group."""
    codes, times, _ = group_links(np.array(a, np.int64), np.array(b, np.int64), np.array([len(a)]), np.array([len(b)]), size_b)
    return Fragment(False, True, [], [], [], [], len(a), len(b), 1, len(a) * len(b), spelled(a, b, [len(a)], [len(b)], [0, 1])[0],
                    *summed(codes, times))


def fragment(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, size_b: int) -> Fragment:
    """Of the tokens that end in a range."""
    shared = common_ends(ends_a, ends_b)
    if not len(shared):
        return Fragment(before_a=a.tolist(), before_b=b.tolist())
    n_a = np.bincount(np.searchsorted(shared, ends_a), minlength=len(shared) + 1)
    n_b = np.bincount(np.searchsorted(shared, ends_b), minlength=len(shared) + 1)
    i, j = len(a) - n_a[-1], len(b) - n_b[-1]
    out = Fragment(False, True, a[:n_a[0]].tolist(), b[:n_b[0]].tolist(), a[i:].tolist(), b[j:].tolist())
    inner_a, inner_b, n_a, n_b = a[n_a[0]:i], b[n_b[0]:j], n_a[1:-1], n_b[1:-1]
    codes, times, _ = group_links(inner_a, inner_b, n_a, n_b, size_b)
    out.n_a, out.n_b, out.n_groups, out.n_links = len(inner_a), len(inner_b), len(n_a), int((n_a * n_b).sum())
    out.groups = spelled(inner_a, inner_b, n_a, n_b, [0, len(n_a)])[0]
    out.codes, out.times = summed(codes, times)
    return out


def composed(parts: list[Fragment], size_b: int) -> Fragment:
    """Neighbouring fragments, in order, as one.  ``Fragment()`` is neutral."""
    out, inner = Fragment(), []
    for part in parts:
        out.bad |= part.bad
        if not part.cut:
            at_a, at_b = (out.after_a, out.after_b) if out.cut else (out.before_a, out.before_b)
            at_a += part.before_a
            at_b += part.before_b
            continue
        if out.cut:
            a, b = out.after_a + part.before_a, out.after_b + part.before_b
            if a or b:
                inner.append(closed(a, b, size_b))
        else:
            out.before_a, out.before_b, out.cut = out.before_a + part.before_a, out.before_b + part.before_b, True
        inner.append(part)
        out.after_a, out.after_b = list(part.after_a), list(part.after_b)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        setattr(out, name, sum(getattr(x, name) for x in inner))
    out.groups = ";".join(x.groups for x in inner if x.n_groups)
    if inner:
        out.codes, out.times = summed(*(np.concatenate([getattr(x, name) for x in inner]) for name in ("codes", "times")))
    return out


def whole(part: Fragment, size_b: int) -> Fragment:
    """The composition of all of a text's ranges as closed groups only; an
    empty fragment if its tokens do not spell it out."""
    if part.bad or not part.cut:
        return Fragment()
    if part.after_a or part.after_b:
        raise ValueError("a text must end where a token of either ends")
    if not part.before_a:
        return part
    return composed([closed(part.before_a, part.before_b, size_b), replace(part, before_a=[], before_b=[])], size_b)


def ranges(text: str, chunk_chars: int) -> Iterator[tuple[str, int, int]]:
    """The text's ranges: tiles that cover one, the bytes of them before it, its
    bytes.  Ranges end every ``chunk_chars`` characters, in the midst of a word
    or not; only inside a tile longer than that none ends."""
    starts = np.array([m.start() for m in TILE.finditer(text)] + [len(text)])
    cuts = {0, len(text)}
    for at in range(chunk_chars, len(text), chunk_chars):
        k = int(np.searchsorted(starts, at, side="right")) - 1
        cuts.add(at if starts[k + 1] - starts[k] <= chunk_chars else int(starts[k]))
    cuts = sorted(cuts)
    for begin, end in zip(cuts, cuts[1:], strict=False):
        first = int(starts[np.searchsorted(starts, begin, side="right") - 1])
        last = int(starts[np.searchsorted(starts, end)])
        yield text[first:last], len(text[first:begin].encode()), len(text[begin:end].encode())


def range_fragment(known: Tiles, tokens: np.ndarray, skip: int, size: int) -> Fragment:
    voc = known.vocabularies
    if known.bad[tokens].any():
        return Fragment(bad=True)
    kept = []
    for ids, width in ((known.ids_a, voc.width_a), (known.ids_b, voc.width_b)):
        got = ids.take(tokens).astype(np.int64)
        ends = np.cumsum(width[got])
        inside = (ends > skip) & (ends <= skip + size)
        kept.append((got[inside], ends[inside]))
    (a, ends_a), (b, ends_b) = kept
    return fragment(a, b, ends_a, ends_b, voc.size_b)


def fragment_batch(rows: list[tuple], parts: list[Fragment]) -> pa.RecordBatch:
    """``rows``: (row, doc_id, seq) of every fragment."""
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
    kinds = {"bad": pa.bool_(), "cut": pa.bool_(), "groups": pa.string(), "codes": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
    kinds |= {f"{side}_{x}": pa.list_(pa.int32()) for side in ("before", "after") for x in "ab"}
    names = [c.split(" ")[0] for c in FRAGMENT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(
        columns + [pa.array([getattr(p, n) for p in parts], kinds.get(n, pa.int64())) for n in names[3:]], names)


def fragments_of(batch: pa.RecordBatch | pa.Table) -> list[Fragment]:
    rows = batch.select([c.split(" ")[0] for c in FRAGMENT_SCHEMA.split(", ")][3:]).to_pylist()
    return [Fragment(**{**r, "codes": np.array(r["codes"], np.int64), "times": np.array(r["times"], np.int64)}) for r in rows]


def long_texts(docs: DataFrame, path_a: str, path_b: str, chunk_chars: int) -> DataFrame:
    """One whole fragment of every text of more than ``chunk_chars``
    characters, by a tree reduction over its ranges."""
    def split(batch):
        for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            for seq, (cover, skip, size) in enumerate(ranges(" " + text, chunk_chars)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], kind) for x, kind in ((row, pa.int64()), (doc_id, pa.int64()), (seq, pa.int64()),
                                                         (cover, pa.string()), (skip, pa.int64()), (size, pa.int64()))],
                    ["row", "doc_id", "seq", "cover", "skip", "size"])

    def leaves(batch):
        for part in common.slices(batch, "cover"):
            known = tiles(path_a, path_b)
            rows = list(zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "seq", "skip", "size")), strict=True))
            read = known.read(part.column("cover").to_pylist())
            yield fragment_batch(rows, [range_fragment(known, t, r[3], r[4]) for r, t in zip(rows, read, strict=True)])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        size_b = tiles(path_a, path_b).vocabularies.size_b
        row, doc_id, seq = (table.column(c)[0].as_py() for c in ("row", "doc_id", "seq"))
        return pa.Table.from_batches([fragment_batch([(row, doc_id, seq // FAN)], [composed(fragments_of(table), size_b)])])

    rows = docs.where(F.char_length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id())
    chunks = common.staged(common.map_batches(rows, split, "row long, doc_id long, seq long, cover string, skip long, size long"),
                           "chunks")
    # from here on the ranges of one text lie in as many tasks as there are
    parts = common.staged(by_task(chunks.repartition(F.xxhash64("row", "seq")), leaves, FRAGMENT_SCHEMA, path_a, path_b), "fragments")
    most = parts.agg(F.max("seq")).first()[0] or 0
    while most:
        parts = common.staged(parts.groupBy("row", F.floor(F.col("seq") / FAN)).applyInArrow(join, FRAGMENT_SCHEMA), "fragments")
        most //= FAN

    def close(batch):
        size_b = tiles(path_a, path_b).vocabularies.size_b
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "seq")), strict=True))
        yield fragment_batch(rows, [whole(x, size_b) for x in fragments_of(batch)])
    return common.map_batches(parts, close, FRAGMENT_SCHEMA)


# -------------------------------------------------------------------- counts

class Counts:
    """Documents that hold a pair linked, of a range of A ids or all."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray, size_b: int):
        order = np.argsort(codes)
        self.codes, self.docs = codes[order], docs[order]
        of_a = self.codes // size_b
        first = np.flatnonzero(np.append(True, of_a[1:] != of_a[:-1])[:len(of_a)])
        most = np.maximum.reduceat(self.docs, first) if len(first) else self.docs
        self.best = self.docs == np.repeat(most, np.diff(np.append(first, len(of_a))))

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair, and whether it is its A id's highest; zeros for pairs of other A ids."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        return np.where(hit, self.docs[at], 0), (self.best[at] & hit).astype(np.int64)


def lists(flat: np.ndarray, n: np.ndarray, kind, shown=None) -> pa.Array:
    """Lists of ``n`` values each, as values of ``shown``."""
    values = pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), values if shown is None else values.cast(shown))


def aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Texts that are not cut: their digests, and their distinct pairs with how
    often each is linked."""
    def run(batch):
        for part in common.slices(batch, "text", 1_000_000):
            known = tiles(path_a, path_b)
            span = known.vocabularies.size_a * known.vocabularies.size_b
            read = known.read(spaced(part.column("text").to_pylist()))
            read = [t if len(t) and not known.bad[t].any() else t[:0] for t in read]
            every, ends = np.concatenate([*read, np.zeros(0, np.int64)]), np.cumsum([len(t) for t in read])
            of_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(0, ends)])
            sums = [of_text(x[every]) for x in (known.ids_a.n, known.ids_b.n, known.n_groups, known.n_links)]
            each = of_text(known.pairs.n[every])
            keys, times = summed(np.repeat(np.arange(len(read)), each) * span + known.pairs.take(every), known.times.take(every))
            look = known.groups.__getitem__
            shas = [hashlib.sha256(";".join(map(look, t.tolist())).encode()).hexdigest() if len(t) else "" for t in read]
            zeros = pa.array(np.zeros(len(read), np.int64))
            distinct = np.bincount(keys // span, minlength=len(read))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, sums), zeros, zeros, pa.array(shas, pa.string()),
                 lists(keys % span, distinct, pa.int64()), lists(times, distinct, pa.int64())], ROW_NAMES)
    return by_task(texts, run, ROW_SCHEMA, path_a, path_b)


def digested(parts: DataFrame) -> DataFrame:
    """Whole fragments as rows of that form."""
    none = F.lit(0).cast("long")
    return parts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none.alias("n_best"), none.alias("count_sum"),
                        F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "codes", "times")


def pair_counts(rows: DataFrame, hold: int = 4_000_000) -> DataFrame:
    """``code, docs`` over all rows, summed in the tasks first."""
    def run(batches):
        held, n = [], 0

        def out():
            codes, docs = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return codes, docs

        def given(codes, docs):
            for at in range(0, len(codes), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at:at + 200_000]), pa.array(docs[at:at + 200_000])], ["code", "docs"])

        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy()
            held.append((codes, np.ones(len(codes), np.int64)))
            n += len(codes)
            if n > hold:
                held.append(out())
                n = len(held[0][0])
                if n > hold // 2:
                    yield from given(*held.pop())
                    n = 0
        if held:
            yield from given(*out())
    return rows.select("codes").mapInArrow(run, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))


def add_counts(rows: DataFrame, counts) -> DataFrame:
    """Adds what these counts say of the rows' own pairs."""
    def run(batch):
        times = batch.column("times").flatten().to_numpy()
        docs, best = counts.value.look_up(batch.column("codes").flatten().to_numpy())
        upto = np.append(0, np.cumsum(pc.list_value_length(batch.column("codes")).to_numpy()))
        for name, x in (("n_best", best), ("count_sum", docs)):
            more = np.diff(np.concatenate([[0], np.cumsum(x * times)])[upto])
            batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(batch.column(name).to_numpy() + more))
        yield batch
    return common.map_batches(rows, run, ROW_SCHEMA)


def blocks(pairs: DataFrame, size_b: int, most_pairs: int) -> Iterator[tuple]:
    """Counts of ranges of A ids, each of up to ``most_pairs`` pairs (of one A
    id at least, which has no more pairs than B has ids), sent to the tasks."""
    of_a = F.floor(F.col("code") / size_b)
    sizes = pairs.groupBy(of_a.alias("a")).count().orderBy("a").toArrow()  # as many rows as A has ids at most
    bounds, n = [], 0
    for a, size in zip(sizes.column("a").to_pylist(), sizes.column("count").to_pylist(), strict=True):
        if not bounds or n + size > most_pairs:
            bounds.append([a, a])
            n = 0
        bounds[-1][1] = a
        n += size
    bounds = bounds or [[0, 0]]
    for low, high in bounds:
        got = pairs.where((F.col("code") >= low * size_b) & (F.col("code") < (high + 1) * size_b)).toArrow()
        made = Counts(got.column("code").to_numpy(), got.column("docs").to_numpy(), size_b)
        yield [low, high] == bounds[-1], pairs.sparkSession.sparkContext.broadcast(made)


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
               chunk_chars: int = 32_768, most_pairs: int = 4_000_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of every row.  ``path_a``, ``path_b``: files that every executor has."""
    common.prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    short = texts.where(F.coalesce(F.char_length("text") <= chunk_chars, F.lit(True)))
    rows = common.staged(aligned(short, path_a, path_b).unionByName(
        digested(long_texts(texts, path_a, path_b, chunk_chars))), "aligned")
    pairs = common.staged(pair_counts(rows), "pairs")
    for last, counts in blocks(pairs, Vocabularies(path_a, path_b).size_b, most_pairs):
        rows = add_counts(rows, counts)
        if not last:
            rows = common.staged(rows, "counted")
    return rows.drop("codes", "times")
