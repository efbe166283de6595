"""Near-duplicates by SimHash with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
read as a word of the perfect (23, 12) Golay code.  Four differing bits leave
two of the three segments with at most two errors between them (pigeonhole), so
a pair of segments has a midpoint that is one flipped bit away from either
side.  Every fingerprint therefore gives, for each pair of segments, the
codeword indices of the segments as they are and with one bit flipped in one of
them (about ten keys a pair); linked fingerprints share a key, and a bucket's
fingerprints are verified by their Hamming distance.

Exact copies fold into one fingerprint before any link is sought.  Inside a
bucket only a spanning forest of the links is emitted, never all pairs.  A
bucket beyond ``bucket_cap`` is dealt over blocks; what its largest component
has not absorbed after the first pass is compared with every block of the
bucket, so no link between components is lost.

Defined results: a null or empty text, or one of white space alone, has
fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; repeated rows are returned once each; a row without doc_id keeps its
fingerprint and takes the smallest doc_id of its component (null if none has
one); other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common

GENERATOR = 0b110001110101  # fixed: generator polynomial of the Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRS = tuple(combinations(range(3), 2))


def _parity() -> np.ndarray:
    """Remainder of ``m * x**11`` for each of the 4096 messages."""
    out = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        out[m] = r
    return out


PARITY = _parity()


def _syndrome(v: np.ndarray) -> np.ndarray:
    return PARITY[v >> 11] ^ (v & 2047)


def _leaders() -> np.ndarray:
    """The one error of at most three bits for each syndrome."""
    out = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            out[_syndrome(np.array([e]))[0]] = e
    return out


LEADERS = _leaders()


def codeword_index(v: np.ndarray) -> np.ndarray:
    """Index (its 12 message bits) of the codeword nearest to each 23-bit word."""
    return (v ^ LEADERS[_syndrome(v)]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every key of every fingerprint (uint64), no key twice a row."""
    segs = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    exact = [codeword_index(s) for s in segs]
    near = []
    for s, (_, n) in zip(segs, SEGMENTS, strict=True):
        flips = s[:, None] ^ np.append(0, 1 << np.arange(n))[None, :]
        near.append(codeword_index(flips))
    blocks = []
    for p, (i, j) in enumerate(PAIRS):
        left = near[i] << 12 | exact[j][:, None]
        right = exact[i][:, None] << 12 | near[j]
        blocks.append(np.concatenate([left, right], axis=1) | p << 24)
    keys = np.sort(np.concatenate(blocks, axis=1), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, at = np.nonzero(fresh)
    return row, keys[row, at].astype(np.int32)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    tokens = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space alone
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(b" ".join(tokens), seed)
    grams = [b" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)]
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning_links(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links among distinct fingerprints:
    breadth first, each visited one compared only with those not yet reached."""
    rest = np.arange(len(prints))
    out: list[tuple[int, int]] = []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            hit = distance(prints[rest], prints[u]) <= max_bits
            if hit.any():
                found = rest[hit].tolist()
                out += [(u, v) for v in found]
                queue += found
                rest = rest[~hit]
    return out


def _small_runs(key: np.ndarray, prints: np.ndarray, size: np.ndarray, most: int, max_bits: int):
    """Links inside the runs of equal keys that have at most ``most`` members, all runs at once."""
    at = np.flatnonzero((size > 1) & (size <= most))
    found = []
    for step in range(1, most):
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        if not len(at):
            break
        hit = at[distance(prints[at], prints[at + step]) <= max_bits]
        found.append((prints[hit], prints[hit + step]))
    return found


def _bucket_links(max_bits: int, small: int = 16):
    """Over rows sorted by bucket: links found within each bucket."""
    def links(bucket: np.ndarray, prints: np.ndarray):
        starts = np.flatnonzero(np.append(True, np.any(bucket[1:] != bucket[:-1], axis=1)))
        lengths = np.diff(np.append(starts, len(prints)))
        run = np.repeat(np.arange(len(starts)), lengths)
        found = _small_runs(run, prints, np.repeat(lengths, lengths), small, max_bits)
        for s, n in zip(starts[lengths > small], lengths[lengths > small], strict=True):
            part = prints[s:s + n]
            pairs = np.array(spanning_links(part, max_bits), np.int64).reshape(-1, 2)
            found.append((part[pairs[:, 0]], part[pairs[:, 1]]))
        a = np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)])
        b = np.concatenate([x for _, x in found] or [np.zeros(0, np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)),
                                           pa.array(np.maximum(a, b).view(np.int64))], ["a", "b"])

    def run(batches):
        held_bucket, held_prints = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            bucket = np.stack([batch.column("key").to_numpy(), batch.column("block").to_numpy()], axis=1).astype(np.int64)
            prints = batch.column("fp").to_numpy().view(np.uint64)
            bucket, prints = np.concatenate([held_bucket, bucket]), np.concatenate([held_prints, prints])
            if not len(prints):
                continue
            last = int(np.argmax(np.all(bucket == bucket[-1], axis=1)))  # where the open bucket begins
            if last:
                yield links(bucket[:last], prints[:last])
            held_bucket, held_prints = bucket[last:], prints[last:]
        if len(held_prints):
            yield links(held_bucket, held_prints)
    return run


def _cross_links(max_bits: int):
    """Links of one block of a large bucket with one block of the rows its
    largest component left over: a forest over labels, not all pairs."""
    def run(group: pa.Table) -> pa.Table:
        over = np.array(group.column("over").to_pylist(), bool)
        prints = group.column("fp").to_numpy().view(np.uint64)
        label = group.column("label").to_numpy()
        members, labels = prints[~over], label[~over]
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x
        out = []
        for p, mine in zip(prints[over], label[over], strict=True):
            hit = distance(members, p) <= max_bits
            for other in np.unique(labels[hit]).tolist():
                a, b = root(int(mine)), root(other)
                if a != b:
                    parent[a] = b
                    out.append((int(mine), other))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def links(prints: DataFrame, max_bits: int = 4, bucket_cap: int = 2048) -> DataFrame:
    """Spanning links ``(a, b)`` of the graph over distinct fingerprints ``fp``
    in which those at most ``max_bits`` apart are joined."""
    if not 0 <= max_bits <= 4:
        raise ValueError("three segments bear four differing bits at most")

    def keyed(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096).column("fp").to_numpy()
            row, key = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(part[row], pa.int64())], ["key", "fp"])

    keys = common.map_batches(prints.select("fp"), keyed, "key int, fp long")
    large = common.staged(keys.groupBy("key").count().where(F.col("count") > bucket_cap)
                          .select("key", F.ceil(F.col("count") / bucket_cap).cast("int").alias("blocks")), "large")
    dealt = keys.join(large, "key", "left").select(
        "key", "fp", F.coalesce(F.pmod(F.xxhash64("fp", "key"), F.col("blocks")), F.lit(0)).cast("int").alias("block"))
    found = common.staged(dealt.repartition("key", "block").sortWithinPartitions("key", "block", "fp")
                          .mapInArrow(_bucket_links(max_bits), "a long, b long").distinct(), "links")
    if large.limit(1).count() == 0:
        return found
    label = common.connected_components(found, "a", "b")
    hot = common.staged(
        keys.join(large, "key").join(label, F.col("fp") == F.col("node"), "left")
        .select("key", "fp", "blocks", F.coalesce("component", "fp").alias("label"),
                F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int").alias("block")), "hot")
    sizes = hot.groupBy("key", "label").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"))
    main = common.staged(main.select("key", F.col("m.label").alias("main"),
                                     F.ceil((F.col("n") - F.col("m.count")) / bucket_cap).cast("int").alias("spans"))
                         .where(F.col("spans") > 0), "main")
    open_rows = hot.join(main, "key")
    over = (open_rows.where(F.col("label") != F.col("main"))
            .withColumn("span", F.pmod(F.xxhash64("key", "fp"), F.col("spans")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", "block", "span", "fp", "label", F.lit(True).alias("over")))
    members = (open_rows.withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1)))
               .select("key", "block", "span", "fp", "label", F.lit(False).alias("over")))
    cross = (over.unionByName(members).groupBy("key", "block", "span")
             .applyInArrow(_cross_links(max_bits), "a long, b long"))
    return found.unionByName(cross)


def components(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text",
               bucket_cap: int = 2048) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, doc_key, fp)`` of every row, and ``(fp, component, component_id)``
    of every fingerprint; ``doc_key`` names a row by its id and text."""
    common.prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        prints = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("doc_key"), pa.array(np.array(prints, np.uint64).view(np.int64))],
            ["doc_id", "doc_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       common.doc_key(F.col(id_col), F.col(text_col)).alias("doc_key"), F.col(text_col).alias("text"))
    printed = common.staged(common.map_batches(rows, run, "doc_id long, doc_key long, fp long"), "prints")
    classes = common.staged(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = common.connected_components(links(classes, max_bits, bucket_cap), "a", "b")
    grouped = classes.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return printed, common.staged(grouped.join(lowest, "component").select("fp", "component", "component_id"), "named")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", bucket_cap: int = 2048) -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id`` for every row."""
    printed, named = components(docs, words, max_bits, id_col, text_col, bucket_cap)
    return printed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text",
                bucket_cap: int = 2048) -> DataFrame:
    """The rows of ``docs``, whole, that stand for their component: of each, the
    row of the smallest doc_id (nulls last), ties by ``doc_key``, once."""
    printed, named = components(docs, words, max_bits, id_col, text_col, bucket_cap)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key"))
    chosen = printed.join(named, "fp").groupBy("component").agg(first["doc_key"].alias("__chosen"))
    chosen = common.staged(chosen.select("__chosen").distinct(), "chosen")
    keyed = docs.withColumn("__key", common.doc_key(F.col(id_col), F.col(text_col)))
    return keyed.join(chosen, F.col("__key") == F.col("__chosen"), "left_semi").dropDuplicates(["__key"]).drop("__key")
