"""Secret scan: fixed patterns, and a character convolutional network over every
further candidate with its surroundings.

A candidate is a maximal run of 12 or more characters of a key's alphabet, or of
any printable ASCII characters (a password's).  The network sees the characters
before it, itself, and those after it; of one longer than its window it sees
windows half a window apart.  A long key counts as a whole by its best window, of
other long runs each window counts for itself.  The network is trained on the
distinct windows of all findings: those whose part overlaps what a pattern found
are secrets, the others are not.  On findings kept back its scores are calibrated, and the
threshold is the highest that keeps the wanted share of the known secrets.
Pattern findings always stay; the network adds the candidates that do not lie
wholly inside one, those that overlap each other as one span.

Defined results: a null or empty text has no spans; spans are in code points,
end exclusive; findings of one kind never overlap; repeated rows are scanned
each for itself; without findings of both sorts no network is trained and the
patterns stand alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common

KINDS = ("assign", "access", "hex", "model")
# fixed patterns of the contract
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEY = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
RUN = re.compile(r"[!-~]{12,}")
BEFORE, HEAD, TAIL, AFTER = 32, 40, 24, 16
BODY = HEAD + TAIL
WINDOW = BEFORE + BODY + AFTER
INSIDE = np.repeat([0.0, 1.0, 0.0], [BEFORE, BODY, AFTER])
LEAST = 8                # findings of each sort, so that a network is trained
MOST_STEPS = 10_000      # of scores, either way
WINDOWS_A_FILE = 20_000  # of those learnt from


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns' findings, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Parts of at most a window's body that cover a run, half a body apart."""
    if end - start <= BODY:
        return [(start, end)]
    return [(at, at + BODY) for at in (*range(start, end - BODY, BODY // 2), end - BODY)]


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, end, first, last)``: a candidate and the part of it that a window shows."""
    out = []
    for m in RUN.finditer(text):
        start, end = m.span()
        keys = [k.span() for k in KEY.finditer(text, start, end)]
        out += [(s, e, a, b) for s, e in keys for a, b in pieces(s, e)]
        if keys != [(start, end)]:
            out += [(a, b, a, b) for a, b in pieces(start, end)]
    return out


def char_class(c: str) -> int:
    """1..36 digits and letters in either case apart, 0 for padding."""
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "f":
        return 2
    if "g" <= c <= "z":
        return 3 + (ord(c) - ord("g")) // 5
    if "A" <= c <= "F":
        return 8
    if "G" <= c <= "Z":
        return 9 + (ord(c) - ord("G")) // 5
    return 14 + "+/_=-:\"' \n.,@".index(c) if c in "+/_=-:\"' \n.,@" else 28 if c.isalpha() else 29


CLASSES = 30


class _Spelling(dict):
    """Code points to characters whose code is the class."""

    def __missing__(self, code: int) -> str:
        self[code] = chr(char_class(chr(code)) if code else 0)
        return self[code]


SPELLING = _Spelling()


def window(text: str, start: int, end: int) -> bytes:
    """Classes of the characters around and in a candidate."""
    body = text[start:end]
    shown = "".join((text[max(0, start - BEFORE):start].rjust(BEFORE, "\0"), body[:HEAD].ljust(HEAD, "\0"),
                     body[max(HEAD, len(body) - TAIL):].rjust(TAIL, "\0"), text[end:end + AFTER].ljust(AFTER, "\0")))
    return shown.translate(SPELLING).encode("latin-1")


def overlaps(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    return any(s < end and start < e for _, s, e in spans)


def inside(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    return any(s <= start and end <= e for _, s, e in spans)


@dataclass
class Network:
    """Embedded classes, one convolution, its maxima over the candidate and over
    the surroundings, one hidden layer, a calibrated output."""
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    recall: float = 0.0  # at the threshold, over the findings kept back
    precision: float = 0.0

    WIDTH = 5

    def forward(self, x: np.ndarray):
        inside = np.zeros(WINDOW, np.float64)
        inside[BEFORE:BEFORE + HEAD + TAIL] = 1
        e = np.concatenate([self.embed[x], np.broadcast_to(inside[None, :, None], (*x.shape, 1))], axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(e, self.WIDTH, axis=1)
        cols = cols.transpose(0, 1, 3, 2).reshape(len(x), -1, self.WIDTH * e.shape[2])
        pre = cols @ self.conv + self.conv_bias
        act = np.maximum(pre, 0)
        mid = np.zeros(act.shape[1], bool)
        mid[BEFORE:BEFORE + HEAD + TAIL - self.WIDTH + 1] = True
        at_in = np.argmax(np.where(mid[None, :, None], act, -1), axis=1)
        at_out = np.argmax(np.where(mid[None, :, None], -1, act), axis=1)
        pooled = np.concatenate([np.take_along_axis(act, a[:, None, :], 1)[:, 0] for a in (at_in, at_out)], axis=1)
        hid = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return hid @ self.out + self.out_bias, (cols, pre, (at_in, at_out), pooled, hid)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The convolution's weights by place; what a class adds at each of its places, two
        classes at two neighbouring ones, and a window's place itself."""
        width, filters = self.WIDTH, self.conv.shape[1]
        by_place = self.conv.reshape(width, -1, filters)
        single = self.embed @ by_place[:, :-1]
        pairs = (single[:-1:2, :, None] + single[1::2, None]).reshape(-1, CLASSES * CLASSES, filters)
        count = WINDOW - width + 1
        bias = sum(INSIDE[k:count + k, None] * by_place[k, -1] for k in range(width)) + self.conv_bias
        return by_place, single, pairs, bias

    def probability(self, windows: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(windows) + self.shift, -35, 35)))

    def scores(self, windows: list[bytes]) -> np.ndarray:
        # what forward() does, by sums over tables: classes in pairs, and the places inside
        width = self.WIDTH
        count = WINDOW - width + 1
        single, pairs, bias = (t.astype(np.float32) for t in self.tables()[1:])
        mid = slice(BEFORE, BEFORE + BODY - width + 1)
        got = [np.zeros(0)]
        for at in range(0, len(windows), 256):
            x = np.frombuffer(b"".join(windows[at:at + 256]), np.uint8).reshape(-1, WINDOW).astype(np.int32)
            two = x[:, :-1] * CLASSES + x[:, 1:]
            pre = single[-1][x[:, width - 1:]] + bias
            for k, table in enumerate(pairs):
                pre += table[two[:, 2 * k:2 * k + count]]
            around = np.maximum(pre[:, :mid.start].max(1), pre[:, mid.stop:].max(1))
            pooled = np.maximum(np.concatenate([pre[:, mid].max(1), around], axis=1), 0).astype(np.float64)
            got.append(np.maximum(pooled @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias)
        return np.concatenate(got)


# places of the convolution inside the candidate, then the others
PLACES = np.arange(WINDOW - Network.WIDTH + 1)
N_MID = BODY - Network.WIDTH + 1
PLACES = np.concatenate([PLACES[BEFORE:BEFORE + N_MID], PLACES[:BEFORE], PLACES[BEFORE + N_MID:]])
LAST_OF = PLACES + Network.WIDTH - 1

PARTS = ("embed", "conv", "conv_bias", "hidden", "hidden_bias", "out", "out_bias")


class Descent:
    """A network with the state of its training (Adam)."""

    def __init__(self, rng: np.random.Generator, filters: int):
        dim = 8
        net = Network(rng.normal(0, 0.3, (CLASSES, dim)), rng.normal(0, 0.15, (Network.WIDTH * (dim + 1), filters)),
                      np.zeros(filters), rng.normal(0, 0.2, (2 * filters, 16)), np.zeros(16), rng.normal(0, 0.2, 16), 0.0)
        self.net = net
        self.shapes = [np.shape(getattr(net, n)) for n in PARTS]
        weights = np.concatenate([np.ravel(getattr(net, n)) for n in PARTS])
        self.take(np.concatenate([weights, np.zeros(2 * len(weights) + 1)]))
        self.room = np.zeros((2, 0))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
        # forward by sums over tables, as ``Network.scores``; back only from the places
        # of the maxima, since no other one has a gradient
        net, width, filters = self.net, Network.WIDTH, self.net.conv.shape[1]
        by_place, single, pairs, bias = net.tables()
        x = np.asarray(x, np.intp)
        two = x[:, :-1] * CLASSES + x[:, 1:]
        if self.room.shape[1:] != (len(x), len(PLACES), filters):
            self.room = np.empty((2, len(x), len(PLACES), filters))
        pre, more = self.room  # no index is out of range, but "raise" would copy
        single[-1].take(x[:, LAST_OF], axis=0, out=pre, mode="clip")
        pre += bias[PLACES]
        for k, table in enumerate(pairs):
            pre += table.take(two[:, PLACES + 2 * k], axis=0, out=more, mode="clip")
        pre = np.ascontiguousarray(pre.transpose(0, 2, 1))
        at = np.concatenate([pre[:, :, :N_MID].argmax(2), pre[:, :, N_MID:].argmax(2) + N_MID], axis=1)
        of_filter = np.tile(np.arange(filters), 2)
        pooled = np.maximum(pre[np.arange(len(x))[:, None], of_filter, at], 0)
        hid = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
        logit = hid @ net.out + net.out_bias

        g = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y) * weight / len(x)
        grad = {"out": hid.T @ g, "out_bias": g.sum()}
        dh = np.outer(g, net.out) * (hid > 0)
        grad |= {"hidden": pooled.T @ dh, "hidden_bias": dh.sum(0)}
        dp = dh @ net.hidden.T * (pooled > 0)
        seen = PLACES[at][:, :, None] + np.arange(width)  # of each maximum: where its characters stand
        cell = (np.arange(width) * CLASSES + x[np.arange(len(x))[:, None, None], seen]) * filters + of_filter[:, None]
        moved = np.repeat(dp.ravel(), width)
        by_class = np.bincount(cell.ravel(), moved, width * CLASSES * filters).reshape(width, CLASSES, filters)
        flagged = (dp[:, :, None] * INSIDE[seen]).sum(0).reshape(2, filters, width).sum(0).T[:, None]
        grad["conv"] = np.concatenate([net.embed.T @ by_class, flagged], axis=1).reshape(net.conv.shape)
        grad["conv_bias"] = dp.sum(0).reshape(2, filters).sum(0)
        grad["embed"] = (by_class @ by_place[:, :-1].transpose(0, 2, 1)).sum(0)
        self.turn += 1
        slope = np.concatenate([np.ravel(grad[n]) for n in PARTS])
        self.mean = 0.9 * self.mean + 0.1 * slope
        self.var = 0.999 * self.var + 0.001 * slope ** 2
        self.set(self.weights - 0.01 * (self.mean / (1 - 0.9 ** self.turn)) / (np.sqrt(self.var / (1 - 0.999 ** self.turn)) + 1e-8))

    def set(self, weights: np.ndarray) -> None:
        self.weights, at = weights, 0
        for n, shape in zip(PARTS, self.shapes, strict=True):
            size = math.prod(shape)
            setattr(self.net, n, weights[at:at + size].reshape(shape) if shape else float(weights[at]))
            at += size

    def numbers(self) -> np.ndarray:
        """All that training changes, in one row."""
        return np.concatenate([self.weights, self.mean, self.var, [self.turn]])

    def take(self, numbers: np.ndarray) -> None:
        weights, self.mean, self.var = np.split(numbers[:-1].copy(), 3)
        self.turn = float(numbers[-1])
        self.set(weights)


def matrix(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)


def fit(windows: list[bytes], y: np.ndarray, recall: float = 0.98, epochs: int = 6, filters: int = 16,
        seed: int = 11) -> Network | None:
    """Train on labelled findings; None unless both sorts are there in numbers."""
    if min(int(y.sum()), int((1 - y).sum())) < LEAST:
        return None
    rng = np.random.default_rng(seed)
    x = matrix(windows)
    descent = Descent(rng, filters)
    net = descent.net
    back = np.zeros(len(y), bool)
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        back[rng.permutation(of)[:max(2, len(of) // 4)]] = True
    learn = np.flatnonzero(~back)
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), 64):
            part = learn[at:at + 64]
            descent.step(x[part], y[part])
    raw = np.concatenate([net.forward(x[back][i:i + 256])[0] for i in range(0, int(back.sum()), 256)])
    net.slope, net.shift = calibrate(raw, y[back])
    p = net.probability([windows[i] for i in np.flatnonzero(back)])
    known = np.sort(p[y[back] == 1])
    net.threshold = float(known[int(np.floor((1 - recall) * len(known)))])
    taken = p >= net.threshold
    net.recall, net.precision = float(taken[y[back] == 1].mean()), float(y[back][taken].mean())
    return net


def fit_all(found: DataFrame, counts: dict[int, int], recall: float = 0.98, epochs: int = 6, filters: int = 16,
            seed: int = 11) -> Network | None:
    """As ``fit``, over a written table ``y, w, back`` of any size: in each epoch every
    task trains on all of its windows, and the next one starts from the mean of the
    tasks' networks by their windows.  Both sorts weigh the same.  Calibration and
    threshold come from all findings kept back, counted by their score (steps of 0.01)."""
    if min(counts.values()) < LEAST:
        return None
    descent = Descent(np.random.default_rng(seed), filters)
    of_sort = np.array([sum(counts.values()) / (2 * counts[y]) for y in (0, 1)])
    learn = found.where("not back").select("y", "w")

    def learned(turn: int):
        start = descent.numbers()

        def run(batches):
            own, rng, n = Descent(np.random.default_rng(seed), filters), np.random.default_rng([seed, turn]), 0
            own.take(start)
            for batch in batches:
                x, y = matrix(batch.column("w").to_pylist()), batch.column("y").to_numpy().astype(np.float64)
                order = rng.permutation(len(y))
                for at in range(0, len(order), 64):
                    part = order[at:at + 64]
                    own.step(x[part], y[part], of_sort[y[part].astype(int)])
                n += len(y)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.numbers().tolist()], pa.list_(pa.float64()))], ["n", "v"])

        each = learn.mapInArrow(run, "n long, v array<double>").select("n", F.posexplode("v").alias("i", "x"))
        mean = each.groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).orderBy("i").collect()
        return np.array([r["x"] for r in mean])

    for turn in range(epochs):
        descent.take(learned(turn))
    net = descent.net

    def counted(batches):
        for batch in batches:
            if batch.num_rows:
                score, y = net.scores(batch.column("w").to_pylist()), batch.column("y").to_numpy().astype(np.int64)
                step = np.clip(np.floor(score * 100), -MOST_STEPS, MOST_STEPS).astype(np.int64)
                (ys, steps), n = np.unique(np.stack([y, step]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ys, steps, n)], ["y", "step", "n"])

    rows = (found.where("back").select("y", "w").mapInArrow(counted, "y long, step long, n long")
            .groupBy("y", "step").agg(F.sum("n").alias("n")).orderBy("step", "y").collect())
    y, step, n = (np.array([r[c] for r in rows], float) for c in ("y", "step", "n"))
    if min(n[y == 1].sum(), n[y == 0].sum()) < 2:
        return None
    slope, net.shift = calibrate((step + 0.5) / 100, y, n=n)
    net.slope = max(slope, 1e-6)
    known = n * (y == 1)
    # the highest step at or above which the wanted share of the known lies
    least = step[np.flatnonzero(np.cumsum(known) > np.floor((1 - recall) * known.sum()))[0]]
    net.threshold = float(1 / (1 + np.exp(-np.clip(net.slope * least / 100 + net.shift, -35, 35))))
    taken = step >= least
    net.recall, net.precision = float(known[taken].sum() / known.sum()), float(known[taken].sum() / n[taken].sum())
    return net


def calibrate(raw: np.ndarray, y: np.ndarray, turns: int = 200, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the labels to the raw scores (``n``: how often each comes)."""
    scale = max(1.0, float(np.abs(raw).max(initial=1.0)))
    a, b = 1.0, 0.0
    n = np.ones(len(y)) if n is None else n
    known, all_of = (n * y).sum(), n.sum()
    target = np.where(y == 1, (known + 1) / (known + 2), 1 / (all_of - known + 2))
    for _ in range(turns):
        g = (1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35))) - target) * (n * len(y) / all_of)
        a -= 0.5 * float((g * raw).mean()) / scale
        b -= 0.5 * float(g.mean())
    return a, b


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``y, w``: the windows of all candidates, 1 for known secrets; most repeats within a task are left out."""
    def run(batches):
        seen: set[tuple[int, bytes]] = set()

        def rows():
            y, w = zip(*seen, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(w, pa.binary())], ["y", "w"])

        for batch in batches:
            for text in common.text_or_empty(batch, "text"):
                found = candidates(text)
                base = base_spans(text) if found else []
                for _, _, a, b in found:
                    seen.add((int(overlaps(a, b, base)), window(text, a, b)))
                    if len(seen) >= 50_000:
                        yield rows()
                        seen.clear()
        if seen:
            yield rows()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "y int, w binary")


def train(docs: DataFrame, at_once: int = 3000, recall: float = 0.98, text_col: str = "text") -> Network | None:
    """Fit on the distinct windows of all known secrets and all other candidates.
    Where neither sort has more than ``at_once``, they are fitted in one go, else by
    Spark jobs over all of them, a quarter (by the window's hash) kept back."""
    common.prepare(docs.sparkSession)
    found = common.staged(labelled(docs, text_col).distinct(), "secrets")
    counts = {0: 0, 1: 0} | {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if max(counts.values()) <= at_once:
        rows = sorted((bytes(r["w"]), r["y"]) for r in found.collect())
        return fit([w for w, _ in rows], np.array([y for _, y in rows], float), recall)
    files = -(-sum(counts.values()) // WINDOWS_A_FILE)
    dealt = found.select("y", "w", (F.pmod(F.xxhash64("w"), F.lit(4)) == 0).alias("back"))
    return fit_all(common.staged(dealt.repartition(files, "w"), "windows"), counts, recall)


def added_spans(network: Network | None, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the network adds to the pattern findings of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if network is None:
        return out
    places, windows = [], []

    def score():
        for (i, s, e), x in zip(places, network.probability(windows), strict=True):
            if x >= network.threshold:
                out[i].append((3, s, e))
        places.clear()
        windows.clear()

    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        for s, e, a, b in candidates(text):
            if not inside(s, e, base):
                places.append((i, s, e))
                windows.append(window(text, a, b))
                if len(windows) >= 4096:
                    score()
    score()
    return [united(spans) for spans in out]


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans of one kind as one."""
    out: list[tuple[int, int, int]] = []
    for k, s, e in sorted(spans, key=lambda x: x[1:]):
        if out and s < out[-1][2]:
            out[-1] = (k, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((k, s, e))
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], s[0])))


def find_secrets(docs: DataFrame, at_once: int = 3000, recall: float = 0.98, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans`` for every row."""
    network = train(docs, at_once, recall, text_col)

    def run(batch: pa.RecordBatch):
        out = []
        texts = common.text_or_empty(batch, "text")
        bases = [base_spans(text) for text in texts]
        for base, more in zip(bases, added_spans(network, texts, bases), strict=True):
            n = [sum(k == kind for k, _, _ in base + more) for kind in range(4)]
            out.append((*n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(base + more)))
        columns = [list(c) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *map(pa.array, columns[4:])],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(
        rows, run, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")


def blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda s: (s[1], s[0])):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, at_once: int = 3000, recall: float = 0.98, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs`` with every secret of the text blanked; a null text stays null."""
    network = train(docs, at_once, recall, text_col)
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        texts = batch.column(place).to_pylist()
        bases = [base_spans(text or "") for text in texts]
        added = added_spans(network, [text or "" for text in texts], bases)
        out = [text and blank(text, base + more) for text, base, more in zip(texts, bases, added, strict=True)]
        columns = list(batch.columns)
        columns[place] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return common.map_batches(docs, run, docs.schema)
