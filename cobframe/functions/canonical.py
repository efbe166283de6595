"""Canonical JSON form and the v1 content hash of a snapshot document.

Rule (version ``sha256-v1``): the document is every snapshot field except
``data_hash``; object keys sorted at every level; floats rounded to 10
decimals and printed the way Python prints them; lists in order; compact
separators; non-ASCII escaped.  NaN / Inf are not allowed.

Spark's own JSON writer prints doubles differently (``1.0E7``), so the text
is re-rendered in Python: headers and trades where they lie, before the
shuffle by snapshot, so a large snapshot's trades are rendered by many tasks.
The keyed stage streams the texts of key-sorted partitions into SHA-256; a
snapshot's trades are never gathered into one array or one pandas frame.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
from collections.abc import Iterator
from json.encoder import encode_basestring_ascii as _quote

import pandas as pd

from cobframe.schema import HASH_PREFIX, HASH_ROUND_DIGITS, KEY


def _rounded_float(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"Non-finite float in snapshot: {text}")
    return round(value, HASH_ROUND_DIGITS)


def _no_constant(text: str):
    raise ValueError(f"Non-finite float in snapshot: {text}")


def loads_rounded(text: str):
    """``json.loads`` that rounds every float while parsing (integers stay
    integers), so parsed text needs no second walk before canonical dumping."""
    return json.loads(text, parse_float=_rounded_float, parse_constant=_no_constant)


def _dumps(obj) -> str:
    return json.dumps(obj, sort_keys=True, separators=(",", ":"))


def header_prefix_parts(counterparty_id: str, netting_set_id: str, cob_date, agreement_json: str,
                        market_text: str) -> str:
    """Canonical text of a document up to and including ``"trades":[``, from
    the key, the agreement's JSON and the (already canonical) market-data text.

    ``trades`` sorts after every other top-level key, so the document is this
    text, the trade texts joined by commas, and ``]}``."""
    agreement = loads_rounded(agreement_json) if agreement_json else None
    if agreement is not None:
        extra = agreement.get("extra")
        agreement["extra"] = loads_rounded(extra) if extra else {}
    d = cob_date.isoformat() if cob_date is not None else None
    return ('{"agreement":' + _dumps(agreement) + ',"cob_date":' + _text(d)
            + ',"counterparty_id":' + _text(counterparty_id) + ',"market_data":' + market_text
            + ',"netting_set_id":' + _text(netting_set_id) + ',"trades":[')



def _number(x) -> str:
    if x is None:
        return "null"
    x = float(x)
    if not math.isfinite(x):
        raise ValueError(f"Non-finite float in snapshot: {x}")
    return repr(round(x, HASH_ROUND_DIGITS))


def _text(s) -> str:
    return "null" if s is None else _quote(s)


def trade_text_from_fields(trade_id, product_type, notional, currency, maturity_date,
                           direction, extra, extra_cache: TextCache) -> str:
    """Canonical text of one trade straight from its typed fields (keys in
    sorted order: currency, direction, extra, maturity_date, notional,
    product_type, trade_id)."""
    canon_extra = extra_cache.get(extra, lambda e: _dumps(loads_rounded(e) if e else {}))
    if maturity_date is None or (isinstance(maturity_date, float) and math.isnan(maturity_date)):
        mdate = "null"
    else:
        d = maturity_date.date() if isinstance(maturity_date, dt.datetime) else maturity_date
        mdate = '"' + d.isoformat() + '"'
    return ('{"currency":' + _text(currency) + ',"direction":' + _text(direction)
            + ',"extra":' + canon_extra + ',"maturity_date":' + mdate
            + ',"notional":' + _number(notional) + ',"product_type":' + _text(product_type)
            + ',"trade_id":' + _text(trade_id) + "}")


TRADE_PART_FIELDS = ["trade_id", "product_type", "notional", "currency", "maturity_date", "direction",
                     "extra"]


class TextCache:
    """Remembers rendered texts up to a number of characters, then starts afresh."""

    def __init__(self, most_chars: int = 32_000_000):
        self.most, self.held, self.texts = most_chars, 0, {}

    def get(self, key, render):
        text = self.texts.get(key)
        if text is None:
            text = render(key)
            size = len(text) + len(key or "")
            if self.held + size > self.most:
                self.texts, self.held = {}, 0
            self.texts[key] = text
            self.held += size
        return text


def render_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body: key, ``doc`` (Spark JSON of the agreement) and
    ``market`` (of the market data, shared by a date's snapshots) -> key, ``text``."""
    cache = TextCache()
    for pdf in batches:
        out = pdf[KEY].copy()
        out["text"] = [header_prefix_parts(*key, doc, cache.get(market, lambda m: _dumps(loads_rounded(m)) if m else "null"))
                       for *key, doc, market in pdf[[*KEY, "doc", "market"]].itertuples(index=False, name=None)]
        yield out


def render_trades(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body: typed trade fields -> key, order columns, ``text``."""
    cache = TextCache()
    for pdf in batches:
        out = pdf[[*KEY, "position", "trade_id"]].copy()
        columns = zip(*(pdf[c].tolist() for c in TRADE_PART_FIELDS), strict=True)
        out["text"] = [trade_text_from_fields(*fields, cache) for fields in columns]
        yield out


def stream_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body.  Input: key columns, ``part`` (0 = header, 1 = trade)
    and the rendered ``text``, sorted by key, part and trade order within each
    partition.  Output: one row per key.  Only feeds bytes to the digest.
    """
    current = digest = None
    n_trades = 0
    for pdf in batches:
        out = []
        for *key, part, text in pdf[[*KEY, "part", "text"]].itertuples(index=False, name=None):
            if key != current:
                if current is not None:
                    digest.update(b"]}")
                    out.append((*current, HASH_PREFIX + digest.hexdigest()))
                current, digest, n_trades = key, hashlib.sha256(), 0
            if part and n_trades:
                digest.update(b",")
            n_trades += part
            digest.update(text.encode())
        if out:
            yield pd.DataFrame(out, columns=[*KEY, "data_hash"])
    if current is not None:
        digest.update(b"]}")
        yield pd.DataFrame([(*current, HASH_PREFIX + digest.hexdigest())], columns=[*KEY, "data_hash"])
