"""Canonical JSON texts as column expressions (the JVM form of ``canonical``).

Each function gives the text the ``sha256-v1`` rule asks for, or NULL where the
expression cannot prove it has the right one; such values go to the Python
renderer.  What is proven:

*Numbers.*  ``cast(x as string)`` spells a decimal that reads back as ``x``.
Rounded to 10 decimals it equals the rounding of ``x``'s exact value unless it
lies (about) half-way.  Whole numbers of up to 15 digits are their integer and ``.0``.  If what remains has at most 15 significant digits, no
shorter decimal reads back as the same double, so these digits are the shortest
spelling; they are laid out as Python does (exponents under 1e-4).

*Strings* of printable ASCII without quote and backslash stand for themselves.

*Objects* (``extra``): flat ones whose values are such strings, integers, short
decimals, ``true``, ``false`` or ``null``, and whose keys ascend, are canonical
once blanks outside strings are gone.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from cobframe.schema import AGREEMENT_FIELDS, HASH_ROUND_DIGITS, TRADE_FIELDS

FIRST_DAY, LAST_DAY = dt.date(1000, 1, 1), dt.date(9999, 12, 31)
DIGITS = 15                    # decimals of so many digits are told apart by a double
SMALLEST_PLAIN = Decimal("0.0001")   # smaller numbers are written with an exponent
PLAIN_STRING = r'[ !#-\[\]-~]*'
INTEGER = r'(?:0|-?[1-9][0-9]*)'
DECIMAL = r'-?(?!0\.0000[0-9])(?:0|[1-9][0-9]{0,4})\.(?:0|[0-9]{0,9}[1-9])'
VALUE = f'(?:"{PLAIN_STRING}"|{DECIMAL}|{INTEGER}|true|false|null)'
FLAT_OBJECT = rf'\A\{{"{PLAIN_STRING}":{VALUE}(?:,"{PLAIN_STRING}":{VALUE})*\}}\z'
BLANKS = r'("[^"\\]*")|[ \t\r\n]+'
# one member, no blank outside a string: as tight as it gets, and its keys ascend
ONE_MEMBER = rf'\A\{{"{PLAIN_STRING}":{VALUE}\}}\z'
# a double's own spelling without exponent, of at most ten decimals, the last not 0
SHORT_NUMBER = r'\A[0-9]+\.[0-9]{0,9}[1-9]\z'


def once(value: Column, use) -> Column:
    """``use(value)``, the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def number_text(x: Column) -> Column:
    # few and small terms: they stand once for every number of a document
    exact = F.abs(x).cast("string").try_cast("decimal(38,20)")
    kept = F.round(exact, HASH_ROUND_DIGITS)
    # from 1e-4 on a decimal is spelled without exponent, with all its places
    plain = F.regexp_replace(kept.cast("string"), r"(\.[0-9]+?)0*$", "$1")
    units = (kept * F.lit(10 ** HASH_ROUND_DIGITS)).cast("int").cast("string")
    tiny = F.concat(F.regexp_replace(F.regexp_replace(units, r"^([0-9])([0-9]*?)0*$", "$1.$2"), r"\.$", ""),
                    F.lit("e-"), F.lpad((HASH_ROUND_DIGITS + 1 - F.length(units)).cast("string"), 2, "0"))
    body = F.when(kept >= F.lit(SMALLEST_PLAIN), plain).when(kept == 0, "0.0").otherwise(tiny)
    rest = F.abs(exact - kept).cast("double")
    half_way = (rest != 0) & (F.abs(rest - 5e-11) <= F.abs(x) * 1e-15 + 1e-20)
    proven = ~half_way & (F.abs(x) < 1e15) & (F.length(plain) <= DIGITS + 1)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    # a whole number of at most 15 digits is spelled by its integer, without decimals and patterns
    integer = F.abs(x).try_cast("long")
    whole = (F.abs(x) < 1e15) & (integer.cast("double") == F.abs(x))
    # no rounding and no trailing zeros: the double's own spelling is what the decimals below would give
    own = F.abs(x).cast("string")
    short = (F.length(own) <= DIGITS + 1) & own.rlike(SHORT_NUMBER)
    return (F.when(x.isNull(), "null").when(whole, F.concat(sign, integer.cast("string"), F.lit(".0")))
            .when(short, x.cast("string"))
            .when(proven, F.concat(sign, body)))


def string_text(s: Column) -> Column:
    return F.when(s.isNull(), "null").when(s.rlike(rf"\A{PLAIN_STRING}\z"), F.concat(F.lit('"'), s, F.lit('"')))


def date_text(d: Column) -> Column:
    # within these years both spell a date alike, the cast in a fraction of the time
    text = F.when(d.between(F.lit(FIRST_DAY), F.lit(LAST_DAY)), d.cast("string")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return F.when(d.isNull(), "null").otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def object_text(e: Column) -> Column:
    """A missing or empty text counts as ``{}``."""
    tight = F.regexp_replace(e, BLANKS, "$1")
    keys = F.json_object_keys(tight)
    ascending = (F.size(keys) == 1) | ((F.array_sort(keys) == keys) & (F.size(F.array_distinct(keys)) == F.size(keys)))
    return (F.when(F.coalesce(e, F.lit("")) == "", "{}").when(e.rlike(ONE_MEMBER), e).when(tight == "{}", "{}")
            .when(tight.rlike(FLAT_OBJECT), F.when(ascending, tight)))


def joined(parts: Column) -> Column:
    """Texts joined by commas; NULL if one is (``array_join`` would leave it out)."""
    return once(parts, lambda known: F.when(F.forall(known, lambda p: p.isNotNull()), F.array_join(known, ",")))


def list_text(strings: Column) -> Column:
    return F.when(strings.isNull(), "null").otherwise(
        F.concat(F.lit("["), joined(F.transform(strings, string_text)), F.lit("]")))


def members(pairs: list[tuple[str, Column]]) -> Column:
    """``{"name":value,...}``, names in order; NULL if a value is."""
    parts = []
    for i, (name, value) in enumerate(sorted(pairs, key=lambda p: p[0])):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def map_text(m: Column, value) -> Column:
    """Keys in order; ``value`` renders one value."""
    entries = F.array_sort(F.transform(F.map_keys(m), lambda k: k))
    parts = F.transform(entries, lambda k: F.concat(string_text(k), F.lit(":"), value(F.element_at(m, k))))
    return F.when(m.isNull(), "null").otherwise(F.concat(F.lit("{"), joined(parts), F.lit("}")))


def reference_text(r: Column) -> Column:
    return F.when(r.isNull(), "null").otherwise(members([("path", string_text(r["path"])), ("hash", string_text(r["hash"]))]))


def market_text(md: Column) -> Column:
    return F.when(md.isNull(), "null").otherwise(members([
        ("fx_rates", map_text(md["fx_rates"], number_text)),
        ("inflation_rates", map_text(md["inflation_rates"], number_text)),
        ("price_matrices", map_text(md["price_matrices"], reference_text))]))


def agreement_text(ag: Column) -> Column:
    kinds = {"extra": object_text, "eligible_collateral": list_text}
    kinds |= dict.fromkeys(("threshold_amount", "minimum_transfer_amount", "independent_amount", "rounding_amount"), number_text)
    return F.when(ag.isNull(), "null").otherwise(members([(f, kinds.get(f, string_text)(ag[f])) for f in AGREEMENT_FIELDS]))


def stored_market_text(md: Column, fx: Column, inflation: Column) -> Column:
    """As ``market_text``, from the texts of the two rate sets."""
    return F.when(md.isNull(), "null").otherwise(members([
        ("fx_rates", fx), ("inflation_rates", inflation), ("price_matrices", map_text(md["price_matrices"], reference_text))]))


def header_text(market: Column) -> Column:
    """A document up to and including ``"trades":[`` (``trades`` is the last
    key), given its market data's text."""
    return F.concat(F.lit('{"agreement":'), agreement_text(F.col("agreement")),
                    F.lit(',"cob_date":'), date_text(F.col("cob_date")),
                    F.lit(',"counterparty_id":'), string_text(F.col("counterparty_id")),
                    F.lit(',"market_data":'), market,
                    F.lit(',"netting_set_id":'), string_text(F.col("netting_set_id")), F.lit(',"trades":['))


def trade_text() -> Column:
    kinds = {"extra": object_text, "notional": number_text, "maturity_date": date_text}
    return members([(f, kinds.get(f, string_text)(F.col(f))) for f in TRADE_FIELDS])
