"""Unit expressions: products, quotients and powers of symbols, with nested brackets and rational exponents."""

from __future__ import annotations

import re
from collections import deque
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.functions.numbers import rational, rational_add, rational_multiply

#: Brackets from the inside out (fixed values); a pair may hold only pairs of its own or an earlier kind.
BRACKETS = ("()", "[]", "{}")
#: Base units in the order in which they are written, and their places in the exponents (fixed values).
BASE_UNITS = (("kg", 1), ("m", 0), ("s", 2), ("K", 3))

_TOKEN = re.compile(r"(?P<symbol>[A-Za-z]+)|(?P<mark>[*/])|(?P<open>[(\[{])|(?P<close>[)\]}])|\^\s*(?P<power>[+-]?\d+|[(\[{]\s*[+-]?\d+\s*(?:/\s*[+-]?\d+\s*)?[)\]}])|(?P<blank>\s+)|(?P<other>.)", re.S)


def flat_unit(text: str) -> list[tuple[str, Fraction]] | None:
    """The symbols of a unit with their exponents, from left to right; None if it is not well formed.

    ``*``, ``/`` and mere juxtaposition bind alike, from the left; an exponent binds closer.
    It is a whole number, or one or a fraction in brackets.
    """
    tokens = deque((m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text) if m.lastgroup != "blank")
    try:
        return _factors(tokens, "")
    except (ValueError, ZeroDivisionError, RecursionError):
        return None


def _factors(tokens: deque[tuple[str, str]], around: str) -> list[tuple[str, Fraction]]:
    """Takes factors up to the end of a bracket pair, or of the text."""
    found, sign, ready = [], 1, False
    while tokens:
        kind, part = tokens.popleft()
        if kind == "close" and ready and around.endswith(part) and around:
            return found
        if kind == "mark" and ready:
            sign, ready = (1 if part == "*" else -1), False
        elif kind in ("symbol", "open"):
            inner = [(part, Fraction(1))]
            if kind == "open":
                pair = next(b for b in BRACKETS if b[0] == part)
                if around and BRACKETS.index(pair) > BRACKETS.index(around):
                    raise ValueError("a wider bracket within a narrower one")
                inner = _factors(tokens, pair)
            power = _exponent(tokens.popleft()[1]) if tokens and tokens[0][0] == "power" else 1
            found += [(symbol, sign * e * power) for symbol, e in inner]
            sign, ready = 1, True
        else:
            raise ValueError(f"unexpected {part!r}")
    if around or not ready:
        raise ValueError("unfinished unit")
    return found


def _exponent(text: str) -> Fraction:
    if not text[-1].isdigit() and text[0] + text[-1] not in BRACKETS:
        raise ValueError("unmatched brackets")
    return Fraction(*(int(n) for n in re.findall(r"[+-]?\d+", text)))


@F.pandas_udf(ArrayType(StructType().add("symbol", "string").add("num", "long").add("den", "long")))
def unit_factors(units: pd.Series) -> pd.Series:
    """The factors of each unit; null where it is not well formed or an exponent needs more than 32 bits."""

    def rows(text: str | None) -> list[dict] | None:
        flat = flat_unit(text or "")
        if flat is None or any(max(abs(e.numerator), e.denominator) >= 1 << 31 for _, e in flat):
            return None
        return [{"symbol": s, "num": e.numerator, "den": e.denominator} for s, e in flat]

    return units.map(rows)


def known_units(units: DataFrame, symbols: DataFrame) -> DataFrame:
    """Units that are well formed and whose symbols are known: ``unit, factor double, exponents array<struct<num, den>>``.

    ``units`` has a column ``unit``; each distinct one is read once.  ``symbols`` has ``symbol,
    factor, dims array<int>`` and a bounded number of rows.
    """
    factors = units.select("unit").distinct().withColumn("f", F.explode(unit_factors("unit")))
    known = factors.select("unit", "f.*").join(F.broadcast(symbols), "symbol", "left")
    power = F.struct("num", "den")
    terms = F.transform("dims", lambda d: rational_multiply(F.struct(d.cast("long").alias("num"), F.lit(1).cast("long").alias("den")), power))
    grouped = known.withColumn("terms", terms).groupBy("unit").agg(
        F.product(F.pow("factor", F.col("num") / F.col("den"))).alias("factor"),
        F.collect_list("terms").alias("terms"),
        F.bool_and(F.col("factor").isNotNull()).alias("known"),
    )
    nothing = F.array(*[rational(F.lit(0), F.lit(1))] * len(BASE_UNITS))
    total = F.aggregate("terms", nothing, lambda a, b: F.zip_with(a, b, rational_add))
    return grouped.filter("known").select("unit", "factor", total.alias("exponents"))


def whole_exponents(exponents: Column) -> Column:
    """The exponents as integers; null if one is a fraction."""
    return F.when(F.forall(exponents, lambda e: e["den"] == 1), F.transform(exponents, lambda e: e["num"].cast("int")))


def si_text(exponents: Column) -> Column:
    """A dimension in base units, such as ``kg/(m*s^2)`` or ``(kg*m)``; without positive exponents as ``m^-2*s^-1``; empty without any, null for null."""
    signed = F.array(*(F.struct(F.lit(name).alias("name"), exponents[place].alias("e")) for name, place in BASE_UNITS))

    def written(factors: Column, sign: int) -> Column:
        return F.array_join(F.transform(factors, lambda f: F.concat(f["name"], _power(f["e"]["num"] * sign, f["e"]["den"]))), "*")

    def group(factors: Column, sign: int) -> Column:
        text = written(factors, sign)
        return F.when((F.size(factors) > 1) | F.exists(factors, lambda f: f["e"]["den"] > 1), F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)

    over, under = F.filter(signed, lambda f: f["e"]["num"] > 0), F.filter(signed, lambda f: f["e"]["num"] < 0)
    text = F.when(F.size(over) == 0, written(under, 1)).when(F.size(under) == 0, group(over, 1)).otherwise(F.concat(group(over, 1), F.lit("/"), group(under, -1)))
    return F.when(exponents.isNotNull(), text)


def _power(num: Column, den: Column) -> Column:
    return F.when((num == 1) & (den == 1), "").when(den == 1, F.concat(F.lit("^"), num)).otherwise(F.concat(F.lit("^"), num, F.lit("/"), den))
