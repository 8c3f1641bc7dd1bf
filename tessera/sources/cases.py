"""Typed case files: lines of ``name = value``, with units.

Lines become rows, and every step is a column expression over these rows or a join with a small
fixed table, so that any number of case files goes through one job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import boolean_word, normal_name
from tessera.sources.builtins import parameter_names
from tessera.sources.units import known_units, whole_exponents

#: Units (fixed values): symbol, whether prefixes apply, factor to SI, exponents of length, mass, time and temperature.
UNITS = [
    ("m", True, 1.0, (1, 0, 0, 0)), ("kg", False, 1.0, (0, 1, 0, 0)), ("g", True, 1e-3, (0, 1, 0, 0)), ("s", True, 1.0, (0, 0, 1, 0)), ("K", True, 1.0, (0, 0, 0, 1)),
    ("Hz", True, 1.0, (0, 0, -1, 0)), ("N", True, 1.0, (1, 1, -2, 0)), ("Pa", True, 1.0, (-1, 1, -2, 0)), ("J", True, 1.0, (2, 1, -2, 0)), ("W", True, 1.0, (2, 1, -3, 0)),
    ("bar", False, 1e5, (-1, 1, -2, 0)), ("atm", False, 101325.0, (-1, 1, -2, 0)), ("rad", False, 1.0, (0, 0, 0, 0)), ("deg", False, pi / 180, (0, 0, 0, 0)),
]
#: Prefixes and their powers of ten (fixed values).
PREFIXES = {
    "Q": 30, "R": 27, "Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6, "n": -9, "p": -12,
    "f": -15, "a": -18, "z": -21, "y": -24, "r": -27, "q": -30,
}
_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


@dataclass(frozen=True)
class UnitSystem:
    """The units and prefixes that case files may use; the given ones, and what is registered on top."""

    units: tuple[tuple[str, bool, float, tuple[int, ...]], ...] = tuple(UNITS)
    prefixes: tuple[tuple[str, int], ...] = tuple(PREFIXES.items())

    def with_unit(self, symbol: str, factor: float, dims: tuple[int, int, int, int], prefixes: bool = False) -> UnitSystem:
        """With one more unit, by its factor to SI and its exponents of length, mass, time and temperature; a symbol that is there already raises."""
        if any(symbol == s for s, *_ in self.units):
            raise ValueError(f"unit {symbol!r} is registered already")
        if not symbol or not 0 < factor < float("inf") or len(dims) != 4:
            raise ValueError(f"unit {symbol!r} needs a symbol, a finite positive factor and four exponents")
        return replace(self, units=(*self.units, (symbol, prefixes, float(factor), tuple(dims))))

    def with_prefix(self, symbol: str, power: int) -> UnitSystem:
        """With one more prefix, by its power of ten; a symbol that is there already raises."""
        if symbol in dict(self.prefixes):
            raise ValueError(f"prefix {symbol!r} is registered already")
        if not symbol:
            raise ValueError("a prefix needs a symbol")
        return replace(self, prefixes=(*self.prefixes, (symbol, power)))

    def symbols(self, spark: SparkSession) -> DataFrame:
        """All symbols that a unit term may be, prefixed ones too: ``symbol, factor, dims array<int>``.

        A plain symbol wins over a prefixed reading; of those the longest prefix does.
        """
        found = {p + s: (f * 10.0**n, d) for s, prefixed, f, d in self.units if prefixed for p, n in sorted(self.prefixes, key=lambda x: len(x[0]))}
        found |= {s: (f, d) for s, _, f, d in self.units}
        return spark.createDataFrame([(s, float(f), list(d)) for s, (f, d) in found.items()], "symbol string, factor double, dims array<int>")


#: A line's name: what stands before the first ``=`` or ``:`` outside quotes, in which a backslash keeps the next character.
_NAMED = r"""^((?:[^=:'"]|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")*)[=:](.*)$"""
#: A line without a separator: a name and what follows it.
_BARE = r"^([A-Za-z_][A-Za-z0-9_]*)(.*)$"
_QUOTED = r"""'[^']*'|"[^"]*\""""


def case_lines(texts: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """Numbered lines ``key, line_no int, name, rest string``; blank lines and comments go.

    The first ``=`` or ``:`` outside quotes separates; without one the line's first word is the name.
    """
    line = F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line_no", "line")
    bare = texts.select(key, line).withColumn("line", F.trim(F.regexp_replace("line", r"""^((?:[^#'"]|'[^']*'|"[^"]*")*)#.*$""", "$1"))).filter("line <> ''")
    pattern = [F.when(F.col("line").rlike(_NAMED), F.regexp_extract("line", _NAMED, n)).otherwise(F.regexp_extract("line", _BARE, n)) for n in (1, 2)]
    name, rest = pattern[0], F.trim(pattern[1])
    return bare.select(key, (F.col("line_no") + 1).alias("line_no"), normal_name(F.trim(name)).alias("name"), rest.alias("rest"))


def parse_cases(lines: DataFrame, key: str = "case_id", units: UnitSystem | None = None) -> DataFrame:
    """Typed rows: ``key, line_no, name, kind`` (quantity, bool, string, error), ``value double`` in SI units, ``dims array<int>``, ``flag boolean``, ``word string``, ``exponents array<struct<num, den>>``.

    Aliases are resolved, but in an error the name stays as it is spelled.  Units follow the grammar of ``units.flat_unit``; one that is not well formed or
    has an unknown symbol makes the row an error; so do an open quote and words beside a quoted text.  ``units`` may hold registered units and prefixes.  ``dims`` is null where an exponent is a fraction.
    """
    spark = lines.sparkSession
    alias = F.create_map(*(F.lit(x) for pair in parameter_names().items() for x in pair))
    number = F.regexp_extract("rest", _NUMBER, 1)
    typed = lines.withColumns(
        {
            "number": F.when(number != "", number.cast("double")),
            "flag": boolean_word(F.col("rest")),
            "unit": F.trim(F.regexp_replace("rest", _NUMBER, "")),
        }
    )
    known = known_units(typed.filter("number is not null and unit <> ''"), (units or UnitSystem()).symbols(spark))
    joined = typed.join(known, "unit", "left")
    broken = F.col("rest").rlike("['\"]") & ~F.col("rest").rlike(f"^(?:{_QUOTED})$")
    plain = F.col("unit") == ""
    kind = (
        F.when(F.col("name").isNull() | (F.col("rest") == "") | broken, "error").when(F.col("flag").isNotNull(), "bool").when(F.col("number").isNull(), "string")
        .when(plain | F.col("factor").isNotNull(), "quantity").otherwise("error")
    )
    value = F.when(plain, F.col("number")).otherwise(F.col("number") * F.col("factor"))
    nothing = F.array(*[F.struct(F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))] * 4)
    exponents = F.when(F.col("kind") == "quantity", F.coalesce("exponents", nothing))
    is_quantity = F.col("kind") == "quantity"
    name = F.when(F.col("kind") == "error", F.col("name")).otherwise(F.coalesce(alias[F.col("name")], F.col("name")))
    return joined.withColumn("kind", kind).select(
        key, "line_no", name.alias("name"), "kind", F.when(is_quantity, value).alias("value"), whole_exponents(exponents).alias("dims"), "flag",
        F.when(F.col("kind") == "string", F.regexp_replace("rest", r"""^(['"])(.*)\1$""", "$2")).alias("word"),
        exponents.alias("exponents"),
    )


def duplicates(parsed: DataFrame, key: str = "case_id") -> DataFrame:
    """Names that a case states twice: ``key, name, line_no`` of the second."""
    first = parsed.groupBy(key, "name").agg(F.min("line_no").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return parsed.join(first, [key, "name"]).filter("line_no > first").groupBy(key, "name").agg(F.min("line_no").alias("line_no"))


def wide_cases(parsed: DataFrame, names: list[str], key: str = "case_id") -> DataFrame:
    """One row a case with a column for each name, null where it is not stated."""
    return parsed.filter("kind = 'quantity'").groupBy(key).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))
