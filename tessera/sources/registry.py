"""Parsed cases against the known parameters: checks, full tables, verdicts, counts and typed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.builtins import MODELS, PARAMETERS
from tessera.sources.cases import case_lines, parse_cases
from tessera.sources.rules import CASE_COLUMNS, complete, with_models

#: Numbers that a typed read may hold (fixed values).
_MOST_INT, _MOST_FLOAT = 2.0**31, 3.4028234663852886e38
_READS = {"double": "quantity", "float": "quantity", "int": "quantity", "bool": "bool", "string": "string"}


def _declared(part: int) -> dict:
    return {p[0]: p[part] for p in PARAMETERS}


def _lookup(values: dict):
    return F.create_map(*(x for name, value in values.items() for x in (F.lit(name), value)))[F.col("name")]


def checked(parsed: DataFrame, key: str = "case_id") -> DataFrame:
    """``parsed`` with ``builtin boolean`` and ``problem``: a line that is not well formed, a name that its case states a second time, a built-in of another kind or dimension; else null.

    Rows without a key form one case.  Rows of one case and name meet in one task, so at most the lines of one case.
    """
    kind = _lookup({n: F.lit(k) for n, k in _declared(1).items()})
    dims = _lookup({n: F.array(*map(F.lit, d)) for n, d in _declared(2).items()})
    nth = F.row_number().over(Window.partitionBy(key, "name").orderBy("line_no"))
    bad = F.col("name").isNull() | (F.col("kind") == "error")
    problem = (
        F.when(bad, "not well formed").when(nth > 1, "stated twice").when(kind != F.col("kind"), "wrong kind")
        .when((F.col("kind") == "quantity") & kind.isNotNull() & ~F.coalesce(F.col("dims") == dims, F.lit(False)), "wrong dimension")
    )
    return parsed.withColumns({"builtin": kind.isNotNull(), "problem": problem})


def full_table(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """A row for each case of ``checked`` rows and each known parameter, stated or not: ``key, name, kind, stated boolean, line_no, value, flag, word``; rows with a problem do not count."""
    known = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k, _, _ in PARAMETERS)))
    slots = rows.select(key).distinct().select(key, known.alias("known")).select(F.col(key).alias("_key"), F.col("known.name").alias("_name"), F.col("known.kind").alias("_kind"))
    good = rows.filter("problem is null and builtin")
    joined = slots.join(good, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_name") == F.col("name")), "left")
    return joined.select(F.col("_key").alias(key), F.col("_name").alias("name"), F.col("_kind").alias("kind"), F.col("line_no").isNotNull().alias("stated"), "line_no", "value", "flag", "word")


def verdicts(texts: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """One row a case: CASE_COLUMNS completed, models in their canonical spelling, ``error`` and ``warnings``.

    The first bad line, in order of lines, comes before the rules, and the rules before the models.  A text that is null or
    empty states nothing.  Keys are taken as unique: texts of one key are read as one case.  Other columns of ``texts`` are left out.
    """
    texts = texts.select(F.col(key), F.col(text).alias("text"))
    rows = checked(parse_cases(case_lines(texts, key), key), key).unionByName(texts.select(key), allowMissingColumns=True)
    stated = F.col("problem").isNull()
    first_bad = F.min(F.when(~stated, F.struct("line_no", F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("problem")).alias("what"))))["what"]
    wide = rows.groupBy(key).agg(
        first_bad.alias("line_error"),
        *(F.max(F.when(stated & (F.col("name") == n), F.col("value"))).alias(n) for n in CASE_COLUMNS),
        *(F.max(F.when(stated & (F.col("name") == n), F.col("word"))).alias(n) for n in MODELS),
    )
    done = with_models(complete(wide))
    error = F.coalesce("line_error", "error", "model_error")
    warnings = F.when(error.isNull(), F.col("warnings")).otherwise(F.array().cast("array<string>"))
    return done.select(key, error.alias("error"), warnings.alias("warnings"), *CASE_COLUMNS, *MODELS)


def read_as(rows: DataFrame, wanted: list[tuple[str, str, tuple[int, int, int, int] | None, int | None]], key: str = "case_id") -> DataFrame:
    """Typed reads of ``checked`` rows: for each case and each (name, type, dimension, most bytes) of the stated list ``wanted``: ``key, name, type, double_value, int_value, flag, word, problem``.

    Types are double, float, int, bool and string.  A dimension and a number of bytes (with one for the end of the text) may be None.
    A problem (not stated, wrong kind, wrong dimension, out of range, not whole, too long) leaves the values null.
    """
    for name, kind, _, _ in wanted:
        if kind not in _READS:
            raise ValueError(f"{name}: {kind} is not one of {', '.join(_READS)}")
    slot = [
        F.struct(
            F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(_READS[t]).alias("needs"),
            (F.array(*map(F.lit, d)) if d else F.lit(None)).cast("array<int>").alias("needs_dims"), F.lit(b).cast("int").alias("bytes"),
        )
        for n, t, d, b in wanted
    ]
    slots = rows.select(F.col(key).alias("_key")).distinct().withColumn("slot", F.explode(F.array(*slot)))
    got = slots.join(rows.filter("problem is null"), F.col("_key").eqNullSafe(F.col(key)) & (F.col("slot.name") == F.col("name")), "left")
    value, whole = F.col("value"), F.round("value")
    tolerance = 1e-12 * F.greatest(F.lit(1.0), F.abs(value))
    finite = (value > float("-inf")) & (value < float("inf"))
    problem = (
        F.when(F.col("kind").isNull(), "not stated").when(F.col("kind") != F.col("slot.needs"), "wrong kind")
        .when(F.col("slot.needs_dims").isNotNull() & ~F.coalesce(F.col("dims") == F.col("slot.needs_dims"), F.lit(False)), "wrong dimension")
        .when((F.col("slot.type") == "float") & ~(finite & (F.abs(value) <= _MOST_FLOAT)), "out of range")
        .when((F.col("slot.type") == "int") & ~finite, "out of range").when((F.col("slot.type") == "int") & (F.abs(value - whole) > tolerance), "not whole")
        .when((F.col("slot.type") == "int") & ~((whole >= -_MOST_INT) & (whole < _MOST_INT)), "out of range")
        .when(F.octet_length("word") + 1 > F.col("slot.bytes"), "too long")
    )
    got = got.withColumn("read_problem", problem)
    good, of = F.col("read_problem").isNull(), F.col("slot.type")
    number = F.when(of == "float", value.cast("float").cast("double")).when(of == "double", value)
    return got.select(
        F.col("_key").alias(key), F.col("slot.name").alias("name"), of.alias("type"), F.when(good, number).alias("double_value"),
        F.when(good & (of == "int"), whole.cast("int")).alias("int_value"), F.when(good & (of == "bool"), F.col("flag")).alias("flag"),
        F.when(good & (of == "string"), F.col("word")).alias("word"), F.col("read_problem").alias("problem"),
    )


def counts(rows: DataFrame, bound: list[str], key: str = "case_id") -> DataFrame:
    """For each case of ``checked`` rows: ``n_builtin, n_own, n_bound, unbound array<string>``; its own parameters are bound if their name is one of ``bound``, the others are listed by line."""
    good = F.col("problem").isNull()
    own, is_bound = good & ~F.col("builtin"), F.col("name").isin(*bound)
    open_rows = F.sort_array(F.collect_list(F.when(own & ~is_bound, F.struct("line_no", "name"))))
    return rows.groupBy(key).agg(
        F.count_if(good & F.col("builtin")).alias("n_builtin"), F.count_if(own).alias("n_own"), F.count_if(own & is_bound).alias("n_bound"), F.transform(open_rows, lambda r: r["name"]).alias("unbound")
    )
