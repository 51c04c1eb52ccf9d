"""Comparison of a table with an expected one, cell by cell, with tolerances.

Rows are matched by keys in a full outer join, so both tables may be of any size. Keys that occur
more than once on either side are reported and not compared, as their rows can't be matched.

Numbers agree if they differ by ``absolute + relative * |expected|`` or less. NaN agrees with
NaN, an infinity with the same infinity, NULL with NULL; other pairs of these don't agree with anything. Other types
agree where they are equal.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Absolute and relative tolerance of columns without their own.
TOLERANCE = (0.0, 0.0)
MISSING, EXTRA, REPEATED, DIFFERS = "missing", "extra", "repeated", "differs"


def agrees(actual: Column, expected: Column, absolute: float, relative: float) -> Column:
    """Whether two numbers agree; never null."""
    a, b = actual.cast("double"), expected.cast("double")
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    close = F.abs(a - b) <= absolute + relative * F.abs(b)
    # NaN is equal to NaN and infinities to themselves here
    return F.when(plain(a) & plain(b), close).otherwise(a.eqNullSafe(b))


def _counted(df: DataFrame, keys: list[str], columns: list[str], side: str) -> DataFrame:
    """One row for each key, with its number of rows and the values of one of them."""
    values = F.any_value(F.struct(*[F.col(c) for c in columns] or [F.lit(0).alias("nothing")]))
    return df.groupBy(*[F.col(k).alias(f"{side}_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(f"{side}_rows"), values.alias(side))


def differences(actual: DataFrame, expected: DataFrame, keys: list[str], tolerances: dict[str, tuple[float, float]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Keys, column, problem, actual and expected (as text) of everything in which actual departs from expected.

    columns: those to compare, all of expected's others by default. Columns that actual lacks are an error, further ones are not looked at.
    """
    columns = [c for c in expected.columns if c not in keys] if columns is None else columns
    lacking = [c for c in [*keys, *columns] if c not in actual.columns or c not in expected.columns]
    if lacking:
        raise ValueError(f"columns that one table lacks: {lacking}")
    tolerances = tolerances or {}
    left, right = _counted(actual, keys, columns, "a"), _counted(expected, keys, columns, "e")
    both = left.join(right, reduce(and_, [F.col(f"a_{i}").eqNullSafe(F.col(f"e_{i}")) for i in range(len(keys))]), "full_outer")
    said = lambda x: x.cast("string")
    cells = []
    for c in columns:
        a, e = F.col("a")[c], F.col("e")[c]
        is_number = all(isinstance(t.schema[c].dataType, T.NumericType) for t in (actual, expected))
        same = agrees(a, e, *tolerances.get(c, TOLERANCE)) if is_number else a.eqNullSafe(e)
        cells.append(F.when(~same, F.struct(F.lit(c).alias("column"), F.lit(DIFFERS).alias("problem"), said(a).alias("actual"), said(e).alias("expected"))))
    none = F.lit(None).cast("string")
    whole = lambda problem: F.array(F.struct(none.alias("column"), F.lit(problem).alias("problem"), said(F.col("a_rows")).alias("actual"), said(F.col("e_rows")).alias("expected")))
    found = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<struct<column:string,problem:string,actual:string,expected:string>>")
    problem = F.when((F.col("a_rows") > 1) | (F.col("e_rows") > 1), whole(REPEATED)).when(F.col("a_rows").isNull(), whole(MISSING)).when(F.col("e_rows").isNull(), whole(EXTRA)).otherwise(found)
    key = [F.when(F.col("a_rows").isNull(), F.col(f"e_{i}")).otherwise(F.col(f"a_{i}")).alias(k) for i, k in enumerate(keys)]
    return both.select(*key, F.explode(problem).alias("x")).select(*keys, "x.*")


def require_equal(actual: DataFrame, expected: DataFrame, keys: list[str], tolerances: dict[str, tuple[float, float]] | None = None) -> None:
    """Fail with a sample of the differences."""
    rows = differences(actual, expected, keys, tolerances).take(5)
    if rows:
        raise ValueError(f"tables differ: {rows}")
