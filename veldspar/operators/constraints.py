"""Declared constraints as checks over a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.scalar import check_passes
from veldspar.operators.joins import not_in_keys


@dataclass(frozen=True)
class Constraint:
    """One declared constraint; ``kind`` is NOT NULL, PRIMARY KEY, UNIQUE, FOREIGN KEY, CHECK or LENGTH."""

    name: str
    kind: str
    columns: Sequence[str] = field(default_factory=tuple)
    condition: Column | None = None
    ref: DataFrame | None = None
    ref_columns: Sequence[str] = field(default_factory=tuple)
    limit: int = 0
    unit: str = "BYTE"


def _any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def _all_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols])


def _too_long(column: str, limit: int, unit: str) -> Column:
    size = F.octet_length(column) if unit.upper() == "BYTE" else F.char_length(column)
    return size > limit


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any of ``cols``."""
    return df.filter(_any_null(cols))


def check_pk(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a NULL, with their row count ``n``."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") > 1) | _any_null(cols))


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; all-NULL keys may repeat."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") > 1) & ~_all_null(cols))


def check_fk(df: DataFrame, cols: Sequence[str], ref: DataFrame, ref_cols: Sequence[str]) -> DataFrame:
    """Keys without a parent, with the number ``n`` of rows that hold them; a NULL key passes.

    Rows are counted per key before the anti join, so a frequent key is one row in it.
    """
    counts = df.filter(~_any_null(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    parents = ref.select(*[F.col(r).alias(c) for r, c in zip(ref_cols, cols)])
    return not_in_keys(counts, parents, cols)


def check_cond(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition is false (an unknown result passes)."""
    return df.filter(~check_passes(cond))


def check_length(df: DataFrame, col: str, n: int, unit: str = "BYTE") -> DataFrame:
    """Rows whose text exceeds VARCHAR2(n BYTE) or VARCHAR2(n CHAR)."""
    return df.filter(_too_long(col, n, unit))


def check_all(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """One row per constraint: name, kind and number of violating rows.

    All row-level constraints share one scan; each key constraint adds one combined aggregate.  A
    repeated key counts every row that holds it.
    """
    row_level: list[tuple[Constraint, Column]] = []
    reports: list[DataFrame] = []
    for c in constraints:
        if c.kind == "NOT NULL":
            row_level.append((c, _any_null(c.columns)))
        elif c.kind == "CHECK":
            row_level.append((c, ~check_passes(c.condition)))
        elif c.kind == "LENGTH":
            row_level.append((c, _too_long(c.columns[0], c.limit, c.unit)))
        else:
            if c.kind == "PRIMARY KEY":
                bad = check_pk(df, c.columns)
            elif c.kind == "UNIQUE":
                bad = check_unique(df, c.columns)
            elif c.kind == "FOREIGN KEY":
                bad = check_fk(df, c.columns, c.ref, c.ref_columns)
            else:
                raise ValueError(f"unknown constraint kind {c.kind!r}")
            reports.append(bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
                F.lit(c.name).alias("constraint_name"), F.lit(c.kind).alias("kind"), "violations"))
    if row_level:
        counted = df.agg(*[F.count_if(bad).alias(f"v{i}") for i, (_, bad) in enumerate(row_level)])
        rows = F.array(*[
            F.struct(F.lit(c.name).alias("constraint_name"), F.lit(c.kind).alias("kind"),
                     F.col(f"v{i}").alias("violations"))
            for i, (c, _) in enumerate(row_level)
        ])
        reports.append(counted.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, reports)
