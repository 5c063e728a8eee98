"""Ordering with Oracle NULL placement, limits and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.operators.windows import rownum

# Largest offset + n that is answered by a heap; deeper pages are cut by row number.  Both ways give the same rows.
TOP_K_ROWS = 10_000


def ora_keys(*cols: str) -> list[Column]:
    """``"x"`` or ``"x desc"``: NULLs last when rising, first when falling."""
    keys = []
    for spec in cols:
        name, _, way = spec.partition(" ")
        keys.append(F.col(name).desc_nulls_first() if way.strip().lower() == "desc"
                    else F.col(name).asc_nulls_last())
    return keys


def order_ora(df: DataFrame, *cols: str) -> DataFrame:
    return df.orderBy(*ora_keys(*cols))


def fetch_first(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """FETCH FIRST n ROWS ONLY in Oracle order."""
    return page(df, order, 0, n)


def limit_rownum(df: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """WHERE ROWNUM <= n: any n rows, or the first n of a stated order."""
    return df.limit(n) if order is None else page(df, order, 0, n)


def page(df: DataFrame, order: Sequence[str], offset: int, n: int) -> DataFrame:
    """OFFSET/FETCH.  A deep page is found by counting rows before sampled keys, so neither its prefix nor a copy of the table meets or is written anywhere.

    Rows equal in ``order`` are told apart by the other columns, so the page is the same whichever way it is cut.
    """
    named = [spec.partition(" ")[0] for spec in order]
    rest = [f.name for f in df.schema if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    specs = [*order, *rest]
    keys = ora_keys(*specs)
    if offset + n <= TOP_K_ROWS:
        return df.orderBy(*keys).offset(offset).limit(n)
    if all(isinstance(df.schema[s.partition(" ")[0]].dataType, PLAIN_TYPES) for s in specs):
        return _deep_page(df, specs, keys, offset, n)
    numbered = rownum(df, keys, "_rn")
    return numbered.filter(F.col("_rn").between(offset + 1, offset + n)).drop("_rn")


# Types whose values come to the driver and back as they are.
PLAIN_TYPES = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
# Keys sampled in a round, those of them whose rows are counted, and the most rounds.
SAMPLE_KEYS, COUNTED_KEYS, ROUNDS = 4096, 48, 40


def _before(df: DataFrame, specs: Sequence[str], key: Sequence) -> Column:
    """Whether a row comes before ``key`` in Oracle order."""
    out = F.lit(False)
    for spec, value in reversed(list(zip(specs, key))):
        name, _, way = spec.partition(" ")
        column, falling = F.col(name), way.strip().lower() == "desc"
        if value is None:  # NULLs are last when rising, first when falling
            first, same = (F.lit(False) if falling else column.isNotNull()), column.isNull()
        else:
            fixed = F.lit(value).cast(df.schema[name].dataType)
            first = F.coalesce(column > fixed, F.lit(True)) if falling else F.coalesce(column < fixed, F.lit(False))
            same = column.eqNullSafe(fixed)
        out = first | (same & out)
    return out


def _deep_page(df: DataFrame, specs: Sequence[str], keys: list[Column], offset: int, n: int) -> DataFrame:
    """The page by order statistics: rows before some sampled keys are counted, the two next to the page bound it, and what lies between is cut again until a heap holds it.

    A round reads the table once and returns one row of counts.  Rows between two bounds that are all alike end the search: any of them will do.
    """
    names = [s.partition(" ")[0] for s in specs]
    total, inside = df.count(), df
    for round_ in range(ROUNDS):
        if offset + n <= TOP_K_ROWS or total == 0:
            break
        # a sample serves only to choose keys; every row is counted against them
        share = min(1.0, 1.5 * SAMPLE_KEYS / total)
        sample = inside.select(*names).sample(share, seed=round_).limit(2 * SAMPLE_KEYS) if share < 1 else inside.select(*names).limit(2 * SAMPLE_KEYS)
        ranked = sample.distinct().orderBy(*keys).collect()
        if not ranked:
            continue
        middle, last = offset * len(ranked) // total, (offset + n) * len(ranked) // total
        near = range(1, COUNTED_KEYS // 4)
        places = {0, len(ranked) - 1, middle, last, *(middle - k * k for k in near), *(last + k * k for k in near)}
        chosen = [tuple(ranked[i]) for i in sorted(p for p in places if 0 <= p < len(ranked))]
        counts = inside.agg(*[F.count_if(_before(df, specs, key)).alias(f"c{i}") for i, key in enumerate(chosen)]).first()
        low = max((i for i in range(len(chosen)) if counts[i] <= offset), default=None)
        high = min((i for i in range(len(chosen)) if counts[i] >= offset + n), default=None)
        bounds = ([~_before(df, specs, chosen[low])] if low is not None else []) + ([_before(df, specs, chosen[high])] if high is not None else [])
        skipped = counts[low] if low is not None else 0
        left = (counts[high] if high is not None else total) - skipped
        for bound in bounds:
            inside = inside.filter(bound)
        if left == total and len(ranked) == 1:  # all rows alike
            first = tuple(ranked[0])
            if inside.filter(_before(df, specs, first) | ~_same(df, specs, first)).limit(1).count() == 0:
                return inside.limit(min(n, max(0, total - offset)))
        total, offset = left, offset - skipped
    if offset + n <= TOP_K_ROWS or total == 0:
        return inside.orderBy(*keys).offset(offset).limit(n)
    numbered = rownum(inside, keys, "_rn")
    return numbered.filter(F.col("_rn").between(offset + 1, offset + n)).drop("_rn")


def _same(df: DataFrame, specs: Sequence[str], key: Sequence) -> Column:
    out = F.lit(True)
    for spec, value in zip(specs, key):
        name = spec.partition(" ")[0]
        out = out & F.col(name).eqNullSafe(F.lit(value).cast(df.schema[name].dataType))
    return out
