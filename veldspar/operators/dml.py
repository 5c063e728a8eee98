"""DML as table-in, table-out operators: merge, keyed update, insert, audit, defaults, errors.

The caller writes the returned table over the old one (or as its next version).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.scalar import as_col, sysdate
from veldspar.operators.joins import compare_versions
from veldspar.operators.sequences import nextval
from veldspar.operators.skew import lookup_join, unique_or_raise
from veldspar.session import materialize


def _source_as(source: DataFrame, on: Sequence[str]) -> DataFrame:
    others = [c for c in source.columns if c not in on]
    return source.select(*on, *[F.col(c).alias(f"src_{c}") for c in others], F.lit(True).alias("_src"))


def merge_upsert(target: DataFrame, source: DataFrame, on: Sequence[str],
                 update: Mapping[str, Column], insert: Mapping[str, Column]) -> DataFrame:
    """MERGE: ``update`` the matched rows, ``insert`` the unmatched source rows.

    Expressions see target columns by name and source columns as ``src_<name>``.  A source key that
    occurs twice is an error, since the update would not be defined.
    """
    on = list(on)
    single = materialize(unique_or_raise(source, on, "MERGE source holds a key twice"), "merge-source")
    joined = lookup_join(target, _source_as(single, on), on, "left", stored=True)
    hit = F.col("_src").isNotNull()
    kept = joined.select(*[
        F.when(hit, as_col(update[c])).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)
        if c in update and c not in on else F.col(c)
        for c in target.columns
    ])
    # the target's keys are reduced to those the source has, and combined, so a key it repeats is one row here
    known = lookup_join(target.select(*on), single.select(*on), on, "left_semi", stored=True).distinct()
    fresh = _source_as(single, on).join(known, on, "left_anti")
    nothing = [F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns if c not in on]
    added = fresh.select("*", *nothing).select(*[
        F.col(c) if c in on else (as_col(insert[c]) if c in insert else F.col(c)).cast(target.schema[c].dataType).alias(c)
        for c in target.columns
    ])
    return kept.unionByName(added)


def update_by_key(target: DataFrame, changes: DataFrame, on: Sequence[str],
                  set: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """UPDATE by key; returns the new table and a status per change (SUCCESS / NOT_FOUND, row count).

    ``set`` sees the change's columns as ``src_<name>``.
    """
    on = list(on)
    single = unique_or_raise(changes, on, "a key is changed twice in one update")
    joined = lookup_join(target, _source_as(single, on), on, "left")
    hit = F.col("_src").isNotNull()
    table = joined.select(*[
        F.when(hit, as_col(set[c])).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)
        if c in set else F.col(c)
        for c in target.columns
    ])
    mine = target.join(changes.select(*on).distinct(), on, "left_semi")
    touched = mine.groupBy(*on).agg(F.count(F.lit(1)).alias("row_count"))
    status = changes.select(*on).distinct().join(touched, on, "left").select(
        *on,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.when(F.col("row_count") > 0, "SUCCESS").otherwise("NOT_FOUND").alias("status"),
    )
    return table, status


def row_count(status: DataFrame, name: str = "row_count") -> DataFrame:
    """SQL%ROWCOUNT of an update: affected rows over all changes."""
    return status.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias(name))


def insert_unique(target: DataFrame, rows: DataFrame, key: Sequence[str],
                  order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """INSERT under a unique key; returns the new table and the rejected rows.

    Of new rows sharing a key the first in ``order`` (total within a key; NULLs first) enters.  The first of a
    key comes from a combined minimum and rejects are found by (key, order), so a key repeated in a
    large part of the batch is not gathered anywhere.  A key that is NULL in all its columns never violates uniqueness; one that is NULL in some
    is equal to a key with the same NULLs and the same values beside them.
    """
    key, order = list(key), list(order)
    some = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in key])
    free, bound = rows.filter(~some), rows.filter(some)
    firsts = bound.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).select(*key, "_first.*")
    names = key + [o for o in order if o not in key]
    firsts = firsts.select(*[F.col(c).alias(f"_w_{c}") for c in names])
    taken = target.select(*[F.col(k).alias(f"_t_{k}") for k in key]).filter(reduce(lambda a, b: a | b, [F.col(f"_t_{k}").isNotNull() for k in key])).distinct()

    def same(left: str, right: str, columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}")) for c in columns])

    winners = firsts.join(taken, same("_w_", "_t_", key), "left_anti")
    accepted = bound.join(winners, same("", "_w_", names), "left_semi").unionByName(free)
    rejects = bound.join(winners, same("", "_w_", names), "left_anti")
    return target.unionByName(accepted.select(*target.columns)), rejects


def report_rows(report: DataFrame, parents: DataFrame, children: DataFrame, keys: Sequence[str],
                aggregate: Mapping[str, Column], row: Mapping[str, Column]) -> DataFrame:
    """The INSERT ... SELECT of a cursor loop as one grouped insert.

    Every parent gives one row built from ``row`` (NVL(agg, 0) columns visible); it is appended to
    ``report``.
    """
    from veldspar.operators.aggregates import summary

    totals = summary(parents, children, keys, aggregate)
    return report.unionByName(totals.select(*[c.alias(n) for n, c in row.items()]))


def soft_delete(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Set ``flag`` to 0 for the listed keys; the rows stay."""
    gone = keys.select(*on).distinct().withColumn("_gone", F.lit(True))
    joined = lookup_join(df, gone, on, "left")
    return joined.select(*[
        F.when(F.col("_gone"), F.lit(0)).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c)
        if c == flag else F.col(c) for c in df.columns
    ])


def capture_changes(before: DataFrame, after: DataFrame, key: Sequence[str], cols: Sequence[str],
                    table_name: str, as_of: datetime | None = None, user: str | None = None,
                    when: Column | None = None) -> DataFrame:
    """Rows an audit trigger would write for the step from ``before`` to ``after``.

    ``when`` is the trigger's WHEN clause over ``old_<col>`` / ``new_<col>``.
    """
    pairs = compare_versions(before, after, key, cols).filter("change <> 'SAME'")
    if when is not None:
        pairs = pairs.filter(when)
    return pairs.select(
        F.lit(table_name).alias("table_name"),
        F.col("change").alias("action"),
        *key,
        *[F.col(f"{side}_{c}") for c in cols for side in ("old", "new")],
        (F.lit(user) if user else F.current_user()).alias("changed_by"),
        sysdate(as_of).alias("changed_at"),
    )


def fill_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """BEFORE INSERT defaulting: :NEW.x := NVL(:NEW.x, default)."""
    return df.withColumns({c: F.coalesce(F.col(c), as_col(d)) for c, d in defaults.items()})


def fill_key(df: DataFrame, key: str, order: Sequence, start: int = 1, inc: int = 1) -> DataFrame:
    """BEFORE INSERT key assignment: only rows with a NULL key draw a sequence number."""
    given = df.filter(F.col(key).isNotNull())
    missing = df.filter(F.col(key).isNull()).drop(key)
    drawn = nextval(missing, order, start, inc, name=key)
    typed = drawn.withColumn(key, F.col(key).cast(df.schema[key].dataType))
    return given.unionByName(typed.select(*df.columns))


def raise_if(df: DataFrame, cond: Column, code: int, msg: str) -> DataFrame:
    """RAISE_APPLICATION_ERROR: reading a row for which ``cond`` holds fails the query."""
    if not -20999 <= code <= -20000:
        raise ValueError("application error codes lie between -20999 and -20000")
    text = F.lit(f"ORA{code}: {msg}")
    return df.filter(F.when(cond, F.raise_error(text)).otherwise(F.lit(True)))


def try_apply(df: DataFrame, source: str, expr: Column, name: str,
              error: str = "conversion failed") -> tuple[DataFrame, DataFrame]:
    """Row-level exception capture: rows where a null-on-error ``expr`` works, and the failed ones."""
    tried = df.withColumn(name, expr)
    failed = F.col(source).isNotNull() & F.col(name).isNull()
    ok = tried.filter(~failed)
    err = df.withColumn("_bad", F.col(source).isNotNull() & expr.isNull()).filter("_bad").drop("_bad")
    return ok, err.withColumn("error_text", F.concat(F.lit(error + ": "), F.col(source).cast("string")))
