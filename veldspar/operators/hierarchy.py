"""CONNECT BY: all descendants of the start rows, level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.skew import maybe_broadcast
from veldspar.session import materialize, shared_folder


def connect_by(df: DataFrame, id: str, parent: str, start: Column, path: str | None = None,
               sep: str = "/", nocycle: bool = False, siblings: str | None = None,
               max_depth: int | None = None) -> DataFrame:
    """START WITH ``start`` CONNECT BY PRIOR ``id`` = ``parent``.

    Adds ``level``; with ``path`` also ``path`` (SYS_CONNECT_BY_PATH); with ``siblings`` also
    ``sibling_key``, an array that sorts depth first with siblings by that column.  A row met again
    below itself is an error, or is left out with ``nocycle``.  ``max_depth`` acts as LEVEL <= n.

    Each level is one join of the table with the level above, stored in the shared folder, so the
    plan does not grow with the depth and a lost executor costs one level at most.  Levels hold keys and what
    path and order need; the other columns join once at the end, by a number each row gets at the start.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "connect-by")
    whole = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "hierarchy").withColumn("_start", start)
    base = list(dict.fromkeys(["_row", id, parent, *([path] if path else []), *([siblings] if siblings else [])]))

    def extended(rows: DataFrame, level: Column, text: Column, ids: Column, key: Column) -> DataFrame:
        extra = [level.cast("int").alias("level"), ids.alias("_ids")]
        if path:
            extra.append(text.alias("path"))
        if siblings:
            extra.append(key.alias("sibling_key"))
        return rows.select(*[F.col(f"c.{c}") for c in base], *extra)

    def own(c: str) -> Column:
        return F.col(f"c.{c}")

    def step_text() -> Column:
        return F.concat(F.lit(sep), F.coalesce(own(path).cast("string"), F.lit(""))) if path else F.lit("")

    def step_key() -> Column:
        # NULL sort values come last, as in an Oracle ascending order
        return F.array(F.struct(own(siblings).isNull().alias("n"), own(siblings).alias("s"), own(id).alias("i"))
                       if siblings else F.lit(0))

    table = whole.select(*base).alias("c")
    level_df = extended(whole.filter("_start").select(*base).alias("c"), F.lit(1), step_text(), F.array(own(id)), step_key())
    depth, schema = 1, level_df.schema
    while True:
        level_df.write.parquet(f"{folder}/depth={depth}")
        stored = spark.read.schema(schema).parquet(f"{folder}/depth={depth}")
        rows = stored.count()
        if rows == 0 or (max_depth is not None and depth >= max_depth):
            break
        kept = ["level", "_ids", *(["path"] if path else []), *(["sibling_key"] if siblings else [])]
        above = stored.select(F.col(id).alias("_above"), *kept).alias("p")
        joined = table.join(maybe_broadcast(above), F.col(f"c.{parent}") == F.col("p._above"))
        seen = F.array_contains("p._ids", own(id))
        if nocycle:
            joined = joined.filter(~seen)
        else:
            joined = joined.filter(
                F.when(seen, F.raise_error(F.lit("CONNECT BY loop in data"))).otherwise(F.lit(True))
            )
        level_df = extended(
            joined, F.col("p.level") + 1,
            F.concat(F.col("p.path"), step_text()) if path else F.lit(""),
            F.concat("p._ids", F.array(own(id))),
            F.concat(F.col("p.sibling_key"), step_key()) if siblings else F.lit(0),
        )
        depth += 1
    levels = spark.read.schema(schema).parquet(*[f"{folder}/depth={d}" for d in range(1, depth + 1)])
    added = ["level", *(["path"] if path else []), *(["sibling_key"] if siblings else [])]
    return whole.drop("_start").join(levels.select("_row", *added), "_row").select(*df.columns, *added)


# Moving rows up to which a hierarchy is followed as it is; longer ones are contracted first.
CONTRACT_FROM = 1_000_000


def _contract(moving: DataFrame, join_up, least: int) -> tuple[list[DataFrame], DataFrame]:
    """The moving rows of each round before it, and those left after the last.

    In a round each id draws a coin, a hash of id and round.  A row with heads under one with tails is taken out, and the rows below it take over its pointer: a quarter
    of the rows each time, whatever the shape of the hierarchy, so all rounds together shuffle and store a few times the rows.
    """
    rounds = []
    left = moving.count()
    while left > least:
        out, under = _taken_out(len(rounds)), _heads("_up", len(rounds))
        jumped = join_up(moving.filter(~out & under), moving.filter(out))
        after = materialize(moving.filter(~out & ~under).unionByName(jumped), "contracted")
        rounds.append(moving)
        moving, before, left = after, left, after.count()
        if left > 0.9 * before:  # circles that are one row long by now
            break
    return rounds, moving


def _heads(c: str, number: int) -> Column:
    return F.xxhash64(F.col(c), F.lit(number)).bitwiseAND(F.lit(1)) == 1


def _taken_out(number: int) -> Column:
    return _heads("_id", number) & ~_heads("_up", number)


def connect_by_doubling(df: DataFrame, id: str, parent: str, start: Column, path: str | None = None, sep: str = "/", nocycle: bool = False,
                        siblings: str | None = None, contract_from: int = CONTRACT_FROM) -> DataFrame:
    """``connect_by`` for deep hierarchies in which every row has one place: rounds grow with the logarithm of the depth, what they move with the rows.

    Each row points at its parent, with the distance, the names and the sort keys of the way.  Rows in the middle of the way are taken out, a quarter in each round, until at most
    ``contract_from`` are left.  Then in a round every pointer is replaced by the pointer it points at (jumps of 1, 2, 4, ... levels) until it stands on a start row or ends above, and the
    rows taken out get their places from the rows they pointed at, last ones first.  Adds ``level`` and ``root`` (the start row's id), ``path`` and ``sibling_key``
    as ``connect_by`` does.  A start row met again below itself is an error, or left out with ``nocycle``; rows on a circle without a start row belong to no tree.

    Ids must be unique and no start row may lie below another one (rows would have two places): both are checked and are errors.  Rows without an id
    can be neither parent nor start.  The children of one parent share a join key: every round is stored, so the adaptive join can split them.
    """
    whole = materialize(df, "hierarchy")
    name = F.concat(F.lit(sep), F.coalesce(F.col(path).cast("string"), F.lit(""))) if path else None
    key = F.array(F.struct(F.col(siblings).isNull().alias("n"), F.col(siblings).alias("s"), F.col(id).alias("i"))) if siblings else None
    way = ([name.alias("_path")] if path else []) + ([key.alias("_key")] if siblings else [])  # what a pointer says besides its length
    is_start = F.coalesce(start, F.lit(False))
    rows = whole.select(F.col(id).alias("_id"), F.col(parent).alias("_up"), is_start.alias("_start"), *way)
    ways = rows.columns[3:]
    ids = rows.filter("_id IS NOT NULL")
    total, different = ids.count(), ids.groupBy("_id").count().count()
    if total != different:
        raise ValueError("connect_by_doubling needs unique ids; use connect_by")

    def join_up(below: DataFrame, above: DataFrame, how: str = "left", found: bool = False) -> DataFrame:
        """``below`` with the pointers of the rows it points at, or with their places (``found``); without such a row a pointer stays."""
        theirs = above.select(F.col("_id").alias("_above"), F.col("_root" if found else "_up").alias("_next"), F.col("_level").alias("_far"),
                              *[F.col(w).alias(f"{w}_far") for w in ways])
        after = [F.when(F.col("_above").isNull(), F.col(w)).otherwise(F.concat(f"{w}_far", w)).alias(w) for w in ways]
        return below.join(theirs, F.col("_up") == F.col("_above"), how).select(
            "_id", (F.col("_next").alias("_root") if found else F.coalesce("_next", "_up").alias("_up")),
            (F.col("_level") + F.coalesce("_far", F.lit(0))).alias("_level"), *after)

    # a start row stands on itself; the others on nothing yet
    fixed = ids.filter("_start").select("_id", F.col("_id").alias("_root"), F.lit(1).cast("long").alias("_level"), *ways)
    moving = ids.filter("NOT _start AND _up IS NOT NULL").select("_id", "_up", F.lit(1).cast("long").alias("_level"), *ways)
    types = whole.select(id, parent).schema
    rounds = []
    if types[0].dataType == types[1].dataType:  # equal values have equal hashes
        rounds, moving = _contract(moving, join_up, contract_from)
    state = fixed.withColumn("_up", F.lit(None).cast(types[1].dataType)).unionByName(moving.withColumn("_root", F.lit(None).cast(types[0].dataType)))
    state = materialize(state, "pointers")
    for _ in range(max(1, total).bit_length() + 1):
        jumping = state.filter("_up IS NOT NULL")
        if jumping.limit(1).count() == 0:
            break
        above = state.select(F.col("_id").alias("_above"), F.col("_up").alias("_next"), F.col("_root").alias("_their"), F.col("_level").alias("_far"),
                             *[F.col(w).alias(f"{w}_far") for w in ways])
        jumped = jumping.join(above, F.col("_up") == F.col("_above"), "left").select(
            "_id", F.col("_next").alias("_up"), F.col("_their").alias("_root"), (F.col("_level") + F.coalesce("_far", F.lit(0))).alias("_level"),
            *[F.when(F.col("_above").isNull(), F.col(w)).otherwise(F.concat(f"{w}_far", w)).alias(w) for w in ways])
        state = materialize(state.filter("_up IS NULL").unionByName(jumped), "pointers")
    placed = state.filter("_up IS NULL AND _root IS NOT NULL").drop("_up")
    for number in reversed(range(len(rounds))):
        back = join_up(rounds[number].filter(_taken_out(number)), placed.filter(~_heads("_id", number)), "inner", found=True)
        placed = placed.unionByName(materialize(back, "placed"))
    # where a start row's own parent has its place tells whether it is met again, below itself or below another start row
    starts = ids.filter("_start AND _up IS NOT NULL").select(F.col("_id").alias("_s"), F.col("_up").alias("_above"))
    if starts.limit(1).count():
        met = starts.join(placed.select(F.col("_id").alias("_above"), F.col("_root").alias("_their")), "_above").select(
            F.count_if(F.col("_their") == F.col("_s")).alias("loops"), F.count_if(F.col("_their") != F.col("_s")).alias("nested")).first()
        if met["nested"]:
            raise ValueError("a start row lies below another one; use connect_by")
        if met["loops"] and not nocycle:
            raise ValueError("CONNECT BY loop in data")
    names = ["level", "root", *(["path"] if path else []), *(["sibling_key"] if siblings else [])]

    def with_places(these: DataFrame, at: str, level: Column, ways_to: list[Column]) -> DataFrame:
        added = [v.alias(n) for n, v in zip(names, [level.cast("int"), F.col("_root"), *ways_to])]
        return these.join(placed, F.col(at) == F.col("_id")).select(*df.columns, *added)

    # rows without an id stand below their parent, whoever they are
    nameless = whole.filter(F.col(id).isNull() & ~is_start)
    own = with_places(whole.filter(F.col(id).isNotNull()), id, F.col("_level"), [F.col(w) for w in ways])
    if nameless.limit(1).count() == 0:
        return own
    last = ([name] if path else []) + ([key] if siblings else [])
    return own.union(with_places(nameless, parent, F.col("_level") + 1, [F.concat(w, x) for w, x in zip(ways, last)]))
