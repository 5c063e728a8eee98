"""Join shapes: (+) outer joins, semi and anti joins, version compare, single-row lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.skew import lookup_join, maybe_broadcast, unique_or_raise
from veldspar.session import materialize


def plus_join(a: DataFrame, b: DataFrame, on, optional: str = "right") -> DataFrame:
    """``a.x = b.y(+)`` keeps all of ``a`` (optional='right'); ``a.x(+) = b.y`` keeps all of ``b``."""
    if optional not in ("left", "right"):
        raise ValueError("optional names the side marked with (+): 'left' or 'right'")
    return a.join(b, on, "left" if optional == "right" else "right")


def in_subquery(df: DataFrame, sub: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys IN (subquery)``: each row of ``df`` at most once."""
    return lookup_join(df, sub.select(*keys).distinct(), keys, "left_semi")


def not_in_keys(df: DataFrame, ref: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with no partner in ``ref`` (NULL keys have none)."""
    return lookup_join(df, ref.select(*keys).distinct(), keys, "left_anti")


def compare_versions(old: DataFrame, new: DataFrame, key: Sequence[str],
                     cols: Sequence[str]) -> DataFrame:
    """Pair two versions of a keyed table: key, change, and old_/new_ value of each column.

    ``change`` is INSERT, DELETE, UPDATE or SAME.  A key that occurs twice in a version is an error; the count shuffles as
    the join needs it.  Rows without a whole key match nothing and stay out of the join.
    """
    key, cols = list(key), list(cols)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    stray = [v.filter(~whole) for v in (old, new)]
    old, new = (unique_or_raise(v.filter(whole).select(*key, *cols), key, "a version holds a key twice") for v in (old, new))
    left = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("_in_old"))
    right = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in cols], F.lit(True).alias("_in_new"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = (
        F.when(F.col("_in_old").isNull(), "INSERT")
        .when(F.col("_in_new").isNull(), "DELETE")
        .when(same, "SAME")
        .otherwise("UPDATE")
    )
    pairs = left.join(right, key, "full").withColumn("change", change).drop("_in_old", "_in_new")
    gone = stray[0].select(*key, *[F.col(c).alias(f"old_{c}") for c in cols], F.lit("DELETE").alias("change"))
    come = stray[1].select(*key, *[F.col(c).alias(f"new_{c}") for c in cols], F.lit("INSERT").alias("change"))
    return pairs.unionByName(gone, allowMissingColumns=True).unionByName(come, allowMissingColumns=True)


# Rows of one bucket of keys when versions are compared by digests, and the most buckets there are.
DIGEST_ROWS, MOST_BUCKETS = 4, 1 << 20


def differing_rows(old: DataFrame, new: DataFrame, key: Sequence[str], cols: Sequence[str], buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of both versions in key buckets that differ; all rows of other buckets are the same in both.

    Each side is reduced to one line per bucket: its number of rows and two sums of row hashes, in whatever order the rows come.  Only these lines are shuffled
    and compared; the rows of equal buckets are dropped where they are read.
    """
    key, cols = list(key), list(cols)
    if buckets is None:
        rows = max(old.count(), new.count())
        buckets = max(1, min(MOST_BUCKETS, rows // DIGEST_ROWS))
    place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    value = [*key, *cols]
    # null and empty values hash alike, so their places are hashed too
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in value])
    sums = [F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64(*value, nulls), F.xxhash64(F.lit(17), nulls, *reversed(value)))]

    def digests(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(place.alias("_bucket")).agg(F.count(F.lit(1)).alias(f"{name}n"), sums[0].alias(f"{name}a"), sums[1].alias(f"{name}b"))

    both = digests(old, "o").join(digests(new, "n"), "_bucket", "full")
    differ = both.filter(~(F.col("on").eqNullSafe(F.col("nn")) & F.col("oa").eqNullSafe(F.col("na")) & F.col("ob").eqNullSafe(F.col("nb")))).select("_bucket")
    differ = maybe_broadcast(materialize(differ, "differing-buckets"))
    return tuple(v.withColumn("_bucket", place).join(differ, "_bucket", "left_semi").drop("_bucket") for v in (old, new))


def changed_rows(old: DataFrame, new: DataFrame, key: Sequence[str], cols: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``compare_versions`` without the SAME rows, for versions that are mostly the same: what is shuffled grows with the changes, not with the tables."""
    before, after = differing_rows(old.select(*key, *cols), new.select(*key, *cols), key, cols, buckets)
    return compare_versions(before, after, key, cols).filter("change <> 'SAME'")


def lookup_one(df: DataFrame, ref: DataFrame, keys: Sequence[str], cols: Sequence[str],
               status: str = "lookup_status") -> DataFrame:
    """SELECT ... INTO per row: the single matching row's columns, with FOUND or NO_DATA_FOUND.

    More than one matching row is an error, as TOO_MANY_ROWS is.
    """
    keys, cols = list(keys), list(cols)
    single = unique_or_raise(ref.select(*keys, *cols), keys, "TOO_MANY_ROWS: lookup key is not unique")
    single = single.withColumn(status, F.lit("FOUND"))
    joined = lookup_join(df, single, keys, "left")
    return joined.withColumn(status, F.coalesce(status, F.lit("NO_DATA_FOUND")))


def map_schema(df: DataFrame, mapping: Mapping[str, str], schema: str = "schema_name",
               name: str = "object_name", target: str = "target_name") -> DataFrame:
    """Schema-name lookup: listed schemas are renamed, others are dropped from the name."""
    from itertools import chain

    pairs = [F.lit(x) for x in chain(*((k.upper(), v) for k, v in mapping.items()))]
    new_schema = F.create_map(*pairs)[F.upper(schema)] if pairs else F.lit(None).cast("string")
    return df.withColumn(
        target,
        F.when(new_schema.isNotNull(), F.concat_ws(".", new_schema, F.col(name))).otherwise(F.col(name)),
    )


def localize(df: DataFrame, messages: DataFrame, lang: str, key: str = "message_key",
             name: str = "message") -> DataFrame:
    """Message text in ``lang``, else English, else ``[key]``.  ``messages(message_key, lang, text)``."""
    texts = (
        messages.filter(F.col("lang").isin(lang, "en"))
        .groupBy(F.col("message_key").alias(key))
        .agg(
            F.max(F.when(F.col("lang") == lang, F.col("text"))).alias("_own"),
            F.max(F.when(F.col("lang") == "en", F.col("text"))).alias("_en"),
        )
    )
    chosen = F.coalesce("_own", "_en", F.concat(F.lit("["), F.col(key), F.lit("]")))
    return lookup_join(df, texts, [key], "left").withColumn(name, chosen).drop("_own", "_en")
