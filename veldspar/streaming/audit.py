"""Row trigger on a change stream: audit rows with the previous value of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldspar.operators.skew import lookup_join
from veldspar.operators.windows import old_new


class AuditState:
    """Last row per key in versioned folders under ``path``.

    A batch stores only the keys it touched (``delta=n``); every ``fold_every`` batches the deltas
    are folded into a ``base=n``.  Batch n reads what batches before it wrote and replaces its own
    folder, so repeating a batch reads the same state.
    """

    def __init__(self, path: str, key: Sequence[str], order: Sequence[str], fold_every: int = 16):
        self.path, self.key, self.order, self.fold_every = path, list(key), list(order), fold_every

    def latest(self, rows: DataFrame) -> DataFrame:
        """The last row of each key, as a combined maximum."""
        values = F.struct(*[F.col(c) for c in rows.columns if c not in self.key])
        last = rows.groupBy(*self.key).agg(F.max_by(values, F.struct(*self.order)).alias("v"))
        return last.select(*self.key, "v.*").select(*rows.columns)

    def read(self, like: DataFrame, batch_id: int) -> DataFrame:
        base = batch_id // self.fold_every * self.fold_every - 1
        folders = [f"{self.path}/delta={i}" for i in range(base + 1, batch_id)]
        if base >= 0:
            folders.append(f"{self.path}/base={base}")
        if not folders:
            return like.limit(0)
        return self.latest(like.sparkSession.read.schema(like.schema).parquet(*folders))

    def write(self, changes: DataFrame, batch_id: int) -> None:
        self.latest(changes).write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")
        if batch_id % self.fold_every == self.fold_every - 1:
            whole = self.latest(self.read(changes, batch_id).unionByName(changes))
            whole.write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")


def split_late(batch: DataFrame, state: AuditState, batch_id: int, key: Sequence[str],
               order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that follow the stored last row of their key, and those that come too late to be given their old values."""
    key, order = list(key), list(order)
    last = state.read(batch.select(*dict.fromkeys([*key, *order, *[c for c in batch.columns if c not in key]])), batch_id)
    last = last.join(batch.select(*key).distinct(), key, "left_semi").select(*key, F.struct(*order).alias("_last"))
    placed = lookup_join(batch, last, key, "left")
    late = F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False))
    return placed.filter(~late).select(*batch.columns), placed.filter(late).select(*batch.columns)


def audit_batch(batch: DataFrame, state: AuditState, batch_id: int, key: Sequence[str],
                order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Audit rows of one batch; the state moves on by one version.

    Inside the batch the previous row of the key counts; its first row looks at the stored last one.
    """
    key, order, cols = list(key), list(order), list(cols)
    changes = batch.select(*dict.fromkeys([*key, *order, *cols]))
    touched = changes.select(*key).distinct()
    before = state.read(changes, batch_id).join(touched, key, "left_semi")
    before = before.select(*key, *[F.col(c).alias(f"_stored_{c}") for c in cols], F.lit(True).alias("_known"))
    marked = changes.withColumn("_here", F.lit(True))
    rows = lookup_join(old_new(marked, key, order, [*cols, "_here"]), before, key, "left")
    first = F.col("old__here").isNull()
    audit = rows.select(
        *changes.columns,
        F.when(first & F.col("_known").isNull(), "INSERT").otherwise("UPDATE").alias("action"),
        *[F.when(first, F.col(f"_stored_{c}")).otherwise(F.col(f"old_{c}")).alias(f"old_{c}") for c in cols])
    state.write(changes, batch_id)
    return audit


def stream_audit(changes: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str],
                 out: str, checkpoint: str, fold_every: int = 16) -> StreamingQuery:
    """Write audit rows of a change stream to ``out``; ``order`` is total within a key.

    Rows that arrive after a later row of their key was audited in an earlier batch go to ``late`` instead: their old value, and that of the row
    after them, would need the whole history.
    """
    state = AuditState(f"{out}/state", key, order, fold_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            changes = batch.select(*dict.fromkeys([*key, *order, *cols]))
            fresh, late = split_late(changes, state, batch_id, key, order)
            late.write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
            audit = audit_batch(fresh, state, batch_id, key, order, cols)
            audit.write.mode("overwrite").parquet(f"{out}/audit/batch={batch_id}")
        finally:
            batch.unpersist()

    return (changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
