"""New script files only: each file is split, rewritten and reported once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veldspar.operators.rule_table import Rule, default_rules
from veldspar.operators.rules import findings_of, rewrite
from veldspar.operators.statements import split_statements
from veldspar.session import materialize
from veldspar.sources.scripts import EXTENSIONS, any_case_glob, decoded


def stream_scripts(spark: SparkSession, path: str, out: str, checkpoint: str,
                   rules: Iterable[Rule] | None = None, exts: Iterable[str] = EXTENSIONS, encoding: str = "utf-8") -> StreamingQuery:
    """Process the files that appeared since the last run, then stop.

    The file source remembers what it has read in ``checkpoint``.  Each batch replaces its own
    ``batch=<id>`` folder, so a batch repeated after a failure leaves one result.
    """
    ruleset = list(rules) if rules is not None else default_rules()
    files = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("recursiveFileLookup", True).option("pathGlobFilter", any_case_glob(exts)).load(path))
    scripts = decoded(files, encoding).drop("error")

    def write(batch: DataFrame, batch_id: int) -> None:
        done = materialize(rewrite(split_statements(batch), ruleset), "script-batch")  # read twice below
        done.drop("ledger").write.mode("overwrite").parquet(f"{out}/statements/batch={batch_id}")
        findings_of(done).write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}")

    return (scripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
