"""Queries that write script files to the shared folder and read them back, in one piece, by ranges and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.plans import script_fixture as fx
from veldspar.plans.registry import query
from veldspar.plans.rules import _NEW_SQL, LEDGER_SQL
from veldspar.plans.script_fixture import STATEMENTS_SQL
from veldspar.plans.scripts import _KNOWN_SQL
from veldspar.session import shared_folder
from veldspar.sources.large_scripts import split_archive
from veldspar.sources.scripts import read_scripts, write_scripts
from veldspar.streaming.scripts import stream_scripts

# Scripts of 5,000 statements and of 500 in turn; the former are above this many bytes, the latter below.
LARGEST = 200_000
_FILES_SQL = STATEMENTS_SQL + """, placed AS (SELECT *, CASE WHEN k // 5000 % 2 = 0 THEN 'big_' || k // 5000 ELSE 'small_' || k // 500 END AS name FROM stmts),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY k) AS INTEGER) AS no FROM placed)"""


def script_files(spark, d) -> str:
    """The folder of the written scripts: one text file per script, the name is that of its folder."""
    key = F.col("k")
    name = F.when(F.floor(key / 5000) % 2 == 0, F.concat(F.lit("big_"), F.floor(key / 5000).cast("string"))).otherwise(
        F.concat(F.lit("small_"), F.floor(key / 500).cast("string")))
    ended = F.concat("stmt", F.when(F.col("tid").isin(*fx.BLOCK_TEMPLATES), "\n/").otherwise(";"))
    pieces = F.array_sort(F.collect_list(F.struct("k", ended.alias("p"))))
    text = F.array_join(F.transform(pieces, lambda s: s["p"]), "\n")
    scripts = fx.statements(spark, d).groupBy(name.alias("path")).agg(text.alias("text"))
    folder = shared_folder(spark, "script-files")
    write_scripts(scripts, folder, suffix="")
    return folder


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name", F.regexp_extract("path", r"out_name=([^/.]+)", 1)).drop("path")


@query("script_files", f"""
WITH {_FILES_SQL} SELECT name, string_agg(stmt || CASE WHEN tid IN (7, 8) THEN chr(10) || '/' ELSE ';' END, chr(10) ORDER BY k) || chr(10) AS text
FROM numbered GROUP BY name
""")
def read_back(spark, d):
    """Scripts as they were written."""
    return _named(read_scripts(spark, script_files(spark, d), exts=(".txt",))).select("name", "text")


@query("unreadable_files", f"""
WITH {_FILES_SQL} SELECT DISTINCT name, name LIKE 'big%' AS failed FROM numbered
""")
def unreadable_files(spark, d):
    """Files larger than a row may be become rows with an error."""
    folder = script_files(spark, d)
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength", None)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(LARGEST))
    try:
        rows = _named(read_scripts(spark, folder, exts=(".txt",), on_unreadable="row"))
        from veldspar.session import materialize

        return materialize(rows.select("name", (F.col("text").isNull() & F.col("error").isNotNull()).alias("failed")), "read-errors")
    finally:
        if old is None:
            spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        else:
            spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)


@query("split_archive", f"""
WITH {_FILES_SQL} SELECT name, no AS stmt_no, 1 + skip + CAST(coalesce(sum(lines) OVER
  (PARTITION BY name ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stmt_line, stmt_type,
  replace(comment, '{{k}}', k::VARCHAR) AS leading_comment,
  substr(stmt, CASE WHEN comment = '' THEN 1 ELSE length(replace(comment, '{{k}}', k::VARCHAR)) + 2 END) AS text
FROM numbered JOIN {_KNOWN_SQL} USING (tid)
""")
def split_files(spark, d):
    """Small scripts within their row, large ones by ranges of lines."""
    return _named(split_archive(spark, script_files(spark, d), LARGEST, exts=(".txt",)))


@query("script_stream", f"""
WITH {_FILES_SQL} SELECT name, no AS stmt_no, replace(new_text, '{{k}}', k::VARCHAR) AS new_text, coalesce(n, 0) AS findings FROM numbered JOIN {_NEW_SQL} USING (tid)
LEFT JOIN (SELECT k, count(*) AS n FROM stmts JOIN {LEDGER_SQL} USING (tid) GROUP BY k) USING (k)
""")
def script_stream(spark, d):
    """The files as a stream that ends when all of them are done: rewritten statements beside the number of their findings."""
    out, seen = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-checkpoint")
    stream_scripts(spark, script_files(spark, d), out, seen, exts=(".txt",)).awaitTermination()
    done = _named(spark.read.parquet(f"{out}/statements")).select("name", "stmt_no", "new_text")
    found = _named(spark.read.parquet(f"{out}/findings")).groupBy("name", "stmt_no").agg(F.count("*").alias("findings"))
    return done.join(found, ["name", "stmt_no"], "left").select(
        "name", F.col("stmt_no").cast("int").alias("stmt_no"), "new_text", F.coalesce("findings", F.lit(0)).alias("findings"))
