"""Reading script files into a table, and writing rewritten scripts, findings and snapshots."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings of SQL and PL/SQL scripts.
EXTENSIONS = (".sql", ".pls", ".pkb", ".pks", ".trg", ".vw", ".fnc", ".prc")


def any_case_glob(exts: Iterable[str]) -> str:
    """Glob that matches file names with one of the endings in any letter case."""
    def letters(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*{" + ",".join(letters(e) for e in exts) + "}"


def decoder(encoding: str):
    """Bytes to text in batches, undecodable bytes replaced."""
    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return decode


def read_scripts(spark: SparkSession, path: str, exts: Iterable[str] = EXTENSIONS, encoding: str = "utf-8",
                 on_unreadable: str = "fail", largest: int | None = None) -> DataFrame:
    """Script table (file_id, path, text, error) of a directory tree.

    Endings are matched while listing, so other files are never opened.  UTF-8 stays in the JVM;
    other encodings go through Arrow batches.  With ``on_unreadable='row'`` a file that is too large
    or cannot be read becomes a row with NULL text and an error; this needs a second pass over the
    bytes.  Files of more than ``largest`` bytes are left to ``large_scripts``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case_glob(exts))
    files = reader.load(path)
    if largest is not None:
        files = files.filter(F.col("length") <= largest)  # applied before a file is opened
    if on_unreadable == "row":
        most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
        lenient = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path)
        lenient = lenient.filter(F.col("length") <= most)  # applied before a file is opened
        opened = lenient.select("path", F.octet_length("content").alias("_bytes")).filter("_bytes >= 0").select("path")
        broken = files.select("path").join(opened, "path", "left_anti").select(
            F.sha2("path", 256).alias("file_id"), "path", F.lit(None).cast("string").alias("text"),
            F.lit("file could not be read").alias("error"))
        return decoded(lenient, encoding).unionByName(broken)
    return decoded(files, encoding)


def decoded(files: DataFrame, encoding: str) -> DataFrame:
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        text = F.make_valid_utf8(F.col("content").cast("string"))
    else:
        text = decoder(encoding)(F.col("content"))
    return files.select(F.sha2("path", 256).alias("file_id"), "path", text.alias("text"),
                        F.lit(None).cast("string").alias("error"))


def output_name(path_column: str, suffix: str = "_pg"):
    """File name with the suffix before its ending (``.sql`` if it has none)."""
    base = F.regexp_extract(path_column, r"([^/\\]*)$", 1)
    ending = F.regexp_extract(base, r"(\.[^.]+)$", 1)
    stem = F.substring(base, F.lit(1), F.char_length(base) - F.char_length(ending))
    return F.concat(stem, F.lit(suffix), F.when(ending == "", ".sql").otherwise(ending))


def relative_name(path_column: str, root: str = "", suffix: str = "_pg"):
    """``output_name`` behind the folders the file has below ``root``, so that equal names in different folders stay apart."""
    folder = F.regexp_extract(path_column, r"^(.*[/\\])[^/\\]*$", 1)
    below = F.when(F.startswith(folder, F.lit(root)), F.substring(folder, F.lit(len(root) + 1), F.char_length(folder))).otherwise(folder)
    return F.concat(F.ltrim(below, F.lit("/\\")), output_name(path_column, suffix))


def write_scripts(scripts: DataFrame, out: str, suffix: str = "_pg", root: str = "") -> None:
    """One output directory per source file, named after its path below ``root`` (slashes escaped); ``scripts(path, text)``."""
    scripts.select(relative_name("path", root, suffix).alias("out_name"), "text").write.mode("overwrite").partitionBy(
        "out_name").option("lineSep", "\n").text(out)


FINDING_COLUMNS = {
    "file": "File", "rule_id": "Rule ID", "category": "Category", "severity": "Severity",
    "description": "Description", "description_local": "Description (local)", "line": "Line"}


def write_findings_csv(findings_flat: DataFrame, out: str) -> None:
    """The seven report columns with a header line."""
    findings_flat.select(*[F.col(c).alias(h) for c, h in FINDING_COLUMNS.items()]).write.mode("overwrite").option(
        "header", True).option("escape", '"').csv(out)


def snapshot(df: DataFrame, out: str, run_ts: str) -> None:
    """Keep the source rows as they were before a rewrite, by run."""
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(out)
