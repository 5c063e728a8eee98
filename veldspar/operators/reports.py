"""Roll-ups of findings and the composed output of a script."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.inventory import CREATE, OBJECT_KINDS, OBJECT_TYPES, QUALIFIED
from veldspar.operators.rule_table import SEVERITIES, Rule
from veldspar.operators.rules import rewrite_sql, rule_facts, rules_list
from veldspar.operators.skew import lookup_join
from veldspar.operators.statements import classify, statement_structs
from veldspar.session import materialize


def _severity_counts() -> list[Column]:
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    return [*counts, F.count(F.lit(1)).alias("total")]


def file_counts(findings: DataFrame) -> DataFrame:
    """Findings per file by severity, with the total."""
    return findings.groupBy("file_id").agg(*_severity_counts())


def category_matrix(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(*_severity_counts())


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def run_totals(files: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: files, changes by severity, errors; each part is reduced per task first."""
    parts = [
        files.agg(F.count_distinct("file_id").alias("files")),
        findings.agg(*_severity_counts()).withColumnRenamed("total", "changes"),
        errors.agg(F.count(F.lit(1)).alias("errors")),
    ]
    names = ["files", "changes", *[s.lower() for s in SEVERITIES], "errors"]
    lined_up = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return lined_up.agg(*[F.sum(n).alias(n) for n in names])


def run_totals_of(scripts: DataFrame, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    """``run_totals`` of scripts in one pass: every script is split, rewritten and counted within its row, and the counts are summed.

    Errors are CREATE statements without a name that can be read.
    """
    ruleset = rules_list(rules)
    typed = statement_structs(scripts).withColumn("_typed", F.transform(
        "statements", lambda s: F.struct(s["text"].alias("text"), classify(s["text"]).alias("kind"))))
    done = typed.withColumn("_ledger", F.expr(f"flatten(transform(_typed, s -> ({rewrite_sql('s.text', 's.kind', ruleset)}).ledger))"))
    numbers = {s: [i for i, r in enumerate(ruleset) if (r.severity_override or r.severity) == s] for s in SEVERITIES}

    def count(severity: str) -> Column:
        listed = F.array(*map(F.lit, numbers[severity])).cast("array<int>")
        return F.size(F.filter("_ledger", lambda i: F.array_contains(listed, i)))

    head = rf"(?i){CREATE}{OBJECT_KINDS}\s+{QUALIFIED}"
    nameless = F.filter("_typed", lambda s: s["kind"].isin(OBJECT_TYPES) & (F.regexp_extract(s["text"], head, 3) == ""))
    rows = done.select("file_id", F.size("_ledger").alias("changes"), *[count(s).alias(s.lower()) for s in SEVERITIES], F.size(nameless).alias("errors"))
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("changes", *[s.lower() for s in SEVERITIES], "errors")]
    return rows.agg(F.count_distinct("file_id").alias("files"), *totals)


def review_items(findings: DataFrame) -> DataFrame:
    """Findings that need a person."""
    return findings.filter(F.col("severity").isin("REVIEW", "MANUAL"))


def file_details(findings: DataFrame) -> DataFrame:
    """Findings beside the counts of their file, one row per finding.

    The findings are stored once: they are counted per file and read again for the rows.
    """
    once = materialize(findings, "findings")
    return lookup_join(once, file_counts(once), ["file_id"], "inner")


def findings_flat(findings: DataFrame) -> DataFrame:
    """The seven report columns."""
    return findings.select(
        F.col("file_id").alias("file"), "rule_id", "category", "severity", "description",
        F.coalesce(F.col("message"), F.col("description")).alias("description_local"),
        F.col("stmt_line").alias("line"))


RULE = "-- " + "=" * 70


def compose_output(scripts: DataFrame, rules: DataFrame | Iterable[Rule], as_of: datetime,
                   name: str = "file_id") -> DataFrame:
    """The rewritten script of each file: header with counts, change summary, statements.

    Splitting, rewriting and composing all happen inside the file's row, so a whole archive passes
    through without a shuffle.
    """
    ruleset = rules_list(rules)
    facts = rule_facts(ruleset)
    split = statement_structs(scripts)
    typed = split.withColumn("_typed", F.transform(
        "statements", lambda s: F.struct(s["text"].alias("text"), classify(s["text"]).alias("kind"))))
    done = typed.withColumn("_done", F.expr(f"transform(_typed, s -> {rewrite_sql('s.text', 's.kind', ruleset)})"))
    applied = done.withColumn("_ids", F.flatten(F.transform("_done", lambda x: x["ledger"])))
    counted = applied.withColumn("_found", F.transform("_ids", lambda i: F.element_at(facts, i + 1)))

    def count(severity: str) -> Column:
        return F.size(F.filter("_found", lambda f: f["severity"] == severity)).cast("string")

    header = F.concat(
        F.lit(f"{RULE}\n-- Source: "), F.col(name).cast("string"),
        F.lit(f"\n-- Generated: {as_of:%Y-%m-%d %H:%M:%S}\n-- Auto-converted: "), count("AUTO"),
        F.lit(" | Review needed: "), count("REVIEW"), F.lit(" | Manual: "), count("MANUAL"), F.lit(f"\n{RULE}\n"))
    changes = F.array_join(F.transform("_found", lambda f: F.concat(
        F.lit("--   ["), f["severity"], F.lit("] ["), f["category"], F.lit("] "), f["description"])), "\n")
    summary = F.when(F.size("_found") > 0, F.concat(F.lit("-- Migration Changes:\n"), changes, F.lit(f"\n{RULE}\n"))).otherwise("")
    body = F.array_join(F.transform("_done", lambda x: F.concat(x["text"], F.lit(";"))), "\n\n")
    kept = [c for c in scripts.columns if c != "text"]
    return counted.select(*kept, F.concat(header, summary, body).alias("text"))
