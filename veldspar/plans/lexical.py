"""Queries over statements in which quotes, comments, slashes and names are easily misread."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions.spans import spans
from veldspar.operators import inventory, rules, statements
from veldspar.operators.rule_table import default_rules
from veldspar.plans import script_fixture as fx
from veldspar.plans.registry import query
from veldspar.plans.script_fixture import ODD_SQL, per_template


def odd(spark, d):
    return statements.split_statements(fx.odd_scripts(spark, d))


# Lines of each template, the line that ends it included.
_LINES = per_template({0: [(2, "SELECT")], 1: [(2, "CREATE_TABLE")], 2: [(6, "SELECT")], 3: [(2, "CREATE_TABLE")], 4: [(4, "BEGIN_BLOCK")],
                       5: [(5, "CREATE_FUNCTION")], 6: [(1, "CREATE_SYNONYM")]}, "tid, lines, stmt_type")


@query("split_odd", f"""
WITH {ODD_SQL} SELECT file_id, stmt_no, 1 + CAST(coalesce(sum(lines) OVER
  (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stmt_line, stmt_type, stmt AS text
FROM stmts JOIN {_LINES} USING (tid)
""")
def split_odd(spark, d):
    return odd(spark, d).drop("leading_comment")


_SPANS = {
    0: [("literal", "q'[it's {k}; SYSDATE]'"), ("literal", "nq'!x;'y!'"), ("literal", "'z'")],
    1: [("name", '"a; -- b"'), ("literal", "','")],
    2: [("literal", "'MINUS'"), ("line_comment", "-- SYSDATE; {k}"), ("block_comment", "/* NVL(x, {k}) */"), ("name", '"DATE"'), ("literal", "'NVL('")],
    4: [("literal", "'end;'"), ("literal", "q'{begin}'")], 5: [("name", '"P; Out"'), ("literal", "q'<;'>'")], 6: [("name", '"Syn {k}"')]}


@query("token_spans", f"""
WITH {ODD_SQL}, e AS (SELECT k, kind, stmt, replace(piece, '{{k}}', k::VARCHAR) AS piece FROM stmts JOIN {per_template(_SPANS, "tid, kind, piece")} USING (tid))
SELECT k, kind, CAST(strpos(stmt, piece) AS BIGINT) AS start, CAST(strpos(stmt, piece) + length(piece) AS BIGINT) AS stop FROM e
""")
def token_spans(spark, d):
    """What is not code: literals, names and comments with their places."""
    rows = fx.odd_keys(spark, d).select("k", F.explode(spans(F.col("stmt"))).alias("s"))
    return rows.select("k", "s.*").filter("kind <> 'open'")


@query("columns_odd", f"""
WITH {ODD_SQL} SELECT file_id, stmt_no, replace(t, '{{k}}', k::VARCHAR) AS table_name, position, column_name, data_type, "precision", default_value
FROM stmts JOIN {per_template({
    1: [("emp$audit_{k}", 1, "note#", "VARCHAR2", "20", None), ("emp$audit_{k}", 2, "a; -- b", "NUMBER", "5", None),
        ("emp$audit_{k}", 3, "made", "DATE", None, "SYSDATE"), ("emp$audit_{k}", 4, "rate", "NUMBER", None, "f(1, ',')")],
    3: [("open_{k}", 1, "a", "NUMBER", None, None), ("open_{k}", 2, "b", "VARCHAR2", "5", None), ("open_{k}", 3, "c", "DATE", None, None)],
}, 'tid, t, position, column_name, data_type, "precision", default_value')} USING (tid)
""")
def columns_odd(spark, d):
    return inventory.columns(odd(spark, d)).drop("scale", "nullable", "is_primary_key")


@query("parameters_odd", f"""
WITH {ODD_SQL} SELECT file_id, stmt_no, 'f$_' || k AS routine, position, parameter, direction, data_type
FROM stmts CROSS JOIN (VALUES (0, NULL, 'RETURN', 'NUMBER'), (1, 'p_in#', 'IN', 'NUMBER'), (2, 'P; Out', 'OUT', 'VARCHAR2')) p(position, parameter, direction, data_type)
WHERE tid = 5
""")
def parameters_odd(spark, d):
    return inventory.parameters(odd(spark, d)).drop("default_value")


@query("list_errors", f"""
WITH {ODD_SQL} SELECT file_id, stmt_no, 'TABLE' AS kind, 'list never ends' AS error FROM stmts WHERE tid = 3
""")
def list_errors(spark, d):
    return inventory.list_errors(odd(spark, d)).drop("stmt_line")


_REWRITTEN = {
    0: "SELECT q'[it's {k}; SYSDATE]' AS a, nq'!x;'y!' AS b, N'z'",
    1: "CREATE TABLE emp$audit_{k} (note# VARCHAR(20), \"a; -- b\" NUMERIC(5), made TIMESTAMP DEFAULT CURRENT_TIMESTAMP, rate NUMERIC DEFAULT f(1, ','))",
    2: "SELECT a\n  / b, 'MINUS' -- SYSDATE; {k}\nFROM t /* NVL(x, {k}) */\nEXCEPT\nSELECT \"DATE\", COALESCE(c, 'NVL(') FROM u",
    3: "CREATE TABLE open_{k} (a NUMERIC, b VARCHAR(5), c TIMESTAMP",
    4: fx.ODD_TEMPLATES[4],
    5: "CREATE OR REPLACE FUNCTION f$_{k}(p_in# IN NUMERIC, \"P; Out\" OUT VARCHAR2) RETURNS NUMERIC\nAS $$\nDECLARE\nBEGIN\n  RETURN LENGTH(q'<;'>');\nEND;",
    6: "CREATE SYNONYM \"Syn {k}\" FOR hr.emp$audit",
}


@query("rewrite_odd", f"""
WITH {ODD_SQL} SELECT file_id, stmt_no, replace(x, '{{k}}', k::VARCHAR) AS new_text
FROM stmts JOIN {per_template({t: [(x,)] for t, x in _REWRITTEN.items()}, "tid, x")} USING (tid)
""")
def rewrite_odd(spark, d):
    return rules.rewrite(odd(spark, d), default_rules()).select("file_id", "stmt_no", "new_text")
