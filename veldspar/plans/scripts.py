"""Queries over script tables: splitting, classification, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions.text import mask_sql, strip_hints
from veldspar.operators import inventory, joins, statements, windows
from veldspar.plans import script_fixture as fx
from veldspar.plans.registry import query
from veldspar.plans.script_fixture import SCRIPTS_SQL, STATEMENTS_SQL, per_template


def split(spark, d):
    return statements.split_statements(fx.scripts(spark, d))


@query("to_lines", f"""
WITH {SCRIPTS_SQL} SELECT file_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no,
       unnest(string_split(text, chr(10))) AS line FROM scripts
""")
def to_lines(spark, d):
    return statements.to_lines(fx.scripts(spark, d))


# Comment text before each template's statement, lines the template spans, and its statement type.
_KNOWN = {
    0: [("", 0, 1, "SELECT")], 1: [("-- order {k}; keyed", 1, 3, "CREATE_TABLE")], 2: [("", 0, 1, "CREATE_SEQUENCE")],
    3: [("", 0, 1, "SELECT")], 4: [("", 0, 3, "SELECT")], 5: [("", 0, 1, "CREATE_SYNONYM")], 6: [("", 0, 2, "SELECT")],
    7: [("-- routine {k}", 1, 10, "CREATE_PROCEDURE")], 8: [("", 0, 7, "CREATE_TRIGGER")],
    9: [("", 0, 1, "CREATE_INDEX")], 10: [("", 0, 1, "SELECT")], 11: [("", 0, 1, "SELECT")],
}
_KNOWN_SQL = per_template(_KNOWN, "tid, comment, skip, lines, stmt_type")


@query("split_statements", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, 1 + skip + CAST(coalesce(sum(lines) OVER
  (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stmt_line, stmt_type,
  replace(comment, '{{k}}', k::VARCHAR) AS leading_comment,
  substr(stmt, CASE WHEN comment = '' THEN 1 ELSE length(replace(comment, '{{k}}', k::VARCHAR)) + 2 END) AS text
FROM stmts JOIN {_KNOWN_SQL} USING (tid)
""")
def split_statements(spark, d):
    return split(spark, d)


@query("type_counts", f"""
WITH {STATEMENTS_SQL} SELECT stmt_type, count(*) AS n FROM stmts JOIN {_KNOWN_SQL} USING (tid) GROUP BY stmt_type
""")
def type_counts(spark, d):
    return split(spark, d).groupBy("stmt_type").agg(F.count(F.lit(1)).alias("n"))


# One example of every statement type.
TYPE_EXAMPLES = [
    ("CREATE_TABLE", "create global temporary table t (id NUMBER)"), ("CREATE_INDEX", "CREATE UNIQUE INDEX ix ON item (kind)"),
    ("CREATE_MATERIALIZED_VIEW", "CREATE MATERIALIZED VIEW m AS SELECT 1"),
    ("CREATE_VIEW", "CREATE OR REPLACE FORCE VIEW cheap AS SELECT 1"), ("CREATE_SEQUENCE", "CREATE SEQUENCE item_seq"),
    ("CREATE_SYNONYM", "CREATE OR REPLACE PUBLIC SYNONYM s FOR t"), ("CREATE_PACKAGE_BODY", "CREATE PACKAGE BODY p AS"),
    ("CREATE_PACKAGE", "CREATE OR REPLACE PACKAGE p AS"), ("CREATE_PROCEDURE", "CREATE PROCEDURE p IS"),
    ("CREATE_FUNCTION", "CREATE OR REPLACE FUNCTION f RETURN NUMBER IS"), ("CREATE_TRIGGER", "CREATE TRIGGER t BEFORE INSERT ON x"),
    ("CREATE_TYPE", "CREATE OR REPLACE TYPE t AS OBJECT (a NUMBER)"), ("CREATE_DATABASE_LINK", "CREATE PUBLIC DATABASE LINK l"),
    ("ALTER_TABLE", "ALTER TABLE item MODIFY kind NUMBER"), ("ALTER_INDEX", "ALTER INDEX i REBUILD"), ("ALTER_SEQUENCE", "ALTER SEQUENCE s CACHE 5"),
    ("DROP", "DROP VIEW cheap"), ("TRUNCATE", "TRUNCATE TABLE t"), ("COMMENT", "COMMENT ON TABLE t IS 'x'"),
    ("GRANT", "GRANT UPDATE ON item TO clerk"), ("REVOKE", "REVOKE SELECT ON t FROM u"), ("SELECT", "/* note */ select 1"),
    ("INSERT", "INSERT INTO item SELECT 1"), ("UPDATE", "UPDATE item SET kind = 2"), ("DELETE", "DELETE FROM item"), ("MERGE", "MERGE INTO t USING s"),
    ("DECLARE_BLOCK", "DECLARE x NUMBER"), ("BEGIN_BLOCK", "BEGIN NULL"), ("SET", "SET SERVEROUTPUT ON"), ("EXEC", "EXEC p(1)"),
    ("UNKNOWN", "-- only a comment"),
]
_EXAMPLES_SQL = per_template({i: [(t,)] for i, (t, _) in enumerate(TYPE_EXAMPLES)}, "i, stmt_type")


@query("classify", f"""
SELECT o_orderkey, stmt_type FROM orders JOIN {_EXAMPLES_SQL} ON i = o_orderkey % {len(TYPE_EXAMPLES)}
""")
def classify(spark, d):
    from veldspar.sources.tables import load

    i = (F.col("o_orderkey") % len(TYPE_EXAMPLES) + 1).cast("int")
    text = F.concat(F.element_at(F.array(*[F.lit(s) for _, s in TYPE_EXAMPLES]), i), F.lit(" /* "), "o_orderkey", F.lit(" */"))
    return load(spark, d, "orders").select("o_orderkey", statements.classify(text).alias("stmt_type"))


@query("mask_sql", f"""
WITH {STATEMENTS_SQL} SELECT k, replace(CASE tid
  WHEN 1 THEN replace(stmt, '-- order ' || k || '; keyed', ' ')
  WHEN 3 THEN replace(stmt, '/*+ INDEX(o ix) */', ' ')
  WHEN 6 THEN replace(replace(stmt, '''a;b''''SYSDATE''', ''''''), '''F''', '''''')
  WHEN 7 THEN replace(replace(stmt, '-- routine ' || k, ' '), '''x;y''', '''''')
  WHEN 11 THEN replace(stmt, ''', ''', '''''') ELSE stmt END, chr(9), ' ') AS masked FROM stmts
""")
def mask_sql_q(spark, d):
    return fx.statements(spark, d).select("k", mask_sql(F.col("stmt")).alias("masked"))


@query("strip_hints", f"""
WITH {STATEMENTS_SQL} SELECT k, replace(stmt, '/*+ INDEX(o ix) */', '/* Oracle hint removed */') AS text FROM stmts
""")
def strip_hints_q(spark, d):
    return fx.statements(spark, d).select("k", strip_hints(F.col("stmt")).alias("text"))


@query("block_depth", f"""
WITH {SCRIPTS_SQL}, lines AS (SELECT file_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no,
       unnest(string_split(text, chr(10))) AS line FROM scripts),
d AS (SELECT *, CASE WHEN regexp_matches(line, '^BEGIN$') THEN 1 WHEN regexp_matches(line, '^END (pr|tr)_') THEN -1 ELSE 0 END AS x FROM lines)
SELECT file_id, line_no, CAST(sum(x) OVER (PARTITION BY file_id ORDER BY line_no) AS BIGINT) AS depth FROM d
""")
def block_depth(spark, d):
    lines = statements.to_lines(fx.scripts(spark, d))
    return windows.running_depth(lines, ["file_id"], ["line_no"], statements.depth_change(F.col("line"))).select(
        "file_id", "line_no", "depth")


_OBJECTS = {
    1: [("TABLE", None, "t_{k}", None, None)], 2: [("SEQUENCE", None, "sq_{k}", None, None)],
    5: [("SYNONYM", None, "syn_{k}", "hr.orders", 1)], 7: [("PROCEDURE", None, "pr_{k}", None, None)],
    8: [("TRIGGER", None, "tr_{k}", None, None)], 9: [("INDEX", None, "ix_{k}", None, None)],
}
_OBJECTS_SQL = per_template(_OBJECTS, "tid, kind, schema_name, object_name, target, pub")


@query("objects", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, kind, schema_name::VARCHAR AS schema_name, replace(object_name, '{{k}}', k::VARCHAR) AS object_name,
       target, pub = 1 AS is_public FROM stmts JOIN {_OBJECTS_SQL} USING (tid)
""")
def objects(spark, d):
    return inventory.objects(split(spark, d)).drop("stmt_line")


_COLUMNS = {1: [
    (1, "id", "NUMBER", "10", 0, None), (2, "flag", "NUMBER", "1", 1, "1"), (3, "name", "VARCHAR2", "50", 1, None),
    (4, "made", "DATE", None, 1, "SYSDATE"), (5, "body", "CLOB", None, 1, None)]}


@query("columns", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, 't_' || k AS table_name, position, column_name, data_type, "precision", NULL::VARCHAR AS scale,
       nullable = 1 AS nullable, default_value, false AS is_primary_key
FROM stmts JOIN {per_template(_COLUMNS, 'tid, position, column_name, data_type, "precision", nullable, default_value')} USING (tid)
""")
def columns(spark, d):
    return inventory.columns(split(spark, d))


@query("constraints", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, 't_' || k AS table_name, c.n || k AS constraint_name, kind, 'id' AS columns,
       CASE WHEN n = 'fk_' THEN 'orders' END AS ref_table, CASE WHEN n = 'fk_' THEN 'o_orderkey' END AS ref_columns,
       NULL::VARCHAR AS condition
FROM stmts CROSS JOIN (VALUES ('pk_', 'PRIMARY KEY'), ('fk_', 'FOREIGN KEY')) c(n, kind) WHERE tid = 1
""")
def constraints(spark, d):
    return inventory.constraints(split(spark, d)).withColumns(
        {c: F.array_join(c, ",") for c in ("columns", "ref_columns")})


@query("parameters", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, 'pr_' || k AS routine, position, parameter, direction, data_type,
       NULL::VARCHAR AS default_value
FROM stmts CROSS JOIN (VALUES (1, 'p_id', 'IN', 'NUMBER'), (2, 'p_out', 'OUT', 'VARCHAR2')) c(position, parameter, direction, data_type)
WHERE tid = 7
""")
def parameters(spark, d):
    return inventory.parameters(split(spark, d))


def _packages(spark, d):
    """One package body per order: three members, one with a literal and a nested call."""
    body = ("CREATE OR REPLACE PACKAGE BODY pkg_{k} AS\n  PROCEDURE hire(p_name IN VARCHAR2, p_pay IN NUMBER DEFAULT f(1, 2)) IS\n"
            "  BEGIN\n    log('FUNCTION in text');\n  END hire;\n  -- PROCEDURE old_one\n  PROCEDURE fire IS BEGIN NULL; END fire;\n"
            "  FUNCTION head_count RETURN NUMBER IS\n  BEGIN\n    RETURN 0;\n  END head_count;\nEND pkg_{k};\n/\n")
    text = F.replace(F.lit(body), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    return fx.order_keys(spark, d).select(F.col("o_orderkey").alias("file_id"), text.alias("text"))


@query("package_members", """
SELECT o_orderkey AS file_id, 1 AS stmt_no, 'pkg_' || o_orderkey AS package, true AS is_body, position, kind, member_name
FROM orders CROSS JOIN (VALUES (1, 'PROCEDURE', 'hire'), (2, 'PROCEDURE', 'fire'), (3, 'FUNCTION', 'head_count'))
  m(position, kind, member_name)
""")
def package_members(spark, d):
    return inventory.package_members(statements.split_statements(_packages(spark, d)))


@query("triggers", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, 'tr_' || k AS trigger_name, 'BEFORE' AS timing, 'INSERT' AS events, 'orders' AS table_name,
       true AS row_level, NULL::VARCHAR AS when_clause FROM stmts WHERE tid = 8
""")
def triggers(spark, d):
    return inventory.triggers(split(spark, d)).withColumn("events", F.array_join("events", ","))


_PROPERTIES = {
    2: [("start", "{k}"), ("increment", "5"), ("cycle", "false")],
    9: [("unique", "false"), ("bitmap", "true"), ("table", "orders"), ("columns", "o_orderstatus"), ("tablespace", "idx")]}


@query("properties", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, name, replace(value, '{{k}}', k::VARCHAR) AS value
FROM stmts JOIN {per_template(_PROPERTIES, 'tid, name, value')} USING (tid)
""")
def properties(spark, d):
    rows = inventory.properties(split(spark, d))
    return rows.select("file_id", "stmt_no", F.explode("properties").alias("name", "value"))


@query("file_features", f"""
WITH {STATEMENTS_SQL} SELECT file_id, bool_or(tid IN (7, 8)) AS has_plsql, false AS has_packages, bool_or(tid = 8) AS has_triggers,
       bool_or(tid = 5) AS has_synonyms, bool_or(tid = 2) AS has_sequences, false AS has_dblinks, bool_or(tid = 3) AS has_oracle_hints,
       bool_or(tid = 10) AS has_connect_by, bool_or(tid = 3) AS has_outer_join_plus FROM stmts GROUP BY file_id
""")
def file_features(spark, d):
    return inventory.file_features(split(spark, d))


_USED = {0: [("NVL",), ("SYSDATE",)], 1: [("SYSDATE",)], 6: [("DECODE",), ("ROWNUM",), ("SYSDATE",)],
         8: [("NVL",), ("SYSDATE",)], 11: [("LISTAGG",)]}


@query("functions_used", f"""
WITH {STATEMENTS_SQL} SELECT file_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS functions
FROM stmts LEFT JOIN {per_template(_USED, 'tid, name')} USING (tid) GROUP BY file_id
""")
def functions_used(spark, d):
    return inventory.functions_used(fx.scripts(spark, d)).withColumn("functions", F.array_join("functions", ","))


@query("parse_errors", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, kind, 'no name found in CREATE ' || kind AS error
FROM stmts JOIN {_OBJECTS_SQL} USING (tid) WHERE k % 5 = 0
""")
def parse_errors(spark, d):
    """Every fifth CREATE loses its name and must be reported."""
    kinds = "TABLE|SEQUENCE|SYNONYM|PROCEDURE|TRIGGER|INDEX"
    nameless = F.regexp_replace("text", rf"(?s)^(CREATE [A-Z ]*(?:{kinds}))\s.*$", "$1")
    fifth = (F.col("file_id") * 10 + F.col("stmt_no") - 1) % 5 == 0
    stmts = split(spark, d).withColumn("text", F.when(fifth, nameless).otherwise(F.col("text")))
    return inventory.parse_errors(inventory.objects(stmts)).drop("stmt_line")


@query("schema_map", f"""
WITH {STATEMENTS_SQL} SELECT k, CASE WHEN k % 3 = 0 THEN 'public.orders' WHEN k % 3 = 1 THEN 'fin.orders' ELSE 'orders' END AS target_name FROM stmts
""")
def schema_map(spark, d):
    names = fx.statements(spark, d).select("k", F.lit("orders").alias("object_name"), F.element_at(
        F.array(F.lit("hr"), F.lit("FINANCE"), F.lit("scott_old")), (F.col("k") % 3 + 1).cast("int")).alias("schema_name"))
    return joins.map_schema(names, {"HR": "public", "FINANCE": "fin"}).select("k", "target_name")
