"""Queries over the rule engine and its reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veldspar.operators import inventory, joins, reports, rules
from veldspar.operators.rule_table import Rule, default_rules
from veldspar.plans import script_fixture as fx
from veldspar.plans.registry import query
from veldspar.plans.script_fixture import STATEMENTS_SQL, per_template
from veldspar.plans.scripts import _KNOWN_SQL, split
from veldspar.sources.tables import load

AS_OF = datetime(2002, 1, 31, 12, 30, 15)

# What each template must become, and the rules that must act on it in order.
REWRITTEN = {
    0: "SELECT COALESCE(o_totalprice, 0), CURRENT_TIMESTAMP FROM orders WHERE o_orderkey = {k}",
    1: "CREATE TABLE t_{k} (id NUMERIC(10) NOT NULL, flag BOOLEAN DEFAULT 1, name VARCHAR(50), "
       "made TIMESTAMP DEFAULT CURRENT_TIMESTAMP, body TEXT,\n"
       "  CONSTRAINT pk_{k} PRIMARY KEY (id), CONSTRAINT fk_{k} FOREIGN KEY (id) REFERENCES orders(o_orderkey))",
    2: "CREATE SEQUENCE sq_{k} START WITH {k} INCREMENT BY 5 NO CYCLE",
    3: "SELECT /* Oracle hint removed */ o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey(+)",
    4: "SELECT c_custkey FROM customer\nEXCEPT\nSELECT o_custkey FROM orders WHERE o_orderkey = {k}",
    5: "CREATE OR REPLACE VIEW syn_{k} AS SELECT * FROM hr.orders",
    6: "SELECT 'a;b''SYSDATE' AS lit_{k},\n  DECODE(o_orderstatus, 'F', 1, 0) FROM orders WHERE ROWNUM <= 10",
    7: "CREATE OR REPLACE PROCEDURE pr_{k}(p_id IN NUMERIC, OUT p_out VARCHAR2)\nAS $$\nDECLARE\n  v NUMERIC(12,2);\nBEGIN\n"
       "  IF p_id > 0 THEN\n    p_out := 'x;y';\n  END IF;\nEND; $$ LANGUAGE plpgsql;",
    8: "CREATE OR REPLACE TRIGGER tr_{k}\n  BEFORE INSERT ON orders\n  FOR EACH ROW\nBEGIN\n"
       "  NEW.o_orderdate := COALESCE(NEW.o_orderdate, CURRENT_TIMESTAMP);\nEND; $$ LANGUAGE plpgsql;",
    9: "CREATE INDEX ix_{k} ON orders(o_orderstatus)",
    10: "SELECT p_partkey, LEVEL FROM part START WITH p_partkey = 0 CONNECT BY PRIOR p_partkey = p_size",
    11: "SELECT LISTAGG(n_name, ', ') WITHIN GROUP (ORDER BY n_name), nextval('sq_{k}')",
}
LEDGER = {
    0: "FN_001 FN_003", 1: "DT_023 DT_002 DT_021 DT_006 DT_014 SX_STORAGE SX_STORAGE SX_STORAGE FN_001",
    2: "SEQ_002 SEQ_003 SEQ_004", 3: "JOIN_001 HINT_001", 4: "SX_007", 5: "SYN_001", 6: "FN_005 FN_016",
    7: "PL_003 PL_004 PL_006 DT_001 DT_003", 8: "TR_001 TR_002 PL_004 FN_001 FN_003", 9: "OBJ_004 SX_009",
    10: "SX_005 SX_006", 11: "FN_022 SX_001 SX_002 SX_001",
}
SCANNED = LEDGER | {
    1: "DT_023 DT_002 DT_021 DT_004 DT_006 DT_014 SX_STORAGE SX_STORAGE SX_STORAGE FN_001 SX_009 SX_010 SX_013",
    7: "PL_001 PL_003 PL_004 PL_006 DT_001 DT_003", 9: "OBJ_004 SX_009 SX_009",
}
# Line offset of each scanned rule's first match within its statement, where it is not the first line.
LINES = {(1, "SX_STORAGE"): 1, (1, "SX_009"): 1, (1, "SX_010"): 1, (1, "SX_013"): 1, (4, "SX_007"): 1, (6, "FN_005"): 1,
         (6, "FN_016"): 1, (7, "PL_003"): 1, (7, "PL_004"): 7, (7, "DT_003"): 2,
         (8, "TR_002"): 4, (8, "PL_004"): 5, (8, "FN_001"): 4, (8, "FN_003"): 4}
REVIEWED = {"JOIN_001", "SYN_001", "FN_005", "FN_016", "TR_001", "SX_005", "SX_006", "FN_022"}
CATEGORY = {"FN": "FUNCTION", "DT": "DATATYPE", "SX": "SYNTAX", "JOIN": "SYNTAX", "HINT": "SYNTAX", "PL": "PLSQL",
            "SEQ": "SEQUENCE", "OBJ": "OBJECT", "TR": "TRIGGER", "SYN": "SYNONYM"}


def _rule_rows(found: dict[int, str]) -> dict[int, list[tuple]]:
    return {tid: [(i + 1, r, CATEGORY[r.split("_")[0]], "REVIEW" if r in REVIEWED else "AUTO", LINES.get((tid, r), 0))
                  for i, r in enumerate(ids.split())] for tid, ids in found.items()}


_COLUMNS = "tid, pos, rule_id, category, severity, line"
LEDGER_SQL = per_template(_rule_rows(LEDGER), _COLUMNS)
_SCAN_SQL = per_template(_rule_rows(SCANNED), _COLUMNS)
_NEW_SQL = per_template({t: [(x,)] for t, x in REWRITTEN.items()}, "tid, new_text")
_LINE_SQL = f"""placed AS (SELECT s.*, 1 + skip + CAST(coalesce(sum(lines) OVER
  (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stmt_line
  FROM stmts s JOIN {_KNOWN_SQL} USING (tid))"""


def rewritten(spark, d):
    return rules.rewrite(split(spark, d), default_rules())


def findings(spark, d):
    return rules.findings_of(rewritten(spark, d))


@query("rule_scan", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, rule_id, category, severity FROM stmts JOIN {_SCAN_SQL} USING (tid)
""")
def rule_scan(spark, d):
    return rules.scan(split(spark, d), default_rules()).select("file_id", "stmt_no", "rule_id", "category", "severity")


USER_RULES = [
    Rule("US_001", "TEXT", "REVIEW", "detect", "HTTP", r"(?i)https?://[^\s]+", "", "Web address", (), "", 901),
    Rule("US_002", "TEXT", "REVIEW", "detect", "", r"[0-9]{3}[-. ][0-9]{4}", "", "Telephone number", (), "", 902),
    Rule("US_003", "TEXT", "AUTO", "detect", "LICEN", r"(?i)licen[cs]e", "", "License line", (), "", 903),
    Rule("US_004", "TEXT", "AUTO", "fix", "@", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "(mail)", "Mail address", (), "MANUAL", 904),
]


def _docs_sql() -> str:
    """Generic rules with patterns both engines read; the others by their token, which is stricter than no check."""
    rows = []
    for r in [*default_rules(), *USER_RULES]:
        if r.scope:
            continue
        both = not any(x in r.pattern for x in ("(?!", "(?=", "++", "*+"))
        pattern = r.pattern if both else "(?i)" + r.token
        rows.append("({}, '{}', '{}')".format(r.rule_order, r.rule_id, pattern.replace("'", "''")))
    return (f"WITH r(o, rule_id, p) AS (VALUES {', '.join(rows)}) "
            "SELECT doc_id, rule_id FROM documents JOIN r ON regexp_matches(text, p)")


@query("rule_scan_docs", _docs_sql())
def rule_scan_docs(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    table = rules.add_user_rules(rules.rules_df(spark), rules.rules_df(spark, USER_RULES))
    generic = table.filter(F.size("scope") == 0)
    return rules.match_patterns(docs, generic).select("doc_id", "rule_id")


@query("user_rule", """
SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '(mail)', 'g') AS new_text,
       CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'MANUAL' END AS severity FROM documents
""")
def user_rule(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", F.lit("UNKNOWN").alias("stmt_type"))
    masked = rules.rewrite(docs, [r for r in USER_RULES if r.mode == "fix"], protect=False)
    return masked.select("doc_id", "new_text", F.get("ledger", F.lit(0))["severity"].alias("severity"))


@query("rewrite_text", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, replace(new_text, '{{k}}', k::VARCHAR) AS new_text FROM stmts JOIN {_NEW_SQL} USING (tid)
""")
def rewrite_text(spark, d):
    return rewritten(spark, d).select("file_id", "stmt_no", "new_text")


@query("rewrite_ledger", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, pos AS finding_no, rule_id, category, severity FROM stmts JOIN {LEDGER_SQL} USING (tid)
""")
def rewrite_ledger(spark, d):
    return findings(spark, d).select("file_id", "stmt_no", "finding_no", "rule_id", "category", "severity")


@query("rewrite_distinct", f"""
WITH {STATEMENTS_SQL} SELECT k, replace(new_text, '{{k}}', CAST(k % 60 AS VARCHAR)) AS new_text FROM stmts JOIN {_NEW_SQL} USING (tid)
""")
def rewrite_distinct(spark, d):
    """An archive whose statements repeat: sixty distinct texts, each rewritten once."""
    from veldspar.operators.statements import classify

    key = (F.col("k") % 60).cast("string")
    text = F.element_at(F.array(*[F.lit(t) for t in fx.TEMPLATES]), (F.col("tid") + 1).cast("int"))
    body = F.regexp_replace(F.replace(text, F.lit("{k}"), key), r"^--[^\n]*\n", "")
    stmts = fx.statements(spark, d).select("k", body.alias("text"), classify(body).alias("stmt_type"))
    return rules.rewrite_distinct(stmts, default_rules()).select("k", "new_text")


@query("rewrite_scoped", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, rule_id FROM stmts JOIN {LEDGER_SQL} USING (tid)
WHERE category IN ('DATATYPE', 'SEQUENCE', 'TRIGGER') AND rule_id <> 'TR_001'
""")
def rewrite_scoped(spark, d):
    """Only rules tied to statement types; the others are switched off."""
    off = {c: False for c in ("FUNCTION", "SYNTAX", "PLSQL", "OBJECT", "SYNONYM")}
    chosen = rules.select_rules(rules.rules_df(spark), off, disabled=["TR_001"])
    return rules.findings_of(rules.rewrite(split(spark, d), chosen)).select("file_id", "stmt_no", "rule_id")


@query("rewrite_fixpoint", f"WITH {STATEMENTS_SQL} SELECT count(*) AS n, count(*) AS unchanged FROM stmts")
def rewrite_fixpoint(spark, d):
    once = rewritten(spark, d).select("file_id", "stmt_no", "stmt_type", F.col("new_text").alias("text"))
    twice = rules.rewrite(once, default_rules())
    return twice.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new_text") == F.col("text")).alias("unchanged"))


@query("severity_counts", f"""
WITH {STATEMENTS_SQL} SELECT severity, count(*) AS n FROM stmts JOIN {LEDGER_SQL} USING (tid) GROUP BY severity
""")
def severity_counts(spark, d):
    return reports.severity_counts(findings(spark, d))


@query("match_line", f"""
WITH {STATEMENTS_SQL}, {_LINE_SQL} SELECT file_id, stmt_no, rule_id, stmt_line + line AS match_line FROM placed JOIN {_SCAN_SQL} USING (tid)
""")
def match_line(spark, d):
    return rules.scan_places(split(spark, d), default_rules()).select("file_id", "stmt_no", "rule_id", "match_line")


@query("rewrite_schema", f"""
WITH {STATEMENTS_SQL} SELECT k, CASE WHEN tid = 5 THEN 'CREATE PUBLIC SYNONYM syn_' || k || ' FOR orders'
  WHEN tid = 3 THEN replace(replace(stmt, 'o.', ''), 'c.', 'crm.') ELSE stmt END AS new_text FROM stmts
""")
def rewrite_schema(spark, d):
    stmts = fx.statements(spark, d).select("k", F.col("stmt").alias("text"), F.lit("UNKNOWN").alias("stmt_type"))
    return rules.rewrite_schema(stmts, {"C": "crm"}, ["HR", "O"]).select("k", "new_text")


def _with_use(spark, d, table):
    """Registry rows beside the number of corpus findings they caused."""
    use = findings(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    listed = table.select("rule_id", "category").distinct()
    return joins.lookup_join(listed, use, ["rule_id"], "left").select(
        "rule_id", "category", F.coalesce("findings", F.lit(0)).alias("findings"))


def _use_sql(where: str) -> str:
    rows = ", ".join(sorted({f"('{r.rule_id}', '{r.category}', '{r.severity_override or r.severity}', '{r.mode}')" for r in default_rules()}))
    return f"""WITH {STATEMENTS_SQL}, r(rule_id, category, severity, mode) AS (VALUES {rows}),
u AS (SELECT rule_id, count(*) AS n FROM stmts JOIN {LEDGER_SQL} USING (tid) GROUP BY rule_id)
SELECT DISTINCT r.rule_id, r.category, coalesce(n, 0) AS findings FROM r LEFT JOIN u ON u.rule_id = r.rule_id WHERE {where}"""


@query("rules_by_category", _use_sql("r.category = 'SYNTAX'"))
def rules_by_category(spark, d):
    return _with_use(spark, d, rules.rules_by_category(rules.rules_df(spark), "SYNTAX"))


@query("rules_by_severity", _use_sql("r.severity = 'REVIEW'"))
def rules_by_severity(spark, d):
    return _with_use(spark, d, rules.rules_by_severity(rules.rules_df(spark), "REVIEW"))


@query("rules_auto_fixable", _use_sql("r.mode = 'fix'"))
def rules_auto_fixable(spark, d):
    return _with_use(spark, d, rules.rules_auto_fixable(rules.rules_df(spark)))


@query("select_rules", _use_sql(
    "(r.category NOT IN ('DATATYPE', 'PLSQL') AND r.rule_id NOT IN ('FN_005', 'SX_003')) OR r.rule_id = 'DT_010'"))
def select_rules(spark, d):
    chosen = rules.select_rules(rules.rules_df(spark), {"DATATYPE": False, "PLSQL": False, "SYNTAX": True},
                                disabled=["FN_005", "SX_003"], forced=["DT_010"])
    return _with_use(spark, d, chosen)


@query("file_counts", f"""
WITH {STATEMENTS_SQL} SELECT file_id, count(*) FILTER (severity = 'AUTO') AS auto, count(*) FILTER (severity = 'REVIEW') AS review,
       count(*) FILTER (severity = 'MANUAL') AS manual, count(*) AS total FROM stmts JOIN {LEDGER_SQL} USING (tid) GROUP BY file_id
""")
def file_counts(spark, d):
    return reports.file_counts(findings(spark, d))


@query("category_matrix", f"""
WITH {STATEMENTS_SQL} SELECT category, count(*) FILTER (severity = 'AUTO') AS auto, count(*) FILTER (severity = 'REVIEW') AS review,
       count(*) FILTER (severity = 'MANUAL') AS manual, count(*) AS total FROM stmts JOIN {LEDGER_SQL} USING (tid) GROUP BY category
""")
def category_matrix(spark, d):
    return reports.category_matrix(findings(spark, d))


@query("run_totals", f"""
WITH {STATEMENTS_SQL}, f AS (SELECT * FROM stmts JOIN {LEDGER_SQL} USING (tid))
SELECT (SELECT count(DISTINCT file_id) FROM stmts) AS files, count(*) AS changes, count(*) FILTER (severity = 'AUTO') AS auto,
       count(*) FILTER (severity = 'REVIEW') AS review, count(*) FILTER (severity = 'MANUAL') AS manual, 0::BIGINT AS errors FROM f
""")
def run_totals(spark, d):
    return reports.run_totals_of(fx.scripts(spark, d), default_rules())


@query("run_totals_odd", f"""
WITH {fx.ODD_SQL} SELECT count(DISTINCT file_id) AS files, CAST(sum(CASE tid WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 4 ELSE 0 END) AS BIGINT) AS changes,
  0::BIGINT AS errors FROM stmts
""")
def run_totals_odd(spark, d):
    return reports.run_totals_of(fx.odd_scripts(spark, d), default_rules()).select("files", "changes", "errors")


@query("review_items", f"""
WITH {STATEMENTS_SQL}, {_LINE_SQL} SELECT file_id, stmt_no, stmt_line, rule_id, severity FROM placed JOIN {LEDGER_SQL} USING (tid)
WHERE severity IN ('REVIEW', 'MANUAL')
""")
def review_items(spark, d):
    return reports.review_items(findings(spark, d)).select("file_id", "stmt_no", "stmt_line", "rule_id", "severity")


@query("file_details", f"""
WITH {STATEMENTS_SQL}, f AS (SELECT * FROM stmts JOIN {LEDGER_SQL} USING (tid)),
c AS (SELECT file_id, count(*) FILTER (severity = 'AUTO') AS auto, count(*) FILTER (severity = 'REVIEW') AS review, count(*) AS total FROM f GROUP BY 1)
SELECT file_id, auto, review, total, stmt_no, pos AS finding_no, rule_id, severity FROM f JOIN c USING (file_id)
""")
def file_details(spark, d):
    return reports.file_details(findings(spark, d)).select(
        "file_id", "auto", "review", "total", "stmt_no", "finding_no", "rule_id", "severity")


# Sample message texts in a second language; other keys fall back to English.
MESSAGES_JA = {"FN_001": "SYSDATE を CURRENT_TIMESTAMP に変換", "SX_007": "MINUS を EXCEPT に変換"}
MESSAGES_EN = {"FN_001": "SYSDATE becomes CURRENT_TIMESTAMP", "FN_003": "NVL becomes COALESCE", "SX_007": "MINUS becomes EXCEPT"}


def _messages(spark):
    rows = [(k, "ja", v) for k, v in MESSAGES_JA.items()] + [(k, "en", v) for k, v in MESSAGES_EN.items()]
    return spark.createDataFrame(rows, "message_key string, lang string, text string")


def _message_case(column: str) -> str:
    texts = MESSAGES_EN | MESSAGES_JA
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + f" ELSE '[' || {column} || ']' END"


@query("localized_findings", f"""
WITH {STATEMENTS_SQL} SELECT file_id, stmt_no, pos AS finding_no, rule_id, {_message_case('rule_id')} AS message
FROM stmts JOIN {LEDGER_SQL} USING (tid)
""")
def localized_findings(spark, d):
    found = findings(spark, d).select("file_id", "stmt_no", "finding_no", "rule_id")
    return joins.localize(found, _messages(spark), "ja", key="rule_id")


def _described() -> dict[int, list[tuple]]:
    """(pos, rule id, category, severity, description) of each template's findings."""
    used = {tid: [] for tid in LEDGER}
    by_hand = {  # rules listed twice under one id: which of their descriptions acts on the template
        ("SX_STORAGE", 0): "TABLESPACE: clause left out", ("SX_STORAGE", 1): "PCTFREE: clause left out",
        ("SX_STORAGE", 2): "NOLOGGING: clause left out", ("FN_022", 0): "LISTAGG: kept, needs a decision",
        ("SX_001", 0): "DUAL: kept, nothing to do", ("SX_001", 1): "DUAL: clause left out", ("SX_009", 0): "TABLESPACE: clause left out"}
    single = {r.rule_id: r.description for r in default_rules()}
    for tid, ids in LEDGER.items():
        seen: dict[str, int] = {}
        for pos, rule_id in enumerate(ids.split()):
            text = by_hand.get((rule_id, seen.get(rule_id, 0)), single[rule_id])
            seen[rule_id] = seen.get(rule_id, 0) + 1
            severity = "REVIEW" if rule_id in REVIEWED else "AUTO"
            used[tid].append((pos + 1, rule_id, CATEGORY[rule_id.split("_")[0]], severity, text))
    return used


@query("findings_flat", f"""
WITH {STATEMENTS_SQL}, {_LINE_SQL} SELECT file_id AS file, rule_id, category, severity, description, {_message_case('rule_id')} AS description_local,
       stmt_line AS line FROM placed JOIN {per_template(_described(), "tid, pos, rule_id, category, severity, description")} USING (tid)
""")
def findings_flat(spark, d):
    return reports.findings_flat(joins.localize(findings(spark, d), _messages(spark), "ja", key="rule_id"))


def _compose_sql() -> str:
    used = {tid: [(pos, severity, f"--   [{severity}] [{category}] {text}") for pos, _, category, severity, text in rows]
            for tid, rows in _described().items()}
    line = reports.RULE
    return f"""
WITH {STATEMENTS_SQL}, f AS (SELECT * FROM stmts JOIN {per_template(used, "tid, pos, severity, label")} USING (tid)),
s AS (SELECT file_id, string_agg(label, chr(10) ORDER BY k, pos) AS changes, count(*) FILTER (severity = 'AUTO') AS a,
      count(*) FILTER (severity = 'REVIEW') AS r FROM f GROUP BY file_id),
b AS (SELECT file_id, string_agg(replace(new_text, '{{k}}', k::VARCHAR) || ';', chr(10) || chr(10) ORDER BY k) AS body
      FROM stmts JOIN {_NEW_SQL} USING (tid) GROUP BY file_id)
SELECT file_id, '{line}' || chr(10) || '-- Source: ' || file_id || chr(10) || '-- Generated: 2002-01-31 12:30:15' || chr(10)
  || '-- Auto-converted: ' || a || ' | Review needed: ' || r || ' | Manual: 0' || chr(10) || '{line}' || chr(10)
  || '-- Migration Changes:' || chr(10) || changes || chr(10) || '{line}' || chr(10) || body AS text
FROM s JOIN b USING (file_id)"""


@query("compose_output", _compose_sql())
def compose_output(spark, d):
    return reports.compose_output(fx.scripts(spark, d), default_rules(), AS_OF)
