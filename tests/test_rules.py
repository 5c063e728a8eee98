from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veldspar.operators import reports
from veldspar.operators import rules as R
from veldspar.operators.rule_table import Rule, default_rules
from veldspar.operators.statements import classify, split_statements


def convert(spark, *sqls, rules=None):
    df = spark.createDataFrame([(1, i + 1, 1, s) for i, s in enumerate(sqls)], "file_id int, stmt_no int, stmt_line bigint, text string")
    out = R.rewrite(df.withColumn("stmt_type", classify(F.col("text"))), rules or default_rules())
    return out.orderBy("stmt_no").collect()


# (statement, text that must appear, text that must not)
CONSTRUCTS = [
    ("CREATE TABLE item (label VARCHAR2(80))", "label VARCHAR(80)", "VARCHAR2"),
    ("CREATE TABLE item (item_no NUMBER(7), price NUMBER(9,3))", "NUMERIC(7), price NUMERIC(9,3)", "NUMBER"),
    ("CREATE TABLE page (body CLOB, scan BLOB)", "body TEXT, scan BYTEA", "LOB"),
    ("CREATE TABLE page (seen DATE)", "seen TIMESTAMP", "DATE"),
    ("SELECT SYSDATE FROM DUAL", "SELECT CURRENT_TIMESTAMP", "DUAL"),
    ("SELECT NVL(price, 1), SUBSTR(label, 2) FROM item", "COALESCE(price, 1), SUBSTRING(label, 2)", "NVL"),
    ("SELECT SYS_GUID() AS id FROM DUAL", "gen_random_uuid() AS id", "SYS_GUID"),
    ("SELECT item_no FROM item MINUS SELECT item_no FROM sold", "item EXCEPT SELECT", "MINUS"),
    ("SELECT item_seq.NEXTVAL, item_seq.CURRVAL FROM DUAL", "nextval('item_seq'), currval('item_seq')", "NEXTVAL"),
    ("CREATE TABLE item (n NUMBER(7)) PCTFREE 5 TABLESPACE data INITRANS 3 LOGGING", "(n NUMERIC(7))", "INITRANS"),
    ("SELECT /*+ FULL(i) */ label FROM item i", "/* Oracle hint removed */", "/*+"),
    ("CREATE GLOBAL TEMPORARY TABLE scratch (n NUMBER) ON COMMIT DELETE ROWS", "CREATE TEMPORARY TABLE", "GLOBAL"),
    ("CREATE SYNONYM things FOR shop.item", "CREATE OR REPLACE VIEW things AS SELECT * FROM shop.item", "SYNONYM"),
    ("CREATE BITMAP INDEX ix ON item(kind) TABLESPACE fast COMPUTE STATISTICS", "CREATE INDEX ix ON item(kind)", "COMPUTE"),
    ("CREATE SEQUENCE item_seq NOORDER NOCYCLE NOCACHE NOMAXVALUE", "item_seq NO CYCLE", "NOCACHE"),
    ("CREATE FORCE VIEW cheap AS SELECT label FROM item", "CREATE OR REPLACE VIEW cheap", "FORCE"),
    # regressions
    ("CREATE TABLE t (flag NUMBER(1), n VARCHAR2(5 BYTE))", "flag BOOLEAN, n VARCHAR(5)", "BYTE"),  # D4
    ("CREATE TABLE t (id NUMBER) NOLOGGING", "CREATE TABLE t (id NUMERIC)", "NO"),  # D5
    ("CREATE PROCEDURE p IS\nBEGIN\nIF a THEN NULL; END IF;\nEND p;", "END IF;", "END p;"),  # D6
    ("BEGIN SELECT s.NEXTVAL INTO v FROM DUAL", "v := nextval('s')", "DUAL"),  # D4
    ("SELECT NVL2(a, 'x,y', b) FROM t", "CASE WHEN a IS NOT NULL THEN 'x,y' ELSE b END", "NVL2"),
    ("SELECT TRUNC(hired), TRUNC(12.7) FROM t", "DATE_TRUNC('day', hired), TRUNC(12.7)", "TRUNC(hired)"),
    ("SELECT LISTAGG(a, ',') FROM t", "STRING_AGG(a, ',')", "LISTAGG"),
    ("CREATE MATERIALIZED VIEW m BUILD IMMEDIATE REFRESH COMPLETE ON DEMAND AS SELECT 1", "CREATE MATERIALIZED VIEW m AS SELECT 1", "BUILD"),
    ("CREATE TYPE t AS VARRAY(5) OF NUMBER", "at most 5 elements", "VARRAY(5)"),
]


def test_constructs(spark):
    for row, (sql, want, gone) in zip(convert(spark, *[c[0] for c in CONSTRUCTS]), CONSTRUCTS):
        assert want in row["new_text"], row
        assert gone not in row["new_text"], row
        assert row["ledger"], row


def test_rewriting_is_a_fixed_point(spark):  # D10
    once = [r["new_text"] for r in convert(spark, *[c[0] for c in CONSTRUCTS], "CREATE PACKAGE p AS PRAGMA x; END p;")]
    again = convert(spark, *once)
    assert [r["new_text"] for r in again] == once


def test_nested_calls_are_left_for_review(spark):  # D8, D11
    row, agg = convert(spark, "SELECT ADD_MONTHS(TRUNC(d, 'MM'), 1) FROM t", "SELECT LISTAGG(a, ',') WITHIN GROUP (ORDER BY a) FROM t")
    assert row["new_text"].startswith("SELECT ADD_MONTHS(TRUNC(d, 'MM'), 1)")
    assert [(e["rule_id"], e["severity"]) for e in row["ledger"]] == [("FN_024", "REVIEW")]
    assert "WITHIN GROUP" in agg["new_text"] and [(e["rule_id"], e["severity"]) for e in agg["ledger"]] == [("FN_022", "REVIEW")]


def test_start_with_of_a_sequence_is_no_hierarchy(spark):  # D16
    seq, tree = convert(spark, "CREATE SEQUENCE s START WITH 1", "SELECT 1 FROM t START WITH a = 1 CONNECT BY PRIOR a = b")
    assert [e["rule_id"] for e in seq["ledger"]] == []
    assert [(e["rule_id"], e["severity"]) for e in tree["ledger"]] == [("SX_005", "REVIEW"), ("SX_006", "REVIEW")]  # D2


def test_effective_severity(spark):  # D2
    table = R.with_effective_severity(R.rules_df(spark))
    got = {r["rule_id"]: r["effective_severity"] for r in table.filter("rule_id IN ('FN_025', 'PL_019', 'FN_001')").filter("mode = 'fix'").collect()}
    assert got == {"FN_025": "REVIEW", "PL_019": "REVIEW", "FN_001": "AUTO"}


def test_registry(spark):
    table = R.rules_df(spark)
    registered = table.filter("rule_id NOT IN ('SX_STORAGE', 'SX_TEMP', 'SEQ_MIN', 'SEQ_MAX')").select("rule_id").distinct()
    assert registered.count() == 104
    counts = {r["category"]: r["n"] for r in R.rule_counts(table.join(registered, "rule_id")).collect()}
    assert counts == {"DATATYPE": 23, "FUNCTION": 26, "SYNTAX": 18, "PLSQL": 21, "SEQUENCE": 4, "OBJECT": 8, "TRIGGER": 3, "SYNONYM": 1}
    assert [r[0] for r in R.rule_categories(table).collect()] == sorted(counts)
    assert R.rule_by_id(table, "DT_001").first()["category"] == "DATATYPE"
    assert R.rules_auto_fixable(table).count() > 50
    orders = [r.rule_order for r in default_rules()]
    assert orders == sorted(set(orders))


def test_tokens_occur_in_every_match():
    for r in default_rules():
        if r.token:
            plain = r.pattern.upper().replace("\\S", "").replace("\\", "")
            assert r.token.replace("\\", "") in plain, r


def test_rule_selection(spark):  # D3
    table = R.rules_df(spark)
    chosen = {r["rule_id"] for r in R.select_rules(table, {"DATATYPE": False}, ["FN_001"], ["DT_001", "FN_001"]).collect()}
    assert "DT_001" in chosen and "DT_002" not in chosen and "FN_001" in chosen and "SX_007" in chosen
    row, = convert(spark, "SELECT SYSDATE, NVL(a, 1) FROM t", rules=R.rules_list(R.select_rules(table, {}, ["FN_001"])))
    assert row["new_text"] == "SELECT SYSDATE, COALESCE(a, 1) FROM t"


def test_schema_mapping(spark):  # D3
    rules = R.schema_rules({"HR": "public"}, ["scott"])
    row, = convert(spark, "SELECT * FROM hr.emp e, Scott.dept d WHERE x.hr.y = :hr.z", rules=rules)
    assert row["new_text"] == "SELECT * FROM public.emp e, dept d WHERE x.hr.y = :hr.z"


def test_match_lines(spark):  # D13
    df = spark.createDataFrame([(1, "\nselect a,\n  sysdate,\n  nvl(b, 1)\nfrom t;")], "file_id int, text string")
    found = R.locate_matches(R.scan(split_statements(df), default_rules()), default_rules())
    assert {(r["rule_id"], r["stmt_line"], r["match_line"]) for r in found.collect()} == {("FN_001", 2, 3), ("FN_003", 2, 4)}
    once = R.scan_places(split_statements(df), default_rules())
    assert {(r["rule_id"], r["stmt_line"], r["match_line"]) for r in once.collect()} == {("FN_001", 2, 3), ("FN_003", 2, 4)}


def test_distinct_rewrite_equals_plain(spark):
    data = [(1, i, "SELECT" if i % 3 else "CREATE_TABLE", f"CREATE TABLE t (a NUMBER(1), b DATE DEFAULT SYSDATE, c{i % 4} CLOB)") for i in range(60)]
    df = spark.createDataFrame(data, "file_id int, stmt_no int, stmt_type string, text string")
    cols = ["stmt_no", "new_text", "ledger"]
    assert sorted(map(str, R.rewrite_distinct(df, default_rules()).select(cols).collect())) == sorted(
        map(str, R.rewrite(df, default_rules()).select(cols).collect()))


def test_user_rule_and_quotes_in_patterns(spark):
    rule = Rule("US_1", "TEXT", "AUTO", "fix", "", r"(?i)it's\s+\\d", r"its $0", "quote and backslash", (), "", 1)
    row, = convert(spark, r"say it's \d twice", rules=[rule])
    assert row["new_text"] == r"say its it's \d twice" and row["ledger"][0]["description"] == "quote and backslash"


def test_compose_output_and_reports(spark):
    text = "SELECT NVL(a, 0) FROM t;\n-- keep\nCREATE PACKAGE p AS\nPROCEDURE q;\nEND p;\n/\n"
    scripts = spark.createDataFrame([("f1", text), ("f2", "ALTER TABLE t ADD c NUMBER;")], "file_id string, text string")
    out = {r["file_id"]: r["text"] for r in reports.compose_output(scripts, default_rules(), datetime(2020, 1, 2, 3, 4, 5)).collect()}
    assert "-- Auto-converted: 2 | Review needed: 0 | Manual: 1" in out["f1"]
    assert "--   [MANUAL] [PLSQL] PACKAGE: becomes -- [MANUAL] Nothing on the other side" in out["f1"] and "SELECT COALESCE(a, 0) FROM t;" in out["f1"]
    assert "Migration Changes" not in out["f2"] and "-- Generated: 2020-01-02 03:04:05" in out["f2"]
    done = R.rewrite(split_statements(scripts), default_rules())
    found = R.findings_of(done)
    counts = {r["file_id"]: (r["auto"], r["review"], r["manual"], r["total"]) for r in reports.file_counts(found).collect()}
    assert counts == {"f1": (2, 0, 1, 3)}
    total = reports.run_totals(scripts, found, spark.createDataFrame([(1,)], "e int")).first()
    assert (total["files"], total["changes"], total["manual"], total["errors"]) == (2, 3, 1, 1)
    once = reports.run_totals_of(scripts, default_rules()).first()
    assert (once["files"], once["changes"], once["auto"], once["review"], once["manual"], once["errors"]) == (2, 3, 2, 0, 1, 0)
    assert reports.run_totals_of(scripts.limit(0), default_rules()).first()["files"] == 0
    nameless = spark.createDataFrame([("f1", "CREATE TABLE; SELECT SYSDATE FROM t")], "file_id string, text string")
    assert reports.run_totals_of(nameless, default_rules()).select("changes", "errors").first() == (1, 1)
    assert reports.review_items(found).count() == 1 and reports.file_details(found).count() == 3


@pytest.mark.parametrize("n", [3])
def test_rules_over_long_text(spark, n):
    long = "SELECT " + ", ".join(f"NVL(c{i}, 0)" for i in range(20_000)) + " FROM t"
    row, = convert(spark, long)
    assert row["new_text"].count("COALESCE(") == 20_000
