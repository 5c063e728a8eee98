import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar.functions import spans as S
from veldspar.functions.text import mask_sql
from veldspar.operators import inventory as inv
from veldspar.operators import rules as R
from veldspar.operators.rule_table import Rule, default_rules
from veldspar.operators.statements import classify, split_statements


def kinds(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(S.spans(F.col("t")).alias("s")).first()
    return [(s["kind"], text[s["start"] - 1:s["stop"] - 1]) for s in row["s"] if s["kind"] != "open"]


@pytest.mark.parametrize("text, found", [
    ("", []), ("a - b / c * d", []), ("'it''s' || ''", [("literal", "'it''s'"), ("literal", "''")]),
    ("q'[a'b]' Q'{;}' nq'(x)' q'<<>' q'!a!b!'", [("literal", x) for x in ("q'[a'b]'", "Q'{;}'", "nq'(x)'", "q'<<>'", "q'!a!b!'"[:6])] + [("literal", "'")][:0]),
    ("seq'x' 'q''[y'", [("literal", "'x'"), ("literal", "'q''[y'")]),
    ('"a;b" "open\n', [("name", '"a;b"')]), ("-- 'x\n'y' /* -- */ /*+ h */", [("line_comment", "-- 'x"), ("literal", "'y'"), ("block_comment", "/* -- */"), ("hint", "/*+ h */")][:3]),
    ("/* never ends", []), ("'never ends", []), ("q'[never ends", [])])
def test_kinds_of_spans(spark, text, found):
    if text.startswith("q'[a'b"):
        assert kinds(spark, text)[:4] == found[:4]
    else:
        assert kinds(spark, text) == found


TRICKY = st.text(alphabet="aqQnN'\"-/*+[]{}!;\n$# 1,", max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TRICKY, min_size=20, max_size=60))
def test_what_is_protected_comes_back(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", S.protect("t")).withColumn("open", F.col("p.text")).withColumn("kept", F.col("p.kept"))
    for r in df.select("t", "open", S.restore("open", "kept").alias("back"), F.array_join(S.pieces(F.col("t")), "").alias("joined"), S.spans(F.col("t")).alias("s")).collect():
        assert r["back"] == r["t"] == r["joined"]
        assert "".join(r["t"][s["start"] - 1:s["stop"] - 1] for s in r["s"]) == r["t"]


def rewritten(spark, *texts, rules=None, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("stmt_type", classify(F.col("text")))
    return [(r["new_text"], [x["rule_id"] for x in r["ledger"]]) for r in R.rewrite(df, rules or default_rules(), **how).orderBy("i").collect()]


def test_only_code_is_rewritten(spark):
    got = rewritten(spark, "SELECT a FROM t WHERE a = 'MINUS' -- SYSDATE", "SELECT \"SYSDATE\", q'[NVL(a;b)]', NVL(c, 'NVL(') /* MINUS */ FROM t",
                    "SELECT MONTHS_BETWEEN(a, TO_DATE('x', 'MINUS')), REGEXP_LIKE(a, 'SYSDATE') FROM t", "SELECT 'x'")
    assert got[0] == ("SELECT a FROM t WHERE a = 'MINUS' -- SYSDATE", [])
    assert got[1] == ("SELECT \"SYSDATE\", q'[NVL(a;b)]', COALESCE(c, 'NVL(') /* MINUS */ FROM t", ["FN_003"])
    assert got[2][0].startswith("SELECT MONTHS_BETWEEN(a, TO_TIMESTAMP('x', 'MINUS')), a ~ 'SYSDATE'")
    assert got[3] == ("SELECT 'x'", [])


def test_marks_may_move_repeat_and_vanish(spark):
    swap = [Rule("A", "T", "AUTO", "fix", "F", r"(?i)\bf\(([^,]*),([^)]*)\)", r"g($2,$1,$1)", "d", (), "", 1), Rule("B", "T", "AUTO", "fix", "", r"--.*$", "", "d", (), "", 2)]
    assert rewritten(spark, "f('a;1','b''2') -- 'gone'", rules=swap) == [("g('b''2','a;1','a;1') ", ["A", "B"])]
    assert rewritten(spark, "it's f(1,2) and it's @", rules=swap, protect=False) == [("it's g(2,1,1) and it's @", ["A"])]
    assert rewritten(spark, "anything", rules=[Rule("N", "T", "AUTO", "fix", "ZZZ", "zzz", "", "d", (), "", 1)]) == [("anything", [])]


def test_tokens_that_are_no_words(spark):
    rules = [Rule("A", "T", "AUTO", "fix", "OLD", r"(?i)old", "NEWER", "d", (), "", 1), Rule("B", "T", "AUTO", "detect", "NEWER", r"\bNEWER\b", "", "d", (), "", 2),
             Rule("C", "T", "AUTO", "detect", "WORD", r"(?i)\bWORD\b", "", "d", (), "", 3), Rule("D", "T", "AUTO", "detect", "", r"\d", "", "d", (), "", 4)]
    assert [R.whole_word(r) for r in rules] == [False, True, True, False]
    assert rewritten(spark, "xolder", "old word", "swords 1", rules=rules) == [
        ("xNEWERer", ["A"]), ("NEWER word", ["A", "B", "C"]), ("swords 1", ["D"])]
    df = spark.createDataFrame([("éword ſword",), ("x",)], "text string")
    assert [r["rule_id"] for r in R.match_patterns(df, rules).collect()] == [
        r.rule_id for r in rules if spark.sql("SELECT 'éword ſword' RLIKE " + S.sql_text(r.pattern)).first()[0]]


def test_many_rules_find_what_few_find(spark):
    """Rules beyond one step of the look-up, in an order of their own."""
    rules = [Rule(f"R{i}", "T", "AUTO", "fix" if i % 2 else "detect", f"W{i}", rf"(?i)\bW{i}\b", f"W{i + 1} X{i}", "d", (), "", i) for i in range(70)]
    (text, ledger), = rewritten(spark, "W3 w69 W40", rules=rules)
    assert text == "W4 X3 W70 X69 W40" and ledger == ["R3", "R4", "R40", "R69"]


def split(spark, text):
    return [r["text"] for r in split_statements(spark.createDataFrame([(1, text)], "file_id int, text string")).orderBy("stmt_no").collect()]


def test_statements_ended_by_a_slash(spark):
    assert split(spark, "SELECT 1 FROM dual\n/\nSELECT 2 FROM dual\n / \nSELECT a\n / b FROM t;\n/\n") == ["SELECT 1 FROM dual", "SELECT 2 FROM dual", "SELECT a\n / b FROM t"]
    assert split(spark, "/\nSELECT '\n/\n' FROM t\n/") == ["SELECT '\n/\n' FROM t"]
    rows = split_statements(spark.createDataFrame([(1, "a\n/\n\n/\nb\n/\nc;d")], "file_id int, text string")).orderBy("stmt_no").collect()
    assert [(r["text"], r["stmt_line"]) for r in rows] == [("a", 1), ("b", 5), ("c", 7), ("d", 7)]


def test_quotes_of_all_kinds_hide_semicolons(spark):
    assert split(spark, "SELECT q'[it's; x]', \"a;b\" FROM t; SELECT nq'!;!' FROM u; SELECT seq'x;y'") == [
        "SELECT q'[it's; x]', \"a;b\" FROM t", "SELECT nq'!;!' FROM u", "SELECT seq'x;y'"]
    assert split(spark, "CREATE PROCEDURE p IS\nBEGIN\n  x := q'[end;\nend;]';\n  y := \"begin\";\nEND;\nSELECT 1;")[-1] == "SELECT 1"
    big = "SELECT " + ", ".join(f"q'[{i};']'" for i in range(30_000)) + " FROM t"
    assert split(spark, big + "\n/\nSELECT 2") == [big, "SELECT 2"]


def test_masks_know_names_and_q_literals(spark):
    df = spark.createDataFrame([("a \"it's\" q'[x'y]' -- \"c\nb 'd' /* \" */ \"e\"",)], "t string")
    assert df.select(mask_sql(F.col("t"))).first()[0] == "a \"it's\" ''  \nb ''   \"e\""


def test_names_and_lists(spark):
    def rows(*texts):
        return spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(texts)], "file_id int, stmt_no int, stmt_line int, text string").withColumn("stmt_type", classify(F.col("text")))
    s = rows("CREATE TABLE hr.emp$audit (note# VARCHAR2(20), \"a, b\" DATE, CONSTRAINT ck$1 CHECK (note# <> ')'), FOREIGN KEY (note#, \"a, b\") REFERENCES x.\"Dept\"(id#))",
             "CREATE TABLE open (a NUMBER, b VARCHAR2(5), c DATE", "CREATE TABLE copy AS SELECT f(1) FROM t", "CREATE TABLE odd (# NUMBER, (x))",
             "CREATE PROCEDURE p(a NUMBER, b DATE", "CREATE PROCEDURE q IS BEGIN NULL; END")
    assert [(r["column_name"], r["data_type"]) for r in inv.columns(s).filter("stmt_no < 2").orderBy("stmt_no", "position").collect()] == [
        ("note#", "VARCHAR2"), ("a, b", "DATE"), ("a", "NUMBER"), ("b", "VARCHAR2"), ("c", "DATE")]
    cons = {r["kind"]: r for r in inv.constraints(s).collect()}
    assert cons["CHECK"]["constraint_name"] == "ck$1" and cons["CHECK"]["condition"] == "note# <> ')'"
    assert cons["FOREIGN KEY"]["columns"] == ["note#", "a, b"] and (cons["FOREIGN KEY"]["ref_table"], cons["FOREIGN KEY"]["ref_columns"]) == ("Dept", ["id#"])
    assert inv.objects(s).filter("stmt_no = 0").first()["object_name"] == "emp$audit"
    assert {(r["stmt_no"], r["kind"], r["error"]) for r in inv.list_errors(s).collect()} == {
        (1, "TABLE", "list never ends"), (3, "TABLE", "no column found in: (x)"), (4, "PROCEDURE", "list never ends")}
    wide = rows("CREATE TABLE w (" + ", ".join(f"c{i} NUMBER(10, 2) DEFAULT f({i}, ',')" for i in range(3_000)) + ")")
    assert inv.columns(wide).count() == 3_000 and inv.list_errors(wide).count() == 0
