import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar.operators import inventory as inv
from veldspar.operators.statements import classify, split_statements
from veldspar.plans.scripts import TYPE_EXAMPLES


def split(spark, text):
    df = spark.createDataFrame([(1, text)], "file_id int, text string")
    return split_statements(df).orderBy("stmt_no").collect()


def texts(spark, text):
    return [r["text"] for r in split(spark, text)]


def stmts(spark, *bodies):
    df = spark.createDataFrame([(1, i + 1, 1, b) for i, b in enumerate(bodies)], "file_id int, stmt_no int, stmt_line int, text string")
    return df.withColumn("stmt_type", classify(F.col("text")))


def test_all_statement_types(spark):
    assert len(TYPE_EXAMPLES) == 31
    df = spark.createDataFrame(TYPE_EXAMPLES, "want string, text string")
    for r in df.withColumn("got", classify(F.col("text"))).collect():
        assert r["got"] == r["want"], r


def test_comment_before_statement_is_kept_apart(spark):  # D1
    got = split(spark, "-- staff\n-- table\nCREATE TABLE t (id NUMBER);\n\n/* seq */ CREATE SEQUENCE s;")
    assert [(r["stmt_type"], r["leading_comment"], r["stmt_line"]) for r in got] == [
        ("CREATE_TABLE", "-- staff\n-- table", 3), ("CREATE_SEQUENCE", "/* seq */", 5)]


def test_semicolons_in_literals_and_comments(spark):  # D15
    assert texts(spark, "select 'a;b''c;' from t; -- don't; stop\nselect 2 /* ; ' */ from u; select 3") == [
        "select 'a;b''c;' from t", "select 2 /* ; ' */ from u", "select 3"]


def test_line_numbers_inside_and_after_a_line(spark):
    got = split(spark, "\n\nselect 1; select 2;\nselect\n 3;\r\nselect 4")
    assert [(r["stmt_line"], r["text"]) for r in got] == [(3, "select 1"), (3, "select 2"), (4, "select\n 3"), (6, "select 4")]


def test_procedure_with_nested_blocks(spark):  # D6: END IF and END LOOP do not end a block
    proc = ("create or replace procedure p is\nbegin\n  if x then\n    begin null; end;\n  end if;\n  for i in 1..2 loop\n    null;\n"
            "  end loop;\n  y := case when a then 1 else 2 end;\nend;")
    got = texts(spark, proc + "\nselect 1 from t;")
    assert got == [proc, "select 1 from t"]


def test_package_ends_at_its_own_end(spark):
    body = "create package body k as\nprocedure a is begin null; end;\nprocedure b is\nbegin\n  null;\nend b;\nend k;"
    got = split(spark, f"-- pkg\n{body}\n/\nselect 1 from dual;")
    assert [(r["text"], r["stmt_type"], r["stmt_line"]) for r in got] == [
        (body, "CREATE_PACKAGE_BODY", 2), ("select 1 from dual", "SELECT", 9 + 1)]


def test_words_in_comments_and_literals_do_not_count(spark):
    trig = "create trigger t before insert on x for each row\nbegin\n  -- begin begin\n  /* begin\n  end;\n  begin */\n  log('end;');\nend;"
    assert texts(spark, trig + "\nselect 1;") == [trig, "select 1"]


def test_unfinished_and_empty_scripts(spark):
    assert texts(spark, "") == [] and texts(spark, " \n;;\n/\n") == []
    assert texts(spark, "select 'open; text") == ["select 'open", "text"]
    got = split(spark, "select 1;\n-- the end")
    assert [(r["stmt_type"], r["text"]) for r in got] == [("SELECT", "select 1"), ("UNKNOWN", "-- the end")]


def test_long_scripts_and_literals(spark):
    got = texts(spark, "insert into t values ('" + "x''y;" * 100_000 + "');\nselect 1;")
    assert len(got) == 2 and len(got[0]) > 500_000


PIECE = st.one_of(
    st.sampled_from(["select 1", "update t set a = ';'", "delete from t -- x;y\n where a = 1", "insert into t values ('it''s')",
                     "select /* a;b */ 2 from t", "merge into t using s on (1 = 1)"]),
    st.text(alphabet="abc xyz=,()", min_size=1, max_size=12).filter(lambda s: s.strip()).map(lambda s: "select " + s.strip()))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECE, min_size=1, max_size=8))
def test_split_of_joined_statements_gives_them_back(spark, pieces):
    assert texts(spark, ";\n".join(pieces) + ";") == pieces


def test_table_inventory(spark):
    ddl = ("CREATE TABLE hr.emp (emp_id NUMBER(10) NOT NULL, pay NUMBER(12,2) DEFAULT f(1, 2) NOT NULL, pic LONG RAW, made DATE DEFAULT SYSDATE,\n"
           "  seen TIMESTAMP(6) WITH LOCAL TIME ZONE, \"odd\" VARCHAR2(20 CHAR) PRIMARY KEY, kind CHAR(3) CHECK (kind IN ('a', 'b,c')), -- note, it's fine\n"
           "  CONSTRAINT fk FOREIGN KEY (pay, made) REFERENCES hr.dept(a, b), CONSTRAINT ck CHECK (pay > 0 AND (made IS NULL)), UNIQUE (pic))\n"
           "TABLESPACE u STORAGE (INITIAL 64K)")
    s = stmts(spark, ddl)
    cols = inv.columns(s).orderBy("position").collect()
    assert [(c["column_name"], c["data_type"], c["precision"], c["scale"]) for c in cols] == [
        ("emp_id", "NUMBER", "10", None), ("pay", "NUMBER", "12", "2"), ("pic", "LONG RAW", None, None), ("made", "DATE", None, None),
        ("seen", "TIMESTAMP WITH LOCAL TIME ZONE", "6", None), ("odd", "VARCHAR2", "20", None), ("kind", "CHAR", "3", None)]
    assert [c["nullable"] for c in cols] == [False, False, True, True, True, True, True]
    assert cols[1]["default_value"] == "f(1, 2)" and cols[5]["is_primary_key"]
    cons = {c["kind"]: c for c in inv.constraints(s).collect()}
    assert cons["FOREIGN KEY"]["columns"] == ["pay", "made"] and cons["FOREIGN KEY"]["ref_table"] == "dept"
    assert cons["FOREIGN KEY"]["ref_columns"] == ["a", "b"] and cons["CHECK"]["condition"] == "pay > 0 AND (made IS NULL)"
    assert cons["UNIQUE"]["constraint_name"] is None and cons["UNIQUE"]["columns"] == ["pic"]
    obj = inv.objects(s).first()
    assert (obj["kind"], obj["schema_name"], obj["object_name"]) == ("TABLE", "hr", "emp")


def test_parameters_with_precision(spark):  # D14
    s = stmts(spark, "create or replace function f(p_a IN OUT NUMBER(12,2), p_b VARCHAR2 DEFAULT 'x,y', p_c OUT NOCOPY CLOB) return NUMBER is begin return 1; end;")
    got = [tuple(r)[3:] for r in inv.parameters(s).orderBy("position").collect()]
    assert got == [(0, None, "RETURN", "NUMBER", None), (1, "p_a", "IN OUT", "NUMBER(12,2)", None), (2, "p_b", "IN", "VARCHAR2", "'x,y'"), (3, "p_c", "OUT", "CLOB", None)]


def test_trigger_events_come_from_the_header(spark):  # D12
    s = stmts(spark, "create trigger a.trg after update or delete on hr.emp for each row when (new.x > f(1)) begin insert into log values (1); end;")
    r = inv.triggers(s).first()
    assert (r["trigger_name"], r["timing"], r["events"], r["table_name"], r["row_level"], r["when_clause"]) == (
        "trg", "AFTER", ["UPDATE", "DELETE"], "emp", True, "new.x > f(1)")


def test_other_inventories(spark):
    s = stmts(spark, "CREATE UNIQUE INDEX a.ix ON b.t (UPPER(c), d) TABLESPACE ts", "CREATE SEQUENCE s START WITH -5 INCREMENT BY -1 MINVALUE -9 MAXVALUE 9 CACHE 20 CYCLE",
              "CREATE PUBLIC SYNONYM emp FOR hr.employees", "CREATE TABLE", "SELECT /*+ x */ 1 FROM a, b WHERE a.i = b.i(+) CONNECT BY PRIOR a = b")
    props = {r["stmt_no"]: r["properties"] for r in inv.properties(s).collect()}
    assert props[1] == {"unique": "true", "bitmap": "false", "table": "t", "columns": "UPPER(c),d", "tablespace": "ts"}
    assert props[2] == {"start": "-5", "increment": "-1", "minvalue": "-9", "maxvalue": "9", "cache": "20", "cycle": "true"}
    objs = {r["stmt_no"]: r for r in inv.objects(s).collect()}
    assert objs[3]["target"] == "hr.employees" and objs[3]["is_public"]
    assert [r["stmt_no"] for r in inv.parse_errors(inv.objects(s)).collect()] == [4]
    f = inv.file_features(s).first()
    assert f["has_oracle_hints"] and f["has_connect_by"] and f["has_outer_join_plus"] and not f["has_plsql"] and f["has_synonyms"]
    used = inv.functions_used(spark.createDataFrame([(1, "select nvl(a, nvl2(b, 1, 2)), sysdate, my_decode(x) from t")], "file_id int, text string"))
    assert used.first()["functions"] == ["NVL", "NVL2", "SYSDATE"]
