import os
from datetime import datetime

from pyspark.sql import functions as F

from veldspar.operators.windows import old_new
from veldspar.sources import scripts as S
from veldspar.sources import types as T
from veldspar.sources.tables import dual, temp_table
from veldspar.streaming.audit import stream_audit
from veldspar.streaming.scripts import stream_scripts


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    return path


def test_read_scripts_by_ending(spark, tmp_path):
    put(tmp_path, "a.sql", b"select 1;\n")
    put(tmp_path, "deep/er/B.PKB", b"x")
    put(tmp_path, "notes.txt", b"no")
    put(tmp_path, "bad.fnc", b"caf\xe9")
    got = {os.path.basename(r["path"]): r["text"] for r in S.read_scripts(spark, str(tmp_path)).collect()}
    assert got == {"a.sql": "select 1;\n", "B.PKB": "x", "bad.fnc": "caf�"}


def test_read_scripts_encodings(spark, tmp_path):
    text = "-- 社員表\nCREATE TABLE 社員 (id NUMBER);"
    put(tmp_path, "a.sql", text.encode("shift_jis") + b"\xff")
    assert S.read_scripts(spark, str(tmp_path), encoding="shift_jis").first()["text"] == text + "�"


def test_unreadable_file_gives_error_row(spark, tmp_path):
    put(tmp_path, "a.sql", b"select 1")
    put(tmp_path, "big.sql", b"x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    try:
        df = S.read_scripts(spark, str(tmp_path), on_unreadable="row")
        got = {os.path.basename(r["path"]): (r["text"], r["error"]) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    bad = (None, "file could not be read")
    assert got == {"a.sql": ("select 1", None), "big.sql": bad}


def test_write_scripts_names(spark, tmp_path):
    df = spark.createDataFrame([("/in/a.sql", "x\ny"), ("/in/sub/pkg.PKB", "z"), ("noext", "w")], "path string, text string")
    df = df.union(spark.createDataFrame([("/in/other/a.sql", "other")], df.schema))
    S.write_scripts(df, str(tmp_path / "out"), root="/in")
    names = sorted(n for n in os.listdir(tmp_path / "out") if n.startswith("out_name="))
    assert names == ["out_name=a_pg.sql", "out_name=noext_pg.sql", "out_name=other%2Fa_pg.sql", "out_name=sub%2Fpkg_pg.PKB"]
    back = spark.read.text(str(tmp_path / "out" / "out_name=a_pg.sql"))
    assert [r[0] for r in back.collect()] == ["x", "y"]


def test_findings_csv_and_snapshot(spark, tmp_path):
    row = ("a.sql", "FN_001", "FUNCTION", "AUTO", 'say "x", y', "訳", 3)
    df = spark.createDataFrame([row], "file string, rule_id string, category string, severity string, description string, description_local string, line int")
    S.write_findings_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == list(S.FINDING_COLUMNS.values()) and tuple(back.first())[4] == 'say "x", y'
    for run in ("r1", "r2"):
        S.snapshot(df, str(tmp_path / "snap"), run)
    assert spark.read.parquet(str(tmp_path / "snap")).filter("run_ts = 'r1'").count() == 1


def test_type_map_and_typed_load(spark):
    assert T.spark_type("NUMBER").simpleString() == "decimal(38,10)"
    assert T.spark_type("number", 12, 2).simpleString() == "decimal(12,2)"
    assert T.spark_type("Long  Raw").simpleString() == "binary"
    assert T.spark_type("NUMBER", 1, flag=True).simpleString() == "boolean"
    defs = [T.ColumnDef("id", "NUMBER", 4, nullable=False), T.ColumnDef("n", "VARCHAR2", 3), T.ColumnDef("c", "CHAR", 4),
            T.ColumnDef("d", "DATE", date_model="DD-MON-YYYY"), T.ColumnDef("r", "RAW", 2000), T.ColumnDef("f", "NUMBER", 1, flag=True),
            T.ColumnDef("y", "INTERVAL YEAR TO MONTH"), T.ColumnDef("x", "BINARY_DOUBLE")]
    assert [f.dataType.simpleString() for f in T.struct_type(defs)] == [
        "decimal(4,0)", "string", "string", "timestamp_ntz", "binary", "boolean", "interval year to month", "double"]
    good = ("7", "abc", "ab", "03-JAN-2020", "FF0A", "1", "1-2", "2.5")
    data = [good, ("70000",) + good[1:], (None,) + good[1:], ("1", "éé") + good[2:], ("1", "abc", "ab", "2020", "XY") + good[5:]]
    df = spark.createDataFrame(data, "id string, n string, c string, d string, r string, f string, y string, x string")
    ok, rejects = T.load_typed(df, defs)
    assert [f.dataType for f in ok.schema] == [f.dataType for f in T.struct_type(defs)]
    row = ok.drop("y").collect()
    assert [tuple(r) for r in row] == [(7, "abc", "ab  ", datetime(2020, 1, 3), bytearray(b"\xff\x0a"), True, 2.5)]
    assert sorted(map(tuple, [r["reject_reasons"] for r in rejects.collect()])) == [
        ("d: not a DATE", "r: not a RAW"), ("id: NULL",), ("id: not a NUMBER",), ("n: longer than 3 BYTE",)]


def test_dual_and_temp_tables(spark):
    assert [tuple(r) for r in dual(spark).collect()] == [("X",)]
    df = spark.range(3)
    with temp_table(df, "tmp_keep", "PRESERVE") as t:
        assert t.rows().count() == 3
    assert spark.table("tmp_keep").count() == 3
    t.drop()
    with temp_table(df, "tmp_gone", "DELETE") as t:
        assert t.rows().count() == 3
    assert spark.table("tmp_gone").count() == 0


def test_stream_scripts_reads_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    put(src, "a.sql", b"select sysdate from dual;\nselect nvl(a, 1) from t;")
    stream_scripts(spark, src, out, mark).awaitTermination()
    put(src, "sub/b.sql", b"select a from t minus select b from u;")
    stream_scripts(spark, src, out, mark).awaitTermination()
    stream_scripts(spark, src, out, mark).awaitTermination()
    done = spark.read.parquet(f"{out}/statements")
    assert sorted(r["new_text"] for r in done.collect()) == [
        "select COALESCE(a, 1) from t", "select CURRENT_TIMESTAMP", "select a from t EXCEPT select b from u"]
    batch_src, batch_out, batch_mark = (str(tmp_path / n) for n in ("src", "out1", "mark1"))
    stream_scripts(spark, batch_src, batch_out, batch_mark).awaitTermination()
    cols = ["path", "stmt_no", "rule_id", "severity"]
    two, one = (sorted(map(tuple, spark.read.parquet(f"{o}/findings").select(cols).collect())) for o in (out, batch_out))
    assert two == one and two


def test_stream_audit_equals_batch(spark, tmp_path):
    data = [(i, (i * 7) % 5 if i % 3 else 1, i * i % 11) for i in range(90)]
    src, out, mark = (str(tmp_path / n) for n in ("chg", "out", "mark"))
    schema = "id int, k int, v int"
    for lo in (0, 18, 36, 54, 72):
        spark.createDataFrame(data[lo:lo + 18], schema).write.mode("append").parquet(src)
        stream_audit(spark.readStream.schema(schema).parquet(src), ["k"], ["id"], ["v"], out, mark, fold_every=2).awaitTermination()
    got = spark.read.parquet(f"{out}/audit").select("id", "k", "v", "old_v", "action")
    want = old_new(spark.createDataFrame(data, schema), ["k"], ["id"], ["v"]).withColumn("first", F.row_number().over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("k").orderBy("id")) == 1)
    want = want.select("id", "k", "v", "old_v", F.when(F.col("first"), "INSERT").otherwise("UPDATE"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
