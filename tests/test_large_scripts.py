import random

import pytest
from pyspark.sql import functions as F

from veldspar.operators.statements import split_statements
from veldspar.sources.large_scripts import read_lines, sections, split_large

PARTS = [
    "select 1 from t;", "-- a comment; with 'quote\nselect 2\n  from u;", "insert into t values ('it''s;\n/\n;\nend;', q'[x;\n'y'\n]');", "/* begin\n; \n*/ delete from t;",
    "update t set a = 1\n/", "create or replace procedure p is\nbegin\n  if x then null; end if;\n  y := 'a;b';\nend;\n/", "\n\n", "merge into t using s on (1 = 1); select 'two' from t; -- tail",
    "declare\n  x number;\nbegin\n  null;\nend;\n/", "create package body k as\nprocedure a is begin null; end;\nend k;\n/", "select \"a;b\", case when 1 = 1 then 2 end from t;",
    "select q'{;\n}' || nq'!\n/\n!' from t;"]


def brute(spark, text):
    df = spark.createDataFrame([(1, text)], "file_id int, text string")
    return sorted((r["stmt_no"], r["stmt_line"], r["stmt_type"], r["leading_comment"], r["text"]) for r in split_statements(df).collect())


def as_lines(spark, *texts):
    rows = [(f"f{i}", n + 1, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "path string, line_no long, line string").repartition(3)


@pytest.mark.parametrize("seed, chunk_lines", [(1, 1), (2, 3), (3, 7), (4, 1000)])
def test_ranges_give_what_one_row_gives(spark, monkeypatch, seed, chunk_lines):
    import veldspar.sources.large_scripts as large

    monkeypatch.setattr(large, "GROUP", 4)
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(6)]
    got = {}
    for r in split_large(as_lines(spark, *texts), chunk_lines).collect():
        got.setdefault(r["path"], []).append((r["stmt_no"], r["stmt_line"], r["stmt_type"], r["leading_comment"], r["text"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(f"f{i}", [])) == brute(spark, t), t


def test_sections_are_short_and_whole(spark):
    text = "\n".join(f"insert into t values ({i}, 'a;b');" for i in range(2_000)) + "\ncreate procedure p is\nbegin\n" + "  null;\n" * 50 + "end;\n/\n" + "select 1;\n" * 500
    parts = sections(as_lines(spark, text), 10).orderBy("first_line").collect()
    assert "\n".join(p["text"] for p in parts) == text
    assert max(p["text"].count("\n") for p in parts) < 80 and len(parts) > 200


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = "".join(f"insert into log values ({i}, 'line {i}; of many');\n" for i in range(3_000))
    (folder / "big.sql").write_text(text)
    (folder / "small.SQL").write_text("select 'é';\r\nselect 2;")
    (folder / "other.txt").write_text("no")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = read_lines(spark, str(folder))
        assert spark.read.text(str(folder / "big.sql")).rdd.getNumPartitions() > 4
        rows = split_large(lines, 100).orderBy("path", "stmt_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = [r for r in rows if r["path"].endswith("big.sql")]
    assert [(r["stmt_no"], r["stmt_line"]) for r in big] == [(i + 1, i + 1) for i in range(3_000)] and big[2_999]["text"] == "insert into log values (2999, 'line 2999; of many')"
    assert [(r["stmt_line"], r["text"]) for r in rows if not r["path"].endswith("big.sql")] == [(1, "select 'é'"), (2, "select 2")]


def test_of_nothing(spark):
    none = spark.createDataFrame([], "path string, line_no long, line string")
    assert split_large(none).count() == 0
    assert split_large(as_lines(spark, "", "-- only\n")).select("text").collect() == [("-- only",)]


def test_only_what_is_needed_is_stored(spark, tmp_path, monkeypatch):
    import veldspar.sources.large_scripts as large

    (tmp_path / "big.sql").write_text("".join(f"insert into log values ({i}, 'a;b');\n" for i in range(300)))
    (tmp_path / "small.sql").write_text("select 1;\nselect 2;\n")
    stored, plain = {}, large.materialize
    monkeypatch.setattr(large, "materialize", lambda d, label: stored.setdefault(label, plain(d, label)))
    found = large.split_archive(spark, str(tmp_path), 1_000)
    assert found.count() == 302
    assert stored["script-lines"].count() == 300  # not the lines of small scripts
    assert "text" not in stored["chunk-facts"].columns
