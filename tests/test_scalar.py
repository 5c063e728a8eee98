from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veldspar.functions import scalar as S
from veldspar.functions.formats import spark_pattern
from veldspar.functions.text import mask_sql, normalize_newlines, strip_hints


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_nvl_nvl2_decode(spark):
    null = F.lit(None).cast("int")
    assert value(spark, S.nvl(null, 3)) == 3
    assert value(spark, S.nvl2(null, 1, 2)) == 2
    assert value(spark, S.decode_ora(null, 1, "one", None, "none", default="other")) == "none"
    assert value(spark, S.decode_ora(F.lit(7), 1, "one")) is None
    with pytest.raises(ValueError):
        S.decode_ora(null, 1)


def test_concat_ignores_nulls(spark):
    null = F.lit(None).cast("string")
    assert value(spark, S.concat_ora("a", null, 1)) == "a1"
    assert value(spark, S.concat_ora(null, null)) is None


@pytest.mark.parametrize("pos,length,want", [
    (1, 2, "ab"), (0, 2, "ab"), (-2, None, "ef"), (3, None, "cdef"), (7, 1, None), (-7, 2, None), (2, 0, None), (-3, 2, "de")])
def test_substr(spark, pos, length, want):
    assert value(spark, S.substr_ora("abcdef", pos, length)) == want


@pytest.mark.parametrize("start,nth,want", [
    (1, 1, 2), (1, 2, 4), (1, 3, 6), (1, 4, 0), (3, 1, 4), (3, 2, 6), (-1, 1, 6), (-1, 3, 2), (-3, 1, 4), (-3, 3, 0), (0, 1, 0), (-9, 1, 0)])
def test_instr(spark, start, nth, want):
    assert value(spark, S.instr_ora("banana", "a", start, nth)) == want


def test_instr_overlaps_and_null(spark):
    assert value(spark, S.instr_ora("aaa", "aa", 1, 2)) == 2
    assert value(spark, S.instr_ora(F.lit(None).cast("string"), "a", -1)) is None


@pytest.mark.parametrize("day,n,want", [
    ("2020-02-29 10:00:00", 1, datetime(2020, 3, 31, 10)), ("2020-01-31 00:00:00", 1, datetime(2020, 2, 29)),
    ("2021-01-30 00:00:00", 1, datetime(2021, 2, 28)), ("2021-02-28 05:06:07", -12, datetime(2020, 2, 29, 5, 6, 7)),
    ("2021-04-15 01:02:03", 2, datetime(2021, 6, 15, 1, 2, 3))])
def test_add_months_keeps_month_end(spark, day, n, want):
    assert value(spark, S.add_months_ora(F.lit(day).cast("timestamp_ntz"), n)) == want


def test_months_between_31_day_rule(spark):  # D7
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    assert value(spark, S.months_between_ora(ts("2021-03-31"), ts("2021-02-28"))) == 1.0
    assert value(spark, S.months_between_ora(ts("2021-03-15"), ts("2021-02-28"))) == pytest.approx(1 - 13 / 31)


def test_trunc_dispatches_on_type(spark):  # D9
    df = spark.sql("SELECT TIMESTAMP_NTZ '2021-05-19 13:14:15' AS ts, -12.789 AS n")
    row = df.select(S.trunc_ora(df, F.col("ts")).alias("d"), S.trunc_ora(df, F.col("ts"), "D").alias("w"),
                    S.trunc_ora(df, F.col("n"), 1).alias("n1"), S.trunc_ora(df, F.col("n")).alias("n0")).first()
    assert row["d"] == datetime(2021, 5, 19) and row["w"] == datetime(2021, 5, 16)
    assert float(row["n1"]) == -12.7 and float(row["n0"]) == -12


def test_date_formats(spark):
    ts = F.lit("2021-03-04 15:06:07.123456").cast("timestamp_ntz")
    assert value(spark, S.to_char_ora(ts, "DD-MON-YYYY HH24:MI:SS")) == "04-MAR-2021 15:06:07"
    assert value(spark, S.to_char_ora(ts, "Mon dd, yyyy")) == "Mar 04, 2021"
    assert value(spark, S.to_char_ora(ts, "HH:MI PM FF3")) == "03:06 PM 123"
    assert value(spark, S.to_char_ora(ts, 'YYYY"year"MM')) == "2021year03"
    assert value(spark, S.to_date_ora("04-mar-2021", "DD-MON-YYYY")) == datetime(2021, 3, 4)
    assert value(spark, S.to_date_ora("2021-02-30", "YYYY-MM-DD")) is None
    with pytest.raises(ValueError):
        spark_pattern("YYYY-XX")


def test_to_number_and_regexp_like(spark):
    assert value(spark, S.to_number_ora(" 12.5 ")) == 12.5
    assert value(spark, S.to_number_ora("x")) is None
    assert value(spark, S.regexp_like(F.lit("Abc"), "^ab", "i")) is True
    assert value(spark, S.regexp_like(F.lit("a\nb"), "a.b", "n")) is True


def test_varray_and_nested_table(spark):
    ok = F.array(F.lit(1), F.lit(2))
    assert value(spark, S.varray(ok, 2)) == [1, 2]
    with pytest.raises(Exception, match="VARRAY"):
        value(spark, S.varray(ok, 1))
    df = spark.sql("SELECT 1 AS id, array('x','y') AS a UNION ALL SELECT 2, cast(array() AS array<string>)")
    assert sorted(tuple(r) for r in S.nested_table(df, "a").collect()) == [(1, 0, "x"), (1, 1, "y")]


def test_xml_value_against_plain_parser(spark):
    import xml.etree.ElementTree as ET

    docs = [f"<o><k>{i}</k><s code='c{i}'>t &amp; {i}</s></o>" for i in range(20)]
    df = spark.createDataFrame([(x,) for x in docs], "x string")
    got = df.select("x", S.xml_value(F.col("x"), "/o/s").alias("s"), S.xml_value(F.col("x"), "/o/s/@code").alias("c")).collect()
    for row in got:
        s = ET.fromstring(row["x"]).find("s")
        assert (row["s"], row["c"]) == (s.text, s.get("code"))


def test_mask_sql(spark):
    text = "SELECT 'it''s -- no', x -- it's a comment\nFROM t /* 'a' \n -- b */ WHERE y = ''"
    assert value(spark, mask_sql(text)) == "SELECT '', x  \nFROM t   WHERE y = ''"
    long = "select '" + "a''b" * 200_000 + "' from dual"
    assert value(spark, mask_sql(long)) == "select '' from dual"


def test_newlines_and_hints(spark):
    assert value(spark, normalize_newlines("a\r\nb\rc\n")) == "a\nb\nc\n"
    assert value(spark, strip_hints("SELECT /*+ FULL(t) */ 1 /* keep */")) == "SELECT /* Oracle hint removed */ 1 /* keep */"
