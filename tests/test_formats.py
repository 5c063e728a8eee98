from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veldspar.functions import scalar as S

# (number, model, text)
NUMBERS = [
    ("1234.5", "9,999.99", " 1,234.50"), ("-1234.5", "9,999.99", "-1,234.50"), ("0.5", "99.9", "   .5"), ("0.5", "90.9", "  0.5"), ("0", "99", "  0"), ("0", "99.99", "   .00"),
    ("12345", "999", "####"), ("-12", "S99", "-12"), ("12", "S99", "+12"), ("-12", "99S", "12-"), ("12", "99S", "12+"), ("-12", "99MI", "12-"), ("12", "99MI", "12 "),
    ("-12", "99PR", "<12>"), ("12", "99PR", " 12 "), ("7", "0000", " 0007"), ("1.5", "FM99.99", "1.5"), ("1", "FM99.99", "1."), ("0", "FM99.99", "0."), ("0.5", "FM99.99", ".5"),
    ("1", "FM99.00", "1.00"), ("1234567", "FM9,999,999", "1,234,567"), ("12", "9,999", "    12"), ("12", "0,099", " 0,012"), ("9.995", "9.99", "#####"), ("1.005", "9.99", " 1.01"),
    ("-0.4", "9", "-0"), ("1234", "$9,999", " $1,234"), ("-5", "FM$99D00", "-$5.00"), ("5", "L99", "           $5"), ("1234.5", "9G999D99", " 1,234.50"), ("-5", "FM99PR", "<5>"),
    (None, "99", None), ("3", ".99", "####")]


def test_number_models(spark):
    df = spark.range(1)
    got = df.select(*[S.to_char_ora(F.lit(None if n is None else Decimal(n)).cast("decimal(20,6)"), m).alias(f"c{i}") for i, (n, m, _) in enumerate(NUMBERS)]).first()
    assert [(n, m, got[i]) for i, (n, m, _) in enumerate(NUMBERS)] == NUMBERS
    for bad in ("9X9", "S99S", "", ",99", "L99$", "9.9.9"):
        with pytest.raises(ValueError):
            S.to_char_number(F.lit(1), bad)
    assert df.select(S.to_number_ora(F.lit("$1,234.50"), "FML9,999.99")).first()[0] == Decimal("1234.50")
    assert df.select(S.to_number_ora(F.lit("x"), "99")).first()[0] is None


def test_date_models_with_fm_and_rrrr(spark):
    day = F.lit(datetime(2021, 3, 4, 9, 6, 7)).cast("timestamp_ntz")
    models = ["FMDD.MM.YYYY HH24:MI", "FMDDFM-MM", "MONTH|", "Month|", "FMMonth|", "DAY|", "FMDay DD", "DD MON"]
    got = spark.range(1).select(*[S.to_char_ora(day, m).alias(f"c{i}") for i, m in enumerate(models)]).first()
    assert list(got) == ["4.3.2021 9:6", "4-03", "MARCH    |", "March    |", "March|", "THURSDAY |", "Thursday 4", "04 MAR"]
    texts = ["04/03/21", "04/03/1921", "4/3/51", "04/03/2051", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(S.to_date_ora(F.col("t"), "FMDD/MM/RRRR").cast("date").cast("string")).collect()]
    assert got == ["2021-03-04", "1921-03-04", "1951-03-04", "2051-03-04", None, None]
