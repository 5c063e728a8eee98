"""Oracle scalar functions as Column expressions (all JVM-side).

Arguments are Columns; plain Python values are taken as literals.  ``''`` keeps Spark's meaning: it
is a string of length zero, not NULL.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions.arrays import let
from veldspar.functions.formats import format_pieces, has_element, has_names, is_number_model, number_model, spark_pattern


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# --- NULL handling and choice ---------------------------------------------------------------

def nvl(a, b) -> Column:
    return F.coalesce(as_col(a), as_col(b))


def nvl2(a, b, c) -> Column:
    return F.when(as_col(a).isNotNull(), as_col(b)).otherwise(as_col(c))


def decode_ora(expr, *pairs, default=None) -> Column:
    """DECODE: the first search value equal to ``expr`` wins, and NULL equals NULL."""
    if len(pairs) < 2 or len(pairs) % 2:
        raise ValueError("decode_ora takes search/result pairs")
    expr = as_col(expr)
    chain = F
    for search, result in zip(pairs[::2], pairs[1::2]):
        chain = chain.when(expr.eqNullSafe(as_col(search)), as_col(result))
    return chain.otherwise(as_col(default))


def check_passes(cond: Column) -> Column:
    """A CHECK condition holds unless it is false: an unknown result passes."""
    return F.coalesce(cond, F.lit(True))


# --- strings --------------------------------------------------------------------------------

def concat_ora(*parts) -> Column:
    """``||``: a NULL operand adds nothing; the result is NULL only if all operands are."""
    cols = [as_col(p).cast("string") for p in parts]
    return F.when(F.coalesce(*cols).isNotNull(), F.concat(*[F.coalesce(c, F.lit("")) for c in cols]))


def substr_ora(c, pos, length=None) -> Column:
    """SUBSTR: 1-based, 0 reads as 1, negative counts from the end, length below 1 gives NULL.

    A start before the first character gives NULL in Oracle, where Spark would return a shorter piece.
    """
    c, pos = as_col(c), as_col(pos)
    n = F.lit(2147483647) if length is None else as_col(length)
    outside = (F.abs(pos) > F.char_length(c)) | (n < 1)
    return F.when(~outside, F.substring(c, pos, n))


def instr_ora(c, sub: str, start: int = 1, nth: int = 1) -> Column:
    """INSTR: position of the nth occurrence (overlaps allowed) at or after ``start``, else 0.

    A negative start searches backwards from that many characters before the end.
    """
    if nth < 1 or not sub:
        raise ValueError("instr_ora needs a non-empty substring and nth >= 1")
    c = as_col(c)
    if start >= 0 and nth == 1:
        return F.when(F.lit(start == 0), F.lit(0)).otherwise(F.locate(sub, c, max(start, 1)))
    if start > 0:
        found = F.locate(sub, c, start)
        for _ in range(nth - 1):
            again = F.call_function("locate", F.lit(sub), c, found + 1)
            found = F.when(found > 0, again).otherwise(F.lit(0))
        return found
    if start == 0:
        return F.when(c.isNotNull(), F.lit(0))
    last = F.char_length(c) + F.lit(start + 1)
    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    hits = F.filter(starts, lambda i: F.substring(c, i, F.lit(len(sub))) == F.lit(sub))
    hits = F.when(last >= 1, hits).otherwise(F.array().cast("array<int>"))
    return F.when(
        c.isNotNull(), F.coalesce(F.get(F.reverse(hits), F.lit(nth - 1)), F.lit(0))
    )


def lengthb(c) -> Column:
    return F.octet_length(as_col(c))


def lob_length(c) -> Column:
    return F.char_length(as_col(c))


def lob_substr(c, amount: int, offset: int = 1) -> Column:
    """DBMS_LOB.SUBSTR takes the amount before the offset."""
    return F.substring(as_col(c), offset, amount)


def lob_append(c, piece) -> Column:
    return concat_ora(c, piece)


def upper(c) -> Column:
    return F.upper(as_col(c))


def regexp_like(c, pattern: str, flags: str = "") -> Column:
    """REGEXP_LIKE with match flags: i ignore case, n dot spans lines, m multi-line, x spacing."""
    inline = {"i": "i", "n": "s", "m": "m", "x": "x", "c": ""}
    try:
        prefix = "".join(inline[f] for f in flags)
    except KeyError as err:
        raise ValueError(f"unknown match flag {err}") from None
    return as_col(c).rlike(f"(?{prefix})" + pattern if prefix else pattern)


# --- conversion -----------------------------------------------------------------------------

def to_date_ora(c, model: str) -> Column:
    """TO_DATE: Oracle DATE carries a time of day, so the result is a zone-free timestamp.

    Text that does not fit the model gives NULL (see ``try_apply`` for the reject side).
    """
    c = as_col(c)
    if has_names(model):
        c = F.initcap(c)
    def read(pattern: str) -> Column:
        return F.call_function("try_to_timestamp", c, F.lit(pattern)).cast("timestamp_ntz")

    def near(parsed: Column) -> Column:  # two digits from 50 on mean the century before
        return F.when(F.year(parsed) >= 2050, parsed - F.expr("INTERVAL '100' YEAR")).otherwise(parsed)

    if has_element(model, "RRRR"):  # four digits are the year, two are read as RR
        two = re.sub("RRRR", "RR", model, flags=re.IGNORECASE)
        return F.coalesce(read(spark_pattern(model)), near(read(spark_pattern(two))))
    parsed = read(spark_pattern(model))
    return near(parsed) if has_element(model, "RR") else parsed


def to_char_ora(c, model: str, currency: str = "$") -> Column:
    """TO_CHAR of a date by a date model, or of a number by a number model (see ``to_char_number``)."""
    c = as_col(c)
    if is_number_model(model):
        return to_char_number(c, model, currency)
    fold = {"upper": F.upper, "lower": F.lower, "": lambda piece: piece}
    parts = []
    for pattern, case, width in format_pieces(model):
        text = fold[case](F.date_format(c, pattern))
        parts.append(F.rpad(text, width, " ") if width else text)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def to_char_number(c, model: str, currency: str = "$") -> Column:
    """TO_CHAR(number, model): rounded to the model's places, the sign next to the first digit, filled with blanks to the model's width.

    A number with more digits than the model is shown as #.  FM leaves out the filling and the zeros that only 9s after the point would show.  L stands for
    ``currency`` and takes up ten places, $ for a dollar sign.
    """
    m = number_model(model)
    size = len(m.places)
    value = as_col(c).cast(T.DecimalType(38, max(10, size)))

    def digits_of(v: Column) -> Column:
        text = F.round(F.abs(v), size).cast("string")
        digits = F.regexp_replace(F.regexp_extract(text, r"^(\d+)", 1), "^0+", "")
        after = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), size, "0") if size else F.lit("")
        if not m.fill:
            loose = size - len(m.places.rstrip("9"))
            after = F.regexp_replace(after, f"0{{1,{loose}}}$", "") if loose else after
        return F.struct((v < 0).alias("below"), digits.alias("digits"), after.alias("after"))

    def filled(x: Column) -> Column:
        digits = x["digits"]
        shown = F.when(F.char_length(digits) < m.forced, F.lpad(digits, m.forced, "0")).otherwise(digits) if m.forced else digits
        if not size and m.digits:  # without places a zero is shown
            shown = F.when(digits == "", "0" * max(1, m.forced)).otherwise(shown)
        return F.lpad(shown, max(1, m.digits), " ")

    def grouped(whole: Column) -> Column:
        parts, seen = [], 0
        for mark in m.whole:
            if mark == ",":
                parts.append(F.when(F.trim(F.substring(whole, 1, seen)) == "", " ").otherwise(","))
            else:
                seen += 1
                parts.append(F.substring(whole, seen, 1))
        return F.ltrim(F.concat(*parts)) if parts else F.lit("")

    def signed(below: Column, body: Column) -> Column:
        blank = " " if m.fill else ""
        pick = lambda yes, no: F.when(below, yes).otherwise(no)
        text = {"": lambda: F.concat(pick("-", blank), body), "S first": lambda: F.concat(pick("-", "+"), body), "S last": lambda: F.concat(body, pick("-", "+")),
                "MI": lambda: F.concat(body, pick("-", blank)), "PR": lambda: F.concat(pick("<", blank), body, pick(">", blank))}[m.sign]()
        return F.lpad(text, m.width, " ") if m.fill else text

    def shown(x: Column) -> Column:
        body = let(filled(x), grouped)
        if m.point and not m.fill:
            body = let(body, lambda w: F.when((w == "") & (x["after"] == ""), "0").otherwise(w))
        symbol = {"": "", "$": "$", "L": currency}[m.currency]
        body = F.concat(F.lit(symbol), body, *([F.lit("."), x["after"]] if m.point else []))
        return F.when(F.char_length(x["digits"]) > m.digits, "#" * m.width).otherwise(signed(x["below"], body))

    return F.when(value.isNotNull(), let(value, lambda v: let(digits_of(v), shown)))


def to_number_ora(c, model: str | None = None) -> Column:
    """TO_NUMBER: NULL where the text is not a number; L is read as a dollar sign, FM says nothing here."""
    c = as_col(c)
    if model is None:
        return F.trim(c).try_cast(T.DecimalType(38, 10))
    return F.try_to_number(c, F.lit(re.sub("^FM", "", model, flags=re.IGNORECASE).replace("L", "$")))


# --- dates ----------------------------------------------------------------------------------

def sysdate(as_of: datetime | None = None) -> Column:
    """SYSDATE is one value per query; pass ``as_of`` to pin it."""
    return F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()


def add_months_ora(c, months) -> Column:
    """ADD_MONTHS: keeps the time of day, and the last day of a month stays the last day."""
    c, months = as_col(c), as_col(months)
    moved = c + F.make_ym_interval(F.lit(0), months)
    day = F.to_date(c)
    stretch = F.datediff(F.last_day(F.to_date(moved)), F.to_date(moved))
    at_end = day == F.last_day(day)
    return F.when(at_end, moved + F.make_dt_interval(stretch)).otherwise(moved)


def months_between_ora(a, b) -> Column:
    """Whole months plus a 31-day fraction; equal days or two month ends count as whole months."""
    return F.months_between(as_col(a), as_col(b), roundOff=False)


def add_interval(c, years: int = 0, months: int = 0, days: int = 0, hours: int = 0,
                 mins: int = 0, secs: float = 0) -> Column:
    out = as_col(c)
    if years or months:
        out = out + F.make_ym_interval(F.lit(years), F.lit(months))
    if days or hours or mins or secs:
        out = out + F.make_dt_interval(
            F.lit(days), F.lit(hours), F.lit(mins), F.lit(secs).cast("decimal(18,6)")
        )
    return out


def trunc_date(c, unit: str = "DD") -> Column:
    """TRUNC(date, unit) on a zone-free timestamp, without passing through a session time zone."""
    c = as_col(c).cast("timestamp_ntz")
    day = F.to_date(c)
    key = unit.upper()
    if key in ("HH", "HH12", "HH24", "MI"):
        minute = F.minute(c) if key == "MI" else F.lit(0)
        return F.make_timestamp_ntz(
            F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), minute,
            F.lit(0).cast("decimal(16,6)"),
        )
    if key in ("DD", "DDD", "J"):
        start = day
    elif key in ("MM", "MON", "MONTH"):
        start = F.trunc(day, "MM")
    elif key in ("Q",):
        start = F.trunc(day, "QUARTER")
    elif key in ("YYYY", "YEAR", "YY", "Y"):
        start = F.trunc(day, "YEAR")
    elif key == "IW":
        start = F.trunc(day, "WEEK")
    elif key in ("D", "DAY", "DY"):  # weeks start on Sunday
        start = F.date_sub(day, F.dayofweek(day) - 1)
    else:
        raise ValueError(f"unknown TRUNC unit {unit!r}")
    return start.cast("timestamp_ntz")


def trunc_num(c, digits: int = 0) -> Column:
    """TRUNC(number, digits): towards zero, over the whole range of NUMBER as this library maps it (28 digits before the point)."""
    exact = as_col(c).cast(T.DecimalType(38, 10))
    return F.when(exact < 0, -F.floor(-exact, F.lit(digits))).otherwise(F.floor(exact, F.lit(digits)))


def trunc_ora(df: DataFrame, c, arg=None) -> Column:
    """TRUNC chosen by the column's type: dates are cut to a unit, numbers to digits."""
    c = as_col(c)
    dtype = df.select(c).schema[0].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return trunc_date(c, arg or "DD")
    if isinstance(dtype, T.NumericType):
        return trunc_num(c, arg or 0)
    raise TypeError(f"TRUNC is undefined for {dtype.simpleString()}")


# --- identity, nested values, XML -----------------------------------------------------------

def current_user_col() -> Column:
    return F.current_user()


def sys_guid() -> Column:
    """SYS_GUID: 32 upper-case hex digits."""
    return F.upper(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def with_rowid(df: DataFrame, name: str = "rowid") -> DataFrame:
    """ROWID of a file-backed table: file and row position, stable while the file is unchanged."""
    return df.withColumn(
        name, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    )


def varray(c, limit: int) -> Column:
    """A VARRAY(limit) value: an array longer than the declared limit is an error."""
    c = as_col(c)
    return F.when(
        F.size(c) > limit,
        F.raise_error(F.format_string("array of %d items exceeds VARRAY(%d)", F.size(c), F.lit(limit))),
    ).otherwise(c)


def varray_split(df: DataFrame, c: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose array fits VARRAY(limit), and those that an assignment would refuse; NULL fits."""
    fits = F.coalesce(F.size(c) <= limit, F.lit(True)) | F.col(c).isNull()
    return df.filter(fits), df.filter(~fits)


def nested_table(df: DataFrame, c: str, name: str = "column_value") -> DataFrame:
    """TABLE(nested): one row per element with its position; empty arrays give no row."""
    kept = [F.col(x) for x in df.columns if x != c]
    return df.select(*kept, F.posexplode(F.col(c)).alias("pos", name))


def record(**cols) -> Column:
    return F.struct(*[as_col(v).alias(k) for k, v in cols.items()])


def xml_value(c, path: str) -> Column:
    return F.xpath_string(as_col(c), F.lit(path))
