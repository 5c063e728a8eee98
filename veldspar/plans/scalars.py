"""Queries over scalar functions, predicates and one-row sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veldspar.functions import scalar as S
from veldspar.functions.text import normalize_newlines
from veldspar.operators.dml import try_apply
from veldspar.plans.registry import query
from veldspar.sources.tables import dual, load, run_sql, synonym, temp_table

AS_OF = datetime(2002, 1, 31, 12, 30, 15)


@query("concat_ora", """
SELECT c_custkey, c_name || ':' || coalesce(n_name, '') AS label
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey
""")
def concat_ora(spark, d):
    nation = load(spark, d, "nation").filter("n_regionkey < 3")
    joined = load(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", S.concat_ora(F.col("c_name"), ":", F.col("n_name")).alias("label"))


@query("filter_and", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice >= 250000 AND o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1998-01-01'
""")
def filter_and(spark, d):
    return load(spark, d, "orders").filter(
        (F.col("o_totalprice") >= 250000) & (F.col("o_orderstatus") != "P")
        & (F.col("o_orderdate") >= F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz"))
    ).select("o_orderkey", "o_totalprice")


@query("like_filter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def like_filter(spark, d):
    return load(spark, d, "part").filter(F.col("p_name").like("%ring%")).select("p_partkey", "p_name")


@query("regexp_like", """
SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^customer#0+[1-5]', 'i')
""")
def regexp_like(spark, d):
    c = load(spark, d, "customer")
    return c.filter(S.regexp_like(F.col("c_name"), "^customer#0+[1-5]", "i")).select("c_custkey", "c_name")


@query("null_filter", """
SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 480000) o
ON c_custkey = o_custkey WHERE o_custkey IS NULL AND c_mktsegment IS NOT NULL
""")
def null_filter(spark, d):
    big = load(spark, d, "orders").filter("o_totalprice > 480000").select("o_custkey").distinct()
    joined = load(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.filter(F.col("o_custkey").isNull() & F.col("c_mktsegment").isNotNull()).select("c_custkey")


@query("bind_param", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal > 1000.0")
def bind_param(spark, d):
    load(spark, d, "customer").createOrReplaceTempView("bind_param_customer")
    return run_sql(
        spark,
        "SELECT c_custkey, c_acctbal FROM bind_param_customer WHERE c_nationkey = :nation AND c_acctbal > :floor",
        {"nation": 7, "floor": 1000.0},
    )


@query("normalize_newlines", r"""
SELECT doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)), '\r\n?', chr(10), 'g') AS text FROM documents
""")
def normalize_newlines_q(spark, d):
    dos = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return load(spark, d, "documents").select("doc_id", normalize_newlines(dos).alias("text"))


@query("from_dual", """
SELECT o_orderkey, o_orderkey * 2 + 1 AS odd, 'X' AS dummy FROM orders
""")
def from_dual(spark, d):
    dual(spark).createOrReplaceTempView("dual")
    load(spark, d, "orders").createOrReplaceTempView("from_dual_orders")
    return spark.sql("""SELECT o_orderkey, o_orderkey * (SELECT 1 + 1 FROM dual) + 1 AS odd, (SELECT dummy FROM dual) AS dummy
                        FROM from_dual_orders""")


@query("sysdate_fixed", """
SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2002-01-31 12:30:15') AS age_days,
       TIMESTAMP '2002-01-31 12:30:15' AS as_of FROM orders
""")
def sysdate_fixed(spark, d):
    now = S.sysdate(AS_OF)
    return load(spark, d, "orders").select(
        "o_orderkey", F.datediff(now, "o_orderdate").cast("bigint").alias("age_days"), now.alias("as_of")
    )


def _commission():
    return F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))


@query("nvl", """
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, 0.0) AS commission FROM customer
""")
def nvl(spark, d):
    return load(spark, d, "customer").select("c_custkey", S.nvl(_commission(), 0.0).alias("commission"))


@query("nvl2", """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_acctbal IS NOT NULL THEN c_acctbal * 2 ELSE -1.0 END AS total
FROM customer
""")
def nvl2(spark, d):
    return load(spark, d, "customer").select(
        "c_custkey", S.nvl2(_commission(), F.col("c_acctbal") * 2, -1.0).alias("total"))


@query("decode", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders)
SELECT o_orderkey, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'F' THEN 'final'
       WHEN status = 'O' THEN 'open' ELSE 'other' END AS status_name FROM s
""")
def decode(spark, d):
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    return load(spark, d, "orders").select("o_orderkey", S.decode_ora(
        status, None, "missing", "F", "final", "O", "open", default="other").alias("status_name"))


@query("to_date", """
WITH s AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'not a date' ELSE strftime(ts, '%d-%b-%Y %H:%M:%S') END AS t
           FROM events)
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strptime(t, '%d-%b-%Y %H:%M:%S') END AS ts FROM s
""")
def to_date(spark, d):
    text = F.when(F.col("event_id") % 10 == 0, "not a date").otherwise(
        F.upper(F.date_format("ts", "dd-MMM-yyyy HH:mm:ss")))
    return load(spark, d, "events").select("event_id", S.to_date_ora(text, "DD-MON-YYYY HH24:MI:SS").alias("ts"))


@query("to_char", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, upper(strftime(ts, '%d-%b-%y')) AS short,
       strftime(ts, 'at %I.%M %p') AS clock FROM events
""")
def to_char(spark, d):
    ts = F.col("ts")
    return load(spark, d, "events").select(
        "event_id",
        S.to_char_ora(ts, "YYYY-MM-DD HH24:MI:SS").alias("iso"),
        S.to_char_ora(ts, "DD-MON-YY").alias("short"),
        S.to_char_ora(ts, '"at "HH12.MI PM').alias("clock"),
    )


@query("to_char_number", """
WITH v AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * CAST(o_totalprice AS DECIMAL(18, 2)) AS p FROM orders),
w AS (SELECT *, format('{:,.2f}', CAST(abs(p) AS DOUBLE)) AS grouped, printf('%.2f', CAST(abs(p) AS DOUBLE)) AS plain, p < 0 AS neg FROM v)
SELECT o_orderkey, lpad(CASE WHEN neg THEN '-' ELSE '' END || grouped, 15, ' ') AS money,
       lpad(CASE WHEN neg THEN '-' ELSE '+' END || printf('%08d', CAST(floor(abs(p)) AS BIGINT)), 9, ' ') AS signed_,
       lpad(plain || CASE WHEN neg THEN '-' ELSE ' ' END, 13, ' ') AS after, lpad(CASE WHEN neg THEN '<' || plain || '>' ELSE ' ' || plain || ' ' END, 14, ' ') AS brackets,
       CASE WHEN neg THEN '-' ELSE '' END || regexp_replace(plain, '0{1,2}$', '') AS short_, lpad(CASE WHEN neg THEN '-$' ELSE '$' END || grouped, 16, ' ') AS dollars,
       CASE WHEN abs(p) >= 99999.95 THEN '########' ELSE lpad(CASE WHEN neg THEN '-' ELSE '' END || printf('%.1f', round(abs(p), 1)), 8, ' ') END AS narrow
FROM w
""")
def to_char_number(spark, d):
    p = F.col("o_totalprice").cast("decimal(18,2)") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    whole = p - p % 1
    return load(spark, d, "orders").select(
        "o_orderkey", S.to_char_ora(p, "999,999,990.99").alias("money"),
        S.to_char_ora(whole, "S00000000").alias("signed_"), S.to_char_ora(p, "999999990.00MI").alias("after"), S.to_char_ora(p, "999999999.99PR").alias("brackets"),
        S.to_char_ora(p, "FM999999990.99").alias("short_"), S.to_char_ora(p, "$999G999G990D00").alias("dollars"),
        S.to_char_ora(p, "99999.9").alias("narrow"))


@query("date_models", """
SELECT o_orderkey, day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) AS short_,
       upper(rpad(monthname(o_orderdate), 9, ' ')) || ' ' || strftime(o_orderdate, '%d') AS filled, monthname(o_orderdate) || ' ' || day(o_orderdate) AS named,
       make_timestamp(CASE WHEN year(o_orderdate) % 100 >= 50 THEN 1900 ELSE 2000 END + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate), 0, 0, 0) AS two_digits,
       date_trunc('day', o_orderdate) AS four_digits
FROM orders
""")
def date_models(spark, d):
    day = F.col("o_orderdate")
    return load(spark, d, "orders").select(
        "o_orderkey", S.to_char_ora(day, "FMDD.MM.YYYY").alias("short_"), S.to_char_ora(day, "MONTH DD").alias("filled"), S.to_char_ora(day, "FMMonth DD").alias("named"),
        S.to_date_ora(F.date_format(day, "dd/MM/yy"), "DD/MM/RRRR").alias("two_digits"), S.to_date_ora(F.date_format(day, "dd/MM/yyyy"), "DD/MM/RRRR").alias("four_digits"))


@query("to_number", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
       o_orderkey * 1000 AS grouped FROM orders
""")
def to_number(spark, d):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    bad = F.when(F.col("o_orderkey") % 5 == 0, F.concat(price, F.lit("x"))).otherwise(F.concat(F.lit(" "), price))
    grouped = F.format_number(F.col("o_orderkey") * 1000, 0)
    return load(spark, d, "orders").select(
        "o_orderkey", S.to_number_ora(bad).cast("double").alias("price"),
        S.to_number_ora(grouped, "999,999,999,999,999").cast("bigint").alias("grouped"),
    )


@query("substr", """
SELECT p_partkey, substr(p_name, 1, 4) AS from_zero, substr(p_name, 3) AS tail,
       CASE WHEN length(p_name) >= 3 THEN right(p_name, 3) END AS ending,
       CASE WHEN length(p_name) >= 12 THEN substr(p_name, 12, 2) END AS far FROM part
""")
def substr(spark, d):
    n = F.col("p_name")
    return load(spark, d, "part").select(
        "p_partkey", S.substr_ora(n, 0, 4).alias("from_zero"), S.substr_ora(n, 3).alias("tail"),
        S.substr_ora(n, -3).alias("ending"), S.substr_ora(n, 12, 2).alias("far"))


@query("instr", """
WITH s AS (SELECT p_partkey, p_name, instr(p_name, 'e') AS first FROM part)
SELECT p_partkey, first,
       CASE WHEN instr(substr(p_name, 4), 'e') > 0 THEN instr(substr(p_name, 4), 'e') + 3 ELSE 0 END AS from_four,
       CASE WHEN first > 0 AND instr(substr(p_name, first + 1), 'e') > 0
            THEN first + instr(substr(p_name, first + 1), 'e') ELSE 0 END AS second,
       CASE WHEN instr(p_name, 'e') > 0 THEN length(p_name) - instr(reverse(p_name), 'e') + 1 ELSE 0 END AS last
FROM s
""")
def instr(spark, d):
    n = F.col("p_name")
    out = {"first": S.instr_ora(n, "e"), "from_four": S.instr_ora(n, "e", 4),
           "second": S.instr_ora(n, "e", 1, 2), "last": S.instr_ora(n, "e", -1)}
    return load(spark, d, "part").select("p_partkey", *[c.cast("bigint").alias(k) for k, c in out.items()])


@query("lengthb", "SELECT doc_id, octet_length(encode(text)) AS bytes, length(text) AS chars FROM documents")
def lengthb(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", S.lengthb(t).cast("bigint").alias("bytes"), S.lob_length(t).cast("bigint").alias("chars"))


@query("rowid", "SELECT count(*) AS rowids, count(*) AS n FROM orders")
def rowid(spark, d):
    return S.with_rowid(load(spark, d, "orders")).agg(
        F.count_distinct("rowid").alias("rowids"), F.count(F.lit(1)).alias("n"))


@query("current_user", "SELECT n_nationkey, true AS named, 1::BIGINT AS users FROM nation")
def current_user(spark, d):
    """One user for all rows, by a name that isn't empty."""
    rows = load(spark, d, "nation").select("n_nationkey", S.current_user_col().alias("db_user"))
    users = rows.agg(F.count_distinct("db_user").alias("users"))
    return rows.join(F.broadcast(users), F.lit(True)).select("n_nationkey", (F.length("db_user") > 0).alias("named"), "users")


@query("sys_guid", "SELECT count(*) AS guids, count(*) AS well_formed FROM orders")
def sys_guid(spark, d):
    ids = load(spark, d, "orders").select("o_orderkey", S.sys_guid().alias("guid"))
    return ids.agg(F.count_distinct("guid").alias("guids"),
                   F.count_if(F.col("guid").rlike("^[0-9A-F]{32}$")).alias("well_formed"))


_ADD_MONTHS_SQL = """CASE WHEN CAST({c} AS DATE) = last_day(CAST({c} AS DATE))
            THEN CAST(last_day(CAST({c} + to_months({n}) AS DATE)) AS TIMESTAMP) + ({c} - date_trunc('day', {c}))
            ELSE {c} + to_months({n}) END"""


@query("add_months", f"""
SELECT o_orderkey, {_ADD_MONTHS_SQL.format(c='ts', n=1)} AS next_month, {_ADD_MONTHS_SQL.format(c='ts', n=-13)} AS before
FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS ts FROM orders)
""")
def add_months(spark, d):
    ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))
    rows = load(spark, d, "orders").select("o_orderkey", ts.alias("ts"))
    return rows.select("o_orderkey", S.add_months_ora(F.col("ts"), 1).alias("next_month"),
                       S.add_months_ora(F.col("ts"), -13).alias("before"))


@query("months_between", """
WITH s AS (SELECT event_id, TIMESTAMP '2024-02-29 06:00:00' + to_hours(CAST(event_id % 9000 AS INTEGER)) AS a, ts AS b FROM events),
t AS (SELECT *, (year(a) - year(b)) * 12 + month(a) - month(b) AS whole,
      CAST(a AS DATE) = last_day(CAST(a AS DATE)) AND CAST(b AS DATE) = last_day(CAST(b AS DATE)) AS ends FROM s)
SELECT event_id, CASE WHEN ends OR day(a) = day(b) THEN whole::DOUBLE
       ELSE whole + ((day(a) - day(b)) * 86400 + hour(a) * 3600 + minute(a) * 60 + second(a)
            - hour(b) * 3600 - minute(b) * 60 - second(b)) / 2678400.0::DOUBLE END AS months FROM t
""")
def months_between(spark, d):
    a = F.lit(datetime(2024, 2, 29, 6)).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), (F.col("event_id") % 9000).cast("int"))
    return load(spark, d, "events").select(
        "event_id", S.months_between_ora(a, F.col("ts")).alias("months"))


@query("trunc_date", """
SELECT event_id, date_trunc('day', ts) AS dd, date_trunc('month', ts) AS mm, date_trunc('quarter', ts) AS q,
       date_trunc('year', ts) AS yyyy, date_trunc('hour', ts) AS hh, date_trunc('minute', ts) AS mi,
       date_trunc('week', ts) AS iw,
       date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS d FROM events
""")
def trunc_date(spark, d):
    df = load(spark, d, "events")
    units = {"dd": "DD", "mm": "MM", "q": "Q", "yyyy": "YYYY", "hh": "HH24", "mi": "MI", "iw": "IW", "d": "D"}
    return df.select("event_id", *[S.trunc_ora(df, F.col("ts"), u).alias(n) for n, u in units.items()])


@query("trunc_num", """
WITH s AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS cents
           FROM orders)
SELECT o_orderkey, (cents // 10) / 10.0 AS one_digit, CAST(cents // 100 AS DOUBLE) AS whole,
       CAST(cents // 100000 * 1000 AS DOUBLE) AS thousands FROM s
""")
def trunc_num(spark, d):
    df = load(spark, d, "orders").withColumn(
        "x", F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1))
    return df.select("o_orderkey", *[
        S.trunc_ora(df, F.col("x"), k).cast("double").alias(n)
        for n, k in (("one_digit", 1), ("whole", 0), ("thousands", -3))])


@query("upper_key", """
SELECT upper(p_name) AS key, count(*) AS n FROM part GROUP BY 1
""")
def upper_key(spark, d):
    return load(spark, d, "part").groupBy(S.upper(F.col("p_name")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("interval_add", """
SELECT event_id, ts + INTERVAL 1 YEAR + INTERVAL 2 MONTH AS later, ts + INTERVAL 36 HOUR + INTERVAL 15 MINUTE AS soon
FROM events
""")
def interval_add(spark, d):
    return load(spark, d, "events").select(
        "event_id", S.add_interval(F.col("ts"), years=1, months=2).alias("later"),
        S.add_interval(F.col("ts"), days=1, hours=12, mins=15).alias("soon"))


@query("varray_cap", """
SELECT doc_id, CASE WHEN len(string_split(text, ' ')) <= 400 THEN 'KEPT' ELSE 'REFUSED' END AS status,
       len(string_split(text, ' ')) AS items, CASE WHEN len(string_split(text, ' ')) <= 400 THEN text END AS joined FROM documents
""")
def varray_cap(spark, d):
    """Whole texts as VARRAY(400): those that fit, and those that are refused."""
    words = load(spark, d, "documents").select("doc_id", F.split("text", " ").alias("a"))
    kept, refused = S.varray_split(words, "a", 400)
    kept = kept.select("doc_id", F.lit("KEPT").alias("status"), S.varray(F.col("a"), 400).alias("a"))
    kept = kept.select("doc_id", "status", F.size("a").cast("bigint").alias("items"), F.array_join("a", " ").alias("joined"))
    return kept.unionByName(refused.select("doc_id", F.lit("REFUSED").alias("status"), F.size("a").cast("bigint").alias("items"),
                                           F.lit(None).cast("string").alias("joined")))


@query("nested_explode", """
SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos,
       unnest(string_split(text, chr(10))) AS line FROM documents
""")
def nested_explode(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return S.nested_table(docs, "lines", "line")


@query("record_fields", """
SELECT c_custkey, c_name AS emp_name, round(c_acctbal, 2) AS salary FROM customer WHERE c_acctbal > 0
""")
def record_fields(spark, d):
    emp = load(spark, d, "customer").select(S.record(
        emp_id=F.col("c_custkey"), emp_name=F.col("c_name"), salary=F.round("c_acctbal", 2)).alias("emp"))
    return emp.filter("emp.salary > 0").select(
        F.col("emp.emp_id").alias("c_custkey"), "emp.emp_name", "emp.salary")


@query("xml_value", "SELECT o_orderkey, o_orderkey AS key, o_orderstatus AS status FROM orders")
def xml_value(spark, d):
    """Values written into XML text and read back."""
    xml = F.format_string("<order><key>%d</key><status code='%s'/></order>", "o_orderkey", "o_orderstatus")
    return load(spark, d, "orders").select(
        "o_orderkey", S.xml_value(xml, "/order/key").cast("bigint").alias("key"),
        S.xml_value(xml, "/order/status/@code").alias("status"))


@query("lob_substr", """
SELECT doc_id, substr(text, 11, 40) AS piece, substr(text, 11, 40) || '...' AS marked FROM documents
""")
def lob_substr(spark, d):
    piece = S.lob_substr(F.col("text"), 40, 11)
    return load(spark, d, "documents").select(
        "doc_id", piece.alias("piece"), S.lob_append(piece, "...").alias("marked"))


@query("try_split", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN raw = 'n/a' THEN NULL ELSE CAST(raw AS BIGINT) END AS value,
       CASE WHEN raw = 'n/a' THEN 'not a number: n/a' END AS error_text FROM s
""")
def try_split(spark, d):
    raw = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    rows = load(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    ok, err = try_apply(rows, "raw", F.col("raw").try_cast("bigint"), "value", "not a number")
    return ok.select("o_orderkey", "value", F.lit(None).cast("string").alias("error_text")).unionByName(
        err.select("o_orderkey", F.lit(None).cast("bigint").alias("value"), "error_text"))


@query("temp_table", """
SELECT o_orderstatus, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS amount FROM orders
WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1
""")
def temp_table_q(spark, d):
    early = load(spark, d, "orders").filter("o_orderdate < TIMESTAMP_NTZ '1999-01-01'").select(
        "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    held = temp_table(early, "temp_report_data", "PRESERVE")
    with held:
        rows = held.rows()
    return rows.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("synonym_view", """
SELECT n_regionkey, count(*) AS n, max(n_name) AS last_name FROM nation GROUP BY n_regionkey
""")
def synonym_view(spark, d):
    load(spark, d, "nation").createOrReplaceTempView("hr_nation")
    return synonym(spark, "nat", "hr_nation").groupBy("n_regionkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_name").alias("last_name"))


@query("sql_function", """
SELECT c_custkey, coalesce(c_acctbal, 0) * 2 + 5 AS raised FROM customer
""")
def sql_function(spark, d):
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION raise_salary(salary DOUBLE, bonus DOUBLE DEFAULT 5)
                 RETURNS DOUBLE RETURN coalesce(salary, 0) * 2 + bonus""")
    load(spark, d, "customer").createOrReplaceTempView("sql_function_customer")
    return spark.sql("SELECT c_custkey, raise_salary(c_acctbal) AS raised FROM sql_function_customer")
