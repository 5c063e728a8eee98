"""Queries over DML, materialized views, sequences and constraint checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veldspar.functions import scalar as S
from veldspar.operators import constraints as C
from veldspar.operators import dml, mviews, sequences
from veldspar.plans.relational import CHANGED_SQL, changed_customers
from veldspar.plans.registry import query
from veldspar.session import shared_folder
from veldspar.sources.tables import load

AS_OF = datetime(2002, 1, 31, 12, 30, 15)


@query("merge_upsert", """
SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(t.c_name, s.c_name) AS c_name,
       CASE WHEN t.c_custkey IS NULL THEN 0.0 WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE s.c_acctbal END AS c_acctbal
FROM customer t FULL JOIN (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000000 END AS c_custkey, c_name,
     c_acctbal * 2 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0) s ON t.c_custkey = s.c_custkey
""")
def merge_upsert(spark, d):
    target = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    key = F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1000000000)
    source = target.filter("c_custkey % 3 = 0").withColumns(
        {"c_custkey": key, "c_acctbal": F.col("c_acctbal") * 2})
    return dml.merge_upsert(target, source, ["c_custkey"], update={"c_acctbal": F.col("src_c_acctbal")},
                            insert={"c_name": F.col("src_c_name"), "c_acctbal": 0.0})


def _update(spark, d):
    target = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    changes = load(spark, d, "part").select(
        (F.col("p_partkey") * 3).alias("c_custkey"), F.col("p_retailprice").alias("salary"))
    return dml.update_by_key(target, changes, ["c_custkey"], {"c_acctbal": F.col("src_salary")})


@query("update_by_key", """
SELECT c_custkey, coalesce(p_retailprice, c_acctbal) AS c_acctbal FROM customer LEFT JOIN part ON p_partkey * 3 = c_custkey
""")
def update_by_key(spark, d):
    return _update(spark, d)[0]


@query("update_status", """
SELECT p_partkey * 3 AS c_custkey, count(c.c_custkey) AS row_count,
       CASE WHEN count(c.c_custkey) > 0 THEN 'SUCCESS' ELSE 'NOT_FOUND' END AS status
FROM part LEFT JOIN customer c ON c.c_custkey = p_partkey * 3 GROUP BY 1
""")
def update_status(spark, d):
    return _update(spark, d)[1]


@query("update_rowcount", "SELECT count(*) AS row_count FROM customer JOIN part ON c_custkey = p_partkey * 3")
def update_rowcount(spark, d):
    return dml.row_count(_update(spark, d)[1])


def _insert(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name", F.lit(0).cast("bigint").alias("seq"))
    batch = load(spark, d, "orders").select(
        (F.col("o_custkey") * 2).alias("c_custkey"), F.lit("new").alias("c_name"), F.col("o_orderkey").alias("seq"))
    return dml.insert_unique(c, batch, ["c_custkey"], ["seq"])


_INSERT_SQL = """
WITH b AS (SELECT o_custkey * 2 AS c_custkey, o_orderkey AS seq,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
           EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey * 2) AS taken FROM orders)
"""


@query("insert_unique", _INSERT_SQL + """
SELECT c_custkey, c_name, 0::BIGINT AS seq FROM customer
UNION ALL SELECT c_custkey, 'new', seq FROM b WHERE rn = 1 AND NOT taken
""")
def insert_unique(spark, d):
    return _insert(spark, d)[0]


@query("insert_rejects", _INSERT_SQL + "SELECT c_custkey, 'new' AS c_name, seq FROM b WHERE rn > 1 OR taken")
def insert_rejects(spark, d):
    return _insert(spark, d)[1]


@query("report_insert", """
SELECT -1 AS report_id, TIMESTAMP '2002-01-31 00:00:00' AS report_date, 0.0::DOUBLE AS amount, 'header' AS description
UNION ALL
SELECT n_nationkey, TIMESTAMP '2002-01-31 00:00:00', coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0)::DOUBLE,
       'Department: ' || n_name
FROM nation LEFT JOIN (SELECT * FROM customer WHERE substr(c_mktsegment, 1, 1) <> 'B'
     AND octet_length(encode(c_name)) < 255 AND c_nationkey <> 5) ON c_nationkey = n_nationkey
GROUP BY n_nationkey, n_name
""")
def report_insert(spark, d):
    day = S.trunc_date(S.sysdate(AS_OF))
    header = spark.range(1).select(
        F.lit(-1).alias("report_id"), day.alias("report_date"), F.lit(0.0).alias("amount"),
        F.lit("header").alias("description"))
    c = load(spark, d, "customer").filter(
        (S.substr_ora(F.col("c_mktsegment"), 1, 1) != "B") & (S.lengthb(F.col("c_name")) < 255)
        & (F.col("c_nationkey") != 5)).withColumnRenamed("c_nationkey", "n_nationkey")
    return dml.report_rows(
        header, load(spark, d, "nation"), c, ["n_nationkey"],
        {"total": F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")},
        {"report_id": F.col("n_nationkey"), "report_date": day, "amount": F.col("total"),
         "description": S.concat_ora("Department: ", F.col("n_name"))})


@query("soft_delete", """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) THEN 0 ELSE 1 END AS is_active
FROM customer
""")
def soft_delete(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.lit(1).alias("is_active"))
    keys = load(spark, d, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return dml.soft_delete(c, keys, ["c_custkey"], "is_active")


_AUDIT_SQL = f"""
SELECT 'CUSTOMER' AS table_name, CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action,
       coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_acctbal AS old_c_acctbal, n.c_acctbal AS new_c_acctbal,
       'app' AS changed_by, TIMESTAMP '2002-01-31 12:30:15' AS changed_at
FROM customer o FULL JOIN {CHANGED_SQL} n ON o.c_custkey = n.c_custkey
WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal IS DISTINCT FROM n.c_acctbal
"""


@query("audit_rows", _AUDIT_SQL)
def audit_rows(spark, d):
    c = load(spark, d, "customer")
    return dml.capture_changes(c, changed_customers(c), ["c_custkey"], ["c_acctbal"], "CUSTOMER", AS_OF, "app")


@query("audit_when", f"SELECT * FROM ({_AUDIT_SQL}) WHERE coalesce(new_c_acctbal, old_c_acctbal) > 5000")
def audit_when(spark, d):
    c = load(spark, d, "customer")
    return dml.capture_changes(c, changed_customers(c), ["c_custkey"], ["c_acctbal"], "CUSTOMER", AS_OF, "app",
                               when=F.coalesce("new_c_acctbal", "old_c_acctbal") > 5000)


@query("fill_defaults", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2002-01-31 12:30:15' ELSE o_orderdate END AS hire_date,
       CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS is_active FROM orders
""")
def fill_defaults(spark, d):
    key = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(
        "o_orderkey", F.when(key % 4 != 0, F.col("o_orderdate")).alias("hire_date"),
        F.when(key % 6 != 0, 0).alias("is_active"))
    return dml.fill_defaults(rows, {"hire_date": S.sysdate(AS_OF), "is_active": F.lit(1)})


@query("fill_key", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS id FROM orders)
SELECT o_orderkey, coalesce(id, 1000000000 + 10 * (row_number() OVER (PARTITION BY id IS NULL ORDER BY o_orderkey) - 1)) AS id FROM s
""")
def fill_key(spark, d):
    rows = load(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("id"))
    return dml.fill_key(rows, "id", ["o_orderkey"], start=1000000000, inc=10)


_ORDER_STATE = """
SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS amount,
       sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(*) AS avg_amount FROM orders GROUP BY o_custkey
"""


def _state(df):
    return mviews.aggregate_state(df, ["o_custkey"], {"amount": F.col("o_totalprice").cast("decimal(18,2)")})


def _with_avg(mv):
    amount = F.col("amount").cast("double")
    return mv.select("o_custkey", "n", amount.alias("amount"), (amount / F.col("n")).alias("avg_amount"))


@query("mview_complete", _ORDER_STATE)
def mview_complete(spark, d):
    path = shared_folder(spark, "mview")
    df = _state(load(spark, d, "orders"))
    mviews.materialize_view(df, path, "DEFERRED")
    return _with_avg(mviews.refresh_complete(df, path))


@query("mview_fast", _ORDER_STATE)
def mview_fast(spark, d):
    """A view over the first years plus the merged delta of the rest equals the full recompute."""
    o = load(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz")
    mv = mviews.materialize_view(_state(o.filter(early)), shared_folder(spark, "mview"))
    return _with_avg(mviews.refresh_fast(mv, _state(o.filter(~early)), ["o_custkey"]))


@query("mview_join", """
WITH p AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 11 <> 0),
c AS (SELECT o_custkey AS c_custkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders WHERE o_orderkey % 13 <> 0)
SELECT p.c_custkey, c_name, count(price) AS n, CAST(coalesce(sum(price), 0) AS DOUBLE) AS total FROM p LEFT JOIN c USING (c_custkey) GROUP BY p.c_custkey, c_name
""")
def mview_join(spark, d):
    """Customers and their orders, refreshed by new and deleted rows on both sides."""
    customers = load(spark, d, "customer").select("c_custkey", "c_name")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), price.alias("price"), "o_orderkey")
    late = F.col("c_custkey") % 7 == 0
    before = customers.filter(~late)
    parents = customers.filter(late).withColumn("sign", F.lit(1)).unionByName(before.filter("c_custkey % 11 = 0").withColumn("sign", F.lit(-1)))
    parents = parents.unionByName(customers.filter(late & (F.col("c_custkey") % 11 == 0)).withColumn("sign", F.lit(-1)))
    new = F.col("o_orderkey") % 5 == 0
    old_orders = orders.filter(~new)
    children = orders.filter(new & (F.col("o_orderkey") % 13 != 0)).withColumn("sign", F.lit(1)).unionByName(
        old_orders.filter("o_orderkey % 13 = 0").withColumn("sign", F.lit(-1)))
    sums = {"total": F.col("price")}
    state = mviews.materialize_view(mviews.join_state(before, old_orders, ["c_custkey"], sums), shared_folder(spark, "mview"))
    after = mviews.refresh_join(state, parents, old_orders, children, ["c_custkey"], sums)
    return mviews.join_view(after).withColumn("total", F.col("total").cast("double"))


@query("nextval", """
SELECT o_orderkey, 100 + 10 * (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) AS nextval FROM orders
""")
def nextval(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sequences.nextval(o, ["o_totalprice", "o_orderkey"], start=100, inc=10).select("o_orderkey", "nextval")


@query("nextval_cycle", """
WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, CASE WHEN i < 90 THEN 100 + 10 * i ELSE 5 + 10 * ((i - 90) % 100) END AS nextval FROM s
""")
def nextval_cycle(spark, d):
    o = load(spark, d, "orders").select("o_orderkey")
    return sequences.nextval(o, ["o_orderkey"], start=100, inc=10, minv=5, maxv=995, cycle=True)


@query("nextval_blocks", "SELECT count(*) AS ids, count(*) AS n FROM lineitem")
def nextval_blocks(spark, d):
    ids = sequences.nextval_blocks(load(spark, d, "lineitem").select("l_orderkey"), cache=20)
    return ids.agg(F.count_distinct("nextval").alias("ids"), F.count(F.lit(1)).alias("n"))


def _holed(spark, d):
    key = F.col("c_custkey")
    return load(spark, d, "customer").select(
        F.when(key % 50 != 0, key).alias("id"), F.when(key % 70 != 0, F.col("c_name")).alias("name"))


_HOLED = """(SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END AS id,
                    CASE WHEN c_custkey % 70 <> 0 THEN c_name END AS name FROM customer)"""


@query("ck_not_null", f"SELECT id, name FROM {_HOLED} WHERE id IS NULL OR name IS NULL")
def ck_not_null(spark, d):
    return C.check_not_null(_holed(spark, d), ["id", "name"])


@query("ck_pk", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def ck_pk(spark, d):
    return C.check_pk(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ck_fk", """
SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
GROUP BY 1
""")
def ck_fk(spark, d):
    ref = load(spark, d, "customer").filter("c_custkey % 10 <> 0")
    return C.check_fk(load(spark, d, "orders"), ["o_custkey"], ref, ["c_custkey"])


@query("ck_check", """
SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal FROM customer)
WHERE NOT (c_acctbal > 0)
""")
def ck_check(spark, d):
    c = load(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return C.check_cond(c, F.col("c_acctbal") > 0)


@query("ck_unique", """
SELECT p_name, p_brand, count(*) AS n FROM (SELECT CASE WHEN p_size > 10 THEN p_name END AS p_name,
       CASE WHEN p_size > 20 THEN p_brand END AS p_brand FROM part) GROUP BY 1, 2
HAVING count(*) > 1 AND NOT (p_name IS NULL AND p_brand IS NULL)
""")
def ck_unique(spark, d):
    p = load(spark, d, "part").select(
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("p_name"),
        F.when(F.col("p_size") > 20, F.col("p_brand")).alias("p_brand"))
    return C.check_unique(p, ["p_name", "p_brand"])


@query("ck_length", """
SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 2000
""")
def ck_length(spark, d):
    return C.check_length(load(spark, d, "documents"), "text", 2000, "BYTE").select("doc_id")


@query("ck_report", """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderpriority END AS prio FROM orders)
SELECT 'nn_prio' AS constraint_name, 'NOT NULL' AS kind, (SELECT count(*) FROM o WHERE prio IS NULL) AS violations
UNION ALL SELECT 'pk_orders', 'PRIMARY KEY', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM o GROUP BY o_orderkey HAVING count(*) > 1))
UNION ALL SELECT 'uq_cust_date', 'UNIQUE', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM o GROUP BY o_custkey, o_orderdate HAVING count(*) > 1))
UNION ALL SELECT 'fk_cust', 'FOREIGN KEY', (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0))
UNION ALL SELECT 'ck_price', 'CHECK', (SELECT count(*) FROM o WHERE NOT (o_totalprice > 5000))
UNION ALL SELECT 'len_prio', 'LENGTH', (SELECT count(*) FROM o WHERE length(prio) > 10)
""")
def ck_report(spark, d):
    o = load(spark, d, "orders").withColumn("prio", F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderpriority")))
    ref = load(spark, d, "customer").filter("c_custkey % 10 <> 0")
    return C.check_all(o, [
        C.Constraint("nn_prio", "NOT NULL", ["prio"]),
        C.Constraint("pk_orders", "PRIMARY KEY", ["o_orderkey"]),
        C.Constraint("uq_cust_date", "UNIQUE", ["o_custkey", "o_orderdate"]),
        C.Constraint("fk_cust", "FOREIGN KEY", ["o_custkey"], ref=ref, ref_columns=["c_custkey"]),
        C.Constraint("ck_price", "CHECK", condition=F.col("o_totalprice") > 5000),
        C.Constraint("len_prio", "LENGTH", ["prio"], limit=10, unit="CHAR"),
    ])


@query("raise_if", "SELECT o_orderkey, o_totalprice FROM orders")
def raise_if(spark, d):
    """No order violates the rule, so every row passes the check."""
    checked = dml.raise_if(load(spark, d, "orders"), F.col("o_totalprice") < 0, -20001, "negative price")
    return checked.select("o_orderkey", "o_totalprice")
