"""Queries over joins, aggregates, windows, ordering, sets and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import scalar as S
from veldspar.operators import aggregates, joins, ordering, sets, windows
from veldspar.operators.hierarchy import connect_by, connect_by_doubling
from veldspar.plans.registry import query
from veldspar.sources.tables import load


@query("active_view", """
SELECT c_custkey AS employee_id, c_name || ' ' || c_mktsegment AS full_name, n_name AS department_name,
       coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, 0.0) AS salary
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0
""")
def active_view(spark, d):
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    active = c.filter(F.col("c_custkey") % 5 != 0)
    salary = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    return active.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("employee_id"),
        S.concat_ora(F.col("c_name"), " ", F.col("c_mktsegment")).alias("full_name"),
        F.col("n_name").alias("department_name"),
        S.nvl(salary, 0.0).alias("salary"),
    )


@query("outer_plus_left", """
SELECT c_custkey, o_orderkey, o_totalprice FROM customer
LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey
""")
def outer_plus_left(spark, d):
    o = load(spark, d, "orders").filter("o_totalprice > 400000")
    return joins.plus_join(load(spark, d, "customer"), o, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "o_orderkey", "o_totalprice")


@query("outer_plus_right", """
SELECT o_orderkey, c_custkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 5000)
RIGHT JOIN orders ON c_custkey = o_custkey
""")
def outer_plus_right(spark, d):
    c = load(spark, d, "customer").filter("c_acctbal > 5000")
    return joins.plus_join(c, load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "o_orderkey", "c_custkey", "c_name")


@query("dept_summary", """
SELECT n_nationkey, n_name, count(c_custkey) AS emp_count,
       coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0)::DOUBLE AS total_salary,
       coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE / nullif(count(c_custkey), 0), 0.0) AS avg_salary
FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 4 <> 0) ON n_nationkey = c_nationkey
GROUP BY n_nationkey, n_name
""")
def dept_summary(spark, d):
    c = load(spark, d, "customer").filter("c_nationkey % 4 <> 0").withColumnRenamed("c_nationkey", "n_nationkey")
    salary = F.col("c_acctbal").cast("decimal(18,2)")
    total = F.sum(salary).cast("double")
    out = aggregates.summary(
        load(spark, d, "nation").select("n_nationkey", "n_name"), c, ["n_nationkey"],
        {"emp_count": F.count("c_custkey"), "total_salary": total,
         "avg_salary": total / F.count("c_custkey")})
    return out


@query("in_subquery", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_name LIKE '%7')
""")
def in_subquery(spark, d):
    sub = load(spark, d, "customer").filter(F.col("c_name").like("%7")).select(F.col("c_custkey").alias("o_custkey"))
    return joins.in_subquery(load(spark, d, "orders"), sub, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("select_into", """
SELECT o_orderkey, c_name, c_acctbal, CASE WHEN c_custkey IS NULL THEN 'NO_DATA_FOUND' ELSE 'FOUND' END AS lookup_status
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey
""")
def select_into(spark, d):
    c = load(spark, d, "customer").filter("c_custkey % 10 <> 0").withColumnRenamed("c_custkey", "o_custkey")
    return joins.lookup_one(load(spark, d, "orders"), c, ["o_custkey"], ["c_name", "c_acctbal"]).select(
        "o_orderkey", "c_name", "c_acctbal", "lookup_status")


@query("anti_join", """
SELECT o_orderkey FROM orders WHERE NOT EXISTS
  (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0)
""")
def anti_join(spark, d):
    ref = load(spark, d, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.not_in_keys(load(spark, d, "orders"), ref, ["o_custkey"]).select("o_orderkey")


def changed_customers(c):
    """The customer table one step later: some rows gone, some raised, some added."""
    kept = c.filter("c_custkey % 10 <> 0").withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 10 == 1, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")))
    added = c.filter("c_custkey % 10 = 2").withColumn("c_custkey", F.col("c_custkey") + 1000000000)
    return kept.unionByName(added)


CHANGED_SQL = """(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 1 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
   c_mktsegment FROM customer WHERE c_custkey % 10 <> 0
 UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 2)"""


@query("compare_versions", f"""
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_acctbal AS old_c_acctbal, n.c_acctbal AS new_c_acctbal,
       CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE'
            WHEN o.c_acctbal IS NOT DISTINCT FROM n.c_acctbal THEN 'SAME' ELSE 'UPDATE' END AS change
FROM customer o FULL JOIN {CHANGED_SQL} n ON o.c_custkey = n.c_custkey
""")
def compare_versions(spark, d):
    c = load(spark, d, "customer")
    return joins.compare_versions(c, changed_customers(c), ["c_custkey"], ["c_acctbal"])


@query("changed_rows", """
WITH n AS (SELECT CASE WHEN o_orderkey % 100 = 3 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey,
                  CASE WHEN o_orderkey % 100 = 1 THEN 'X' WHEN o_orderkey % 100 = 2 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 100 <> 4)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderstatus AS old_o_orderstatus, n.s AS new_o_orderstatus,
       CASE WHEN o.o_orderkey IS NULL THEN 'INSERT' WHEN n.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change
FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.s
""")
def changed_rows(spark, d):
    """A version in which a few rows of a hundred were changed, moved or deleted."""
    old = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    part = F.col("o_orderkey") % 100
    status = F.when(part == 1, "X").when(part == 2, F.lit(None)).otherwise(F.col("o_orderstatus"))
    new = old.filter(part != 4).select((F.col("o_orderkey") + F.when(part == 3, 100000000).otherwise(0)).alias("o_orderkey"), status.alias("o_orderstatus"))
    return joins.changed_rows(old, new, ["o_orderkey"], ["o_orderstatus"])


@query("listagg", """
SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey
""")
def listagg(spark, d):
    return aggregates.listagg(load(spark, d, "nation"), ["n_regionkey"], "n_name", ", ", name="nations")


@query("listagg_by_order", """
SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS history FROM orders GROUP BY o_custkey
""")
def listagg_by_order(spark, d):
    return aggregates.listagg(
        load(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "", order="o_orderkey", name="history")


@query("wm_concat", """
SELECT l_returnflag, string_agg(CAST(l_quantity AS BIGINT)::VARCHAR, ',' ORDER BY CAST(l_quantity AS BIGINT)::VARCHAR) AS wm_concat
FROM lineitem GROUP BY l_returnflag
""")
def wm_concat(spark, d):
    q = load(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("bigint").cast("string").alias("q"))
    return aggregates.wm_concat(q, ["l_returnflag"], "q")


@query("distinct_keys", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_keys(spark, d):
    return sets.distinct_keys(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("currval", "SELECT max(o_orderkey) AS currval FROM orders")
def currval(spark, d):
    return aggregates.currval(load(spark, d, "orders"), "o_orderkey")


@query("count_or_zero", """
SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000)
ON n_nationkey = s_nationkey GROUP BY n_nationkey
""")
def count_or_zero(spark, d):
    rich = load(spark, d, "supplier").filter("s_acctbal > 9000").withColumnRenamed("s_nationkey", "n_nationkey")
    return aggregates.count_or_zero(rich, ["n_nationkey"], load(spark, d, "nation"))


@query("agg_nvl", """
SELECT o_orderpriority, coalesce(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN 1 END), 0)::BIGINT AS finished,
       coalesce(max(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END), 0.0) AS top_price
FROM orders GROUP BY o_orderpriority
""")
def agg_nvl(spark, d):
    listed = F.col("o_orderpriority") != "5-LOW"
    return aggregates.agg_nvl(load(spark, d, "orders"), ["o_orderpriority"], {
        "finished": F.sum(F.when(listed & (F.col("o_orderstatus") == "F"), 1)),
        "top_price": F.max(F.when(listed, F.col("o_totalprice"))),
    })


@query("rownum", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
""")
def rownum(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return windows.rownum(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "rn")


@query("top_earners", """
SELECT c_nationkey, c_custkey, c_acctbal, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER
  (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 10
""")
def top_earners(spark, d):
    c = load(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return windows.top_n_by(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 10)


@query("top_earners_function", """
SELECT n_nationkey, c_custkey, c_acctbal FROM (SELECT n_nationkey, c_custkey, c_acctbal, row_number() OVER
  (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey
   WHERE c_custkey % 5 <> 0) WHERE rn <= 3
""")
def top_earners_function(spark, d):
    """The pipelined function as a SQL table function, called for every nation.

    The limit is a row number: ORDER BY ... LIMIT inside a lateral call is applied once, not per call.
    """
    load(spark, d, "customer").createOrReplaceTempView("earners_customer")
    load(spark, d, "nation").createOrReplaceTempView("earners_nation")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION get_top_earners(dept INT)
                 RETURNS TABLE (c_custkey BIGINT, c_acctbal DOUBLE)
                 RETURN SELECT c_custkey, c_acctbal FROM (
                   SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place
                   FROM earners_customer WHERE c_custkey % 5 <> 0) WHERE place <= 3 AND c_nationkey = dept""")
    return spark.sql("SELECT n_nationkey, e.* FROM earners_nation, LATERAL get_top_earners(n_nationkey) e")


_OLD_NEW_SQL = """
SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events
"""


@query("old_new", _OLD_NEW_SQL)
def old_new(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return windows.old_new(e, ["user_id"], ["ts", "event_id"], ["value"]).select(
        "event_id", "user_id", "value", "old_value")


@query("old_new_hot", _OLD_NEW_SQL)
def old_new_hot(spark, d):
    """The same change feed with every key treated as hot: range partitions stitched at their edges."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return windows.old_new(e, ["user_id"], ["ts", "event_id"], ["value"], hot_rows=0).select(
        "event_id", "user_id", "value", "old_value")


@query("order_ora", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY price ASC NULLS LAST, o_orderkey) AS up,
       row_number() OVER (ORDER BY price DESC NULLS FIRST, o_orderkey) AS down FROM s
""")
def order_ora(spark, d):
    price = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))
    o = load(spark, d, "orders").select("o_orderkey", price.alias("price"))
    up = windows.rownum(o, ordering.ora_keys("price", "o_orderkey"), "up")
    down = windows.rownum(up, ordering.ora_keys("price desc", "o_orderkey"), "down")
    return down.select("o_orderkey", "up", "down")


@query("rownum_limit", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def rownum_limit(spark, d):
    o = load(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return ordering.limit_rownum(o, 100, ["o_totalprice desc", "o_orderkey"])


@query("fetch_first", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 10")
def fetch_first(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return ordering.fetch_first(c, ["c_acctbal desc", "c_custkey"], 10)


@query("page", """
SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 200
""")
def page(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_retailprice")
    return ordering.page(p, ["p_retailprice desc", "p_partkey"], 200, 50)


@query("page_deep", """
SELECT l_extendedprice, l_orderkey, l_partkey FROM lineitem
ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 500 OFFSET 20000
""")
def page_deep(spark, d):
    li = load(spark, d, "lineitem").select("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    deep = ordering.page(li, ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 20000, 500)
    return deep.select("l_extendedprice", "l_orderkey", "l_partkey")


@query("minus", """
SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey % 3 <> 0
""")
def minus(spark, d):
    used = load(spark, d, "customer").filter("c_nationkey % 3 <> 0").select("c_nationkey")
    return sets.minus(load(spark, d, "nation").select(F.col("n_nationkey").alias("k")), used)


@query("minus_nulls", """
SELECT CASE WHEN l_linenumber > 3 THEN l_suppkey END AS s, l_returnflag AS f FROM lineitem
EXCEPT SELECT CASE WHEN l_linenumber > 5 THEN l_suppkey END, l_returnflag FROM lineitem WHERE l_suppkey % 2 = 0
""")
def minus_nulls(spark, d):
    li = load(spark, d, "lineitem")
    a = li.select(F.when(F.col("l_linenumber") > 3, F.col("l_suppkey")).alias("s"), F.col("l_returnflag").alias("f"))
    b = li.filter("l_suppkey % 2 = 0").select(F.when(F.col("l_linenumber") > 5, F.col("l_suppkey")), "l_returnflag")
    return sets.minus(a, b)


def staff(spark, d):
    """Customers as employees: manager = key div 8, the root has none."""
    key = F.col("c_custkey")
    return load(spark, d, "customer").select(
        key.alias("employee_id"), F.when(key > 0, F.floor(key / 8)).alias("manager_id"), F.col("c_name").alias("name"))


_TREE_SQL = """
WITH RECURSIVE emp AS (SELECT c_custkey AS employee_id, CASE WHEN c_custkey > 0 THEN c_custkey // 8 END AS manager_id,
                              c_name AS name FROM customer),
tree AS (SELECT employee_id, manager_id, name, 1 AS level, '/' || name AS path, [name] AS names FROM emp WHERE manager_id IS NULL
         UNION ALL SELECT e.employee_id, e.manager_id, e.name, level + 1, path || '/' || e.name, list_append(names, e.name)
         FROM tree t JOIN emp e ON e.manager_id = t.employee_id)
"""


@query("connect_by", _TREE_SQL + "SELECT employee_id, manager_id, level, path FROM tree")
def connect_by_q(spark, d):
    tree = connect_by(staff(spark, d), "employee_id", "manager_id", F.col("manager_id").isNull(), path="name")
    return tree.select("employee_id", "manager_id", "level", "path")


@query("siblings_order", _TREE_SQL + """
SELECT employee_id, level, row_number() OVER (ORDER BY names) AS rn FROM tree
""")
def siblings_order(spark, d):
    tree = connect_by(staff(spark, d), "employee_id", "manager_id", F.col("manager_id").isNull(), siblings="name")
    numbered = windows.rownum(tree.select("employee_id", "level", "sibling_key"), ["sibling_key"])
    return numbered.select("employee_id", "level", "rn")


@query("connect_by_nocycle", """
WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN (SELECT max(c_custkey) FROM customer) ELSE c_custkey // 8 END AS boss
                     FROM customer),
t AS (SELECT id, boss, 1 AS level, [id] AS seen FROM e WHERE id = 0
      UNION ALL SELECT e.id, e.boss, level + 1, list_append(seen, e.id) FROM e JOIN t ON e.boss = t.id AND NOT list_contains(seen, e.id))
SELECT id, boss, level FROM t
""")
def connect_by_nocycle(spark, d):
    """A tree whose root reports to its last leaf: NOCYCLE leaves out the row that would be met again."""
    c = load(spark, d, "customer")
    last = c.agg(F.max("c_custkey").alias("last"))
    rows = c.join(F.broadcast(last), F.lit(True)).select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") == 0, F.col("last")).otherwise(F.expr("c_custkey div 8")).alias("boss"))
    return connect_by(rows, "id", "boss", F.col("id") == 0, nocycle=True).select("id", "boss", "level")


@query("connect_by_deep", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10000 <> 0 THEN o_orderkey - 1 END AS boss, CAST(o_orderkey % 10000 + 1 AS INTEGER) AS level,
       o_orderkey // 10000 * 10000 AS root FROM orders
""")
def connect_by_deep(spark, d):
    """Chains of 10,000 rows, each below the one before."""
    key = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(key.alias("id"), F.when(key % 10_000 != 0, key - 1).alias("boss"))
    return connect_by_doubling(rows, "id", "boss", F.col("boss").isNull()).select("id", "boss", "level", "root")


@query("connect_by_tree", _TREE_SQL + "SELECT employee_id, manager_id, level, path FROM tree")
def connect_by_tree(spark, d):
    """The tree of ``connect_by`` with jumps instead of levels."""
    tree = connect_by_doubling(staff(spark, d), "employee_id", "manager_id", F.col("manager_id").isNull(), path="name")
    return tree.select("employee_id", "manager_id", "level", "path")
