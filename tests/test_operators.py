import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veldspar.functions.arrays import running_totals
from veldspar.operators import aggregates, constraints, dml, joins, mviews, ordering, sequences, sets, skew, windows
from veldspar.operators.hierarchy import connect_by, connect_by_doubling
from veldspar.session import materialize


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """2,000 rows of which a third share one key, some without a key."""
    rnd = random.Random(3)
    data = [(i, 1 if i % 3 == 0 else None if i % 50 == 1 else rnd.randrange(40), rnd.randrange(100)) for i in range(2000)]
    return spark.createDataFrame(data, "id int, k int, v int").repartition(5)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_plain_join(spark, hot, how, monkeypatch):
    lookup = spark.createDataFrame([(i, f"n{i}") for i in range(0, 40, 2)] + [(1, "hot"), (99, "unused")], "k int, name string")
    want = rows(hot.join(lookup, ["k"], how))
    assert rows(skew.lookup_join(hot, lookup, ["k"], how)) == want
    monkeypatch.setattr(skew, "fits_broadcast", lambda *a, **k: False)
    assert rows(skew.lookup_join(hot, lookup, ["k"], how)) == want
    assert rows(skew.lookup_join(hot, lookup, ["k"], how, hot_rows=100)) == want
    assert rows(skew.lookup_join(hot.repartition(1), lookup, ["k"], how, hot_rows=7)) == want


def test_broadcast_bounds(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id").alias("a"))
    assert skew.fits_broadcast(df) and not skew.fits_broadcast(df, max_rows=99)
    assert not skew.fits_broadcast(df, max_bytes=90_000) and skew.fits_broadcast(df.select("id"), max_bytes=1)


def test_old_new_hot_keys(spark, hot):
    want = rows(windows.old_new(hot, ["k"], ["v", "id"], ["v"]))
    assert rows(windows.old_new(hot, ["k"], ["v", "id"], ["v"], hot_rows=10)) == want


def test_listagg_order_nulls_and_repeats(spark):
    df = spark.createDataFrame(
        [("a", "x", 2), ("a", "y", 1), ("a", None, 0), ("a", "x", 2), ("b", None, 1), ("a", "z", None)], "g string, s string, o int")
    assert rows(aggregates.listagg(df, ["g"], "s", "-", order="o")) == [("a", "y-x-x-z"), ("b", None)]
    assert rows(aggregates.wm_concat(df, ["g"], "s")) == [("a", "x,x,y,z"), ("b", None)]


def test_plus_join_and_lookup_one(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "y int, n string")
    on = F.col("x") == F.col("y")
    assert rows(joins.plus_join(a, b, on)) == [(1, None, None), (2, 2, "b")]
    assert rows(joins.plus_join(a, b, on, "left")) == [(2, 2, "b"), (None, 3, "c")]
    ref = b.withColumnRenamed("y", "x")
    assert rows(joins.lookup_one(a, ref, ["x"], ["n"])) == [(1, None, "NO_DATA_FOUND"), (2, "b", "FOUND")]
    with pytest.raises(Exception, match="TOO_MANY_ROWS"):
        joins.lookup_one(a, ref.union(ref), ["x"], ["n"]).collect()


def test_minus_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (None, None)], "a int, b string")
    b = spark.createDataFrame([(None, None), (2, "y")], "a int, b string")
    assert rows(sets.minus(a, b)) == [(1, None), (2, "x")]


def test_oracle_null_order_and_pages(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i) for i in range(20)], "id int, v int")
    up = [r["id"] for r in ordering.order_ora(df, "v", "id").collect()]
    assert up[-5:] == [0, 4, 8, 12, 16]
    assert [r["id"] for r in ordering.order_ora(df, "v desc", "id").collect()][:5] == [0, 4, 8, 12, 16]
    want = rows(ordering.page(df, ["v desc", "id"], 7, 6))
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 3)
    assert rows(ordering.page(df, ["v desc", "id"], 7, 6)) == want and len(want) == 6


def test_nextval_dense_and_cycling(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("o", F.col("id") * 37 % 1000)
    got = {r["o"]: r["nextval"] for r in sequences.nextval(df, ["o"], start=5, inc=3).collect()}
    assert got == {o: 5 + 3 * o for o in range(1000)}
    cyc = [r["nextval"] for r in sequences.nextval(df, ["o"], start=8, inc=2, minv=1, maxv=13, cycle=True).orderBy("o").collect()]
    assert cyc[:11] == [8, 10, 12, 1, 3, 5, 7, 9, 11, 13, 1]
    down = [r["nextval"] for r in sequences.nextval(df, ["o"], start=-1, inc=-4, minv=-9, maxv=0, cycle=True).orderBy("o").collect()]
    assert down[:5] == [-1, -5, -9, 0, -4]
    with pytest.raises(Exception, match="does not cycle"):
        sequences.nextval(df, ["o"], maxv=10).collect()


def test_nextval_empty_and_blocks(spark):
    assert sequences.nextval(spark.range(0), ["id"]).count() == 0
    ids = [r["nextval"] for r in sequences.nextval_blocks(spark.range(0, 500, 1, 6), cache=20).collect()]
    assert len(set(ids)) == 500


def test_connect_by_levels_paths_and_cycles(spark):
    edges = [(1, None, "a"), (2, 1, "c"), (3, 1, "b"), (4, 3, "d"), (9, 8, "orphan")]
    df = spark.createDataFrame(edges, "id int, mgr int, n string")
    tree = connect_by(df, "id", "mgr", F.col("mgr").isNull(), path="n", siblings="n")
    assert rows(tree.select("id", "level", "path")) == [(1, 1, "/a"), (2, 2, "/a/c"), (3, 2, "/a/b"), (4, 3, "/a/b/d")]
    assert [r["id"] for r in tree.orderBy("sibling_key").collect()] == [1, 3, 4, 2]
    assert connect_by(df, "id", "mgr", F.col("mgr").isNull(), max_depth=2).count() == 3
    assert connect_by(df, "id", "mgr", F.col("id") == 77).count() == 0
    loop = df.union(spark.createDataFrame([(5, 6, "e"), (6, 5, "f")], df.schema))
    with pytest.raises(Exception, match="CONNECT BY loop"):
        connect_by(loop, "id", "mgr", F.col("id") == 5)
    assert rows(connect_by(loop, "id", "mgr", F.col("id") == 5, nocycle=True).select("id", "level")) == [(5, 1), (6, 2)]


def test_merge_and_updates(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, n string, v double")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "id int, n string")
    out = dml.merge_upsert(t, s, ["id"], {"n": F.col("src_n")}, {"n": F.col("src_n"), "v": 0.0})
    assert rows(out) == [(1, "a", 1.0), (2, "B", 2.0), (3, "C", 0.0)]
    with pytest.raises(Exception, match="holds a key twice"):
        dml.merge_upsert(t, s.union(s), ["id"], {"n": F.col("src_n")}, {}).collect()
    table, status = dml.update_by_key(t, s, ["id"], {"n": F.col("src_n")})
    assert rows(table) == [(1, "a", 1.0), (2, "B", 2.0)]
    assert rows(status) == [(2, 1, "SUCCESS"), (3, 0, "NOT_FOUND")]
    assert dml.row_count(status).first()[0] == 1


def test_insert_unique_keeps_first(spark):
    t = spark.createDataFrame([(1, 0)], "id int, seq int")
    new = spark.createDataFrame([(1, 5), (2, 7), (2, 6), (3, 8)], "id int, seq int")
    table, rejects = dml.insert_unique(t, new, ["id"], ["seq"])
    assert rows(table) == [(1, 0), (2, 6), (3, 8)] and rows(rejects) == [(1, 5), (2, 7)]


def test_audit_and_when(spark):  # D12: the WHEN clause filters
    old = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, pay int")
    new = spark.createDataFrame([(1, 10), (2, 25), (4, 40)], "id int, pay int")
    as_of = datetime(2020, 1, 1)
    out = dml.capture_changes(old, new, ["id"], ["pay"], "EMP", as_of, "me")
    assert rows(out.select("action", "id", "old_pay", "new_pay")) == [
        ("DELETE", 3, 30, None), ("INSERT", 4, None, 40), ("UPDATE", 2, 20, 25)]
    assert dml.capture_changes(old, new, ["id"], ["pay"], "EMP", as_of, "me", when=F.col("new_pay") > 30).count() == 1


def test_raise_if_and_try_apply(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    with pytest.raises(Exception, match="ORA-20001: bad row"):
        dml.raise_if(df, F.col("s") == "x", -20001, "bad row").collect()
    assert dml.raise_if(df, F.col("s") == "nothing", -20001, "bad row").count() == 3
    ok, err = dml.try_apply(df, "s", F.col("s").try_cast("int"), "n")
    assert rows(ok) == [("1", 1), (None, None)] and rows(err) == [("x", "conversion failed: x")]


def test_fill_key_and_defaults(spark):
    df = spark.createDataFrame([(5, None), (6, 60), (7, None)], "o int, id int")
    assert rows(dml.fill_key(df, "id", ["o"], start=100)) == [(5, 100), (6, 60), (7, 101)]
    assert rows(dml.fill_defaults(df, {"id": F.lit(0)})) == [(5, 0), (6, 60), (7, 0)]


def test_materialized_view_modes(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k int, v int")
    state = mviews.aggregate_state(df, ["k"], {"s": F.col("v")})
    assert mviews.materialize_view(state, str(tmp_path / "d"), "DEFERRED").count() == 0
    mv = mviews.materialize_view(state, str(tmp_path / "i"))
    gone = mviews.aggregate_state(df.filter("k = 2"), ["k"], {"s": F.col("v")}).select("k", (-F.col("n")).alias("n"), (-F.col("s")).alias("s"))
    assert rows(mviews.refresh_fast(mv, gone, ["k"])) == [(1, 2, 5)]


def test_constraint_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (None, None)], "k int, s string")
    assert rows(constraints.check_pk(df, ["k"])) == [(1, 2), (None, 2)]
    assert rows(constraints.check_unique(df, ["k"])) == [(1, 2)]
    assert constraints.check_cond(df, F.col("k") > 1).count() == 2
    ref = spark.createDataFrame([(2,)], "id int")
    assert rows(constraints.check_fk(df, ["k"], ref, ["id"])) == [(1, 2)]
    long = spark.createDataFrame([("éé",)], "t string")
    assert constraints.check_length(long, "t", 2, "BYTE").count() == 1
    assert constraints.check_length(long, "t", 2, "CHAR").count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 1025, 3000])
def test_running_totals(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda x: x.cast("bigint")).alias("a"))
    if n == 0:
        df = df.select(F.array().cast("array<bigint>").alias("a"))
    got = df.select(running_totals(F.col("a"), 64).alias("t")).first()["t"]
    assert got == [i * (i + 1) // 2 for i in range(n)]


def test_jumps_give_what_levels_give(spark, monkeypatch):
    import random

    from veldspar.operators import hierarchy

    rng = random.Random(3)
    data = [(i, rng.randrange(i) if i % 17 else (None if i % 2 else 10_000), rng.choice(["b", "a", None])) for i in range(1, 300)] + [(None, 5, "x"), (None, None, "y")]
    df = spark.createDataFrame(data, "id int, mgr int, n string").repartition(3)
    start = F.col("mgr").isNull() & F.col("id").isNotNull()
    want = connect_by(df, "id", "mgr", start, path="n", siblings="n")
    got = connect_by_doubling(df, "id", "mgr", start, path="n", siblings="n")
    assert rows(got.drop("root")) == rows(want) and got.columns == ["id", "mgr", "n", "level", "root", "path", "sibling_key"]
    stored = []
    monkeypatch.setattr(hierarchy, "materialize", lambda d, label: stored.append(label) or materialize(d, label))
    chain = spark.range(3_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("mgr"))
    deep = connect_by_doubling(chain, "id", "mgr", F.col("id") == 0)
    assert deep.filter("level <> id + 1 OR root <> 0").count() == 0 and deep.count() == 3_000
    assert stored.count("pointers") <= 14


def test_jumps_on_circles_and_double_places(spark):
    loop = spark.createDataFrame([(5, 7), (6, 5), (7, 6), (8, 9), (9, 8), (10, 9)], "id int, mgr int")
    with pytest.raises(ValueError, match="loop"):
        connect_by_doubling(loop, "id", "mgr", F.col("id") == 5)
    assert rows(connect_by_doubling(loop, "id", "mgr", F.col("id") == 5, nocycle=True).select("id", "level")) == [(5, 1), (6, 2), (7, 3)]
    with pytest.raises(ValueError, match="below another"):
        connect_by_doubling(loop, "id", "mgr", F.col("id").isin(5, 6))
    with pytest.raises(ValueError, match="unique"):
        connect_by_doubling(loop.union(loop), "id", "mgr", F.col("id") == 5)
    assert connect_by_doubling(loop, "id", "mgr", F.col("id") == 99).count() == 0
    assert connect_by_doubling(loop.limit(0), "id", "mgr", F.lit(True), path="id", siblings="id").count() == 0


def test_jumps_take_out_rows_of_the_middle(spark, monkeypatch):
    from veldspar.operators import hierarchy

    # a chain, a wide tree, a circle, a row under nobody and rows without an id: contracted to little, or not at all
    data = [(k, k - 1 if k else None) for k in range(400)] + [(1000 + k, 1000 + (k - 1) // 3 if k else None) for k in range(200)]
    data += [(5000 + k, 5000 + (k + 1) % 30) for k in range(30)] + [(6000, 5999), (None, 399), (None, 5999)]
    df = spark.createDataFrame([(a, b, f"n{a}") for a, b in data], "id int, mgr int, n string")
    start = F.col("mgr").isNull()
    whole, contracted = (connect_by_doubling(df, "id", "mgr", start, path="n", siblings="n", contract_from=m) for m in (10**6, 200))
    assert rows(contracted) == rows(whole) and len(rows(whole)) == 601
    tree = df.filter("id BETWEEN 1000 AND 1999")
    assert rows(contracted.filter("id BETWEEN 1000 AND 1999").drop("root")) == rows(connect_by(tree, "id", "mgr", start, path="n", siblings="n"))
    # what a chain stores on the way does not grow with its rows times the rounds of its depth
    deep = spark.range(4_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("mgr"))
    stored = []
    monkeypatch.setattr(hierarchy, "materialize", lambda d, label: stored.append(materialize(d, label)) or stored[-1])
    found = connect_by_doubling(deep, "id", "mgr", start, contract_from=500)
    assert found.filter("level = id + 1 AND root = 0").count() == 4_000
    assert sum(d.count() for d in stored) < 8 * 4_000


def test_unnest_works_out_what_it_keeps_once_per_row(spark):
    from veldspar.functions.arrays import unnest

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id int, t string")
    each = unnest(df, ["id", F.upper("t").alias("u")], F.split("t", " "), "pos", "x")
    assert rows(each) == [(1, "A B", 0, "a"), (1, "A B", 1, "b"), (3, "C", 0, "c")]
    plan = each._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("upper(")
