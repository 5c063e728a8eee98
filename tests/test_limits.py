"""Cases without a limit or a switch: deep nesting, hot keys after a shuffle, NULL keys, equal orders, wide numbers."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veldspar.functions import scalar as S
from veldspar.operators import aggregates, dml, inventory, joins, mviews, ordering, rules, skew
from veldspar.operators.rule_table import Rule, default_rules
from veldspar.operators.statements import split_statements


def _stmts(spark, *texts):
    return split_statements(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, text string"))


def test_groups_nested_to_any_depth(spark):
    deep = "a > 0" + ""
    for _ in range(12):
        deep = f"({deep} OR f('(,)') = 1)"
    text = f"CREATE TABLE t (a NUMBER(10, 2) DEFAULT g(h(1, 2), 3), b VARCHAR2(5), CONSTRAINT c CHECK {deep}) TABLESPACE x;"
    stmts = _stmts(spark, text)
    assert [(r.column_name, r.precision, r.scale, r.default_value) for r in inventory.columns(stmts).orderBy("position").collect()] == [
        ("a", "10", "2", "g(h(1, 2), 3)"), ("b", "5", None, None)]
    check = inventory.constraints(stmts).collect()
    assert [(r.constraint_name, r.kind, r.condition) for r in check] == [("c", "CHECK", deep[1:-1])]
    group = spark.createDataFrame([("x (a, (b, c), ',') y (z)",), ("(a, b",), ("none",), (None,)], "t string").select(
        inventory.group_items(F.col("t")).alias("g")).select("g.*").collect()
    assert [(r["items"], r["closed"]) if r["items"] is not None else None for r in group] == [
        (["a", "(b, c)", "','"], True), (["a"], False), ([], False), None]


def test_a_hot_key_gets_many_salts_after_a_shuffle(spark):
    hot = spark.range(4000).select(F.lit(7).alias("k"), F.col("id").alias("v")).repartition(8, "k")
    salts = hot.select(skew.row_salt(hot, F.lit(40)).alias("s")).distinct().count()
    assert salts == 40
    lookup = spark.createDataFrame([(7, "seven"), (8, "eight")], "k int, name string")
    more = hot.union(spark.createDataFrame([(8, 1), (None, 2), (None, 3)], "k int, v long"))
    whole = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, rows in (("left", 4003), ("inner", 4001), ("left_semi", 4001), ("left_anti", 2)):
            assert skew._salted_join(more, lookup, ["k"], how, 100, 40).count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", whole)


def test_repeated_keys_raise(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="twice"):
        skew.unique_or_raise(twice, ["k"], "twice").collect()
    assert skew.unique_or_raise(twice.filter("v <> 'b'"), ["k"], "twice").count() == 2
    with pytest.raises(Exception, match="twice"):
        joins.compare_versions(twice, twice.limit(0), ["k"], ["v"]).collect()


def test_rows_without_a_key_stay_out_of_version_pairs(spark):
    old = spark.createDataFrame([(1, "a"), (None, "x"), (None, "y")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (None, "x")], "k int, v string")
    got = joins.compare_versions(old, new, ["k"], ["v"]).select("k", "old_v", "new_v", "change").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, "a", "b", "UPDATE"), (None, "x", None, "DELETE"), (None, "y", None, "DELETE"), (None, None, "x", "INSERT")], key=repr)


def test_merge_with_a_repeated_target_key(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (3, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "new"), (4, "four"), (None, "null")], "k int, v string")
    got = dml.merge_upsert(target, source, ["k"], {"v": F.concat("v", F.lit(">"), "src_v")}, {"v": F.col("src_v")})
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "a>new"), (1, "b>new"), (None, "n"), (3, "c"), (4, "four"), (None, "null")], key=repr)


def test_null_keys_never_violate_uniqueness(spark):
    target = spark.createDataFrame([(1, "t")], "k int, v string")
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (2, None), (3, "x"), (3, "y")], "k int, v string")
    table, rejects = dml.insert_unique(target, rows, ["k"], ["v"])
    assert sorted(map(tuple, table.collect()), key=repr) == sorted([(1, "t"), (None, "a"), (None, "b"), (2, None), (3, "x")], key=repr)
    assert sorted(map(tuple, rejects.collect())) == [(1, "c"), (3, "y")]


def test_partly_null_keys_are_compared_in_all_their_columns(spark):
    target = spark.createDataFrame([(1, None, "t"), (None, None, "u"), (2, 5, "v")], "a int, b int, v string")
    rows = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (None, None, "c"), (None, None, "d"), (None, 5, "e"), (None, 5, "f"), (2, None, "g"), (2, 5, "h")],
                                 "a int, b int, v string")
    table, rejects = dml.insert_unique(target, rows, ["a", "b"], ["v"])
    assert sorted(r["v"] for r in table.collect()) == ["c", "d", "e", "g", "t", "u", "v"]
    assert sorted(r["v"] for r in rejects.collect()) == ["a", "b", "f", "h"]


def test_versions_by_digests(spark):
    old = spark.createDataFrame([(i, f"v{i}" if i % 9 else None, "") for i in range(4000)] + [(None, "n", "x")], "k int, v string, w string").repartition(5)
    new = old.filter("k <> 70 OR k IS NULL").withColumn("v", F.when(F.col("k") == 8, None).when(F.col("k") == 9, "").otherwise(F.col("v"))).union(
        spark.createDataFrame([(9999, "new", None)], "k int, v string, w string")).repartition(3)
    got = joins.changed_rows(old, new, ["k"], ["v", "w"])
    assert sorted((r["k"], r["change"], r["old_v"], r["new_v"]) for r in got.collect()) == [
        (8, "UPDATE", "v8", None), (9, "UPDATE", None, ""), (70, "DELETE", "v70", None), (9999, "INSERT", None, "new")]
    some = joins.differing_rows(old, new, ["k"], ["v", "w"])
    assert all(0 < x.count() <= 60 for x in some)
    assert [x.count() for x in joins.differing_rows(old, old, ["k"], ["v"])] == [0, 0]
    assert joins.changed_rows(old.limit(0), old.limit(0), ["k"], ["v"]).count() == 0


def test_listagg_by_the_bytes_of_its_groups(spark, monkeypatch):
    rows = [(k % 3 if k % 7 else None, k % 11 if k % 5 else None, "é" * (k % 4) if k % 13 else None) for k in range(400)] + [(9, 1, None)]
    df = spark.createDataFrame(rows, "g int, o int, v string").repartition(4)
    plain = aggregates.listagg(df, ["g"], "v", "; ", order="o")
    assert str(plain._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    want = sorted(map(tuple, plain.collect()), key=repr)
    by_hand = {}
    for g, o, v in rows:
        by_hand.setdefault(g, []).append((o is None, o or 0, v)) if v is not None else by_hand.setdefault(g, [])
    assert want == sorted(((g, "; ".join(x[2] for x in sorted(vs)) if vs else None) for g, vs in by_hand.items()), key=repr)
    monkeypatch.setattr(aggregates, "SMALL_BYTES", 300)
    monkeypatch.setattr(aggregates, "SLICE_BYTES", 64)
    assert sorted(map(tuple, aggregates.listagg(df, ["g"], "v", "; ", order="o").collect()), key=repr) == want
    big = spark.range(30).select(F.lit(1).alias("g"), F.concat(F.lit("x"), "id").alias("v"))
    monkeypatch.setattr(aggregates, "MOST_BYTES", 50)
    with pytest.raises(ValueError, match="cannot be one string"):
        aggregates.listagg(big, ["g"], "v")


def test_refreshed_join_views_equal_the_recompute(spark):
    import random

    rng = random.Random(4)
    for _ in range(3):
        key = lambda: rng.choice([None, *range(8)])
        parents = [(key(), rng.choice("ab")) for _ in range(12)]
        children = [(key(), rng.randint(1, 9)) for _ in range(30)]
        gone_p, gone_c = rng.sample(range(12), 4), rng.sample(range(30), 9)
        come_p, come_c = [(rng.choice([None, *range(10)]), rng.choice("abc")) for _ in range(5)], [(rng.choice([None, *range(10)]), rng.randint(1, 9)) for _ in range(8)]
        p, c = "k int, name string", "k int, x int"
        sums = {"s": F.col("x")}
        state = mviews.join_state(spark.createDataFrame(parents, p), spark.createDataFrame(children, c), ["k"], sums)
        dp = spark.createDataFrame([(*parents[i], -1) for i in gone_p] + [(*r, 1) for r in come_p], p + ", sign int")
        dc = spark.createDataFrame([(*children[i], -1) for i in gone_c] + [(*r, 1) for r in come_c], c + ", sign int")
        got = mviews.join_view(mviews.refresh_join(state, dp, spark.createDataFrame(children, c), dc, ["k"], sums))
        now_p = [r for i, r in enumerate(parents) if i not in gone_p] + come_p
        now_c = [r for i, r in enumerate(children) if i not in gone_c] + come_c
        want = mviews.join_view(mviews.join_state(spark.createDataFrame(now_p, p), spark.createDataFrame(now_c, c), ["k"], sums))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        by_hand = {}
        for r in now_p:
            n, s = by_hand.get(r, (0, 0))
            own = [x for k, x in now_c if k is not None and k == r[0]]
            by_hand[r] = (n + len(own), s + sum(own))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*r, *v) for r, v in by_hand.items()), key=repr)


def test_deep_pages_by_order_statistics(spark, monkeypatch):
    import datetime as dt

    from veldspar import session

    monkeypatch.setattr(ordering, "SAMPLE_KEYS", 40)
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 60)
    monkeypatch.setattr(session, "materialize", lambda *_: pytest.fail("a copy was stored"))
    when = dt.datetime(2020, 1, 1)
    rows = [(i % 7 if i % 5 else None, ["b", "a", None, "é"][i % 4], when + dt.timedelta(hours=i % 50), float("nan") if i % 11 == 0 else i / 3) for i in range(1500)]
    df = spark.createDataFrame(rows, "a int, b string, c timestamp_ntz, d double").repartition(5)
    for order in (["a", "b desc"], ["d desc", "c"]):
        rest = [x for x in df.columns if x not in {o.split(" ")[0] for o in order}]
        want = [str(r) for r in df.orderBy(*ordering.ora_keys(*order, *rest)).collect()]
        for offset, n in ((200, 30), (1480, 50), (5000, 9)):
            assert sorted(str(r) for r in ordering.page(df, order, offset, n).collect()) == sorted(want[offset:offset + n]), (order, offset, n)
    same = spark.range(3000).select(F.lit(1).alias("x"), (F.col("id") % 3).alias("y")).repartition(4)
    assert [tuple(r) for r in ordering.page(same, ["x"], 1500, 70).collect()] == [(1, 1)] * 70
    assert ordering.page(same.limit(0), ["x"], 1500, 70).count() == 0


def test_user_rules_come_last_and_equal_orders_keep_their_patterns(spark):
    table = rules.add_user_rules(rules.rules_df(spark), rules.rules_df(spark, [Rule("U2", "T", "AUTO", "detect", "", "b", "", "d"),
                                                                              Rule("U1", "T", "AUTO", "detect", "", "a", "", "d")]))
    last = [r.rule_id for r in rules.rules_list(table)][-2:]
    assert last == ["U1", "U2"] and rules.rules_list(table)[-1].rule_order == len(default_rules()) + 2
    same = [Rule("A", "T", "AUTO", "detect", "", "one", "", "d", (), "", 5), Rule("B", "T", "AUTO", "detect", "", "two", "", "d", (), "", 5)]
    found = spark.createDataFrame([("x\none\ntwo", 1)], "text string, stmt_line int")
    placed = rules.locate_matches(rules.match_patterns(found, same), same)
    assert {r.rule_id: r.match_line for r in placed.collect()} == {"A": 2, "B": 3}


def test_nested_calls_are_reported(spark):
    stmts = _stmts(spark, "SELECT TRUNC(NVL(a, b)), TO_CHAR(NVL(a, b), 'YYYY') FROM t;",
                   "CREATE PROCEDURE p IS\nBEGIN\n RAISE_APPLICATION_ERROR(-20001, f(1));\nEND p;\n/",
                   "SELECT LISTAGG(a || f(g(h(i(1)))), ',') WITHIN GROUP (ORDER BY a) FROM t;")
    found = {(r.file_id, r.rule_id, r.severity) for r in rules.scan(stmts, default_rules()).collect()}
    assert {(0, "FN_026", "REVIEW"), (0, "FN_007", "REVIEW"), (1, "PL_011", "REVIEW"), (2, "FN_022", "REVIEW")} <= found
    assert (2, "FN_022", "AUTO") not in found


def test_pages_with_ties_are_the_same_either_way(spark, monkeypatch):
    df = spark.range(60).select((F.col("id") % 3).alias("a"), (59 - F.col("id")).alias("b")).repartition(5)
    heap = [tuple(r) for r in ordering.page(df, ["a"], 10, 25).collect()]
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 1)
    assert sorted(tuple(r) for r in ordering.page(df, ["a"], 10, 25).collect()) == sorted(heap)


def test_trunc_over_the_range_of_number(spark):
    big = Decimal("1234567890123456789012345678.9876543210")
    df = spark.createDataFrame([(big,), (big.copy_negate(),), (Decimal("-1.99"),), (None,)], "n decimal(38,10)")
    got = df.select(S.trunc_num(F.col("n")).alias("a"), S.trunc_num(F.col("n"), 2).alias("b"), S.trunc_num(F.col("n"), -2).alias("c")).collect()
    assert got[0]["a"] == Decimal("1234567890123456789012345678") and got[1]["a"] == got[0]["a"].copy_negate() and got[2]["a"] == -1 and got[3]["a"] is None
    assert got[0]["b"] == Decimal("1234567890123456789012345678.98") and got[0]["c"] == Decimal("1234567890123456789012345600")


def test_dates_with_one_digit_and_two_digit_years(spark):
    df = spark.createDataFrame([("31-DEC-99", "5-JAN-2020", "3/4/2021 7:08", "20200105"), ("1-FEB-49", "x", None, "2020015")], "r string, d string, t string, p string")
    got = df.select(S.to_date_ora(F.col("r"), "DD-MON-RR").cast("string"), S.to_date_ora(F.col("d"), "DD-MON-YYYY").cast("string"),
                    S.to_date_ora(F.col("t"), "DD/MM/YYYY HH24:MI").cast("string"), S.to_date_ora(F.col("p"), "YYYYMMDD").cast("string")).collect()
    assert list(got[0]) == ["1999-12-31 00:00:00", "2020-01-05 00:00:00", "2021-04-03 07:08:00", "2020-01-05 00:00:00"]
    assert list(got[1]) == ["2049-02-01 00:00:00", None, None, None]


def test_varray_refuses_longer_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2, 3]), (3, None)], "id int, a array<int>")
    kept, refused = S.varray_split(df, "a", 2)
    assert [r.id for r in kept.collect()] == [1, 3] and [r.id for r in refused.collect()] == [2]


def test_anonymous_blocks_are_one_statement(spark):
    text = """SELECT 1 FROM DUAL;
DECLARE
  v NUMBER; -- a; comment
BEGIN
  v := 1; IF v > 0 THEN NULL; END IF;
  BEGIN
    NULL;
  END;
END;
/
BEGIN NULL; END;
UPDATE t SET a = 1
WHERE b = 'BEGIN';
begin
  /* END; */
  x('END;');
end;
/
CREATE OR REPLACE EDITIONABLE PROCEDURE p IS
BEGIN
  NULL;
END;
/
CREATE TYPE BODY ty AS
  MEMBER FUNCTION f RETURN NUMBER IS
  BEGIN
    RETURN 1;
  END;
END;
/
BEGIN
  NULL;
END last_one;
DELETE FROM t;"""
    rows = _stmts(spark, text).orderBy("stmt_no").collect()
    assert [(r.stmt_type, r.stmt_line) for r in rows] == [
        ("SELECT", 1), ("DECLARE_BLOCK", 2), ("BEGIN_BLOCK", 11), ("UPDATE", 12), ("BEGIN_BLOCK", 14), ("CREATE_PROCEDURE", 19), ("CREATE_TYPE", 24),
        ("BEGIN_BLOCK", 31), ("DELETE", 34)]
    lines = text.split("\n")
    assert rows[1].text == "\n".join(lines[1:9]) and rows[4].text == "\n".join(lines[13:17]) and rows[7].text == "\n".join(lines[30:33])


def test_late_changes_go_aside(spark, tmp_path):
    from veldspar.streaming.audit import stream_audit

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, o int, v string"
    for rows in ([(1, 10, "ten"), (2, 1, "x")], [(1, 3, "late"), (1, 12, "twelve"), (2, 2, "y")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream_audit(spark.readStream.schema(schema).parquet(src), ["k"], ["o"], ["v"], out, str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(f"{out}/audit").select("k", "o", "v", "action", "old_v").collect()
    assert sorted(map(tuple, got)) == [(1, 10, "ten", "INSERT", None), (1, 12, "twelve", "UPDATE", "ten"), (2, 1, "x", "INSERT", None), (2, 2, "y", "UPDATE", "x")]
    assert [tuple(r) for r in spark.read.parquet(f"{out}/late").select("k", "o", "v").collect()] == [(1, 3, "late")]


def test_script_stream_reads_other_encodings(spark, tmp_path):
    from veldspar.streaming.scripts import stream_scripts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.SQL").write_bytes("SELECT NVL(a, 'é') FROM t;".encode("latin-1"))
    stream_scripts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), encoding="latin-1").awaitTermination()
    assert [r.new_text for r in spark.read.parquet(str(tmp_path / "out" / "statements")).collect()] == ["SELECT COALESCE(a, 'é') FROM t"]
    assert [r.rule_id for r in spark.read.parquet(str(tmp_path / "out" / "findings")).collect()] == ["FN_003"]
