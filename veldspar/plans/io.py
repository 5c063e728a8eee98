"""Queries over typed loading, stored outputs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators.rule_table import default_rules
from veldspar.operators.rules import findings_of, rewrite
from veldspar.operators.statements import split_statements
from veldspar.plans import script_fixture as fx
from veldspar.plans.registry import query
from veldspar.plans.rules import LEDGER_SQL
from veldspar.session import shared_folder
from veldspar.sources import scripts as S
from veldspar.sources.tables import load
from veldspar.sources.types import ColumnDef, load_typed
from veldspar.streaming.audit import stream_audit

ORDER_DEFS = [
    ColumnDef("o_orderkey", "NUMBER", 10, nullable=False), ColumnDef("price", "NUMBER", 12, 2),
    ColumnDef("made", "DATE"), ColumnDef("prio", "VARCHAR2", 12), ColumnDef("flag", "NUMBER", 1, flag=True),
]


def _raw_orders(spark, d):
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return load(spark, d, "orders").select(
        F.when(key % 97 != 0, key.cast("string")).alias("o_orderkey"),
        F.when(key % 13 == 0, "n/a").otherwise(price).alias("price"),
        F.when(key % 17 == 0, "31/31/1999").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("made"),
        F.col("o_orderpriority").alias("prio"), (key % 3).cast("string").alias("flag"))


@query("typed_load", """
SELECT o_orderkey, o_totalprice AS price, o_orderdate AS made, o_orderpriority AS prio, o_orderkey % 3 <> 0 AS flag
FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND length(o_orderpriority) <= 12
""")
def typed_load(spark, d):
    ok, _ = load_typed(_raw_orders(spark, d), ORDER_DEFS)
    return ok.withColumns({"o_orderkey": F.col("o_orderkey").cast("bigint"), "price": F.col("price").cast("double")})


@query("typed_rejects", """
WITH r AS (SELECT CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS o_orderkey,
  concat_ws('; ', CASE WHEN o_orderkey % 97 = 0 THEN 'o_orderkey: NULL' END, CASE WHEN o_orderkey % 13 = 0 THEN 'price: not a NUMBER' END,
    CASE WHEN o_orderkey % 17 = 0 THEN 'made: not a DATE' END, CASE WHEN length(o_orderpriority) > 12 THEN 'prio: longer than 12 BYTE' END) AS reasons
  FROM orders)
SELECT * FROM r WHERE reasons <> ''
""")
def typed_rejects(spark, d):
    _, rejects = load_typed(_raw_orders(spark, d), ORDER_DEFS)
    return rejects.select("o_orderkey", F.array_join("reject_reasons", "; ").alias("reasons"))


@query("snapshot", "SELECT '20020131_123015' AS run_ts, count(*) AS files FROM (SELECT DISTINCT o_orderkey // 10 FROM orders)")
def snapshot(spark, d):
    out = shared_folder(spark, "snapshot")
    S.snapshot(fx.scripts(spark, d), out, "20020131_123015")
    return spark.read.parquet(out).groupBy(F.col("run_ts").cast("string").alias("run_ts")).agg(F.count(F.lit(1)).alias("files"))


@query("findings_csv", f"""
WITH {fx.STATEMENTS_SQL} SELECT file_id, stmt_no, rule_id FROM stmts JOIN {LEDGER_SQL} USING (tid)
""")
def findings_csv(spark, d):
    """The CSV report of the whole corpus, read back."""
    found = findings_of(rewrite(split_statements(fx.scripts(spark, d)), default_rules()))
    flat = found.select(
        F.concat_ws("-", "file_id", "stmt_no").alias("file"), "rule_id", "category", "severity", "description",
        F.col("description").alias("description_local"), F.col("stmt_line").alias("line"))
    out = shared_folder(spark, "findings")
    S.write_findings_csv(flat, out)
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    key = F.split("File", "-")
    return back.select(key[0].cast("bigint").alias("file_id"), key[1].cast("int").alias("stmt_no"), F.col("Rule ID").alias("rule_id"))


@query("stream_audit", """
SELECT event_id, user_id, value, lag(value) OVER w AS old_value,
       CASE WHEN row_number() OVER w = 1 THEN 'INSERT' ELSE 'UPDATE' END AS action
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def stream_audit_q(spark, d):
    """The change stream in four batches gives the same audit rows as one batch."""
    source, out, mark = (shared_folder(spark, n) for n in ("changes", "audit", "audit-mark"))
    events = load(spark, d, "events").select("event_id", "user_id", "ts", "value")
    # four portions in time order, each picked up by a run of its own
    cuts = events.select(F.percentile_approx(F.col("ts").cast("timestamp"), F.array(F.lit(.25), F.lit(.5), F.lit(.75)))).first()[0]
    part = sum((F.col("ts") > F.lit(c).cast("timestamp_ntz")).cast("int") for c in cuts)
    for i in range(4):
        events.filter(part == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        stream_audit(stream, ["user_id"], ["ts", "event_id"], ["value"], out, mark).awaitTermination()
    return spark.read.parquet(f"{out}/audit").select("event_id", "user_id", "value", "old_value", "action")
