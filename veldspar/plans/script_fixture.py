"""A script corpus derived from ``orders``: one statement per order, ten statements per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.sources.tables import load

# Statement templates by o_orderkey % 12; {k} stands for the order key.
TEMPLATES = [
    "SELECT NVL(o_totalprice, 0), SYSDATE FROM orders WHERE o_orderkey = {k}",
    "-- order {k}; keyed\n"
    "CREATE TABLE t_{k} (id NUMBER(10) NOT NULL, flag NUMBER(1) DEFAULT 1, name VARCHAR2(50 BYTE), "
    "made DATE DEFAULT SYSDATE, body CLOB,\n"
    "  CONSTRAINT pk_{k} PRIMARY KEY (id), CONSTRAINT fk_{k} FOREIGN KEY (id) REFERENCES orders(o_orderkey)) "
    "TABLESPACE users PCTFREE 10 NOLOGGING",
    "CREATE SEQUENCE sq_{k} START WITH {k} INCREMENT BY 5 NOCACHE NOCYCLE NOORDER",
    "SELECT /*+ INDEX(o ix) */ o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey(+)",
    "SELECT c_custkey FROM customer\nMINUS\nSELECT o_custkey FROM orders WHERE o_orderkey = {k}",
    "CREATE PUBLIC SYNONYM syn_{k} FOR hr.orders",
    "SELECT 'a;b''SYSDATE' AS lit_{k},\n  DECODE(o_orderstatus, 'F', 1, 0) FROM orders WHERE ROWNUM <= 10",
    "-- routine {k}\n"
    "CREATE OR REPLACE PROCEDURE pr_{k}(p_id IN NUMBER, p_out OUT VARCHAR2)\nIS\n  v NUMBER(12,2);\nBEGIN\n"
    "  IF p_id > 0 THEN\n    p_out := 'x;y';\n  END IF;\nEND pr_{k};",
    "CREATE OR REPLACE TRIGGER tr_{k}\n  BEFORE INSERT ON orders\n  FOR EACH ROW\nBEGIN\n"
    "  :NEW.o_orderdate := NVL(:NEW.o_orderdate, SYSDATE);\nEND tr_{k};",
    "CREATE BITMAP INDEX ix_{k} ON orders(o_orderstatus) TABLESPACE idx",
    "SELECT p_partkey, LEVEL FROM part START WITH p_partkey = 0 CONNECT BY PRIOR p_partkey = p_size",
    "SELECT LISTAGG(n_name, ', ') WITHIN GROUP (ORDER BY n_name), sq_{k}.NEXTVAL FROM DUAL",
]
BLOCK_TEMPLATES = (7, 8)  # ended by a lone '/', the others by ';'
PER_FILE = 10


def order_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys by file: only keys are shuffled, the texts are made where they are joined."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    file_id = F.floor(F.col("o_orderkey") / PER_FILE).alias("file_id")
    return load(spark, folder, "orders").select("o_orderkey", file_id).repartition(parts, "file_id")


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """(k, tid, file_id, stmt): the statements the scripts are made of."""
    return _statements(order_keys(spark, folder))


def _statements(keys: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    tid = key % len(TEMPLATES)
    text = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (tid + 1).cast("int"))
    return keys.select(
        key.alias("k"), tid.cast("int").alias("tid"), "file_id",
        F.replace(text, F.lit("{k}"), key.cast("string")).alias("stmt"))


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, text): ten statements to a file, so every group is small."""
    ended = F.concat("stmt", F.when(F.col("tid").isin(*BLOCK_TEMPLATES), "\n/").otherwise(";"))
    pieces = F.array_sort(F.collect_list(F.struct("k", ended.alias("p"))))
    return statements(spark, folder).groupBy("file_id").agg(
        F.array_join(F.transform(pieces, lambda s: s["p"]), "\n").alias("text"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def per_template(values: dict[int, list[tuple]], columns: str) -> str:
    """SQL relation with the rows that each template must yield."""
    rows = [f"({tid}, {', '.join(_quote(v) if isinstance(v, str) else 'NULL' if v is None else str(v) for v in row)})"
            for tid, found in values.items() for row in found]
    return f"(VALUES {', '.join(rows)}) AS e({columns})"


STATEMENTS_SQL = (
    "stmts AS (SELECT o_orderkey AS k, CAST(o_orderkey % 12 AS INTEGER) AS tid, o_orderkey // 10 AS file_id, "
    "CAST(o_orderkey % 10 + 1 AS INTEGER) AS stmt_no, "
    "replace(CASE o_orderkey % 12 "
    + " ".join(f"WHEN {i} THEN {_quote(t)}" for i, t in enumerate(TEMPLATES))
    + " END, '{k}', CAST(o_orderkey AS VARCHAR)) AS stmt FROM orders)"
)
SCRIPTS_SQL = (
    STATEMENTS_SQL
    + ", scripts AS (SELECT file_id, string_agg(stmt || CASE WHEN tid IN (7, 8) THEN chr(10) || '/' ELSE ';' END, "
    "chr(10) ORDER BY k) AS text FROM stmts GROUP BY file_id)"
)


# Statements that need more than a search for ';' (o_orderkey % 7); all but the last two are ended by a lone '/'.
ODD_TEMPLATES = [
    "SELECT q'[it's {k}; SYSDATE]' AS a, nq'!x;'y!' AS b, N'z' FROM dual",
    "CREATE TABLE emp$audit_{k} (note# VARCHAR2(20), \"a; -- b\" NUMBER(5), made DATE DEFAULT SYSDATE, rate NUMBER DEFAULT f(1, ','))",
    "SELECT a\n  / b, 'MINUS' -- SYSDATE; {k}\nFROM t /* NVL(x, {k}) */\nMINUS\nSELECT \"DATE\", NVL(c, 'NVL(') FROM u",
    "CREATE TABLE open_{k} (a NUMBER, b VARCHAR2(5), c DATE",
    "BEGIN\n  log#('end;', q'{begin}');\nEND",
    "CREATE OR REPLACE FUNCTION f$_{k}(p_in# IN NUMBER, \"P; Out\" OUT VARCHAR2) RETURN NUMBER\nIS\nBEGIN\n  RETURN LENGTH(q'<;'>');\nEND;",
    "CREATE SYNONYM \"Syn {k}\" FOR hr.emp$audit",
]
ODD_BY_SEMICOLON = (5, 6)


def odd_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("k")
    tid = (key % len(ODD_TEMPLATES)).cast("int")
    text = F.element_at(F.array(*[F.lit(t) for t in ODD_TEMPLATES]), tid + 1)
    return order_keys(spark, folder).select(F.col("o_orderkey").alias("k"), "file_id").select(
        "k", "file_id", tid.alias("tid"), F.replace(text, F.lit("{k}"), key.cast("string")).alias("stmt"))


def odd_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, text): ten statements to a file."""
    ended = F.concat("stmt", F.when(F.col("tid") == 6, ";").when(F.col("tid") == 5, "").otherwise("\n/"))
    pieces = F.array_sort(F.collect_list(F.struct("k", ended.alias("p"))))
    return odd_keys(spark, folder).groupBy("file_id").agg(F.array_join(F.transform(pieces, lambda s: s["p"]), "\n").alias("text"))


ODD_SQL = (
    "stmts AS (SELECT o_orderkey AS k, CAST(o_orderkey % 7 AS INTEGER) AS tid, o_orderkey // 10 AS file_id, "
    "CAST(o_orderkey % 10 + 1 AS INTEGER) AS stmt_no, replace(CASE o_orderkey % 7 "
    + " ".join(f"WHEN {i} THEN {_quote(t)}" for i, t in enumerate(ODD_TEMPLATES))
    + " END, '{k}', CAST(o_orderkey AS VARCHAR)) AS stmt FROM orders)"
)
