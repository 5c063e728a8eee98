"""Inventories of a statement table: objects, columns, constraints, parameters, triggers, features.

All of them read ``(file_id, stmt_no, stmt_type, text)`` rows and work within a row; nothing here
shuffles except the per-file roll-ups, whose rows are combined per task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.arrays import let, unnest
from veldspar.functions.text import IDENTIFIER, LITERAL, QUOTED_NAME, WORD_RUN, mask_sql, strip_comments

KEYS = ["file_id", "stmt_no"]

# Names, and the DDL words that may stand between CREATE and the object kind.
NAME = rf'({QUOTED_NAME}|{IDENTIFIER})'
QUALIFIED = rf'(?:{NAME}\s*\.\s*)?{NAME}'
CREATE = r"^CREATE\s+(?:(?:OR\s+REPLACE|GLOBAL\s+TEMPORARY|UNIQUE|BITMAP|FORCE|PUBLIC|EDITIONABLE|NONEDITIONABLE)\s+)*+"
OBJECT_KINDS = (
    r"(TABLE|INDEX|MATERIALIZED\s+VIEW|VIEW|SEQUENCE|SYNONYM|PACKAGE\s+BODY|PACKAGE|PROCEDURE|FUNCTION|TRIGGER)"
)
OBJECT_TYPES = [
    "CREATE_TABLE", "CREATE_INDEX", "CREATE_MATERIALIZED_VIEW", "CREATE_VIEW", "CREATE_SEQUENCE", "CREATE_SYNONYM",
    "CREATE_PACKAGE_BODY", "CREATE_PACKAGE", "CREATE_PROCEDURE", "CREATE_FUNCTION", "CREATE_TRIGGER",
]

# Oracle functions whose use is reported per file.
ORACLE_FUNCTIONS = [
    "SYSDATE", "SYSTIMESTAMP", "NVL", "NVL2", "DECODE", "TO_DATE", "TO_CHAR", "TO_NUMBER", "SUBSTR", "INSTR",
    "ROWNUM", "ROWID", "SYS_GUID", "ADD_MONTHS", "MONTHS_BETWEEN", "TRUNC", "DBMS_OUTPUT", "DBMS_LOB", "UTL_FILE",
    "DBMS_SCHEDULER", "REGEXP_LIKE", "LISTAGG", "WM_CONCAT", "LENGTHB", "RAISE_APPLICATION_ERROR",
]


# A literal or quoted name, a bracket or comma, or the text between them.
PIECE = rf"{LITERAL}|{QUOTED_NAME}|[(),]|(?:{WORD_RUN}|[^(),'\"\w$#]++)++|(?s:.)"


def group_items(c: Column) -> Column:
    """struct(whole, items, closed, rest) of the first parenthesised group, nested to any depth.

    One fold over the text's brackets and commas that keeps places only; the texts are cut out at the end.  Commas inside nested groups, literals or quoted
    names don't separate.  ``whole`` is the group without its own brackets.  A group that never ends has ``closed`` false and reaches to the end of the text;
    ``rest`` is what follows its last comma.
    """
    start = F.expr("named_struct('depth', 0, 'at', 1, 'open', 0, 'item', 0, 'close', 0, 'cuts', cast(array() as array<struct<a: int, b: int>>))")

    def step(acc: Column, piece: Column) -> Column:
        depth, at = acc["depth"], acc["at"]
        after = at + F.char_length(piece)

        def state(depth: Column, open_: Column, item: Column, close: Column, cuts: Column) -> Column:
            return F.struct(depth.alias("depth"), after.alias("at"), open_.alias("open"), item.alias("item"), close.alias("close"), cuts.alias("cuts"))

        cut = F.array_append(acc["cuts"], F.struct(acc["item"].alias("a"), at.alias("b")))
        moved = state(depth + F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0), acc["open"], acc["item"], acc["close"], acc["cuts"])
        return (F.when(acc["close"] > 0, acc)
                .when((depth == 0) & (piece != "("), state(depth, acc["open"], acc["item"], acc["close"], acc["cuts"]))
                .when(depth == 0, state(F.lit(1), after, after, acc["close"], acc["cuts"]))
                .when((depth == 1) & (piece == ")"), state(F.lit(0), acc["open"], acc["item"], at, cut))
                .when((depth == 1) & (piece == ","), state(depth, acc["open"], after, acc["close"], cut))
                .otherwise(moved))

    def finish(text: Column, acc: Column) -> Column:
        closed = acc["close"] > 0
        end = F.when(closed, acc["close"]).otherwise(acc["at"])
        rest = F.when(closed | (acc["open"] == 0), "").otherwise(F.trim(F.substring(text, acc["item"], end - acc["item"]), F.lit(" \t\n")))
        items = F.transform(acc["cuts"], lambda x: F.trim(F.substring(text, x["a"], x["b"] - x["a"]), F.lit(" \t\n")))
        whole = F.when(acc["open"] > 0, F.substring(text, acc["open"], end - acc["open"])).otherwise("")
        return F.struct(whole.alias("whole"), F.filter(items, lambda x: x != "").alias("items"), closed.alias("closed"), rest.alias("rest"))

    return let(c, lambda text: let(F.aggregate(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), start, step), lambda acc: finish(text, acc)))


def all_items(group: Column) -> Column:
    """A group's items, with what is left of one that never ends."""
    return F.concat(group["items"], F.when(group["rest"] != "", F.array(group["rest"])).otherwise(F.array().cast("array<string>")))


def _plain(name: Column) -> Column:
    """A name without its quotes."""
    return F.regexp_replace(name, r'^"|"$', "")


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Matched group, NULL where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _names(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?:{QUOTED_NAME}|[^,\"])+"), F.lit(0)), lambda n: F.trim(n, F.lit(' \t\n"')))


def _of_type(stmts: DataFrame, *types: str) -> DataFrame:
    return stmts.filter(F.col("stmt_type").isin(*types))


def objects(stmts: DataFrame) -> DataFrame:
    """Every created object: kind, schema, name; for synonyms the target and PUBLIC; '' if unnamed."""
    text = F.col("text")
    head = rf"(?i){CREATE}{OBJECT_KINDS}\s+{QUALIFIED}"
    kind = F.replace(F.substring(F.col("stmt_type"), 8, 100), F.lit("_"), F.lit(" "))
    is_synonym = F.col("stmt_type") == "CREATE_SYNONYM"
    return _of_type(stmts, *OBJECT_TYPES).select(
        *KEYS, "stmt_line", kind.alias("kind"),
        _plain(_extract(text, head, 2)).alias("schema_name"),
        _plain(F.regexp_extract(text, head, 3)).alias("object_name"),
        F.when(is_synonym, F.replace(_extract(text, rf"(?i)\bFOR\s+({NAME}(?:\.{NAME})?)"), F.lit('"'), F.lit(""))).alias("target"),
        F.when(is_synonym, text.rlike(r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?PUBLIC\b")).alias("is_public"),
    )


def parse_errors(object_rows: DataFrame) -> DataFrame:
    """Statements of a known kind whose object name could not be read."""
    return object_rows.filter(F.col("object_name") == "").select(
        *KEYS, "stmt_line", "kind", F.concat(F.lit("no name found in CREATE "), "kind").alias("error"))


def list_errors(stmts: DataFrame) -> DataFrame:
    """Column and parameter lists that never end, and columns whose name or type could not be read: rows as ``parse_errors`` gives them."""
    head = F.regexp_extract(F.col("text"), rf"(?i){CREATE}{OBJECT_KINDS}\b", 1)
    listed = F.when(F.col("stmt_type") == "CREATE_TABLE", _table_list()).otherwise(_parameter_list())
    rows = _of_type(stmts, "CREATE_TABLE", "CREATE_PROCEDURE", "CREATE_FUNCTION").select(*KEYS, "stmt_line", "stmt_type", F.upper(head).alias("kind"), listed.alias("list"))
    unread = F.filter(all_items(F.col("list")), lambda x: ~x.rlike(_CONSTRAINT_ITEM) & ~x.rlike(rf"(?is)^{NAME}\s+\w"))
    errors = F.concat(F.when((F.col("list.whole") != "") & ~F.col("list.closed"), F.array(F.lit("list never ends"))).otherwise(F.array().cast("array<string>")),
                      F.when(F.col("stmt_type") == "CREATE_TABLE", F.transform(unread, lambda x: F.concat(F.lit("no column found in: "), F.substring(x, 1, 80))))
                      .otherwise(F.array().cast("array<string>")))
    return unnest(rows, [*KEYS, "stmt_line", "kind"], errors, "_pos", "error").drop("_pos")


_CONSTRAINT_ITEM = r"(?i)^(?:CONSTRAINT|PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK)\b"


def _table_list() -> Column:
    """A table's list as ``group_items`` reads it; the list of a table made by a query is none."""
    listed = F.regexp_extract(strip_comments(F.col("text")), rf"(?is){CREATE}TABLE\s+{QUALIFIED}\s*(\(.*)$", 3)
    return group_items(listed)


def _table_items(stmts: DataFrame) -> DataFrame:
    table = _plain(F.regexp_extract(strip_comments(F.col("text")), rf"(?i){CREATE}TABLE\s+{QUALIFIED}", 2))
    return unnest(_of_type(stmts, "CREATE_TABLE"), [*KEYS, table.alias("table_name")], let(_table_list(), all_items), "pos", "item")


def columns(stmts: DataFrame) -> DataFrame:
    """Columns of created tables: type, precision, scale, nullable, default, inline primary key."""
    item = F.col("item")
    words = r"(LONG\s+RAW|DOUBLE\s+PRECISION|INTERVAL\s+(?:YEAR|DAY)(?:\s*\(\d+\))?\s+TO\s+(?:MONTH|SECOND)|\w+)"
    shape = rf'(?i)^{NAME}\s+{words}(?:\s*\(\s*(\d+|\*)\s*(?:,\s*(-?\d+)\s*)?(?:BYTE|CHAR)?\s*\))?(\s+WITH\s+(?:LOCAL\s+)?TIME\s+ZONE)?'
    default = r"(?is)\bDEFAULT\s+(.+?)(?:\s+(?:NOT\s+NULL|NULL|CONSTRAINT|PRIMARY|UNIQUE|CHECK|REFERENCES)\b|$)"
    rows = _table_items(stmts).filter(~item.rlike(_CONSTRAINT_ITEM))
    numbered = rows.select(
        *KEYS, "table_name", (F.col("pos") + 1).alias("position"),
        _plain(F.regexp_extract(item, shape, 1)).alias("column_name"),
        F.concat(F.regexp_extract(item, shape, 2), F.regexp_extract(item, shape, 5)).alias("data_type"),
        _extract(item, shape, 3).alias("precision"),
        _extract(item, shape, 4).alias("scale"),
        (~item.rlike(r"(?i)\bNOT\s+NULL\b")).alias("nullable"),
        _extract(item, default).alias("default_value"),
        item.rlike(r"(?i)\bPRIMARY\s+KEY\b").alias("is_primary_key"),
    )
    return numbered


def constraints(stmts: DataFrame) -> DataFrame:
    """Table constraints: name, kind, columns, referenced table and columns, check condition."""
    named = rf"(?i)^CONSTRAINT\s+{NAME}\s+"
    item = F.col("item")
    rest = F.regexp_replace(item, named, "")
    rows = _table_items(stmts).filter(item.rlike(_CONSTRAINT_ITEM)).withColumn("rest", rest)
    rest = F.col("rest")
    kind = F.upper(F.regexp_replace(F.regexp_extract(rest, r"(?i)^(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK)", 1), r"\s+", " "))
    keyed = kind.isin("PRIMARY KEY", "FOREIGN KEY", "UNIQUE")
    ref = rf"(?i)\bREFERENCES\s+(?:(?:{QUOTED_NAME}|{IDENTIFIER})\s*\.\s*)?{NAME}\s*(?:\(([^)]*)\))?"
    return rows.select(
        *KEYS, "table_name", _plain(_extract(item, named)).alias("constraint_name"), kind.alias("kind"),
        F.when(keyed, _names(F.regexp_extract(rest, r"\(([^)]*)\)", 1))).alias("columns"),
        _plain(_extract(rest, ref, 1)).alias("ref_table"),
        F.when(rest.rlike(r"(?i)\bREFERENCES\s+[\w.$#\"]+\s*\("), _names(F.regexp_extract(rest, ref, 2))).alias("ref_columns"),
        F.when(kind == "CHECK", F.trim(group_items(rest)["whole"])).alias("condition"),
    )


_ROUTINE_HEAD = rf"(?i){CREATE}(?:PROCEDURE|FUNCTION)\s+{QUALIFIED}"


def _parameter_list() -> Column:
    return group_items(F.regexp_extract(strip_comments(F.col("text")), rf"(?s){_ROUTINE_HEAD}\s*(\(.*)$", 3))


def parameters(stmts: DataFrame) -> DataFrame:
    """Routine parameters with direction, type and default; position 0 is a function's return value."""
    text = strip_comments(F.col("text"))
    shape = rf"(?is)^{NAME}\s+(?:(IN\s+OUT|IN|OUT)\b\s*)?(?:NOCOPY\s+)?(.+?)(?:\s*(?:\bDEFAULT\b|:=)\s*(.+))?$"
    base = _of_type(stmts, "CREATE_PROCEDURE", "CREATE_FUNCTION").select(
        *KEYS, _plain(F.regexp_extract(text, _ROUTINE_HEAD, 2)).alias("routine"), text.alias("text"),
        let(_parameter_list(), all_items).alias("list"), (F.col("stmt_type") == "CREATE_FUNCTION").alias("is_function"))
    item = F.col("item")
    given = unnest(base, [*KEYS, "routine"], F.col("list"), "pos", "item").select(
        *KEYS, "routine", (F.col("pos") + 1).alias("position"),
        _plain(F.regexp_extract(item, shape, 1)).alias("parameter"),
        F.coalesce(F.upper(F.regexp_replace(_extract(item, shape, 2), r"\s+", " ")), F.lit("IN")).alias("direction"),
        F.regexp_extract(item, shape, 3).alias("data_type"),
        _extract(item, shape, 4).alias("default_value"))
    returned = base.filter("is_function").select(
        *KEYS, "routine", F.lit(0).alias("position"), F.lit(None).cast("string").alias("parameter"),
        F.lit("RETURN").alias("direction"),
        F.regexp_extract("text", rf"(?i)\bRETURN\s+([\w.%$#]+(?:\s*\([^)]*\))?)", 1).alias("data_type"),
        F.lit(None).cast("string").alias("default_value"))
    return given.unionByName(returned)


def package_members(stmts: DataFrame) -> DataFrame:
    """Procedures and functions declared in packages, in order."""
    text = F.col("masked")
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b((?:PROCEDURE|FUNCTION)\s+{NAME})"), F.lit(1))
    kept = [*KEYS, _plain(F.regexp_extract(text, rf"(?i){CREATE}PACKAGE\s+(?:BODY\s+)?{QUALIFIED}", 2)).alias("package"),
            (F.col("stmt_type") == "CREATE_PACKAGE_BODY").alias("is_body")]
    packages = _of_type(stmts, "CREATE_PACKAGE", "CREATE_PACKAGE_BODY").select(*KEYS, "stmt_type", mask_sql(F.col("text")).alias("masked"))
    rows = unnest(packages, kept, found, "pos", "member")
    return rows.select(*KEYS, "package", "is_body", (F.col("pos") + 1).alias("position"),
                       F.upper(F.regexp_extract("member", r"^(\w+)", 1)).alias("kind"),
                       _plain(F.regexp_extract("member", rf"^\w+\s+{NAME}$", 1)).alias("member_name"))


def triggers(stmts: DataFrame) -> DataFrame:
    """Trigger timing, events, table, row level and WHEN clause, read from the header only."""
    head = F.regexp_extract(strip_comments(F.col("text")), r"(?is)^(.*?)(?:\b(?:BEGIN|DECLARE)\b|$)", 1)
    rows = _of_type(stmts, "CREATE_TRIGGER").select(*KEYS, head.alias("head"))
    head = F.col("head")
    events = F.array_compact(F.array(*[
        F.when(head.rlike(rf"(?i)\b{e}\b"), F.lit(e)) for e in ("INSERT", "UPDATE", "DELETE")]))
    return rows.select(
        *KEYS, _plain(F.regexp_extract(head, rf"(?i)\bTRIGGER\s+{QUALIFIED}", 2)).alias("trigger_name"),
        F.upper(F.regexp_replace(F.regexp_extract(head, r"(?i)\b(BEFORE|AFTER|INSTEAD\s+OF)\b", 1), r"\s+", " ")).alias("timing"),
        events.alias("events"),
        _plain(F.regexp_extract(head, rf"(?i)\bON\s+{QUALIFIED}", 2)).alias("table_name"),
        head.rlike(r"(?i)\bFOR\s+EACH\s+ROW\b").alias("row_level"),
        F.nullif(F.trim(group_items(F.regexp_extract(head, r"(?is)\bWHEN\s*(\(.*)$", 1))["whole"]), F.lit("")).alias("when_clause"))


def properties(stmts: DataFrame) -> DataFrame:
    """Index and sequence properties as a map; absent ones are left out."""
    text = strip_comments(F.col("text"))
    index = rf"(?is)\bINDEX\s+{QUALIFIED}\s+ON\s+{QUALIFIED}\s*(\(.*)$"
    number = r"\s+(-?\d+)"
    cycle = F.when(text.rlike(r"(?i)\bNOCYCLE\b"), "false").when(text.rlike(r"(?i)\bCYCLE\b"), "true").otherwise("false")
    of_index = {
        "unique": text.rlike(r"(?i)^CREATE\s+UNIQUE\b").cast("string"),
        "bitmap": text.rlike(r"(?i)^CREATE\s+(?:UNIQUE\s+)?BITMAP\b").cast("string"),
        "table": _plain(_extract(text, index, 4)),
        "columns": F.array_join(group_items(F.regexp_extract(text, index, 5))["items"], ","),
        "tablespace": _plain(_extract(text, rf"(?i)\bTABLESPACE\s+{NAME}")),
    }
    of_sequence = {
        "start": _extract(text, rf"(?i)\bSTART\s+WITH{number}"),
        "increment": _extract(text, rf"(?i)\bINCREMENT\s+BY{number}"),
        "minvalue": _extract(text, rf"(?i)\bMINVALUE{number}"),
        "maxvalue": _extract(text, rf"(?i)\bMAXVALUE{number}"),
        "cache": _extract(text, rf"(?i)\bCACHE{number}"),
        "cycle": cycle,
    }

    def as_map(values: dict[str, Column]) -> Column:
        pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
        return F.map_filter(pairs, lambda _, v: v.isNotNull())

    is_index = F.col("stmt_type") == "CREATE_INDEX"
    return _of_type(stmts, "CREATE_INDEX", "CREATE_SEQUENCE").select(
        *KEYS, "stmt_type", F.when(is_index, as_map(of_index)).otherwise(as_map(of_sequence)).alias("properties"))


def file_features(stmts: DataFrame) -> DataFrame:
    """Nine feature flags per file: a flag is set if any statement shows the feature."""
    kind, text = F.col("stmt_type"), F.col("text")
    packages = kind.isin("CREATE_PACKAGE", "CREATE_PACKAGE_BODY")
    flags = {
        "has_plsql": packages | kind.isin("CREATE_PROCEDURE", "CREATE_FUNCTION", "CREATE_TRIGGER") | text.rlike(r"(?i)\bBEGIN\b"),
        "has_packages": packages,
        "has_triggers": kind == "CREATE_TRIGGER",
        "has_synonyms": kind == "CREATE_SYNONYM",
        "has_sequences": kind == "CREATE_SEQUENCE",
        "has_dblinks": text.rlike(r"(?i)\bDATABASE\s+LINK\b"),
        "has_oracle_hints": text.contains("/*+"),
        "has_connect_by": text.rlike(r"(?i)\bCONNECT\s+BY\b"),
        "has_outer_join_plus": text.contains("(+)"),
    }
    return stmts.groupBy("file_id").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])


def functions_used(scripts: DataFrame) -> DataFrame:
    """Sorted list of the Oracle functions named in each script's text."""
    def hits(text: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(text.rlike(rf"\b{name}\b"), F.lit(name)) for name in sorted(ORACLE_FUNCTIONS)]))

    return scripts.select("file_id", let(F.upper("text"), hits).alias("functions"))
