"""Script tables: text to lines, lines to statements, statements to types.

A script is one row ``(file_id, text)``.  All splitting happens inside that row with array and
regular-expression functions, so no shuffle is needed however many scripts there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.arrays import let, running_totals, unnest
from veldspar.functions.text import BLOCK_COMMENT, LINE_COMMENT, LITERAL, QUOTED_NAME, WORD_RUN, mask_sql, normalize_newlines

# How statements begin and end in a script.
GAP = rf"(?:\s++|{LINE_COMMENT}|{BLOCK_COMMENT})++"
LEAD = rf"(?:\s++|{LINE_COMMENT}|{BLOCK_COMMENT})*+"
BLOCK_OPENER = r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:NON)?EDITIONABLE\s+)?(?:PACKAGE|PROCEDURE|FUNCTION|TRIGGER|TYPE\s+BODY)\b"
ANONYMOUS = r"(?i)^\s*+(?:DECLARE|BEGIN)\b"
# A line of its own with nothing but a slash ends a statement too.
LONE_SLASH = r"(?<=\n[ \t]{0,64})/(?=[ \t]*+(?:\n|\z))"


def _piece(run: str, stray: str) -> str:
    """Text up to the next ';' or lone slash outside literals, names and comments; a stray quote or slash counts as text."""
    some = rf"(?:{run}|-(?!-)|{LINE_COMMENT}|(?!{LONE_SLASH})/(?!\*)|{BLOCK_COMMENT}|{LITERAL}|{QUOTED_NAME}|(?!{LONE_SLASH}){stray})++"
    return rf"((?:{LONE_SLASH})?+{some}|{LONE_SLASH})"


PIECE = _piece(r"[^;'\"\-/]++", r"['\"/]")
# The same for texts with q-literals, word by word.
PIECE_Q = _piece(rf"[^;'\"\-/\w$#]++|{WORD_RUN}", r"['\"/\w$#]")

# Statement types by their leading words, first match wins.
STATEMENT_TYPES = [
    ("CREATE_TABLE", "CREATE (OR REPLACE )?(GLOBAL TEMPORARY )?TABLE"),
    ("CREATE_INDEX", "CREATE (UNIQUE )?(BITMAP )?INDEX"),
    ("CREATE_MATERIALIZED_VIEW", "CREATE MATERIALIZED VIEW"),
    ("CREATE_VIEW", "CREATE (OR REPLACE )?(FORCE )?VIEW"),
    ("CREATE_SEQUENCE", "CREATE SEQUENCE"),
    ("CREATE_SYNONYM", "CREATE (OR REPLACE )?(PUBLIC )?SYNONYM"),
    ("CREATE_PACKAGE_BODY", "CREATE (OR REPLACE )?PACKAGE BODY"),
    ("CREATE_PACKAGE", "CREATE (OR REPLACE )?PACKAGE"),
    ("CREATE_PROCEDURE", "CREATE (OR REPLACE )?PROCEDURE"),
    ("CREATE_FUNCTION", "CREATE (OR REPLACE )?FUNCTION"),
    ("CREATE_TRIGGER", "CREATE (OR REPLACE )?TRIGGER"),
    ("CREATE_TYPE", "CREATE (OR REPLACE )?TYPE"),
    ("CREATE_DATABASE_LINK", "CREATE (PUBLIC )?DATABASE LINK"),
    ("ALTER_TABLE", "ALTER TABLE"),
    ("ALTER_INDEX", "ALTER INDEX"),
    ("ALTER_SEQUENCE", "ALTER SEQUENCE"),
    ("DROP", "DROP"),
    ("TRUNCATE", "TRUNCATE"),
    ("COMMENT", "COMMENT ON"),
    ("GRANT", "GRANT"),
    ("REVOKE", "REVOKE"),
    ("SELECT", "SELECT"),
    ("INSERT", "INSERT"),
    ("UPDATE", "UPDATE"),
    ("DELETE", "DELETE"),
    ("MERGE", "MERGE"),
    ("DECLARE_BLOCK", "DECLARE"),
    ("BEGIN_BLOCK", "BEGIN"),
    ("SET", "SET"),
    ("EXEC", "EXEC"),
]
UNKNOWN = "UNKNOWN"

_MARK = "\u0001\u0002"


def newlines(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def to_lines(scripts: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    kept = [c for c in scripts.columns if c != "text"]
    lines = unnest(scripts, kept, F.split(normalize_newlines(F.col("text")), "\n"), "pos", "line")
    return lines.select(*kept, (F.col("pos") + 1).alias("line_no"), "line")


def depth_change(line: Column) -> Column:
    """BEGIN and CASE open, END closes; END IF and END LOOP close what is not counted."""
    return _depth_of(mask_sql(line))


def _depth_of(clean: Column) -> Column:
    opened = F.regexp_count(clean, F.lit(r"(?i)\bBEGIN\b|(?<!\bEND )\bCASE\b"))
    closed = F.regexp_count(clean, F.lit(r"(?i)\bEND\b(?!\s+(?:IF|LOOP)\b)"))
    return (opened - closed).cast("int")


def _closing_line(lines: Column, package: Column) -> Column:
    """Index of the line that ends a block: a lone '/', or a bare END at depth 0; -1 if none does.

    A fold with a constant-size state: depth, position, and whether a block comment is open.
    """
    start = F.struct(
        F.when(package, 1).otherwise(0).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("close"),
        F.lit(False).alias("comment"))

    def step(acc: Column, line: Column) -> Column:
        plain = F.when(acc["comment"], F.regexp_replace(line, r"^(?s:.*?)\*/", "")).otherwise(line)
        still = acc["comment"] & ~F.contains(line, F.lit("*/"))
        counts = ~still & plain.rlike(r"(?i)\b(?:BEGIN|END|CASE)\b")
        opens = ~still & F.contains(plain, F.lit("/*")) & mask_sql(plain).contains("/*")

        def moved(depth: Column, ends: Column) -> Column:
            return F.struct(depth.alias("depth"), (acc["i"] + 1).alias("i"),
                            F.when(ends, acc["i"]).otherwise(-1).alias("close"), (still | opens).alias("comment"))

        def counted(clean: Column) -> Column:
            bare_end = clean.rlike(r"(?i)\bEND\s*;?\s*$")
            return let(acc["depth"] + _depth_of(clean), lambda depth: moved(depth, bare_end & (depth <= 0)))

        masked = mask_sql(plain)
        clean = F.when(F.contains(plain, F.lit("/*")), F.regexp_replace(masked, r"/\*.*$", "")).otherwise(masked)  # a comment left open hides the rest
        return F.when(acc["close"] >= 0, acc).when(counts, let(clean, counted)).otherwise(
            moved(acc["depth"], ~still & (F.trim(plain) == "/")))

    return F.aggregate(lines, start, step, lambda acc: acc["close"])


def _anonymous_blocks(lines: Column) -> Column:
    """array<struct<first, last>> of the lines of DECLARE and BEGIN blocks that begin where a statement may begin.

    A fold over the lines: whether a statement is open, the block's first line and depth, and whether a block comment is open.
    A block ends with a lone '/' or the END that closes its first BEGIN; one that doesn't end reaches to the last line.
    """
    start = F.expr("named_struct('i', 0, 'first', -1, 'depth', 0, 'begun', false, 'open', false, 'comment', false, "
                   "'found', cast(array() as array<struct<first: int, last: int>>))")

    def step(acc: Column, line: Column) -> Column:
        plain = F.when(acc["comment"], F.regexp_replace(line, r"^(?s:.*?)\*/", "")).otherwise(line)
        still = acc["comment"] & ~F.contains(line, F.lit("*/"))
        comment = still | (F.contains(plain, F.lit("/*")) & mask_sql(plain).contains("/*"))
        clean = F.when(still, F.lit("")).otherwise(F.regexp_replace(mask_sql(plain), r"/\*.*$", ""))

        def moved(clean: Column) -> Column:
            opens = (acc["first"] < 0) & ~acc["open"] & clean.rlike(ANONYMOUS)
            inside = (acc["first"] >= 0) | opens
            depth = F.when(inside, acc["depth"] + _depth_of(clean)).otherwise(0)
            begun = inside & (acc["begun"] | clean.rlike(r"(?i)\bBEGIN\b"))
            bare_end = clean.rlike(r"(?i)\bEND(?:\s+\w+)?\s*;?\s*$") & (depth <= 0) & begun
            ends = inside & (bare_end | (F.trim(clean) == "/"))
            first = F.when(opens, acc["i"]).otherwise(acc["first"])
            word = F.trim(clean, F.lit(" \t"))
            open_ = F.when(inside, F.lit(False)).when(word == "", acc["open"]).otherwise(~word.rlike(r"(?:;|^/)$"))
            found = F.when(ends, F.array_append(acc["found"], F.struct(first.alias("first"), acc["i"].alias("last")))).otherwise(acc["found"])
            return F.struct((acc["i"] + 1).alias("i"), F.when(ends, -1).otherwise(first).alias("first"), F.when(ends, 0).otherwise(depth).alias("depth"),
                            (begun & ~ends).alias("begun"), open_.alias("open"), comment.alias("comment"), found.alias("found"))

        return let(clean, moved)

    def finish(acc: Column) -> Column:
        rest = F.array(F.struct(acc["first"].alias("first"), (acc["i"] - 1).alias("last")))
        return F.when(acc["first"] >= 0, F.concat(acc["found"], rest)).otherwise(acc["found"])

    return F.aggregate(lines, start, step, finish)


def _chunk_parts(chunk: Column) -> Column:
    """Pieces of a chunk without named blocks, its anonymous blocks kept whole."""
    def cut(lines: Column, blocks: Column) -> Column:
        def text(first: Column, count: Column) -> Column:
            return F.array_join(F.slice(lines, first + 1, count), "\n")

        def before(b: Column, i: Column) -> Column:  # the lines between the block before and this one, then the block
            begin = F.coalesce(F.get(blocks, i - 1)["last"] + 1, F.lit(0))
            slash = F.trim(F.get(lines, b["last"])) == "/"
            count = b["last"] - b["first"] + 1
            block = _part(text(b["first"], count - F.when(slash, 1).otherwise(0)), True, count.cast("bigint"))
            gap = F.when(b["first"] > begin, _pieces(F.concat(text(begin, b["first"] - begin), F.lit("\n"))))
            return F.concat(F.coalesce(gap, F.slice(F.array(block), 1, 0)), F.array(block))

        rest = F.element_at(blocks, -1)["last"] + 1
        tail = F.when(rest < F.size(lines), _pieces(text(rest, F.size(lines) - rest)))
        return F.concat(F.flatten(F.transform(blocks, before)), F.coalesce(tail, F.slice(_pieces(F.lit("x")), 1, 0)))

    def parted(lines: Column) -> Column:
        return let(_anonymous_blocks(lines), lambda blocks: F.when(F.size(blocks) == 0, _pieces(chunk)).otherwise(cut(lines, blocks)))

    return F.when(chunk.rlike(r"(?im)^[ \t]*(?:DECLARE|BEGIN)\b"), let(F.split(chunk, "\n"), parted)).otherwise(_pieces(chunk))


def _part(raw: Column, block, count: Column) -> Column:
    return F.struct(raw.alias("raw"), F.lit(block).alias("block"), count.alias("newlines"))


def _pieces(chunk: Column) -> Column:
    found = F.when(chunk.rlike("[qQ]'"), F.regexp_extract_all(chunk, F.lit(PIECE_Q), F.lit(1))).otherwise(F.regexp_extract_all(chunk, F.lit(PIECE), F.lit(1)))
    return F.transform(found, lambda p: _part(p, False, newlines(p)))


def _segment_parts(segment: Column) -> Column:
    """A segment starts with a block opener or holds none: the block (if any), then the pieces."""
    lead = F.regexp_extract(segment, rf"^({LEAD})", 1)
    body = F.substring(segment, F.char_length(lead) + 1, F.char_length(segment))

    def block_parts(lead: Column, body: Column) -> Column:
        package = body.rlike(r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:NON)?EDITIONABLE\s+)?(?:PACKAGE|TYPE)\b")

        def cut(lines: Column, close: Column) -> Column:
            count = F.when(close < 0, F.size(lines)).otherwise(close + 1)
            slash = F.trim(F.get(lines, count - 1)) == "/"
            text = F.array_join(F.slice(lines, 1, count - F.when(slash, 1).otherwise(0)), "\n")
            rest = F.array_join(F.slice(lines, count + 1, F.size(lines)), "\n")
            block = _part(F.concat(lead, text), True, newlines(lead) + count)
            return F.concat(F.array(block), _chunk_parts(rest))

        return let(F.split(body, "\n"), lambda lines: let(
            _closing_line(lines, package), lambda close: cut(lines, close)))

    return let(F.struct(lead.alias("lead"), body.alias("body")), lambda s: F.when(
        s["body"].rlike(rf"(?i)^{BLOCK_OPENER}"), block_parts(s["lead"], s["body"])
    ).otherwise(_chunk_parts(segment)))


def statement_array(text: Column) -> Column:
    """All statements of a script as array<struct<raw, block, newlines>>, in order."""
    # A block takes the comment lines right above it along.
    opener = rf"(?im)^((?:[ \t]*+--[^\n]*+\n|[ \t]*+\n|[ \t]*+{BLOCK_COMMENT}[ \t]*+\n)*+[ \t]*+{BLOCK_OPENER})"
    marked = F.regexp_replace(normalize_newlines(text), opener, _MARK + "$1")
    return F.flatten(F.transform(F.split(marked, _MARK), _segment_parts))


def statement_structs(scripts: DataFrame, name: str = "statements") -> DataFrame:
    """Scripts with an array column of their statements: stmt_line, leading_comment, text."""
    parts = scripts.withColumn("_parts", statement_array(F.col("text")))
    before = running_totals(F.transform("_parts", lambda p: p["newlines"]))
    placed = parts.withColumn("_before", before)

    def statement(part: Column, line: Column) -> Column:
        raw = F.regexp_replace(part["raw"], r"^(?:\s*+/[ \t]*+(?:\n|$))++", "")

        def split_lead(raw: Column, lead: Column) -> Column:
            skipped = newlines(part["raw"]) - newlines(raw)
            body = F.substring(raw, F.char_length(lead) + 1, F.char_length(raw))
            only_comment = body == ""
            text = F.rtrim(F.when(only_comment, raw).otherwise(body), F.lit(" \t\n"))
            text = F.when(only_comment, F.ltrim(text, F.lit(" \t\n"))).otherwise(text)
            shown = F.when(only_comment, F.regexp_extract(raw, r"^(\s*+)", 1)).otherwise(lead)
            comment = F.when(only_comment, F.lit("")).otherwise(F.trim(lead, F.lit(" \t\n")))
            return F.struct(
                (F.lit(1) + line + skipped + newlines(shown)).alias("stmt_line"),
                comment.alias("leading_comment"), text.alias("text"))

        return let(raw, lambda r: let(F.regexp_extract(r, rf"^({LEAD})", 1), lambda x: split_lead(r, x)))

    made = F.filter(F.zip_with("_parts", "_before", statement), lambda s: s["text"] != "")
    return placed.withColumn(name, made).drop("_parts", "_before")


def split_statements(scripts: DataFrame) -> DataFrame:
    """One row per statement, numbered within its file; stmt_line is the line its text begins on."""
    kept = [c for c in scripts.columns if c != "text"]
    each = unnest(statement_structs(scripts), kept, F.col("statements"), "pos", "s")
    return each.select(*kept, (F.col("pos") + 1).alias("stmt_no"), "s.stmt_line",
                       classify(F.col("s.text")).alias("stmt_type"), "s.leading_comment", "s.text")


def classify(text: Column) -> Column:
    """Statement type from the leading words (comments between them do not count)."""
    words = F.regexp_extract(text, rf"^{LEAD}((?:\w++(?:{GAP})?){{1,7}}+)", 1)
    head = F.regexp_replace(F.upper(F.regexp_replace(words, GAP, " ")), r"^(CREATE (?:OR REPLACE )?)(?:NON)?EDITIONABLE ", "$1")

    def chosen(h: Column) -> Column:
        chain = F
        for name, pattern in STATEMENT_TYPES:
            chain = chain.when(h.rlike(rf"^{pattern}\b"), name)
        return chain.otherwise(UNKNOWN)

    return let(head, chosen)
