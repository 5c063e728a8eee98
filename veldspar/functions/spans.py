"""The lexical spans of SQL text: what is code, and what only looks like it.

A text is cut once into literals (q-literals too), quoted names, comments and the open text between them; hints count as open text, they say something.  ``spans``
gives their kinds and places.  ``protect`` puts a mark in the place of what lies inside each of them, so that patterns see where a literal is but
never what it says, and ``restore`` puts it back wherever the marks ended up.  Everything is column functions; the ``_sql`` forms are for use inside array lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspar.functions.arrays import let, running_totals
from veldspar.functions.scalar import as_col
from veldspar.functions.text import BLOCK_COMMENT, LINE_COMMENT, LITERAL, QUOTED_NAME, WORD_RUN

# Marks are private-use characters, which no pattern for words, numbers or punctuation matches: ten digits and a fence.
DIGITS, FENCE = "".join(chr(0xE000 + k) for k in range(10)), chr(0xE00A)
MARKS = f"[{DIGITS[0]}-{FENCE}]"

PROTECTED = rf"{LITERAL}|{QUOTED_NAME}|{LINE_COMMENT}|(?!/\*\+){BLOCK_COMMENT}|{MARKS}++"
OPEN = rf"(?:{WORD_RUN}|[^\w$#'\"\-/{DIGITS[0]}-{FENCE}]++|-(?!-)|/(?!\*)|/\*(?=\+))++|(?s:.)"
PIECES = rf"(?=[\w\"'\-/{DIGITS[0]}-{FENCE}])(?:{PROTECTED})|{OPEN}"
BEGINS = rf"^(?s:'.|\".|--|/\*(?!\+).|(?i:n?q)'.|{MARKS})"
MAY_HIDE = rf"[\"'{DIGITS[0]}-{FENCE}]|--|/\*"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pieces(text) -> Column:
    """The text cut into protected spans and the open text between them, in order; joined, they are the text."""
    return F.regexp_extract_all(as_col(text), F.lit(PIECES), F.lit(0))


def _kind(piece: Column) -> Column:
    two = F.substring(piece, 1, 2)
    return (F.when(~piece.rlike(BEGINS), F.when(two == "/*", "hint").otherwise("open"))
            .when(two == "--", "line_comment").when(two == "/*", "block_comment")
            .when(F.substring(piece, 1, 1) == '"', "name").when(piece.rlike(f"^{MARKS}"), "open").otherwise("literal"))


def spans(text) -> Column:
    """array<struct<kind, start, stop>>: kind is open, literal, name, line_comment or block_comment; start counts characters from 1, stop is the place after the last one."""
    def placed(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p: F.char_length(p).cast("bigint"))
        return F.zip_with(F.zip_with(ps, running_totals(sizes), lambda p, b: F.struct(p.alias("p"), b.alias("b"))), sizes,
                          lambda x, n: F.struct(_kind(x["p"]).alias("kind"), (x["b"] + 1).alias("start"), (x["b"] + n + 1).alias("stop")))

    return let(pieces(text), lambda ps: F.when(F.size(ps) > 0, placed(ps)).otherwise(
        F.expr("cast(array() as array<struct<kind: string, start: bigint, stop: bigint>>)")))


def _ends(p: str) -> tuple[str, str]:
    """SQL for how many characters begin and end a protected piece; what lies between is what it says."""
    begins = (f"CASE WHEN {p} RLIKE {sql_text(f'^{MARKS}')} THEN 0 WHEN {p} LIKE '--%' OR {p} LIKE '/*%' THEN 2 "
              f"WHEN {p} LIKE '\"%' THEN 1 ELSE locate('\\'', {p}) END")
    ends = f"CASE WHEN {p} RLIKE {sql_text(f'^(?:{MARKS}|--)')} THEN 0 WHEN {p} LIKE '/*%' THEN 2 ELSE 1 END"
    return begins, ends


def protect_sql(text: str) -> str:
    """struct(text, kept): the text with a numbered mark inside each protected span, and the pieces the marks stand for."""
    begins, ends = _ends("p")
    mark = f"concat({sql_text(FENCE)}, translate(CAST(i AS STRING), '0123456789', {sql_text(DIGITS)}), {sql_text(FENCE)})"
    marked = f"concat(substring(p, 1, {begins}), {mark}, right(p, {ends}))"
    return (f"CASE WHEN {text} RLIKE {sql_text(MAY_HIDE)} THEN transform(array(regexp_extract_all({text}, {sql_text(PIECES)}, 0)), ps -> named_struct("
            f"'text', array_join(transform(ps, (p, i) -> CASE WHEN p RLIKE {sql_text(BEGINS)} THEN {marked} ELSE p END), ''), 'kept', ps))[0] "
            f"ELSE named_struct('text', {text}, 'kept', CAST(array() AS array<string>)) END")


def restore_sql(text: str, kept: str) -> str:
    """The marks of ``protect_sql`` replaced by what they stand for; a mark that was cut apart stays as it is."""
    begins, ends = _ends("p")
    inside = f"transform(array(get({kept}, try_cast(translate(s, {sql_text(DIGITS)}, '0123456789') AS INT))), p -> substring(p, {begins} + 1, length(p) - {begins} - {ends}))[0]"
    return (f"CASE WHEN size({kept}) = 0 OR NOT contains({text}, {sql_text(FENCE)}) THEN {text} ELSE array_join(transform(split({text}, {sql_text(FENCE)}), "
            f"(s, j) -> CASE WHEN j % 2 = 1 THEN coalesce({inside}, s) ELSE s END), '') END")


def protect(column: str) -> Column:
    return F.expr(protect_sql(f"`{column}`"))


def restore(column: str, kept: str) -> Column:
    return F.expr(restore_sql(f"`{column}`", kept))
