"""Text preparation for SQL scripts: newlines, literals, comments, hints."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspar.functions.scalar import as_col

# The lexical pieces of SQL text that hide other characters from a search.
# q'[...]' and its like end with the mark that closes the one they begin with; doubled quotes mean nothing there.
ALTERNATIVE = (r"(?<![\w$#])(?i:n?q)'(?:\[(?s:.*?)\]'|\{(?s:.*?)\}'|\((?s:.*?)\)'|<(?s:.*?)>'"
               r"|(?<mark>[^\s\[{(<'])(?s:.*?)\k<mark>')")
LITERAL = rf"(?:{ALTERNATIVE}|'[^']*+(?:''[^']*+)*+')"
QUOTED_NAME = r'"[^"\n]*+"'
LINE_COMMENT = r"--[^\n]*+"
BLOCK_COMMENT = r"/\*(?s:.*?)\*/"
HINT = r"/\*\+[^*]*\*/"
HINT_NOTE = "/* Oracle hint removed */"
# A name as it is written without quotes, and a run of its characters that is not the beginning of a q-literal.
IDENTIFIER = r"[\w$#]+"
WORD_RUN = r"(?!(?i:n?q)')[\w$#]++"


def normalize_newlines(c) -> Column:
    return F.regexp_replace(as_col(c), r"\r\n?", "\n")


def mask_sql(c) -> Column:
    """Empty every string literal and drop every comment.

    One pass with one alternation, so that a quote in a comment or a dash in a literal is read as
    what it is.  Literals become '' and comments a space; quoted names stay.
    """
    text = as_col(c)
    hidden = F.regexp_replace(text, rf"""(?=["'\-/nNqQ])(?:({QUOTED_NAME})|({LITERAL})|{LINE_COMMENT}|{BLOCK_COMMENT})""", "$1\u0001$2")
    literals = F.regexp_replace(hidden, "\u0001" + LITERAL, "''")
    names = F.regexp_replace(literals, f"({QUOTED_NAME})\u0001", "$1")
    masked = F.replace(names, F.lit("\u0001"), F.lit(" "))
    # most lines hold nothing to hide, and looking for the signs of it is cheaper than three patterns
    signs = [F.contains(text, F.lit(x)) for x in ("'", '"', "--", "/*", "\u0001")]
    return F.when(reduce(or_, signs), masked).otherwise(text)


def strip_comments(c) -> Column:
    """Drop comments, keep literals and quoted names."""
    return F.regexp_replace(as_col(c), rf"""(?=["'\-/nNqQ])(?:({QUOTED_NAME}|{LITERAL})|{LINE_COMMENT}|{BLOCK_COMMENT})""", "$1")


def strip_hints(c) -> Column:
    """Replace optimizer hints by a plain comment: hints never change a result."""
    return F.regexp_replace(as_col(c), HINT, HINT_NOTE)
