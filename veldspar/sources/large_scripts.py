"""Scripts too large for one row: many tasks read ranges of one file, and no row holds more than a section of it.

Lines are read by the splittable text source and numbered by their place in the file.  A chunk of lines says where it ends for each way it might begin: in code, or inside a
literal, a q-literal or a comment that an earlier line opened.  These maps are composed in file order, so each chunk learns how it really begins.  A
section ends where the statement splitter is sure to start afresh: after a line that is nothing but a slash, or after a line ended by ';' with no PL/SQL
since the last such slash.  Sections are a few chunks long; each is split within its row as any script is, and statements are numbered through by the counts of the sections before.

What meets in one task are rows of some hundred bytes per chunk of one file, never its lines.  A script whose blocks are never followed by a lone slash is one section from its
first block on.  A literal or comment that never ends reaches to the end of the file (the splitter of small scripts takes such a quote as text).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions.arrays import let, unnest
from veldspar.functions.spans import BEGINS, PIECES, sql_text
from veldspar.functions.text import BLOCK_COMMENT, LINE_COMMENT, LITERAL, QUOTED_NAME, WORD_RUN
from veldspar.operators.statements import BLOCK_OPENER, split_statements
from veldspar.session import materialize
from veldspar.sources.scripts import EXTENSIONS, any_case_glob, decoded

CHUNK_LINES = 1000
# Chunks whose maps are composed in one row.
GROUP = 1000
# Different q-literal marks in use; a mark is one character.
MOST_MARKS = 500

# From the start over everything that is complete, then the beginning of what is not.
UNFINISHED = (rf"^(?:{LITERAL}|{QUOTED_NAME}|{LINE_COMMENT}|{BLOCK_COMMENT}|{WORD_RUN}|[^\w$#'\"\-/]++|\"|-(?!-)|/(?!\*)|(?i:n?q)(?='[\s']))*+"
              r"(?<open>(?i:n?q)'[^\s']|'|/\*)")
BLOCK_WORDS = rf"(?i)^[ \t]*{BLOCK_OPENER}|\b(?:DECLARE|BEGIN)\b"


def read_lines(spark: SparkSession, path: str, exts: Iterable[str] = EXTENSIONS, only: DataFrame | None = None) -> DataFrame:
    """(path, line_no, line) of UTF-8 script files, or of those whose ``path`` is in ``only``; a large file is read by as many tasks as it has splits."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", any_case_glob(exts)).text(path)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("place"), F.make_valid_utf8("value").alias("line"))
    rows = materialize(rows if only is None else rows.join(only, "path", "left_semi"), "script-lines")
    # a split's lines are numbered within the split: places of one split are consecutive
    blocks = rows.groupBy("path", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return rows.join(blocks, ["path", "block"]).select("path", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line_no"), "line")


def _closer(state: Column) -> Column:
    mark = F.substring(state, 3, 1)
    return (F.when(state == "", "").when(state == "'", "'").when(state == "/*", "*/")
            .otherwise(F.concat(F.translate(mark, "[{(<", "]})>"), F.lit("'"))))


def _plain_state(opener: Column) -> Column:
    """How an unfinished span begins, in one writing: nq'[ and Q'[ are q'[."""
    return F.when(F.char_length(opener) < 3, opener).otherwise(F.concat(F.lit("q'"), F.substring(opener, -1, 1)))


def _masked(state: Column, text: Column, end: Column) -> Column:
    """The chunk's lines with literals emptied and comments dropped, whatever was open before and stays open after; as many lines as before."""
    whole = F.concat(state, text, _closer(end))
    breaks = lambda p: F.repeat(F.lit("\n"), F.regexp_count(p, F.lit("\n")))
    hidden = lambda p: F.concat(F.when(p.rlike('^"'), p).when(p.rlike("^(?:--|/\\*)"), " ").otherwise("''"), breaks(p))
    parts = F.transform(F.regexp_extract_all(whole, F.lit(PIECES), F.lit(0)), lambda p: F.when(p.rlike(BEGINS) | p.rlike(r"^/\*\+"), hidden(p)).otherwise(p))
    return F.split(F.array_join(parts, ""), "\n")


def _first(flags: Column) -> Column:
    """Place of the first true, from 1; 0 if there is none."""
    return F.array_position(flags, True)


def _last(flags: Column) -> Column:
    at = F.array_position(F.reverse(flags), True)
    return F.when(at > 0, F.size(flags) - at + 1).otherwise(F.lit(0))


def _facts(state: Column, text: Column) -> Column:
    """What a chunk that begins in ``state`` does: its end state, its first and last lone slash, its first line ended by ';' and its first and last block words."""
    def of_lines(end: Column, masked: Column, raw: Column) -> Column:
        slash = F.transform(masked, lambda m: F.trim(m, F.lit(" \t")) == "/")
        semi = F.zip_with(masked, raw, lambda m, r: F.endswith(F.rtrim(m, F.lit(" \t")), F.lit(";")) & F.endswith(F.rtrim(r, F.lit(" \t")), F.lit(";")))
        block = F.transform(masked, lambda m: m.rlike(BLOCK_WORDS))
        return let(F.struct(slash.alias("slash"), semi.alias("semi"), block.alias("block")), lambda f: F.struct(
            end.alias("end"), _first(f["slash"]).alias("slash"), _last(f["slash"]).alias("last_slash"), _first(f["semi"]).alias("semi"),
            _first(f["block"]).alias("block"), _last(f["block"]).alias("last_block")))

    # the masked lines are bound: a column used in several places is worked out in each of them
    end = _plain_state(F.regexp_extract(F.concat(state, text), UNFINISHED, 2))  # the literal's mark is group 1
    return let(end, lambda e: let(F.struct(_masked(state, text, e).alias("masked"), F.split(text, "\n").alias("raw")),
                                  lambda x: of_lines(e, x["masked"], x["raw"])))


def _moved(fact: Column, dirty: Column) -> Column:
    """Whether PL/SQL was seen since the last lone slash, after the chunk."""
    return F.when(fact["last_slash"] > 0, fact["last_block"] > fact["last_slash"]).otherwise(dirty | (fact["last_block"] > 0))


def _starts(chunks: DataFrame, states: list[str]) -> DataFrame:
    """(path, chunk, state, dirty): how each chunk begins, from the maps of the chunks before it; two levels of rows with at most ``GROUP`` maps."""
    known = F.array(*map(F.lit, states))
    pick = lambda facts, state: F.get(facts, F.array_position(known, state).cast("int") - 1)

    def through(maps: Column, begin: Column) -> Column:
        """The states before each map and after the last, beginning with ``begin``."""
        def step(acc: Column, facts: Column) -> Column:
            last = F.element_at(acc, -1)
            return let(pick(facts, last["state"]), lambda f: F.array_append(acc, F.struct(f["end"].alias("state"), _moved(f, last["dirty"]).alias("dirty"))))
        return F.aggregate(maps, F.array(begin), step)

    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda s: s[c])
    kept = lambda f: F.struct(f["end"].alias("end"), f["last_slash"].alias("last_slash"), f["last_block"].alias("last_block"))
    small = chunks.select("path", F.floor(F.col("chunk") / GROUP).alias("group"), F.col("chunk").alias("at"), F.transform("facts", kept).alias("facts"))
    groups = materialize(small.groupBy("path", "group").agg(F.min("at").alias("first"), ordered("facts").alias("maps")), "chunk-maps")
    # a group's own map: where it ends for each way it might begin, with and without PL/SQL before
    begins = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(d).alias("dirty")) for s in states for d in (False, True)])
    ends = groups.select("path", F.col("group").alias("at"), F.transform(begins, lambda b: F.element_at(through(F.col("maps"), b), -1)).alias("ends"))
    places = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(d).alias("dirty")) for s in states for d in (False, True)])

    def step(acc: Column, ends: Column) -> Column:
        return F.array_append(acc, F.get(ends, F.array_position(places, F.element_at(acc, -1)).cast("int") - 1))

    fresh = F.struct(F.lit("").alias("state"), F.lit(False).alias("dirty"))
    files = ends.groupBy("path").agg(ordered("ends").alias("all"), F.array_sort(F.collect_list("at")).alias("numbers"))
    begun = files.select("path", F.explode(F.zip_with("numbers", F.aggregate("all", F.array(fresh), step), lambda n, b: F.struct(n.alias("group"), b.alias("begin")))).alias("g"))
    begun = begun.select("path", "g.group", "g.begin").filter("group IS NOT NULL")
    each = groups.join(begun, ["path", "group"])
    rows = unnest(each, ["path", "first"], F.slice(through(F.col("maps"), F.col("begin")), F.lit(1), F.size("maps")), "pos", "s")
    return rows.select("path", (F.col("first") + F.col("pos")).alias("chunk"), "s.state", "s.dirty")


def sections(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(path, first_line, text): the parts of each script that can be split on their own; ``lines`` has path, line_no (from 1, without gaps) and line."""
    chunk = F.floor((F.col("line_no") - 1) / chunk_lines).alias("chunk")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"])
    # chunks are small when they are stored and slow to read through: as many parts as the session has, whatever their bytes
    spread = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select("path", chunk, "line_no", F.coalesce("line", F.lit("")).alias("line")).repartition(spread, "path", "chunk")
    chunks = dealt.groupBy("path", "chunk").agg(F.array_join(parts, "\n").alias("text"), F.min("line_no").alias("first_line"))
    chunks = materialize(chunks, "script-chunks")
    marks = chunks.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)q'([^\s'])"), F.lit(1)))).alias("m")).distinct().limit(MOST_MARKS + 1).collect()
    if len(marks) > MOST_MARKS:
        raise ValueError(f"more than {MOST_MARKS} different q-literal marks")
    states = ["", "'", "/*", *sorted(f"q'{r['m']}" for r in marks)]
    facts = F.array(*[_facts(F.lit(s), F.col("text")) for s in states]) if len(states) < 8 else F.transform(
        F.array(*map(F.lit, states)), lambda s: _facts(s, F.col("text")))
    known = materialize(chunks.select("path", "chunk", "first_line", facts.alias("facts")), "chunk-facts")
    placed = known.join(_starts(known, states), ["path", "chunk"])
    fact = F.expr(f"get(facts, CAST(array_position(array({', '.join(map(sql_text, states))}), state) AS INT) - 1)")
    clean_semi = ~F.col("dirty") & (F.col("f.semi") > 0) & ((F.col("f.block") == 0) | (F.col("f.block") > F.col("f.semi")))
    cut = F.least(F.when(F.col("f.slash") > 0, F.col("f.slash")), F.when(clean_semi, F.col("f.semi")))
    cuts = materialize(placed.withColumn("f", fact).select("path", "chunk", "first_line", F.coalesce(cut, F.lit(0)).cast("int").alias("cut")), "chunk-cuts")
    upto = Window.partitionBy("path").orderBy("chunk")
    here = F.when(F.col("cut") > 0, F.col("chunk"))
    numbered = cuts.withColumn("head", F.coalesce(F.max(here).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    rows = chunks.drop("first_line").join(numbered, ["path", "chunk"]).withColumn("lines", F.split("text", "\n"))
    n, c = F.size("lines"), F.col("cut")
    text = lambda a, k: F.array_join(F.slice(F.col("lines"), a, k), "\n")
    head = F.struct(F.col("head").alias("section"), F.col("first_line").alias("at"), text(F.lit(1), F.when(c > 0, c).otherwise(n)).alias("text"))
    tail = F.struct(F.col("chunk").alias("section"), (F.col("first_line") + c).alias("at"), text(c + 1, F.greatest(n - c, F.lit(0))).alias("text"))
    both = rows.select("path", F.explode(F.when((c > 0) & (c < n), F.array(head, tail)).otherwise(F.array(head))).alias("p")).select("path", "p.*")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), "\n")
    return both.groupBy("path", "section").agg(F.min("at").alias("first_line"), joined.alias("text")).drop("section")


def split_large(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The statements of each script, as ``split_statements`` gives them: path, stmt_no, stmt_line, stmt_type, leading_comment, text."""
    found = materialize(split_statements(sections(lines, chunk_lines)), "section-statements")
    counts = found.groupBy("path", "first_line").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("first_line").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return found.join(counts, ["path", "first_line"]).select(
        "path", (F.col("before") + F.col("stmt_no")).cast("int").alias("stmt_no"), (F.col("first_line") + F.col("stmt_line") - 1).alias("stmt_line"),
        "stmt_type", "leading_comment", "text")


def split_archive(spark: SparkSession, path: str, most: int | None = None, exts: Iterable[str] = EXTENSIONS) -> DataFrame:
    """The statements of all UTF-8 scripts of a directory tree: files up to ``most`` bytes within their row, larger ones by sections.

    ``most`` is at most what one row may hold (``spark.sql.sources.binaryFile.maxLength``), which is also its default.
    """
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    most = limit if most is None else min(most, limit)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case_glob(exts)).load(path)
    large = listed.select("path", "length").filter(F.col("length") > most).select("path")  # sizes come from the listing; no file is opened
    small = split_statements(decoded(listed.filter(F.col("length") <= most), "utf-8").select("path", "text"))  # applied before a file is opened
    big = split_large(read_lines(spark, path, exts, materialize(large, "large-scripts")))
    return small.withColumn("stmt_no", F.col("stmt_no").cast("int")).unionByName(big)
