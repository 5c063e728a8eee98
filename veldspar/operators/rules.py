"""Rule jobs over a text column: selection, scan, ordered rewrite with a ledger, match lines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import astuple, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions.arrays import unnest
from veldspar.functions.spans import protect_sql, restore_sql, sql_text
from veldspar.operators.rule_table import Rule, default_rules
from veldspar.operators.skew import lookup_join

RULE_SCHEMA = (
    "rule_id string, category string, severity string, mode string, token string, pattern string, "
    "replacement string, description string, scope array<string>, severity_override string, rule_order int"
)


# Rules become literals of the plan; more than this is not configuration any more.
MOST_RULES = 5_000

# --- the registry as a table ----------------------------------------------------------------

def rules_df(spark: SparkSession, rules: Iterable[Rule] | None = None) -> DataFrame:
    rows = [astuple(r) for r in (default_rules() if rules is None else rules)]
    return spark.createDataFrame([(*r[:8], list(r[8]), *r[9:]) for r in rows], RULE_SCHEMA)


def rules_list(rules: DataFrame | Iterable[Rule]) -> list[Rule]:
    """Rules on the driver: a rule table is configuration, written by hand."""
    if not isinstance(rules, DataFrame):
        return sorted(rules, key=lambda r: r.rule_order)
    names = [f.name for f in fields(Rule)]
    rows = rules.select(*names).orderBy("rule_order", "rule_id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table has at most {MOST_RULES} rows")
    return [Rule(**{**r.asDict(), "scope": tuple(r["scope"] or ())}) for r in rows]


def effective_severity(severity, override) -> Column:
    return F.coalesce(F.nullif(F.col(override), F.lit("")), F.col(severity))


def with_effective_severity(rules: DataFrame) -> DataFrame:
    return rules.withColumn("effective_severity", effective_severity("severity", "severity_override"))


def rules_by_category(rules: DataFrame, category: str) -> DataFrame:
    return rules.filter(F.col("category") == category)


def rules_by_severity(rules: DataFrame, severity: str) -> DataFrame:
    return with_effective_severity(rules).filter(F.col("effective_severity") == severity)


def rules_auto_fixable(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("mode") == "fix")


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.filter(F.col("rule_id") == rule_id)


def rule_categories(rules: DataFrame) -> DataFrame:
    return rules.select("category").distinct().orderBy("category")


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category").agg(F.count_distinct("rule_id").alias("n"))


def select_rules(rules: DataFrame, toggles: Mapping[str, bool] | None = None,
                 disabled: Iterable[str] = (), forced: Iterable[str] = ()) -> DataFrame:
    """Rules of enabled categories without the disabled ids, plus the forced ids whatever else holds.

    A category that is not listed is enabled.
    """
    off = [c for c, on in (toggles or {}).items() if not on]
    disabled, forced = list(disabled), list(forced)
    kept = ~F.col("category").isin(off) if off else F.lit(True)
    if disabled:
        kept = kept & ~F.col("rule_id").isin(disabled)
    if forced:
        kept = kept | F.col("rule_id").isin(forced)
    return rules.filter(kept)


def add_user_rules(rules: DataFrame, user_rules: DataFrame) -> DataFrame:
    """User rules come last, in the order of their ids, unless they carry a rule_order of their own."""
    last = rules.agg(F.coalesce(F.max("rule_order"), F.lit(0))).first()[0]
    place = F.row_number().over(Window.orderBy("rule_id", "pattern"))  # a rule table is configuration, see rules_list
    unset = user_rules.filter("rule_order = 0").withColumn("rule_order", (F.lit(last) + place).cast("int"))
    return rules.unionByName(user_rules.filter("rule_order <> 0")).unionByName(unset)


# --- which rules a text has to go through ---------------------------------------------------

_ASCII = sql_text("abcdefghijklmnopqrstuvwxyz"), sql_text("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def whole_word(rule: Rule) -> bool:
    """Whether every match holds the rule's token as a word of its own, as its pattern says."""
    if not re.fullmatch(r"[A-Z0-9_]+", rule.token):
        return False
    before, after = r"(?:\\b|\\s\+|\\s\+\)\?)(?:\(\?:)?", r"(?:\\b|\\s\+|\\s\*\\[(n])"
    body = re.sub(r"^\(\?[is]+\)", "", rule.pattern)
    return all(re.search(before + "$", body[:m.start()]) and re.match(after, body[m.end():])
               for m in re.finditer(re.escape(rule.token), body, re.I)) and rule.token in body.upper()


class Candidates:
    """Which rules have to look at a text, worked out from one pass over its words.

    The words of a text meet the rules' tokens once; each of the handful that remains names its rules by a map.  Tokens that are no words are looked for on their
    own.  For a rewrite, a token also names the rules whose token a rule of its own could bring in.  Statement types are checked where a rule acts.
    """

    def __init__(self, ruleset: list[Rule], rewriting: bool):
        self.rules = ruleset
        tokens = {r.token for r in ruleset if r.token}
        self.words = sorted(t for t in tokens if all(whole_word(r) for r in ruleset if r.token == t))
        self.parts = sorted(tokens.difference(self.words))
        brings = [{i for i, r in enumerate(ruleset) if i > e and rewriting and x.mode == "fix" and r.token and r.token in x.replacement.upper()}
                  for e, x in enumerate(ruleset)]
        # a rule due brings in others, which may bring in more
        self.leads = [{i} for i in range(len(ruleset))]
        for e in range(len(ruleset) - 1, -1, -1):
            for i in brings[e]:
                self.leads[e] |= self.leads[i]

    def ready(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with the column ``_due``: the numbers of the rules that have to look, in order; ``text`` is SQL."""
        found = df.withColumn("_upper", F.expr(self.upper_sql(text))).withColumn("_words", F.expr(self.words_sql("`_upper`")))
        return found.withColumn("_due", F.expr(self.due_sql("`_words`"))).drop("_upper", "_words")

    def upper_sql(self, text: str) -> str:
        """Letters A-Z only: what the patterns take as equal."""
        return f"translate({text}, {_ASCII[0]}, {_ASCII[1]})"

    def words_sql(self, upper: str) -> str:
        """The tokens among a text's words, and those found that are no words."""
        known = ", ".join(map(sql_text, self.words))
        words = f"array_distinct(filter(regexp_extract_all({upper}, '[A-Z0-9_]++', 0), w -> w IN ({known})))" if known else "CAST(array() AS array<string>)"
        if not self.parts:
            return words
        parts = ", ".join(f"CASE WHEN contains({upper}, {sql_text(t)}) THEN {sql_text(t)} END" for t in self.parts)
        return f"concat({words}, array_compact(array({parts})))"

    def due_sql(self, words: str) -> str:
        """Numbers of the rules that have to look, in order."""
        by_token: dict[str, set[int]] = {}
        for i, r in enumerate(self.rules):
            by_token.setdefault(r.token, set()).update(self.leads[i])
        always = by_token.pop("", set())
        pairs = ", ".join(f"{sql_text(t)}, array({', '.join(map(str, sorted(n)))})" for t, n in sorted(by_token.items()))
        found = f"flatten(transform({words}, w -> try_element_at(map({pairs}), w)))" if pairs else "CAST(array() AS array<int>)"
        found = f"concat(array({', '.join(map(str, sorted(always)))}), {found})" if always else found
        return f"sort_array(array_distinct({found}))" if always or any(len(x) > 1 for x in self.leads) else f"sort_array({found})"

    def of_kind(self, i: int, kind: str | None) -> str:
        """Whether rule i is one for this statement type."""
        scope = self.rules[i].scope
        return f"{kind} IN ({', '.join(map(sql_text, scope))})" if scope and kind else "true"


def _chosen(n: int, number: str, branch, otherwise: str) -> str:
    """``branch(i)`` for i = ``number``, found in two steps."""
    groups = []
    for low in range(0, n, _STEP):
        branches = " ".join(f"WHEN {i} THEN {branch(i)}" for i in range(low, min(n, low + _STEP)))
        groups.append(f"WHEN {number} < {low + _STEP} THEN CASE {number} {branches} ELSE {otherwise} END")
    return f"CASE {' '.join(groups)} ELSE {otherwise} END"


# Rules whose number is looked up together.
_STEP = 12


# --- scan -----------------------------------------------------------------------------------

def match_patterns(texts: DataFrame, rules: DataFrame | Iterable[Rule], text: str = "text", stmt_type: str | None = None, protect: bool = False,
                   places: bool = False) -> DataFrame:
    """Every (text row, rule) pair whose pattern matches, as one narrow pass over the texts.

    The patterns are literals of the plan, so each is compiled once per task, and only the rules whose token is among a text's words search it.
    Nothing is joined or shuffled.  ``protect`` hides what literals, quoted names and comments say; ``places`` adds ``match_pos``, the place of the first match in the text.
    """
    ruleset = rules_list(rules)
    kept = list(texts.columns)
    seen = texts.withColumn("_seen", F.expr(protect_sql(f"`{text}`"))) if protect else texts.withColumn("_seen", F.struct(F.col(text).alias("text")))
    if not ruleset:
        return texts.select(*kept, F.expr(f"CAST(NULL AS {_FACTS_TYPE})").alias("r")).select(*kept, "r.*").limit(0)
    candidates = Candidates(ruleset, rewriting=False)
    ready = candidates.ready(seen, "`_seen`.text")
    kind = f"`{stmt_type}`" if stmt_type else None
    if places:
        at = _chosen(len(ruleset), "i", lambda i: f"CASE WHEN {candidates.of_kind(i, kind)} THEN regexp_instr(`_seen`.text, {sql_text(ruleset[i].pattern)}) ELSE 0 END", "0")
        found = ready.withColumn("_hits", F.expr(f"filter(transform(`_due`, i -> named_struct('i', i, 'at', {at})), h -> h.at > 0)"))
    else:
        here = _chosen(len(ruleset), "i", lambda i: f"{candidates.of_kind(i, kind)} AND `_seen`.text RLIKE {sql_text(ruleset[i].pattern)}", "false")
        found = ready.withColumn("_hits", F.expr(f"filter(`_due`, i -> {here})"))
    rows = unnest(found, [*kept, "_seen"], F.col("_hits"), "_pos", "_hit")
    number = F.col("_hit.i") if places else F.col("_hit")
    out = [*kept, F.element_at(rule_facts(ruleset), number + 1).alias("r")]
    if places:
        before = F.substring(F.col("_seen.text"), F.lit(1), F.col("_hit.at") - 1)
        hidden = rows.withColumn("_before", before)
        whole = F.expr(restore_sql("`_before`", "`_seen`.kept")) if protect else F.col("_before")
        return hidden.select(*out, whole.alias("_before")).select(*kept, "r.*", (F.char_length("_before") + 1).alias("match_pos"))
    return rows.select(*out).select(*kept, "r.*")


def _facts_sql(rule: Rule) -> str:
    return (f"named_struct('rule_id', {sql_text(rule.rule_id)}, 'category', {sql_text(rule.category)}, "
            f"'severity', {sql_text(rule.severity_override or rule.severity)}, "
            f"'description', {sql_text(rule.description)}, 'rule_order', {rule.rule_order})")


_FACTS_TYPE = "struct<rule_id: string, category: string, severity: string, description: string, rule_order: int>"


def rule_facts(ruleset: list[Rule]) -> Column:
    """What a finding says about each rule, as a constant array."""
    return F.expr(f"array({', '.join(map(_facts_sql, ruleset))})")


def scan(stmts: DataFrame, rules: DataFrame | Iterable[Rule], text: str = "text", protect: bool = True, places: bool = False) -> DataFrame:
    """Findings of all rules, detect-only ones included, each within its statement types; what literals, quoted names and comments say is no finding."""
    return match_patterns(stmts, rules, text, "stmt_type" if "stmt_type" in stmts.columns else None, protect, places)


def scan_places(stmts: DataFrame, rules: DataFrame | Iterable[Rule], text: str = "text", first_line: str = "stmt_line", protect: bool = True) -> DataFrame:
    """``scan`` with the position of each first match in its text, and the line it lies on; each pattern searches a text once."""
    return _with_line(scan(stmts, rules, text, protect, places=True), text, first_line)


def locate_matches(findings: DataFrame, rules: DataFrame | Iterable[Rule], text: str = "text", first_line: str = "stmt_line", protect: bool = True) -> DataFrame:
    """Position of each finding's first match in its text, and the line it lies on, for findings that come without."""
    ruleset = rules_list(rules)
    numbers = {f"{r.rule_order} {r.rule_id}": i for i, r in enumerate(ruleset)}
    number = F.array_position(F.array(*map(F.lit, numbers)), F.concat_ws(" ", "rule_order", "rule_id")).cast("int") - 1
    seen = findings.withColumn("_seen", F.expr(protect_sql(f"`{text}`")) if protect else F.struct(F.col(text).alias("text"), F.array().cast("array<string>").alias("kept")))
    order = list(numbers.values())
    at = _chosen(len(order), "`_number`", lambda n: f"regexp_instr(`_seen`.text, {sql_text(ruleset[order[n]].pattern)})", "0")
    placed = seen.withColumn("_number", number).withColumn("_at", F.expr(at))
    before = placed.withColumn("_before", F.expr("substring(`_seen`.text, 1, `_at` - 1)"))
    found = before.withColumn("match_pos", F.when(F.col("_at") > 0, F.char_length(F.expr(restore_sql("`_before`", "`_seen`.kept"))) + 1).otherwise(F.col("_at")))
    return _with_line(found.drop("_seen", "_number", "_at", "_before"), text, first_line)


def _with_line(placed: DataFrame, text: str, first_line: str) -> DataFrame:
    before = F.substring(F.col(text), F.lit(1), F.col("match_pos") - 1)
    down = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))
    return placed.withColumn("match_line", F.col(first_line) + down)


# --- rewrite --------------------------------------------------------------------------------

def _apply_sql(candidates: Candidates, text: str, due: str, kind: str) -> str:
    """struct(text, ledger): the due rules (numbers, in order) applied one after the other, and those that acted.

    Each rule is a branch with its own literal pattern, compiled once per task; the branches are found in two steps.  The replaced text is bound by
    a one-element ``transform`` so that it is computed once.
    """
    def act(i: int, r: Rule) -> str:
        if r.mode != "fix":
            return f"CASE WHEN acc.text RLIKE {sql_text(r.pattern)} THEN named_struct('text', acc.text, 'ledger', array_append(acc.ledger, {i})) ELSE acc END"
        return (f"transform(array(regexp_replace(acc.text, {sql_text(r.pattern)}, {sql_text(r.replacement)})), "
                f"new -> CASE WHEN new <> acc.text THEN named_struct('text', new, 'ledger', array_append(acc.ledger, {i})) ELSE acc END)[0]")

    def acts(i: int) -> str:
        rule = candidates.rules[i]
        return f"CASE WHEN {candidates.of_kind(i, kind)} THEN {act(i, rule)} ELSE acc END" if rule.scope else act(i, rule)

    step = _chosen(len(candidates.rules), "i", acts, "acc")
    return f"aggregate({due}, named_struct('text', {text}, 'ledger', CAST(array() AS array<int>)), (acc, i) -> {step})"


def rewrite_sql(text: str, kind: str, ruleset: list[Rule]) -> str:
    """The whole rewrite as one expression over SQL fragments, for use inside array lambdas."""
    if not ruleset:
        return f"named_struct('text', {text}, 'ledger', CAST(array() AS array<int>))"
    c = Candidates(ruleset, rewriting=True)
    steps = [
        ("v", f"named_struct('seen', {protect_sql(text)}, 'kind', {kind})"),
        ("w", f"named_struct('seen', v.seen, 'kind', v.kind, 'upper', {c.upper_sql('v.seen.text')})"),
        ("u", f"named_struct('seen', w.seen, 'kind', w.kind, 'upper', w.upper, 'words', {c.words_sql('w.upper')})"),
        ("d", f"named_struct('seen', u.seen, 'kind', u.kind, 'due', {c.due_sql('u.words')})"),
        ("x", f"named_struct('seen', d.seen, 'done', {_apply_sql(c, 'd.seen.text', 'd.due', 'd.kind')})")]
    out = f"named_struct('text', {restore_sql('x.done.text', 'x.seen.kept')}, 'ledger', x.done.ledger)"
    for name, value in reversed(steps):
        out = f"transform(array({value}), {name} -> {out})[0]"
    return out


def rewrite(stmts: DataFrame, rules: DataFrame | Iterable[Rule], protect: bool = True) -> DataFrame:
    """Statements with ``new_text`` and ``ledger`` (structs of the rules that acted, in order).

    What literals, quoted names and comments say stays as it is (``protect``; off for plain prose).  The due rules are worked out in generated code;
    the fold then sees the handful that remain, and statements without any skip it.
    """
    ruleset = rules_list(rules)
    nothing = F.array().cast("array<int>")
    if not ruleset:
        facts = F.expr(f"slice(array({_facts_sql(default_rules()[0])}), 1, 0)")
        return stmts.withColumns({"new_text": F.col("text"), "ledger": facts})
    candidates = Candidates(ruleset, rewriting=True)
    seen = stmts.withColumn("_seen", F.expr(protect_sql("`text`")) if protect else F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("kept")))
    due = candidates.ready(seen, "`_seen`.text")
    untouched = F.struct(F.col("_seen.text").alias("text"), nothing.alias("ledger"))
    done = due.withColumn("_done", F.when(F.size("_due") == 0, untouched).otherwise(F.expr(_apply_sql(candidates, "`_seen`.text", "`_due`", "`stmt_type`"))))
    facts = rule_facts(ruleset)
    new_text = F.when(F.size("_done.ledger") == 0, F.col("text")).otherwise(F.expr(restore_sql("`_done`.text", "`_seen`.kept")))
    return done.withColumns({
        "new_text": new_text,
        "ledger": F.transform("_done.ledger", lambda i: F.element_at(facts, i + 1)),
    }).drop("_done", "_due", "_seen")


def rewrite_distinct(stmts: DataFrame, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    """``rewrite`` for archives that repeat themselves: each distinct text is rewritten once.

    Copies are found by digest with a combined aggregate; a text repeated in a large part of the
    archive is joined back without gathering its copies in one task.
    """
    keyed = stmts.withColumn("_digest", F.sha2(F.concat_ws("\u0001", "stmt_type", "text"), 256))
    once = keyed.groupBy("_digest").agg(F.max("stmt_type").alias("stmt_type"), F.max("text").alias("text"))
    done = rewrite(once, rules).select("_digest", "new_text", "ledger")
    return lookup_join(keyed, done, ["_digest"], "inner").drop("_digest")


def findings_of(rewritten: DataFrame) -> DataFrame:
    """The ledger as one finding per row; old and new text are not carried."""
    kept = [c for c in rewritten.columns if c not in ("text", "new_text", "ledger", "leading_comment")]
    return unnest(rewritten, kept, F.col("ledger"), "_pos", "r").select(
        *kept, (F.col("_pos") + 1).alias("finding_no"), "r.*")


def schema_rules(mapping: Mapping[str, str], schemas: Iterable[str] = ()) -> list[Rule]:
    """Rules that rename the listed schemas in qualified names and drop the unlisted ``schemas``."""
    wanted = {k.upper(): v for k, v in mapping.items()}
    names = sorted(set(wanted) | {s.upper() for s in schemas})
    return [
        Rule("SCHEMA", "OBJECT", "AUTO", "fix", n, rf"(?i)(?<![\w.:]){n}\.(?=\w)",
             f"{wanted[n]}." if n in wanted else "", f"Schema {n} mapped", (), "", i + 1)
        for i, n in enumerate(names)
    ]


def rewrite_schema(stmts: DataFrame, mapping: Mapping[str, str], schemas: Iterable[str] = ()) -> DataFrame:
    return rewrite(stmts, schema_rules(mapping, schemas))
