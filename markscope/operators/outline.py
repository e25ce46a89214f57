"""Code outline (T1, T2, T4, X11, W1, J2, O1): declarations and scope paths.

A file is split into lines after its strings and comments are blanked out
(``mask``), so braces, keywords and colons inside them do not count.  Each
line is matched against a small per-language rule table (regexes, tried in
order).  Nesting then comes from windows, never from pairing rows:

* brace languages (rust, cpp, typescript, javascript): the depth before each
  line is a running sum of ``{`` minus ``}``.  A declaration at depth n is
  inside the blocks opened, for each level j < n, on the last earlier line
  that left level j open.
* indentation languages (python, ruby): a line is a block opener when the
  next code line is indented deeper.  A declaration at indent i is inside,
  for each opener indent k < i, the last earlier opener with indent <= k,
  when that opener's indent is exactly k.

A declaration is kept only when every block around it is the body of a
declaration that opens a scope (a class, a module, an impl...), which is the
reference's rule of walking only the root and scope bodies.  Everything is
keyed by ``path``: one shuffle puts a file in one task, and all windows,
groupings and joins after that reuse the partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from markscope.functions import lexer
from markscope.operators.lang import comment_prefix_of, indent_unit_of, scannable_rules
from markscope.operators.lines import split_lines
from markscope.session import broadcast_if_small, carried

BRACE_LANGS = ["rust", "cpp", "typescript", "javascript"]
INDENT_LANGS = ["python", "ruby"]

# String / comment tokens per language (Java regex).  Loops over groups are
# possessive: they keep no state per round, so the regex stack stays flat.
_DQ = r'"(?:[^"\\\n]++|\\.)*+"'
_SQ = r"'(?:[^'\\\n]++|\\.)*+'"
_DQ_ML = r'"(?:[^"\\]++|\\[\s\S])*+"'
_SQ_ML = r"'(?:[^'\\]++|\\[\s\S])*+'"
_BLOCK = r"/\*[\s\S]*?\*/"
_LINE = r"//[^\n]*"
MASK_TOKENS = {
    "python": "|".join([r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", _DQ, _SQ, r"#[^\n]*", r"""[^"'#]+""", r"[\s\S]"]),
    "ruby": "|".join([r"^=begin[\s\S]*?^=end", _DQ_ML, _SQ_ML, r"#[^\n]*", r"""[^"'#=]+""", r"[\s\S]"]),
    "rust": "|".join([_BLOCK, _LINE, _DQ_ML, r"'(?:\\[^'\n]{1,10}|[^'\\\n])'", r"""[^/"']+""", r"[\s\S]"]),
    "cpp": "|".join([_BLOCK, _LINE, _DQ, _SQ, r"""[^/"']+""", r"[\s\S]"]),
    "typescript": "|".join([_BLOCK, _LINE, _DQ, _SQ, r"`(?:[^`\\]++|\\[\s\S])*+`", r"""[^/"'`]+""", r"[\s\S]"]),
}
MASK_TOKENS["javascript"] = MASK_TOKENS["typescript"]
MASKED_START = {"python": r"""^["'#]""", "ruby": r"""^(["'#]|=begin)""", "rust": r"""^(["']|/[*/])""",
                "cpp": r"""^(["']|/[*/])""", "typescript": r"""^(["'`]|/[*/])""",
                "javascript": r"""^(["'`]|/[*/])"""}
# Files with forms that these tokens cannot tell apart (patterns, templates with code in them,
# raw strings, here-documents, interpolation, directives) go through the lexer instead.
STATEFUL = {"ruby": r"<<|[/%?`]|#\{|__END__", "rust": r'\b[bc]?r#*"|/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*',
            "cpp": r"""(?m)^[ \t]*#|R"|\d'\w|//[^\n]*\\\n""", "typescript": r"(?<![/*])/(?![/*])|`[^`]*\$\{",
            "javascript": r"(?<![/*])/(?![/*])|`[^`]*\$\{"}

# Declaration rules: (language, kind, role, regex over the masked line,
# name groups, flags).  Roles: "decl" gets a comment, "scope" gets a comment
# and its body is walked, "ignorable" gets none and swallows the decorators
# above it, "decorator" is attached to the next declaration.  Flags:
# "body" - needs a block ("{" before ";"), "member" - only inside a scope,
# "oneline_ignorable" - no comment when the block closes on its first line.
_V = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_GEN_CHARS = r"(?:[^<>-]|->|-(?!>))"  # the arrow of a function type closes nothing
_GEN = rf"<(?:{_GEN_CHARS}|<(?:{_GEN_CHARS}|<{_GEN_CHARS}*+>)*+>)*+>"
_ID = r"[\p{L}_][\p{L}\p{N}_]*"
RULES = [
    # python
    ("python", "decorator", "decorator", r"^\s*@", [], ""),
    ("python", "class_definition", "scope", rf"^\s*class\s+({_ID})", [1], ""),
    ("python", "function_definition", "decl", rf"^\s*(?:async\s+)?def\s+({_ID})", [1], ""),
    # ruby
    ("ruby", "module", "scope", r"^\s*module\s+([A-Z][\w:]*)", [1], ""),
    ("ruby", "class", "scope", r"^\s*class\s+([A-Z][\w:]*)", [1], ""),
    ("ruby", "method", "decl", r"^\s*def\s+(?!self\.)([^\s(;]+)", [1], ""),
    # rust
    ("rust", "attribute_item", "decorator", r"^\s*#\[", [], ""),
    ("rust", "macro_definition", "decl", r"^\s*macro_rules!\s*(\w+)", [1], ""),
    ("rust", "mod_item", "scope", rf"^\s*{_V}mod\s+(\w+)", [1], "oneline_ignorable"),
    ("rust", "enum_item", "decl", rf"^\s*{_V}enum\s+(\w+)", [1], ""),
    ("rust", "struct_item", "decl", rf"^\s*{_V}struct\s+(\w+)", [1], ""),
    ("rust", "trait_item", "decl", rf"^\s*{_V}(?:unsafe\s+)?(?:auto\s+)?trait\s+(\w+)", [1], ""),
    ("rust", "impl_item", "scope",
     rf"^\s*(?:unsafe\s+)?impl(?:\s*{_GEN})?\s+(?:!?([\w:]+(?:{_GEN})?)\s+for\s+)?([\w:&\[\]]+(?:{_GEN})?)", [1, 2], ""),
    ("rust", "function_item", "decl",
     rf"^\s*{_V}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+(\w+)", [1], ""),
    ("rust", "use_declaration", "ignorable", rf"^\s*{_V}use\s", [], ""),
    ("rust", "extern_crate_declaration", "ignorable", rf"^\s*{_V}extern\s+crate\s", [], ""),
    ("rust", "foreign_mod_item", "ignorable", r"^\s*(?:unsafe\s+)?extern\s*\{", [], ""),
    ("rust", "static_item", "ignorable", rf"^\s*{_V}static\s", [], ""),
    ("rust", "const_item", "ignorable", rf"^\s*{_V}const\s+(?!fn\b)\w+\s*:", [], ""),
    ("rust", "type_item", "ignorable", rf"^\s*{_V}type\s+\w+", [], ""),
    ("rust", "macro_invocation", "ignorable", r"^\s*[\w:]+!\s*[(\[{]", [], ""),
    # cpp (also C headers)
    ("cpp", "namespace_definition", "scope", r"^\s*(?:inline\s+)?namespace(?:\s+([\w:]+))?\s*(?:\{|$)", [1], "body"),
    ("cpp", "class_specifier", "scope",
     r"^\s*class\s+[\w:\s]*?(?<=\s)([A-Za-z_]\w*+)\s*+(?:final\s*+)?(?:[:{]|$)", [1], "body"),
    ("cpp", "function_definition", "decl",
     r"^\s*(?!(?:if|for|while|switch|return|else|do|case|catch|sizeof|new|delete|throw|using|typedef|namespace"
     r"|class|struct|enum|union|template|public|private|protected|goto|static_assert|extern)\b)"
     # all up to the bracket is a type's text; the name is what stands right before the bracket
     r"(?=[\w:<>,*&~\[\]\s]*+(?:(?<=operator\s{0,4})[^\s(\w]*+\s*+)?\()[\w:<>,*&~\[\]\s]*?(?:^|(?<=[\s*&]))"
     r"((?:\w+::)*+~?(?!operator\b)[A-Za-z_]\w*+|(?:\w+::)*+operator\s*+[^\s(]++)\s*+\([^;{]*+(?:\{|$)",
     [1], "body"),
    # typescript / javascript
    ("ts", "decorator", "decorator", r"^\s*@[\w.$]+", [], ""),
    ("ts", "export_statement", "decl",
     r"^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
     r"(?:(?:class|interface|enum|type|namespace|module|const\s+enum)\s+|function\s*\*?\s*)([\w$]+)", [1], ""),
    ("ts", "class_declaration", "scope", r"^\s*class\s+([\w$]+)", [1], ""),
    ("ts", "function_declaration", "decl", r"^\s*(?:async\s+)?function\s+([\w$]+)", [1], ""),
    ("ts", "interface_declaration", "decl", r"^\s*interface\s+([\w$]+)", [1], ""),
    ("ts", "enum_declaration", "decl", r"^\s*(?:const\s+)?enum\s+([\w$]+)", [1], ""),
    ("ts", "expression_statement", "decl", r"^\s*(?:namespace|module)\s+[\w$.]+\s*\{", [], "closed"),
    ("ts", "method_definition", "decl",
     r"^\s*(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+(?!\())*+\*?\s*"
     r"(?!(?:if|for|while|switch|catch|function|return|with|else|new|typeof|await|yield|super|this)\b)"
     r"(#?[\w$]+)\s*(?:<[^>]*>)?\s*\(", [1], "body member"),
    # any other statement at the top level (a call, an assignment, a string
    # directive): named "anonymous"; checked further in symbols_from
    ("ts", "expression_statement", "decl",
     r"^\s*(?!(?:import|export|const|let|var|function|async\s+function|class|if|else|for|while|do|switch|try"
     r"|catch|finally|return|throw|break|continue|default|case|with|debugger)\b)"
     r"(?!(?:interface|enum|type|declare|abstract|namespace|module)\s+[\w$])[^\s})\],.?:=&|*/%<>+\-]",
     [], "toplevel closed"),
]

# The word by which a rule's lines are looked up, by kind (a rule without one is tried on every line).
KEYWORDS = {("python", "class_definition"): "class", ("python", "function_definition"): "def",
            ("ruby", "module"): "module", ("ruby", "class"): "class", ("ruby", "method"): "def",
            ("rust", "macro_definition"): "macro_rules", ("rust", "mod_item"): "mod", ("rust", "enum_item"): "enum",
            ("rust", "struct_item"): "struct", ("rust", "trait_item"): "trait", ("rust", "impl_item"): "impl",
            ("rust", "function_item"): "fn", ("rust", "use_declaration"): "use",
            ("rust", "extern_crate_declaration"): "crate", ("rust", "static_item"): "static",
            ("rust", "const_item"): "const", ("rust", "type_item"): "type", ("cpp", "namespace_definition"): "namespace",
            ("cpp", "class_specifier"): "class", ("ts", "export_statement"): "export", ("ts", "class_declaration"): "class",
            ("ts", "function_declaration"): "function", ("ts", "interface_declaration"): "interface",
            ("ts", "enum_declaration"): "enum"}
RULE_TABLE = ("language string, ord int, keyword string, kind string, role string, regex string, "
              "name_groups array<int>, flags string")


_LEAD = r"^\s*"  # every rule starts with it; the combined prefilter hoists it


def _rules_for(lang: str):
    key = "ts" if lang in ("typescript", "javascript") else lang
    return [r for r in RULES if r[0] == key]


# languages that share one rule table and one token grammar
_GROUPS = [["python"], ["ruby"], ["rust"], ["cpp"], ["typescript", "javascript"]]


def mask(content: Column, language: Column, lexed: Column) -> Column:
    """Blank the strings and comments (line breaks kept); ``lexed`` is used where it is set."""
    out = None
    for group in _GROUPS:
        toks = F.regexp_extract_all(content, F.lit("(?m)" + MASK_TOKENS[group[0]]), 0)
        masked = F.array_join(F.transform(toks, _masker(MASKED_START[group[0]])), "")
        cond = language.isin(group)
        out = F.when(cond, masked) if out is None else out.when(cond, masked)
    return F.coalesce(lexed, out.otherwise(content))


def lexed_text(content: Column, language: Column) -> Column:
    """The lexer's result for files that need it, NULL for the others (which it does not see)."""
    hard = F.lit(False)
    for lang, form in STATEFUL.items():
        hard = hard | ((language == lang) & content.rlike(form))
    return _lexed(F.when(hard, content), language)


@F.pandas_udf(T.StringType())
def _lexed(content: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else lexer.blanked(t, g) for t, g in zip(content, language)], dtype=object)


carried("markscope.functions.lexer", __name__)


def _masker(start: str):
    def fn(t):
        # a run without newlines becomes one space: line breaks and the
        # order of what is left are all that later steps need
        return F.when(t.rlike(start), F.regexp_replace(t, r"[^\n]+", " ")).otherwise(t)
    return fn


def _match(m: Column, language: Column) -> Column:
    """First matching rule per line: struct(kind, role, name, flags) or NULL."""
    branches = None
    for group in _GROUPS:
        lang = group[0]
        res = None
        for _, kind, role, rx, groups, flags in reversed(_rules_for(lang)):
            if groups:
                names = [F.nullif(F.regexp_extract(m, rx, g), F.lit("")) for g in groups]
                name = F.coalesce(*names) if len(names) > 1 else names[0]
            else:
                name = F.lit(None).cast("string")
            hit = F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), name.alias("name"),
                           F.lit(flags).alias("flags"))
            res = F.when(m.rlike(rx), hit) if res is None else F.when(m.rlike(rx), hit).otherwise(res)
        # one combined pass first: most lines match no rule at all
        anyrule = r"^\s*(?:" + "|".join(f"(?:{r[3][len(_LEAD):]})" for r in _rules_for(lang)) + ")"
        res = F.when(m.rlike(anyrule), res)
        cond = language.isin(group)
        branches = F.when(cond, res) if branches is None else branches.when(cond, res)
    return branches


def decl_rules(spark: SparkSession) -> DataFrame:
    """The outline's own rules as rows of RULE_TABLE. Their roles are those of the symbol sets (A6):
    an ignorable kind, a kind that opens a scope, another listed kind; decorators and kinds
    whose bodies are not walked (flag ``closed``) keep the rule's role."""
    rows = [(lang, i, KEYWORDS.get((r[0], r[1])), r[1], r[2], r[3], r[4], r[5])
            for group in _GROUPS for lang in group for i, r in enumerate(_rules_for(lang))]
    kinds = scannable_rules(spark).groupBy("language", "kind").agg(
        F.max("is_ignorable").alias("ign"), F.max("is_scope").alias("scope"))
    role = F.when((F.col("role") == "decorator") | F.col("flags").contains("closed") | F.col("ign").isNull(), F.col("role")) \
            .when(F.col("ign"), "ignorable").when(F.col("scope"), "scope").otherwise("decl")
    # a few dozen rows on both sides
    return (spark.createDataFrame(rows, RULE_TABLE).join(F.broadcast(kinds), ["language", "kind"], "left")
            .withColumn("role", role).select("language", "ord", "keyword", "kind", "role", "regex", "name_groups", "flags"))


def _rule_lookup(rules: DataFrame) -> DataFrame:
    """One row per language: its rules in a map from keyword ('' for rules without one)."""
    item = F.struct("ord", "kind", "role", "regex", "name_groups", F.coalesce("flags", F.lit("")).alias("flags"))
    by_word = rules.groupBy("language", F.coalesce("keyword", F.lit("")).alias("k")).agg(F.collect_list(item).alias("items"))
    return by_word.groupBy(F.col("language").alias("_lang")).agg(
        F.map_from_entries(F.collect_list(F.struct("k", "items"))).alias("_rules"))


def _match_table(m: Column, rules: Column) -> Column:
    """First matching rule of a language's lookup per line: struct(kind, role, name, flags) or NULL.
    Only rules whose keyword stands before the line's first ``{``, ``=`` or ``;`` are tried, in rule order."""
    words = F.array_distinct(F.concat(F.array(F.lit("")),
                                      F.regexp_extract_all(F.regexp_extract(m, r"^[^{=;]*+", 0), F.lit(r"[\w$]+"), 0)))
    found = F.flatten(F.filter(F.transform(words, lambda k: rules[k]), lambda x: x.isNotNull()))
    hit = F.filter(F.array_sort(found), lambda r: F.regexp(m, r["regex"]))
    names = lambda r: F.filter(F.transform(
        F.coalesce(r["name_groups"], F.array().cast("array<int>")),
        lambda g: F.call_function("regexp_extract", m, r["regex"], g)), lambda n: n != "")
    return F.transform(F.slice(hit, 1, 1), lambda r: F.struct(
        r["kind"].alias("kind"), r["role"].alias("role"), F.get(names(r), F.lit(0)).alias("name"),
        r["flags"].alias("flags")))


def _brace_stats(m: Column) -> Column:
    """Per line: net change of ``{}`` depth and the lowest point reached
    inside the line (relative, <= 0)."""
    b = F.regexp_replace(m, r"[^{}]+", "")
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("lo"))
    fold = F.aggregate(F.filter(F.split(b, ""), lambda c: c != ""), init,
                       lambda s, c: F.struct((s["d"] + F.when(c == "{", 1).otherwise(-1)).alias("d"),
                                             F.least(s["lo"], s["d"] + F.when(c == "{", 1).otherwise(-1)).alias("lo")))
    return F.when(b == "", init).otherwise(fold)


def outline_partitions(spark) -> int:
    """Partitions for the outline's shuffle: ``markscope.outline.partitions``
    when set, else ``spark.sql.shuffle.partitions``."""
    explicit = spark.conf.get("markscope.outline.partitions", None)
    if explicit:
        return int(explicit)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def outline_lines(files: DataFrame, path_col: str = "path", lang_col: str = "language",
                  content_col: str = "content", rules: DataFrame | None = None) -> DataFrame:
    """One row per line with its masked text and layout facts. ``rules`` (RULE_TABLE) replace the
    built-in ones: a table of at most 200,000 rows is broadcast, a larger one joined by language."""
    f = files.select(F.col(path_col).alias("path"), F.col(lang_col).alias("language"),
                     F.col(content_col).alias("content"))
    # before the shuffle: a Python step would hide the partitioning from the windows after it
    f = f.withColumn("lexed", lexed_text(F.col("content"), F.col("language")))
    # The one shuffle of the outline: whole files, hashed by path.  Every
    # later window and grouping is keyed by path and reuses it.  The count is
    # explicit because the work per byte is high (regexes, windows): AQE would
    # otherwise merge a small input into one CPU-bound task.
    f = f.repartition(outline_partitions(files.sparkSession), "path")
    f = f.withColumn("masked", mask(F.col("content"), F.col("language"), F.col("lexed")))
    own = [] if rules is None else ["_rules"]
    if own:
        f = f.join(broadcast_if_small(_rule_lookup(rules)), F.col("language") == F.col("_lang"), "left")
    pairs = F.zip_with(split_lines("content"), split_lines("masked"),
                       lambda a, b: F.struct(a.alias("line"), b.alias("m")))
    ln = f.select("path", "language", F.col("content").endswith("\n").alias("has_eol"),
                  F.posexplode(pairs).alias("pos", "p"), *own)
    ln = ln.select("path", "language", "has_eol", *own, (F.col("pos") + 1).cast("bigint").alias("line_no"),
                   F.col("p.line").alias("line"), F.coalesce(F.col("p.m"), F.col("p.line")).alias("m"))
    bs = _brace_stats(F.col("m"))
    parens = (F.length(F.regexp_replace("m", r"[^(\[]+", "")) - F.length(F.regexp_replace("m", r"[^)\]]+", "")))
    # facts about the masked text are taken here so the masked text itself
    # is not carried through the shuffle and the window sorts
    m = F.col("m")
    return ln.select("path", "language", "has_eol", "line_no", "line",
                     F.instr(m, ";").alias("semi_at"), F.instr(m, "{").alias("brace_at"),
                     (m.rlike(r"^[\w:<>,*&\s]*+$") & m.rlike(r"\S") &
                      ~m.rlike(r"^\s*(?:public|private|protected)\s*:") & ~m.rlike(r"^\s*template\s*<"))
                     .alias("type_like"),
                     m.rlike(r"^\s*template\s*<").alias("template_like"),
                     F.regexp_extract(m, r"(\S)\s*$", 1).alias("end_char"),
                     F.length(F.regexp_extract("line", r"^[ \t]*", 0)).alias("indent"),
                     (F.trim("m") == "").alias("blank"),
                     ((F.trim("m") == "") & (F.trim("line") != "")).alias("comment_only"),
                     bs["d"].alias("net"), bs["lo"].alias("lo"), parens.alias("paren_net"),
                     (_match(F.col("m"), F.col("language")) if rules is None else
                      F.get(_match_table(F.col("m"), F.col("_rules")), F.lit(0))).alias("rule"))


def declarations(lines: DataFrame) -> DataFrame:
    """Per-line layout facts from windows over each file.

    All look-ahead facts come from one descending pass and all look-back
    facts from one ascending pass, so a file is sorted twice; every frame
    grows from one end, which keeps each window linear in the file size.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rev = Window.partitionBy("path").orderBy(F.col("line_no").desc())
    ahead_incl = rev.rowsBetween(Window.unboundedPreceding, 0)
    ahead = rev.rowsBetween(Window.unboundedPreceding, -1)
    # lines that start inside brackets continue another one: their indent says
    # nothing.  The depth before a line is the file's sum less that of the rest
    # (same order as the next pass, so no further sort).
    rest = F.sum("paren_net").over(ahead_incl)
    l0 = lines.withColumn("indented", ~F.col("blank") & (F.sum("paren_net").over(Window.partitionBy("path")) - rest <= 0))
    l1 = l0.select(
        "*",
        # next code line's indent, next line opening a block, next line with ';'
        F.last(F.when(F.col("indented"), F.col("indent")), ignorenulls=True).over(ahead).alias("next_indent"),
        F.min(F.when(F.col("net") - F.col("lo") > 0, F.col("line_no"))).over(ahead_incl).alias("next_open"),
        F.min(F.when(F.col("semi_at") > 0, F.col("line_no"))).over(ahead_incl).alias("next_semi"),
    )
    l2 = l1.select(
        "*",
        F.coalesce(F.sum("net").over(before), F.lit(0)).alias("depth"),
        F.coalesce(F.sum("paren_net").over(before), F.lit(0)).alias("pdepth"),
        F.coalesce(F.lag("type_like").over(w), F.lit(False)).alias("prev_type"),
        F.coalesce(F.lag("template_like").over(w), F.lit(False)).alias("prev_template"),
        F.last(F.when(~F.col("blank"), F.col("end_char")), ignorenulls=True).over(before).alias("prev_end"),
    )
    # Decorator runs.  A breaker is a code line that is neither a decorator
    # nor inside a decorator's parentheses; comment-only lines do not break.
    # first_deco = the first decorator after the last breaker above the line.
    is_deco = F.coalesce(F.col("rule.role") == "decorator", F.lit(False))
    member = is_deco | (F.col("pdepth") > 0) | F.col("comment_only")
    l2 = l2.withColumn("_is_deco", is_deco).withColumn("_breaker", ~member)
    l2 = l2.withColumn("_last_breaker", F.last(F.when(F.col("_breaker"), F.col("line_no")), ignorenulls=True).over(before)) \
           .withColumn("_prev_deco", F.last(F.when(F.col("_is_deco"), F.col("line_no")), ignorenulls=True).over(before))
    run_head = F.col("_is_deco") & (F.col("_prev_deco").isNull() |
                                    (F.col("_last_breaker").isNotNull() & (F.col("_prev_deco") < F.col("_last_breaker"))))
    l2 = l2.withColumn("_fd", F.last(F.when(run_head, F.col("line_no")), ignorenulls=True).over(upto))
    l2 = l2.withColumn("first_deco", F.when(F.col("_fd").isNotNull() &
                                            (F.col("_last_breaker").isNull() | (F.col("_fd") > F.col("_last_breaker"))),
                                            F.col("_fd")))
    # indentation languages: the indents at which blocks open in this file
    l2 = l2.withColumn("kset", F.collect_set(F.when(F.col("indented") & (F.col("next_indent") > F.col("indent")),
                                                    F.col("indent"))).over(Window.partitionBy("path")))
    return l2.drop("_is_deco", "_breaker", "_last_breaker", "_prev_deco", "_fd")


_EVENT = ("struct<key:int,tag:int,pos:bigint,o_line:bigint,o_indent:int,o_name:string,o_scope:boolean,"
          "text:string>")


def symbols(files: DataFrame, path_col: str = "path", lang_col: str = "language",
            content_col: str = "content", keep_all: bool = False, rules: DataFrame | None = None) -> DataFrame:
    """Declarations with scope paths, by the built-in rules or a table of ``rules``.

    Columns: ``path, language, start, header, kind, role, name, level,
    scope ARRAY<STRING>, scope_path STRING``.  ``start`` is the first line of
    the decorators above a declaration (W2).  Only declarations the
    reference walks are returned (``keep_all=True`` also returns the others
    with ``level = NULL``).
    """
    l2 = declarations(outline_lines(files, path_col, lang_col, content_col, rules))
    return symbols_from(l2, keep_all)


def symbols_from(l2: DataFrame, keep_all: bool = False) -> DataFrame:
    """``symbols`` over the output of ``declarations``."""
    out = symbol_groups(l2).where(F.col("tag") == 0)
    if not keep_all:
        out = out.where("ok")
    return out.select("path", "language", "start", "header", "kind", "role", "name", "level", "scope",
                      F.array_join("scope", " > ").alias("scope_path"))


def symbol_groups(l2: DataFrame, with_lines: bool = False) -> DataFrame:
    """One pass over a file set's lines: every line emits "opener" events
    (the levels it leaves open, with the declaration owning that block),
    every declaration emits "lookup" events (the levels it must be nested
    in); a window per (path, level) hands each lookup the last opener before
    it, and one grouping per declaration assembles the scope path.

    With ``with_lines`` every source line also passes through as its own
    group (``tag = 2``, its text in ``text``), so annotation needs no second
    read of the input.  Declaration groups have ``tag = 0``.
    """
    brace = F.col("language").isin(BRACE_LANGS)
    w = Window.partitionBy("path").orderBy("line_no")
    # --- declaration facts on their own line --------------------------------
    role0 = F.col("rule.role")
    is_decl = F.col("rule").isNotNull() & (role0 != "decorator") & (F.col("pdepth") <= 0)
    flags = F.coalesce(F.col("rule.flags"), F.lit(""))
    has_body_brace = F.col("next_open").isNotNull() & (
        F.col("next_semi").isNull() | (F.col("next_open") < F.col("next_semi")) |
        ((F.col("next_open") == F.col("next_semi")) & (F.col("brace_at") < F.col("semi_at"))))
    # a block that closes on the line it opens on
    closed = (F.col("brace_at") > 0) & (F.col("net") <= F.col("lo")) & F.col("end_char").isin("}", ";", ",") & (
        (F.col("semi_at") == 0) | (F.col("brace_at") < F.col("semi_at")))
    opener = F.when(brace, F.when(closed, F.col("line_no")).when(has_body_brace, F.col("next_open"))) \
              .otherwise(F.when(F.col("next_indent") > F.col("indent"), F.col("line_no")))
    start = F.when(role0 == "ignorable", F.col("line_no")).otherwise(F.coalesce(F.col("first_deco"), F.col("line_no")))
    cpp_fn = (F.col("language") == "cpp") & (F.col("rule.kind") == "function_definition")
    # C++: a function whose return type sits alone on the line above starts there
    type_line = F.col("prev_type")
    # C++ templates are not declarations the reference lists
    template = (F.col("language") == "cpp") & F.col("prev_template")
    # a top-level statement starts a line only after a finished one
    toplevel_ok = ~flags.contains("toplevel") | (
        (F.col("depth") == 0) & (F.col("lo") == 0) &
        (F.col("prev_end").isNull() | F.col("prev_end").isin(";", "}", ")")))
    d = l2.withColumn("d_ok", is_decl & ~(flags.contains("body") & opener.isNull()) & ~template & toplevel_ok) \
          .withColumn("opener", opener) \
          .withColumn("start", F.when(cpp_fn & type_line & (start == F.col("line_no")), F.col("line_no") - 1)
                      .otherwise(start))
    # Python: a decorated class or function is one decorated_definition, not walked into
    decorated = (F.col("language") == "python") & (F.col("start") < F.col("line_no"))
    d = d.withColumn("kind", F.when(decorated, F.lit("decorated_definition")).otherwise(F.col("rule.kind"))) \
         .withColumn("role", F.when(decorated, F.lit("decl")).otherwise(role0)) \
         .withColumn("name", F.coalesce(F.nullif(F.col("rule.name"), F.lit("")), F.lit("anonymous")))
    # --- the declaration owning the block a line opens -----------------------
    own = F.when(F.col("d_ok") & F.col("opener").isNotNull(),
                 F.struct(F.col("opener").alias("at"), F.col("name").alias("n"),
                          (F.col("role") == "scope").alias("scope")))
    d = d.withColumn("_pend", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.col("_pend.at") == F.col("line_no")
    # --- events --------------------------------------------------------------
    brace_keys = F.when(F.col("net") - F.col("lo") > 0,
                        F.sequence(F.col("depth") + F.col("lo"), F.col("depth") + F.col("net") - 1))
    indent_keys = F.when(F.col("indented") & (F.col("next_indent") > F.col("indent")),
                         F.filter("kset", lambda k: k >= F.col("indent")))
    okeys = F.coalesce(F.when(brace, brace_keys).otherwise(indent_keys), F.array().cast("array<int>"))
    open_ev = F.transform(okeys, lambda k: F.struct(
        k.alias("key"), F.lit(1).alias("tag"), F.col("line_no").alias("pos"), F.col("line_no").alias("o_line"),
        F.col("indent").alias("o_indent"), F.when(here, F.col("_pend.n")).alias("o_name"),
        F.when(here, F.col("_pend.scope")).alias("o_scope"), F.lit(None).cast("string").alias("text")).cast(_EVENT))
    lkeys = F.when(brace, F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1))) \
             .otherwise(F.filter(F.coalesce(F.col("kset"), F.array().cast("array<int>")),
                                 lambda k: k < F.col("indent")))
    lkeys = F.when(F.size(F.coalesce(lkeys, F.array().cast("array<int>"))) > 0, lkeys) \
             .otherwise(F.array(F.lit(None).cast("int")))
    # at equal positions a lookup comes first: a line never encloses itself
    look_ev = F.when(F.col("d_ok"), F.transform(lkeys, lambda k: F.struct(
        k.alias("key"), F.lit(0).alias("tag"), F.col("start").alias("pos"), F.lit(None).cast("bigint").alias("o_line"),
        F.lit(None).cast("int").alias("o_indent"), F.lit(None).cast("string").alias("o_name"),
        F.lit(None).cast("boolean").alias("o_scope"), F.lit(None).cast("string").alias("text")).cast(_EVENT))
                        ).otherwise(F.array().cast(f"array<{_EVENT}>"))
    src_ev = F.array(F.struct(
        F.lit(None).cast("int").alias("key"), F.lit(2).alias("tag"), F.col("line_no").alias("pos"),
        F.lit(None).cast("bigint").alias("o_line"), F.lit(None).cast("int").alias("o_indent"),
        F.lit(None).cast("string").alias("o_name"), F.lit(None).cast("boolean").alias("o_scope"),
        F.col("line").alias("text")).cast(_EVENT))
    events = F.concat(open_ev, look_ev, src_ev) if with_lines else F.concat(open_ev, look_ev)
    dcols = ["language", "has_eol", "start", "kind", "role", "name", "flags", "net", "opener"]
    ev = d.withColumn("flags", flags).select(
        "path", F.col("line_no").alias("header"), *dcols, F.explode(events).alias("e"))
    ev = ev.select("path", "header", *dcols, "e.*")
    wk = Window.partitionBy("path", "key").orderBy("pos", "tag").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("enc", F.last(F.when(F.col("tag") == 1, F.struct("o_line", "o_indent", "o_name", "o_scope")),
                                     ignorenulls=True).over(wk))
    look = ev.where(F.col("tag") != 1)
    # indentation: a block at level k exists only if its opener sits at indent k
    counts = F.col("key").isNotNull() & (F.col("language").isin(BRACE_LANGS) | (F.col("enc.o_indent") == F.col("key")))
    anc_item = F.when(counts, F.struct(F.col("enc.o_line").alias("o_line"), F.col("enc.o_name").alias("n"),
                                       F.coalesce(F.col("enc.o_scope"), F.lit(False)).alias("ok")))
    out = look.groupBy("path", "header", "tag").agg(*[F.first(c).alias(c) for c in dcols],
                                                    F.array_sort(F.collect_list(anc_item)).alias("anc"),
                                                    F.first("text").alias("text"))
    valid = F.forall("anc", lambda a: a["ok"])
    # methods must sit directly in a scope body (not at the root)
    member_ok = ~F.col("flags").contains("member") | (F.size("anc") > 0)
    out = out.withColumn("ok", valid & member_ok)
    scope = F.concat(F.transform("anc", lambda a: a["n"]), F.array(F.col("name")))
    # Rust: a module whose block ends on its first line gets no comment
    oneline = F.col("flags").contains("oneline_ignorable") & (
        F.col("opener").isNull() | ((F.col("opener") == F.col("header")) & (F.col("net") <= 0)))
    return out.select("path", "header", "tag", "language", "has_eol", "start", "kind",
                      F.when(oneline, F.lit("ignorable")).otherwise(F.col("role")).alias("role"), "name", "ok",
                      F.when(F.col("ok"), F.size("anc")).cast("bigint").alias("level"), scope.alias("scope"), "text")


def comment_text(language: Column, level: Column, scope: Column) -> Column:
    """Indent unit x level, the TODO prefix, a space, the scope path."""
    return F.concat(F.repeat(indent_unit_of(language), level.cast("int")), comment_prefix_of(language),
                    F.lit(" "), F.array_join(scope, " > "))
