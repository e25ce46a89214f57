"""

Each takes ``(spark, sf_dir)`` and returns a DataFrame with flat columns
(BIGINT / STRING / BOOLEAN).  Offset arrays are rendered as comma-joined
strings so that the oracle comparison does not depend on array encodings.
Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.functions import positions as P
from markscope.functions.paths import base_name, directory, extension, last_two, relative_display
from markscope.functions.text import highlight, trim_start
from markscope.operators import report as R
from markscope.operators.grep import SearchOptions, grep, grep_documents, pattern_tokens
from markscope.sources import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The parameters of the registered queries (shared with the
# oracle SQL in oracle.py).
LIT = "[TODO]"
LIT_CI = "THE"
MULTI = ["the", "and", "ion"]
MULTI_CI = ["The", "AND", "Ión"]
MULTI_AC = ["th", "the", "he", "e t"]
REGEX = "[A-Z][a-z]+ion"
REGEX_CI = "th[a-z]+n"
REGEX_POS = "[0-9]+"
POS_LIT = "en"
POS_OVERLAP = "ee"
POS_FIRST = "ion"
POS_CI = "ÉE"
NEXT_START = 2
NEXT_CHAR = "e"


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _pos(c="position"):
    return F.array_join(F.col(c), ",").alias("pos")


def _marked_grep(spark, sf, patterns=None, options=SearchOptions()):
    docs = TB.marked_documents(spark, sf).withColumnRenamed("content", "text")
    return grep_documents(docs, patterns, options, keep=["doc_id", "path"])


def _lines_grep(spark, sf, patterns, options=SearchOptions()):
    docs = TB.table(spark, sf, "documents").select("doc_id", "text")
    return grep_documents(docs, patterns, options, keep=["doc_id"])


# --- S2 / W5 ---------------------------------------------------------------
@query("lines_explode")
def q_lines_explode(spark, sf):
    return TB.lines(spark, sf)


# --- F7-F15 -------------------------------------------------------------------
@query("grep_literal")
def q_grep_literal(spark, sf):
    return _marked_grep(spark, sf, [LIT]).select("doc_id", "line_no", _pos())


@query("grep_literal_ci")
def q_grep_literal_ci(spark, sf):
    return _lines_grep(spark, sf, [LIT_CI], SearchOptions(ignore_case=True)).select("doc_id", "line_no", _pos())


@query("grep_multi")
def q_grep_multi(spark, sf):
    return _lines_grep(spark, sf, MULTI).select("doc_id", "line_no", _pos())


@query("grep_multi_ci")
def q_grep_multi_ci(spark, sf):
    return _lines_grep(spark, sf, MULTI_CI, SearchOptions(ignore_case=True)).select("doc_id", "line_no", _pos())


@query("grep_pattern_table")
def q_grep_pattern_table(spark, sf):
    """The words of part names and those of the benchmark's items as a table of patterns."""
    from markscope.operators.pattern_table import grep_pattern_table
    words = TB.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("pattern")).unionByName(
        TB.table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("pattern"))
        .where("length(pattern) > 5"))
    g = grep_pattern_table(TB.lines(spark, sf), words, ["doc_id", "line_no"])
    return g.select("doc_id", "line_no", _pos())


@query("grep_regex_ci")
def q_grep_regex_ci(spark, sf):
    return _lines_grep(spark, sf, [REGEX_CI], SearchOptions(ignore_case=True, regex=True)) \
        .select("doc_id", "line_no", _pos())


@query("grep_regex")
def q_grep_regex(spark, sf):
    return _lines_grep(spark, sf, [REGEX], SearchOptions(regex=True)).select("doc_id", "line_no", _pos())


@query("grep_default")
def q_grep_default(spark, sf):
    return _marked_grep(spark, sf, None).select("doc_id", "line_no", _pos())


@query("grep_none")
def q_grep_none(spark, sf):
    return _marked_grep(spark, sf, []).select("doc_id", "line_no", _pos())


@query("pattern_tokens")
def q_pattern_tokens(spark, sf):
    bench = TB.table(spark, sf, "benchmark").select("item_id", "text")
    return pattern_tokens(bench, "text").select("item_id", "token_no", "pattern")


# --- P1-P7 ----------------------------------------------------------------------
@query("pos_literal")
def q_pos_literal(spark, sf):
    return _lines_grep(spark, sf, [POS_LIT]).select("doc_id", "line_no", _pos())


@query("pos_overlap")
def q_pos_overlap(spark, sf):
    return _lines_grep(spark, sf, [POS_OVERLAP], SearchOptions(overlapping=True)) \
        .select("doc_id", "line_no", _pos())


@query("pos_first")
def q_pos_first(spark, sf):
    return TB.lines(spark, sf).select("doc_id", "line_no", P.first_position("line", POS_FIRST).alias("first_pos"))


@query("pos_multi")
def q_pos_multi(spark, sf):
    return _lines_grep(spark, sf, MULTI_AC).select("doc_id", "line_no", _pos())


@query("pos_regex")
def q_pos_regex(spark, sf):
    return _lines_grep(spark, sf, [REGEX_POS], SearchOptions(regex=True)).select("doc_id", "line_no", _pos())


@query("next_char_dist")
def q_next_char_dist(spark, sf):
    return TB.lines(spark, sf).select("doc_id", "line_no",
                                      P.next_char_distance("line", NEXT_START, NEXT_CHAR).cast("bigint").alias("dist"))


@query("pos_literal_ci")
def q_pos_literal_ci(spark, sf):
    return _lines_grep(spark, sf, [POS_CI], SearchOptions(ignore_case=True)).select("doc_id", "line_no", _pos())


# --- X8, X10 ----------------------------------------------------------------------
@query("trim_line")
def q_trim_line(spark, sf):
    return TB.lines(spark, sf).select("doc_id", "line_no", trim_start("line").alias("trimmed"))


@query("highlight")
def q_highlight(spark, sf):
    g = _marked_grep(spark, sf, None)
    return g.select("doc_id", "line_no", highlight("line", ["[TODO]", "[DONE]"]).alias("text"))


# --- A1-A4 / S7-S9 ------------------------------------------------------------------
@query("count_total")
def q_count_total(spark, sf):
    return R.count_total(_marked_grep(spark, sf, None))


@query("count_per_file")
def q_count_per_file(spark, sf):
    return R.count_per_file(_marked_grep(spark, sf, None))


@query("files_with_matches")
def q_files_with_matches(spark, sf):
    return R.files_with_matches(_marked_grep(spark, sf, None))


def _items_text(items):
    return F.array_join(F.transform(items, lambda x: F.concat(x["line"].cast("string"), F.lit(":"),
                                                                F.array_join(x["position"], ","))), ";")


@query("report_nested")
def q_report_nested(spark, sf):
    rep = R.nested_report(_marked_grep(spark, sf, None))
    return rep.select("directory", "name", F.size("items").cast("bigint").alias("n_items"),
                      _items_text(F.col("items")).alias("items"))


@query("report_json")
def q_report_json(spark, sf):
    rep = R.nested_report(_marked_grep(spark, sf, None))
    back = R.report_from_json(R.report_to_json(rep))
    return back.select("directory", "name", F.explode("items").alias("it")).select(
        "directory", "name", F.col("it.line").alias("line"), F.col("it.content").alias("content"),
        F.array_join("it.position", ",").alias("pos"))


@query("report_plain")
def q_report_plain(spark, sf):
    return R.plain_report_rows(_marked_grep(spark, sf, None))


@query("report_tree")
def q_report_tree(spark, sf):
    return R.tree_report_rows(_marked_grep(spark, sf, None))


@query("todo_progress")
def q_todo_progress(spark, sf):
    g = _marked_grep(spark, sf, None)
    marker = F.when(F.col("line").contains("[TODO]"), "todo").otherwise("done")
    return (g.groupBy(directory("path").alias("directory"))
            .agg(F.sum(F.when(marker == "todo", 1).otherwise(0)).cast("bigint").alias("todo"),
                 F.sum(F.when(marker == "done", 1).otherwise(0)).cast("bigint").alias("done")))


# --- X1-X4 -------------------------------------------------------------------------
@query("path_parts")
def q_path_parts(spark, sf):
    c = TB.corpus(spark, sf)
    return c.select("doc_id", "path", directory("path").alias("directory"),
                    base_name("path").alias("file_name"), extension("path").alias("ext"))


@query("path_last_two")
def q_path_last_two(spark, sf):
    c = TB.corpus(spark, sf)
    t = last_two("path")
    return c.select("doc_id", t[0].alias("last"), t[1].alias("second"))


@query("path_relative")
def q_path_relative(spark, sf):
    c = TB.corpus(spark, sf)
    deep = F.concat(F.lit("/home/user/work/"), F.col("path"))
    return c.select("doc_id", relative_display(directory("path"), "path").alias("rel"),
                    relative_display(directory(deep), deep).alias("rel_deep"))


# --- X5, X6, J1, S10, F1-F6, S3-S5, J5 ---------------------------------------------------
from markscope.functions.points import is_after, is_before, is_member_of, point  # noqa: E402
from markscope.operators import lang as L  # noqa: E402
from markscope.operators import select as S  # noqa: E402
from markscope.operators.gitignore import drop_gitignored, rules_frame  # noqa: E402
from markscope.operators.lines import split_strict_utf8  # noqa: E402
from markscope.operators.overlay import overlay  # noqa: E402
from markscope.operators.project import marker_dirs, project_roots  # noqa: E402
from markscope.operators.suggest import suggest  # noqa: E402

# Query parameters for selection.
GITIGNORE = [("root", "*.json"), ("root", "!doc_1*.json"), ("root", "/src2/"), ("root", "*.m?"),
             ("root", "!test_*"), ("root", "src3/**/*.go")]
ONLY = ["python", "rust", "md"]
GLOB = "root/src1*/*.py"
ONE_PATH = "root/src3/doc_3.cpp"


def _files(spark, sf):
    return TB.corpus(spark, sf).select("doc_id", "path")


@query("lang_detect")
def q_lang_detect(spark, sf):
    return L.detect_language(_files(spark, sf)).select("doc_id", "ext", "language", "comment_prefix", "supported")


@query("dim_lookup")
def q_dim_lookup(spark, sf):
    dim = F.broadcast(L.dim_extension_language(spark))
    f = _files(spark, sf).withColumn("ext", extension("path"))
    return f.join(dim, "ext").select("doc_id", "language", "comment_prefix", "indent_unit", "root_kind",
                                     "decorator_kind", "comment_kind")


@query("filter_ext")
def q_filter_ext(spark, sf):
    return S.drop_ignored_extensions(_files(spark, sf))


@query("filter_hidden")
def q_filter_hidden(spark, sf):
    return S.drop_hidden(_files(spark, sf))


@query("filter_gitignore")
def q_filter_gitignore(spark, sf):
    return drop_gitignored(_files(spark, sf), rules_frame(spark, GITIGNORE))


@query("filter_test_path")
def q_filter_test_path(spark, sf):
    return S.drop_test_paths(_files(spark, sf))


@query("filter_language")
def q_filter_language(spark, sf):
    return L.supported_only(_files(spark, sf)).select("doc_id", "path", "language")


@query("select_only")
def q_select_only(spark, sf):
    f = L.detect_language(_files(spark, sf)).select("doc_id", "language")
    return S.select_names(f, ONLY, "language", only=True)


@query("select_except")
def q_select_except(spark, sf):
    f = L.detect_language(_files(spark, sf)).select("doc_id", "language")
    return S.select_names(f, ONLY, "language", only=False)


@query("path_glob")
def q_path_glob(spark, sf):
    return S.select_glob(_files(spark, sf), GLOB)


@query("path_eq")
def q_path_eq(spark, sf):
    return S.select_path(_files(spark, sf), ONE_PATH)


@query("strict_utf8_split")
def q_strict_utf8_split(spark, sf):
    files = TB.corpus(spark, sf).select("doc_id", F.col("content").cast("binary").alias("content"))
    good, bad = split_strict_utf8(files)
    return good.select("doc_id", F.lit(True).alias("valid"), "has_eol") \
               .unionByName(bad.select("doc_id", F.lit(False).alias("valid"), F.lit(None).cast("boolean").alias("has_eol")))


@query("project_root")
def q_project_root(spark, sf):
    f = _files(spark, sf)
    return project_roots(f, marker_dirs(f, hidden_names=True)).select("doc_id", "path", "root")


# --- J3, J4, A6, X12 ---------------------------------------------------------------------
@query("fuzzy_suggest")
def q_fuzzy_suggest(spark, sf):
    words = TB.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", suggest("word").alias("suggestion"))


@query("overlay_merge")
def q_overlay_merge(spark, sf):
    nat = TB.table(spark, sf, "nation")
    sup = TB.table(spark, sf, "supplier")
    base = nat.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region_key"),
                      F.lit(None).cast("bigint").alias("supplier_count"), F.lit("base").alias("source"),
                      F.struct(F.lit(4).alias("width"), F.lit("    ").alias("unit")).alias("indent"),
                      F.col("n_nationkey").cast("bigint").alias("ord"))
    k = (F.col("s_nationkey") + 20).cast("bigint")
    user = sup.groupBy(k.alias("k")).agg(F.count(F.lit(1)).cast("bigint").alias("supplier_count")).select(
        F.concat(F.lit("NATION_"), F.col("k").cast("string")).alias("name"),
        F.lit(None).cast("bigint").alias("region_key"), "supplier_count", F.lit("user").alias("source"),
        F.struct(F.lit(2).alias("width"), F.lit(None).cast("string").alias("unit")).alias("indent"),
        F.col("k").alias("ord"))
    m = overlay(base, user)
    return m.select("name", "region_key", "supplier_count", "source", F.col("indent.width").cast("bigint").alias("indent_width"),
                    F.col("indent.unit").alias("indent_unit"), F.col("ord_group").cast("bigint").alias("ord_group"),
                    F.col("ord").cast("bigint").alias("ord"))


@query("fuzzy_vocabulary")
def q_fuzzy_vocabulary(spark, sf):
    """Words of the documents' first lines against the words of part names as a vocabulary table."""
    from markscope.operators.suggest import suggest_terms
    vocab = TB.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    first = TB.lines(spark, sf).where("line_no = 1")
    words = first.select(F.explode(F.split(F.lower("line"), "[^a-z]+")).alias("word")).where("length(word) > 2")
    return suggest_terms(words, vocab, max_distance=2)


def _layer_texts(spark, sf):
    """Two settings files as text: a record per nation, and one per nation with suppliers."""
    nat, sup = TB.table(spark, sf, "nation"), TB.table(spark, sf, "supplier")
    base = nat.select(F.lit("base").alias("path"), F.col("n_nationkey").alias("k"), F.concat_ws(
        "\n", F.lit("[[language]]"), F.format_string('name = "%s" # a name', "n_name"),
        F.format_string("region = %d", F.col("n_regionkey").cast("long")),
        F.format_string('file-types = ["x%d", \'y\']', F.col("n_nationkey").cast("long")), F.lit("auto = true")).alias("t"))
    user = sup.groupBy("s_nationkey").count().join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit("user").alias("path"), F.col("n_nationkey").alias("k"), F.concat_ws(
            "\n", F.lit("[[grammar]]"), F.lit('name = "none"'), F.lit("[[language]]"), F.format_string("name = '%s'", "n_name"),
            F.format_string("suppliers = %d", "count"), F.lit("auto = false")).alias("t"))
    both = base.unionByName(user)
    return both.groupBy("path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


@query("config_layers")
def q_config_layers(spark, sf):
    """Two loaded layers, merged, without some names."""
    from markscope.operators.overlay import overlay_all
    from markscope.operators.sections import load_sections
    from markscope.operators.select import select_names
    rows = load_sections(_layer_texts(spark, sf), "language", {
        "name": "string", "region": "bigint", "file-types": "array<string>", "auto": "boolean", "suppliers": "bigint"})
    merged = overlay_all([rows.where(F.col("path") == p).drop("path") for p in ("base", "user")])
    kept = select_names(merged, ["NATION_1", "NATION_2"], "name", only=False)
    return kept.select("name", "region", F.array_join("file-types", "|").alias("file_types"), "auto", "suppliers",
                       F.array_join(F.transform("ord_path", lambda x: x.cast("string")), ",").alias("ord_path"))


@query("scannable_rules")
def q_scannable_rules(spark, sf):
    f = L.detect_language(_files(spark, sf))
    rules = F.broadcast(L.scannable_rules(spark))
    return f.join(rules, "language").groupBy("language", "kind", "is_ignorable", "is_scope") \
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))


@query("point_in_range")
def q_point_in_range(spark, sf):
    g = _marked_grep(spark, sf, [LIT])
    p = point("line_no", F.element_at("position", 1))
    start = point(F.lit(10).cast("bigint"), F.lit(5).cast("bigint"))
    end = point(F.lit(20).cast("bigint"), F.lit(40).cast("bigint"))
    return g.select("doc_id", "line_no", F.element_at("position", 1).alias("col"),
                    is_before(p, start).alias("before"), is_after(p, end).alias("after"),
                    is_member_of(p, start, end).alias("member"))


# --- T1-T7, X7, X11, W2-W4, O3, S6 (generated code corpus) --------------------------------
from markscope.operators import annotate as A  # noqa: E402
from markscope.operators.outline import comment_text, symbols  # noqa: E402
from markscope.operators.gitignore import rules_frame as _rules  # noqa: E402

# Selection parameters of the corpus-level annotation queries.
CODE_GLOB = "code/AFRICA/*.py"
CODE_RULES = [("code", "vendor/")]


def _code(spark, sf):
    return TB.code_files(spark, sf)


@query("symbol_decls")
def q_symbol_decls(spark, sf):
    return symbols(_code(spark, sf)).select("path", "start", "header", "kind", "name")


@query("symbol_names")
def q_symbol_names(spark, sf):
    s = symbols(_code(spark, sf), keep_all=True)
    return s.select("path", "header", "kind", "name", F.col("level").isNotNull().alias("walked"))


@query("symbol_scope")
def q_symbol_scope(spark, sf):
    return symbols(_code(spark, sf)).select("path", "header", "level", "scope_path")


@query("symbol_ignorable")
def q_symbol_ignorable(spark, sf):
    return symbols(_code(spark, sf)).where(F.col("role") == "ignorable").select("path", "header", "kind")


@query("decorator_anchor")
def q_decorator_anchor(spark, sf):
    s = symbols(_code(spark, sf))
    return s.where(F.col("start") < F.col("header")).select("path", "header", F.col("start").alias("anchor"))


@query("comment_line")
def q_comment_line(spark, sf):
    s = symbols(_code(spark, sf)).where(F.col("role").isin("decl", "scope"))
    return s.select("path", "start", comment_text(F.col("language"), F.col("level"), F.col("scope")).alias("comment"))


@query("annotate_lines")
def q_annotate_lines(spark, sf):
    return A.annotate_lines(_code(spark, sf)).select("path", "ord", "line", "is_comment")


@query("annotate_idempotent")
def q_annotate_idempotent(spark, sf):
    once = A.annotate_files(_code(spark, sf))
    once = once.withColumn("language", F.when(F.col("path").endswith(".rs"), "rust").otherwise("python"))
    return A.annotate_lines(once).select("path", "ord", "line")


@query("collapse_comments")
def q_collapse_comments(spark, sf):
    ann = A.annotate_lines(_code(spark, sf))
    doubled = ann.select("path", "language", (F.col("ord") * 2).alias("line_no"), "line").unionByName(
        ann.where("is_comment").select("path", "language", (F.col("ord") * 2 + 1).alias("line_no"), "line"))
    return A.collapse_comments(doubled).select("path", "line_no", "line")


@query("annotate_files")
def q_annotate_files(spark, sf):
    return A.annotate_files(_code(spark, sf))


# A rule table of the user's own for the code corpus.
OWN_RULES = [
    ("python", 0, "class", "type", "scope", r"^\s*class\s+(\w+)", [1], ""),
    ("python", 1, "def", "callable", "decl", r"^\s*def\s+(\w+)", [1], ""),
    ("rust", 5, None, "anything", "decl", r"^\s*(?:pub\s+)?(struct|static)\s", [1], ""),
    ("rust", 1, "mod", "space", "scope", r"^\s*mod\s+(\w+)", [1], ""),
    ("rust", 2, "struct", "record", "decl", r"^\s*(?:pub\s+)?struct\s+(\w+)", [1], ""),
    ("rust", 3, "use", "import", "ignorable", r"^\s*use\s", [], ""),
]


@query("symbol_rules")
def q_symbol_rules(spark, sf):
    from markscope.operators.outline import RULE_TABLE
    s = symbols(_code(spark, sf), rules=spark.createDataFrame(OWN_RULES, RULE_TABLE))
    return s.select("path", "start", "kind", "role", "name", "level", "scope_path")


@query("symbol_languages")
def q_symbol_languages(spark, sf):
    s = symbols(TB.code_files(spark, sf, TB.LITERAL_TEMPLATES))
    return s.select("path", "start", "header", "kind", "name", "role", "level", "scope_path")


@query("annotate_languages")
def q_annotate_languages(spark, sf):
    return A.annotate_lines(TB.code_files(spark, sf, TB.LITERAL_TEMPLATES)).select("path", "ord", "line", "is_comment")


def _code_corpus_with_noise(spark, sf):
    """The code files plus copies the selection must drop: hidden, test,
    ignored extension, unsupported language, gitignored folder."""
    c = _code(spark, sf).select("path", "content")
    copies = F.array(F.col("path"),
                     F.regexp_replace("path", "^code/", "code/.cache/"),
                     F.regexp_replace("path", "^code/", "code/tests/"),
                     F.concat(F.col("path"), F.lit(".orig")),
                     F.concat(F.col("path"), F.lit("x")),
                     F.regexp_replace("path", "^code/", "code/vendor/"))
    return c.select(F.explode(copies).alias("path"), "content")


@query("annotate_corpus")
def q_annotate_corpus(spark, sf):
    return A.annotate_corpus(_code_corpus_with_noise(spark, sf), _rules(spark, CODE_RULES), root="code")


@query("annotate_glob")
def q_annotate_glob(spark, sf):
    return A.annotate_glob(_code_corpus_with_noise(spark, sf), CODE_GLOB)


# --- the same operators over the other text tables ---------------------------------------
# Patterns for the conversation corpus.
CONV_PATTERNS = ["tion", "ment", "the"]


@query("grep_conversations")
def q_grep_conversations(spark, sf):
    conv = TB.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    g = grep_documents(conv, CONV_PATTERNS, keep=["conv_id", "turn", "role"])
    return g.select("conv_id", "turn", "role", "line_no", _pos())


@query("url_parts")
def q_url_parts(spark, sf):
    pages = TB.table(spark, sf, "pages").select("page_id", "url")
    p = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("url_path"))
    return p.select("page_id", "url_path", directory("url_path").alias("directory"),
                    base_name("url_path").alias("file_name"), extension("url_path").alias("ext"),
                    last_two("url_path")[1].alias("second"))
