"""DuckDB SQL oracles, one per registered query (same keys, same column names).

Each string is self-contained: the views of FIXTURES.md are inlined as CTEs
over the pre-registered tables.  Offsets are computed by brute force where
that is simpler than the Spark plan (e.g. overlapping matches by testing
every position), so the two sides share no algorithm.
"""

from __future__ import annotations

from markscope.plans import queries as Q
from markscope.sources import tables as TB
from markscope.sources.tables import CORPUS_PATH_SQL, MARKED_LINE_SQL

ORACLE_SQL: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _n(s: str) -> int:
    return len(s.encode("utf-8"))


VIEWS = f"""
corpus AS (SELECT doc_id, {CORPUS_PATH_SQL} AS path, text AS content FROM documents),
lines0 AS (SELECT doc_id, len(parts) AS n, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
lines AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no, line FROM lines0 WHERE NOT (i = n AND line = '')),
marked AS (SELECT doc_id, line_no, {MARKED_LINE_SQL} AS line FROM lines),
mfiles AS (SELECT m.doc_id, c.path, m.line_no, m.line FROM marked m JOIN corpus c USING (doc_id)),
dflt AS (SELECT * FROM mfiles WHERE contains(line, '[TODO]') OR contains(line, '[DONE]'))
"""


def sql(name: str, body: str, extra_ctes: str = "") -> None:
    ORACLE_SQL[name] = "WITH " + VIEWS + ("," + extra_ctes if extra_ctes else "") + "\n" + body


def lit_pos(line: str, p: str) -> str:
    """Non-overlapping literal offsets (bytes) as a comma-joined string."""
    parts = f"string_split({line}, {_q(p)})"
    return (f"array_to_string(list_transform(range(1, len({parts})), lambda k: "
            f"list_sum(list_transform({parts}[1:k], lambda x: strlen(x))) + (k - 1) * {_n(p)}), ',')")


def overlap_list(line: str, p: str) -> str:
    """Every occurrence (bytes), by testing each character position."""
    nc = len(p)
    return (f"list_transform(list_filter(range(0, length({line})), lambda i: substr({line}, i + 1, {nc}) = {_q(p)}),"
            f" lambda i: CAST(strlen(substr({line}, 1, i)) AS BIGINT))")


def multi_pos(line: str, pats: list[str]) -> str:
    """Standard Aho-Corasick semantics by brute force: all occurrences,
    ordered by (end, -length), greedy non-overlapping fold."""
    occ = [f"list_transform({overlap_list(line, p)}, lambda s: {{'e': s + {_n(p)}, 'nn': {-_n(p)}, 's': s}})"
           for p in sorted(set(pats))]
    allocc = occ[0] if len(occ) == 1 else "list_concat(" + ", ".join(occ) + ")"
    fold = (f"list_reduce(list_sort({allocc}), lambda acc, x: CASE WHEN x.s >= acc.last "
            f"THEN {{'last': x.e, 'a': list_append(acc.a, x.s)}} ELSE acc END, "
            f"{{'last': CAST(0 AS BIGINT), 'a': CAST([] AS BIGINT[])}})")
    return f"array_to_string(({fold}).a, ',')"


def regex_pos(line: str, rx: str) -> str:
    parts = f"regexp_split_to_array({line}, {_q(rx)})"
    ms = f"regexp_extract_all({line}, {_q(rx)})"
    return (f"array_to_string(list_transform(range(1, len({ms}) + 1), lambda k: "
            f"list_sum(list_transform({parts}[1:k], lambda x: strlen(x))) + "
            f"coalesce(list_sum(list_transform({ms}[1:k - 1], lambda x: strlen(x))), 0)), ',')")


# --- S2 ---------------------------------------------------------------------
sql("lines_explode", "SELECT doc_id, line_no, line FROM lines")

# --- F7-F15 ---------------------------------------------------------------
sql("grep_literal", f"SELECT doc_id, line_no, {lit_pos('line', Q.LIT)} AS pos FROM marked "
                    f"WHERE contains(line, {_q(Q.LIT)})")
sql("grep_literal_ci", f"SELECT doc_id, line_no, {lit_pos('lower(line)', Q.LIT_CI.lower())} AS pos FROM lines "
                       f"WHERE contains(lower(line), {_q(Q.LIT_CI.lower())})")
sql("grep_multi", f"SELECT doc_id, line_no, {multi_pos('line', Q.MULTI)} AS pos FROM lines WHERE "
                  + " OR ".join(f"contains(line, {_q(p)})" for p in Q.MULTI))
sql("grep_multi_ci", f"SELECT doc_id, line_no, {multi_pos('lower(line)', [p.lower() for p in Q.MULTI_CI])} AS pos "
                     "FROM lines WHERE " + " OR ".join(f"contains(lower(line), {_q(p.lower())})" for p in Q.MULTI_CI))
sql("grep_pattern_table", """
SELECT doc_id, line_no, array_to_string((list_reduce(list(o ORDER BY o), lambda acc, x: CASE WHEN x.s >= acc.last
         THEN {'last': x.e, 'a': list_append(acc.a, x.s)} ELSE acc END,
         {'last': CAST(0 AS BIGINT), 'a': CAST([] AS BIGINT[])})).a, ',') AS pos
FROM (SELECT DISTINCT doc_id, line_no, {'e': CAST(strlen(substr(line, 1, i + length(p))) AS BIGINT),
             'nn': -length(p), 's': CAST(strlen(substr(line, 1, i)) AS BIGINT)} AS o
      FROM (SELECT doc_id, line_no, line, p FROM lines, pats WHERE contains(line, p)) h, unnest(range(0, length(line))) t(i)
      WHERE substr(line, i + 1, length(p)) = p) occ
GROUP BY doc_id, line_no""",
    """pats AS (SELECT DISTINCT p FROM (SELECT unnest(string_split(p_name, ' ')) AS p FROM part UNION ALL
              SELECT p FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS p FROM benchmark) b
              WHERE length(p) > 5) u WHERE p <> '')""")
sql("grep_regex_ci", f"SELECT doc_id, line_no, {regex_pos('line', '(?i)' + Q.REGEX_CI)} AS pos FROM lines "
                     f"WHERE regexp_matches(line, {_q('(?i)' + Q.REGEX_CI)})")
sql("grep_regex", f"SELECT doc_id, line_no, {regex_pos('line', Q.REGEX)} AS pos FROM lines "
                  f"WHERE regexp_matches(line, {_q(Q.REGEX)})")
sql("grep_default", f"SELECT doc_id, line_no, {multi_pos('line', ['[TODO]', '[DONE]'])} AS pos FROM dflt")
sql("grep_none", "SELECT doc_id, line_no, CAST(NULL AS VARCHAR) AS pos FROM marked WHERE false")
sql("pattern_tokens", """
SELECT item_id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS token_no, unnest(toks) AS pattern
FROM (SELECT item_id, list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '\\s+'),
                                  lambda t: t <> '') AS toks FROM benchmark)""")

# --- P1-P7 -------------------------------------------------------------------
sql("pos_literal", f"SELECT doc_id, line_no, {lit_pos('line', Q.POS_LIT)} AS pos FROM lines "
                   f"WHERE contains(line, {_q(Q.POS_LIT)})")
sql("pos_overlap", f"SELECT doc_id, line_no, array_to_string({overlap_list('line', Q.POS_OVERLAP)}, ',') AS pos "
                   f"FROM lines WHERE contains(line, {_q(Q.POS_OVERLAP)})")
sql("pos_first", f"SELECT doc_id, line_no, CASE WHEN instr(line, {_q(Q.POS_FIRST)}) > 0 THEN "
                 f"CAST(strlen(substr(line, 1, instr(line, {_q(Q.POS_FIRST)}) - 1)) AS BIGINT) END AS first_pos FROM lines")
sql("pos_multi", f"SELECT doc_id, line_no, {multi_pos('line', Q.MULTI_AC)} AS pos FROM lines WHERE "
                 + " OR ".join(f"contains(line, {_q(p)})" for p in Q.MULTI_AC))
sql("pos_regex", f"SELECT doc_id, line_no, {regex_pos('line', Q.REGEX_POS)} AS pos FROM lines "
                 f"WHERE regexp_matches(line, {_q(Q.REGEX_POS)})")
sql("next_char_dist", f"""
SELECT doc_id, line_no, CAST(coalesce(list_min(list_filter(range({Q.NEXT_START} + 1, length(line)),
       lambda i: substr(line, i + 1, 1) = {_q(Q.NEXT_CHAR)})) - {Q.NEXT_START}, 0) AS BIGINT) AS dist FROM lines""")
sql("pos_literal_ci", f"SELECT doc_id, line_no, {lit_pos('lower(line)', Q.POS_CI.lower())} AS pos FROM lines "
                      f"WHERE contains(lower(line), {_q(Q.POS_CI.lower())})")

# --- X8, X10 ---------------------------------------------------------------------
sql("trim_line", "SELECT doc_id, line_no, regexp_replace(line, '^[\\s\\x{0B}\\x{85}\\p{Z}]+', '') AS trimmed FROM lines")
sql("highlight", "SELECT doc_id, line_no, regexp_replace(line, '(?i)(\\[TODO\\]|\\[DONE\\])', "
                 "chr(27) || '[31m\\1' || chr(27) || '[0m', 'g') AS text FROM dflt")

# --- A1-A4 / S7-S9 -------------------------------------------------------------------
DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
sql("count_total", "SELECT CAST(count(*) AS BIGINT) AS total FROM dflt")
sql("count_per_file", "SELECT path, CAST(count(*) AS BIGINT) AS n_lines FROM dflt GROUP BY path")
sql("files_with_matches", f"SELECT DISTINCT {DIR} AS directory, path AS name FROM dflt")
sql("report_nested", f"""
SELECT {DIR} AS directory, path AS name, CAST(count(*) AS BIGINT) AS n_items,
       string_agg(CAST(line_no AS VARCHAR) || ':' || pos, ';' ORDER BY line_no) AS items
FROM (SELECT path, line_no, {multi_pos('line', ['[TODO]', '[DONE]'])} AS pos FROM dflt) GROUP BY path""")
sql("report_json", f"SELECT {DIR} AS directory, path AS name, line_no AS line, line AS content, "
                   f"{multi_pos('line', ['[TODO]', '[DONE]'])} AS pos FROM dflt")
sql("report_plain", f"""
SELECT {DIR} AS directory, path AS file, 2 AS section, line_no AS line, 0 AS seq,
       CAST(line_no AS VARCHAR) || '    ' || regexp_replace(line, '^[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', '') AS text FROM dflt
UNION ALL
SELECT directory, NULL, 0, 0, seq, text FROM (
  SELECT DISTINCT {DIR} AS directory FROM dflt) d,
  LATERAL (SELECT 0 AS seq, split_part(directory, '/', -2) || '/' || split_part(directory, '/', -1) AS text
           UNION ALL SELECT 1, split_part(directory, '/', -1))
UNION ALL
SELECT DISTINCT {DIR}, path, 1, 0, 0, split_part(path, '/', -1) FROM dflt
UNION ALL
SELECT DISTINCT {DIR}, path, 3, 0, 0, '' FROM dflt
UNION ALL
SELECT NULL, NULL, 9, 0, 0, '' UNION ALL
SELECT NULL, NULL, 9, 0, 1, 'Total ' || CAST((SELECT count(*) FROM dflt) AS VARCHAR) || ' lines found'""")
sql("report_tree", f"""
SELECT DISTINCT {DIR} AS directory, CAST(NULL AS VARCHAR) AS file, 0 AS section, CAST(0 AS BIGINT) AS line,
       {DIR} AS text FROM dflt
UNION ALL
SELECT {DIR}, path, 1, line_no, '    ' || split_part(path, '/', -1) || ':' || CAST(line_no AS VARCHAR) || ':'
       || split_part({multi_pos('line', ['[TODO]', '[DONE]'])}, ',', 1) || ' - ' || regexp_replace(line, '^[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', '')
FROM dflt""")
sql("todo_progress", f"""
SELECT {DIR} AS directory,
       CAST(sum(CASE WHEN contains(line, '[TODO]') THEN 1 ELSE 0 END) AS BIGINT) AS todo,
       CAST(sum(CASE WHEN contains(line, '[TODO]') THEN 0 ELSE 1 END) AS BIGINT) AS done
FROM dflt GROUP BY 1""")

# --- X1-X4 -------------------------------------------------------------------------
sql("path_parts", f"""
SELECT doc_id, path, {DIR} AS directory, split_part(path, '/', -1) AS file_name,
       regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1) AS ext FROM corpus""")
sql("path_last_two", "SELECT doc_id, split_part(path, '/', -1) AS last, split_part(path, '/', -2) AS second FROM corpus")
sql("path_relative", """
SELECT doc_id, split_part(path, '/', -1) AS rel, '../../../' || split_part(path, '/', -1) AS rel_deep FROM corpus""")

# --- X5, X6, J1, S10, F1-F6, S3-S5, J5 -----------------------------------------------
EXT = "regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1)"
LANG = (f"CASE {EXT} WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'rb' THEN 'ruby' WHEN 'cpp' THEN 'cpp' "
        f"WHEN 'h' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' END")
DIM = """dim(language, comment_prefix, indent_unit, root_kind, decorator_kind, comment_kind) AS (VALUES
 ('rust', '/// [TODO]', '    ', 'source_file', 'attribute_item', 'line_comment'),
 ('python', '# [TODO]', '    ', 'module', NULL, 'comment'),
 ('ruby', '# [TODO]', '  ', 'program', NULL, 'comment'),
 ('cpp', '/// [TODO]', '    ', 'translation_unit', NULL, 'comment'),
 ('typescript', '// [TODO]', '    ', 'program', 'decorator', 'comment'),
 ('javascript', '// [TODO]', '    ', 'program', 'decorator', 'comment'))"""
sql("lang_detect", f"""
SELECT doc_id, {EXT} AS ext, coalesce({LANG}, {EXT}) AS language, coalesce(d.comment_prefix, '') AS comment_prefix,
       {LANG} IS NOT NULL AS supported
FROM corpus LEFT JOIN dim d ON d.language = {LANG}""", DIM)
sql("dim_lookup", f"""
SELECT doc_id, d.language, comment_prefix, indent_unit, root_kind, decorator_kind, comment_kind
FROM corpus JOIN dim d ON d.language = {LANG}""", DIM)
sql("filter_ext", f"SELECT doc_id, path FROM corpus WHERE {EXT} NOT IN ('md', 'json')")
sql("filter_hidden", "SELECT doc_id, path FROM corpus WHERE NOT starts_with(split_part(path, '/', -1), '.')")
sql("filter_gitignore", """
SELECT doc_id, path FROM corpus
WHERE NOT (regexp_matches(substr(path, 6), '^src2/')   -- an ignored folder: nothing under it comes back
  OR coalesce(CASE
  WHEN regexp_matches(substr(path, 6), '^src3/(.*/)?[^/]*\\.go$') THEN true
  WHEN regexp_matches(substr(path, 6), '^(.*/)?test_[^/]*$') THEN false
  WHEN regexp_matches(substr(path, 6), '^(.*/)?[^/]*\\.m[^/]$') THEN true
  WHEN regexp_matches(substr(path, 6), '^(.*/)?doc_1[^/]*\\.json$') THEN false
  WHEN regexp_matches(substr(path, 6), '^(.*/)?[^/]*\\.json$') THEN true END, false))""")
sql("filter_test_path", "SELECT doc_id, path FROM corpus WHERE NOT contains(path, 'test')")
sql("filter_language", f"SELECT doc_id, path, {LANG} AS language FROM corpus WHERE {LANG} IS NOT NULL")
sql("select_only", f"SELECT doc_id, coalesce({LANG}, {EXT}) AS language FROM corpus "
                   "WHERE coalesce(" + LANG + ", " + EXT + ") IN ('python', 'rust', 'md')")
sql("select_except", f"SELECT doc_id, coalesce({LANG}, {EXT}) AS language FROM corpus "
                     "WHERE coalesce(" + LANG + ", " + EXT + ") NOT IN ('python', 'rust', 'md')")
sql("path_glob", "SELECT doc_id, path FROM corpus WHERE path GLOB 'root/src1*/*.py'")
sql("path_eq", "SELECT doc_id, path FROM corpus WHERE path = 'root/src3/doc_3.cpp'")
sql("strict_utf8_split", "SELECT doc_id, true AS valid, ends_with(content, chr(10)) AS has_eol FROM corpus")
sql("project_root", f"""
SELECT doc_id, path, m.root FROM corpus
LEFT JOIN (SELECT DISTINCT {DIR} AS root FROM corpus WHERE starts_with(split_part(path, '/', -1), '.')) m
  ON m.root = {DIR}""")

# --- J3, J4, A6, X12 ---------------------------------------------------------------------
sql("fuzzy_suggest", """
SELECT word, CASE WHEN list_min(list_transform(vocab, lambda t: levenshtein(word, t))) = 0 THEN NULL
  ELSE (list_min(list_filter(list_transform(range(1, 10), lambda i: {'d': levenshtein(word, vocab[i]), 'i': i, 'term': vocab[i]}),
        lambda c: c.d BETWEEN 1 AND 3))).term END AS suggestion
FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
     (SELECT ['init', 'reset', 'grep', 'help', 'file', 'pattern', 'format', 'json', 'plain'] AS vocab)""")
sql("overlay_merge", """
SELECT coalesce(u.name, b.name) AS name, coalesce(u.region_key, b.region_key) AS region_key,
       coalesce(u.supplier_count, b.supplier_count) AS supplier_count, coalesce(u.source, b.source) AS source,
       CAST(CASE WHEN u.name IS NOT NULL THEN 2 ELSE 4 END AS BIGINT) AS indent_width,
       CASE WHEN u.name IS NOT NULL THEN NULL ELSE '    ' END AS indent_unit,
       CAST(CASE WHEN u.name IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS ord_group,
       CAST(coalesce(u.ord, b.ord) AS BIGINT) AS ord
FROM (SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region_key, CAST(NULL AS BIGINT) AS supplier_count,
             'base' AS source, n_nationkey AS ord FROM nation) b
FULL OUTER JOIN (SELECT 'NATION_' || CAST(s_nationkey + 20 AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS region_key,
             CAST(count(*) AS BIGINT) AS supplier_count, 'user' AS source, s_nationkey + 20 AS ord
             FROM supplier GROUP BY s_nationkey) u ON u.name = b.name""")
RULES = """rules(language, kind, is_ignorable, is_scope) AS (VALUES
 ('rust','type_item',true,false),('rust','static_item',true,false),('rust','extern_crate_declaration',true,false),
 ('rust','const_item',true,false),('rust','use_declaration',true,false),('rust','expression_statement',true,false),
 ('rust','macro_invocation',true,false),('rust','foreign_mod_item',true,false),
 ('typescript','string_fragment',true,false),('typescript','import_specifier',true,false),('typescript','named_imports',true,false),
 ('javascript','string_fragment',true,false),('javascript','import_specifier',true,false),('javascript','named_imports',true,false),
 ('rust','attribute_item',false,false),('rust','mod_item',false,true),('rust','enum_item',false,false),('rust','impl_item',false,true),
 ('rust','function_item',false,false),('rust','struct_item',false,false),('rust','trait_item',false,false),('rust','macro_definition',false,false),
 ('python','class_definition',false,true),('python','function_definition',false,false),('python','decorated_definition',false,false),
 ('ruby','class',false,true),('ruby','method',false,false),('ruby','function',false,false),('ruby','module',false,true),
 ('cpp','namespace_definition',false,true),('cpp','function_definition',false,false),('cpp','class_specifier',false,true),
 ('typescript','enum_declaration',false,false),('typescript','function_declaration',false,false),('typescript','class_declaration',false,true),
 ('typescript','method_definition',false,false),('typescript','interface_declaration',false,false),('typescript','export_statement',false,false),
 ('typescript','expression_statement',false,true),
 ('javascript','enum_declaration',false,false),('javascript','function_declaration',false,false),('javascript','class_declaration',false,true),
 ('javascript','method_definition',false,false),('javascript','interface_declaration',false,false),('javascript','export_statement',false,false),
 ('javascript','expression_statement',false,true))"""
sql("fuzzy_vocabulary", """
SELECT word, CASE WHEN word NOT IN (SELECT term FROM vocab) THEN
       (SELECT min({'d': levenshtein(word, term), 't': term}) FROM vocab WHERE levenshtein(word, term) <= 2).t END AS suggestion
FROM (SELECT DISTINCT unnest(string_split_regex(lower(line), '[^a-z]+')) AS word FROM lines WHERE line_no = 1) w
WHERE length(word) > 2""",
    "vocab AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)")
sql("config_layers", """
SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region, 'x' || n_nationkey || '|y' AS file_types,
       s.n IS NULL AS auto, s.n AS suppliers,
       CASE WHEN s.n IS NULL THEN '0,' || row_number() OVER (ORDER BY n_nationkey)
            ELSE '1,' || 2 * row_number() OVER (PARTITION BY s.n IS NULL ORDER BY n_nationkey) END AS ord_path
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) s ON s_nationkey = n_nationkey
QUALIFY n_name NOT IN ('NATION_1', 'NATION_2')""")
sql("scannable_rules", f"""
SELECT r.language, kind, is_ignorable, is_scope, CAST(count(*) AS BIGINT) AS n_files
FROM corpus JOIN rules r ON r.language = {LANG} GROUP BY ALL""", RULES)
sql("point_in_range", """
SELECT doc_id, line_no, c AS col,
       (line_no < 10 OR (line_no = 10 AND c < 5)) AS before,
       (line_no > 20 OR (line_no = 20 AND c > 40)) AS after,
       NOT (line_no < 10 OR (line_no = 10 AND c < 5)) AND NOT (line_no > 20 OR (line_no = 20 AND c > 40)) AS member
FROM (SELECT doc_id, line_no, CAST(strlen(substr(line, 1, instr(line, '[TODO]') - 1)) AS BIGINT) AS c
      FROM marked WHERE contains(line, '[TODO]'))""")

# --- T1-T7, X7, X11, W2-W4, O3, S6 (generated code corpus) ----------------------------
CODE = """
code_sup AS (
  SELECT regexp_replace(r_name, '[^A-Za-z0-9_]', '_', 'g') AS region,
         regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') AS nation,
         regexp_replace(s_name, '[^A-Za-z0-9_]', '_', 'g') AS supplier,
         s_suppkey, CAST(floor(s_suppkey / 1000) AS BIGINT) AS chunk
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
code_sym AS (
  SELECT *, 'code/' || region || '/' || nation || '_' || CAST(chunk AS VARCHAR) AS stem,
         CAST(row_number() OVER (PARTITION BY region, nation, chunk ORDER BY s_suppkey) - 1 AS BIGINT) AS k,
         CAST(count(*) OVER (PARTITION BY region, nation, chunk) AS BIGINT) AS n
  FROM code_sup),
code_file AS (SELECT DISTINCT stem, region, nation, n FROM code_sym)"""

# expected declarations: (file ext, source, start, header, kind, name, level, scope path, role)
_DECLS = [
    ("py", "code_file", "1", "1", "'class_definition'", "region", 0, "region", "scope"),
    ("py", "code_file", "3", "3", "'class_definition'", "nation", 1, "region || ' > ' || nation", "scope"),
    ("py", "code_sym", "4 + 6 * k", "5 + 6 * k", "'decorated_definition'", "supplier", 2,
     "region || ' > ' || nation || ' > ' || supplier", "decl"),
    ("rs", "code_file", "1", "1", "'mod_item'", "region", 0, "region", "scope"),
    ("rs", "code_file", "2", "2", "'mod_item'", "nation", 1, "region || ' > ' || nation", "scope"),
    ("rs", "code_file", "3", "3", "'use_declaration'", "'anonymous'", 2,
     "region || ' > ' || nation || ' > anonymous'", "ignorable"),
    ("rs", "code_file", "5", "5", "'static_item'", "'anonymous'", 2,
     "region || ' > ' || nation || ' > anonymous'", "ignorable"),
    ("rs", "code_sym", "6 + 7 * k", "7 + 7 * k", "'struct_item'", "supplier", 2,
     "region || ' > ' || nation || ' > ' || supplier", "decl"),
    ("rs", "code_sym", "10 + 7 * k", "10 + 7 * k", "'impl_item'", "'fmt::Display'", 2,
     "region || ' > ' || nation || ' > fmt::Display'", "scope"),
    ("rs", "code_sym", "11 + 7 * k", "11 + 7 * k", "'function_item'", "'fmt'", 3,
     "region || ' > ' || nation || ' > fmt::Display > fmt'", "decl"),
]
DECLS = "decls AS (" + " UNION ALL ".join(
    f"SELECT stem || '.{e}' AS path, CAST({s} AS BIGINT) AS start, CAST({h} AS BIGINT) AS header, {kind} AS kind, "
    f"{name} AS name, CAST({lv} AS BIGINT) AS level, {sp} AS scope_path, '{role}' AS role, "
    f"'{'python' if e == 'py' else 'rust'}' AS language FROM {src}"
    for e, src, s, h, kind, name, lv, sp, role in _DECLS) + ")"

sql("symbol_decls", "SELECT path, start, header, kind, name FROM decls", CODE + "," + DECLS)
sql("symbol_names", """
SELECT path, header, kind, name, true AS walked FROM decls
UNION ALL
SELECT stem || '.py', CAST(7 + 6 * k AS BIGINT), 'function_definition', 'helper', false FROM code_sym""", CODE + "," + DECLS)
sql("symbol_scope", "SELECT path, header, level, scope_path FROM decls", CODE + "," + DECLS)
sql("symbol_ignorable", "SELECT path, header, kind FROM decls WHERE role = 'ignorable'", CODE + "," + DECLS)
sql("decorator_anchor", "SELECT path, header, start AS anchor FROM decls WHERE start < header", CODE + "," + DECLS)
sql("comment_line", """
SELECT path, start, repeat('    ', CAST(level AS INTEGER)) || CASE language WHEN 'python' THEN '# [TODO] ' ELSE '/// [TODO] ' END
       || scope_path AS comment
FROM decls WHERE role <> 'ignorable'""", CODE + "," + DECLS)

# expected annotated files: (ext, source, ord expression, line expression, is comment)
_PY_SUP = ["'        # [TODO] ' || region || ' > ' || nation || ' > ' || supplier", "'        @deco'",
           "'        def ' || supplier || '(self):'", "'            # def not_a_decl(): in a comment'",
           "'            def helper():'", "'                pass'", "'            return helper'"]
_RS_SUP = ["'        /// [TODO] ' || region || ' > ' || nation || ' > ' || supplier", "'        #[derive(Debug)]'",
           "'        pub struct ' || supplier || ' {'", "'            id: u64,'", "'        }'",
           "'        /// [TODO] ' || region || ' > ' || nation || ' > fmt::Display'",
           "'        impl fmt::Display for ' || supplier || ' {'",
           "'            /// [TODO] ' || region || ' > ' || nation || ' > fmt::Display > fmt'",
           "'            fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result { write!(f, \"{{{}\", self.id) }'",
           "'        }'"]
_ANN = (
    [("py", "code_file", str(i + 1), e, c) for i, (e, c) in enumerate([
        ("'# [TODO] ' || region", True), ("'class ' || region || ':'", False),
        ("'    \"\"\"Region ' || region || '. class Fake: def fake(): in a docstring\"\"\"'", False),
        ("'    # [TODO] ' || region || ' > ' || nation", True), ("'    class ' || nation || ':'", False)])]
    + [("py", "code_sym", f"6 + 7 * k + {i}", e, i == 0) for i, e in enumerate(_PY_SUP)]
    + [("rs", "code_file", str(i + 1), e, c) for i, (e, c) in enumerate([
        ("'/// [TODO] ' || region", True), ("'mod ' || region || ' {'", False),
        ("'    /// [TODO] ' || region || ' > ' || nation", True), ("'    mod ' || nation || ' {'", False),
        ("'        use std::fmt;'", False), ("'        #[allow(dead_code)]'", False),
        ("'        static COUNT: u32 = 0;'", False)])]
    + [("rs", "code_sym", f"8 + 10 * k + {i}", e, i in (0, 5, 7)) for i, e in enumerate(_RS_SUP)]
    + [("rs", "code_file", "8 + 10 * n", "'    }'", False), ("rs", "code_file", "9 + 10 * n", "'}'", False)]
)
ANN = "ann AS (" + " UNION ALL ".join(
    f"SELECT stem || '.{e}' AS path, CAST({o} AS BIGINT) AS ord, {ln} AS line, {str(c).lower()} AS is_comment FROM {src}"
    for e, src, o, ln, c in _ANN) + ")"
ANN_FILES = "ann_files AS (SELECT path, string_agg(line, chr(10) ORDER BY ord) || chr(10) AS content FROM ann GROUP BY path)"

sql("annotate_lines", "SELECT path, ord, line, is_comment FROM ann", CODE + "," + ANN)
sql("annotate_idempotent", "SELECT path, ord, line FROM ann", CODE + "," + ANN)
sql("collapse_comments", "SELECT path, ord * 2 AS line_no, line FROM ann", CODE + "," + ANN)
sql("annotate_files", "SELECT path, content FROM ann_files", CODE + "," + ANN + "," + ANN_FILES)
sql("annotate_corpus", "SELECT path, content FROM ann_files", CODE + "," + ANN + "," + ANN_FILES)
sql("annotate_glob", "SELECT path, content FROM ann_files WHERE path GLOB 'code/AFRICA/*.py'",
    CODE + "," + ANN + "," + ANN_FILES)

# The six-language corpus. Expected declarations: (language, part of the template, line of the
# start and of the header in it, kind, role, scope path; {x} is filled in as in the template).
_LITERAL_DECLS = [
    ("python", "header", 0, 0, "class_definition", "scope", ["{nation}"]),
    ("python", "per_supplier", 0, 0, "function_definition", "decl", ["{nation}", "{supplier}"]),
    ("python", "footer", 0, 0, "function_definition", "decl", ["after_{nation}"]),
    ("ruby", "header", 0, 0, "module", "scope", ["{region}"]),
    ("ruby", "header", 7, 7, "class", "scope", ["{region}", "{nation}"]),
    ("ruby", "per_supplier", 0, 0, "method", "decl", ["{region}", "{nation}", "{supplier}"]),
    ("rust", "header", 0, 0, "mod_item", "scope", ["{region}"]),
    ("rust", "per_supplier", 0, 0, "function_item", "decl", ["{region}", "{supplier}"]),
    ("cpp", "header", 0, 0, "namespace_definition", "scope", ["{region}"]),
    ("cpp", "header", 2, 2, "class_specifier", "scope", ["{region}", "{nation}"]),
    ("cpp", "per_supplier", 1, 1, "function_definition", "decl", ["{region}", "{nation}", "{supplier}"]),
    ("cpp", "per_supplier", 3, 3, "function_definition", "decl", ["{region}", "{nation}", "{supplier}"]),
    ("typescript", "header", 0, 0, "class_declaration", "scope", ["{nation}"]),
    ("typescript", "per_supplier", 0, 1, "method_definition", "decl", ["{nation}", "{supplier}"]),
    ("typescript", "footer", 1, 1, "function_declaration", "decl", ["after_{nation}"]),
    ("javascript", "header", 0, 0, "class_declaration", "scope", ["{nation}"]),
    ("javascript", "per_supplier", 0, 0, "method_definition", "decl", ["{nation}", "{supplier}"]),
    ("javascript", "footer", 1, 1, "function_declaration", "decl", ["after_{nation}"]),
]
_PREFIX = {"python": "# [TODO] ", "ruby": "# [TODO] ", "rust": "/// [TODO] ", "cpp": "/// [TODO] ",
           "typescript": "// [TODO] ", "javascript": "// [TODO] "}


def _filled(text: str, part: str) -> str:
    """SQL for a template's text."""
    out = _q(text)
    for name in ("region", "nation", *(["supplier"] if part == "per_supplier" else [])):
        out = f"replace({out}, '{{{name}}}', {name})"
    return out


def _line_of(parts: dict, part: str, i: int) -> str:
    """SQL for the line number (from 1) of line ``i`` of a part."""
    nh, ns = len(parts["header"]), len(parts["per_supplier"])
    return {"header": f"{i + 1}", "per_supplier": f"{nh + 1 + i} + {ns} * k", "footer": f"{nh + 1 + i} + {ns} * n"}[part]


def _literal_sql() -> tuple[str, str]:
    decls, lines = [], []
    for lang, t in TB.LITERAL_TEMPLATES.items():
        parts = {p: t[p] for p in ("header", "per_supplier", "footer")}
        path = f"stem || '.{t['ext']}' AS path"
        own = [d for d in _LITERAL_DECLS if d[0] == lang]
        marked = {p: [] for p in parts}  # the annotated text: (line, is comment)
        for p, text in parts.items():
            for i, x in enumerate(text):
                for d in own:
                    if (d[1], d[2]) == (p, i):
                        unit = ("  " if lang == "ruby" else "    ") * (len(d[6]) - 1)
                        marked[p].append((unit + _PREFIX[lang] + " > ".join(d[6]), True))
                marked[p].append((x, False))
        source = {p: "code_sym" if p == "per_supplier" else "code_file" for p in parts}
        for _, p, start, header, kind, role, scope in own:
            decls.append(f"SELECT {path}, CAST({_line_of(parts, p, start)} AS BIGINT) AS start, "
                         f"CAST({_line_of(parts, p, header)} AS BIGINT) AS header, '{kind}' AS kind, "
                         f"{_filled(scope[-1], p)} AS name, '{role}' AS role, CAST({len(scope) - 1} AS BIGINT) AS level, "
                         f"{_filled(' > '.join(scope), p)} AS scope_path FROM {source[p]}")
        for p in parts:
            lines += [f"SELECT {path}, CAST({_line_of(marked, p, i)} AS BIGINT) AS ord, {_filled(x, p)} AS line, "
                      f"{str(c).lower()} AS is_comment FROM {source[p]}" for i, (x, c) in enumerate(marked[p])]
    return " UNION ALL ".join(decls), " UNION ALL ".join(lines)


sql("symbol_rules", """
SELECT path, start, CASE kind WHEN 'class_definition' THEN 'type' WHEN 'mod_item' THEN 'space' WHEN 'struct_item' THEN 'record'
                              WHEN 'use_declaration' THEN 'import' END AS kind, role, name, level, scope_path
FROM (SELECT path, CASE kind WHEN 'struct_item' THEN header ELSE start END AS start, kind, role, name, level, scope_path FROM decls
      WHERE kind IN ('class_definition', 'mod_item', 'struct_item', 'use_declaration')) d
UNION ALL
SELECT path, header, 'callable', role, name, level, scope_path FROM decls WHERE kind = 'decorated_definition'
UNION ALL
SELECT path, header, 'anything', 'decl', 'static', level, replace(scope_path, 'anonymous', 'static') FROM decls
WHERE kind = 'static_item'""", CODE + "," + DECLS)
sql("symbol_languages", _literal_sql()[0], CODE)
sql("annotate_languages", _literal_sql()[1], CODE)

# --- the same operators over the other text tables -----------------------------------
CONV_LINES = """
cl0 AS (SELECT conv_id, turn, role, len(parts) AS n, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
        FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS parts FROM conversations)),
cl AS (SELECT conv_id, turn, role, CAST(i AS BIGINT) AS line_no, line FROM cl0 WHERE NOT (i = n AND line = ''))"""
sql("grep_conversations", f"SELECT conv_id, turn, role, line_no, {multi_pos('line', Q.CONV_PATTERNS)} AS pos FROM cl WHERE "
    + " OR ".join(f"contains(line, {_q(p)})" for p in Q.CONV_PATTERNS), CONV_LINES)
sql("url_parts", """
SELECT page_id, url_path,
       CASE WHEN url_path LIKE '%/%' THEN regexp_extract(url_path, '^(.*)/[^/]*$', 1) ELSE '' END AS directory,
       regexp_extract(url_path, '([^/]*)/*$', 1) AS file_name,
       regexp_extract(regexp_extract(url_path, '([^/]*)/*$', 1), '^.+\\.([^.]*)$', 1) AS ext,
       CASE WHEN len(list_filter(string_split(url_path, '/'), lambda c: c <> '')) >= 2
            THEN list_filter(string_split(url_path, '/'), lambda c: c <> '')[-2] END AS second
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS url_path FROM pages)""")
