"""Language dimension (S10) and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscope.functions.paths import extension

# Supported languages and their file extensions.
EXTENSIONS = [("rs", "rust"), ("py", "python"), ("rb", "ruby"), ("cpp", "cpp"), ("h", "cpp"),
              ("hpp", "cpp"), ("ts", "typescript"), ("js", "javascript")]

# Per language the TODO comment prefix, the indent unit and the
# syntax node kinds for the root, decorators and comments.
LANGUAGES = [
    # language,    comment prefix, indent, root kind,          decorator kind,   comment kind
    ("rust",       "/// [TODO]",   "    ", "source_file",      "attribute_item", "line_comment"),
    ("python",     "# [TODO]",     "    ", "module",           None,             "comment"),
    ("ruby",       "# [TODO]",     "  ",   "program",          None,             "comment"),
    ("cpp",        "/// [TODO]",   "    ", "translation_unit", None,             "comment"),
    ("typescript", "// [TODO]",    "    ", "program",          "decorator",      "comment"),
    ("javascript", "// [TODO]",    "    ", "program",          "decorator",      "comment"),
]

# Declaration kinds that get a comment, that open a nested
# scope, and that are skipped without a comment.
COMMENTABLE = {
    "rust": ["attribute_item", "mod_item", "enum_item", "impl_item", "function_item", "struct_item",
             "trait_item", "macro_definition"],
    "python": ["class_definition", "function_definition", "decorated_definition"],
    "ruby": ["class", "method", "function", "module"],
    "cpp": ["namespace_definition", "function_definition", "class_specifier"],
    "typescript": ["enum_declaration", "function_declaration", "class_declaration", "method_definition",
                   "interface_declaration", "export_statement", "expression_statement"],
    "javascript": ["enum_declaration", "function_declaration", "class_declaration", "method_definition",
                   "interface_declaration", "export_statement", "expression_statement"],
}
NESTED_SCOPE = {
    "rust": ["mod_item", "impl_item"],
    "python": ["class_definition"],
    "ruby": ["class", "module"],
    "cpp": ["namespace_definition", "class_specifier"],
    "typescript": ["class_declaration", "expression_statement", "internal_module"],
    "javascript": ["class_declaration", "expression_statement", "internal_module"],
}
IGNORABLE = {
    "rust": ["type_item", "static_item", "extern_crate_declaration", "const_item", "use_declaration",
             "expression_statement", "macro_invocation", "foreign_mod_item"],
    "typescript": ["string_fragment", "import_specifier", "named_imports"],
    "javascript": ["string_fragment", "import_specifier", "named_imports"],
}

EXT_SCHEMA = T.StructType([T.StructField("ext", T.StringType(), False),
                           T.StructField("language", T.StringType(), False)])
LANG_SCHEMA = T.StructType([T.StructField("language", T.StringType(), False),
                            T.StructField("comment_prefix", T.StringType(), False),
                            T.StructField("indent_unit", T.StringType(), False),
                            T.StructField("root_kind", T.StringType(), False),
                            T.StructField("decorator_kind", T.StringType(), True),
                            T.StructField("comment_kind", T.StringType(), False)])
RULE_SCHEMA = T.StructType([T.StructField("language", T.StringType(), False),
                            T.StructField("kind", T.StringType(), False),
                            T.StructField("is_ignorable", T.BooleanType(), False),
                            T.StructField("is_scope", T.BooleanType(), False)])


def dim_extension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXTENSIONS, EXT_SCHEMA)


def dim_language(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, LANG_SCHEMA)


def dim_extension_language(spark: SparkSession) -> DataFrame:
    """One row per supported extension with its language attributes."""
    return dim_extension(spark).join(F.broadcast(dim_language(spark)), "language").select(
        "ext", "language", "comment_prefix", "indent_unit", "root_kind", "decorator_kind", "comment_kind")


def scannable_rules(spark: SparkSession) -> DataFrame:
    """Ignorable kinds union commentable kinds, per language."""
    ign = [(lang, k, True, k in NESTED_SCOPE.get(lang, [])) for lang, ks in IGNORABLE.items() for k in ks]
    com = [(lang, k, False, k in NESTED_SCOPE.get(lang, [])) for lang, ks in COMMENTABLE.items() for k in ks]
    return spark.createDataFrame(ign, RULE_SCHEMA).unionByName(spark.createDataFrame(com, RULE_SCHEMA))


def detect_language(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``ext``, ``language`` (the extension itself when it is
    not supported), ``comment_prefix`` ('' when unsupported), ``indent_unit``
    and ``supported``.  The dimension has 8 rows and is broadcast."""
    spark = files.sparkSession
    dim = F.broadcast(dim_extension_language(spark).select("ext", F.col("language").alias("_lang"),
                                                           "comment_prefix", "indent_unit"))
    with_ext = files.withColumn("ext", extension(path_col))
    j = with_ext.join(dim, "ext", "left")
    return (j.withColumn("supported", F.col("_lang").isNotNull())
             .withColumn("language", F.coalesce(F.col("_lang"), F.col("ext")))
             .withColumn("comment_prefix", F.coalesce(F.col("comment_prefix"), F.lit("")))
             .withColumn("indent_unit", F.coalesce(F.col("indent_unit"), F.lit("")))
             .drop("_lang"))


def supported_only(files: DataFrame, path_col: str = "path") -> DataFrame:
    """keep files of a supported language (inner broadcast join)."""
    dim = F.broadcast(dim_extension(files.sparkSession))
    return files.withColumn("ext", extension(path_col)).join(dim, "ext", "inner")


def comment_prefix_of(language: Column) -> Column:
    """X6 as an expression (no join) for use inside larger projections."""
    m = F.create_map(*[x for lang, tok, *_ in LANGUAGES for x in (F.lit(lang), F.lit(tok))])
    return F.coalesce(m[language], F.lit(""))


def indent_unit_of(language: Column) -> Column:
    m = F.create_map(*[x for lang, _, unit, *_ in LANGUAGES for x in (F.lit(lang), F.lit(unit))])
    return F.coalesce(m[language], F.lit(""))
