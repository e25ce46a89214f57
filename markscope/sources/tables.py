"""Given tables and the derived views used by tests, queries and the bench.

The views are defined once as SQL text so that the Spark plans and the
DuckDB oracles use the very same derivation (FIXTURES.md section 3).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from markscope.operators.lines import explode_lines

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# How a document becomes a file path (FIXTURES.md).
CORPUS_PATH_SQL = (
    "concat('root/', source, '/', "
    "CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END, "
    "CASE WHEN doc_id % 13 = 0 THEN 'test_' ELSE 'doc_' END, "
    "CAST(doc_id AS STRING), '.', "
    "CASE doc_id % 10 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'rb' "
    "WHEN 3 THEN 'cpp' WHEN 4 THEN 'h' WHEN 5 THEN 'ts' WHEN 6 THEN 'js' "
    "WHEN 7 THEN 'md' WHEN 8 THEN 'json' ELSE 'go' END)"
)

# Marker text added to lines (FIXTURES.md).
MARKED_LINE_SQL = ("CASE WHEN line_no % 7 = 0 THEN concat('[TODO] ', line) "
                   "WHEN line_no % 5 = 0 THEN concat('[DONE] ', line) ELSE line END")

# Suppliers per generated code file: keeps every file (one group) bounded.
CODE_CHUNK = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus(doc_id, path, content)``: one file per document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(CORPUS_PATH_SQL).alias("path"),
                       F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(doc_id, line_no, line)``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return explode_lines(docs, "text", keep=["doc_id"])


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with ``[TODO]`` / ``[DONE]`` markers."""
    return lines(spark, sf_dir).select("doc_id", "line_no",
                                       F.expr(MARKED_LINE_SQL).alias("line"))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text carries the markers: ``(doc_id, path, content)``.

    Built per document with array functions (no regrouping shuffle), so a
    file is rewritten where it lives.
    """
    docs = table(spark, sf_dir, "documents")
    from markscope.operators.lines import split_lines
    marked_text = F.array_join(
        F.transform(split_lines("text"), lambda l, i: F.when((i + 1) % 7 == 0, F.concat(F.lit("[TODO] "), l))
                    .when((i + 1) % 5 == 0, F.concat(F.lit("[DONE] "), l)).otherwise(l)), "\n")
    return docs.select("doc_id", F.expr(CORPUS_PATH_SQL).alias("path"), marked_text.alias("content"))


def _ident(c):
    return F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected declarations of the generated code corpus, one row per
    supplier: ``(stem, region, nation, supplier, s_suppkey, rank, n)`` where
    ``stem`` names the file (without extension), ``rank`` orders suppliers
    inside it and ``n`` counts them."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation and region are fixed-size dimensions (25 and 5 rows)
    dims = nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey)
    s = sup.join(F.broadcast(dims), sup.s_nationkey == dims.n_nationkey)
    chunk = F.floor(F.col("s_suppkey") / CODE_CHUNK).cast("bigint")
    s = s.select(_ident(F.col("r_name")).alias("region"), _ident(F.col("n_name")).alias("nation"),
                 _ident(F.col("s_name")).alias("supplier"), "s_suppkey", chunk.alias("chunk"))
    s = s.withColumn("stem", F.concat(F.lit("code/"), "region", F.lit("/"), "nation",
                                      F.lit("_"), F.col("chunk").cast("string")))
    w = Window.partitionBy("stem")
    return s.withColumn("rank", (F.row_number().over(w.orderBy("s_suppkey")) - 1).cast("bigint")) \
            .withColumn("n", F.count(F.lit(1)).over(w).cast("bigint"))


# The text of the generated code files ({region}, {nation},
# {supplier} are filled in).  Python: one class per region holding one class
# per nation holding decorated methods; Rust: nested modules holding structs
# with a trait impl.
CODE_TEMPLATES = {
    "python": {
        "ext": "py",
        "header": ["class {region}:",
                   '    """Region {region}. class Fake: def fake(): in a docstring"""',
                   "    class {nation}:"],
        "per_supplier": ["        @deco",
                         "        def {supplier}(self):",
                         "            # def not_a_decl(): in a comment",
                         "            def helper():",
                         "                pass",
                         "            return helper"],
        "footer": [],
    },
    "rust": {
        "ext": "rs",
        "header": ["mod {region} {",
                   "    mod {nation} {",
                   "        use std::fmt;",
                   "        #[allow(dead_code)]",
                   "        static COUNT: u32 = 0;"],
        "per_supplier": ["        #[derive(Debug)]",
                         "        pub struct {supplier} {",
                         "            id: u64,",
                         "        }",
                         "        impl fmt::Display for {supplier} {",
                         '            fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result { write!(f, "{{{}", self.id) }',
                         "        }"],
        "footer": ["    }", "}"],
    },
}


# A second corpus, one template for each of the six languages, whose literals
# and directives hide brackets and declarations; {nation} etc. as above.
LITERAL_TEMPLATES = {
    "python": {"ext": "py",
               "header": ["class {nation}:"],
               "per_supplier": ["    def {supplier}(self):", "        s = \'\'\'", "    def fake(self):", "        \'\'\'",
                                "        return s"],
               "footer": ["def after_{nation}():", "    pass"]},
    "ruby": {"ext": "rb",
             "header": ["module {region}", "  SQL = <<~EOS + join(<<-END)", "    def fake", "  class Fake", "  EOS", "  def (fake",
                        "  END", "  class {nation}"],
             "per_supplier": ["    def {supplier}(x)", "      x =~ /[\"{(]/ ? \"a#{x[\"}\"]} def z(\" : %w(a (b) def)", "    end"],
             "footer": ["  end", "end"]},
    "rust": {"ext": "rs",
             "header": ["mod {region} {"],
             "per_supplier": ["    fn {supplier}() -> &'static str {", "        r##\"} \"# fn fake() {\"##", "    }",
                              "    /* { /* nested */ { */"],
             "footer": ["}"]},
    "cpp": {"ext": "cpp",
            "header": ["namespace {region} {", "#define OPEN_{nation} {", "class {nation} {"],
            "per_supplier": ["#if defined(A)", "  int {supplier}(int a) {", "#else", "  int {supplier}(long a) {", "#endif",
                             "    auto s = R\"x(} int fake() {)x\"; char c = '{'; long n = 1'000;", "    return a;", "  }"],
            "footer": ["};", "}"]},
    "typescript": {"ext": "ts",
                   "header": ["class {nation} {"],
                   "per_supplier": ["  @deco", "  {supplier}(x: string): boolean {",
                                    "    const s = `a ${x.length > 0 ? `}${x}{` : '{'} {`;",
                                    "    return /[\"{]\\/`/.test(x) || x.length / 2 / 1 > 0;", "  }"],
                   "footer": ["}", "function after_{nation}(): void {", "}"]},
    "javascript": {"ext": "js",
                   "header": ["class {nation} {"],
                   "per_supplier": ["  {supplier}(x) { return /[\"{]/.test(x) ? `}${x}{` : x / 2; }"],
                   "footer": ["}", "function after_{nation}() { return /}/; }"]},
}


def _fill(t: str):
    """Template -> Column, with the placeholders as format arguments."""
    fmt = t.replace("%", "%%").replace("{region}", "%1$s").replace("{nation}", "%2$s") \
           .replace("{supplier}", "%3$s")
    return F.format_string(fmt, F.col("region"), F.col("nation"), F.col("supplier"))


def code_lines(spark: SparkSession, sf_dir: str, templates: dict = CODE_TEMPLATES) -> DataFrame:
    """``(stem, path, language, line_no, line)`` of the generated code corpus.

    One pass over the suppliers: each emits its own lines, the first of a
    file also the header and the last also the footer.
    """
    syms = code_symbols(spark, sf_dir)
    items = []
    for lang, t in templates.items():
        nh, ns = len(t["header"]), len(t["per_supplier"])
        for i, x in enumerate(t["header"]):
            items.append(F.when(F.col("rank") == 0, F.struct(F.lit(lang).alias("language"), F.lit(t["ext"]).alias("ext"),
                                                           F.lit(i + 1).cast("bigint").alias("line_no"),
                                                           _fill(x).alias("line"))))
        for i, x in enumerate(t["per_supplier"]):
            items.append(F.struct(F.lit(lang).alias("language"), F.lit(t["ext"]).alias("ext"),
                                  (F.lit(nh + 1 + i) + F.col("rank") * ns).cast("bigint").alias("line_no"),
                                  _fill(x).alias("line")))
        for i, x in enumerate(t["footer"]):
            items.append(F.when(F.col("rank") == F.col("n") - 1,
                                F.struct(F.lit(lang).alias("language"), F.lit(t["ext"]).alias("ext"),
                                         (F.lit(nh + 1 + i) + F.col("n") * ns).cast("bigint").alias("line_no"),
                                         _fill(x).alias("line"))))
    out = syms.select("stem", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x"))
    return out.select("stem", F.concat(F.col("stem"), F.lit("."), F.col("x.ext")).alias("path"),
                      "x.language", "x.line_no", "x.line")


def code_files(spark: SparkSession, sf_dir: str, templates: dict = CODE_TEMPLATES) -> DataFrame:
    """``code(path, language, content)``: a file for each template (a Python and a Rust
    one) per region,
    nation and block of suppliers; each ends with a newline.  Grouped by
    (stem, language) so the supplier window's partitioning is reused."""
    ln = code_lines(spark, sf_dir, templates)
    content = F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    return ln.groupBy("stem", "language").agg(F.first("path").alias("path"), content.alias("content")) \
             .select("path", "language", "content")
