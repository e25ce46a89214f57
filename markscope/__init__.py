"""markscope: search, outline and annotate large bodies of text and code with Spark.

Everything is a DataFrame -> DataFrame function built from Spark SQL
expressions, joins and windows:

* ``sources``    - corpus scans (files, parquet tables) and fixture views
* ``functions``  - ``Column`` builders (match offsets, paths, highlighting)
* ``operators``  - grep, reports, file selection, language lookup, outline,
                   annotation, overlay merge, fuzzy suggestion
* ``plans``      - the registered queries and their DuckDB oracles
* ``streaming``  - incremental grep with Structured Streaming
"""

from markscope.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
