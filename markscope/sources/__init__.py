"""Sources: parquet tables, the fixture views built on them, and a file-tree scan."""
