"""Independent ANSI SQL for every registered query, run by DuckDB over the same Parquet.

The statements use the direct form (COUNT DISTINCT, unpartitioned windows) where the
Spark plans use grain tables, so that agreement tests the rewrites.
"""
