"""Runnable jobs: each reads given tables, uses the library's operators and writes partitioned tables."""
