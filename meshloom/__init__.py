"""Meshloom: directed graphs and sparse matrices as plain Spark relations."""
