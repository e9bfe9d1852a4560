"""Repolith: repository-audit jobs and corpus preparation as Spark DataFrame operators."""
