"""Spark-first analytics over multi-source discussion data."""
