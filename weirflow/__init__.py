"""Spark-first analytics over postings, notices, filings and company records."""
