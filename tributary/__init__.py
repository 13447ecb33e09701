"""Tributary: record pipelines, data quality and pipeline analytics as Spark plans."""
