"""Tillage: Spark-first feature pipelines and training-data operators."""
