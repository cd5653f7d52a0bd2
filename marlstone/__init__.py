"""Spark-first retrieval, ranking and vector-topology engine."""
