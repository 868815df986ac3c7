"""Tessellum: Spark-first document structuring, retrieval and graph analytics."""
