"""Relational, structuring, retrieval, extraction and graph operators."""
