"""Tessera: a PySpark engine for curating educational text and dialogue corpora."""
