"""Retrieval, governance and evaluation over large document tables, as PySpark DataFrame operators."""
