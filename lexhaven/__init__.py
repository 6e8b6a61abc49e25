"""Retrieval data engine on PySpark: files and text in, searchable vectors out."""
