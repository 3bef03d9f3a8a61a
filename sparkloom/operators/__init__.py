"""Operators over DataFrames of files, documents, chunks and points."""
