"""Corpus operators for training-data pipelines (documents, pages, embeddings)."""
