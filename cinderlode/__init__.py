"""Catalogue analytics on Spark: hybrid retrieval, curation, synchronisation and quality checks as DataFrame plans."""

__all__ = ["core"]
