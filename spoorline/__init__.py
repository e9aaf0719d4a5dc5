"""Session provenance analytics on Spark: attribute, connect, score and evaluate."""

__version__ = "0.1.0"
