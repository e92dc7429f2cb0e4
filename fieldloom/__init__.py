"""fieldloom: text-evidence preparation, indexing, retrieval and evaluation as Spark plans."""

__version__ = "0.1.0"
