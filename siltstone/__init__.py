"""siltstone: a document catalog and evidence-retrieval engine on Spark DataFrames."""

__version__ = "0.1.0"
