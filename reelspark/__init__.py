"""Event retrieval, ranking and media-metadata processing as Spark plans."""

__version__ = "0.1.0"
