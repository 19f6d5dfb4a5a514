"""leafmill: document-ingest, retrieval and quiz-data jobs on Spark."""

__version__ = "0.1.0"
