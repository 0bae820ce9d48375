"""Document-structure analytics on Spark: operators over tables of documents, lines, headings and versions."""

__version__ = "0.1.0"
