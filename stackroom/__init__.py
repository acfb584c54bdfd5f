"""stackroom: a Spark-native analytics engine for document and media catalogues."""

__version__ = "0.1.0"
