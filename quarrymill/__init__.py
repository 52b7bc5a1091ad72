"""quarrymill: DataFrame operators for analysing collections of documents, events and labelled predictions."""

__version__ = "0.1.0"
