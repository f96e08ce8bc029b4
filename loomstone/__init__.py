"""loomstone: corpus analytics for language-model training data, on Spark DataFrames."""

__version__ = "0.1.0"
