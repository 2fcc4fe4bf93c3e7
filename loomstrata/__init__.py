"""loomstrata: a PySpark analytics engine for code graphs, summary evaluation and text corpora."""

__version__ = "0.1.0"
