"""Oracle-style query semantics and script-corpus jobs as PySpark DataFrame operators."""

__version__ = "0.1.0"
