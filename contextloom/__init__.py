"""Context-packing analytics on Spark: repository files as one DataFrame, every step a plan."""

__version__ = "0.1.0"
