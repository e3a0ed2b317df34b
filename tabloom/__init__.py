"""Instruction-data preparation, batch generation and judged evaluation as Spark DataFrames."""

__version__ = "0.1.0"
