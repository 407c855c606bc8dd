"""granthvahi: narration text, ledgers and timelines as Spark DataFrames."""

__version__ = "0.1.0"
