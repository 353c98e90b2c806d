"""Change ledgers on Spark; see api for the entry points."""

__version__ = "0.2.0"
