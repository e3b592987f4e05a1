"""Market-data tables, feeds and order books as Spark jobs."""

__version__ = "0.1.0"
