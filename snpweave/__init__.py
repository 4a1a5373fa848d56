"""snpweave: population-genomics analytics as DataFrame and SQL operations on Spark."""

__version__ = "0.1.0"
