"""sievemark: search-evidence analytics and table preparation on PySpark."""

__version__ = "0.1.0"
