"""Housing-market data work expressed as PySpark DataFrame transformations."""

__version__ = "0.1.0"
