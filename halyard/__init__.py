"""halyard: customer analytics, demand forecasting and text search as Spark jobs."""

__version__ = "0.1.0"
