"""Seasonal spatio-temporal risk analytics as DataFrame -> DataFrame operators on PySpark."""

__version__ = "0.1.0"
