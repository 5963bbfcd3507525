"""Isohaline: analytics for profiling-float ocean observations, written as Spark jobs."""

__version__ = "0.1.0"
